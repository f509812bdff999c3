"""Comparison of predictions, runs and back ends."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tessera.functions.statistics import walsh_median
from tessera.operators.order import with_rank

PHASES = ("processing", "setup", "baseline", "hierarchical")


def comparable_rows(df: DataFrame, architectures: Sequence[str], phases: Sequence[str] = PHASES) -> DataFrame:
    """Measured rows of known back ends and phases; an unknown back end in a measured phase is an error."""
    measured = df.filter(F.col("phase").isin(*phases) & (F.col("run_id") >= 0))
    known = F.coalesce(F.col("architecture").isin(*architectures), F.lit(False))
    unknown = measured.filter(~known).select("architecture").first()
    if unknown:
        raise ValueError(f"unknown architecture: {unknown[0]}")
    return measured


def pairs_of(df: DataFrame, column: str = "architecture") -> DataFrame:
    """Unordered pairs ``a < b`` of a column's values (a few per benchmark)."""
    values = df.select(column).distinct()
    return values.select(F.col(column).alias("a")).join(values.select(F.col(column).alias("b")), F.col("a") < F.col("b"))


def percentiles(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Median, 95th and 99th percentile (linear between ranks) and count by key."""
    found = F.percentile(value, F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    return df.groupBy(*keys).agg(F.count(value).alias("n"), found[0].alias("p50"), found[1].alias("p95"), found[2].alias("p99"))


def run_summary(df: DataFrame) -> DataFrame:
    return df.groupBy("phase", "architecture").agg(
        F.count("duration_s").alias("n"), F.avg("duration_s").alias("mean"), F.stddev_samp("duration_s").alias("std"), F.max("duration_s").alias("most")
    )


def run_totals(df: DataFrame) -> DataFrame:
    return df.groupBy("run_id", "architecture").agg(F.sum("duration_s").alias("total_s"))


def paired(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """``keys, a, b, value_a, value_b``: values of two back ends side by side."""
    left = df.select(*keys, F.col("architecture").alias("a"), F.col(value).alias("value_a"))
    right = df.select(*keys, F.col("architecture").alias("b"), F.col(value).alias("value_b"))
    return left.join(right, list(keys)).filter(F.col("a") < F.col("b"))


def paired_differences(df: DataFrame, keys: Sequence[str], value: str, groups: Sequence[str]) -> DataFrame:
    """Mean and deviation of paired differences, and their ratio d_z, for each group and pair."""
    d = F.col("value_a") - F.col("value_b")
    return paired(df, keys, value).groupBy(*groups, "a", "b").agg(
        F.count(d).alias("n"), F.avg(d).alias("mean_difference"), F.stddev_samp(d).alias("std_difference"),
        (F.avg(d) / F.when(F.stddev_samp(d) > 0, F.stddev_samp(d))).alias("d_z"), F.avg(F.log(F.col("value_a") / F.col("value_b"))).alias("mean_log_ratio"),
    )


def speedups(df: DataFrame) -> DataFrame:
    """Ratio of median durations for each phase and pair."""
    medians = df.groupBy("phase", "architecture").agg(F.percentile("duration_s", F.lit(0.5)).alias("p50"))
    return paired(medians, ["phase"], "p50").select("phase", "a", "b", F.try_divide("value_a", "value_b").alias("speedup_of_b"))


def fastest(df: DataFrame) -> DataFrame:
    """The back end with the least mean duration in each phase, ties to the smaller name."""
    means = df.groupBy("phase", "architecture").agg(F.avg("duration_s").alias("mean"))
    return means.groupBy("phase").agg(F.min_by("architecture", F.struct("mean", "architecture")).alias("winner"), F.min("mean").alias("mean"))


def stage_shares(df: DataFrame) -> DataFrame:
    """Seconds of each phase, its share of the back end's total and its ratio to the fastest back end."""
    sums = df.groupBy("phase", "architecture").agg(F.sum("duration_s").alias("seconds"))
    return sums.select(
        "phase", "architecture", "seconds", (F.col("seconds") / F.sum("seconds").over(W.partitionBy("architecture"))).alias("share"),
        (F.col("seconds") / F.min("seconds").over(W.partitionBy("phase"))).alias("ratio_to_fastest"),
    )


def resource_summary(df: DataFrame) -> DataFrame:
    """Means, maxima and sums of nested resource records by phase and back end; warm-ups are left out, unmarked records are an error."""
    if not df.filter(F.col("is_warmup").isNull()).isEmpty():
        raise ValueError("records without a warm-up mark")
    return df.filter(~F.col("is_warmup")).groupBy("phase", "architecture").agg(
        F.avg("cpu_proc.mean").alias("cpu_mean"), F.max("cpu_proc.max").alias("cpu_max"), F.avg("rss_mb.mean").alias("rss_mean"), F.max("rss_mb.max").alias("rss_max"),
        F.sum("io_read_mb").alias("read_mb"), F.sum("io_write_mb").alias("write_mb"), F.count(F.lit(1)).alias("n"),
    )


def adjusted_p(df: DataFrame, p: str = "p", family: Sequence[str] = ()) -> DataFrame:
    """Add Bonferroni and Benjamini-Hochberg adjusted values within each family of tests."""
    within = W.partitionBy(*family)
    m = F.count(p).over(within)
    rank = F.row_number().over(within.orderBy(p))
    down = within.orderBy(F.desc(p), F.desc("_rank")).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn("_rank", rank).withColumn("_step", F.col(p) * m / F.col("_rank")).select(
        *df.columns, F.least(F.col(p) * m, F.lit(1.0)).alias("bonferroni"), F.least(F.min("_step").over(down), F.lit(1.0)).alias("benjamini_hochberg")
    )


def hodges_lehmann(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Median of all Walsh averages, a value with itself included, for each group; a task holds a group's values, never their pairs."""
    kinds = dict(df.dtypes)
    rows = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_value"))

    def median(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({**{k: group[k].iloc[:1] for k in keys}, "hodges_lehmann": [walsh_median(group["_value"].to_numpy())]})

    return rows.groupBy(*keys).applyInPandas(median, ", ".join([*[f"{k} {kinds[k]}" for k in keys], "hodges_lehmann double"]))


def equivalence(low: Column, high: Column, delta: Column) -> Column:
    """Decision for an interval of a minus b against a smallest effect of interest."""
    return (
        F.when(low.isNull() | high.isNull(), "insufficient_data").when((low >= -delta) & (high <= delta), "equivalent")
        .when(low > delta, "a_exceeds_b").when(high < -delta, "b_exceeds_a").otherwise("inconclusive")
    )


def advantage(decision: Column, larger_is_better: Column) -> Column:
    a, b = F.when(larger_is_better, "a").otherwise("b"), F.when(larger_is_better, "b").otherwise("a")
    return F.when(decision == "a_exceeds_b", a).when(decision == "b_exceeds_a", b).otherwise("none")


def repeated_keys(predictions: DataFrame) -> DataFrame:
    """Keys of a prediction table that stand more than once."""
    return predictions.groupBy("fold", "model", "row").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def compare_predictions(left: DataFrame, right: DataFrame) -> DataFrame:
    """Per fold and model of either side: rows, and how the two prediction vectors (``fold, model, row, entity, y_true, y_pred``) relate.

    ``kind`` is disjoint (one side has no such vector), misaligned (rows, entities or observed values differ), divergent (a prediction differs in any
    bit) or equal.
    """
    a, b = (df.select("fold", "model", "row", F.struct("entity", "y_true").alias(f"seen_{x}"), F.col("y_pred").alias(f"pred_{x}"), F.lit(True).alias(f"in_{x}")) for x, df in (("a", left), ("b", right)))
    both = a.join(b, ["fold", "model", "row"], "full_outer")
    met = F.col("in_a").isNotNull() & F.col("in_b").isNotNull()
    found = both.groupBy("fold", "model").agg(
        F.count("in_a").alias("rows_a"), F.count("in_b").alias("rows_b"),
        F.count_if(~met | ~F.col("seen_a").eqNullSafe(F.col("seen_b"))).alias("n_misaligned"),
        F.count_if(met & ~F.col("pred_a").eqNullSafe(F.col("pred_b"))).alias("n_divergent"), F.max(F.abs(F.col("pred_a") - F.col("pred_b"))).alias("max_abs_difference"),
    )
    kind = F.when((F.col("rows_a") == 0) | (F.col("rows_b") == 0), "disjoint").when(F.col("n_misaligned") > 0, "misaligned").when(F.col("n_divergent") > 0, "divergent").otherwise("equal")
    return found.withColumn("kind", kind)


def numbered_predictions(df: DataFrame, entity: str, period: str) -> DataFrame:
    """The stored form of predictions: each row's place in its fold and model, by entity and period."""
    placed = with_rank(df.select("fold", "model", entity, period, "y_true", "y_pred"), ["fold", "model"], [entity, period], "row")
    return placed.select("fold", "model", F.col("row").cast("int").alias("row"), F.col(entity).alias("entity"), "y_true", "y_pred")


def gap_to_baseline(scores: DataFrame, baselines: DataFrame) -> DataFrame:
    """``fold, model, gap``: a model's R2 less that of the fold's best baseline."""
    best = baselines.groupBy("fold").agg(F.max("r2").alias("best_r2"))
    return scores.join(best, "fold").select("fold", "model", (F.col("r2") - F.col("best_r2")).alias("gap"))
