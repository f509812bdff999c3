"""Summaries of panels and of predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tessera.config import PanelConfig
from tessera.functions.expressions import correlation
from tessera.operators.folds import Fold, fold_bounds
from tessera.operators.order import exact_percentiles, with_previous
from tessera.operators.panel import ordered


def overview(df: DataFrame, config: PanelConfig = PanelConfig()) -> DataFrame:
    """Rows, distinct entities and periods, and moments of the target."""
    y = config.target
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct(config.entity).alias("n_entities"), F.count_distinct(config.period).alias("n_periods"),
        F.min(config.period).alias("first_period"), F.max(config.period).alias("last_period"), F.count(y).alias("n_target"),
        F.avg(y).alias("mean"), F.stddev_samp(y).alias("std"), F.min(y).alias("least"), F.max(y).alias("most"),
    )


def target_profile(df: DataFrame, config: PanelConfig = PanelConfig()) -> DataFrame:
    """Completeness, quartiles, range, coefficient of variation and out-of-range count of the target."""
    y = config.target
    mean, std = F.avg(y), F.stddev_pop(y)
    one = df.agg(
        F.count(y).alias("n_valid"), (F.count(F.lit(1)) - F.count(y)).alias("n_missing"), (F.count(y) * 100.0 / F.count(F.lit(1))).alias("completeness"),
        mean.alias("mean"), std.alias("std_pop"), F.try_divide(std, mean).alias("variation"), (F.max(y) - F.min(y)).alias("spread"),
        F.count_if((F.col(y) < 0) | (F.col(y) > 100)).alias("n_out_of_range"),
    )
    quartile = exact_percentiles(df, [], [y], [0.25, 0.5, 0.75]).select(*[F.col("values")[i].alias(c) for i, c in enumerate(("q25", "median", "q75"))])  # one row, none without values
    return one.join(F.broadcast(quartile), F.lit(True), "left").withColumn("iqr", F.col("q75") - F.col("q25")).select(
        "n_valid", "n_missing", "completeness", "mean", "std_pop", "variation", "q25", "median", "q75", "iqr", "spread", "n_out_of_range"
    )


def by_key(df: DataFrame, key: str, value: str) -> DataFrame:
    """Count, mean, sample deviation, least and most of a value for each key."""
    return df.groupBy(key).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("least"), F.max(value).alias("most")
    )


def spread_of_entities(df: DataFrame, config: PanelConfig = PanelConfig()) -> DataFrame:
    """Least, most and deviation of the entities' mean targets, and which entities they are (ties to the smaller id)."""
    means = df.groupBy(config.entity).agg(F.avg(config.target).alias("m")).filter(F.col("m").isNotNull())
    first = lambda order: F.min_by(config.entity, F.struct(order, F.col(config.entity)))
    return means.agg(
        F.count(F.lit(1)).alias("n_entities"), F.min("m").alias("least_mean"), F.max("m").alias("most_mean"), F.stddev_samp("m").alias("std_of_means"),
        first(F.col("m")).alias("least_entity"), first(-F.col("m")).alias("most_entity"),
    )


def entity_summary(df: DataFrame, columns: Sequence[str], config: PanelConfig = PanelConfig(), most: int = 5) -> DataFrame:
    """Means of the first few columns and the number of rows by entity and stratum."""
    return df.groupBy(config.entity, config.stratum).agg(*[F.avg(c).alias(f"avg_{c}") for c in list(columns)[:most]], F.count(F.lit(1)).alias("n_rows"))


def coverage_by_stratum(df: DataFrame, column: str, config: PanelConfig = PanelConfig()) -> DataFrame:
    return df.groupBy(config.stratum).agg(
        F.count_distinct(config.entity).alias("n_entities"), F.count_distinct(config.period).alias("n_periods"), F.avg(column).alias("mean")
    )


def longitudinal(dimension: DataFrame, df: DataFrame, columns: Sequence[str], config: PanelConfig = PanelConfig()) -> DataFrame:
    """For every entity of the dimension: distinct periods, first and last period, and means (null without rows)."""
    facts = df.groupBy(config.entity).agg(
        F.count_distinct(config.period).alias("n_periods"), F.min(config.period).alias("first_period"), F.max(config.period).alias("last_period"),
        *[F.avg(c).alias(f"avg_{c}") for c in columns],
    )
    return dimension.join(facts, config.entity, "left").withColumn("n_periods", F.coalesce("n_periods", F.lit(0)))


def missing_by(df: DataFrame, columns: Sequence[str], key: str | None = None) -> DataFrame:
    """Missing and present values of each column, over all rows or for each key: ``[key,] indicator, n_rows, n_missing, missing_share``."""
    groups = [key] if key else []
    counted = df.groupBy(*groups).agg(F.count(F.lit(1)).alias("n_rows"), *[F.count(c).alias(f"_{c}") for c in columns])
    rows = F.array(*[F.struct(F.lit(c).alias("indicator"), (F.col("n_rows") - F.col(f"_{c}")).alias("n_missing")) for c in columns])
    return counted.select(*groups, "n_rows", F.inline(rows)).withColumn("missing_share", F.try_divide(F.col("n_missing").cast("double"), F.col("n_rows")))


def correlation_pairs(df: DataFrame, columns: Sequence[str], complete: bool = True) -> DataFrame:
    """``a, b, r`` for each pair of columns in one pass, over complete rows or over rows complete for the pair."""
    rows = df.dropna(subset=list(columns)) if complete else df
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    if not pairs:
        return df.sparkSession.createDataFrame([], "a string, b string, r double")
    one = rows.agg(*[correlation(F.col(a), F.col(b)).alias(f"{i}") for i, (a, b) in enumerate(pairs)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{i}").alias("r")) for i, (a, b) in enumerate(pairs)])))


def missingness_correlation(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean absolute correlation of the columns' missing marks (those without variance left out), and whether it is low enough to be at random."""
    marks = df.select(*[F.col(c).isNull().cast("double").alias(c) for c in columns])
    mean = F.avg(F.abs("r"))
    return correlation_pairs(marks, columns).agg(F.count("r").alias("n_pairs"), mean.alias("mean_abs_r"), (mean < 0.3).alias("at_random"))


def target_correlations(df: DataFrame, features: Sequence[str], config: PanelConfig = PanelConfig()) -> DataFrame:
    """``feature, r_abs`` with each feature's absolute correlation with the target, 0 where it is undefined, and whether it was."""
    one = df.agg(*[correlation(F.col(f), F.col(config.target)).alias(f) for f in features])
    rows = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("r")) for f in features])
    return one.select(F.inline(rows)).select("feature", F.coalesce(F.abs("r"), F.lit(0.0)).alias("r_abs"), F.col("r").isNull().alias("undefined"))


def lag_autocorrelation(df: DataFrame, columns: Sequence[str], config: PanelConfig = PanelConfig(), within_entities: bool = True) -> DataFrame:
    """Correlation of each column with its entity's previous row; on request the first row of an entity follows the last one of the entity before.

    The latter sorts the entities' first and last rows by ranges, each of which hands its last entity to the next.
    """
    lagged = df.select(*columns, *[F.lag(c).over(ordered(config)).alias(f"_{c}") for c in columns])
    if not within_entities:
        first = lambda order, c: F.min_by(F.struct(*columns), order).alias(c)
        ends = df.groupBy(config.entity).agg(first(F.col(config.period), "first"), first(-F.col(config.period), "last"))
        linked = with_previous(ends, [config.entity], ["last"], "before_").withColumnRenamed("before_last", "before").filter("before IS NOT NULL")
        lagged = lagged.union(linked.select(*[F.col(f"first.{c}") for c in columns], *[F.col(f"before.{c}").alias(f"_{c}") for c in columns]))
    one = lagged.agg(*[correlation(F.col(c), F.col(f"_{c}")).alias(c) for c in columns])
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("indicator"), F.col(c).alias("r")) for c in columns])))


def profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column: missing percentage, whether it has no variance, and how many values are infinite."""
    one = df.agg(*[
        F.struct(
            F.lit(c).alias("indicator"), ((F.count(F.lit(1)) - F.count(c)) * 100.0 / F.count(F.lit(1))).alias("missing_percent"),
            (F.coalesce(F.max(c) - F.min(c), F.lit(0.0)) == 0).alias("constant"), F.count_if(F.abs(c) == float("inf")).alias("n_infinite"),
        ).alias(c)
        for c in columns
    ])
    return one.select(F.inline(F.array(*columns)))


def duplicate_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def imputation_quality(before: DataFrame, after: DataFrame, columns: Sequence[str], categories: dict[str, str], config: PanelConfig = PanelConfig()) -> DataFrame:
    """Per indicator: filled cells, rate, bias of the mean in per cent and share of variance preserved."""
    pair = before.select(*config.keys, *[F.col(c).alias(f"_{c}") for c in columns]).join(after.select(*config.keys, *columns), config.keys)
    def measures(c: str) -> Column:
        old, new = F.col(f"_{c}"), F.col(c)
        return F.struct(
            F.lit(c).alias("indicator"), F.lit(categories.get(c, "other")).alias("category"), F.count_if(old.isNull() & new.isNotNull()).alias("n_filled"),
            F.try_divide(F.count_if(old.isNull() & new.isNotNull()).cast("double"), F.count_if(old.isNull())).alias("fill_rate"),
            F.try_divide((F.avg(new) - F.avg(old)) * 100.0, F.abs(F.avg(old))).alias("bias_percent"),
            F.try_divide(F.var_samp(new), F.var_samp(old)).alias("variance_preserved"),
        ).alias(c)
    return pair.agg(*[measures(c) for c in columns]).select(F.inline(F.array(*columns)))


def group_centred(df: DataFrame, value: str, config: PanelConfig = PanelConfig()) -> DataFrame:
    """Add the value less its entity's mean."""
    return df.withColumn("centred", F.col(value) - F.avg(value).over(W.partitionBy(config.entity)))


def within_share(df: DataFrame, value: str, config: PanelConfig = PanelConfig()) -> DataFrame:
    """Share of a value's variance that lies within entities."""
    return group_centred(df, value, config).agg(F.try_divide(F.var_samp("centred"), F.var_samp(value)).alias("within_share"))


def residual_dependence(df: DataFrame, value: str, most: int = 6, least_pairs: int = 30, config: PanelConfig = PanelConfig()) -> DataFrame:
    """``lag, n_pairs, r``: correlation of centred values of the same entity ``lag`` periods apart, null under ``least_pairs``."""
    centred = group_centred(df, value, config).select(*config.keys, "centred").filter(F.col("centred").isNotNull())
    later = centred.select(config.entity, F.explode(F.sequence(F.lit(1), F.lit(most))).alias("lag"), config.period, F.col("centred").alias("now"))
    earlier = centred.select(config.entity, F.col(config.period).alias("_then"), F.col("centred").alias("then"))
    pairs = later.withColumn("_then", F.col(config.period) - F.col("lag")).join(earlier, [config.entity, "_then"])
    return pairs.groupBy("lag").agg(F.count(F.lit(1)).alias("n_pairs"), F.when(F.count(F.lit(1)) >= least_pairs, correlation(F.col("now"), F.col("then"))).alias("r"))


def mase_scale(df: DataFrame, config: PanelConfig = PanelConfig()) -> DataFrame:
    """Mean absolute change of the target between an entity's consecutive rows."""
    moved = df.filter(F.col(config.target).isNotNull()).withColumn("_change", F.col(config.target) - F.lag(config.target).over(ordered(config)))
    return moved.agg(F.avg(F.abs("_change")).alias("scale"), F.count("_change").alias("n_changes"))


def mase_scales(df: DataFrame, folds: Sequence[Fold], config: PanelConfig = PanelConfig()) -> DataFrame:
    """``mase_scale`` of each fold's training part, with ``fold``: a change counts where both of its rows lie in that part."""
    lag = lambda c: F.lag(c).over(ordered(config))
    moved = df.filter(F.col(config.target).isNotNull()).select(F.col(config.period).alias("_at"), lag(config.period).alias("_from"), (F.col(config.target) - lag(config.target)).alias("_change"))
    bounds = F.broadcast(fold_bounds(df.sparkSession, folds).filter("split = 'train'"))
    held = moved.join(bounds, (F.col("_from") >= F.col("first_period")) & (F.col("_at") <= F.col("last_period")))
    return held.groupBy("fold").agg(F.avg(F.abs("_change")).alias("scale"), F.count("_change").alias("n_changes"))


def shrunken_means(df: DataFrame, strength: float = 5.0, config: PanelConfig = PanelConfig()) -> DataFrame:
    """Entity means drawn towards the overall mean by ``n / (n + strength)``."""
    entities = df.groupBy(config.entity).agg(F.count(config.target).alias("n"), F.sum(config.target).alias("_sum"))
    overall = F.col("_overall")
    weight = F.col("n") / (F.col("n") + F.lit(strength))
    whole = entities.agg(F.try_divide(F.sum("_sum"), F.sum("n")).alias("_overall"))  # one row, over the same exchange
    return entities.crossJoin(F.broadcast(whole)).select(config.entity, "n", (weight * F.try_divide(F.col("_sum"), F.col("n")) + (1 - weight) * overall).alias("shrunken_mean"))


def error_metrics(predictions: DataFrame, keys: Sequence[str], scale: Column | None = None, floor: float = 1e-12) -> DataFrame:
    """R2, MSE, RMSE, MAE, WAPE and MASE of ``y_true, y_pred`` for each key, in one pass; null where undefined."""
    e = F.col("y_true") - F.col("y_pred")
    n, sse, sst = F.count(e), F.sum(e * e), F.var_pop("y_true") * F.count("y_true")
    mae = F.avg(F.abs(e))
    scale = scale if scale is not None else F.lit(None).cast("double")
    return predictions.filter(e.isNotNull()).groupBy(*keys).agg(
        n.alias("n"), F.when(sst > 0, 1 - sse / F.when(sst > 0, sst)).alias("r2"), (sse / n).alias("mse"), F.sqrt(sse / n).alias("rmse"), mae.alias("mae"),
        (F.sum(F.abs(e)) / F.greatest(F.sum(F.abs("y_true")), F.lit(floor))).alias("wape"), F.try_divide(mae, F.max(scale)).alias("mase"),
    )
