"""Baseline forecasts of all folds at once, as joins and aggregates over the folded panel.

Each takes the output of ``folds.materialise`` and returns ``fold, split, model, <keys>, y_true, y_pred`` for the validation and test rows that have a
target.  Validation rows may use the training part, test rows the training and validation parts, and only periods at least ``lag`` before the row's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tessera.config import PanelConfig


def _scored(folded: DataFrame, config: PanelConfig) -> DataFrame:
    return folded.filter((F.col("split") != "train") & F.col(config.target).isNotNull()).select(
        "fold", "split", *config.keys, F.col(config.target).alias("y_true")
    )


def _history(folded: DataFrame, config: PanelConfig) -> DataFrame:
    """``fold, for_split`` and the rows that a part may look back on."""
    rows = folded.filter((F.col("split") != "test") & F.col(config.target).isNotNull())
    uses = F.when(F.col("split") == "train", F.array(F.lit("val"), F.lit("test"))).otherwise(F.array(F.lit("test")))
    return rows.select("fold", F.explode(uses).alias("split"), *config.keys, F.col(config.target).alias("y"))


def _answer(rows: DataFrame, model: str, prediction: Column, config: PanelConfig) -> DataFrame:
    return rows.select("fold", "split", F.lit(model).alias("model"), *config.keys, "y_true", prediction.alias("y_pred"))


def global_mean(folded: DataFrame, config: PanelConfig = PanelConfig()) -> DataFrame:
    """The training part's mean."""
    means = folded.filter("split = 'train'").groupBy("fold").agg(F.avg(config.target).alias("m"))
    return _answer(_scored(folded, config).join(F.broadcast(means), "fold"), "global_mean", F.col("m"), config)


def linear_trend(folded: DataFrame, config: PanelConfig = PanelConfig()) -> DataFrame:
    """Least squares of the training target on the period; the mean where all rows share a period."""
    y, x = F.col(config.target), F.col(config.period)
    lines = folded.filter("split = 'train'").groupBy("fold").agg(
        F.coalesce(F.regr_slope(y, x), F.lit(0.0)).alias("b"), F.coalesce(F.regr_intercept(y, x), F.avg(y)).alias("a")
    )
    return _answer(_scored(folded, config).join(F.broadcast(lines), "fold"), "linear_trend", F.col("a") + F.col("b") * x, config)


def naive_with_lag(folded: DataFrame, lag: int = 2, config: PanelConfig = PanelConfig()) -> DataFrame:
    """The entity's last observation at least ``lag`` periods before, else the mean of what may be looked back on.

    Rows and history are one stream by entity: history is moved ``lag`` periods on, so that the last value up to a row's period is the answer.  One sort
    replaces a range join.
    """
    rows, history = _scored(folded, config), _history(folded, config)
    means = history.groupBy("fold", "split").agg(F.avg("y").alias("m"))
    entity, period = config.keys
    events = rows.select("fold", "split", entity, F.col(period).cast("int").alias("at"), F.lit(1).alias("kind"), "y_true", F.lit(None).cast("double").alias("y")).unionByName(
        history.select("fold", "split", entity, (F.col(period) + lag).cast("int").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("double").alias("y_true"), "y")
    )
    past = W.partitionBy("fold", "split", entity).orderBy("at", "kind").rowsBetween(W.unboundedPreceding, 0)
    last = events.withColumn("last", F.last("y", ignorenulls=True).over(past)).filter("kind = 1").withColumnRenamed("at", period)
    return _answer(last.join(F.broadcast(means), ["fold", "split"]), "naive_with_lag", F.coalesce("last", "m"), config)


def cross_entity(folded: DataFrame, lag: int = 2, config: PanelConfig = PanelConfig()) -> DataFrame:
    """Mean of the other entities' mean targets up to ``lag`` periods before; else the mean of what may be looked back on.

    Entity means at each cutoff come from running sums over the entity's history spread to all cutoffs; their sum over entities, less the row's own, gives the answer.
    """
    rows, history = _scored(folded, config), _history(folded, config)
    entity, period = config.keys
    means = history.groupBy("fold", "split").agg(F.avg("y").alias("m"))
    cutoffs = rows.select("fold", "split", (F.col(period) - lag).cast("int").alias("cutoff")).distinct()
    reach = history.join(F.broadcast(cutoffs), ["fold", "split"]).filter(F.col(period) <= F.col("cutoff"))
    at = reach.groupBy("fold", "split", "cutoff", entity).agg(F.avg("y").alias("own"))
    total = at.groupBy("fold", "split", "cutoff").agg(F.sum("own").alias("s"), F.count("own").alias("n"))
    found = (
        rows.withColumn("cutoff", (F.col(period) - lag).cast("int"))
        .join(at, ["fold", "split", "cutoff", entity], "left")
        .join(F.broadcast(total), ["fold", "split", "cutoff"], "left")
        .join(F.broadcast(means), ["fold", "split"], "left")
    )
    others = F.try_divide(F.col("s") - F.coalesce("own", F.lit(0.0)), F.col("n") - F.col("own").isNotNull().cast("int"))
    return _answer(found, "cross_entity", F.coalesce(others, "m"), config)


def all_baselines(folded: DataFrame, lag: int = 2, config: PanelConfig = PanelConfig()) -> DataFrame:
    return global_mean(folded, config).union(linear_trend(folded, config)).union(naive_with_lag(folded, lag, config)).union(cross_entity(folded, lag, config))


def best_by_validation(metrics: DataFrame) -> DataFrame:
    """Per fold, the model with the highest validation R2 (ties by name), its test R2 and the difference; folds without a defined R2 are left out."""
    wide = metrics.groupBy("fold", "model").agg(F.max(F.when(F.col("split") == "val", F.col("r2"))).alias("val_r2"), F.max(F.when(F.col("split") == "test", F.col("r2"))).alias("test_r2"))
    best = F.row_number().over(W.partitionBy("fold").orderBy(F.desc("val_r2"), "model"))
    return wide.filter(F.col("val_r2").isNotNull() & ~F.isnan("val_r2")).withColumn("_r", best).filter("_r = 1").select(
        "fold", "model", "val_r2", "test_r2", (F.col("val_r2") - F.col("test_r2")).alias("generalisation_gap")
    )


def predictability(metrics: DataFrame) -> DataFrame:
    """Mean, population deviation, least and most validation R2 of each model over folds, and the level it stands for."""
    mean = F.avg("r2")
    level = F.when(mean < 0, "none").when(mean < 0.05, "very_low").when(mean < 0.15, "low").when(mean < 0.35, "moderate").otherwise("high")
    return metrics.filter((F.col("split") == "val") & F.col("r2").isNotNull()).groupBy("model").agg(
        F.count("r2").alias("n_folds"), mean.alias("mean_r2"), F.stddev_pop("r2").alias("std_r2"), F.min("r2").alias("least_r2"), F.max("r2").alias("most_r2"), level.alias("level")
    )


def generalisation_gaps(metrics: DataFrame) -> DataFrame:
    """Mean and population deviation of validation less test R2 of each model over the folds where both are defined, mean test R2, and the band of the mean gap."""
    wide = metrics.groupBy("fold", "model").agg(F.max(F.when(F.col("split") == "val", F.col("r2"))).alias("val_r2"), F.max(F.when(F.col("split") == "test", F.col("r2"))).alias("test_r2"))
    gap = F.col("val_r2") - F.col("test_r2")
    away = F.abs(F.avg(gap))
    band = F.when(away <= 0.15, "within_target").when(away <= 0.2, "moderate").otherwise("high")
    return wide.filter(gap.isNotNull() & ~F.isnan(gap)).groupBy("model").agg(
        F.count(gap).alias("n_folds"), F.avg(gap).alias("mean_gap"), F.stddev_pop(gap).alias("std_gap"), F.avg("test_r2").alias("mean_test_r2"), band.alias("band")
    )


def stability(gaps: DataFrame) -> DataFrame:
    """One row: the mean of the models' mean gaps, its band, and the model of highest mean test R2 (ties by name)."""
    away = F.abs(F.avg("mean_gap"))
    level = F.when(away <= 0.05, "excellent").when(away <= 0.1, "good").when(away <= 0.15, "moderate").when(away.isNotNull(), "low")
    return gaps.agg(F.avg("mean_gap").alias("mean_gap"), level.alias("level"), F.min_by("model", F.struct(-F.col("mean_test_r2"), "model")).alias("best"))
