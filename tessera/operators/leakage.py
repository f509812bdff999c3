"""What leakage does to scores: the same ridge under walk-forward folds with clean features, and under folds that ignore time with a feature that knows the target."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from tessera.config import PanelConfig
from tessera.operators.aggregates import error_metrics
from tessera.operators.folds import Fold
from tessera.operators.models import ridge_weights
from tessera.operators.ridge_cube import second_moments, segments
from tessera.sources.staging import stage

FIT = "fold int, _first int, _last int, _start double, _slopes array<double>"


def inflated_scores(
    df: DataFrame, folds: Sequence[Fold], clean: Sequence[str], leaked: Sequence[str], part: Column, parts: int = 9, alpha: float = 1.0, config: PanelConfig = PanelConfig()
) -> DataFrame:
    """``setting, fold, n, r2, rmse, mae, ...``: error metrics of both settings.

    ``clean`` trains on each fold's training part and is scored on its test part, with the features ``clean``.  ``leaked`` deals all rows to ``parts`` by ``part`` (0 to ``parts`` - 1),
    trains on all parts but one and is scored on that one, with ``clean`` and ``leaked``.  Both use the rows with a target and all features.  Models come from moments by
    segment of periods and by part, in one aggregation each; rows are read again only to be scored.  Settings and folds without a training row are left out.
    """
    spark, both = df.sparkSession, [*clean, *leaked]
    names = [f"_x{i}" for i in range(len(both))]
    cuts, members = segments(folds)
    number = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col("_period")))
    rows = df.select(
        F.col(config.period).alias("_period"), F.col(config.target).cast("double").alias("y_true"), part.cast("int").alias("_part"), *[F.col(f).cast("double").alias(n) for f, n in zip(both, names)]
    ).dropna(subset=["y_true", *names])
    rows = stage(rows.withColumn("_segment", number), "leakage-rows")

    def fitted(m: np.ndarray) -> tuple[float, list[float]]:
        weights, start = ridge_weights(m, alpha)
        return float(start), [float(w) for w in weights]

    columns = lambda features: [F.lit(1.0), *[F.col(n) for n in features], F.col("y_true")]
    empty = np.zeros((len(clean) + 2, len(clean) + 2))
    by_segment = second_moments(rows.filter((F.col("_period") >= cuts[0]) & (F.col("_period") < cuts[-1])), columns(names[: len(clean)]), ["_segment"])
    past = [(f, sum((by_segment.get((s,), empty) for s in members[f.fold]), empty)) for f in folds]
    by_part = second_moments(rows, columns(names), ["_part"])
    whole = sum(by_part.values(), np.zeros((len(both) + 2, len(both) + 2)))
    others = [(k, whole - by_part[k,]) for k in range(parts) if (k,) in by_part]
    clean_fits = [(f.fold, f.test_start, f.test_end, *fitted(m)) for f, m in past if m[0, 0]]
    leaked_fits = [(k, None, None, *fitted(m)) for k, m in others if m[0, 0]]

    def scored(setting: str, fits: list, met: Column, width: int) -> DataFrame:
        answer = F.col("_start")
        for i in range(width):
            answer = answer + F.get("_slopes", F.lit(i)) * F.col(names[i])
        # one row for each fold or part
        return rows.join(F.broadcast(spark.createDataFrame(fits, FIT)), met).select(F.lit(setting).alias("setting"), "fold", "y_true", answer.alias("y_pred"))

    predictions = scored("clean", clean_fits, F.col("_period").between(F.col("_first"), F.col("_last")), len(clean)).union(
        scored("leaked", leaked_fits, F.col("_part") == F.col("fold"), len(both))
    )
    return error_metrics(predictions, ["setting", "fold"])


def inflation(scores: DataFrame) -> DataFrame:
    """One row: folds, mean and population deviation of R2 and MAE of both settings, and how much leakage adds to R2 and takes from MAE."""
    of = lambda setting, c: F.when(F.col("setting") == setting, F.col(c))
    one = scores.agg(*[
        f(of(s, c)).alias(f"{s}_{c}_{name}") for s in ("clean", "leaked") for c in ("r2", "mae") for name, f in (("n", F.count), ("mean", F.avg), ("std", F.stddev_pop))
    ])
    gained = F.col("leaked_r2_mean") - F.col("clean_r2_mean")
    return one.select(
        F.col("clean_mae_n").alias("clean_folds"), F.col("leaked_mae_n").alias("leaked_folds"), *[f"{s}_{c}_{n}" for s in ("clean", "leaked") for c in ("r2", "mae") for n in ("mean", "std")],
        gained.alias("r2_inflation"), (gained / F.greatest(F.abs("clean_r2_mean"), F.lit(1e-9)) * 100).alias("r2_inflation_percent"),
        (F.col("clean_mae_mean") - F.col("leaked_mae_mean")).alias("mae_reduction"),
    )
