"""One fold from its parts to scored predictions, in the order that keeps the test part unseen, and all folds side by side."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.config import PanelConfig, ProtocolConfig
from tessera.operators import aggregates as A, folds as L, models as M, prep, ridge_cube as RC, selection as S


@dataclass(frozen=True)
class FoldResult:
    """Predictions of the validation and test parts, their scores, and what was learnt on the way."""

    predictions: DataFrame
    metrics: DataFrame
    audit: dict
    medians: dict[str, float]
    shrink: float
    alpha: float


MODELS = ("ridge_hierarchical", "random_forest_hierarchical")


def run_fold(
    df: DataFrame, fold: L.Fold, features: Sequence[str], config: PanelConfig = PanelConfig(), protocol: ProtocolConfig = ProtocolConfig(), models: Sequence[str] = MODELS[:1], forest: dict | None = None
) -> FoldResult:
    """Audit the features on the training part, impute and scale by it, fit on it alone, choose the shrinkage or the forest's shape on the validation part, score both others.

    ``models`` are of ``MODELS``; ``forest`` goes to ``models.choose_forest`` (depths, leaves, trees).  ``df`` has the target and its lags (``panel.with_target``, ``panel.with_lags``).
    """
    features = list(features)
    prep.require_columns(df, [*config.keys, config.target, *features])
    parts = {s: L.split_of(df, fold, s, config).filter(F.col(config.target).isNotNull()) for s in L.SPLITS}
    audit = S.audit_features(parts["train"], features, config, protocol)
    medians = prep.train_statistics(parts["train"], features)
    parts = {s: prep.impute(p, medians) for s, p in parts.items()}
    scales = prep.scaler(parts["train"], features)
    parts = {s: prep.scale(p, scales) for s, p in parts.items()}
    if unknown := set(models) - set(MODELS):
        raise ValueError(f"unknown models: {sorted(unknown)}")
    model = M.choose_shrink(M.fit_hierarchical(parts["train"], features, config=config), parts["val"], protocol.shrinkage, config)
    forecasters = {"ridge_hierarchical": lambda part: model.predict(part, config)}
    if "random_forest_hierarchical" in models:
        forecasters["random_forest_hierarchical"] = M.choose_forest(parts["train"], parts["val"], features, config=config, **(forest or {}))
    scored = [
        forecasters[m](parts[s]).select(F.lit(fold.fold).alias("fold"), F.lit(s).alias("split"), F.lit(m).alias("model"), *config.keys, F.col(config.target).alias("y_true"), "y_pred")
        for m in models for s in ("val", "test")
    ]
    predictions = reduce(DataFrame.union, scored)
    scale = A.mase_scale(parts["train"], config).first()["scale"]
    metrics = A.error_metrics(predictions, ["fold", "model", "split"], F.lit(scale).cast("double"))
    return FoldResult(predictions, metrics, audit, medians, model.shrink, model.ridge.alpha)


@dataclass(frozen=True)
class FoldResults:
    """``FoldResult`` of all folds: predictions and scores in one table each, what was learnt by fold."""

    predictions: DataFrame
    metrics: DataFrame
    audits: dict[int, dict]
    settings: dict[int, RC.FoldSettings]


def run_folds(df: DataFrame, folds: Sequence[L.Fold], features: Sequence[str], config: PanelConfig = PanelConfig(), protocol: ProtocolConfig = ProtocolConfig()) -> FoldResults:
    """``run_fold`` of every fold with the ridge, by jobs whose number does not depend on the number of folds.

    Features are audited on every training part before anything is fitted; imputation, scaling, fit and shrinkage are those of ``ridge_cube.all_folds``.
    """
    features = list(features)
    prep.require_columns(df, [*config.keys, config.target, *features])
    audits = S.audit_folds(df, folds, features, config, protocol)
    found, settings = RC.all_folds(df, folds, features, protocol.shrinkage, config=config)
    predictions = found.select("fold", "split", F.lit(MODELS[0]).alias("model"), *config.keys, "y_true", "y_pred")
    scales = F.broadcast(A.mase_scales(df, folds, config).select("fold", F.col("scale").alias("_scale")))
    return FoldResults(predictions, A.error_metrics(predictions.join(scales, "fold", "left"), ["fold", "model", "split"], F.col("_scale")), audits, settings)


def each_fold(spark: SparkSession, folds: Sequence[L.Fold], work: Callable[[L.Fold], Any], parallelism: int = 8) -> list:
    """``work`` of every fold, in the order of ``folds``.  Folds need nothing of each other, so their many small jobs are submitted from ``parallelism`` threads."""
    with ThreadPoolExecutor(max(1, parallelism)) as pool:
        return list(pool.map(inheritable_thread_target(spark)(work), folds))
