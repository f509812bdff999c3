"""Hierarchical models: entity means drawn to the overall mean, and a regression of what they leave."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from tessera.config import PanelConfig
from tessera.operators.aggregates import shrunken_means

ALPHAS = tuple(np.logspace(-1, 3, 20))


@dataclass(frozen=True)
class RidgeFit:
    """Ridge weights for residuals, with the groups' moments they came from."""

    features: list[str]
    weights: np.ndarray
    intercept: float
    alpha: float


def balanced_groups(sizes: dict[str, int], folds: int) -> dict[str, int]:
    """Deal groups to folds, the largest first, each to the lightest fold (ties to the first)."""
    load, out = [0] * folds, {}
    for group, size in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        lightest = load.index(min(load))
        out[group], load[lightest] = lightest, load[lightest] + size
    return out


def _group_moments(df: DataFrame, features: Sequence[str], residual: str, group: str) -> dict[str, np.ndarray]:
    """Raw second moments of ``[1, features, residual]`` by group, in one aggregation."""
    columns = [F.lit(1.0), *[F.col(f) for f in features], F.col(residual)]
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    found = df.groupBy(group).agg(*[F.sum(columns[i] * columns[j]).alias(f"p{i}_{j}") for i, j in pairs]).collect()
    out = {}
    for r in found:
        m = np.zeros((len(columns), len(columns)))
        for i, j in pairs:
            m[i, j] = m[j, i] = r[f"p{i}_{j}"]
        out[r[group]] = m
    return out


def ridge_weights(m: np.ndarray, alpha: float) -> tuple[np.ndarray, float]:
    """Weights and intercept from the raw second moments of ``[1, features, target]``."""
    n, means = m[0, 0], m[0, 1:] / m[0, 0]
    centred = m[1:, 1:] - n * np.outer(means, means)
    weights = np.linalg.solve(centred[:-1, :-1] + alpha * np.eye(len(centred) - 1), centred[:-1, -1])
    return weights, float(means[-1] - weights @ means[:-1])


def _error(m: np.ndarray, weights: np.ndarray, intercept: float) -> float:
    v = np.concatenate([[-intercept], -weights, [1.0]])
    return float(v @ m @ v / m[0, 0])


def ridge_by_groups(df: DataFrame, features: Sequence[str], residual: str, group: str, buckets: int = 64, folds: int = 3) -> RidgeFit:
    """Ridge with the penalty of least error on held-out groups.

    Groups are hashed into at most ``buckets`` before they are gathered, so the moments that reach the driver have a fixed bound.
    """
    keyed = df.withColumn("_group", F.pmod(F.xxhash64(group), F.lit(buckets)).cast("string"))
    return ridge_of_moments(_group_moments(keyed, features, residual, "_group"), features, folds)


def ridge_of_moments(by_group: dict[str, np.ndarray], features: Sequence[str], folds: int = 3) -> RidgeFit:
    """Ridge from the raw second moments of ``[1, features, residual]`` by group, with the penalty of least error on held-out groups."""
    sizes = {g: int(round(m[0, 0])) for g, m in by_group.items()}
    whole = sum(by_group.values())
    alpha = ALPHAS[0]
    if len(by_group) > 1:
        dealt = balanced_groups(sizes, min(folds, len(by_group)))
        parts = [sum(by_group[g] for g in by_group if dealt[g] == k) for k in range(max(dealt.values()) + 1)]
        errors = [np.mean([_error(p, *ridge_weights(whole - p, a)) for p in parts]) for a in ALPHAS]
        alpha = ALPHAS[int(np.argmin(errors))]
    return RidgeFit(list(features), *ridge_weights(whole, alpha), alpha)


@dataclass(frozen=True)
class HierarchicalModel:
    means: DataFrame
    overall: float
    ridge: RidgeFit
    shrink: float

    def predict(self, df: DataFrame, config: PanelConfig = PanelConfig()) -> DataFrame:
        """Add ``y_pred``; an entity not met in training starts from the overall mean."""
        joined = df.join(self.means, config.entity, "left").withColumn("_base", F.coalesce("shrunken_mean", F.lit(self.overall)))
        fitted = F.lit(self.ridge.intercept)
        for feature, weight in zip(self.ridge.features, self.ridge.weights.tolist()):
            fitted = fitted + F.lit(weight) * F.col(feature)
        return joined.withColumn("y_pred", F.col("_base") + F.lit(self.shrink) * fitted).drop("_base", "shrunken_mean")


def fit_hierarchical(train: DataFrame, features: Sequence[str], shrink: float = 1.0, config: PanelConfig = PanelConfig()) -> HierarchicalModel:
    """Fit on training rows with a target and no missing feature."""
    rows = train.dropna(subset=[config.target, *features])
    means = shrunken_means(rows, config=config).select(config.entity, "shrunken_mean")
    overall = rows.agg(F.avg(config.target)).first()[0]
    residuals = rows.join(means, config.entity).withColumn("_residual", F.col(config.target) - F.col("shrunken_mean"))
    return HierarchicalModel(means, overall, ridge_by_groups(residuals, features, "_residual", config.entity), shrink)


def choose_shrink(model: HierarchicalModel, validation: DataFrame, candidates: Sequence[float], config: PanelConfig = PanelConfig()) -> HierarchicalModel:
    """The first shrinkage with the strictly best validation error; all are scored in one pass."""
    y = F.col(config.target)
    scored = HierarchicalModel(model.means, model.overall, model.ridge, 1.0).predict(validation, config)
    base = HierarchicalModel(model.means, model.overall, model.ridge, 0.0).predict(scored.withColumnRenamed("y_pred", "_full"), config)
    errors = base.agg(*[F.avg((y - (F.col("y_pred") + F.lit(s) * (F.col("_full") - F.col("y_pred")))) ** 2) for s in candidates]).first()
    best = min(range(len(candidates)), key=lambda i: (errors[i] is None, errors[i], i))
    return HierarchicalModel(model.means, model.overall, model.ridge, candidates[best])


def fit_forest(train: DataFrame, features: Sequence[str], depth: int = 6, leaf: int = 8, trees: int = 200, seed: int = 42, config: PanelConfig = PanelConfig()):
    """Random forest over the features and the entity's shrunken mean; returns a function that adds ``y_pred``."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    rows = train.dropna(subset=[config.target, *features])
    means = shrunken_means(rows, config=config).select(config.entity, F.col("shrunken_mean").alias("entity_effect"))
    overall = rows.agg(F.avg(config.target)).first()[0]
    assembler = VectorAssembler(inputCols=[*features, "entity_effect"], outputCol="_features")

    def prepared(df: DataFrame) -> DataFrame:
        joined = df.dropna(subset=list(features)).join(means, config.entity, "left")
        return assembler.transform(joined.withColumn("entity_effect", F.coalesce("entity_effect", F.lit(overall))))

    forest = RandomForestRegressor(
        featuresCol="_features", labelCol=config.target, predictionCol="y_pred", numTrees=trees, maxDepth=depth, minInstancesPerNode=leaf, featureSubsetStrategy="sqrt", seed=seed
    ).fit(prepared(rows))
    return lambda df: forest.transform(prepared(df)).drop("_features", "entity_effect")


def choose_forest(
    train: DataFrame, validation: DataFrame, features: Sequence[str], depths: Sequence[int] = (5, 6, 7), leaves: Sequence[int] = (5, 8, 12), trees: int = 200, seed: int = 42, config: PanelConfig = PanelConfig()
):
    """The forest of least validation error over depths and leaves, the first of equals; all are fit on the training part alone."""
    train, validation = train.persist(), validation.persist()
    best, least = None, None
    for depth in depths:
        for leaf in leaves:
            model = fit_forest(train, features, depth=depth, leaf=leaf, trees=trees, seed=seed, config=config)
            error = model(validation).agg(F.avg((F.col(config.target) - F.col("y_pred")) ** 2)).first()[0]
            if best is None or error is not None and (least is None or error < least):
                best, least = model, error
    train.unpersist()
    validation.unpersist()
    return best
