"""Hierarchical ridge forecasts of all folds from one table of moments.

Training parts are cut into segments: the stretches of periods between one fold's first or last training period and the next one's.  The panel is added up by segment
once, and a fold's training part is a sum of segments, so that a further fold adds rows to small tables and no job.  What depends on the fold is applied to moments, not to rows:

* a feature is its value (0 where missing) and a mark of missing, so the moments after imputation follow from the fold's medians;
* scaling is linear;
* the residual is the target less the entity's shrunken mean, which is the same for all rows of an entity: its products need the entity's sums only.

The driver gets a matrix for each bucket of entities and segment, and a vector for each bucket and fold.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, functions as F

from tessera.config import PanelConfig, ProtocolConfig
from tessera.operators.folds import Fold, segment_of, segments
from tessera.operators.models import RidgeFit, ridge_of_moments
from tessera.operators.order import values_at_ranks
from tessera.sources.staging import stage

#: A feature whose variance is below this share of its mean square does not vary; its scale stays 1.
CONSTANT = 1e-13


@dataclass(frozen=True)
class FoldSettings:
    """What one fold's training and validation parts taught."""

    ridge: RidgeFit
    overall: float
    medians: dict[str, float]
    scales: dict[str, tuple[float, float]]
    shrink: float


def second_moments(rows: DataFrame, columns: list, found_by: Sequence[str]) -> dict[tuple, np.ndarray]:
    """Second moments of ``columns`` for each key, which reach the driver."""
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    out = {}
    for r in rows.groupBy(*found_by).agg(*[F.sum(columns[i] * columns[j]).alias(f"p{i}_{j}") for i, j in pairs]).collect():
        m = np.zeros((len(columns), len(columns)))
        for i, j in pairs:
            m[i, j] = m[j, i] = r[f"p{i}_{j}"]
        out[tuple(r[k] for k in found_by)] = m
    return out


def counted_values(rows: DataFrame, folds: Sequence[Fold], columns: Sequence[str]) -> DataFrame:
    """``indicator, part, value, n``: how often each value of each column occurs in each segment of the folds' training parts."""
    cuts, _ = segments(folds)
    held = rows.withColumn("_part", segment_of(cuts, F.col("_period"))).filter((F.col("_period") >= cuts[0]) & (F.col("_period") < cuts[-1]))
    long = [held.filter(F.col(c).isNotNull()).select(F.lit(i).alias("indicator"), F.col("_part").alias("part"), F.col(c).alias("value")) for i, c in enumerate(columns)]
    return reduce(DataFrame.union, long).groupBy("indicator", "part", "value").agg(F.count(F.lit(1)).alias("n"))


def middle(n: int) -> tuple[int, int]:
    """The ranks between which the median of ``n`` values lies."""
    return (n - 1) // 2, n // 2


def fold_medians(rows: DataFrame, folds: Sequence[Fold], features: Sequence[str]) -> dict[int, dict[str, float]]:
    """Each fold's training medians, all searched at once in values counted by segment; a column without an observation in some fold is an error."""
    out = {f.fold: {} for f in folds}
    if not features:
        return out
    _, members = segments(folds)

    def asked(sizes):
        found = {(f, i): sum(sizes.get((i, s), 0) for s in parts) for f, parts in members.items() for i in range(len(features))}
        return {(f, i): (i, members[f], middle(n)) for (f, i), n in found.items() if n}

    for (fold, i), found in values_at_ranks(counted_values(rows, folds, features), asked).items():
        out[fold][features[i]] = 0.5 * found[min(found)] + 0.5 * found[max(found)]
    refuse_lacking(out, features)
    return out


def refuse_lacking(medians: dict[int, dict[str, float]], features: Sequence[str]) -> None:
    for fold, found in medians.items():
        if lacking := sorted(set(features) - set(found)):
            raise ValueError(f"the training part of fold {fold} has no observation of {lacking}")


def all_folds(
    panel: DataFrame, folds: Sequence[Fold], features: Sequence[str], shrinkage: Sequence[float] = ProtocolConfig().shrinkage, strength: float = 5.0, buckets: int = 64,
    config: PanelConfig = PanelConfig(),
) -> tuple[DataFrame, dict[int, FoldSettings]]:
    """``fold, split, <keys>, y_true, y_pred`` of the validation and test rows that have a target, and each fold's settings.

    Each fold imputes by its training medians, scales by its training part, fits ``models.fit_hierarchical`` there and takes the first shrinkage of least validation error.
    Features that are null or NaN are missing.  Rows without an entity teach nothing and start from the overall mean.  Features are finite otherwise.  A fold in whose training part a
    feature has no value is an error, so is an empty panel.  The number of Spark jobs does not depend on the number of folds.
    """
    spark, features = panel.sparkSession, list(features)
    cuts, members = segments(folds)
    value = lambda f: F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double"))
    names = [f"_x{i}" for i in range(len(features))]
    rows = stage(
        panel.filter(F.col(config.target).isNotNull()).select(
            F.col(config.entity).alias("_entity"), F.col(config.period).alias("_period"), F.col(config.target).cast("double").alias("_y"),
            segment_of(cuts, F.col(config.period)).alias("_segment"), F.pmod(F.xxhash64(config.entity), F.lit(buckets)).cast("string").alias("_group"), *[value(f).alias(n) for f, n in zip(features, names)],
        ),
        "ridge-rows",
    )
    # common centre and unit: they cancel out of every result and only keep sums of squares small
    one = rows.agg(*[F.struct(F.avg(n).alias("m"), F.stddev_pop(n).alias("s")).alias(n) for n in names]).first()
    centres = [(one[n]["m"] or 0.0, one[n]["s"] or 1.0) for n in names]
    medians = {f: dict(zip(features, (m[n] for n in names))) for f, m in fold_medians(rows, folds, names).items()}

    trained = rows.filter(F.col("_entity").isNotNull() & (F.col("_period") >= cuts[0]) & (F.col("_period") < cuts[-1]))
    moved = [F.coalesce((F.col(n) - F.lit(c)) / F.lit(d), F.lit(0.0)) for n, (c, d) in zip(names, centres)]
    columns = [F.lit(1.0), *moved, *[F.col(n).isNull().cast("double") for n in names], F.col("_y")]
    by_segment = second_moments(trained, columns, ["_group", "_segment"])
    groups = sorted({g for g, _ in by_segment})
    empty = np.zeros((len(columns), len(columns)))
    by_fold = {(f, g): sum((by_segment.get((g, s), empty) for s in members[f]), empty) for f in members for g in groups}
    whole = {f: sum((by_fold[f, g] for g in groups), empty) for f in members}
    overall = {f: float(m[0, -1] / m[0, 0]) for f, m in whole.items()}

    # sums of each entity and segment, then of each entity and fold: the second step stays where the entity is
    sums = trained.groupBy("_entity", "_group", "_segment").agg(*[F.sum(c).alias(f"z{i}") for i, c in enumerate(columns)]).repartition("_entity")
    belongs = F.broadcast(spark.createDataFrame([(s, f, overall[f]) for f, parts in members.items() for s in parts], "_segment int, fold int, _overall double"))
    zs = [f"z{i}" for i in range(len(columns))]
    entities = sums.join(belongs, "_segment").groupBy("_entity", "fold", "_group", "_overall").agg(*[F.sum(z).alias(z) for z in zs])
    mean = (F.col(zs[-1]) + F.lit(strength) * F.col("_overall")) / (F.col("z0") + F.lit(strength))
    entities = stage(entities.withColumn("_mean", mean), "ridge-entities")
    crossed = entities.groupBy("fold", "_group").agg(*[F.sum(F.col("_mean") * F.col(z)).alias(z) for z in zs], F.sum(F.col("_mean") ** 2 * F.col("z0")).alias("_square")).collect()

    residual = {key: m.copy() for key, m in by_fold.items()}
    for r in crossed:  # the last row and column turn from the target's products into the residual's
        m, c = residual[r["fold"], r["_group"]], np.array([r[z] for z in zs])
        m[-1, -1] += r["_square"] - 2 * c[-1]
        m[:-1, -1] -= c[:-1]
        m[-1, :-1] -= c[:-1]

    k = len(features)
    fits, answers = {}, []
    for f in members:
        filled = [(medians[f][x] - c) / d for x, (c, d) in zip(features, centres)]
        impute = np.zeros((k + 2, len(columns)))
        impute[0, 0] = impute[-1, -1] = 1
        for i in range(k):
            impute[i + 1, i + 1], impute[i + 1, k + i + 1] = 1, filled[i]
        imputed = impute @ whole[f] @ impute.T
        n, means = imputed[0, 0], imputed[0, 1:-1] / imputed[0, 0]
        squares = np.diag(imputed)[1:-1] / n
        spread = squares - means**2
        units = np.where(spread > CONSTANT * np.maximum(squares, 1), np.sqrt(np.maximum(spread, 0)), 1 / np.array([d for _, d in centres]))
        scaled = impute.copy()
        scaled[1:-1] = (impute[1:-1] - means[:, None] * impute[0]) / units[:, None]
        ridge = ridge_of_moments({g: scaled @ residual[f, g] @ scaled.T for g in groups if by_fold[f, g][0, 0]}, features)
        fits[f] = (ridge, {x: (c + m * d, u * d) for x, (c, d), m, u in zip(features, centres, means, units)})
        # on the features' own scale
        slopes = [w / (u * d) for w, u, (_, d) in zip(ridge.weights, units, centres)]
        start = ridge.intercept - sum(s * fits[f][1][x][0] for s, x in zip(slopes, features))
        answers.append((f, float(start), [float(s) for s in slopes], [float(medians[f][x]) for x in features], overall[f]))

    learnt = {a[0]: a[1:] for a in answers}
    bounds = [(f.fold, s, getattr(f, f"{s}_start"), getattr(f, f"{s}_end"), *learnt[f.fold]) for f in folds for s in ("val", "test")]
    bounds = spark.createDataFrame(bounds, "fold int, split string, _first int, _last int, _start double, _slopes array<double>, _fill array<double>, _overall double")
    fitted = F.col("_start")
    for i, x in enumerate(names):
        fitted = fitted + F.get("_slopes", F.lit(i)) * F.coalesce(x, F.get("_fill", F.lit(i)))
    scored = rows.join(F.broadcast(bounds), F.col("_period").between(F.col("_first"), F.col("_last"))).select("fold", "split", "_entity", "_period", "_y", "_overall", fitted.alias("_fitted"))
    known = entities.select("_entity", "fold", "_mean")
    scored = stage(scored.join(known, ["_entity", "fold"], "left").withColumn("_base", F.coalesce("_mean", "_overall")), "ridge-scored")
    left = F.col("_y") - F.col("_base")
    errors = {r["fold"]: r for r in scored.filter("split = 'val'").groupBy("fold").agg(*[F.avg((left - F.lit(s) * F.col("_fitted")) ** 2).alias(f"e{i}") for i, s in enumerate(shrinkage)]).collect()}
    chosen = {f: shrinkage[min(range(len(shrinkage)), key=lambda i: (errors[f][f"e{i}"], i)) if f in errors else 0] for f in members}
    shrinks = F.broadcast(spark.createDataFrame(list(chosen.items()), "fold int, _shrink double"))
    predictions = scored.join(shrinks, "fold").select(
        "fold", "split", F.col("_entity").alias(config.entity), F.col("_period").alias(config.period), F.col("_y").alias("y_true"), (F.col("_base") + F.col("_shrink") * F.col("_fitted")).alias("y_pred")
    )
    return predictions, {f: FoldSettings(fits[f][0], overall[f], medians[f], fits[f][1], chosen[f]) for f in members}
