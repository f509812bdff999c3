"""Feature selection and the checks against leakage through features.

Everything that grows with the panel is one aggregation to a matrix of moments, columns by columns, or a tree of triangular factors; the linear algebra on those runs on the driver.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row, functions as F

from tessera.config import LeakageViolation, PanelConfig, ProtocolConfig
from tessera.functions.expressions import correlation, numeric_columns
from tessera.operators.aggregates import correlation_pairs, target_correlations
from tessera.operators.folds import Fold, materialise, segment_of, segments
from tessera.sources.staging import stage


@dataclass(frozen=True)
class Moments:
    """Rows, means and centred cross products of complete rows."""

    columns: list[str]
    n: int
    means: np.ndarray
    products: np.ndarray

    def pick(self, names: Sequence[str]) -> np.ndarray:
        at = [self.columns.index(c) for c in names]
        return self.products[np.ix_(at, at)]


def _moment_columns(columns: Sequence[str]) -> list[Column]:
    """Aggregates over the rows in which all columns are observed."""
    complete = reduce(Column.__and__, [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in columns], F.lit(True))
    x = [F.when(complete, F.col(c)) for c in columns]
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    return [F.count_if(complete).alias("n"), *[F.avg(x[i]).alias(f"m{i}") for i in range(len(columns))], *[F.covar_pop(x[i], x[j]).alias(f"c{i}_{j}") for i, j in pairs]]


def _moments_of(found: Row, columns: Sequence[str]) -> Moments:
    products = np.zeros((len(columns), len(columns)))
    for i in range(len(columns)):
        for j in range(i, len(columns)):
            products[i, j] = products[j, i] = (found[f"c{i}_{j}"] or 0.0) * found["n"]
    return Moments(list(columns), found["n"], np.array([found[f"m{i}"] or 0.0 for i in range(len(columns))]), products)


def moments(df: DataFrame, columns: Sequence[str]) -> Moments:
    columns = list(columns)
    return _moments_of(df.agg(*_moment_columns(columns)).first(), columns)


def reconstruction_r2(found: Moments, target: str, features: Sequence[str]) -> float | None:
    """R2 of the least-squares fit of one column by others; None without features, with too few rows, or for a constant column."""
    features = list(features)
    total = found.products[found.columns.index(target), found.columns.index(target)]
    if not features or found.n <= len(features) + 1 or total <= 0:
        return None
    cross = found.pick([*features, target])
    weights = np.linalg.lstsq(cross[:-1, :-1], cross[:-1, -1], rcond=None)[0]
    return float(weights @ cross[:-1, -1] / total)


def redundant_features(found: Moments, features: Sequence[str], protocol: ProtocolConfig = ProtocolConfig()) -> list[str]:
    """Features that the others reproduce."""
    scores = {f: reconstruction_r2(found, f, [g for g in features if g != f]) for f in features}
    return [f for f, r2 in scores.items() if r2 is not None and r2 > protocol.identity]


def _stacked(parts: Iterable[np.ndarray], size: int) -> np.ndarray:
    r = np.zeros((0, size))
    for part in parts:
        r = np.linalg.qr(np.vstack([r, part]), mode="r")
    return r


def triangular_factors(df: DataFrame, columns: Sequence[str], segment: Column, fan_in: int = 16) -> dict[int, np.ndarray]:
    """For each of a few segments of rows, the R of a QR decomposition of the complete rows of a constant and the columns, by a tree: each partition's own, then those of ``fan_in`` at a time.

    Unlike the matrix of moments it does not square the columns, so that dependences down to the precision of a double can be told from near ones.
    """
    size = len(columns) + 1
    rows = df.select(segment.cast("long").alias("segment"), *[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(columns)]).dropna()

    def own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = {}
        for b in batches:
            for k, part in b.groupby("segment"):
                found[k] = _stacked([found.get(k, np.zeros((0, size))), np.column_stack([np.ones(len(part)), part.drop(columns="segment").to_numpy(float)])], size)
        yield pd.DataFrame({"part": TaskContext.get().partitionId(), "segment": list(found), "r": [r.tobytes() for r in found.values()]})

    def merged(group: pd.DataFrame) -> pd.DataFrame:
        r = _stacked((np.frombuffer(x).reshape(-1, size) for x in group.sort_values("part")["r"]), size)
        return pd.DataFrame({"part": [int(group["part"].iloc[0]) // fan_in], "segment": [int(group["segment"].iloc[0])], "r": [r.tobytes()]})

    factors = stage(rows.mapInPandas(own, "part long, segment long, r binary"), "factors")
    parts = (factors.agg(F.max("part")).first()[0] or 0) + 1
    while parts > fan_in:
        factors = factors.groupBy("segment", F.floor(F.col("part") / fan_in)).applyInPandas(merged, "part long, segment long, r binary")
        parts = -(-parts // fan_in)
    held: dict[int, list[np.ndarray]] = {}
    for r in factors.orderBy("part").collect():  # fan_in matrices of the columns' size for each segment at most
        held.setdefault(r["segment"], []).append(np.frombuffer(r["r"]).reshape(-1, size))
    return {k: _stacked(v, size) for k, v in held.items()}


def triangular_factor(df: DataFrame, columns: Sequence[str], fan_in: int = 16) -> np.ndarray:
    """``triangular_factors`` of all rows."""
    return triangular_factors(df, columns, F.lit(0), fan_in).get(0, np.zeros((0, len(columns) + 1)))


def design_rank(df: DataFrame, features: Sequence[str], tolerance: float = 1e-11) -> tuple[int, int]:
    """Rank of the features with a constant, and the rank it would have without dependence.

    Dependence is told by singular values relative to the largest, of columns less their means and brought to one length.
    """
    features = list(features)
    return rank_of_factor(triangular_factor(df, features), tolerance) if features else (1, 1)


def rank_of_factor(r: np.ndarray, tolerance: float = 1e-11) -> tuple[int, int]:
    """``design_rank`` from the triangular factor."""
    centred = r[1:, 1:]
    lengths = np.sqrt((centred * centred).sum(axis=0))
    whole = np.sqrt((r[:, 1:] ** 2).sum(axis=0))
    varying = lengths > tolerance * whole
    # a column far from zero holds its variation with the precision of its size only
    tolerance = max(tolerance, 8 * np.finfo(float).eps * float((whole[varying] / lengths[varying]).max(initial=0)))
    values = np.linalg.svd(centred[:, varying] / lengths[varying], compute_uv=False) if varying.any() else np.empty(0)
    return int(len(r) > 0) + int((values > tolerance * values.max(initial=0)).sum()), r.shape[1]


def candidate_pool(df: DataFrame, config: PanelConfig = PanelConfig(), protocol: ProtocolConfig = ProtocolConfig(), declared: Sequence[str] = ()) -> list[str]:
    """Numeric columns that are neither excluded, nor roles, nor derived from the target, sorted."""
    hidden = [c for c in declared if c.startswith(config.derived_prefix)]
    if hidden:
        raise ValueError(f"declared features carry the prefix of derived columns: {hidden}")
    pool = sorted(c for c in numeric_columns(df.schema, config.excluded) if c not in config.roles and not c.startswith(config.derived_prefix))
    metadata = [c for c in pool if any(part in c for part in protocol.metadata_fragments)]
    if metadata:
        raise ValueError(f"columns look like metadata: {metadata}")
    return pool


@dataclass
class Selection:
    features: list[str]
    correlations: dict[str, float]
    floor: float
    undefined: list[str] = field(default_factory=list)
    dropped: list[str] = field(default_factory=list)
    reconstruction: float | None = None


def within_band(correlations: Mapping[str, float], protocol: ProtocolConfig = ProtocolConfig()) -> tuple[list[str], float]:
    """Features whose absolute correlation lies between a floor and the proxy limit; the floor is lowered if that helps a short list."""
    at = lambda floor: sorted(f for f, r in correlations.items() if floor <= r <= protocol.proxy)
    chosen, floor = at(protocol.floor), protocol.floor
    if len(chosen) < protocol.least_features and len(at(protocol.relaxed_floor)) > len(chosen):
        chosen, floor = at(protocol.relaxed_floor), protocol.relaxed_floor
    if not chosen:
        raise ValueError("no feature lies within the band")
    return chosen, floor


def without_collinear(df: DataFrame, features: Sequence[str], protocol: ProtocolConfig = ProtocolConfig()) -> list[str]:
    """In the order of names, features whose correlation with all kept ones is under the limit."""
    names = sorted(features)
    if df.dropna(subset=names).limit(protocol.least_rows + 1).count() <= protocol.least_rows:
        raise ValueError("too few complete rows for a correlation matrix")
    r = {frozenset((x["a"], x["b"])): abs(x["r"]) for x in correlation_pairs(df, names).collect() if x["r"] is not None}
    kept: list[str] = []
    for name in names:
        if all(r.get(frozenset((name, other)), 0.0) < protocol.collinear for other in kept):
            kept.append(name)
    return kept


def select_features(df: DataFrame, train_end: int, config: PanelConfig = PanelConfig(), protocol: ProtocolConfig = ProtocolConfig()) -> Selection:
    """Select on the first training window alone, then refuse what gives the target away."""
    pool = candidate_pool(df, config, protocol)
    window = df.filter((F.col(config.period) <= train_end) & F.col(config.target).isNotNull())
    found = target_correlations(window, pool, config).collect()
    correlations = {x["feature"]: x["r_abs"] for x in found}
    chosen, floor = within_band({f: r for f, r in correlations.items()}, protocol)
    kept = without_collinear(window, chosen, protocol)
    if set(kept) & set(config.excluded):
        raise LeakageViolation("an excluded column was selected")
    everywhere = {x["feature"]: x["r_abs"] for x in target_correlations(df, kept, config).collect()}
    proxies = sorted(f for f, r in everywhere.items() if r > protocol.proxy)
    if proxies:
        raise LeakageViolation(f"features stand in for the target over the whole panel: {proxies}")
    r2 = reconstruction_r2(moments(window, [*kept, config.target]), config.target, kept)
    if r2 is not None and r2 > protocol.reconstruction:
        raise LeakageViolation(f"the features reconstruct the target (R2 {r2:.4f})")
    return Selection(kept, correlations, floor, sorted(x["feature"] for x in found if x["undefined"]), sorted(set(chosen) - set(kept)), r2)


def _audited(features: Sequence[str], config: PanelConfig, protocol: ProtocolConfig, columns: Sequence[str]) -> tuple[list[str], list[str]]:
    """The features that are no lags of the target, and the lags among the features."""
    lags = [f"{config.target}_lag_{k}" for k in config.lags]
    missing = [c for c in lags if c not in columns]
    if missing:
        raise ValueError(f"lag columns are missing: {missing}")
    exogenous = [f for f in features if f not in lags]
    if not exogenous:
        raise LeakageViolation("no feature but lags of the target")
    return exogenous, [c for c in lags if c in features]


def _audit_columns(exogenous: Sequence[str], exempt: Sequence[str], config: PanelConfig) -> list[Column]:
    """What an audit needs to know of its rows, as aggregates."""
    counts = [F.struct(F.count(f).alias("n"), (F.min(f) != F.max(f)).alias("varies"), correlation(F.col(f), F.col(config.target)).alias("r")).alias(f"f{i}") for i, f in enumerate(exogenous)]
    return [*counts, *_moment_columns([*exogenous, *exempt, config.target])]


def _verdict(row: Row, exogenous: Sequence[str], exempt: Sequence[str], config: PanelConfig, protocol: ProtocolConfig) -> dict:
    seen = {f: row[f"f{i}"] for i, f in enumerate(exogenous)}
    testable = [f for f in exogenous if seen[f]["n"] >= 3 and seen[f]["varies"]]
    r = {f: abs(seen[f]["r"] or 0.0) for f in testable}
    proxies = sorted(f for f, v in r.items() if v > protocol.proxy)
    if proxies:
        raise LeakageViolation(f"features stand in for the target: {proxies}")
    found = _moments_of(row, [*exogenous, *exempt, config.target])
    r2 = reconstruction_r2(found, config.target, exogenous)
    if r2 is not None and r2 > protocol.identity:
        raise LeakageViolation("the features determine the target")
    return {
        "status": "ran" if testable and r2 is not None else "indeterminate", "exempt": list(exempt), "correlations": r,
        "untested": sorted(set(exogenous) - set(testable)), "reconstruction_r2": r2, "redundant": redundant_features(found, exogenous, protocol),
    }


def audit_features(df: DataFrame, features: Sequence[str], config: PanelConfig = PanelConfig(), protocol: ProtocolConfig = ProtocolConfig()) -> dict:
    """Check a feature set with its lags: ``status`` is ran, not_applicable or indeterminate; violations raise."""
    exogenous, exempt = _audited(features, config, protocol, df.columns)
    rows = df.filter(F.col(config.target).isNotNull())
    verdict = _verdict(rows.agg(*_audit_columns(exogenous, exempt, config)).first(), exogenous, exempt, config, protocol)
    rank, full = design_rank(rows, exogenous)
    return verdict | {"rank": rank, "full_rank": full}


def audit_folds(df: DataFrame, folds: Sequence[Fold], features: Sequence[str], config: PanelConfig = PanelConfig(), protocol: ProtocolConfig = ProtocolConfig()) -> dict[int, dict]:
    """``audit_features`` of every fold's training part.  The number of jobs does not depend on the number of folds: one aggregation, and triangular factors of segments that folds put together."""
    exogenous, exempt = _audited(features, config, protocol, df.columns)
    rows = df.filter(F.col(config.target).isNotNull())
    held = materialise(rows, folds, config).filter("split = 'train'").groupBy("fold").agg(*_audit_columns(exogenous, exempt, config))
    seen = {r["fold"]: r for r in held.collect()}  # a row for each fold
    if empty := sorted({f.fold for f in folds} - set(seen)):
        raise ValueError(f"the training parts of folds {empty} have no rows")
    verdicts = {f.fold: _verdict(seen[f.fold], exogenous, exempt, config, protocol) for f in folds}
    cuts, members = segments(folds)
    trained = rows.filter((F.col(config.period) >= cuts[0]) & (F.col(config.period) < cuts[-1]))
    factors = triangular_factors(trained, exogenous, segment_of(cuts, F.col(config.period)))
    for f, parts in members.items():
        rank, full = rank_of_factor(_stacked([factors[p] for p in parts if p in factors], len(exogenous) + 1))
        verdicts[f] |= {"rank": rank, "full_rank": full}
    return verdicts
