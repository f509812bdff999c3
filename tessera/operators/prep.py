"""Imputation and scaling learnt from the training part alone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tessera.operators.order import exact_percentiles


def train_statistics(train: DataFrame, columns: Sequence[str], how: str = "median") -> dict[str, float]:
    """Median or mean of each column; a column without an observation is an error."""
    if how == "median":
        found = dict.fromkeys(columns) | {r["indicator"]: r["values"][0] for r in exact_percentiles(train, [], columns, [0.5]).collect()}  # a row for each column
    else:
        found = train.agg(*[F.avg(c).alias(c) for c in columns]).first().asDict()
    unobserved = sorted(c for c, v in found.items() if v is None)
    if unobserved:
        raise ValueError(f"the training part has no observation of {unobserved}")
    return found


def impute(df: DataFrame, statistics: dict[str, float]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(float(v))) for c, v in statistics.items()})


def missing_cells(df: DataFrame, columns: Sequence[str], *keys: str) -> DataFrame:
    """Cells that imputation will fill, for each key."""
    total = sum((F.count_if(F.col(c).isNull()) for c in columns[1:]), F.count_if(F.col(columns[0]).isNull()))
    return df.groupBy(*keys).agg(total.alias("n_missing"))


def scaler(train: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation; a constant column keeps its scale."""
    found = train.agg(*[F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(c) for c in columns]).first()
    return {c: (found[c]["m"], found[c]["s"] or 1.0) for c in columns}


def scale(df: DataFrame, scales: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in scales.items()})


def require_columns(df: DataFrame, columns: Sequence[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns are missing: {missing}")
