"""Reshaping, imputation and lags of a panel."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tessera.config import PanelConfig
from tessera.functions.expressions import clip, complement_rate, completeness, symmetric_log
from tessera.operators.order import exact_percentiles


def pivot_observations(df: DataFrame, index: Sequence[str], indicators: Sequence[str], name: str = "indicator", value: str = "value") -> DataFrame:
    """Long observations to one column per indicator; of several values for a cell the smallest non-null one is taken.

    Rows with a null key are dropped.  The indicators are given, so that no job is needed to find them.
    """
    known = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in index))
    return df.filter(known).groupBy(*index).pivot(name, list(indicators)).agg(F.min(value))


def unpivot_panel(df: DataFrame, index: Sequence[str], indicators: Sequence[str], name: str = "indicator", value: str = "value") -> DataFrame:
    """One row per indicator and cell, missing values left out."""
    return df.unpivot(list(index), list(indicators), name, value).filter(F.col(value).isNotNull())


def clip_columns(df: DataFrame, columns: Sequence[str], low: float = 0.0, high: float = 100.0) -> DataFrame:
    return df.withColumns({c: clip(F.col(c), low, high) for c in columns})


def corrections(df: DataFrame, columns: Sequence[str], low: float = 0.0, high: float = 100.0) -> DataFrame:
    """How many values of each column lie below and above the bounds: ``indicator, below, above``."""
    counted = df.agg(*[F.struct(F.count_if(F.col(c) < low).alias("below"), F.count_if(F.col(c) > high).alias("above")).alias(c) for c in columns])
    rows = F.array(*[F.struct(F.lit(c).alias("indicator"), F.col(c)["below"].alias("below"), F.col(c)["above"].alias("above")) for c in columns])
    return counted.select(F.inline(rows))


def with_lineage(df: DataFrame, source: str, batch: str | Column, method: str) -> DataFrame:
    """Add where rows come from, their batch (a name, or a stamp such as ``expressions.batch_stamp``) and how they were made."""
    return df.withColumns({"data_source": F.lit(source), "etl_batch_id": F.lit(batch), "processing_method": F.lit(method)})


def with_completeness(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumn("completeness", completeness(columns))


def with_target(df: DataFrame, config: PanelConfig = PanelConfig()) -> DataFrame:
    return df.withColumn(config.target, complement_rate(F.col(config.target_source)))


def with_symmetric_logs(df: DataFrame, features: Sequence[str], first: int = 5) -> DataFrame:
    """Add ``<feature>_log_transform`` for the first few features."""
    return df.withColumns({f"{c}_log_transform": symmetric_log(F.col(c)) for c in list(features)[:first]})


def with_lags(df: DataFrame, config: PanelConfig = PanelConfig()) -> DataFrame:
    """Add ``<target>_lag_<k>``: the target of the same entity exactly ``k`` periods before, null where that period is absent.

    A self equi-join on entity and shifted period for each lag, not a row offset, so that gaps never pass a nearer or farther value off as a lag.
    """
    out = df
    for k in config.lags:
        past = df.select(config.entity, (F.col(config.period) + k).cast(df.schema[config.period].dataType).alias(config.period), F.col(config.target).alias(f"{config.target}_lag_{k}"))
        out = out.join(past, config.keys, "left")
    return out


def ordered(config: PanelConfig = PanelConfig()):
    return W.partitionBy(config.entity).orderBy(config.period)


def since_observed(column: str, config: PanelConfig = PanelConfig(), by: str = "rows") -> Column:
    """Distance to the last observation: 0 where observed, null before the first; in rows (of ``with_row_position``), or in periods."""
    past = ordered(config).rowsBetween(W.unboundedPreceding, 0)
    position = F.col("_at") if by == "rows" else F.col(config.period)
    return (position - F.last(F.when(F.col(column).isNotNull(), position), ignorenulls=True).over(past)).cast("int")


def with_row_position(df: DataFrame, config: PanelConfig = PanelConfig()) -> DataFrame:
    return df.withColumn("_at", F.row_number().over(ordered(config)))


def carry_forward(df: DataFrame, limits: Mapping[str, int], config: PanelConfig = PanelConfig(), by: str = "rows") -> DataFrame:
    """Fill each column with its last observation of the same entity, up to a limit of rows (or periods) back; never from the future."""
    placed = with_row_position(df, config)
    past = ordered(config).rowsBetween(W.unboundedPreceding, 0)
    filled = {
        c: F.when(since_observed(c, config, by) <= limit, F.last(c, ignorenulls=True).over(past)) for c, limit in limits.items()
    }
    return placed.withColumns(filled).drop("_at")


def fill_with_previous_mean(df: DataFrame, column: str, rows: int = 3, config: PanelConfig = PanelConfig()) -> DataFrame:
    """Fill missing values with the mean of the entity's previous ``rows`` rows, missing ones skipped."""
    mean = F.avg(column).over(ordered(config).rowsBetween(-rows, -1))
    return df.withColumn(column, F.coalesce(F.col(column).cast("double"), mean))


def fill_with_peers(df: DataFrame, columns: Sequence[str], how: str = "median", config: PanelConfig = PanelConfig()) -> DataFrame:
    """Fill missing values with the median or mean of the same stratum and period."""
    peer = [config.stratum, config.period]
    if how == "median":
        medians = exact_percentiles(df, peer, columns, [0.5])
        peers = medians.groupBy(*peer).agg(*[F.max(F.when(F.col("indicator") == c, F.col("values")[0])).alias(f"_{c}") for c in columns])
    else:
        peers = df.groupBy(*peer).agg(*[F.avg(c).alias(f"_{c}") for c in columns])
    same = df[config.stratum].eqNullSafe(peers[config.stratum]) & (df[config.period] == peers[config.period])
    joined = df.join(peers, same, "left").select(df["*"], *[peers[f"_{c}"] for c in columns])
    return joined.withColumns({c: F.coalesce(F.col(c).cast("double"), F.col(f"_{c}")) for c in columns}).drop(*[f"_{c}" for c in columns])


def entity_dimension(df: DataFrame, config: PanelConfig = PanelConfig()) -> DataFrame:
    """One row per entity with its name and stratum at its first period."""
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col(config.period))).alias(c)
    return df.groupBy(config.entity).agg(first(config.name), first(config.stratum))


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Frames with the same or overlapping columns, one below the other."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def validation_sample(df: DataFrame, rows: int = 1000, seed: int = 42, config: PanelConfig = PanelConfig()) -> DataFrame:
    """The same ``rows`` rows in every run, chosen by a hash of their keys."""
    return df.orderBy(F.xxhash64(F.lit(seed), *config.keys), *config.keys).limit(rows)
