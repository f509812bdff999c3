"""Checks of imputation: a seeded holdout, candidate methods side by side, and coverage after filling."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tessera.config import PanelConfig
from tessera.functions.expressions import correlation, portable_draw
from tessera.operators.panel import carry_forward, fill_with_peers, ordered


def held_out(column: str, seed: int, share: float, config: PanelConfig = PanelConfig()) -> Column:
    """Whether an observed cell belongs to the holdout: a fixed share, chosen by a hash of its key so that any partitioning draws the same cells."""
    draw = portable_draw(F.lit(seed), F.lit(column), *[F.col(k) for k in config.keys])
    return F.col(column).isNotNull() & (draw < share)


def holdout_check(
    df: DataFrame, columns: Sequence[str], categories: Mapping[str, str], share: float = 0.1, least: int = 5, seed: int = 42, config: PanelConfig = PanelConfig()
) -> DataFrame:
    """Error of filling held-out cells with the entity's previous row: by indicator, MAE, RMSE, MAPE and correlation, null under ``least`` cells."""
    previous = df.select(*columns, *config.keys, *[F.lag(c).over(ordered(config)).alias(f"_{c}") for c in columns])
    cells = F.array(*[
        F.struct(F.lit(c).alias("indicator"), F.lit(categories.get(c, "other")).alias("category"), F.col(c).cast("double").alias("y"), F.col(f"_{c}").cast("double").alias("filled"), held_out(c, seed, share, config).alias("held"))
        for c in columns
    ])
    pairs = previous.select(F.inline(cells)).filter("held AND filled IS NOT NULL")
    e, enough = F.col("y") - F.col("filled"), F.count("y") >= least
    return pairs.groupBy("indicator", "category").agg(
        F.count("y").alias("n"), F.when(enough, F.avg(F.abs(e))).alias("mae"), F.when(enough, F.sqrt(F.avg(e * e))).alias("rmse"),
        F.when(enough, F.avg(F.try_divide(F.abs(e), F.abs("y"))) * 100).alias("mape"), F.when(enough, correlation(F.col("y"), F.col("filled"))).alias("r"),
    )


def compare_candidates(candidates: Mapping[str, DataFrame], original: DataFrame, column: str) -> DataFrame:
    """How far each method moves a column's mean and deviation, in per cent; the most robust moves them least in sum."""
    base = original.agg(F.avg(column).alias("m"), F.stddev_samp(column).alias("s"))
    rows = None
    for method, df in candidates.items():
        one = df.agg(F.lit(method).alias("method"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"), F.count_if(F.col(column).isNull()).alias("n_missing"))
        rows = one if rows is None else rows.union(one)
    moved = lambda now, then: F.abs(F.try_divide(F.col(now) - F.col(then), F.col(then))) * 100
    # base is one row
    return rows.join(F.broadcast(base), F.lit(True)).select("method", "n_missing", moved("mean", "m").alias("mean_shift_percent"), moved("std", "s").alias("std_shift_percent"))


def most_robust(comparison: DataFrame) -> str:
    return comparison.orderBy(F.col("mean_shift_percent") + F.col("std_shift_percent"), "method").first()["method"]


def coverage(before: DataFrame, after: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Observed and imputed share of each column after filling, and rows before and after."""
    def shares(df: DataFrame, name: str) -> DataFrame:
        one = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(c).alias(c) for c in columns])
        return one.select(F.col("_n").alias(f"rows_{name}"), F.inline(F.array(*[F.struct(F.lit(c).alias("indicator"), F.col(c).alias(f"present_{name}")) for c in columns])))

    joined = shares(before, "before").join(shares(after, "after"), "indicator")
    return joined.select(
        "indicator", "rows_before", "rows_after", F.try_divide(F.col("present_before").cast("double"), F.col("rows_before")).alias("observed_share"),
        F.try_divide((F.col("present_after") - F.col("present_before")).cast("double"), F.col("rows_after")).alias("imputed_share"),
    )


CANDIDATES = ("temporal", "peers", "everyone")


def candidate_moments(df: DataFrame, reach: Mapping[str, int], applied: str = "temporal", least: int = 10, config: PanelConfig = PanelConfig()) -> DataFrame:
    """``indicator, method, applied, n, mean, std, mean_diff, std_diff``: what each way to fill a column does to its observed moments.

    ``temporal`` carries forward by ``reach`` rows, ``peers`` takes the mean of stratum and period, ``everyone`` that of the column; which of them is ``applied`` is marked.
    All columns and methods are measured in one pass.  Columns with fewer than ``least`` observations are left out; NaN counts as missing.
    """
    columns = list(reach)
    value = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    base = df.select(*config.keys, config.stratum, *[value(c).alias(f"_v{i}") for i, c in enumerate(columns)])
    places = range(len(columns))
    filled = carry_forward(base.withColumns({f"_temporal{i}": F.col(f"_v{i}") for i in places}), {f"_temporal{i}": reach[c] for i, c in enumerate(columns)}, config)
    filled = fill_with_peers(filled.withColumns({f"_peers{i}": F.col(f"_v{i}") for i in places}), [f"_peers{i}" for i in places], "mean", config)
    means = base.agg(*[F.avg(f"_v{i}").alias(f"_m{i}") for i in places])  # one row
    filled = filled.join(F.broadcast(means), F.lit(True)).withColumns({f"_everyone{i}": F.coalesce(f"_v{i}", f"_m{i}") for i in places})
    moments = lambda c: F.struct(F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"))
    one = filled.agg(*[moments(f"_{m}{i}").alias(f"{m}{i}") for i in places for m in ("v", *CANDIDATES)])
    rows = F.array(*[F.struct(F.lit(c).alias("indicator"), F.lit(m).alias("method"), F.col(f"v{i}").alias("was"), F.col(f"{m}{i}").alias("now")) for i, c in enumerate(columns) for m in CANDIDATES])
    return one.select(F.inline(rows)).filter(F.col("was.n") >= least).select(
        "indicator", "method", (F.col("method") == applied).alias("applied"), F.col("now.n").alias("n"), F.col("now.mean").alias("mean"), F.col("now.std").alias("std"),
        (F.col("now.mean") - F.col("was.mean")).alias("mean_diff"), (F.col("now.std") - F.col("was.std")).alias("std_diff"),
    )


def candidate_bias(moments: DataFrame) -> DataFrame:
    """``method, mean_bias, most_robust``: the mean absolute shift of means over indicators, and whether it is the least (of equals the first of ``CANDIDATES``)."""
    order = F.array_position(F.array(*[F.lit(m) for m in CANDIDATES]), F.col("method"))
    bias = moments.groupBy("method").agg(F.avg(F.abs("mean_diff")).alias("mean_bias"))
    best = bias.agg(F.min_by("method", F.struct("mean_bias", order)).alias("_best"))  # one row
    return bias.join(F.broadcast(best), F.lit(True)).select("method", "mean_bias", (F.col("method") == F.col("_best")).alias("most_robust"))
