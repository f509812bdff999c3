"""Order statistics without one task that holds a whole group: ranks, neighbours, exact percentiles and mergeable quantile sketches.

Ranges: a table is dealt by ranges of its order and written with the number of each row's range, so that later steps see the same ranges after a lost executor.  What
passes between ranges is a row for each range: its counts (ranks) or its last row (neighbours).
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Hashable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tessera.sources.staging import stage

#: Values of a group that one task may sort; brackets that hold more are narrowed further.
MOST_SORTED = 1 << 17
#: Quantiles of a bracket that are estimated to narrow it, and the accuracy of the estimates: an estimated quantile is off by 1 / ACCURACY of the rows at most.
GRID, ACCURACY = 64, 1000
#: The parameter of the sketches: their rank error is about 1.7 % / (k / 200), so 0.42 % here, with a confidence of 99 %.
SKETCH_K = 800


def ranged(df: DataFrame, order: Sequence[str], ranges: int | None = None) -> DataFrame:
    """``df`` written by ranges of ``order`` (nulls first), with the number of the range as ``_range``; equal rows share one."""
    count = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stage(df.repartitionByRange(count, *order).withColumn("_range", F.spark_partition_id()), "ranged")


def with_rank(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "rank", ranges: int | None = None) -> DataFrame:
    """Add each row's place from 0 within its key by ``order``, which tells rows of a key apart.

    Rows are dealt by ranges of key and order, so that a key with most rows lies in many ranges.  A place is that within the range plus the key's rows in earlier
    ranges: one row for each key and range, and a key's rows meet in one task only as those counts.
    """
    rows = ranged(df, [*keys, *order], ranges)
    counts = rows.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_rows"))
    earlier = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], F.col("_range").alias("_at"), F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    met = F.col("_range") == F.col("_at")
    for i, k in enumerate(keys):
        met = met & rows[k].eqNullSafe(F.col(f"_key{i}"))
    within = F.row_number().over(W.partitionBy(*keys, "_range").orderBy(*order)) - 1
    return rows.withColumn("_within", within).join(offsets, met).select(*df.columns, (F.col("_before") + F.col("_within")).alias(name))


def with_previous(df: DataFrame, order: Sequence[str], columns: Sequence[str], prefix: str = "previous_", ranges: int | None = None) -> DataFrame:
    """Add each row's predecessor in one order over the whole table: ``<prefix><column>``, null for the first row.

    Each range hands its last row to the next range that has rows (a halo of one row): the only rows that leave their range.
    """
    rows = ranged(df, order, ranges)
    value = F.struct(*[F.col(c).alias(f"_{i}") for i, c in enumerate(columns)])
    last = rows.groupBy("_range").agg(F.max_by(value, F.struct(*order)).alias("_last"))
    halo = last.select(F.col("_range").alias("_at"), F.lag("_last").over(W.orderBy("_range")).alias("_halo"))  # a row for each range
    inside = F.lag(value).over(W.partitionBy("_range").orderBy(*order))
    joined = rows.withColumn("_inside", inside).join(F.broadcast(halo), F.col("_range") == F.col("_at"))
    before = F.coalesce("_inside", "_halo")
    return joined.withColumn("_before", before).select(*df.columns, *[F.col("_before")[f"_{i}"].alias(f"{prefix}{c}") for i, c in enumerate(columns)])


def _joined(rows: DataFrame, found: DataFrame, names: Sequence[str]) -> DataFrame:
    """Null-safe join by ``names``, which ``found`` gives up."""
    other = found.select(*[F.col(c).alias(f"_b{i}") if c in names else F.col(c) for i, c in enumerate(found.columns)])
    met = F.lit(True)
    for i, c in enumerate(found.columns):
        if c in names:
            met = met & rows[c].eqNullSafe(other[f"_b{i}"])
    return rows.join(other, met).drop(*[f"_b{i}" for i, c in enumerate(found.columns) if c in names])


def exact_percentiles(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str], fractions: Sequence[float], most_sorted: int = MOST_SORTED, grid: int = GRID
) -> DataFrame:
    """``<keys>, indicator, n, values``: for each key and column its non-null values' number and exact percentiles, linear between ranks, in the order of ``fractions``.

    All groups, columns and ranks are searched at once.  A rank's bracket is at first the whole group.  While some bracket holds more than ``most_sorted`` rows, quantiles
    of its rows are estimated with a stated error; of two that surely enclose the rank, the rows below, at and between them are counted exactly, so that the rank is found at one of them
    or the open interval between them, which has lost both values with all their ties, is the new bracket.  Then the distinct values of the brackets that are left are counted and sorted:
    a task sorts ``most_sorted`` values of a group at most.
    """
    group = [*keys, "indicator"]
    long = df.select(*keys, F.explode(F.array(*[F.struct(F.lit(c).alias("indicator"), F.col(c).cast("double").alias("value")) for c in columns])).alias("_v"))
    long = long.select(*keys, "_v.*").filter(F.col("value").isNotNull())
    sizes = stage(long.groupBy(*group).agg(F.count(F.lit(1)).alias("n")), "ranks-sizes")
    position = lambda f: F.lit(float(f)) * (F.col("n") - 1)
    # positions between two ranks are interpolated
    ranks = F.array_distinct(F.concat(*[F.array(F.floor(position(f)), F.ceil(position(f))) for f in fractions]))
    none = F.lit(None).cast("double")
    searches = sizes.select(*group, F.explode(ranks).alias("rank"), none.alias("lo"), none.alias("hi"), F.lit(0).cast("long").alias("below"), F.col("n").alias("inside"), none.alias("found"))

    def within(open_searches: DataFrame) -> DataFrame:
        rows = _joined(long, open_searches.filter("found IS NULL").drop("found"), group)
        return rows.filter((F.col("lo").isNull() | (F.col("value") > F.col("lo"))) & (F.col("hi").isNull() | (F.col("value") < F.col("hi"))))

    while (searches.filter("found IS NULL").agg(F.max("inside")).first()[0] or 0) > most_sorted:
        steps = F.array(*[F.lit(i / grid) for i in range(grid + 1)])
        rows = within(searches)
        # searches of one group that share a bracket share its estimates
        estimated = rows.groupBy(*group, "rank", "below", "inside").agg(F.percentile_approx("value", steps, F.lit(ACCURACY)).alias("_grid"))
        at = (F.col("rank") - F.col("below")) / F.col("inside") * grid
        slack = 1 + grid / ACCURACY  # an estimate at i / grid has its rank within 1 / ACCURACY of the rows
        low, high = F.greatest(F.floor(at - slack), F.lit(0)).cast("int"), F.least(F.ceil(at + slack), F.lit(grid)).cast("int")
        aimed = estimated.select(*group, "rank", F.get("_grid", low).alias("_lo"), F.get("_grid", high).alias("_hi"))
        counted = _joined(rows, aimed, [*group, "rank"]).groupBy(*group, "rank", "lo", "hi", "below", "_lo", "_hi").agg(
            F.count_if(F.col("value") < F.col("_lo")).alias("_less"), F.count_if(F.col("value") == F.col("_lo")).alias("_at"),
            F.count_if((F.col("value") > F.col("_lo")) & (F.col("value") < F.col("_hi"))).alias("_between"),
            F.count_if((F.col("value") == F.col("_hi")) & (F.col("_hi") > F.col("_lo"))).alias("_end"),
        )
        first = F.col("below") + F.col("_less")
        inner = first + F.col("_at")
        outer = inner + F.col("_between")
        rank = F.col("rank")
        case = F.when(rank < first, 0).when(rank < inner, 1).when(rank < outer, 2).when(rank < outer + F.col("_end"), 3).otherwise(4)
        pick = lambda *values: F.element_at(F.array(*values), F.col("_case") + 1)
        narrowed = counted.withColumn("_case", case).select(
            *group, "rank", pick("lo", "_lo", "_lo", "_hi", "_hi").alias("lo"), pick("_lo", "_lo", "_hi", "_hi", "hi").alias("hi"),
            pick("below", first, inner, outer, outer + F.col("_end")).alias("below"),
            pick("_less", "_at", "_between", "_end", F.lit(most_sorted + 1).cast("long")).alias("inside"), pick(none, "_lo", none, "_hi", none).alias("found"),
        )
        searches = stage(narrowed.unionByName(searches.filter("found IS NOT NULL")), "ranks")
    values = within(searches).groupBy(*group, "rank", "below", "value").agg(F.count(F.lit(1)).alias("_times"))
    upto = F.col("below") + F.sum("_times").over(W.partitionBy(*group, "rank").orderBy("value"))
    ended = values.withColumn("_upto", upto).filter(F.col("_upto") > F.col("rank")).groupBy(*group, "rank").agg(F.min("value").alias("found"))
    everything = ended.unionByName(searches.filter("found IS NOT NULL").select(*group, "rank", "found"))
    listed = everything.groupBy(*group).agg(F.map_from_entries(F.collect_list(F.struct("rank", "found"))).alias("_of"))  # two ranks for each fraction at most

    def value(f: float) -> Column:
        a, b = F.element_at("_of", F.floor(position(f))), F.element_at("_of", F.ceil(position(f)))
        share = position(f) - F.floor(position(f))
        return F.when(a == b, a).otherwise((1 - share) * a + share * b)

    return _joined(sizes, listed, group).select(*group, "n", F.array(*[value(f) for f in fractions]).alias("values"))


def values_at_ranks(
    counted: DataFrame, asked: Callable[[dict[tuple[int, int], int]], dict[Hashable, tuple[int, Sequence[int], Sequence[int]]]], most_sorted: int = MOST_SORTED
) -> dict[Hashable, dict[int, float]]:
    """Exact order statistics of unions of parts: by name and rank, the value.

    ``counted`` has ``indicator int, part int, value double, n long``: how often a value occurs in a part.  ``asked`` is given the number of values by indicator and part, and names an indicator,
    the parts whose values count together, and ranks from 0.  The values lie in ranges of about ``most_sorted`` rows, equal ones in one range; a rank is looked up in its range alone.  Parts are
    counted once, however many unions they belong to.

    The driver gets a number for each range and part, and the values asked for.
    """
    counted = stage(counted, "ranks-counted")
    ranges = max(int(counted.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-counted.count() // most_sorted))
    rows = ranged(counted, ["indicator", "value"], ranges)
    inside, whole = defaultdict(dict), defaultdict(int)
    for r in rows.groupBy("indicator", "_range", "part").agg(F.sum("n").alias("n")).collect():
        inside[r["indicator"], r["_range"]][r["part"]] = r["n"]
        whole[r["indicator"], r["part"]] += r["n"]
    lookups, names = defaultdict(list), []
    for name, (indicator, parts, ranks) in asked(dict(whole)).items():
        at = sorted(r for i, r in inside if i == indicator)
        upto = np.cumsum([sum(inside[indicator, r].get(p, 0) for p in parts) for r in at])
        for rank in sorted(set(ranks)):
            k = int(np.searchsorted(upto, rank, "right"))
            lookups[indicator, at[k]].append((len(names), list(parts), rank, rank - (int(upto[k - 1]) if k else 0)))
        names.append(name)

    def find(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("value")
        value, n, part = (group[c].to_numpy() for c in ("value", "n", "part"))
        out, held = [], (None, None)
        for name, parts, rank, local in lookups.get((int(group["indicator"].iloc[0]), int(group["_range"].iloc[0])), []):
            if held[0] != parts:
                held = parts, np.where(np.isin(part, parts), n, 0).cumsum()
            out.append((name, rank, value[np.searchsorted(held[1], local, "right")]))
        return pd.DataFrame(out, columns=["name", "rank", "value"])

    found = {name: {} for name in names}
    for r in rows.groupBy("indicator", "_range").applyInPandas(find, "name int, rank long, value double").collect():
        found[names[r["name"]]][r["rank"]] = r["value"]
    return found


def quantile_sketches(df: DataFrame, keys: Sequence[str], value: str, k: int = SKETCH_K) -> DataFrame:
    """``<keys>, n, sketch``: a mergeable quantile sketch of each key's non-null values, of bounded size, to be stored beside partitions."""
    rows = df.filter(F.col(value).isNotNull()).groupBy(*keys)
    return rows.agg(F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double(F.col(value).cast("double"), k).alias("sketch"))


def merged_sketches(sketches: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Sketches of finer keys merged into those of ``keys``: ``<keys>, n, sketch``; no row is read again."""
    return sketches.groupBy(*keys).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))


def sketched_quantiles(sketches: DataFrame, keys: Sequence[str], fractions: Sequence[float]) -> DataFrame:
    """``<keys>, n, fraction, value``: estimates from sketches."""
    rows = F.array(*[F.struct(F.lit(float(f)).alias("fraction"), F.kll_sketch_get_quantile_double("sketch", F.lit(float(f))).alias("value")) for f in fractions])
    return sketches.select(*keys, "n", F.inline(rows))


def rank_errors(df: DataFrame, keys: Sequence[str], value: str, estimates: DataFrame) -> DataFrame:
    """Add ``rank_error`` to estimates (``<keys>, n, fraction, value``): how far, as a share of ``n``, the fraction lies outside the exact ranks of the estimated value."""
    rows = df.filter(F.col(value).isNotNull()).select(*[F.col(c).alias(f"_b_{c}") for c in keys], F.col(value).cast("double").alias("_value"))
    met = F.lit(True)
    for c in keys:
        met = met & estimates[c].eqNullSafe(F.col(f"_b_{c}"))
    counted = rows.join(F.broadcast(estimates), met).groupBy(*keys, "n", "fraction", "value").agg(
        F.count_if(F.col("_value") < F.col("value")).alias("_less"), F.count_if(F.col("_value") <= F.col("value")).alias("_upto")
    )
    outside = F.greatest(F.col("_less") / F.col("n") - F.col("fraction"), F.col("fraction") - F.col("_upto") / F.col("n"), F.lit(0.0))
    return counted.select(*keys, "n", "fraction", "value", outside.alias("rank_error"))
