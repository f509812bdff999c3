"""Mixing sources to target weights: systematic sampling within each source.

A source's documents share one rate, its target over its size in words.  Ranked within their source, the document of
rank k covers the interval [k * rate + u, (k + 1) * rate + u) of expected copies, u being the source's one
offset in [0, 1), and is taken once for each integer boundary in it.  Ranking by size first makes
the taken words follow the target closely.

Ranks come from counts, not from one window over a source: sizes fall into bins, bins into salted cells, and a
rank is the rows in the source's earlier bins, plus those in the bin's earlier cells, plus the place in the cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from .scratch import stage

BIN_WIDTH = 16  # words
BINS = 4096
SALTS = 256


def word_count(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space; null counts as none."""
    parts = F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", -1)
    empty = lambda part: F.when(part == "", 1).otherwise(0)
    return F.greatest(F.size(parts) - empty(F.get(parts, F.lit(0))) - empty(F.element_at(parts, -1)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """Add ``target`` and ``rate`` to one row per source (``_source, _source_size``).

    Weights repeat over the sources in code-point order, null last.  A level fills all sources in proportion to weight;
    sources are capped at ``cap`` times their size in the order in which the level reaches their cap, and what
    is above is shared by the others: the same as resharing the excess until no target is above its cap.
    """
    by_name = W.partitionBy(F.lit(0)).orderBy(F.col("_source").asc_nulls_last())
    order = F.row_number().over(by_name) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (order % len(weights) + 1).cast("int"))
    capped = sources.withColumn("_weight", weight).withColumn("_cap", F.col("_source_size") * F.lit(float(cap)))
    by_level = W.partitionBy(F.lit(0)).orderBy(F.col("_cap") / F.col("_weight"), F.col("_source").asc_nulls_last())
    everything = W.partitionBy(F.lit(0))
    before = by_level.rowsBetween(W.unboundedPreceding, -1)
    left = F.sum("_source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    weight_left = F.sum("_weight").over(everything) - F.coalesce(F.sum("_weight").over(before), F.lit(0.0))
    levelled = capped.withColumn("_level", left / weight_left)
    # the level at which no further source reaches its cap is the first whose own cap lies above it
    final = F.min(F.when(F.col("_cap") > F.col("_level") * F.col("_weight"), F.struct(F.col("_cap") / F.col("_weight"), "_level"))).over(everything)
    fair = F.coalesce(F.least(F.col("_cap"), final["_level"] * F.col("_weight")), F.col("_cap"))
    return levelled.withColumn("target", fair).withColumn(
        "_rate", F.when(F.col("_source_size") > 0, F.col("target") / F.col("_source_size")).otherwise(F.lit(0.0))
    )


def offset(source: Column, seed: str) -> Column:
    """A source's offset in [0, 1), the same in every run."""
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(source, F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(2**32))


def _keyed(df: DataFrame, id_col: str, text_col: str, source_col: str, *more: Column) -> DataFrame:
    return (
        df.select(F.col(id_col).alias("_id"), F.col(source_col).cast("string").alias("_source"), word_count(F.col(text_col)).alias("_size"), F.coalesce(F.col(id_col).cast("string"), F.col(text_col), F.lit("")).alias("_name"), *more)
        .withColumn("_bin", F.least((F.col("_size") / BIN_WIDTH).cast("int"), F.lit(BINS - 1)))
        .withColumn("_salt", F.conv(F.substring(F.md5(F.col("_name").cast("binary")), 1, 2), 16, 10).cast("int"))
        .drop("_name")
    )


def _joined(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join in which nulls are equal, the keys once."""
    condition = left[keys[0]].eqNullSafe(right[keys[0]])
    for key in keys[1:]:
        condition = condition & left[key].eqNullSafe(right[key])
    return left.join(right, condition).select(left["*"], *[right[c] for c in right.columns if c not in keys])


def _with_copies(rows: DataFrame, slim: DataFrame, weights: tuple[int, ...], share: float, cap: float, seed: str) -> DataFrame:
    """Add ``_source_size, target, _copies`` to ``rows``; ``slim`` has the same rows' keys."""
    cells = slim.groupBy("_source", "_bin", "_salt").agg(F.count(F.lit(1)).alias("_n"), F.sum("_size").alias("_words"))
    bins = cells.groupBy("_source", "_bin").agg(F.sum("_n").alias("_n"), F.sum("_words").alias("_words"))
    sources = bins.groupBy("_source").agg(F.sum("_words").alias("_source_size"))

    def starts_of(counted: DataFrame, *keys: str) -> Column:
        earlier = W.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(W.unboundedPreceding, -1)
        return F.coalesce(F.sum("_n").over(earlier), F.lit(0))

    bin_starts = bins.select("_source", "_bin", starts_of(bins, "_source", "_bin").alias("_bin_start"))
    cell_starts = cells.select("_source", "_bin", "_salt", starts_of(cells, "_source", "_bin", "_salt").alias("_cell_start"))
    rates = targets(sources, weights, share, cap).withColumn("_u", offset(F.col("_source"), seed)).select("_source", "_source_size", "target", "_rate", "_u")
    starts = _joined(_joined(cell_starts, bin_starts, ["_source", "_bin"]), rates, ["_source"])
    place = F.row_number().over(W.partitionBy("_source", "_bin", "_salt").orderBy("_size", "_id")) - 1
    ranked = _joined(rows.withColumn("_place", place), starts, ["_source", "_bin", "_salt"])
    rank = F.col("_bin_start") + F.col("_cell_start") + F.col("_place")
    edge = lambda k: F.floor(k * F.col("_rate") + F.col("_u"))
    return ranked.withColumn("_copies", edge(rank + 1) - edge(rank))


def mix_sources(
    df: DataFrame,
    weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    cap: float = 2.0,
    seed: str = "mix",
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """Words of each document that a mix of ``share`` times the corpus takes.

    Returns ``<id_col>, size, source_size, target, taken``.  Copies of a document are 0, 1 or up to ``ceil(cap)``, so no document
    exceeds ``cap`` times its size where ``cap`` is whole.  Null and empty texts have size 0 and give 0 words; a null source is a source of its own, last in
    order; repeated rows and ids are ranked one by one, rows that tie in size and id are interchangeable.  A source without words has target 0.
    An empty table gives no rows.  Other columns are ignored, whatever their names.
    """
    slim = stage(_keyed(df, id_col, text_col, source_col), "mixing")
    mixed = _with_copies(slim, slim, weights, share, cap, seed)
    return mixed.select(
        F.col("_id").alias(id_col),
        F.col("_size").alias("size"),
        F.col("_source_size").alias("source_size"),
        "target",
        (F.col("_copies") * F.col("_size")).cast("long").alias("taken"),
    )


def mixed_rows(
    df: DataFrame,
    weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    cap: float = 2.0,
    seed: str = "mix",
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """The mix itself: every row of ``df``, with all its columns, as often as the mix takes it (see ``mix_sources``)."""
    slim = stage(_keyed(df, id_col, text_col, source_col), "mixing")
    rows = _with_copies(_keyed(df, id_col, text_col, source_col, F.struct("*").alias("_row")), slim, weights, share, cap, seed)
    return rows.filter(F.col("_copies") > 0).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("_row.*")
