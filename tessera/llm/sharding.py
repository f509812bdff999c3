"""Sharding by bytes: minimax contiguous partition of ordered atomic groups.

Rows with the same text form an atomic group, and groups are ordered by the digest of their text.  Sizes of groups that share the digest's first 16 bits
are added up, so that at most 65,536 units describe a corpus of any size.  The smallest capacity for which a greedy sweep over them needs no more than the wanted
shards is found by binary search.  It bounds the smallest capacity of the groups themselves from above, and bounds where each cut can lie; units at those places
are split by one more digit of the digest, and the search is repeated until only single groups lie there, so that the capacity is the smallest there is.
At that capacity, sweeps from both ends bound where each cut may lie, and each is made there as near to an
equal share as it can be, so that no shard exceeds the capacity and none is left with a remainder.

Slots are numbered without gathering a shard in one task: a row's slot is the number of rows in its shard's earlier
units, plus those in earlier salts of its unit, plus its place in its (unit, salt) cell.  Salts come from
the row's id, so a text with very many copies is numbered by many tasks.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import DataFrame, functions as F, Window as W

from .scratch import stage

UNIT_DIGITS = 4  # hexadecimal digits of the digest that name a unit at first: 16 ** 4 units at most
SLOT_DIGITS = 4  # that name a unit of rows that are numbered together
SALTS = 256


def greedy_cuts(prefix: list[int], capacity: int) -> list[int]:
    """Ends (exclusive, as positions in the unit order) of the segments that a greedy sweep fills; the last stands before a unit larger than the capacity."""
    cuts, at = [], 0
    while at < len(prefix) - 1:
        end = bisect_right(prefix, prefix[at] + capacity) - 1
        cuts.append(end)
        if end == at:
            break
        at = end
    return cuts


def even_cuts(prefix: list[int], capacity: int, shards: int) -> list[int]:
    """Ends of ``shards`` segments under a capacity that allows them, each as near to its equal share of the whole as can be."""
    units = len(prefix) - 1
    earliest = [units]  # from the back: the first end of each segment from which the rest still fits
    for _ in range(shards - 1):
        earliest.append(bisect_left(prefix, prefix[earliest[-1]] - capacity))
    cuts, at = [], 0
    for number, first in enumerate(reversed(earliest[1:]), 1):
        last = bisect_right(prefix, prefix[at] + capacity) - 1
        share = prefix[-1] * number / shards
        near = bisect_left(prefix, share)
        near -= near > 0 and share - prefix[near - 1] < prefix[near] - share
        at = min(max(near, first, at), last)
        cuts.append(at)
    return cuts


def smallest_capacity(prefix: list[int], shards: int) -> int:
    """Of the contiguous partitions into ``shards`` segments, the least size of the largest segment."""
    low, high = max([-(-prefix[-1] // shards), *(b - a for a, b in zip(prefix, prefix[1:]))]), prefix[-1]
    while low < high:
        middle = (low + high) // 2
        if len(greedy_cuts(prefix, middle)) <= shards:
            high = middle
        else:
            low = middle + 1
    return low


@dataclass(frozen=True, order=True)
class Unit:
    """Groups whose digests begin alike."""

    digits: str
    size: int
    single: bool  # whether it is one group


def to_split(units: list[Unit], shards: int, least: int) -> list[Unit]:
    """Units of several groups, sorted, in which a cut at the smallest capacity may lie, which is ``least`` or more.

    Units above ``least`` come first and alone, ``shards`` of them at most.  Then no unit stops a sweep: the k-th cut lies no nearer than a sweep over units at
    ``least`` gets, and no farther than k times the units' own capacity.  That is about 2 k units, so ``shards`` squared in all.
    """
    large = [u for u in units if u.size > least and not u.single]
    prefix = [0, *accumulate(u.size for u in units)]
    capacity = smallest_capacity(prefix, shards)
    if large or capacity == least:
        return large
    found: set[int] = set()
    for number, cut in enumerate(greedy_cuts(prefix, least)[: shards - 1], 1):
        found.update(range(cut, bisect_left(prefix, number * capacity)))
    return [units[i] for i in sorted(found) if i < len(units) and not units[i].single]


def minimax_cuts(sizes: list[int], shards: int) -> list[int]:
    """Cuts of the contiguous partition into ``shards`` segments whose largest segment is smallest; segments may be empty."""
    if not sizes:
        return []
    prefix = [0, *accumulate(sizes)]
    return [*even_cuts(prefix, smallest_capacity(prefix, shards), shards), len(sizes)]


def units_of(groups: DataFrame, shards: int) -> list[Unit]:
    """Units of ``groups`` (``_digest, _bytes``), split as far as the smallest capacity needs."""

    def added_up(rows: DataFrame, digits: int) -> list[Unit]:
        sizes = rows.groupBy(F.substring("_digest", 1, digits).alias("_digits")).agg(F.sum("_bytes"), F.min("_digest") == F.max("_digest"))
        return [Unit(*r) for r in sizes.collect()]  # 16 ** UNIT_DIGITS at first, then 16 for each unit that is split

    units = sorted(added_up(groups, UNIT_DIGITS))
    total = sum(u.size for u in units)
    if not total:
        return units
    least = max(groups.agg(F.max("_bytes")).first()[0], -(-total // shards))
    while split := set(to_split(units, shards, least)):
        units = [u for u in units if u not in split]
        for digits in {len(u.digits) for u in split}:
            inside = groups.filter(F.substring("_digest", 1, digits).isin([u.digits for u in split if len(u.digits) == digits]))
            units += added_up(inside, digits + 1)
        units.sort()
    return units


def shard_by_bytes(df: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shard every row of ``df`` so that shards hold nearly equal bytes and equal texts stay together.

    Returns ``<id_col>, size, text_crc32, law, shard, slot, grown_shard``.  A row's size is its text's UTF-8
    bytes plus 8.  A null text has no bytes: size 8, CRC 0, grouped with the empty text.  Repeated rows and ids each
    get a slot of their own; rows that tie in text and id are interchangeable.  A null id is kept.  An empty table gives no rows.
    Other columns are ignored, whatever their names.  ``grown_shard`` is null: this law moves rows when a shard is added.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = stage(
        df.select(
            F.col(id_col).alias("_id"),
            (F.octet_length(text) + F.lit(8)).cast("long").alias("_size"),
            F.crc32(text.cast("binary")).alias("_crc"),
            F.md5(text.cast("binary")).alias("_digest"),
            F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(SALTS)).cast("int").alias("_salt"),
        ).withColumn("_unit", F.conv(F.substring("_digest", 1, SLOT_DIGITS), 16, 10).cast("int")),
        "sharding",
    )
    groups = stage(slim.groupBy("_digest").agg(F.sum("_size").alias("_bytes")), "sharding-groups")
    known = units_of(groups, shards)
    cuts = minimax_cuts([u.size for u in known], shards)
    firsts = [known[c].digits if c < len(known) else "g" for c in cuts[:-1]]  # what begins each further shard; no digest reaches "g"
    shard = F.size(F.filter(F.array(*[F.lit(x) for x in firsts]).cast("array<string>"), lambda first: first <= F.col("_digest"))).cast("int")
    slim = slim.withColumn("shard", shard)

    in_shard = W.partitionBy("shard").orderBy("_unit").rowsBetween(W.unboundedPreceding, -1)
    starts = slim.groupBy("shard", "_unit").agg(F.count(F.lit(1)).alias("_rows")).select(
        "_unit", "shard", F.coalesce(F.sum("_rows").over(in_shard), F.lit(0)).alias("_unit_start")
    )
    in_unit = W.partitionBy("shard", "_unit").orderBy("_salt").rowsBetween(W.unboundedPreceding, -1)
    cells = (
        slim.groupBy("shard", "_unit", "_salt")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("shard", "_unit", "_salt", F.coalesce(F.sum("_n").over(in_unit), F.lit(0)).alias("_cell_start"))
    )
    place = F.row_number().over(W.partitionBy("shard", "_unit", "_salt").orderBy("_digest", "_id")) - 1
    return (
        slim.withColumn("_place", place)
        .join(cells, ["shard", "_unit", "_salt"])
        .join(F.broadcast(starts), ["shard", "_unit"])  # 65,536 rows and one for each shard at most
        .select(
            F.col("_id").alias(id_col),
            F.col("_size").alias("size"),
            F.col("_crc").alias("text_crc32"),
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("_unit_start") + F.col("_cell_start") + F.col("_place")).alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
