"""Near-duplicates: circulant MinHash, banding, exact Jaccard verification, components.

A document's set holds its distinct word shingles.  One permutation places a shingle on a circle, a second one, read from
there on at successive shifts, gives all signature coordinates.  Documents with the same set form a class; what follows
works on classes, so copies are never expanded into pairs.

1. Bands of coordinates put classes into buckets.  Each bucket's leader is its most popular member, by the sizes of all buckets it is in;
   members are compared with leaders on their full sets, and the confirmed links give components.  The original of a group of near
   copies is more popular than its copies, so the links of large groups are found by as many comparisons as it has members.
2. Buckets whose members are not all in one component are searched for further links: members of different components, of fitting sizes,
   whose long sketches agree often enough are compared on their full sets.  The sketch's threshold lies 4.5 standard deviations under the
   similarity asked for.  Buckets are searched in blocks, which copies a member at most ``CROWD / BLOCK`` times: members of larger
   buckets are not compared all with all, but dealt out by 64 further bands of 8 coordinates each, from the long sketch, and
   once more within what is still crowded.  A piece that stays crowded after that, of texts much alike, is searched whole.

A pair at the similarity asked for (0.75) shares no bucket with probability (1 - 0.75 ** 4) ** 32, about 5e-6, and, in a crowded one, no further
band with probability (1 - 0.75 ** 8) ** 64, about 0.0012 each time.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .components import connected_components
from .scratch import stage
from .text import raw, slices, windows, words

CIRCLE_BITS = 22
CIRCLE = 1 << CIRCLE_BITS
BANDS, BAND_ROWS = 32, 4
SKETCH = 1024
SPLITS, SPLIT_BANDS, SPLIT_ROWS = 2, 64, 8  # SPLITS * SPLIT_BANDS * SPLIT_ROWS is SKETCH
SLICE_BYTES = 1 << 20
BLOCK = 1024
CROWD = 16 * BLOCK


@lru_cache(maxsize=1)
def _permutations() -> tuple[np.ndarray, np.ndarray]:
    """The permutation that places shingles, and the one read from there on, continued past the circle's end."""
    rng = np.random.default_rng(11)
    first, second = rng.permutation(CIRCLE).astype(np.int32), rng.permutation(CIRCLE).astype(np.uint32)
    return first, np.concatenate([second, second[:SKETCH]])


def signature(shingles: np.ndarray, coordinates: int) -> np.ndarray:
    """Circulant MinHash of a set: coordinate k is the least value of the second permutation, shifted by k, over the set."""
    place, values = _permutations()
    shifted = np.lib.stride_tricks.sliding_window_view(values, coordinates)
    spots = place[(shingles >> np.uint64(64 - CIRCLE_BITS)).astype(np.int64)]
    step = max(1, (1 << 20) // coordinates)
    out = shifted[spots[:step]].min(axis=0)
    for at in range(step, len(spots), step):
        np.minimum(out, shifted[spots[at : at + step]].min(axis=0), out=out)
    return out


def shingle_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The sorted set of each text; a text with fewer words than a shingle has its whole sequence as one."""
    for lo, hi in slices(texts, SLICE_BYTES):
        found = words(*raw(texts.slice(lo, hi - lo)), lower=True)
        runs = windows(found.hashes, size)
        for begin, end in zip(found.bounds[:-1].tolist(), found.bounds[1:].tolist()):
            if end - begin >= size:
                yield np.unique(runs[begin : end - size + 1])
            else:
                yield windows(found.hashes[begin:end], end - begin) if end > begin else np.empty(0, np.uint64)


def _key(shingles: np.ndarray) -> bytes:
    return md5(shingles.tobytes()).digest()


def band_keys(shingles: np.ndarray) -> np.ndarray:
    bands = signature(shingles, BANDS * BAND_ROWS).reshape(BANDS, BAND_ROWS).astype(np.uint64)
    key = np.arange(BANDS, dtype=np.uint64)
    for row in range(BAND_ROWS):
        key = (key * np.uint64(CIRCLE + 7) + bands[:, row]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(32)
    return key.view(np.int64)


def _int64_lists(arrays: list[np.ndarray]) -> pa.Array:
    bounds = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate([np.empty(0, np.int64), *[a.view(np.int64) for a in arrays]])))


def described(df: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """``_id, _hash, n, key, bands`` for every row; a set without shingles has neither key nor bands."""
    source = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.xxhash64(text_col).alias("_hash"))
    schema = T.StructType([source.schema["_id"], source.schema["_hash"], T.StructField("n", T.LongType()), T.StructField("key", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))])

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, keys, bands = [], [], []
            for shingles in shingle_sets(batch.column(1), size):
                n.append(len(shingles))
                keys.append(_key(shingles) if len(shingles) else None)
                bands.append(band_keys(shingles) if len(shingles) else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), _int64_lists(bands)], schema.names)

    return source.mapInArrow(describe, schema)


def full_sets(df: DataFrame, size: int) -> DataFrame:
    """``key, n, shingles, sketch`` of rows (``text, key``) whose text has the set of that key."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sets, done = batch.column(1).to_pylist(), [], []
            for key, shingles in zip(keys, shingle_sets(batch.column(0), size)):
                if len(shingles) and _key(shingles) == key:
                    sets.append(shingles)
                    done.append(key)
            for at in range(0, len(done), 256):
                part = sets[at : at + 256]
                sketches = [signature(s, SKETCH).astype(np.uint8).tobytes() for s in part]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(done[at : at + 256], pa.binary()),
                        pa.array([len(s) for s in part], pa.int64()),
                        _int64_lists(part),
                        pa.array(sketches, pa.binary()),
                    ],
                    ["key", "n", "shingles", "sketch"],
                )

    return df.select("text", "key").mapInArrow(compute, "key binary, n long, shingles array<long>, sketch binary").dropDuplicates(["key"])


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (``a, b``) whose sets' intersection is at least ``percent`` per cent of their union."""
    side = lambda name: sets.select(F.col("key").alias(name), F.col("n").alias(f"n_{name}"), F.col("shingles").alias(f"set_{name}"))
    both = F.size(F.array_intersect("set_a", "set_b"))
    return pairs.join(side("a"), "a").join(side("b"), "b").filter(100 * both >= percent * (F.col("n_a") + F.col("n_b") - both)).select("a", "b")


def mixed_pieces(rows: DataFrame) -> DataFrame:
    """Rows (``piece, key, root``) of the pieces with several roots, with the piece's ``size``."""
    sizes = rows.groupBy("piece").agg(F.count(F.lit(1)).alias("size"), F.min("root").alias("_least"), F.max("root").alias("_most"))
    return rows.join(sizes.filter(F.col("_least") != F.col("_most")).select("piece", "size"), "piece")


def pieces(members: DataFrame, sets: DataFrame) -> DataFrame:
    """``piece, key, root, size``: the groups of members (``bucket, key, root``) that are compared with each other.

    Buckets of up to ``CROWD`` members are pieces as they are.  Members of larger ones are dealt out by further bands, and again where that leaves more than ``CROWD``.
    """
    found = stage(mixed_pieces(members.select(F.col("bucket").alias("piece"), "key", "root")), "near-pieces")
    out = found.filter(F.col("size") <= CROWD)
    crowded = found.filter(F.col("size") > CROWD).select(F.lit(0).cast("long").alias("piece"), "key", "root").distinct()
    for level in range(SPLITS):
        if crowded.isEmpty():
            return out
        part = lambda j: F.substring("sketch", level * SPLIT_BANDS * SPLIT_ROWS + 1, SPLIT_BANDS * SPLIT_ROWS).substr(j * SPLIT_ROWS + 1, F.lit(SPLIT_ROWS))  # noqa: E731, B023
        bands = F.transform(F.sequence(F.lit(0), F.lit(SPLIT_BANDS - 1)), lambda j: F.xxhash64("piece", j, part(j)))
        split = crowded.join(sets.select("key", "sketch"), "key").select(F.explode(bands).alias("piece"), "key", "root")
        found = stage(mixed_pieces(split), "near-pieces")
        out = out.unionByName(found.filter(F.col("size") <= CROWD))
        crowded = found.filter(F.col("size") > CROWD).drop("size")
    return out.unionByName(found.filter(F.col("size") > CROWD))


def further_pairs(searched: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components within a piece (``piece, key, root, size``) that their sizes and sketches allow to be linked.

    A pair may share many pieces.  Each member carries the list of its pieces, and the least common one alone gives the pair.
    """
    share = percent / 100
    least = (share - 4.5 * np.sqrt(share * (1 - share) / SKETCH)) * SKETCH
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("key"), blocks).cast("int")
    held = searched.groupBy("key").agg(F.collect_set("piece").alias("held"))
    dealt = (
        searched.join(sets.select("key", "n", "sketch"), "key").join(held, "key")
        .withColumn("_blocks", blocks).withColumn("_own", own)
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
        .select("piece", F.least("_own", "_other").alias("i"), F.greatest("_own", "_other").alias("j"), "_own", "key", "root", "n", "sketch", "held")
    )

    def search(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("key", kind="stable").reset_index(drop=True)
        sketch = np.frombuffer(b"".join(rows["sketch"]), np.uint8).reshape(len(rows), -1)
        root, n, own = pd.factorize(rows["root"])[0], rows["n"].to_numpy(), rows["_own"].to_numpy()
        crossing, piece = rows["i"].iloc[0] != rows["j"].iloc[0], rows["piece"].iloc[0]
        held = [set(h.tolist()) for h in rows["held"]]
        left, right = [], []
        for x in range(len(rows) - 1):
            y = np.arange(x + 1, len(rows))
            fits = (root[y] != root[x]) & (100 * np.minimum(n[y], n[x]) >= percent * np.maximum(n[y], n[x]))
            if crossing:
                fits &= own[y] != own[x]
            y = y[fits]
            y = y[(sketch[y] == sketch[x]).sum(axis=1) >= least]
            here = [z for z in y.tolist() if min(held[x] & held[z]) == piece]
            left += [x] * len(here)
            right += here
        keys = rows["key"].to_numpy()
        return pd.DataFrame({"a": keys[left], "b": keys[right]})

    return dealt.groupBy("piece", "i", "j").applyInPandas(search, "a binary, b binary")


def near_duplicates(df: DataFrame, shingle: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Component of every row of ``df``: ``<id_col>, n_shingles, component_id, kept``.

    Rows are linked if ``100 * intersection >= percent * union`` holds for their shingle sets; ``component_id`` is the smallest id reachable, the
    row's own included, and ``kept`` tells whether it is the row's.  Null, empty and white-space texts have no shingles and link with
    nothing.  Rows are nodes: repeated rows are linked by their equal sets, and all rows that carry a component's smallest id are kept.  A null id
    is never a component's smallest id unless the component has no other.  An empty table gives no rows.  Other columns are ignored, whatever their names.
    """
    return _components(df, shingle, percent, id_col, text_col).select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", "kept")


def _components(df: DataFrame, shingle: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """``_id, _hash, n, component_id, kept`` of every row, the hash being that of its text."""
    rows = stage(described(df, shingle, id_col, text_col), "near-rows")
    classes = stage(
        rows.filter(F.col("key").isNotNull()).groupBy("key").agg(
            F.min("_id").alias("least_id"), F.min(F.struct("_hash", "_id")).alias("example"), F.any_value("bands").alias("bands")
        ),
        "near-classes",
    )
    entries = classes.select("key", F.explode("bands").alias("bucket"))
    shared = entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > 1)
    members = stage(entries.join(shared, "bucket"), "near-members")
    popular = members.groupBy("key").agg(F.sum("size").alias("popularity"))
    # one text of each class, by hash and id: rows without an id must not all meet
    wanted = classes.join(popular, "key").select("key", "example.*")
    texts = df.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_hash"), F.col(text_col).alias("text"))
    same = (texts["_hash"] == wanted["_hash"]) & texts["_id"].eqNullSafe(wanted["_id"])
    sets = stage(full_sets(texts.join(wanted, same), shingle), "near-sets")

    ranked = members.join(popular, "key")
    leaders = ranked.groupBy("bucket").agg(F.max(F.struct("popularity", "key"))["key"].alias("a"))
    star = members.join(leaders, "bucket").filter(F.col("key") != F.col("a")).select("a", F.col("key").alias("b")).distinct()
    links = stage(confirmed(star, sets, percent), "near-links")
    roots = stage(connected_components(links), "near-roots")

    labelled = members.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    pairs = further_pairs(pieces(labelled, sets), sets, percent)
    more = stage(confirmed(pairs, sets, percent), "near-links")
    if not more.isEmpty():
        roots = stage(connected_components(links.union(more)), "near-roots")

    rooted = classes.select("key", "least_id").join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    component = rooted.join(least, "root").select("key", "component_id")
    answer = F.when(F.col("key").isNull(), F.col("_id")).otherwise(F.col("component_id"))
    return rows.select("_id", "_hash", "n", "key").join(component, "key", "left").select(
        "_id", "_hash", "n", answer.alias("component_id"), F.col("_id").eqNullSafe(answer).alias("kept")
    )


def drop_near_duplicates(df: DataFrame, shingle: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stand for their component, with all columns: those with its smallest id, repeated rows once.

    Rows without an id stay if a component has no other rows.
    """
    found = _components(df, shingle, percent, id_col, text_col).filter("kept")
    kept = stage(found.groupBy(F.col("_id").alias("_kept_id"), F.col("_hash").alias("_kept_hash")).agg(F.count(F.lit(1)).alias("_times")), "near-kept")

    def rows(of: DataFrame) -> DataFrame:
        same = df[id_col].eqNullSafe(of["_kept_id"]) & (F.xxhash64(df[text_col]) == of["_kept_hash"])  # each row follows its own component
        return df.join(of, same, "left_semi")

    repeated = kept.filter("_times > 1")
    if repeated.isEmpty():
        return rows(kept)
    # whole rows are dealt by their text once more only where some repeat
    return rows(kept.filter("_times = 1")).unionByName(rows(repeated).dropDuplicates([id_col, text_col]))
