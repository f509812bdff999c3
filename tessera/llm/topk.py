"""Exact top-k by inner product: norm-bucketed retrieval.

Vectors are grouped by length into bands, and bands into blocks of bounded size.  A query's threshold is its k-th best
score among a few of the longest vectors.  A block of queries meets a block of vectors only if the largest length there reaches one of its queries' threshold over length, which is
found out before any vector is sent.  For a block, threshold over (query length times the block's largest length) is a
local cosine threshold: above 1, no vector of the block can qualify; otherwise the query either scans the
vectors that are long enough, or those whose value in the query's dominant coordinate lies where a vector of that cosine must
have it, whichever costs less, and their products are computed exactly.  A block's vectors are ordered by length, so those that are long enough
for a query are its first ones: queries that ask for about as many of them share one product of matrices.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, Window as W

from .exact_products import best as best_places, beyond, clipped, packed, products, unpacked
from .scratch import stage

BLOCK = 4096
QUERY_BLOCK = 1024
BANDS = 16
SLACK = 1e-9
#: Queries that share a product of matrices, and the vectors of a run whose scores cost as much as those of one vector picked by itself.
GROUP = 64
PICKED = 8


def _packed(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per block: ids, vectors in the smallest type that holds their integers, and the largest length."""

    def pack(key: tuple, rows: pa.Table) -> pa.Table:
        ids = rows["_id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        matrix = rows["_vector"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1)[order]
        kind, data = packed(matrix)
        block = {"ids": [ids[order].tobytes()], "kind": [kind], "matrix": [data], "longest": [np.sqrt((matrix * matrix).sum(axis=1)).max()]}
        return pa.table({k: pa.array([v.as_py()], pa.int32()) for k, v in zip(keys, key)} | block)

    return df.groupBy(*keys).applyInArrow(pack, ", ".join(f"{k} int" for k in keys) + ", ids binary, kind string, matrix binary, longest double")


def _read(ids: bytes, kind: str, matrix: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, np.int64), unpacked(kind, matrix, dim)


def kth_best(queries: np.ndarray, query_ids: np.ndarray, seeds: np.ndarray, seed_ids: np.ndarray, k: int) -> np.ndarray:
    """The k-th best score of each query among the seeds' ids, its own apart, each with its best row; minus infinity if there are fewer."""
    by_id = np.argsort(seed_ids, kind="stable")
    distinct, first = np.unique(seed_ids[by_id], return_index=True)
    if len(distinct) < k:
        return np.full(len(queries), -np.inf)
    exact = products(queries, seeds[by_id])
    scores = np.maximum.reduceat(exact, first, axis=1).astype(np.float64)
    if exact.dtype != np.float64:
        scores = np.nextafter(scores, -np.inf)  # a threshold may be lower than the score it stands for, not higher
    scores[query_ids[:, None] == distinct[None, :]] = -np.inf
    return np.partition(scores, len(distinct) - k, axis=1)[:, len(distinct) - k]


def least_length(queries: np.ndarray, thresholds: np.ndarray) -> float:
    """The length under which no vector can reach the threshold of any of the queries."""
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        lengths = np.sqrt((queries * queries).sum(axis=1))
        least = np.where(thresholds > 0, thresholds / lengths * (1 - SLACK), 0.0)
    return float(np.where(np.isfinite(least), least, 0.0).min())


@np.errstate(divide="ignore", over="ignore", invalid="ignore")
def chosen_rows(queries: np.ndarray, thresholds: np.ndarray, vectors: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """How many of the vectors, the longest first, each query scans; for queries whose dominant coordinate leaves far fewer, their places instead."""
    sizes, longest = np.sqrt((queries * queries).sum(axis=1)), lengths[0]
    bounded = (thresholds > 0) & np.isfinite(sizes) & np.isfinite(longest)
    counts = np.where(bounded, np.searchsorted(-lengths, -thresholds / sizes * (1 - SLACK), "right"), len(lengths))
    counts[bounded & (thresholds > sizes * longest * (1 + SLACK))] = 0
    cosine = np.minimum(1.0, thresholds / (sizes * longest)) - SLACK
    dominant = np.abs(queries).argmax(axis=1)
    q = queries[np.arange(len(queries)), dominant] / sizes
    spread = np.sqrt(np.maximum(0.0, 1 - q * q) * np.maximum(0.0, 1 - cosine * cosine))
    low = np.where(q <= -cosine, -1.0, q * cosine - spread) - SLACK
    high = np.where(q >= cosine, 1.0, q * cosine + spread) + SLACK
    picked: dict[int, np.ndarray] = {}
    for at in np.unique(dominant[bounded & (counts > 0)]).tolist():
        values = vectors[:, at] / np.where(lengths > 0, lengths, 1)
        by_value = np.argsort(values, kind="stable")
        rows = np.flatnonzero(bounded & (counts > 0) & (dominant == at))
        bounds = [np.searchsorted(values, ends[rows], side, sorter=by_value).tolist() for ends, side in ((low, "left"), (high, "right"))]
        picked |= {i: by_value[lo:hi] for i, lo, hi in zip(rows.tolist(), *bounds) if PICKED * (hi - lo) < counts[i]}
    return counts, picked


@np.errstate(over="ignore", invalid="ignore")
def search_block(queries, query_ids, thresholds, vectors, ids, k) -> list[tuple[int, int, int]]:
    """(query, vec_id, score) of up to ``k`` best ids of a block for each query, each with its best vector, none that is under its threshold."""
    # below 2 ** 53 sums of products are exact in float64
    plain = max(1, vectors.shape[1]) * float(np.abs(vectors).max(initial=0)) * float(np.abs(queries).max(initial=0)) < 2.0**53
    lengths = np.sqrt((vectors * vectors).sum(axis=1))
    by_length = np.argsort(-lengths, kind="stable")
    vectors, ids, lengths = vectors[by_length], ids[by_length], lengths[by_length]
    repeated = len(np.unique(ids)) < len(ids)
    counts, picked = chosen_rows(queries, thresholds, vectors, lengths)
    found = []

    def take(i: int, scores: np.ndarray, own: np.ndarray) -> None:
        keep = (own != query_ids[i]) & (scores >= thresholds[i]).astype(bool)
        scores, own = scores[keep], own[keep]
        best = best_places(scores, own, len(own) if repeated else k)
        if repeated:
            _, first = np.unique(own[best], return_index=True)
            best = best[np.sort(first)[:k]]
        found.extend(zip([int(query_ids[i])] * len(best), own[best].tolist(), scores[best].tolist()))

    score = (lambda a, b: a @ b.T) if plain else products
    for i, rows in picked.items():
        take(i, score(queries[[i]], vectors[rows])[0], ids[rows])
    scanning = np.array([i for i in np.argsort(counts, kind="stable").tolist() if counts[i] and i not in picked], dtype=np.int64)
    group = GROUP if plain else 1
    for start in range(0, len(scanning), group):
        some = scanning[start : start + group]
        run = slice(0, counts[some[-1]])
        scores = score(queries[some], vectors[run])
        high = (scores >= thresholds[some, None]).astype(bool)
        for i, own_scores, at in zip(some.tolist(), scores, high):
            take(i, own_scores[at], ids[run][at])
    return found


def exact_top_k(df: DataFrame, k: int = 5, every: int = 50, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Each query's ``k`` highest integer inner products: ``query_id, rank, <id_col>, score``.

    A component x counts as ``floor(scale * x)`` (``scale`` is a power of two), and scores are exact at any size: they are compared as integers, and one outside the range of a long
    is returned as that range's end.  A component whose multiple is no finite double counts as non-finite.  Queries are the rows whose id is divisible by ``every``; candidates are all rows whose id
    is not the query's.  Ties go to the smaller id.  Null vectors, vectors with null or non-finite components, empty
    vectors and null ids take no part; vectors of different dimensions don't meet.  A query repeated with the same id and vector is one query; with different
    vectors, each candidate counts with its best score, and repeated candidates count once.  Fewer candidates than ``k`` give fewer rows; an
    empty table gives none.  Other columns are ignored, whatever their names.
    """
    wide = lambda x: x.cast("double") * scale
    finite = F.forall(vector_col, lambda x: F.abs(wide(x)) < F.lit(float("inf")))  # neither nulls nor NaN, which is above infinity, are
    whole = lambda x: F.when(F.abs(wide(x)) < 2.0**53, F.floor(wide(x)).cast("double")).otherwise(wide(x))  # noqa: E731  larger doubles are integers
    vectors = stage(
        df.filter(F.col(id_col).isNotNull() & (F.size(vector_col) > 0) & finite)
        .select(
            F.col(id_col).cast("long").alias("_id"),
            F.transform(vector_col, whole).alias("_vector"),
        )
        .distinct()
        .withColumn("_dim", F.size("_vector"))
        .withColumn("_norm", F.aggregate("_vector", F.lit(0.0), lambda a, x: a + x * x)),
        "topk",
    )
    empty = df.sparkSession.createDataFrame([], f"query_id long, rank int, {id_col} long, score long")
    steps = [F.lit(i / BANDS) for i in range(1, BANDS)]
    edges = vectors.groupBy("_dim").agg(
        F.count(F.when(F.col("_id") % every == 0, 1)).alias("queries"),
        F.percentile_approx("_norm", F.array(*steps), F.lit(10000)).alias("edges"),
    )
    edges = edges.withColumn("edges", F.array_distinct("edges"))
    banded = vectors.join(F.broadcast(edges), "_dim").withColumn("_band", F.size(F.filter("edges", lambda e: e < F.col("_norm"))))
    dims = edges.select("_dim", "queries").collect()  # a row for each dimension
    if not dims:
        return empty
    crowd = banded.groupBy("_dim", "_band").count().agg(F.max("count")).first()[0]
    salts = -(-crowd // BLOCK)
    query_blocks = max(1, -(-max(r["queries"] for r in dims) // QUERY_BLOCK))
    salt = lambda n: F.pmod(F.xxhash64("_id"), F.lit(n)).cast("int")
    blocked = banded.withColumn("_salt", salt(salts))
    blocks = stage(_packed(blocked.select("_dim", "_band", "_salt", "_id", "_vector"), ["_dim", "_band", "_salt"]), "topk-blocks")
    queries = vectors.filter(F.col("_id") % every == 0).withColumn("_query_block", salt(query_blocks))
    packed_queries = _packed(queries.select("_dim", "_query_block", "_id", "_vector"), ["_dim", "_query_block"])
    # the longest vectors seed the thresholds: one bounded block for each dimension
    seeds = blocks.groupBy("_dim").agg(F.max_by(F.struct("ids", "kind", "matrix"), F.struct("_band", -F.col("_salt"))).alias("seed"))
    seeded = packed_queries.join(seeds, "_dim").select("_dim", "_query_block", F.col("ids").alias("query_ids"), F.col("kind").alias("query_kind"), F.col("matrix").alias("query_matrix"), "seed")

    def thresholds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for r in rows.rename(columns={"_dim": "dim"}).itertuples(index=False):
                ids, matrix = _read(r.query_ids, r.query_kind, r.query_matrix, r.dim)
                seed_ids, seed = _read(r.seed["ids"], r.seed["kind"], r.seed["matrix"], r.dim)
                best = kth_best(matrix, ids, seed, seed_ids, k)
                out.append((best.tobytes(), least_length(matrix, best)))
            yield rows.drop(columns="seed").assign(thresholds=[b for b, _ in out], least=[x for _, x in out])

    aimed = stage(
        seeded.mapInPandas(thresholds, "_dim int, _query_block int, query_ids binary, query_kind string, query_matrix binary, thresholds binary, least double"), "topk-queries"
    )
    # the keys of the pairs of blocks that can hold a result, then the vectors
    spots, wanted = blocks.select("_dim", "_band", "_salt", "longest"), aimed.select("_dim", "_query_block", "least")
    met = spots.join(wanted, "_dim").filter(F.col("least") <= F.col("longest")).drop("longest", "least")
    pairs = met.join(blocks, ["_dim", "_band", "_salt"]).join(aimed, ["_dim", "_query_block"]).select("_dim", "ids", "kind", "matrix", "query_ids", "query_kind", "query_matrix", "thresholds")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                query_ids, query_matrix = _read(r["query_ids"], r["query_kind"], r["query_matrix"], r["_dim"])
                ids, matrix = _read(r["ids"], r["kind"], r["matrix"], r["_dim"])
                rows = search_block(query_matrix, query_ids, np.frombuffer(r["thresholds"]), matrix, ids, k)
                columns = list(zip(*rows)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array([clipped(x) for x in columns[2]], pa.int64()),
                        pa.array([beyond(x) or "1" for x in columns[2]], pa.string()),
                    ],
                    ["query_id", "_other", "score", "beyond"],
                )

    found = pairs.mapInArrow(search, "query_id long, _other long, score long, beyond string").groupBy("query_id", "_other").agg(F.max(F.struct("score", "beyond")).alias("_best"))
    found = found.select("query_id", "_other", "_best.*")
    best = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), F.desc("beyond"), "_other"))
    return found.withColumn("rank", best).filter(F.col("rank") <= k).select("query_id", "rank", F.col("_other").alias(id_col), "score")
