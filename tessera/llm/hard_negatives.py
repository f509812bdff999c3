"""Hard-negative mining by dual-tree search.

1. The tree over candidates: cells of a two-level tree of centres, fitted on a bounded sample and used for all rows, then blocks of bounded size
   of one cell and label, then leaves of neighbouring rows inside a block.  The tree over anchors: blocks of one label and upper cell, then leaves.
   Every node has a centre and a radius.
2. The inner products of two nodes lie within ``a.b +- (|a| r_b + |b| r_a + r_a r_b)``.  A pair of nodes is left out, for all anchors of the
   group at once, if that interval meets none of the scores that its anchors still ask for.  Pairs of leaves that remain are scored exactly.
3. A first search finds the positives (same label), from a lower bound that one nearby block gives.  The second one finds, for each positive, the highest scores of other labels
   between a share of the positive's and the positive's own, from lower bounds that two nearby blocks of different labels give.

Vectors meet in pairs of blocks that Spark joins by block; nothing but the sample, which ``Shape`` bounds, and its centres reach the driver.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .exact_products import best, beyond, clipped, packed, products, restored, scaled, unpacked
from .scratch import stage

SLACK = 1e-9
OUTSIDE = 1 << 62  # of the scores that ``products`` returns in numpy's own numbers


@dataclass(frozen=True)
class Shape:
    """Bounds of the trees: rows and numbers of the sample, cells of each level, rows of blocks and leaves.

    A tree has as many cells as the rows fill blocks, up to ``upper * lower``.
    """

    sample: int = 8192
    sample_numbers: int = 1 << 21
    upper: int = 16
    lower: int = 16
    block: int = 2048
    anchor_block: int = 512
    leaf: int = 64

    def fitted(self, rows: int) -> Shape:
        """The shape for so many rows."""
        cells = -(-rows // self.block)
        upper = max(1, min(self.upper, math.ceil(math.sqrt(cells))))
        return replace(self, upper=upper, lower=max(1, min(self.lower, -(-cells // upper))))


@np.errstate(over="ignore", invalid="ignore")
def fit_centres(points: np.ndarray, parts: int, rounds: int = 6) -> np.ndarray:
    """Centres of up to ``parts`` groups of points, by Lloyd's steps from points far apart."""
    points = np.unique(points, axis=0)
    centres = points[:1]
    far = ((points - centres[0]) ** 2).sum(axis=1)
    while len(centres) < min(parts, len(points)):
        centres = np.concatenate([centres, points[[int(far.argmax())]]])
        far = np.minimum(far, ((points - centres[-1]) ** 2).sum(axis=1))
    for _ in range(rounds):
        own = nearest(points, centres)
        centres = np.stack([points[own == i].mean(axis=0) if (own == i).any() else centres[i] for i in range(len(centres))])
    return centres


@np.errstate(over="ignore", invalid="ignore")
def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(axis=1)[None, :] - 2 * points @ centres.T).argmin(axis=1)


def fit_tree(points: np.ndarray, shape: Shape) -> tuple[np.ndarray, list[np.ndarray]]:
    """Upper centres, and the centres of each upper cell's parts."""
    upper = fit_centres(points, shape.upper)
    own = nearest(points, upper)
    return upper, [fit_centres(points[own == i], shape.lower) if (own == i).any() else upper[[i]] for i in range(len(upper))]


@np.errstate(over="ignore", invalid="ignore")
def placed(points: np.ndarray, tree: tuple[np.ndarray, list[np.ndarray]] | None, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """The cell of each point and its distance to the cell's centre; without a tree there is one cell, about the origin."""
    if tree is None:
        return np.zeros(len(points), np.int64), np.sqrt((points * points).sum(axis=1))
    upper, lower = tree
    above = nearest(points, upper)
    cells, far = np.empty(len(points), np.int64), np.empty(len(points))
    for i in np.unique(above):
        rows = np.flatnonzero(above == i)
        part = nearest(points[rows], lower[i])
        cells[rows] = i * shape.lower + part
        far[rows] = np.sqrt(((points[rows] - lower[i][part]) ** 2).sum(axis=1))
    return cells, far


@np.errstate(over="ignore", invalid="ignore")
def ball(points: np.ndarray) -> tuple[np.ndarray, float]:
    centre = points.mean(axis=0)
    return centre, float(np.sqrt(((points - centre) ** 2).sum(axis=1).max()))


@np.errstate(over="ignore", invalid="ignore")
def intervals(a: np.ndarray, ra: np.ndarray, b: np.ndarray, rb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and most inner product of points of each ball of one side with points of each ball of the other, a little widened."""
    na, nb = np.sqrt((a * a).sum(axis=1)), np.sqrt((b * b).sum(axis=1))
    spread = na[:, None] * rb[None, :] + ra[:, None] * nb[None, :] + ra[:, None] * rb[None, :]
    slack = SLACK * ((na + ra)[:, None] * (nb + rb)[None, :] + 1)
    middle = a @ b.T
    return middle - spread - slack, middle + spread + slack


@np.errstate(over="ignore", invalid="ignore")
def leaves(points: np.ndarray, most: int) -> tuple[np.ndarray, list[slice], np.ndarray, np.ndarray]:
    """An order of the points in which runs of at most ``most`` are neighbours (halves by the coordinate that varies most), the runs, their centres and radii."""
    order, bounds, todo = np.arange(len(points)), [], [(0, len(points))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo <= most:
            bounds.append((lo, hi))
            continue
        rows, middle = order[lo:hi], (hi - lo) // 2
        axis = int(np.var(points[rows], axis=0).argmax())
        order[lo:hi] = rows[np.argpartition(points[rows, axis], middle)]
        todo += [(lo, lo + middle), (lo + middle, hi)]
    runs = [slice(lo, hi) for lo, hi in sorted(bounds)]
    balls = [ball(points[order[r]]) for r in runs]
    return order, runs, np.stack([c for c, _ in balls]), np.array([r for _, r in balls])


def _floats(matrix: np.ndarray) -> np.ndarray:
    return np.array([float(x) if abs(x) < 1e300 else np.copysign(np.inf, x) for x in matrix.ravel()]).reshape(matrix.shape) if matrix.dtype == object else matrix


def _wanted(lo: np.ndarray, hi: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Which intervals may hold a score from ``least`` to ``most`` of a group; those of overflowing numbers may."""
    return ~((hi < least) | (lo > most))


class Aim:
    """What the anchors of a block ask for: bands ``low <= score <= high``, one for each anchor or several, as Python integers (none: unbounded).

    ``best`` has the best scores that blocks searched by now have in a band.
    """

    def __init__(self, low: list[list], high: list[list]):
        self.low, self.high = low, high
        self.best: dict[tuple[int, int], list] = {}
        self.matrices: dict[type, tuple[np.ndarray, np.ndarray]] = {}

    def written(self) -> str:
        """A line for each anchor, its bands apart by semicolons."""
        text = lambda x: "" if x is None else str(x)
        return "\n".join(";".join(f"{text(x)},{text(y)}" for x, y in zip(a, b)) for a, b in zip(self.low, self.high))

    @classmethod
    def read(cls, text: str) -> Aim:
        number = lambda x: int(x) if x else None
        bands = [[band.split(",") for band in line.split(";") if band] for line in text.split("\n")]
        return cls([[number(low) for low, _ in b] for b in bands], [[number(high) for _, high in b] for b in bands])

    def of(self, rows: np.ndarray) -> tuple[float, float]:
        """The band that holds all bands of some anchors; an anchor without a band asks for nothing."""
        low = [x for i in rows for x in self.low[i]]
        high = [x for i in rows for x in self.high[i]]
        if not low:
            return np.inf, -np.inf
        return (-np.inf if None in low else float(min(low)) - 1), (np.inf if None in high else float(max(high)) + 1)

    def limits(self, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
        """Lowest and highest scores, a row for each anchor and a column for each band, to compare with scores of a kind that ``products`` returns.

        Scores that are no Python integers lie between ``-OUTSIDE`` and ``OUTSIDE``, which stand for numbers beyond; an anchor without the band asks for nothing.
        """
        own = object if kind == object else np.int64
        if own not in self.matrices:
            bands = max(map(len, self.low), default=0)
            ends = [[(-np.inf if x is None else x for x in a), (np.inf if x is None else x for x in b), bands - len(a)] for a, b in zip(self.low, self.high)]
            matrix = lambda rows: np.array([[x if own is object else max(-OUTSIDE, min(OUTSIDE, x)) for x in row] for row in rows], dtype=own).reshape(len(self.low), bands)
            self.matrices[own] = matrix([*a, *[np.inf] * lacking] for a, _, lacking in ends), matrix([*b, *[-np.inf] * lacking] for _, b, lacking in ends)
        return self.matrices[own]

    def met(self, found: list[tuple[int, int, int, int]], k: int) -> None:
        """Bands in which ``k`` rows have been found by now ask for no score under the least of the best ``k``."""
        for row, band, _, score in found:
            best = self.best.setdefault((row, band), [])
            heapq.heappush(best, score)
            if len(best) > k:
                heapq.heappop(best)
        for row, band in {f[:2] for f in found}:
            best = self.best[row, band]
            if len(best) == k and (self.low[row][band] is None or best[0] > self.low[row][band]):
                self.low[row][band] = best[0]
                for own, (low, _) in self.matrices.items():
                    low[row, band] = best[0] if own is object else max(-OUTSIDE, min(OUTSIDE, best[0]))


def inside(scores: np.ndarray, low: int | np.ndarray | None, high: int | np.ndarray | None) -> np.ndarray:
    """Which scores lie in a band; limits are numbers, or arrays that meet the scores."""
    fits = np.ones(scores.shape, bool)
    if low is not None:
        fits &= (scores >= low).astype(bool)
    if high is not None:
        fits &= (scores <= high).astype(bool)
    return fits


def search(
    anchors: np.ndarray, anchor_ids: np.ndarray, aim: Aim, vectors: np.ndarray, ids: np.ndarray, k: int, leaf: int = Shape.leaf, own: tuple | None = None
) -> Iterator[tuple[int, int, int, int]]:
    """(anchor's place, band, id, score) of the ``k`` best ids in each band; pairs of leaves outside the bands are not scored.  ``own`` has the anchors' leaves, if known."""
    own = own or leaves(_floats(anchors), leaf)
    other = leaves(_floats(vectors), leaf)
    lo, hi = intervals(own[2], own[3], other[2], other[3])
    for g, run in enumerate(own[1]):
        rows = own[0][run]
        least, most = aim.of(rows)
        near = np.flatnonzero(_wanted(lo[g], hi[g], least, most))
        if not len(near):
            continue
        chosen = np.concatenate([other[0][other[1][j]] for j in near])
        scores = products(anchors[rows], vectors[chosen])
        low, high = (ends[rows] for ends in aim.limits(scores.dtype))
        # few scores lie in any band of their anchor: the bands are told apart among those
        at, place = np.nonzero(inside(scores, low.min(axis=1)[:, None], high.max(axis=1)[:, None]) & (ids[chosen] != anchor_ids[rows, None]))
        found, found_ids = scores[at, place], ids[chosen[place]]
        for band in range(low.shape[1]):
            here = np.flatnonzero(inside(found, low[at, band], high[at, band]))
            for i in np.flatnonzero(np.bincount(at[here]) > k).tolist():
                mine = here[at[here] == i]
                here = np.concatenate([here[at[here] != i], mine[best(found[mine], found_ids[mine], k)]])
            yield from zip(rows[at[here]].tolist(), [band] * len(here), found_ids[here].tolist(), map(int, found[here].tolist()))


def kth(scores: np.ndarray, ids: np.ndarray, k: int) -> int | None:
    """The ``k``-th best score, none if there are fewer."""
    return int(scores[best(scores, ids, k)[-1]]) if len(scores) >= k else None


NODE = "kind string, ids binary, matrix binary"
#: Found rows that are handed back at once.
FOUND = 4096


def unpacked_rows(kinds: list[str], rows: list[bytes], dim: int) -> np.ndarray:
    """The matrix of vectors that were packed one by one; of Python integers if one of them is."""
    if len(set(kinds)) == 1:
        return unpacked(kinds[0], (b"\n" if kinds[0] == "o" else b"").join(rows), dim)
    parts = [unpacked(kind, data, dim) for kind, data in zip(kinds, rows)]
    if any(p.dtype == object for p in parts):
        parts = [p if p.dtype == object else np.array([[int(x) for x in p[0]]], dtype=object) for p in parts]
    return np.concatenate(parts)


def _blocks(rows: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each block: its rows' ids and integer vectors as bytes, centre and radius."""

    def pack(group: pa.Table) -> pa.Table:
        group = group.take(np.argsort(group["_id"].to_numpy(), kind="stable"))
        matrix = unpacked_rows(group["_kind"].to_pylist(), group["_row"].to_pylist(), group["_dim"][0].as_py())
        kind, data = packed(matrix)
        centre, radius = ball(_floats(matrix))
        block = {"kind": kind, "ids": group["_id"].to_numpy().tobytes(), "matrix": data, "centre": centre.tobytes(), "radius": radius}
        return pa.table({k: group[k].slice(0, 1) for k in keys} | {c: [x] for c, x in block.items()})

    types = dict(rows.dtypes)
    return rows.select(*keys, *[c for c in ("_dim", "_id", "_kind", "_row") if c not in keys]).groupBy(*keys).applyInArrow(pack, ", ".join(f"{k} {types[k]}" for k in keys) + f", {NODE}, centre binary, radius double")


def _salted(rows: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Add ``_salt``, so that about ``size`` rows share keys and salt."""
    counts = stage(rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / size).alias("_parts")), "negatives-counts")
    return rows.join(counts, keys).withColumn("_salt", F.pmod(F.xxhash64("_id", "_row"), F.col("_parts")).cast("int")).drop("_parts")


def _clean(df: DataFrame, scale: int, id_col: str, label_col: str, vector_col: str) -> DataFrame:
    """``_id, _label, _dim, _kind, _row`` of the rows that take part, each distinct row once."""
    vector = F.col(vector_col).cast("array<double>")
    finite = F.forall(vector, lambda x: F.abs(x) < F.lit(float("inf")))  # neither nulls nor NaN, which is above infinity, are
    rows = df.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (F.size(vector) > 0) & finite).select(
        F.col(id_col).cast("long").alias("_id"), F.col(label_col).alias("_label"), vector.alias("_vector")
    )
    label = rows.schema["_label"].dataType.simpleString()

    def integers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            values, ends = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(lists.value_lengths())[:-1]
            with np.errstate(over="ignore"):
                plain = np.isfinite(values * scale).all()
            # a row is scaled by itself where one of them needs Python integers, which are of that row only
            whole = np.split(scaled(values, scale), ends) if plain else [scaled(x, scale) for x in np.split(values, ends)]
            out = [packed(x) for x in whole]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), lists.value_lengths(), pa.array([k for k, _ in out], pa.string()), pa.array([d for _, d in out], pa.binary())],
                ["_id", "_label", "_dim", "_kind", "_row"],
            )

    return rows.mapInArrow(integers, f"_id long, _label {label}, _dim int, _kind string, _row binary").distinct()


def _trees(rows: DataFrame, shape: Shape) -> dict[int, tuple[np.ndarray, list[np.ndarray]]]:
    """A tree for each dimension that the sample has: the rows with the smallest hashes, within the bounds of ``shape``."""
    widest = rows.agg(F.max("_dim")).first()[0]
    if widest is None:
        return {}
    sample = rows.filter("_kind <> 'o'").orderBy(F.xxhash64("_id", "_row"), "_id").limit(max(1, min(shape.sample, shape.sample_numbers // widest))).select("_dim", "_kind", "_row").collect()
    points: dict[int, list[np.ndarray]] = {}
    for r in sample:
        points.setdefault(r["_dim"], []).append(unpacked(r["_kind"], r["_row"], r["_dim"])[0])
    return {dim: fit_tree(np.stack(p), shape) for dim, p in points.items()}


def hard_negatives(
    df: DataFrame, positives: int = 5, negatives: int = 5, every: int = 100, low_percent: int = 80, scale: int = 256,
    id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", shape: Shape = Shape(),
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    A component x counts as ``floor(scale * x)`` and scores are integer inner products, compared exactly at any size (those outside the range of a long are returned as
    its ends).  Anchors are the rows whose id is divisible by ``every``; an anchor's positives are its ``positives`` best other rows of its label.  For each,
    the ``negatives`` best rows of other labels with ``low_percent * positive_score <= 100 * negative_score <= 100 * positive_score`` are returned, ranked from 1.  Higher scores
    come first, ties go to the smaller id; fewer rows than asked for are all returned.

    Null ids and labels, null and empty vectors, and vectors with a null or non-finite component take no part; vectors of different
    dimensions don't meet.  Equal rows are one row; different rows with one id are rows of their own, which never meet each other, and each is an anchor of its own.
    An empty table gives no rows.  Other columns are ignored, whatever their names.
    """
    rows = stage(_clean(df, scale, id_col, label_col, vector_col), "negatives-rows")
    number, asking = rows.agg(F.count(F.lit(1)), F.count_if(F.col("_id") % every == 0)).first()
    shape = shape.fitted(number)
    trees = rows.sparkSession.sparkContext.broadcast(_trees(rows, shape))  # bounded by the shape

    def cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = batch.to_pandas()
            table["_cell"], table["_far"] = 0, np.inf
            for dim, group in table.groupby("_dim"):
                plain = group[group["_kind"] != "o"]
                if len(plain):
                    points = unpacked_rows(plain["_kind"].tolist(), plain["_row"].tolist(), dim)
                    cells, far = placed(points, trees.value.get(dim), shape)
                    table.loc[plain.index, "_cell"], table.loc[plain.index, "_far"] = cells, far
            yield pa.RecordBatch.from_pandas(table, schema=pa.schema([*batch.schema, ("_cell", pa.int64()), ("_far", pa.float64())]), preserve_index=False)

    label = dict(rows.dtypes)["_label"]
    fitted = stage(rows.mapInArrow(cell, f"_id long, _label {label}, _dim int, _kind string, _row binary, _cell long, _far double"), "negatives-cells")
    # anchors are grouped by upper cell once there are enough of them to fill blocks
    upper = F.floor(F.col("_cell") / shape.lower) if asking > shape.upper * shape.anchor_block else F.lit(0).cast("long")
    fitted = fitted.withColumn("_upper", upper)
    spot = ["_dim", "_label", "_cell"]
    blocks = stage(_blocks(_salted(fitted, spot, shape.block), [*spot, "_salt"]), "negatives-blocks").withColumn("_upper", upper)
    blocks = blocks.withColumn("_block", F.struct(*spot, "_salt"))
    ground = ["_dim", "_label", "_upper"]
    chosen = fitted.filter(F.col("_id") % every == 0)
    anchors = stage(_blocks(_salted(chosen, ground, shape.anchor_block), [*ground, "_salt"]), "negatives-anchors")
    anchors = anchors.select(F.struct(*ground, "_salt").alias("_anchors"), *ground, *[F.col(c).alias(f"a_{c}") for c in ("kind", "ids", "matrix", "centre", "radius")])
    # the cells of the tree over candidates: at most upper * lower for each dimension
    cells = fitted.groupBy("_dim", "_cell").agg(F.max("_far").alias("_far"))

    def met_cells(aimed: DataFrame) -> DataFrame:
        """``_anchors, a_least, a_most, _dim, _cell``: the cells that the group may find something in; a cell's centre is that of the fitted tree."""

        def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = []
                for r in batch.select(["_dim", "_cell", "_far", "a_centre", "a_radius", "a_least", "a_most"]).to_pylist():
                    tree, at = trees.value.get(r["_dim"]), r["_cell"]
                    centre = tree[1][at // shape.lower][at % shape.lower] if tree is not None else np.zeros(r["_dim"])
                    lo, hi = intervals(np.frombuffer(r["a_centre"])[None, :], np.array([r["a_radius"]]), centre[None, :], np.array([r["_far"]]))
                    keep.append(bool(_wanted(lo, hi, np.array(r["a_least"]), np.array(r["a_most"]))[0, 0]))
                yield batch.filter(pa.array(keep)).select(["_anchors", "_dim", "_cell", "a_least", "a_most", "a_centre", "a_radius"])

        kinds = dict(aimed.dtypes)
        slim = aimed.select("_anchors", "_dim", "a_centre", "a_radius", "a_least", "a_most").filter("a_least < double('Infinity')")
        # cells are dealt by dimension and number: one dimension is no hot key
        asked = slim.withColumn("_cell", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shape.upper * shape.lower - 1).cast("long"))))
        return asked.join(cells, ["_dim", "_cell"]).mapInArrow(descend, f"_anchors {kinds['_anchors']}, _dim int, _cell long, a_least double, a_most double, a_centre binary, a_radius double")

    def met_blocks(aimed: DataFrame, same: bool) -> DataFrame:
        """The pairs of blocks ``_anchors, _block`` that may hold a result: first the cells, then the blocks of each."""
        spots = blocks.select("_dim", "_cell", "_label", "_block", "centre", "radius")
        own = F.col("_anchors._label")
        pairs = met_cells(aimed).join(spots, ["_dim", "_cell"]).filter(F.col("_label") == own if same else F.col("_label") != own)

        def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = []
                for r in batch.select(["centre", "radius", "a_centre", "a_radius", "a_least", "a_most"]).to_pylist():
                    lo, hi = intervals(np.frombuffer(r["a_centre"])[None, :], np.array([r["a_radius"]]), np.frombuffer(r["centre"])[None, :], np.array([r["radius"]]))
                    keep.append(bool(_wanted(lo, hi, np.array(r["a_least"]), np.array(r["a_most"]))[0, 0]))
                yield batch.filter(pa.array(keep)).select(["_anchors", "_block"])

        kinds = dict(pairs.dtypes)
        return pairs.mapInArrow(narrow, f"_anchors {kinds['_anchors']}, _block {kinds['_block']}")

    def leaf_search(aimed: DataFrame, same: bool, k: int) -> DataFrame:
        """``_anchors, _row, anchor_id, _band, _other, score, beyond, rank`` of the pairs of blocks that are left."""
        pairs = met_blocks(aimed, same).join(blocks.select("_block", "kind", "ids", "matrix"), "_block").join(aimed.select("_anchors", "_dim", "a_kind", "a_ids", "a_matrix", "aim"), "_anchors")
        pairs = pairs.withColumn("_group", F.xxhash64("_anchors"))

        def rows_of(anchors: pa.Array, found: list[tuple]) -> pa.RecordBatch:
            pair, own, row, band, other, scores = zip(*found)
            return pa.RecordBatch.from_arrays(
                [
                    anchors.take(pa.array(pair, pa.int32())), pa.array(row, pa.int32()), pa.array(own, pa.int64()), pa.array(band, pa.int32()),
                    pa.array(other, pa.int64()), pa.array([clipped(x) for x in scores], pa.int64()), pa.array([beyond(x) for x in scores], pa.string()),
                ],
                ["_anchors", "_row", "anchor_id", "_band", "_other", "score", "beyond"],
            )

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            group = lambda r: (r[1]["_group"], r[1]["a_ids"])
            for batch in batches:
                blocks_met = batch.select(["_group", "_dim", "kind", "ids", "matrix", "a_kind", "a_ids", "a_matrix", "aim"]).to_pylist()
                anchors, found = batch.column(batch.schema.names.index("_anchors")), []
                # what a group of anchors finds in one block narrows what it asks of the next ones
                for _, members in groupby(sorted(enumerate(blocks_met), key=group), key=group):
                    aim = None
                    for i, r in members:
                        if aim is None:
                            aim, own, asking = Aim.read(r["aim"]), np.frombuffer(r["a_ids"], np.int64), unpacked(r["a_kind"], r["a_matrix"], r["_dim"])
                            own_leaves = leaves(_floats(asking), shape.leaf)
                        vectors, ids = unpacked(r["kind"], r["matrix"], r["_dim"]), np.frombuffer(r["ids"], np.int64)
                        best_here = list(search(asking, own, aim, vectors, ids, k, shape.leaf, own_leaves))
                        aim.met(best_here, k)
                        found += [(i, int(own[f[0]]), *f) for f in best_here]
                        if len(found) >= FOUND:
                            yield rows_of(anchors, found)
                            found = []
                if found:
                    yield rows_of(anchors, found)

        found = pairs.mapInArrow(score, f"_anchors {dict(aimed.dtypes)['_anchors']}, _row int, anchor_id long, _band int, _other long, score long, beyond string")
        rank = F.row_number().over(W.partitionBy("_anchors", "_row", "_band").orderBy(F.desc("score"), F.desc(F.coalesce("beyond", F.lit("1"))), "_other"))
        return found.withColumn("rank", rank).filter(F.col("rank") <= k)

    def aimed_at(rows: DataFrame, low, high, k: int) -> DataFrame:
        """Add ``aim, a_least, a_most`` to anchor blocks with ``seeds``, an array of nearby blocks; ``low`` and ``high`` give an anchor's bands before the seeds are seen."""

        def take_aim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                aims, least, most = [], [], []
                for r in batch.select([c for c in batch.schema.names if c != "_anchors"]).to_pylist():
                    ids, matrix = np.frombuffer(r["a_ids"], np.int64), unpacked(r["a_kind"], r["a_matrix"], r["_dim"])
                    known = r.get("known")
                    lows, highs = low(len(ids), known), high(len(ids), known)
                    seeds = [(np.frombuffer(s["ids"], np.int64), products(matrix, unpacked(s["kind"], s["matrix"], r["_dim"]))) for s in r["seeds"] or []]
                    for i in range(len(ids)):
                        for band, (x, y) in enumerate(zip(lows[i], highs[i])):
                            fits = [(scores[i], own, inside(scores[i], x, y) & (own != ids[i])) for own, scores in seeds]
                            if fits:
                                found = kth(np.concatenate([v[m] for v, _, m in fits]), np.concatenate([own[m] for _, own, m in fits]), k)
                                lows[i][band] = x if found is None else found
                    aim = Aim(lows, highs)
                    band = aim.of(np.arange(len(ids)))
                    aims.append(aim.written())
                    least.append(band[0])
                    most.append(band[1])
                names = ["_anchors", "_dim", "a_kind", "a_ids", "a_matrix", "a_centre", "a_radius"]
                yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(aims, pa.string()), pa.array(least, pa.float64()), pa.array(most, pa.float64())], [*names, "aim", "a_least", "a_most"])

        kinds = dict(rows.dtypes)
        columns = f"_anchors {kinds['_anchors']}, _dim int, a_kind string, a_ids binary, a_matrix binary, a_centre binary, a_radius double, aim string, a_least double, a_most double"
        return rows.mapInArrow(take_aim, columns)

    node = F.struct("kind", "ids", "matrix")
    of_label = blocks.groupBy(*ground).agg(F.min_by(node, F.struct("_cell", "_salt")).alias("seed"))
    seeded = anchors.join(of_label, ground, "left").withColumn("seeds", F.array_compact(F.array("seed"))).drop("seed")
    first = stage(aimed_at(seeded, lambda n, _: [[None] for _ in range(n)], lambda n, _: [[None] for _ in range(n)], positives), "negatives-aims")
    found = leaf_search(first, True, positives).select("_anchors", "_row", "anchor_id", F.col("rank").alias("_band"), F.col("_other").alias("positive_id"), "score", "beyond")
    found = stage(found, "negatives-positives")

    known = found.groupBy("_anchors").agg(F.collect_list(F.struct("_row", "_band", "score", "beyond")).alias("known"))
    # two blocks of different labels in the upper cell: one of them at least has another label than the anchors
    labels = of_label.groupBy("_dim", "_upper").agg(F.min_by(F.struct("_label", "seed"), "_label").alias("one"), F.max_by(F.struct("_label", "seed"), "_label").alias("two"))
    other = lambda c: F.when(F.col(f"{c}._label") != F.col("_label"), F.col(f"{c}.seed"))
    near = anchors.join(known, "_anchors").join(labels, ["_dim", "_upper"], "left").withColumn("seeds", F.array_compact(F.array(other("one"), other("two")))).drop("one", "two")

    def bands(n: int, known: list[dict], of) -> list[list]:
        out: list[list] = [[] for _ in range(n)]
        for r in sorted(known, key=lambda r: (r["_row"], r["_band"])):
            out[r["_row"]].append(of(restored(r["score"], r["beyond"])))
        return out

    second = stage(aimed_at(near, lambda n, known: bands(n, known, lambda p: -(-low_percent * p // 100)), lambda n, known: bands(n, known, lambda p: p), negatives), "negatives-aims")
    mined = leaf_search(second, False, negatives).select(
        "_anchors", "_row", (F.col("_band") + 1).alias("_band"), "rank", F.col("_other").alias("negative_id"), F.col("score").alias("negative_score")
    )
    pairs = found.select("_anchors", "_row", "_band", "anchor_id", "positive_id", F.col("score").alias("positive_score"))
    return pairs.join(mined, ["_anchors", "_row", "_band"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
