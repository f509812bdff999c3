"""Random forests of all folds, grown side by side: one job a level, whatever the number of folds, shapes and trees.

What the shapes of ``models.choose_forest`` share is done once:

* trees are grown by levels from the same draws, so the forest of a smaller depth is the top of that of the largest;
* trees with another least leaf differ only below the first node where that leaf rules a split out: a node with the same splits above it takes the counts of the leaf before.

Training rows that no tree can tell apart (same fold, bins and target) are one row with a number of copies: what a tree draws of ``k`` copies is a Poisson number of mean ``k``, which is what ``k`` draws
of mean one add up to.  So the work grows with the distinct rows.  They lie in blocks, several to a fold.  At each level a task adds up counts and targets of its block by tree, node, feature and
bin; those meet by fold and tree, where the best splits are found.  Thresholds are ``BINS`` quantiles of the fold's training part, exact ones, looked up in values that are counted once for all
folds; each node sees a root of the features, each tree draws rows with replacement (from a hash of bins and target, so that reruns agree); leaves count drawn rows.

The driver gets the nodes: folds x leaves x trees x 2 ** depth of them, and never rows.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tessera.config import PanelConfig
from tessera.operators.folds import Fold, segments
from tessera.operators.order import values_at_ranks
from tessera.operators.ridge_cube import counted_values, middle, refuse_lacking
from tessera.sources.staging import stage

BINS = 32
#: Rows of a block, about: blocks are dealt by hash.
BLOCK = 1 << 19
#: Trees that meet in one group, to have fewer calls of Python.
GROVE = 8
#: Rows that numpy takes at once, so that they stay in a core's cache.
SLICE = 1 << 13
#: Number of draws of a row by 16 random bits.
DRAWN = np.searchsorted(np.cumsum([math.exp(-1) / math.factorial(k) for k in range(8)]), (np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.uint8)
#: Bins in one long.
PACKED = 12


@functools.lru_cache(None)
def drawn_of(power: int) -> np.ndarray:
    """Number of draws of ``2 ** power`` copies by 16 random bits: a Poisson number's quantiles."""
    if not power:
        return DRAWN
    mean = 1 << power
    reach = 10 * math.isqrt(mean) + 10
    k = np.arange(max(0, mean - reach), mean + reach)
    logs = np.concatenate([[0.0], np.log(mean / k[1:]).cumsum()])
    chance = np.exp(logs - logs.max())
    return k[0] + np.searchsorted(chance.cumsum() / chance.sum(), (np.arange(1 << 16) + 0.5) / (1 << 16)).clip(max=len(k) - 1)


def _mixed(rows: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """16 random bits of each row for each of the four trees that ``tree`` is one of: ``rows, 4``."""
    constant = np.uint64((seed * 0x9E3779B97F4A7C15 + (tree // 4) * 0xD1B54A32D192ED03) % (1 << 64))
    z = rows + constant
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (z ^ (z >> np.uint64(31))).astype("<u8").view("<u2").reshape(-1, 4)


def _by_power(rows: np.ndarray, copies: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """The powers of two that the numbers of copies add up from: which rows have each, and their hashes for it."""
    out = []
    for power in range(int(copies.max(initial=0)).bit_length()):
        at = np.flatnonzero(copies >> power & 1)
        if len(at):
            out.append((power, at, rows[at] + np.uint64(power * 0xA24BAED4963EE407 % (1 << 64))))
    return out


def _draws(rows: np.ndarray, copies: np.ndarray, trees: Sequence[int], seed: int) -> Iterator[np.ndarray]:
    """How often each of ``trees`` draws the copies of each row."""
    powers, four, mixed = _by_power(rows, copies), None, []
    for tree in trees:
        if tree // 4 != four:
            four, mixed = tree // 4, [_mixed(hashes, tree, seed) for _, _, hashes in powers]
        times = np.zeros(len(rows))
        for (power, at, _), bits in zip(powers, mixed):
            found = drawn_of(power).take(bits[:, tree % 4])
            if len(at) == len(rows):
                times += found
            else:
                times[at] += found
        yield times


def draws(rows: np.ndarray, tree: int, seed: int, copies: np.ndarray | None = None) -> np.ndarray:
    """How often a tree draws each row, told by the row's hash: a Poisson number of mean ``copies`` (one)."""
    return next(_draws(rows, np.ones(len(rows), np.int64) if copies is None else copies, [tree], seed))


def descend(bins: np.ndarray, feature: np.ndarray, edge: np.ndarray, depth: int):
    """The node of each row at every depth; a row stays where the tree ends.  ``bins`` has a row for each row; children of node k are 2 k + 1 and 2 k + 2."""
    flat, base = bins.reshape(-1), np.arange(0, bins.size, bins.shape[1], dtype=np.int32)
    node = np.zeros(len(bins), np.int32)
    yield node
    for _ in range(depth):
        f = feature[node]
        below = 2 * node + 1 + (flat[base + np.maximum(f, 0)] > edge[node])
        node = np.where(f >= 0, below, node)
        yield node


def _places(flat: np.ndarray, base: np.ndarray, feature: np.ndarray, edge: np.ndarray, depth: int) -> Iterator[np.ndarray]:
    """Each row's place within every level, to be used before the next: a row keeps to the left below the end of its tree.  ``base`` tells where a row's bins begin in ``flat``."""
    at = np.zeros(len(base), np.intp)
    yield at
    asked, last = np.maximum(feature, 0).astype(np.intp), np.where(feature < 0, 255, edge).astype(np.uint8)
    for level in range(depth):
        here = slice((1 << level) - 1, (2 << level) - 1)
        where = asked[here].take(at)
        where += base
        right = flat.take(where) > last[here].take(at)
        at <<= 1
        at += right
        yield at


def grove_counts(bins, y, rows, copies, level, feature, edge, asked, same, trees, seed):
    """Draws and drawn targets of a block for each of ``trees``, by node, asked feature and bin, for each leaf whose nodes are not all as those of the leaf before: ``leaves, features, nodes x bins``.

    Rows below the end of a tree are counted where nothing is read.
    """
    nodes, first = 1 << level, (1 << level) - 1
    width, held = nodes * BINS, range(len(trees))
    own = [[i for i in range(len(feature)) if not same[i, k].all()] for k in held]
    found = [np.zeros((2, len(own[k]), asked.shape[2], width)) for k in held]
    asks = asked[:, first : first + nodes].astype(np.intp)
    for start in range(0, len(y), SLICE):
        part = slice(start, start + SLICE)
        flat, target = bins[part].reshape(-1), y[part]
        for k, times in enumerate(_draws(rows[part], copies[part], trees, seed)):
            drawn = np.flatnonzero(times > 0)
            times, base = times.take(drawn), drawn * bins.shape[1]
            weighted = target.take(drawn) * times
            places = None
            for i, leaf in enumerate(own[k]):
                if places is None:
                    *_, places = _places(flat, base, feature[leaf, k], edge[leaf, k], level)
                    at, begin, n, s = places, base, times, weighted
                else:
                    # rows in nodes of the leaf before that are the same for this leaf are counted already
                    other = np.flatnonzero(~same[leaf, k].take(places))
                    begin, n, s = base.take(other), times.take(other), weighted.take(other)
                    *_, at = _places(flat, begin, feature[leaf, k], edge[leaf, k], level)
                    places[other] = at
                row = at * BINS
                for j in range(asks.shape[2]):
                    where = asks[k, :, j].take(at)
                    where += begin
                    key = row + flat.take(where)
                    found[k][0, i, j] += np.bincount(key, n, width)
                    found[k][1, i, j] += np.bincount(key, s, width)
    return found


def level_counts(bins, y, rows, level, feature, edge, asked, same, tree, seed, copies=None):
    """``grove_counts`` of one tree: draws and drawn targets."""
    copies = np.ones(len(y), np.int64) if copies is None else copies
    return grove_counts(bins, y, rows, copies, level, feature[:, None], edge[:, None], asked[None], same[:, None], [tree], seed)[0]


def best_splits(counts, sums, leaves, same, asked):
    """For each leaf and node of a level: feature (-1: none), bin of the last row to the left, and means of the node and both sides."""
    features, edges = np.full(same.shape, -1, np.int8), np.zeros(same.shape, np.uint8)
    means = np.full((*same.shape, 3), np.nan)
    own, n, s = 0, None, None
    for i, leaf in enumerate(leaves):
        if not same[i].all():
            shape = (asked.shape[1], same.shape[1], BINS)
            n, s = (x[own].reshape(shape) if n is None else np.where(same[i][None, :, None], old, x[own].reshape(shape)) for x, old in ((counts, n), (sums, s)))
            own += 1
        left, left_sum = n.cumsum(-1)[..., :-1], s.cumsum(-1)[..., :-1]
        whole, whole_sum = n.sum(-1, keepdims=True), s.sum(-1, keepdims=True)
        right, right_sum = whole - left, whole_sum - left_sum
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = left_sum**2 / left + right_sum**2 / right - whole_sum**2 / whole
            gain = np.where((left >= leaf) & (right >= leaf), gain, -np.inf).transpose(1, 0, 2).reshape(same.shape[1], -1)
            found = gain.argmax(1)
            node = np.arange(same.shape[1])
            j, edge = np.divmod(found, BINS - 1)
            split = gain[node, found] > 1e-12 * np.abs(whole_sum[0, :, 0])
            means[i, :, 0] = whole_sum[0, :, 0] / whole[0, :, 0]
            means[i, :, 1] = left_sum[j, node, edge] / left[j, node, edge]
            means[i, :, 2] = right_sum[j, node, edge] / right[j, node, edge]
        features[i] = np.where(split, asked[node, j], -1)
        edges[i] = np.where(split, edge, 0)
    return features, edges, means


def closed(feature: np.ndarray, edge: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Trees in which the leftmost nodes below an end are ends with its value, so that a row may go on to the left; and whether all on the way to a place of the last level is as for the leaf before."""
    feature, edge, value = feature.copy(), edge.copy(), value.copy()
    inner = feature.shape[-1] // 2
    alike = np.zeros(feature.shape, bool)
    alike[1:, :, 0] = value[1:, :, 0] == value[:-1, :, 0]
    for node in range(inner):
        left, end = 2 * node + 1, feature[..., node] < 0
        feature[..., left] = np.where(end, -1, feature[..., left])
        value[..., left] = np.where(end, value[..., node], value[..., left])
        split = alike[1:, :, node] & (feature[1:, :, node] == feature[:-1, :, node]) & (end[1:] | (edge[1:, :, node] == edge[:-1, :, node]))
        alike[1:, :, left] = split & (value[1:, :, left] == value[:-1, :, left])
        alike[1:, :, left + 1] = split & (end[1:] | (value[1:, :, left + 1] == value[:-1, :, left + 1]))  # no row comes to the right below an end
    return feature, edge, value, alike[:, :, inner:]


def _answers(bins, feature, edge, value, alike, depths) -> np.ndarray:
    """Mean over closed trees of what each leaf and depth answers: ``leaves, depths, rows``.  A row goes through a tree once for leaves that do not differ on its way."""
    out = np.zeros((len(feature), len(depths), len(bins)))
    for start in range(0, len(bins), SLICE):
        part = bins[start : start + SLICE]
        flat, base = part.reshape(-1), np.arange(0, part.size, part.shape[1], dtype=np.intp)

        def answered(leaf, tree, base):
            found = np.empty((len(depths), len(base)))
            for depth, at in enumerate(_places(flat, base, feature[leaf, tree], edge[leaf, tree], max(depths))):
                if depth in depths:
                    found[depths.index(depth)] = value[leaf, tree, (1 << depth) - 1 : (2 << depth) - 1].take(at)
            return found, at

        for tree in range(feature.shape[1]):
            found, at = answered(0, tree, base)
            out[0, :, start : start + SLICE] += found
            for leaf in range(1, len(feature)):
                other = np.flatnonzero(~alike[leaf, tree].take(at))
                if len(other):
                    found[:, other], at[other] = answered(leaf, tree, base.take(other))
                out[leaf, :, start : start + SLICE] += found
    return out / feature.shape[1]


def _packed(bins: np.ndarray) -> list[np.ndarray]:
    """A row's bins in as few longs as hold them."""
    return [sum(bins[:, i].astype(np.int64) << 5 * (i % PACKED) for i in range(k, min(k + PACKED, bins.shape[1]))) for k in range(0, bins.shape[1], PACKED)]


def _unpacked(batch: pd.DataFrame, width: int) -> np.ndarray:
    return np.ascontiguousarray(np.column_stack([batch[f"_c{i // PACKED}"].to_numpy() >> 5 * (i % PACKED) & (BINS - 1) for i in range(width)]).astype(np.uint8))


def learnt_edges(rows: DataFrame, effects: DataFrame, folds: Sequence[Fold], sizes: dict[int, int], names: Sequence[str], features: Sequence[str]) -> tuple[dict, dict]:
    """Each fold's medians of the features in its training part, and the thresholds of the filled features and of the entity's effect: by fold, a list for each.

    ``effects`` has ``fold, _effect, _n``.  Values are counted once by segment; with ``k`` missing, the ranks of filled values are those of present ones up to the median, ``k`` times it, and the rest.
    """
    _, members = segments(folds)
    by_effect = effects.groupBy(F.lit(len(names)).alias("indicator"), F.col("fold").alias("part"), F.col("_effect").alias("value")).agg(F.sum("_n").alias("n"))
    counted = counted_values(rows, folds, names).union(by_effect) if names else by_effect
    ranks = {f: [max(-(-n * i // BINS) - 1, 0) for i in range(1, BINS)] for f, n in sizes.items()}  # the least values that i / BINS of the rows reach
    places: dict[tuple[int, int], tuple[int, int, list]] = {}

    def asked(counts):
        wanted = {}
        for f, n in sizes.items():
            for i in range(len(names)):
                m = sum(counts.get((i, s), 0) for s in members[f])
                if m:
                    low, high = middle(m)
                    places[f, i] = low, high, [r if r <= low else None if r <= low + n - m else r - n + m for r in ranks[f]]
                    wanted[f, i] = i, members[f], [low, high, *[r for r in places[f, i][2] if r is not None]]
            wanted[f, len(names)] = len(names), [f], ranks[f]
        return wanted

    found = values_at_ranks(counted, asked)
    medians, edges = {f: {} for f in sizes}, {f: [] for f in sizes}
    for (f, i), (low, high, _) in places.items():
        medians[f][features[i]] = 0.5 * found[f, i][low] + 0.5 * found[f, i][high]
    refuse_lacking(medians, features)
    for f in sizes:
        for i, name in enumerate(features):
            edges[f].append(np.array([medians[f][name] if r is None else found[f, i][r] for r in places[f, i][2]]))
        edges[f].append(np.array([found[f, len(names)][r] for r in ranks[f]]))
    return {f: [medians[f][name] for name in features] for f in sizes}, edges


def all_folds(
    panel: DataFrame, folds: Sequence[Fold], features: Sequence[str], depths: Sequence[int] = (5, 6, 7), leaves: Sequence[int] = (5, 8, 12), trees: int = 200, seed: int = 42,
    config: PanelConfig = PanelConfig(), strength: float = 5.0,
) -> tuple[DataFrame, dict[int, tuple[int, int]]]:
    """``fold, <keys>, y_true, y_pred`` of test rows with a target, and each fold's depth and leaf: those of least validation error, the first of equals (depths first).

    Forests see the features, filled with the fold's training medians, and the entity's shrunken mean in the fold's training part.
    """
    spark, depths, leaves, most = panel.sparkSession, list(depths), list(leaves), max(depths)
    number = lambda f: F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double"))
    names = [f"_x{i}" for i in range(len(features))]
    rows = stage(
        panel.filter(F.col(config.target).isNotNull()).select(
            F.col(config.entity).alias("_entity"), F.col(config.period).alias("_period"), F.col(config.target).cast("double").alias("_y"), *[number(f).alias(n) for f, n in zip(features, names)]
        ),
        "forest-panel",
    )
    inside = lambda f, split: F.col("_period").between(getattr(f, f"{split}_start"), getattr(f, f"{split}_end"))
    either = lambda *splits: functools.reduce(lambda a, b: a | b, [inside(f, s) for f in folds for s in splits])
    whole = rows.agg(*[F.count_if(inside(f, "train")).alias(f"n{f.fold}") for f in folds], *[F.avg(F.when(inside(f, "train"), F.col("_y"))).alias(f"m{f.fold}") for f in folds]).first()
    if features:
        refuse_lacking({f.fold: {} if not whole[f"n{f.fold}"] else dict.fromkeys(features) for f in folds}, features)
    folds = [f for f in folds if whole[f"n{f.fold}"]]
    sizes, centres = {f.fold: whole[f"n{f.fold}"] for f in folds}, {f.fold: whole[f"m{f.fold}"] for f in folds}

    sums = [F.sum(F.when(inside(f, "train"), F.col("_y"))) for f in folds]
    entities = stage(
        rows.filter(either("train")).groupBy("_entity").agg(F.array(*sums).alias("_sums"), F.array(*[F.count_if(inside(f, "train")) for f in folds]).alias("_counts")), "forest-entities"
    )
    effect = lambda i, f: F.when(
        F.col("_entity").isNotNull() & (F.get("_counts", F.lit(i)) > 0), (F.get("_sums", F.lit(i)) + F.lit(strength * centres[f.fold])) / (F.get("_counts", F.lit(i)) + F.lit(strength))
    ).otherwise(F.lit(centres[f.fold]))
    listed = F.array(*[F.struct(F.lit(f.fold).alias("fold"), effect(i, f).alias("_effect"), F.get("_counts", F.lit(i)).alias("_n")) for i, f in enumerate(folds)])
    medians, edges = learnt_edges(rows, entities.select(F.inline(listed)).filter("_n > 0"), folds, sizes, names, features)

    width, order = len(names) + 1, [f.fold for f in folds]
    unknown = bytes(int(np.searchsorted(edges[f][-1], centres[f])) for f in order)

    def effect_bins(batches):
        for batch in batches:
            found = np.stack(batch["_effects"].to_numpy()).reshape(len(batch), -1)
            bins = np.column_stack([np.searchsorted(edges[f][-1], found[:, i]) for i, f in enumerate(order)]).astype(np.uint8)
            yield pd.DataFrame({"_entity": batch["_entity"], "_bins": [b.tobytes() for b in bins]})

    kind = panel.schema[config.entity].dataType.simpleString()
    known = entities.filter("_entity IS NOT NULL").select("_entity", F.array(*[effect(i, f) for i, f in enumerate(folds)]).alias("_effects")).mapInPandas(effect_bins, f"_entity {kind}, _bins binary")

    def binned(batch: pd.DataFrame, splits: Sequence[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Fold, number of the split, rows and their bins."""
        period, values = batch["_period"].to_numpy(), [batch[n].to_numpy(float) for n in names]
        effects = np.frombuffer(b"".join(unknown if b is None else b for b in batch["_bins"]), np.uint8).reshape(len(batch), -1)
        for i, f in enumerate(folds):
            for k, split in enumerate(splits):
                at = np.flatnonzero((period >= getattr(f, f"{split}_start")) & (period <= getattr(f, f"{split}_end")))
                if len(at):
                    bins = np.empty((len(at), width), np.uint8)
                    for j, x in enumerate(values):
                        held = x[at]
                        bins[:, j] = np.searchsorted(edges[f.fold][j], np.where(np.isnan(held), medians[f.fold][j], held))
                    bins[:, -1] = effects[at, i]
                    yield f.fold, k, at, bins

    def coded(batches):
        for batch in batches:
            found = list(binned(batch, ("train", "val")))
            if found:
                codes = _packed(np.concatenate([bins for *_, bins in found]))
                many = [len(at) for _, _, at, _ in found]
                yield pd.DataFrame(
                    {"fold": np.repeat([f for f, *_ in found], many), "val": np.repeat([k for _, k, _, _ in found], many)} | {f"_c{i}": c for i, c in enumerate(codes)}
                    | {"_y": batch["_y"].to_numpy()[np.concatenate([at for _, _, at, _ in found])]}
                )

    codes = [f"_c{i}" for i in range(-(-width // PACKED))]
    inputs = ["_entity", "_period", "_y", *names]
    # as many tasks as Python can use, however few bytes they read
    parallel = spark.sparkContext.defaultParallelism
    wide = 4 * parallel
    of_splits = lambda *splits: rows.filter(either(*splits)).select(*inputs).repartition(wide, "_entity").join(known.repartition(wide, "_entity"), "_entity", "left")
    single = of_splits("train", "val").select("_period", "_y", *names, "_bins").mapInPandas(coded, "fold int, val int, " + "".join(f"{c} long, " for c in codes) + "_y double")
    distinct = stage(single.groupBy("fold", "val", *codes, "_y").agg(F.count(F.lit(1)).alias("_copies")), "forest-distinct")
    train = distinct.filter("val = 0")
    chunks = {r["fold"]: -(-r["count"] // BLOCK) for r in train.groupBy("fold").count().collect()}  # a row for each fold

    def block(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["_copies", "_row", "_y"], kind="stable")  # few sorts of numbers of copies in each slice
        fold, chunk = int(group["fold"].iloc[0]), int(group["_chunk"].iloc[0])
        held = {"bins": _unpacked(group, width), "y": group["_y"].to_numpy(float) - centres[fold], "rows": group["_row"].to_numpy(np.int64), "copies": group["_copies"].to_numpy(np.int64)}
        return pd.DataFrame({"fold": [fold], "chunk": [chunk]} | {k: [v.tobytes()] for k, v in held.items()})

    of_fold = F.broadcast(spark.createDataFrame([(f, chunks[f], centres[f]) for f in sizes], "fold int, _chunks int, _centre double"))
    hashed = train.withColumn("_row", F.xxhash64(*codes, "_y")).join(of_fold, "fold").withColumn("_chunk", F.pmod(F.xxhash64("_row"), F.col("_chunks")).cast("int"))
    fields = "fold int, chunk int, bins binary, y binary, rows binary, copies binary"
    blocks = stage(hashed.select("fold", "_chunk", "_row", *codes, "_y", "_copies").groupBy("fold", "_chunk").applyInPandas(block, fields), "forest-blocks")
    # few blocks are read by several tasks, each for some of the trees
    groves = -(-trees // GROVE)
    parts = max(1, min(groves, -(-8 * parallel // sum(chunks.values()))))
    tasks = blocks.select("*", F.explode(F.array(*[F.lit(i) for i in range(parts)])).alias("part")).repartition(parts * sum(chunks.values()))

    asked = np.random.default_rng(seed).random((trees, (1 << most) - 1, width)).argsort(-1)[..., : math.ceil(math.sqrt(width))].astype(np.int8)
    grown = (len(leaves), trees, (1 << most + 1) - 1)
    feature, edge, value = {f: np.full(grown, -1, np.int8) for f in sizes}, {f: np.zeros(grown, np.uint8) for f in sizes}, {f: np.full(grown, np.nan) for f in sizes}
    same = {f: np.repeat(np.arange(len(leaves)) > 0, trees).reshape(len(leaves), trees, 1) for f in sizes}
    for level in range(most):
        first, nodes = (1 << level) - 1, 1 << level
        state = spark.sparkContext.broadcast((feature, edge, same, asked))

        def counted(batches):
            feature, edge, same, asked = state.value
            for batch in batches:
                for r in batch.itertuples():
                    bins, y = np.frombuffer(r.bins, np.uint8).reshape(-1, width), np.frombuffer(r.y)
                    hashes, copies = np.frombuffer(r.rows, np.uint64), np.frombuffer(r.copies, np.int64)
                    for grove in range(r.part, groves, parts):
                        held = range(grove * GROVE, min((grove + 1) * GROVE, trees))
                        of = slice(held.start, held.stop)
                        found = grove_counts(bins, y, hashes, copies, level, feature[r.fold][:, of], edge[r.fold][:, of], asked[of], same[r.fold][:, of], held, seed)
                        yield pd.DataFrame({"fold": r.fold, "grove": grove, "tree": held, "chunk": r.chunk, "n": [n.astype(np.int64).tobytes() for n, _ in found], "s": [s.tobytes() for _, s in found]})

        def split(group: pd.DataFrame) -> pd.DataFrame:
            _, _, same, asked = state.value
            fold, shape, out = int(group["fold"].iloc[0]), (-1, asked.shape[2], nodes * BINS), []
            for t, blocks in group.sort_values("chunk").groupby("tree"):
                n, s = sum(np.frombuffer(x, np.int64).astype(float) for x in blocks["n"]).reshape(shape), sum(np.frombuffer(x) for x in blocks["s"]).reshape(shape)
                out.append((fold, t, *[x.tobytes() for x in best_splits(n, s, leaves, same[fold][:, t], asked[t, first : first + nodes])]))
            return pd.DataFrame(out, columns=["fold", "tree", "feature", "edge", "means"])

        added = tasks.mapInPandas(counted, "fold int, grove int, tree int, chunk int, n binary, s binary").repartition(2 * parallel, "fold", "grove")
        found = added.groupBy("fold", "grove").applyInPandas(split, "fold int, tree int, feature binary, edge binary, means binary")
        at = slice(first, first + nodes)
        for r in found.collect():  # a row for each fold and tree
            shape, f, t = (len(leaves), nodes), r["fold"], r["tree"]
            feature[f][:, t, at], edge[f][:, t, at] = np.frombuffer(r["feature"], np.int8).reshape(shape), np.frombuffer(r["edge"], np.uint8).reshape(shape)
            means = np.frombuffer(r["means"]).reshape(*shape, 3) + centres[f]
            if not level:
                value[f][:, t, 0] = means[:, 0, 0]
            value[f][:, t, 2 * first + 1 : 2 * first + 1 + 2 * nodes] = means[:, :, 1:].reshape(len(leaves), -1)
        for f in sizes:
            alike = same[f].copy()
            # no row comes below a node without a split, whatever is written there
            alike[1:] &= (feature[f][1:, :, at] < 0) | (feature[f][1:, :, at] == feature[f][:-1, :, at]) & (edge[f][1:, :, at] == edge[f][:-1, :, at])
            same[f] = alike.repeat(2, axis=2)
        state.unpersist()

    forests = spark.sparkContext.broadcast({f: closed(feature[f], edge[f], value[f]) for f in sizes})

    def errors(batches):
        for batch in batches:
            bins = _unpacked(batch, width)
            for fold, at in batch.groupby("fold").indices.items():
                n, total, square = (batch[c].to_numpy()[at] for c in ("_n", "_sum", "_square"))
                for leaf, answers in zip(leaves, _answers(bins[at], *forests.value[fold], depths) - centres[fold]):
                    yield pd.DataFrame({"fold": fold, "depth": depths, "leaf": leaf, "n": n.sum(), "sse": (answers**2 * n - 2 * answers * total + square).sum(1)})

    apart = F.col("_y") - F.col("_centre")
    validation = distinct.filter("val = 1").join(of_fold, "fold").groupBy("fold", *codes).agg(
        F.sum("_copies").alias("_n"), F.sum(apart * F.col("_copies")).alias("_sum"), F.sum(apart**2 * F.col("_copies")).alias("_square")
    )
    missed = validation.repartition(wide, "fold", *codes).mapInPandas(errors, "fold int, depth int, leaf int, n long, sse double").groupBy("fold", "depth", "leaf").agg((F.sum("sse") / F.sum("n")).alias("mse"))
    mse = {(r["fold"], r["depth"], r["leaf"]): r["mse"] for r in missed.collect()}  # a row for each fold and shape
    chosen = {f: min(((d, n) for d in depths for n in leaves), key=lambda shape: mse.get((f, *shape), 0.0)) for f in sizes}

    def placed(batches):
        for batch in batches:
            for fold, _, at, bins in binned(batch, ["test"]):
                held = batch.iloc[at]
                yield pd.DataFrame({"fold": fold, "_entity": held["_entity"], "_period": held["_period"], "_y": held["_y"]} | dict(zip(codes, _packed(bins))))

    def forecast(batches):
        for batch in batches:
            bins, out = _unpacked(batch, width), np.empty(len(batch))
            for fold, at in batch.groupby("fold").indices.items():
                depth, leaf = chosen[fold]
                i = leaves.index(leaf)
                out[at] = _answers(bins[at], *[x[i : i + 1] for x in forests.value[fold]], [depth])[0, 0]
            yield batch.assign(y_pred=out)

    # rows with the same bins are answered once
    longs = "".join(f", {c} long" for c in codes)
    test = stage(of_splits("test").mapInPandas(placed, f"fold int, _entity {kind}, _period {panel.schema[config.period].dataType.simpleString()}, _y double{longs}"), "forest-test")
    answers = test.select("fold", *codes).distinct().repartition(wide, "fold", *codes).mapInPandas(forecast, f"fold int{longs}, y_pred double")
    predictions = test.join(answers, ["fold", *codes]).select("fold", F.col("_entity").alias(config.entity), F.col("_period").alias(config.period), F.col("_y").alias("y_true"), "y_pred")
    return predictions, chosen
