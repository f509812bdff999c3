import math
import random

import numpy as np

import tessera.llm.hard_negatives as module
from tessera.llm.exact_products import LONG, beyond, clipped, packed, products, restored, scaled, unpacked
from tessera.llm.hard_negatives import hard_negatives

SCHEMA = "vec_id long, label int, embedding array<double>, rank string, _id string"


SMALL = module.Shape(sample=128, upper=4, lower=3, block=32, anchor_block=4, leaf=8)


def brute(rows, every, positives=5, negatives=5, percent=80):
    whole = lambda x: int(x) * 256 if abs(x) > 2**53 else math.floor(256 * x)
    clean = {(i, c, tuple(map(whole, v))) for i, c, v in rows if i is not None and c is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    hold = lambda s: max(-LONG - 1, min(LONG, s))
    out = []
    for i, c, v in clean:
        if i % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), j, d) for j, d, w in clean if j != i and len(w) == len(v))
        for p, j in [(-s, j) for s, j, d in scored if d == c][:positives]:
            fits = [(-s, n) for s, n, d in scored if d != c and percent * p <= -100 * s <= 100 * p][:negatives]
            out += [(i, j, k, n, hold(p), hold(s)) for k, (s, n) in enumerate(fits, 1)]
    return sorted(out)


def run(spark, rows, every=10, shape=SMALL):
    df = spark.createDataFrame([(i, c, v, "r", "x") for i, c, v in rows], SCHEMA)
    return sorted(tuple(r) for r in hard_negatives(df, every=every, shape=shape).collect())


def test_matches_brute_force(spark):
    rng = random.Random(5)
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    rows = [(i, rng.randrange(4), [x + rng.gauss(0, 0.4) for x in rng.choice(centres)]) for i in range(400)]
    same = rows[10][2]
    rows += [(i, i % 3, same) for i in range(400, 460)]  # ties, in several labels
    rows += [(470, 1, None), (480, None, same), (490, 1, []), (None, 1, same), (500, 1, [math.nan] * 6), (501, 1, [math.inf] * 6), (502, 2, [1.0, None] * 3), (510, 2, [0.0] * 6)]
    rows += [rows[20], (30, 2, rows[31][2]), (520, 3, [1.0, 2.0]), (521, 1, [1.0, 1.9]), (523, 3, [1.0, 2.1]), (530, 7, [9.0, 9.0])]
    expected = brute(rows, 10)
    assert len(expected) > 500
    assert run(spark, rows) == expected


def test_scores_beyond_floats_and_longs(spark):
    near = [(i, i % 2, [float(2**22), i / 256]) for i in range(12)]
    assert run(spark, near) == brute(near, 10)
    huge = [(i, i % 2, [1e30 if i % 3 else -1e30, float(i), 1e305 if i == 7 else 1.0]) for i in range(24)]
    assert run(spark, huge) == brute(huge, 10)


def test_few_and_no_rows(spark):
    assert run(spark, []) == []
    assert run(spark, [(0, 1, [1.0])]) == []
    assert run(spark, [(0, 1, [1.0]), (1, 1, [1.0]), (2, 2, [1.0])]) == [(0, 1, 1, 2, 256 * 256, 256 * 256)]
    assert run(spark, [(0, 1, [1.0]), (1, 1, [-1.0]), (2, 2, [-1.0])]) == []  # a band below a negative score is empty


def test_intervals_hold_all_products():
    rng = np.random.default_rng(1)
    groups = [rng.normal(size=(20, 5)) * s + m for s, m in ((1, 0), (0.1, 3), (2, -1))]
    balls = [module.ball(g) for g in groups]
    lo, hi = module.intervals(np.stack([c for c, _ in balls]), np.array([r for _, r in balls]), np.stack([c for c, _ in balls]), np.array([r for _, r in balls]))
    for i, a in enumerate(groups):
        for j, b in enumerate(groups):
            p = a @ b.T
            assert lo[i, j] <= p.min() and p.max() <= hi[i, j]


def test_far_leaves_are_not_scored(monkeypatch):
    scored = []
    monkeypatch.setattr(module, "products", lambda a, b: scored.append(len(a) * len(b)) or products(a, b))
    rng = np.random.default_rng(2)
    points = np.concatenate([rng.integers(0, 10, (64, 4)) + 1000 * np.eye(4, dtype=int)[k % 4] * (1 + k // 4) for k in range(16)]).astype(float)
    aim = module.Aim([[15_000_000]] * 64, [[None]] * 64)
    list(module.search(points[-64:], np.arange(64), aim, points, np.arange(100, 100 + len(points)), 5))
    assert 0 < sum(scored) <= 64 * len(points) // 4


def test_integers_of_any_size():
    values = [0, 5, -5, LONG, LONG + 1, -LONG - 1, -LONG - 2, 10**30, -(10**30), 10**64 + 1, 10**64]
    keys = sorted(values, key=lambda v: (clipped(v), beyond(v) or "1"))
    assert keys == sorted(values) and [restored(clipped(v), beyond(v)) for v in values] == values
    a, b = np.array([[2.0**22, 3.0]]), np.array([[2.0**38, 1.0], [2.0**38, 2.0]])
    assert products(a, b).tolist() == [[2**60 + 3, 2**60 + 6]]
    big = scaled(np.array([[1e30, -1.5, 1e308]]), 256)
    assert big.tolist() == [[int(1e30) * 256, -384, int(1e308) * 256]]
    assert unpacked(*packed(big), 3).tolist() == big.tolist()


def brute_bands(anchors, anchor_ids, low, high, vectors, ids, k):
    out = []
    for row, (a, own) in enumerate(zip(anchors.tolist(), anchor_ids.tolist())):
        scored = [(sum(int(x) * int(y) for x, y in zip(a, v)), i) for v, i in zip(vectors.tolist(), ids.tolist()) if i != own]
        for band, (x, y) in enumerate(zip(low[row], high[row])):
            fits = [(s, i) for s, i in scored if (x is None or s >= x) and (y is None or s <= y)]
            out += [(row, band, i, s) for s, i in sorted(fits, key=lambda r: (-r[0], r[1]))[:k]]
    return sorted(out)


def made_bands(seed, scale=1):
    """Anchors with no band, with open ones and with several, vectors with ties and repeated ids."""
    rng = np.random.default_rng(seed)
    anchors, vectors = np.floor(rng.normal(0, 9, (70, 5))) * scale, np.floor(rng.normal(0, 9, (300, 5))) * scale
    ends = [[sorted(rng.integers(-400, 700, 2).tolist()) for _ in range(rng.integers(0, 4))] for _ in range(70)]
    low = [[int(x) * int(scale) ** 2 if x % 7 else None for x, _ in bands] for bands in ends]
    high = [[int(y) * int(scale) ** 2 if y % 5 else None for _, y in bands] for bands in ends]
    return anchors, np.arange(70), low, high, vectors, np.concatenate([np.arange(280), np.arange(20)])


def test_search_matches_brute_force_in_all_bands():
    for seed, scale in ((1, 1), (2, 2.0**20), (3, 2.0**25), (4, 2.0**40)):  # float64, then int64, then Python integers
        anchors, anchor_ids, low, high, vectors, ids = made_bands(seed, scale)
        aim = module.Aim([list(x) for x in low], [list(x) for x in high])
        assert sorted(module.search(anchors, anchor_ids, aim, vectors, ids, 4, 16)) == brute_bands(anchors, anchor_ids, low, high, vectors, ids, 4)


def test_bands_beyond_the_scores_of_a_block():
    far = [[2**53 + 1, 10**300, None], [-(10**300), -(2**70), 6]]
    aim = module.Aim([[far[0][0], None, -(10**300)]], [[far[0][1], -(2**70), 2**70]])
    assert sorted(module.search(np.array([[2.0]]), np.array([0]), aim, np.array([[3.0], [4.0]]), np.array([1, 2]), 5)) == [(0, 2, 1, 6), (0, 2, 2, 8)]


def test_what_blocks_have_given_narrows_what_the_next_ones_are_asked():
    for seed, scale in ((5, 1), (6, 2.0**40)):
        anchors, anchor_ids, low, high, vectors, ids = made_bands(seed, scale)
        aim, found, apart = module.Aim([list(x) for x in low], [list(x) for x in high]), [], 0
        for part in range(0, 300, 50):
            block = slice(part, part + 50)
            apart += len(brute_bands(anchors, anchor_ids, low, high, vectors[block], ids[block], 3))
            here = list(module.search(anchors, anchor_ids, aim, vectors[block], ids[block], 3, 16))
            aim.met(here, 3)
            found += here
        best = {}
        for row, band, i, score in found:
            best.setdefault((row, band), []).append((-score, i))
        kept = sorted((row, band, i, -s) for (row, band), rows in best.items() for s, i in sorted(rows)[:3])
        assert kept == brute_bands(anchors, anchor_ids, low, high, vectors, ids, 3)
        assert len(found) < 0.7 * apart


def test_scores_meet_bands_by_group_and_not_by_anchor(monkeypatch):
    calls, inside = [], module.inside
    monkeypatch.setattr(module, "inside", lambda *a: calls.append(1) or inside(*a))
    rng = np.random.default_rng(3)
    anchors, vectors = np.floor(rng.normal(0, 9, (64, 4))), np.floor(rng.normal(0, 9, (200, 4)))
    list(module.search(anchors, np.arange(64), module.Aim([[0, 10]] * 64, [[50, 60]] * 64), vectors, np.arange(100, 300), 5))
    assert 0 < len(calls) <= 3


def test_rows_of_a_batch_are_packed_by_themselves(spark):
    rows = [(1, 1, [1.0, 2.0]), (2, 1, [1e308, 1.0]), (1, 1, [1.0, 2.0]), (3, 1, [3.0]), (4, 2, None), (5, None, [1.0]), (6, 1, []), (7, 1, [float("nan")]), (8, 1, [float("-inf")]), (9, 1, [1.0, None])]
    df = spark.createDataFrame(rows, "vec_id long, label long, embedding array<double>").coalesce(1)
    got = sorted((r._id, r._dim, r._kind, unpacked(r._kind, r._row, r._dim).tolist()) for r in module._clean(df, 256, "vec_id", "label", "embedding").collect())
    assert got == [(1, 2, "<i2", [[256, 512]]), (2, 2, "o", [[int(1e308) * 256, 256]]), (3, 1, "<i2", [[768]])]


def test_rows_packed_apart_are_one_matrix():
    rows = [packed(np.array(x)) for x in ([1.0, 2.0], [2.0**20, 3.0], [2.0**40, 5.0])] + [packed(np.array([2**80, 1], dtype=object))]
    for some in ([0], [0, 0], [0, 1, 2], [3, 3], [2, 3, 0]):
        expected = [[int(x) for x in unpacked(*rows[i], 2)[0]] for i in some]
        assert module.unpacked_rows([rows[i][0] for i in some], [rows[i][1] for i in some], 2).tolist() == expected
