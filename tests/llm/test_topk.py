import math
import random

from tessera.llm.topk import exact_top_k


def brute(rows, k, every):
    clean = {(i, tuple(math.floor(256 * x) for x in v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q in {i for i, _ in clean if i % every == 0}:
        best = {}
        for i, a in clean:
            for j, b in clean:
                if i == q and j != q and len(a) == len(b):
                    score = sum(x * y for x, y in zip(a, b))
                    best[j] = max(best.get(j, score), score)
        ranked = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k]
        out += [(q, n, j, s) for n, (j, s) in enumerate(ranked, 1)]
    return sorted(out)


def run(spark, rows, k=5, every=10, kind="float"):
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], f"vec_id long, embedding array<{kind}>, rank int")
    return sorted(tuple(r) for r in exact_top_k(df, k, every).collect())


def test_matches_brute_force(spark, monkeypatch):
    import tessera.llm.topk as topk

    monkeypatch.setattr(topk, "BLOCK", 16)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 4)
    rng = random.Random(3)
    sixteenths = lambda n: [rng.randrange(-32, 33) / 16 for _ in range(n)]
    rows = [(i, [x * rng.choice([0.25, 1, 4]) for x in sixteenths(8)]) for i in range(150)]
    same = sixteenths(8)
    rows += [(i, same) for i in range(150, 200)]
    rows += [(200, None), (201, [1.0, None]), (210, [float("nan")] * 8), (202, [float("inf")] * 8), (None, same), (220, []), (0, rows[0][1]), (230, [0.0] * 8), (3, rows[3][1])]
    rows += [(240, [1.0, 2.0]), (241, [1.0, -2.0])]
    assert run(spark, rows) == brute(rows, 5, 10)


def test_an_id_with_many_vectors_takes_one_rank(spark):
    rows = [(0, [1.0, 0.0])] + [(1, [100.0 + i, 0.0]) for i in range(8)] + [(i, [float(i), 1.0]) for i in range(2, 10)]
    expected = brute(rows, 5, 10)
    assert len(expected) == 5
    assert run(spark, rows) == expected


def test_least_length_bounds_what_can_reach_a_threshold():
    import numpy as np

    from tessera.llm.topk import least_length

    queries = np.array([[3.0, 4.0], [0.0, 2.0]])
    assert abs(least_length(queries, np.array([50.0, 8.0])) - 4) < 1e-6
    assert least_length(queries, np.array([50.0, -np.inf])) == 0 and least_length(np.zeros((1, 2)), np.array([0.0])) == 0


def test_few_and_no_rows(spark):
    assert run(spark, [(0, [1.0]), (1, [2.0])]) == [(0, 1, 1, 256 * 512)]
    assert run(spark, []) == []
    assert run(spark, [(0, [1.0])]) == []


def test_scores_beyond_floats_and_longs(spark):
    limit = (1 << 63) - 1
    held = lambda rows: [(q, r, i, max(-limit - 1, min(limit, s))) for q, r, i, s in rows]
    near = [(0, [2.0**22, 1.0]), *[(i, [2.0**22, x / 256]) for i, x in ((1, 0), (2, 6), (3, 3), (4, 6))]]
    assert brute(near, 5, 10)[0][3] > 1 << 59 and run(spark, near) == brute(near, 5, 10)
    huge = [(i, [1e30 * (-1) ** i, i / 2, 2.0**40 if i == 4 else 1.0]) for i in range(12)]
    expected = brute(huge, 5, 10)
    assert any(s > limit for *_, s in expected)
    assert run(spark, huge, kind="double") == held(expected)
    assert run(spark, [(0, [1e308]), (1, [1.0]), (10, [1.0])], kind="double") == [(10, 1, 1, 65536)]


def made_block(seed, least=1.0, factors=(1, 3, 30)):
    """Queries near one axis with thresholds about their best scores, vectors near the axes and of lengths apart by ``factors``, some ids twice."""
    import numpy as np

    rng = np.random.default_rng(seed)
    axes = rng.integers(0, 6, 600)
    vectors = np.floor(rng.normal(0, 4, (600, 6)) + np.eye(6)[axes] * rng.choice([-1, 1], 600)[:, None] * 40) * rng.choice(factors, 600)[:, None]
    queries = np.floor(rng.normal(0, 1, (150, 6)) + np.eye(6)[rng.integers(0, 6, 150)] * 60)
    ids, query_ids = np.concatenate([np.arange(550), np.arange(50)]), np.arange(150)
    best = np.sort(queries @ vectors.T, axis=1)[:, -20]
    return queries, query_ids, np.where(rng.random(150) < 0.1, -np.inf, best * least), vectors, ids


def brute_block(queries, query_ids, thresholds, vectors, ids, k):
    out = []
    for q, query_id, threshold in zip(queries.tolist(), query_ids.tolist(), thresholds.tolist()):
        best = {}
        for v, own in zip(vectors.tolist(), ids.tolist()):
            score = sum(int(x) * int(y) for x, y in zip(q, v))
            if own != query_id and score >= threshold:
                best[own] = max(best.get(own, score), score)
        out += [(query_id, own, score) for own, score in sorted(best.items(), key=lambda r: (-r[1], r[0]))[:k]]
    return sorted(out)


def test_block_search_matches_brute_force():
    import numpy as np

    from tessera.llm.topk import chosen_rows, search_block

    for block in (made_block(1), made_block(2, 0.6), made_block(3, 1.4), made_block(4, -1.0), made_block(6, 1.0, [1])):
        assert sorted((q, i, int(s)) for q, i, s in search_block(*block, 4)) == brute_block(*block, 4)
    large = made_block(5)  # scores beyond 2 ** 53 and beyond longs
    for scale in (2.0**22, 2.0**30):
        block = (large[0] * scale, large[1], large[2] * scale * scale, large[3] * scale, large[4])
        assert sorted((q, i, int(s)) for q, i, s in search_block(*block, 4)) == brute_block(*block, 4)
    chosen = []
    for queries, _, thresholds, vectors, _ in (made_block(1), made_block(6, 1.0, [1])):
        lengths = np.sqrt((vectors * vectors).sum(axis=1))
        order = np.argsort(-lengths, kind="stable")
        chosen.append(chosen_rows(queries, thresholds, vectors[order], lengths[order]))
    assert chosen[0][0].min() < 300 and len(chosen[1][1]) > 20  # vectors are left out by length and by coordinate


def test_queries_of_a_block_share_products():
    import numpy as np

    from tessera.llm.topk import search_block

    calls = []

    class Counted(np.ndarray):
        def __matmul__(self, other):
            calls.append(self.shape)
            return np.asarray(self) @ np.asarray(other)

    rng = np.random.default_rng(1)
    queries, vectors = np.floor(rng.normal(0, 50, (256, 8))), np.floor(rng.normal(0, 50, (500, 8)))
    search_block(queries.view(Counted), np.arange(256), np.full(256, -np.inf), vectors.view(Counted), np.arange(500), 3)
    assert 0 < len(calls) <= 8


def test_rows_with_null_nan_and_overflowing_components_take_no_part(spark):
    rows = [(0, [1.0, 2.0]), (1, [3.0, None]), (2, [float("nan"), 1.0]), (3, [float("inf"), 1.0]), (4, [1.0, float("-inf")]), (5, [1e306, 1.0]), (6, [-1e306, 1.0])]
    rows += [(7, [5.0, 5.0]), (7, [5.0, 5.0]), (8, None), (9, []), (None, [9.0, 9.0]), (11, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert [tuple(r) for r in exact_top_k(df, k=5, every=50).orderBy("rank").collect()] == [(0, 1, 7, 15 * 65536), (0, 2, 11, 3 * 65536)]


def test_blocks_hold_their_integers_in_the_smallest_type(spark):
    from tessera.llm.topk import _packed, _read

    rows = [(2, 0, [3.0, -4.0]), (1, 0, [32767.0, 0.0]), (3, 1, [40000.0, 1.0]), (4, 2, [2.0**40, 5.0]), (5, 2, [-(2.0**90), 1.0])]
    blocks = _packed(spark.createDataFrame(rows, "_id long, _band int, _vector array<double>"), ["_band"]).orderBy("_band").collect()
    assert [(b["kind"], len(b["matrix"])) for b in blocks] == [("<i2", 8), ("<i4", 8), ("<f8", 32)]
    assert [[x.tolist() for x in _read(b["ids"], b["kind"], b["matrix"], 2)] for b in blocks] == [
        [[1, 2], [[32767, 0], [3, -4]]], [[3], [[40000, 1]]], [[4, 5], [[2.0**40, 5], [-(2.0**90), 1]]]
    ]


def test_components_of_all_sizes_in_one_table(spark):
    rng = random.Random(8)
    rows = [(i, [rng.randrange(-9, 10) * rng.choice([1.0, 1.0, 500.0, 2.0**30, 1e30]) for _ in range(3)]) for i in range(40)]
    limit = 2**63
    assert run(spark, rows) == [(q, n, j, max(-limit, min(limit - 1, s))) for q, n, j, s in brute(rows, 5, 10)]
