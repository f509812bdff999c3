import random

import pytest
from pyspark.sql import functions as F

from tessera.llm import near_duplicates as nd
from tessera.llm.components import connected_components
from tessera.llm.near_duplicates import drop_near_duplicates


def brute(rows, size=5, percent=75):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        component = min(ids) if ids else None
        out.append((doc, len(sets[i]), component, doc == component))
    return sorted(out, key=repr)


def run(spark, rows):
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id long, text string, n int, key string")
    out = nd.near_duplicates(df)
    assert out.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    return sorted((tuple(r) for r in out.collect()), key=repr)


def family(rng, base, copies, edits):
    out = []
    for _ in range(copies):
        words = list(base)
        for _ in range(rng.randrange(edits + 1)):
            words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("block", [1024, 7])
def test_matches_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(nd, "BLOCK", block)
    monkeypatch.setattr(nd, "CROWD", block)
    rng = random.Random(block)
    word = lambda: f"w{rng.randrange(3000)}"
    texts = []
    for copies, edits in ((40, 4), (12, 6), (3, 1), (2, 3)):
        texts += family(rng, [word() for _ in range(60)], copies, edits)
    passage = " ".join(word() for _ in range(40))
    texts += [passage + " " + " ".join(word() for _ in range(rng.randrange(5, 60))) for _ in range(40)]
    texts += ["", None, " \n\t", "one", "ONE", "a b c d", "A b\nc  d", "a b c d e", "É b", "é b", "x " * 30000, "x x x x x"]
    texts += [texts[0], texts[0].upper()]
    rng.shuffle(texts)
    rows = list(enumerate(texts)) + [(3, texts[3]), (3, "quite another text of its own here"), (None, texts[5]), (None, "alone it stands without any id")]
    assert run(spark, rows) == brute(rows)


def crowd(rng, n, own):
    """Texts that share one passage, and for each tenth a partner at a similarity of 0.75 to 0.8 that shares the rest as well."""
    word = lambda: f"w{rng.randrange(10**9)}"
    passage = [word() for _ in range(120)]
    texts, partners = [], []
    for i in range(n):
        text = passage + [word() for _ in range(own)]
        texts.append(text)
        if i % 10 == 0:
            edited = list(text)
            size = len(text) - 4
            for at in rng.sample(range(2, len(text) // 5), round(size * 0.12 / 5)):  # each changes five shingles
                edited[at * 5] = word()
            a, b = ({tuple(t[k : k + 5]) for k in range(size)} for t in (text, edited))
            assert 0.75 <= len(a & b) / len(a | b) <= 0.82
            partners.append((i, edited))
    return texts, partners


def test_links_in_a_crowded_bucket_are_found(spark, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK", 32)
    monkeypatch.setattr(nd, "CROWD", 64)
    texts, partners = crowd(random.Random(8), 600, 120)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(10000 + i, " ".join(t)) for i, t in partners]
    component = {r[0]: r[2] for r in run(spark, rows)}
    found = sum(component[10000 + i] == component[i] for i, _ in partners)
    assert found >= 0.95 * len(partners) and all(component[i] == i for i in range(600))


def test_crowded_buckets_are_searched_in_linear_rows(spark, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK", 32)
    monkeypatch.setattr(nd, "CROWD", 64)
    dealt = []
    for n in (400, 1600):
        texts, _ = crowd(random.Random(n), n, 150)
        monkeypatch.setattr(nd, "further_pairs", lambda searched, sets, percent: dealt.append(searched.agg(F.sum(F.ceil(F.col("size") / nd.BLOCK))).first()[0]) or searched.select(F.col("key").alias("a"), F.col("key").alias("b")).limit(0))
        run(spark, [(i, " ".join(t)) for i, t in enumerate(texts)])
    assert dealt[1] <= 6 * dealt[0] + 1000, dealt


def test_rows_without_ids_do_not_all_meet(spark):
    rng = random.Random(3)
    words = lambda: [f"w{rng.randrange(500)}" for _ in range(30)]
    texts = [t for _ in range(20) for t in family(rng, words(), 3, 2)]
    rows = [(None, t) for t in texts] + [(i, t) for i, t in enumerate(texts[:10])]
    assert run(spark, rows) == brute(rows)


def test_empty_and_single(spark):
    assert run(spark, []) == []
    assert run(spark, [(4, None)]) == [(4, 0, 4, True)]
    assert run(spark, [(4, "a b"), (2, "a  B")]) == [(2, 1, 2, True), (4, 1, 2, False)]


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(100 + rng.randrange(30), 100 + rng.randrange(30)) for _ in range(25)] + [(7, 7), (None, 1), (3, 4)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    assert got == {x: find(x) for x in parent}


def test_rows_without_or_with_shared_ids_follow_their_own_component(spark):
    prose = " ".join(f"word{i}" for i in range(80))
    other = " ".join(f"term{i}" for i in range(80))
    rows = [(1, prose), (None, prose + " more"), (None, "a text of its own without any copy"), (2, other), (7, other + " more"), (7, "another text that has no copy at all")]
    got = drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {tuple(r) for r in got} == {rows[i] for i in (0, 2, 3, 5)} and len(got) == 4


def test_a_pair_is_given_by_one_of_its_pieces(spark):
    sketch = lambda changed: bytes([7] * (nd.SKETCH - changed) + [9] * changed)
    keys = {b"a": 0, b"b": 60, b"c": 120, b"d": 900}
    sets = spark.createDataFrame([(k, 100, sketch(c)) for k, c in keys.items()], "key binary, n long, sketch binary")
    searched = spark.createDataFrame(
        [(p, k, k, 3) for p, ks in ((-5, b"abd"), (3, b"abc"), (4, b"bcd"), (9, b"abc")) for k in (bytes([x]) for x in ks)], "piece long, key binary, root binary, size long"
    )
    got = [(bytes(r.a), bytes(r.b)) for r in nd.further_pairs(searched, sets, 75).collect()]
    assert sorted(got) == [(b"a", b"b"), (b"a", b"c"), (b"b", b"c")]


def test_whole_rows_are_dealt_by_text_only_where_some_repeat(spark):
    rows = [(i, f"text number {i} with words of its own {i * 7} {i * 11}", "x") for i in range(30)] + [(None, "a row without an id that is alone here", "y"), (99, None, "z")]
    single = drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert "Aggregate" not in single._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(repr, single.collect())) == sorted(map(repr, spark.createDataFrame(rows, "doc_id long, text string, source string").collect()))
    # the same rows and one id with two texts: repeated rows stay once, others as they are
    twice = [*rows, rows[3], rows[3], rows[-2], rows[-1], (5, "another text that carries the id five and is unlike it", "x")]
    got = drop_near_duplicates(spark.createDataFrame(twice, "doc_id long, text string, source string").repartition(5)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, spark.createDataFrame([*rows, twice[-1]], "doc_id long, text string, source string").collect()))
