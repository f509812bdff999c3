import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.llm.mixing import mix_sources, mixed_rows, word_count


def water_filled(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    """Targets by resharing the excess until none is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, s.encode() if s is not None else b""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, left, open_ = {}, share * sum(sizes.values()), set(names)
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > cap * sizes[s]]
        if not over:
            return target | {s: left * weight[s] / total for s in open_}
        for s in over:
            target[s] = cap * sizes[s]
        left -= sum(target[s] for s in over)
        open_ -= set(over)
    return target


def fixture():
    rng = random.Random(4)
    rows = [(i, "w " * rng.randrange(1, 200), rng.choice(["a", "a", "a", "b", "ü", "Z", None])) for i in range(900)]
    rows += [(900, None, "a"), (901, "", "b"), (902, " \n", None), (903, "x", "tiny"), (904, "", "empty"), (5, rows[5][1], rows[5][2]), (None, "a b c", "a")]
    return rows + [(2000 + i, "same text here", "a") for i in range(400)]


def test_targets_and_taken_words(spark):
    rows = fixture()
    df = spark.createDataFrame([(i, t, s, 1, "x") for i, t, s in rows], "doc_id long, text string, source string, size int, taken string")
    out = mix_sources(df)
    assert out.columns == ["doc_id", "size", "source_size", "target", "taken"]
    got = out.collect()
    assert sorted(got, key=repr) == sorted(mix_sources(df.repartition(7)).collect(), key=repr)
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len((text or "").split())
    expected = water_filled(sizes)
    by_size = {}
    for s, n in sizes.items():
        by_size.setdefault(n, set()).add(round(expected[s], 6))
    assert len(got) == len(rows) and all(round(r.target, 6) in by_size[r.source_size] for r in got)
    assert all(0 <= r.taken <= 2 * r.size and (r.size == 0 or r.taken % r.size == 0) for r in got)
    taken = defaultdict(int)
    for r in got:
        taken[r.source_size] += r.taken
    for s, n in sizes.items():
        if n > 5000:
            assert taken[n] == pytest.approx(expected[s], rel=0.02)


def test_rows_are_repeated_as_often_as_taken(spark):
    rows = [r for r in fixture() if r[1] and r[1].split()]
    df = spark.createDataFrame([(n, t, s, n * 2) for n, (_, t, s) in enumerate(rows)], "doc_id long, text string, source string, extra long")
    taken = {r.doc_id: r.taken // r.size for r in mix_sources(df).collect()}
    got = mixed_rows(df)
    assert got.columns == df.columns
    copies = defaultdict(int)
    for r in got.collect():
        assert r.extra == 2 * r.doc_id
        copies[r.doc_id] += 1
    assert {k: v for k, v in taken.items() if v} == copies


def test_empty_table_and_word_count(spark):
    schema = "doc_id long, text string, source string"
    assert mix_sources(spark.createDataFrame([], schema)).count() == 0
    assert mixed_rows(spark.createDataFrame([], schema)).count() == 0
    texts = [None, "", " ", "a", " a\tb\x0bc\n", "a\xa0b c", "a" + " " * 300000 + "b"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(word_count(F.col("t")).alias("n")).collect()
    assert [r.n for r in got] == [0, 0, 0, 1, 3, 2, 2]
