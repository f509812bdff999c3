import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import order as O


def test_ranks_span_ranges_and_a_hot_key(spark):
    rows = [("hot", i * 7919 % 5000) for i in range(3000)] + [("b", i) for i in range(5)] + [(None, 3), (None, 1)]
    df = spark.createDataFrame(rows, "k string, x long").repartition(3)
    got = O.with_rank(df, ["k"], ["x"], "at", ranges=8)
    expected = {(k, x): r for key in ("hot", "b", None) for r, (k, x) in enumerate(sorted((p for p in rows if p[0] == key), key=lambda p: p[1]))}
    assert {(r.k, r.x): r["at"] for r in got.collect()} == expected
    ranges = O.ranged(df, ["k", "x"], 8).filter("k = 'hot'").groupBy("_range").count().collect()
    assert len(ranges) > 4 and max(r["count"] for r in ranges) < 1500


def test_ranks_of_no_rows(spark):
    assert O.with_rank(spark.createDataFrame([], "k string, x long"), ["k"], ["x"]).collect() == []


@pytest.mark.parametrize("ranges", [1, 3, 50])
def test_previous_row_crosses_ranges(spark, ranges):
    rows = [(i, float(i * i)) for i in range(40)]
    got = O.with_previous(spark.createDataFrame(rows, "x long, v double").repartition(4), ["x"], ["v", "x"], ranges=ranges)
    assert sorted(tuple(r) for r in got.collect()) == [(i, v, float((i - 1) ** 2) if i else None, i - 1 if i else None) for i, v in rows]


def groups():
    rng = np.random.default_rng(3)
    return {
        "distinct": rng.permutation(5000).astype(float), "ties": rng.integers(0, 3, 4000).astype(float), "normal": rng.normal(size=3001), "heavy": np.exp(rng.normal(size=2500) * 8),
        "one": np.array([4.0]), "two": np.array([1.0, 2.0]), "constant": np.full(3000, 7.0),
    }


@pytest.mark.parametrize("most", [50, 10**6])
def test_percentiles_are_exact_with_and_without_narrowing(spark, most):
    found = groups()
    df = spark.createDataFrame([(k, float(x), float(-x)) for k, v in found.items() for x in v] + [("one", None, None)], "k string, a double, b double").repartition(5)
    fractions = [0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = O.exact_percentiles(df, ["k"], ["a", "b"], fractions, most_sorted=most, grid=8).collect()
    assert len(got) == 2 * len(found)
    for r in got:
        values = found[r.k] if r.indicator == "a" else -found[r.k]
        assert r.n == len(values)
        np.testing.assert_allclose(r["values"], np.quantile(values, fractions), rtol=1e-12)


def test_no_task_sorts_more_than_asked_for(spark, monkeypatch):
    seen, real = [], O.stage
    monkeypatch.setattr(O, "stage", lambda df, name: seen.append(real(df, name)) or seen[-1])
    df = spark.range(20000).select((F.col("id") * 7919 % 20011).cast("double").alias("a"))  # all distinct
    assert O.exact_percentiles(df, [], ["a"], [0.5], most_sorted=300, grid=16).first()["values"] == [float(np.median([i * 7919 % 20011 for i in range(20000)]))]
    inside = [r.inside for r in seen[-1].collect()]
    assert len(seen) > 2 and max(inside) <= 300


def test_percentiles_of_no_values(spark):
    df = spark.createDataFrame([("a", None)], "k string, x double")
    assert O.exact_percentiles(df, ["k"], ["x"], [0.5]).collect() == []
    assert O.exact_percentiles(df.limit(0), [], ["x"], [0.5]).collect() == []


def test_sketches_merge_within_their_error(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i % 7, i % 2, float(x)) for i, x in enumerate(rng.normal(size=30000))] + [(0, 0, None)], "part int, k int, v double")
    stored = O.quantile_sketches(df, ["part", "k"], "v")
    assert stored.count() == 14 and max(len(r.sketch) for r in stored.collect()) < 40_000
    estimates = O.sketched_quantiles(O.merged_sketches(stored, ["k"]), ["k"], [0.1, 0.5, 0.99])
    errors = O.rank_errors(df, ["k"], "v", estimates).collect()
    assert len(errors) == 6 and sum(r.n for r in errors) == 3 * 30000 and max(r.rank_error for r in errors) < 0.01
