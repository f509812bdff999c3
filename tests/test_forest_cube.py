import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.config import FoldConfig
from tessera.operators import folds as L, forest_cube as FC, order as O

FOLDS = L.walk_forward(FoldConfig(0, 17, 8, 2, 2))


def panel(spark, entities=30):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(entities, 18))
    rows = [(f"e{e}", p, float(40 + 5 * (x[e, p] > 0) + rng.normal()), float(x[e, p]) if rng.random() < 0.7 else None) for e in range(entities) for p in range(18)]
    return spark.createDataFrame(rows, "entity_id string, period int, target double, x double").cache()


def staged(monkeypatch):
    """Tables that the forest stages, by name."""
    seen, real = {}, FC.stage
    monkeypatch.setattr(FC, "stage", lambda df, name: seen.setdefault(name, real(df, name)))
    return seen


def test_copies_of_rows_add_no_work(spark, monkeypatch):
    df = panel(spark)
    many = df.crossJoin(spark.range(6).select(F.col("id").alias("copy"))).withColumn("entity_id", F.concat("entity_id", F.lit("-"), "copy")).drop("copy")
    sizes = []
    for rows in (df, many):
        with monkeypatch.context() as patch:
            seen = staged(patch)
            found, _ = FC.all_folds(rows, FOLDS[:2], ["x"], depths=(3,), leaves=(5,), trees=8)
            sizes.append({r.fold: r.bytes for r in seen["forest-blocks"].groupBy("fold").agg(F.sum(F.length("y")).alias("bytes")).collect()})
            got = found.collect()
            assert len(got) == sum(rows.filter(f"period BETWEEN {f.test_start} AND {f.test_end}").count() for f in FOLDS[:2])
            assert np.corrcoef([r.y_true for r in got], [r.y_pred for r in got])[0, 1] > 0.6
    assert sizes[0] == sizes[1]


def test_thresholds_are_exact_quantiles_of_filled_training_rows(spark):
    df = panel(spark)
    rows = df.select(F.col("entity_id").alias("_entity"), F.col("period").alias("_period"), F.col("target").alias("_y"), F.col("x").alias("_x0"))
    local = df.toPandas()
    sizes = {f.fold: int(local["period"].between(f.train_start, f.train_end).sum()) for f in FOLDS}
    effects = spark.createDataFrame([(f, float(v), n) for f, size in sizes.items() for v, n in ((3, size // 4), (1, size // 2), (2, size - size // 2 - size // 4))], "fold int, _effect double, _n long")
    medians, edges = FC.learnt_edges(rows, effects, FOLDS, sizes, ["_x0"], ["x"])
    for f in FOLDS:
        x = local.loc[local["period"].between(f.train_start, f.train_end), "x"]
        assert medians[f.fold] == [x.median()]
        wanted = np.sort(x.fillna(x.median()))
        np.testing.assert_array_equal(edges[f.fold][0], [wanted[-(-len(x) * i // FC.BINS) - 1] for i in range(1, FC.BINS)])
        several = np.sort(np.repeat([3.0, 1.0, 2.0], [len(x) // 4, len(x) // 2, len(x) - len(x) // 2 - len(x) // 4]))
        np.testing.assert_array_equal(edges[f.fold][1], [several[-(-len(x) * i // FC.BINS) - 1] for i in range(1, FC.BINS)])


@pytest.mark.parametrize("most", [7, 10**6])
def test_values_at_ranks_of_unions_of_parts(spark, most):
    rng = np.random.default_rng(2)
    data = {(i, p): rng.integers(0, 40, 60).astype(float) * (1 + i) for i in range(2) for p in range(3)}
    df = spark.createDataFrame([(i, p, float(v)) for (i, p), values in data.items() for v in values], "indicator int, part int, value double")
    counted = df.groupBy("indicator", "part", "value").agg(F.count(F.lit(1)).alias("n"))
    unions = {(i, upto): (i, list(range(upto))) for i in range(2) for upto in (1, 2, 3)}

    def asked(sizes):
        assert sizes == {k: 60 for k in data}
        return {name: (i, parts, [0, 17, 60 * len(parts) - 1]) for name, (i, parts) in unions.items()}

    found = O.values_at_ranks(counted, asked, most_sorted=most)
    assert found == {name: {k: np.sort(np.concatenate([data[i, p] for p in parts]))[k] for k in (0, 17, 60 * len(parts) - 1)} for name, (i, parts) in unions.items()}


def test_draws_of_copies_are_poisson_numbers_of_that_mean():
    rng = np.random.default_rng(3)
    copies = np.repeat([1, 3, 10, 100, 5000], 20000)
    got = FC.draws(rng.integers(0, 1 << 63, len(copies)).astype(np.uint64), 2, 42, copies)
    for k in np.unique(copies):
        drawn = got[copies == k]
        assert drawn.mean() == pytest.approx(k, rel=0.03) and drawn.var() == pytest.approx(k, rel=0.06)


def grown(leaves, copies, trees=4, most=5, n=3000):
    """Trees of all leaves on made-up rows: bins, features, edges and values."""
    rng = np.random.default_rng(1)
    bins = rng.integers(0, FC.BINS, (n, 6)).astype(np.uint8)
    y = (bins[:, 0] > 12) * 3.0 + bins[:, 1] * 0.1 + rng.normal(size=n)
    hashes = rng.integers(0, 1 << 63, n).astype(np.uint64)
    asked = rng.random((trees, (1 << most) - 1, 6)).argsort(-1)[..., :3].astype(np.int8)
    shape = (len(leaves), trees, (2 << most) - 1)
    feature, edge, value, same = np.full(shape, -1, np.int8), np.zeros(shape, np.uint8), np.full(shape, np.nan), np.repeat(np.arange(len(leaves)) > 0, trees).reshape(len(leaves), trees, 1)
    for level in range(most):
        first, nodes = (1 << level) - 1, 1 << level
        at = slice(first, first + nodes)
        counts = FC.grove_counts(bins, y, hashes, copies, level, feature, edge, asked, same, range(trees), 42)
        for t in range(trees):
            times = FC.draws(hashes, t, 42, copies)
            node = list(FC.descend(bins, feature[0, t], edge[0, t], level))[-1]
            for k in range(first, first + nodes):  # what is counted is what the tree draws
                if (inside := node == k).any():
                    for j, f in enumerate(asked[t, k]):
                        here = slice((k - first) * FC.BINS, (k - first + 1) * FC.BINS)
                        np.testing.assert_array_equal(counts[t][0][0, j, here], np.bincount(bins[inside, f], times[inside], FC.BINS))
                        np.testing.assert_allclose(counts[t][1][0, j, here], np.bincount(bins[inside, f], (times * y)[inside], FC.BINS), atol=1e-8)
            f, e, means = FC.best_splits(*counts[t], leaves, same[:, t], asked[t, at])
            feature[:, t, at], edge[:, t, at] = f, e
            if not level:
                value[:, t, 0] = means[:, 0, 0]
            value[:, t, 2 * first + 1 : 2 * first + 1 + 2 * nodes] = means[:, :, 1:].reshape(len(leaves), -1)
        alike = same.copy()
        alike[1:] &= (feature[1:, :, at] < 0) | (feature[1:, :, at] == feature[:-1, :, at]) & (edge[1:, :, at] == edge[:-1, :, at])
        same = alike.repeat(2, axis=2)
    return bins, feature, edge, value


@pytest.mark.parametrize("most_copies", [1, 9])
def test_answers_shared_by_leaves_are_those_of_each_tree(most_copies):
    leaves = [5, 40, 160]
    bins, feature, edge, value = grown(leaves, np.random.default_rng(4).integers(1, most_copies + 1, 3000))
    got = FC._answers(bins, *FC.closed(feature, edge, value), [3, 5])
    for i in range(len(leaves)):
        for j, depth in enumerate([3, 5]):
            wanted = np.mean([value[i, t][list(FC.descend(bins, feature[i, t], edge[i, t], depth))[-1]] for t in range(4)], axis=0)
            np.testing.assert_allclose(got[i, j], wanted)
