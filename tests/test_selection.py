import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.config import LeakageViolation, PanelConfig, ProtocolConfig
from tessera.operators import models as M, prep, selection as S


def frame(spark, **columns):
    names = list(columns)
    return spark.createDataFrame([tuple(None if v is None else float(v) for v in r) for r in zip(*columns.values())], ", ".join(f"{n} double" for n in names))


def test_partitioned_panel_is_refused(spark):
    rng = np.random.default_rng(7)
    approved, failed = rng.uniform(20, 60, 400), rng.uniform(0, 30, 400)
    df = frame(spark, approved=approved, failed=failed, target=100 - approved - failed)
    assert S.reconstruction_r2(S.moments(df, df.columns), "target", ["approved", "failed"]) == pytest.approx(1, abs=1e-9)
    with pytest.raises(LeakageViolation):
        S.audit_features(df.selectExpr("*", "target AS target_lag_2", "target AS target_lag_3"), ["approved", "failed"])


def test_reconstruction_matches_least_squares(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(80, 3))
    y = x @ [1, -2, 0.5] + rng.normal(size=80)
    df = frame(spark, a=x[:, 0], b=x[:, 1], c=x[:, 2], target=y)
    design = np.column_stack([x, np.ones(80)])
    rest = y - design @ np.linalg.lstsq(design, y, rcond=None)[0]
    found = S.moments(df, df.columns)
    assert S.reconstruction_r2(found, "target", ["a", "b", "c"]) == pytest.approx(1 - rest @ rest / ((y - y.mean()) ** 2).sum())
    assert S.reconstruction_r2(found, "target", []) is None
    assert S.design_rank(df, ["a", "b", "c"]) == (4, 4)


def test_collinear_frame(spark):
    rng = np.random.default_rng(42)
    a, c = rng.normal(size=100), rng.normal(size=100)
    df = frame(spark, a=a, b=a + 0.001 * rng.normal(size=100), c=c, d=a + c)
    assert S.without_collinear(df.drop("d"), ["a", "b", "c"]) == ["a", "c"]
    found = S.moments(df, ["a", "c", "d"])
    assert S.redundant_features(found, ["a", "c", "d"]) == ["a", "c", "d"] and S.design_rank(df, ["a", "c", "d"]) == (3, 4)
    with pytest.raises(ValueError):
        S.without_collinear(df.limit(5), ["a", "b"])


def test_band_and_pool(spark):
    assert S.within_band({"a": 0.2, "b": 0.9, "c": 0.12, "d": 0.05}) == (["a", "c"], 0.10)
    with pytest.raises(ValueError):
        S.within_band({"a": 0.9})
    df = frame(spark, gini=[1], target_lag_2=[1], target=[2], target_source=[3], etl=[4])
    assert S.candidate_pool(df, PanelConfig(excluded=("etl",))) == ["gini"]
    with pytest.raises(ValueError):
        S.candidate_pool(df, declared=["target_x"])
    with pytest.raises(ValueError):
        S.candidate_pool(df.selectExpr("*", "1.0D AS quality_score_x"))


def test_selection_uses_the_training_window(spark):
    rng = np.random.default_rng(0)
    n = 300
    y = rng.normal(size=n)
    rows = [(f"e{i % 10}", 2000 + i // 10, float(y[i]), float(0.5 * y[i] + rng.normal()), float(y[i] if i > 200 else rng.normal())) for i in range(n)]
    df = spark.createDataFrame(rows, "entity_id string, period int, target double, good double, later double")
    found = S.select_features(df, 2019)
    assert found.features == ["good"] and 0.15 < found.correlations["good"] < 0.8
    # harmless in the first window, the target itself afterwards
    proxy = F.when(F.col("period") <= 2003, F.col("later")).otherwise(F.col("target"))
    with pytest.raises(LeakageViolation):
        S.select_features(df.withColumn("later", proxy), 2003, protocol=ProtocolConfig(floor=0.0, relaxed_floor=0.0))


def test_audit(spark):
    rng = np.random.default_rng(13)
    y = rng.normal(size=300)
    df = frame(spark, gini=0.3 * y + rng.normal(size=300), net=rng.normal(size=300), target=y, target_lag_2=0.85 * y + 0.3 * rng.normal(size=300), target_lag_3=y)
    report = S.audit_features(df, ["gini", "net", "target_lag_2"])
    assert report["status"] == "ran" and report["exempt"] == ["target_lag_2"] and report["rank"] == report["full_rank"]
    with pytest.raises(LeakageViolation):
        S.audit_features(df, ["target_lag_2"])
    with pytest.raises(ValueError):
        S.audit_features(df.drop("target_lag_3"), ["gini"])


def test_imputation_learns_from_training_alone(spark):
    train, test = frame(spark, a=[1, None, 3], b=[10, 20, None]), frame(spark, a=[None, 5], b=[None, 1])
    statistics = prep.train_statistics(train, ["a", "b"])
    assert statistics == {"a": 2.0, "b": 15.0}
    assert [tuple(r) for r in prep.impute(test, statistics).collect()] == [(2.0, 15.0), (5.0, 1.0)]
    with pytest.raises(ValueError):
        prep.train_statistics(spark.createDataFrame([(None,)], "a double"), ["a"])
    assert prep.scaler(frame(spark, a=[2, 2]), ["a"]) == {"a": (2.0, 1.0)}


def test_ridge_by_moments_matches_ridge_by_rows(spark):
    rng = np.random.default_rng(17)
    x = rng.normal(size=(90, 3))
    y = x @ [0.5, -0.2, 0] + 0.3 * rng.normal(size=90)
    ids = [f"e{i % 6}" for i in range(90)]
    df = spark.createDataFrame([(e, i, float(v), *map(float, r)) for i, (e, v, r) in enumerate(zip(ids, y, x))], "entity_id string, period int, target double, gini double, internet double, gdp double")
    model = M.fit_hierarchical(df, ["gini", "internet", "gdp"])
    means = {r.entity_id: r.shrunken_mean for r in model.means.collect()}
    resid = y - np.array([means[e] for e in ids])
    centred = x - x.mean(axis=0)
    weights = np.linalg.solve(centred.T @ centred + model.ridge.alpha * np.eye(3), centred.T @ (resid - resid.mean()))
    assert np.allclose(model.ridge.weights, weights, atol=1e-8) and model.ridge.alpha in M.ALPHAS
    got = {r.period: r.y_pred for r in model.predict(df).collect()}
    expected = np.array([means[e] for e in ids]) + centred @ weights + resid.mean()
    assert np.allclose([got[i] for i in range(90)], expected)
    unseen = model.predict(df.limit(1).selectExpr("'new' AS entity_id", "period", "target", "gini", "internet", "gdp")).first()
    assert np.isfinite(unseen.y_pred)
    assert M.choose_shrink(model, df, (0.6, 0.8, 1.0)).shrink == 1.0


def test_group_dealing_and_forest(spark):
    assert M.balanced_groups({"a": 5, "b": 4, "c": 3, "d": 1}, 2) == {"a": 0, "b": 1, "c": 1, "d": 0}
    rng = np.random.default_rng(5)
    rows = [(f"e{i % 5}", i, float(v + i % 5), float(v)) for i, v in enumerate(rng.normal(size=120))]
    df = spark.createDataFrame(rows, "entity_id string, period int, target double, x double")
    got = M.fit_forest(df, ["x"], depth=5, leaf=3, trees=20)(df).collect()
    assert len(got) == 120 and np.corrcoef([r.target for r in got], [r.y_pred for r in got])[0, 1] > 0.8


def test_forest_is_chosen_on_the_validation_part(spark, monkeypatch):
    tried = []

    def fit(train, features, depth, leaf, trees, **_):
        tried.append((depth, leaf, trees))
        return lambda df: df.withColumn("y_pred", F.col("target") + abs(depth - 7) + abs(leaf - 8))

    monkeypatch.setattr(M, "fit_forest", fit)
    df = spark.createDataFrame([("a", 1, 2.0, 1.0)], "entity_id string, period int, target double, x double")
    assert M.choose_forest(df, df, ["x"])(df).first().y_pred == 2.0
    assert tried == [(d, n, 200) for d in (5, 6, 7) for n in (5, 8, 12)]


def test_forests_of_all_folds_share_what_shapes_have_in_common(spark):
    from tessera.config import FoldConfig
    from tessera.operators import folds as L, forest_cube as FC

    rng = np.random.default_rng(11)
    n = 3000
    bins = rng.integers(0, FC.BINS, (n, 6)).astype(np.uint8)
    y = (bins[:, 0] > 12) * 3.0 + bins[:, 1] * 0.1 + rng.normal(size=n)
    hashes = rng.integers(0, 1 << 63, n).astype(np.uint64)
    asked = rng.random((31, 6)).argsort(-1)[:, :3].astype(np.int8)

    def grown(leaves):
        feature, edge, same = np.full((len(leaves), 63), -1, np.int8), np.zeros((len(leaves), 63), np.uint8), np.arange(len(leaves))[:, None] > 0
        for level in range(5):
            at = slice((1 << level) - 1, (2 << level) - 1)
            counts, sums = FC.level_counts(bins, y, hashes, level, feature, edge, asked, same, 3, 42)
            f, e, _ = FC.best_splits(counts, sums, leaves, same, asked[at])
            alike = same.copy()
            alike[1:] &= (f[1:] < 0) | (f[1:] == f[:-1]) & (e[1:] == e[:-1])
            feature[:, at], edge[:, at], same = f, e, alike.repeat(2, axis=1)
        return feature, edge

    times = FC.draws(hashes, 3, 42).astype(int)
    assert abs(times.mean() - 1) < 0.1 and abs(times.var() - 1) < 0.15
    feature, edge = grown([5, 40, 160])
    for i, leaf in enumerate([5, 40, 160]):  # as if grown alone, each leaf large enough, each split the best of those allowed
        alone = grown([leaf])
        reached = np.unique(np.concatenate(list(FC.descend(bins, feature[i], edge[i], 5))))
        assert (feature[i][reached] == alone[0][0][reached]).all() and (edge[i][reached] == alone[1][0][reached]).all()
        *levels, last = FC.descend(bins, feature[i], edge[i], 5)
        assert min(times[last == k].sum() for k in np.unique(last)) >= leaf
        for node in (k for k in reached if k < 31 and feature[i][k] >= 0):
            inside = np.flatnonzero(levels[int(np.log2(node + 1))] == node)
            w, v = times[inside], y[inside]

            def error(f, b):
                sides = [bins[inside, f] <= b, bins[inside, f] > b]
                return sum(w[s] @ (v[s] - np.average(v[s], weights=w[s])) ** 2 for s in sides) if min(w[s].sum() for s in sides) >= leaf else np.inf

            least = min(error(f, b) for f in asked[node] for b in range(FC.BINS - 1))
            assert error(feature[i][node], edge[i][node]) == pytest.approx(least)

    x = rng.normal(size=(40, 24))
    rows = [(f"e{e}", p, float(40 + 5 * (x[e, p] > 0) + rng.normal()), float(x[e, p]) if rng.random() < 0.9 else None) for e in range(40) for p in range(24)]
    df = spark.createDataFrame(rows, "entity_id string, period int, target double, x double")
    few = L.walk_forward(FoldConfig(0, 23, 8, 2, 2))
    found, chosen = FC.all_folds(df, few, ["x"], trees=20)
    got = found.collect()
    assert set(chosen) == {f.fold for f in few} and len(got) == sum(40 * 2 for _ in few)
    assert np.corrcoef([r.y_true for r in got], [r.y_pred for r in got])[0, 1] > 0.8
    # later rows teach nothing, the order and cut of the input change nothing
    cut = few[0].test_end
    early = FC.all_folds(df.repartition(7).filter(F.col("period") <= cut), few[:1], ["x"], trees=20)[0]
    a, b = ({(r.entity_id, r.period): r.y_pred for r in d} for d in (early.collect(), [r for r in got if r.fold == 0]))
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) for k in a)


def test_forest_query_does_not_run_jobs_for_each_fold(spark, monkeypatch):
    from tessera.plans import queries as Q

    def refused(*_, **__):
        raise AssertionError("a forest for one fold")

    monkeypatch.setattr(M, "fit_forest", refused)
    monkeypatch.setattr(Q, "PERIODS", Q.PERIODS[:2])
    assert {r.fold for r in Q.QUERIES["random_forest_hierarchical"](spark, "/root/testdata/sf0.001").select("fold").distinct().collect()} == {0, 1}


@pytest.mark.parametrize("name", ["ridge_hierarchical", "fold_runner", "random_forest_hierarchical"])
def test_model_queries_run_every_fold(spark, monkeypatch, name):
    from tessera.plans import queries as Q

    monkeypatch.setattr(Q, "PERIODS", Q.PERIODS[:2])
    monkeypatch.setattr(M, "choose_forest", lambda train, validation, features: M.fit_forest(train, features, trees=3))
    got = Q.QUERIES[name](spark, "/root/testdata/sf0.001").select("fold").distinct().collect()
    assert {r.fold for r in got} == {0, 1}


@pytest.mark.parametrize("parallelism", [1, 8])
def test_each_fold_keeps_the_order_and_raises_what_a_fold_raises(spark, parallelism):
    from tessera.operators import runner as R

    assert R.each_fold(spark, list(range(12)), lambda k: spark.range(k).count(), parallelism) == list(range(12))
    assert R.each_fold(spark, [], lambda k: k, parallelism) == []
    with pytest.raises(ZeroDivisionError):
        R.each_fold(spark, [1, 0], lambda k: 1 // k, parallelism)


def test_rank_tells_a_small_difference_from_none(spark):
    rng = np.random.default_rng(8)
    a, b, c = rng.normal(size=(3, 4000))
    df = frame(spark, a=a, b=b, near=a * (1 + 1e-7 * c), same=2 * a - b + 1e6, flat=np.full(4000, 3.0), far=1e7 + b + c).repartition(40)
    assert S.design_rank(df, ["a", "near"]) == (3, 3)
    assert S.design_rank(df, ["a", "b", "same"]) == (3, 4)
    assert S.design_rank(df, ["a", "flat", "far"]) == (3, 4)
    assert S.design_rank(df, []) == (1, 1)


def test_factor_does_not_depend_on_partitions(spark):
    x = np.random.default_rng(9).normal(size=(500, 3))
    df = frame(spark, a=x[:, 0], b=x[:, 1], c=x[:, 2])
    whole = np.abs(np.linalg.qr(np.column_stack([np.ones(500), x]), mode="r"))
    for parts in (1, 7, 60):
        np.testing.assert_allclose(np.abs(S.triangular_factor(df.repartition(parts), ["a", "b", "c"], fan_in=4)), whole, rtol=1e-9, atol=1e-9)
