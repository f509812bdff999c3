import random
import time

import pytest

from tessera.config import FoldConfig
from tessera.operators import backends as E, benchmark as N, comparison as C, folds as L, gates as G, imputation_checks as I
from tessera.operators.panel import carry_forward, fill_with_peers


def panel(spark):
    rng = random.Random(6)
    rows = [(f"e{e}", f"e{e}", f"s{e % 3}", p, float(rng.randrange(64)), None if rng.random() < 0.3 else float(rng.randrange(16))) for e in range(12) for p in range(1, 25) if rng.random() < 0.8]
    return spark.createDataFrame(rows, "entity_id string, entity_name string, entity_stratum string, period int, target double, x double")


def test_back_ends_agree_bit_by_bit(spark):
    folded = L.materialise(panel(spark), L.walk_forward(FoldConfig(1, 24, 8, 2, 2))).cache()
    found = {}
    for name, kind in E.BackEnd.registry.items():
        # targets are whole numbers, so that sums do not depend on their order
        found[name] = C.numbered_predictions(kind().forecasts(folded), "entity_id", "period")
    assert set(found) == {"dataframe", "sql", "pandas"}
    gate = G.equivalence_gate(found)
    assert gate == {"status": "equivalent", "findings": []}
    with pytest.raises(ValueError):
        type("Again", (E.BackEnd,), {"name": "sql"})


def test_pandas_back_end_takes_many_entities_in_one_call(spark):
    folded = L.materialise(panel(spark), L.walk_forward(FoldConfig(1, 24, 8, 2, 2))).cache()
    sql, pandas = (E.BackEnd.registry[n]().naive_with_lag(folded) for n in ("sql", "pandas"))
    plan = pandas._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" in plan and "FlatMapGroups" not in plan  # no call of Python for each entity of each fold
    wanted = sorted(sql.collect())
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        assert sorted(pandas.collect()) == wanted and len(wanted) > 50
        assert E.BackEnd.registry["pandas"]().naive_with_lag(folded.filter("false")).isEmpty()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_holdout_and_candidates(spark):
    df = panel(spark)
    got = I.holdout_check(df, ["x"], {"x": "k"}, share=0.5).first()
    again = I.holdout_check(df.repartition(5), ["x"], {"x": "k"}, share=0.5).first()
    assert (got.n, got.category) == (again.n, "k") and got.mae == pytest.approx(again.mae) and got.n > 20 and got.rmse >= got.mae
    assert I.holdout_check(df, ["x"], {}, share=0.5, least=10**6).first().mae is None
    methods = {"carried": carry_forward(df, {"x": 3}), "peers": fill_with_peers(df, ["x"]), "zero": df.fillna({"x": 0.0})}
    comparison = I.compare_candidates(methods, df, "x")
    assert {r.method for r in comparison.collect()} == set(methods) and I.most_robust(comparison) != "zero"
    row = I.coverage(df, methods["zero"], ["x"]).first()
    assert row.observed_share + row.imputed_share == pytest.approx(1) and row.rows_before == row.rows_after


def test_benchmark_runner(spark):
    frames = {a: {p: (lambda: spark.range(10)) for p in ("setup", "processing")} for a in ("x", "y")}
    records = N.run_benchmark(frames, runs=2, warmups=1)
    assert len(records) == 3 * 4 and sum(r["is_warmup"] for r in records) == 4 and all(r["cpu_proc"]["n"] > 0 for r in records)
    assert [r["phase"] for r in records[:2]] == ["processing", "setup"]
    assert C.run_totals(N.runs_frame(spark, records)).count() == 4


def test_collection_pass_and_failures(spark):
    frames = {a: {"setup": lambda: spark.range(10)} for a in ("x", "y")}
    records = N.run_benchmark(frames, runs=1, warmups=0, collection=lambda: spark.range(5))
    assert [(r["run_id"], r["phase"], r["architecture"], r["is_warmup"]) for r in records if r["run_id"] < 0] == [(-1, "collection", "both", False)]
    assert records[0]["phase"] == "collection" and N.runs_frame(spark, records).filter("phase = 'collection'").isEmpty()

    def broken():
        raise KeyError

    with pytest.raises(RuntimeError, match="setup of y failed"):
        N.run_benchmark({"y": {"setup": broken}}, runs=1, warmups=0)


def test_resource_samples(spark):
    heavy = lambda: spark.range(0, 3_000_000, 1, 4).selectExpr("id % 1000 AS k", "sha2(CAST(id AS string), 256) AS v").groupBy("k").agg({"v": "max"})
    one, two = (N.run_benchmark({"x": {"setup": f}}, runs=1, warmups=0)[0] for f in (heavy, lambda: spark.range(1)))
    for r in (one, two):
        assert set(N.Sampler.MEASURES) <= set(r) and 0 < r["mem_sys_percent"]["max"] < 100 and 0 <= r["cpu_sys"]["max"] <= 100.5 and r["rss_mb"]["max"] > 10
        assert r["executors"]["tasks"] > 0 and r["executors"]["peak_heap_mb"] >= 0
    # figures of a phase do not hold those of the phase before
    assert one["executors"]["shuffle_write_mb"] > 0 and two["executors"]["shuffle_write_mb"] == 0
    assert one["executors"]["task_s"] > two["executors"]["task_s"] and one["rss_children_mb"]["max"] > 50


def test_reports(spark):
    rng = random.Random(2)
    rows = [(r, p, a, f * (1 + 0.05 * rng.random())) for r in range(10) for p in C.PHASES for a, f in (("x", 1.0), ("y", 2.0), ("z", 1.0))]
    df = spark.createDataFrame(rows, "run_id int, phase string, architecture string, duration_s double")
    tests = N.significance(df)
    assert len(tests) == 12 and all(t["p"] == t["floor"] and t["p_bh"] <= t["p_bonferroni"] for t in tests if (t["a"], t["b"]) == ("x", "y"))
    decisions = {(r["phase"], r["a"], r["b"]): r["decision"] for r in N.latency_equivalence(df, dict.fromkeys(C.PHASES, 0.1), rounds=500)}
    assert decisions["setup", "x", "y"] == "b_exceeds_a" and decisions["setup", "x", "z"] == "equivalent"
    assert {r["winner"] for r in N.latency_table(df)} <= {"x", "z"}
    scores = spark.createDataFrame([(f, a, 0.5 + d) for f in range(9) for a, d in (("x", 0.0), ("y", 0.001 * f))], "fold int, architecture string, r2 double")
    assert N.metric_equivalence(scores, "r2", 0.05, rounds=500)[0]["decision"] == "equivalent"
    assert {r["decision"] for r in N.sensitivity([0.001 * i for i in range(9)], 0.1, rounds=(500,))} == {"equivalent"}
    assert N.agreed({"a": 0.1 + 0.2, "b": 0.3}) == 0.1 + 0.2 and N.agreed({"a": 1.0, "b": 1.1}) is None


def test_more_pairs_than_the_driver_takes_are_refused(spark):
    df = spark.range(33_334).selectExpr("CAST(id AS int) AS fold", "explode(array('x', 'y', 'z')) AS architecture", "1.0D AS r2")
    with pytest.raises(ValueError, match="more than 100000 rows"):
        N.metric_equivalence(df, "r2", 0.05, rounds=10)


def test_gap_to_baselines_and_spent_dependence(spark):
    schema = "fold int, model string, r2 double"
    models = spark.createDataFrame([(f, "m", 0.5 + 0.01 * f) for f in range(8)], schema)
    baselines = spark.createDataFrame([(f, b, v) for f in range(8) for b, v in (("a", 0.4), ("b", 0.53))], schema)
    report = N.baseline_report(models, baselines, rounds=500)
    assert [(r["model"], r["n_folds"], r["wins"]) for r in report] == [("m", 8, 4)] and report[0]["low"] < report[0]["mean_gap"] < report[0]["high"]
    dependence = spark.createDataFrame([(1, 0.5), (2, -0.2), (3, 0.05), (4, None)], "lag int, r double")
    assert N.dependence_spent_at(dependence) == 3 and N.dependence_spent_at(dependence, 0.01) is None


def test_fold_records_and_phases(spark, caplog):
    df, folds = panel(spark), L.walk_forward(FoldConfig(1, 24, 8, 2, 2))
    assert N.fold_records(df, folds) == L.materialise(df, folds).count()

    @N.phase("work")
    def work(fail):
        time.sleep(0.01)
        if fail:
            raise KeyError
        return 1

    with caplog.at_level("INFO", "tessera"):
        assert work(False) == 1
        with pytest.raises(KeyError):
            work(True)
    assert "work took" in caplog.text and "work failed" in caplog.text


def test_fold_runner_keeps_the_test_part_unseen(spark):
    from pyspark.sql import functions as F

    from tessera.operators import panel as P, runner

    df = P.with_lags(panel(spark).withColumn("z", F.col("target") * 0.05 + F.col("period") % 7))
    fold = L.walk_forward(FoldConfig(1, 24, 8, 2, 2))[-1]
    features = ["x", "z", "target_lag_2"]
    one = runner.run_fold(df, fold, features)
    changed = df.withColumn("x", F.when(F.col("period") >= fold.test_start, F.col("x") * 100).otherwise(F.col("x")))
    two = runner.run_fold(changed, fold, features)
    assert one.medians == two.medians and one.alpha == two.alpha and one.shrink == two.shrink and one.audit["status"] == "ran"
    assert {(r.split, r.model) for r in one.metrics.collect()} == {("val", "ridge_hierarchical"), ("test", "ridge_hierarchical")}
    with pytest.raises(ValueError):
        runner.run_fold(df.drop("z"), fold, features)


def test_folds_run_together_as_one_by_one(spark):
    from pyspark.sql import functions as F

    from tessera.config import LeakageViolation
    from tessera.operators import panel as P, runner

    df = P.with_lags(panel(spark).withColumn("z", F.col("target") * 0.05 + F.col("period") % 7)).cache()
    folds, features = L.walk_forward(FoldConfig(1, 24, 8, 2, 2))[::3], ["x", "z", "target_lag_2"]
    together = runner.run_folds(df, folds, features)
    scores = {(r.fold, r.split): r.asDict() for r in together.metrics.collect()}
    assert len(scores) == 2 * len(folds) > 2
    for fold in folds:
        alone = runner.run_fold(df, fold, features)
        for r in alone.metrics.collect():
            assert scores[fold.fold, r.split] == pytest.approx(r.asDict()) and list(scores[fold.fold, r.split]) == alone.metrics.columns
        audit, settings = together.audits[fold.fold], together.settings[fold.fold]
        assert audit.keys() == alone.audit.keys() and {k: v for k, v in audit.items() if k not in ("correlations", "reconstruction_r2")} == {k: v for k, v in alone.audit.items() if k not in ("correlations", "reconstruction_r2")}
        assert audit["correlations"] == pytest.approx(alone.audit["correlations"]) and audit["reconstruction_r2"] == pytest.approx(alone.audit["reconstruction_r2"])
        assert settings.medians == pytest.approx(alone.medians) and (settings.shrink, settings.ridge.alpha) == (alone.shrink, alone.alpha)
    with pytest.raises(LeakageViolation, match="stand in"):  # in the training part of the last fold alone
        runner.run_folds(df.withColumn("x", F.when(F.col("period") > folds[0].train_end, F.col("target"))), folds, features)
    with pytest.raises(ValueError):
        runner.run_folds(df.drop("z"), folds, features)


def test_fold_runner_query_does_not_run_jobs_for_each_fold(spark, monkeypatch):
    from tessera.operators import runner
    from tessera.plans import queries as Q

    def refused(*_, **__):
        raise AssertionError("a run of one fold")

    monkeypatch.setattr(runner, "run_fold", refused)
    monkeypatch.setattr(Q, "PERIODS", Q.PERIODS[:2])
    assert Q.QUERIES["fold_runner"](spark, "/root/testdata/sf0.001").count() == 4


def test_fold_runner_with_both_models(spark):
    from pyspark.sql import functions as F

    from tessera.operators import panel as P, runner

    df = P.with_lags(panel(spark).withColumn("z", F.col("target") * 0.05 + F.col("period") % 7))
    fold = L.walk_forward(FoldConfig(1, 24, 8, 2, 2))[-1]
    features = ["x", "z", "target_lag_2"]
    both = runner.run_fold(df, fold, features, models=runner.MODELS, forest={"depths": (2, 3), "leaves": (3,), "trees": 5})
    assert {(r.split, r.model) for r in both.metrics.collect()} == {(s, m) for s in ("val", "test") for m in runner.MODELS}
    assert both.predictions.filter("y_pred IS NULL").isEmpty()
    assert {r.n for r in both.predictions.groupBy("model").agg(F.count("y_pred").alias("n")).collect()} == {both.predictions.count() // 2}
    with pytest.raises(ValueError, match="unknown"):
        runner.run_fold(df, fold, features, models=("x",))


def test_candidates_of_imputation(spark):
    import numpy as np
    import pandas as pd

    df = panel(spark)
    frame = df.toPandas().sort_values(["entity_id", "period"])
    moments = {r.method: r for r in I.candidate_moments(df, {"x": 2}).collect()}
    filled = {
        "temporal": frame.groupby("entity_id")["x"].ffill(limit=2), "peers": frame["x"].fillna(frame.groupby(["entity_stratum", "period"])["x"].transform("mean")), "everyone": frame["x"].fillna(frame["x"].mean()),
    }
    for method, values in filled.items():
        got = moments[method]
        assert got.n == values.count() and got.mean == pytest.approx(values.mean()) and got.std == pytest.approx(values.std())
        assert got.mean_diff == pytest.approx(values.mean() - frame["x"].mean(), abs=1e-12) and got.applied == (method == "temporal")
    bias = {r.method: r for r in I.candidate_bias(I.candidate_moments(df, {"x": 2})).collect()}
    assert bias["everyone"].most_robust and bias["everyone"].mean_bias == pytest.approx(0, abs=1e-12) and sum(r.most_robust for r in bias.values()) == 1
    assert I.candidate_moments(df, {"x": 2}, least=10**6).isEmpty() and I.candidate_moments(df.limit(0), {"x": 2}).isEmpty()
    assert pd.notna(np.float64(moments["peers"].std_diff))


def test_leakage_inflates_scores(spark):
    import numpy as np

    from pyspark.sql import functions as F

    from tessera.operators import leakage as K

    rng = random.Random(3)
    rows = [(f"e{e}", p, 40 + rng.gauss(0, 5), rng.gauss(0, 1)) for e in range(20) for p in range(1, 25)]
    df = spark.createDataFrame(rows, "entity_id string, period int, target double, x double").withColumn("near", F.col("target") + F.col("x") * 0.01)
    folds = L.walk_forward(FoldConfig(1, 24, 8, 2, 2))
    scores = K.inflated_scores(df, folds, ["x"], ["near"], F.col("period") % 3, 3)
    frame = df.toPandas()

    def ridge(train, test, features):
        x, y = train[features].to_numpy(), train["target"].to_numpy()
        centred = x - x.mean(0)
        w = np.linalg.solve(centred.T @ centred + np.eye(len(features)), centred.T @ (y - y.mean()))
        e = test["target"].to_numpy() - (y.mean() + (test[features].to_numpy() - x.mean(0)) @ w)
        return 1 - (e @ e) / ((test["target"] - test["target"].mean()) ** 2).sum(), np.abs(e).mean()

    wanted = {("clean", f.fold): ridge(frame[frame.period.between(f.train_start, f.train_end)], frame[frame.period.between(f.test_start, f.test_end)], ["x"]) for f in folds}
    wanted |= {("leaked", k): ridge(frame[frame.period % 3 != k], frame[frame.period % 3 == k], ["x", "near"]) for k in range(3)}
    got = {(r.setting, r.fold): (r.r2, r.mae) for r in scores.collect()}
    assert got.keys() == wanted.keys() and all(got[k] == pytest.approx(wanted[k], rel=1e-6) for k in wanted)
    row = K.inflation(scores).first()
    assert (row.clean_folds, row.leaked_folds) == (len(folds), 3) and row.r2_inflation > 0.9 and row.mae_reduction > 3


def test_sample_and_cache(spark, tmp_path):
    from tessera.operators import panel as P

    df = panel(spark)
    assert sorted(P.validation_sample(df, 20).collect()) == sorted(P.validation_sample(df.repartition(7), 20).collect())
    file = tmp_path / "a.json"
    assert not G.cache_is_valid([file])
    file.write_text("x")
    assert G.cache_is_valid([file]) and not G.cache_is_valid([file], most_hours=0)
    assert G.cache_is_valid([file], {"a.json": G.file_digest(file)}) and not G.cache_is_valid([file], {"a.json": "0"})
