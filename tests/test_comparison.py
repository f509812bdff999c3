import json
import random
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.config import FoldConfig, LeakageViolation
from tessera.functions import statistics as S
from tessera.operators import comparison as C, folds as L, gates as G
from tessera.sources import readers as R, sinks as K

VECTOR = "fold int, model string, row int, entity string, y_true double, y_pred double"
RUN = "run_id int, phase string, architecture string, duration_s double"


def vectors(spark, rows):
    return spark.createDataFrame(rows, VECTOR)


BASE = [(0, "m", 0, "a", 1.0, 1.5), (0, "m", 1, "b", 2.0, None)]


@pytest.mark.parametrize("change, kind", [
    (lambda r: r, "equal"), (lambda r: r[:1], "misaligned"), (lambda r: [r[0], (0, "m", 1, "c", 2.0, None)], "misaligned"),
    (lambda r: [r[0], (0, "m", 1, "b", 2.5, None)], "misaligned"), (lambda r: [(0, "m", 0, "a", 1.0, 1.5 + 2**-52), r[1]], "divergent"), (lambda r: [], "disjoint"),
])
def test_prediction_kinds(spark, change, kind):
    got = C.compare_predictions(vectors(spark, BASE), vectors(spark, change(list(BASE)))).collect()
    assert [r.kind for r in got] == [kind]
    status = G.equivalence_gate({"x": vectors(spark, BASE), "y": vectors(spark, change(list(BASE)))})["status"]
    assert status == ("equivalent" if kind == "equal" else "violation")
    assert G.equivalence_gate({"x": vectors(spark, BASE)})["status"] == "insufficient_data"


def test_digests(spark):
    before, after = G.prediction_digest(vectors(spark, BASE)), G.prediction_digest(vectors(spark, [(0, "m", 0, "a", 1.0, 1.25), BASE[1], (1, "m", 0, "a", 1.0, 1.0)]))
    assert sorted(tuple(r) for r in G.digest_changes(before, after).collect()) == [(0, "m", "changed"), (1, "m", "appeared")]
    assert G.digest_changes(before, G.prediction_digest(vectors(spark, BASE[::-1]))).isEmpty()


def runs(spark):
    rng = np.random.default_rng(17)
    rows = [(r, p, a, float(f * (1 + 0.35 * abs(rng.normal())))) for r, p, (a, f) in product(range(10), C.PHASES, [("x", 1.0), ("y", 1.25), ("z", 1.1)])]
    return rows, spark.createDataFrame([*rows, (-1, "collection", "both", 5.0)], RUN)


def test_runs(spark):
    rows, df = runs(spark)
    assert C.comparable_rows(df, "xyz").count() == len(rows)
    with pytest.raises(ValueError):
        C.comparable_rows(df, "xy")
    got = {(r.phase, r.architecture): r for r in C.percentiles(df, ["phase", "architecture"], "duration_s").collect()}
    own = [v for _, p, a, v in rows if (p, a) == ("setup", "y")]
    assert [got["setup", "y"].p50, got["setup", "y"].p95, got["setup", "y"].p99] == pytest.approx(np.percentile(own, [50, 95, 99]))
    assert sorted(tuple(r) for r in C.pairs_of(C.comparable_rows(df, "xyz")).collect()) == [("x", "y"), ("x", "z"), ("y", "z")]


def test_adjusted_p_and_hodges_lehmann(spark):
    for seed in range(4):
        rng = random.Random(seed)
        p = [rng.random() for _ in range(13)]
        got = C.adjusted_p(spark.createDataFrame([(i, v) for i, v in enumerate(p)], "i int, p double")).orderBy("i").collect()
        assert [r.benjamini_hochberg for r in got] == pytest.approx(S.benjamini_hochberg(p))
        assert all(1 >= r.bonferroni >= r.benjamini_hochberg >= r.p - 1e-12 for r in got)
        hl = C.hodges_lehmann(spark.createDataFrame([("k", v) for v in p], "k string, v double"), ["k"], "v").first()[1]
        assert hl == pytest.approx(np.median([(a + b) / 2 for i, a in enumerate(p) for b in p[i:]]))


def test_decisions(spark):
    rows = [(-0.1, 0.1), (0.3, 0.5), (-0.5, -0.3), (0.1, 0.5), (None, 1.0)]
    got = [r[0] for r in spark.createDataFrame(rows, "lo double, hi double").select(C.equivalence(F.col("lo"), F.col("hi"), F.lit(0.2))).collect()]
    assert got == ["equivalent", "a_exceeds_b", "b_exceeds_a", "inconclusive", "insufficient_data"]


def test_resource_records(spark, tmp_path):
    record = {"run_id": 1, "phase": "setup", "architecture": "x", "is_warmup": False, "cpu_proc": {"mean": 10.0, "max": 20.0, "n": 3}, "rss_mb": {"mean": 5.0, "max": 6.0}, "io_read_mb": 1.0, "io_write_mb": 2.0}
    path = tmp_path / "log.jsonl"
    path.write_text("\n".join(json.dumps(r) for r in (record, {**record, "is_warmup": True, "io_read_mb": 100.0})))
    got = C.resource_summary(R.resource_records(spark, str(path))).first()
    assert (got.cpu_mean, got.cpu_max, got.read_mb, got.n) == (10.0, 20.0, 1.0, 1)
    unmarked = {k: v for k, v in record.items() if k != "is_warmup"}
    path.write_text(json.dumps(unmarked))
    with pytest.raises(ValueError):
        C.resource_summary(R.resource_records(spark, str(path)))


def test_wilcoxon_and_t_by_enumeration():
    rng = random.Random(1)
    d = [rng.uniform(-1, 2) for _ in range(9)]
    order = sorted(range(9), key=lambda i: abs(d[i]))
    ranks = {i: k + 1 for k, i in enumerate(order)}
    observed = min(sum(ranks[i] for i in range(9) if d[i] > 0), sum(ranks[i] for i in range(9) if d[i] < 0))
    as_small = sum(min(s := sum(k + 1 for k in range(9) if signs[k]), 45 - s) <= observed for signs in product([0, 1], repeat=9))
    assert S.wilcoxon(d) == (observed, pytest.approx(min(1, as_small / 2**9)))
    assert S.wilcoxon([0, 0]) == (None, None) and S.wilcoxon_floor(9) == 2 / 512
    # a t of 2.262 with 9 degrees of freedom has p = 0.05
    assert S._incomplete_beta(4.5, 0.5, 9 / (9 + 2.2621571628**2)) == pytest.approx(0.05, abs=1e-9)
    assert S.paired_t([1, 2], [0, 1]) == (None, None)


def test_bootstrap_and_effects():
    rng = np.random.default_rng(0)
    a, b = rng.normal(2, 1, 40), rng.normal(1, 1, 40)
    ci = S.bootstrap_ci(a, b, rounds=2000)
    assert ci["difference"][0] < (a - b).mean() < ci["difference"][1] and ci["ratio"][0] < a.mean() / b.mean() < ci["ratio"][1]
    low, high, how = S.bca_ci(a - b, rounds=2000)
    assert low < (a - b).mean() < high and how == "bca"
    assert S.bca_ci([1.0, 1.0])[2] == "zero_variance" and S.bca_ci([None])[2] == "no_data"
    assert S.cohens_dz([1, 1]) is None and 0 < S.hedges_g(a - b) < S.cohens_dz(a - b)
    assert 0.2 < S.wilcoxon_power(0.5, 9, draws=400) < 0.4
    assert S.anderson_darling(rng.normal(size=200)) < 0.9 < S.anderson_darling(rng.exponential(size=200))
    assert len(S.moving_blocks(10, 3, rng)) == 10


def test_artifacts_receipts_and_back_ends(spark, tmp_path):
    path = G.write_artifact(tmp_path / "a" / "folds.json", {"n": 1}, "r1")
    G.require_run([path], "r1")
    for bad in ([path, tmp_path / "none.json"], [path]):
        with pytest.raises(LeakageViolation):
            G.require_run(bad, "r2")
    good = {"run_id": "r1", "entries": [{"status": "ran"}]}
    G.check_receipts({"x": good}, "r1")
    for bad in (None, {"entries": [1]}, {**good, "run_id": "r0"}, {**good, "entries": []}, {**good, "entries": [{"status": "indeterminate"}]}):
        with pytest.raises(LeakageViolation):
            G.check_receipts({"x": bad}, "r1")
    config = FoldConfig(1, 30, 8, 2, 2)
    folds = L.walk_forward(config)
    G.check_back_ends({"a": folds, "b": list(folds)}, config)
    with pytest.raises(LeakageViolation):
        G.check_back_ends({"a": folds, "b": folds[1:]}, config)
    assert L.as_records(folds, config, "r1", (2, 3))[0]["information_horizon"] == 2
    before = G.snapshot(tmp_path)
    (tmp_path / "new").write_text("x")
    assert G.verify_snapshot(tmp_path, before) == ["new"]
    assert {r.file: r.sha256 for r in G.content_digests(spark, str(tmp_path / "new")).collect()} == {"new": G.file_digest(tmp_path / "new")}
    assert G.environment(spark)["spark"] == spark.version


def test_sinks(spark, tmp_path):
    df = vectors(spark, BASE)
    K.write_predictions(df, f"{tmp_path}/p")
    assert K.read_predictions(spark, f"{tmp_path}/p").count() == 2
    with pytest.raises(ValueError):
        K.write_predictions(df.union(df), f"{tmp_path}/q")
    table = spark.createDataFrame([("a_b", 1.23456, None)], "name string, v double, w int")
    assert K.markdown(table, 2).splitlines()[-1] == "| a_b | 1.23 |  |" and r"a\_b & 1.235 &" in K.latex(table, "50 %")
    K.write_csv(table, f"{tmp_path}/csv")
    assert [tuple(r) for r in spark.read.csv(f"{tmp_path}/csv", header=True).collect()] == [("a_b", "1.23456", None)]
    panel = spark.createDataFrame([("b", 1, 1.0), ("a", 2, float("nan")), ("a", 1, 3.0)], "entity_id string, period int, x double")
    K.write_panel(panel, f"{tmp_path}/panel")
    assert [tuple(r) for r in R.panel(spark, f"{tmp_path}/panel").orderBy("entity_id", "period").collect()] == [("a", 1, 3.0), ("a", 2, None), ("b", 1, 1.0)]
    K.write_panel(panel, f"{tmp_path}/parts", partition_by=["entity_id"])
    assert R.row_count(spark, f"{tmp_path}/parts") == 3 and R.panel(spark, f"{tmp_path}/parts", recursive=True).count() == 3


def test_readers(spark):
    record = {"country": {"id": "BR", "value": "Brazil"}, "indicator": {"id": "X", "value": "x"}, "date": "2001", "value": 3}
    got = R.observations_from_records(spark, [record, {**record, "value": None}]).collect()
    assert [tuple(r) for r in got] == [("BR", "Brazil", 2001, "X", "x", 3.0), ("BR", "Brazil", 2001, "X", "x", None)]
    raw = spark.createDataFrame([("1100015.0", "Total", "2010", "97,5", "90.5"), ("1100015.0", "Urban", "2010", "1", "1")], "id string, scope string, year string, a string, em string")
    row = R.adapt_census(raw, {"id": "entity_id", "year": "period"}, "em", scope="scope").first()
    assert (row.entity_id, row.period, row.a, row.target_source) == ("1100015", 2010, None, 9.5)
    assert R.sniff_header([["x"], ["a ", "b"], ["1", "2"]], ["a", "b"]) == 1
    calls = []

    def opener(url):
        calls.append(url)
        raise OSError

    waits = []
    with pytest.raises(OSError):
        R.fetch("http://x", attempts=3, opener=opener, sleep=waits.append)
    assert len(calls) == 3 and waits == [1.0, 2.0]


def test_walsh_median_without_pairs():
    import time

    from tessera.functions.statistics import walsh_median

    rng = np.random.default_rng(6)
    for n in (1, 2, 3, 10, 57, 400):
        for x in (rng.normal(size=n), rng.integers(0, 4, n).astype(float), np.full(n, 0.1)):
            i, j = np.triu_indices(n)
            assert walsh_median(x) == pytest.approx(np.median((x[i] + x[j]) / 2), abs=1e-12)
    began = time.perf_counter()
    large = rng.normal(size=100_000)
    assert abs(walsh_median(large) - np.mean(large)) < 0.01
    assert time.perf_counter() - began < 30
