import pytest

from tessera.config import FoldConfig, LeakageViolation
from tessera.operators import baselines as B, folds as L, gates as G

ANNUAL = FoldConfig(first=2000, last=2023, min_train=8, validation=2, test=2, gap=2)


def test_annual_folds():
    folds = L.walk_forward(ANNUAL)
    assert len(folds) == 9 and folds[0].train_end == 2007 == L.first_train_end(ANNUAL) and folds[-1].test_end == 2023
    assert all(f.train_start == 2000 for f in folds)
    L.check_folds(folds, ANNUAL)
    assert len(L.walk_forward(FoldConfig(2007, 2024, 5, 1, 1))) == 8
    with pytest.raises(ValueError):
        L.walk_forward(FoldConfig(2000, 2005, 8, 2, 2))


def test_limits_and_guards():
    limited = L.walk_forward(FoldConfig(2000, 2023, 8, 2, 2, most=3))
    assert limited == L.walk_forward(ANNUAL)[:3]
    assert L.walk_forward(FoldConfig(2000, 2023, 8, 2, 2, most=99)) == L.walk_forward(ANNUAL)
    for bad in (FoldConfig(2000, 2023, 0, 2, 2), FoldConfig(2000, 2023, 8, 2, 2, step=0), FoldConfig(2000, 2023, 8, 2, 2, gap=-1), FoldConfig(2000, 2023, 8, 2, 2, most=0)):
        with pytest.raises(ValueError):
            L.walk_forward(bad)
    with pytest.raises(LeakageViolation, match="shorter than 9"):
        L.check_folds(limited, FoldConfig(2000, 2023, 9, 2, 2))
    with pytest.raises(LeakageViolation, match="outside"):
        L.check_folds(L.walk_forward(ANNUAL), FoldConfig(2000, 2022, 8, 2, 2))


@pytest.mark.parametrize("fault", ["zero_gap", "overlap", "reversed"])
def test_faults_are_refused(fault):
    with pytest.raises(LeakageViolation):
        L.check_folds(G.inject(L.walk_forward(ANNUAL), fault), ANNUAL)


def test_other_violations():
    folds = L.walk_forward(ANNUAL)
    for bad, config in (([], ANNUAL), (folds[::-1], ANNUAL), (folds, FoldConfig(2000, 2023, 8, 2, 2, gap=2, embargo=3))):
        with pytest.raises(LeakageViolation):
            L.check_folds(bad, config)


def data(spark):
    rows = [(e, e, "s", y, float((ord(e[0]) % 5 + y * (i + 1)) % 11), float(y)) for i, e in enumerate(["ARG", "BRA", "CHL", "URY"]) for y in range(2000, 2024) if (i + y) % 9]
    return spark.createDataFrame(rows, "entity_id string, entity_name string, entity_stratum string, period int, target double, x double")


def test_parts_agree_with_filters(spark):
    df, folds = data(spark), L.walk_forward(ANNUAL)
    folded = L.materialise(df, folds)
    for f in (folds[0], folds[-1]):
        for s in L.SPLITS:
            one = sorted(map(tuple, L.split_of(df, f, s).collect()))
            assert one == sorted(tuple(r)[:6] for r in folded.filter(f"fold = {f.fold} AND split = '{s}'").collect())
            assert [tuple(r) for r in L.canonical(L.split_of(df, f, s)).collect()] == one


def test_canonical_refuses(spark):
    df = data(spark)
    for bad in (df.limit(0), df.union(df), df.selectExpr("entity_id", "entity_name", "entity_stratum", "period", "CAST(NULL AS DOUBLE) AS target", "x")):
        with pytest.raises(ValueError):
            L.canonical(bad)


def test_baselines_by_hand(spark):
    df, folds = data(spark), L.walk_forward(ANNUAL)[:2]
    rows = [tuple(r) for r in df.collect()]
    folded = L.materialise(df, folds)
    got = {(r.fold, r.split, r.model, r.entity_id, r.period): r.y_pred for r in B.all_baselines(folded).collect()}
    for f in folds:
        train = [r for r in rows if r[3] <= f.train_end]
        both = train + [r for r in rows if f.val_start <= r[3] <= f.val_end]
        for split, history, lo, hi in (("val", train, f.val_start, f.val_end), ("test", both, f.test_start, f.test_end)):
            for e, _, _, p, _, _ in (r for r in rows if lo <= r[3] <= hi):
                mean = lambda v: sum(v) / len(v)
                past = [r for r in history if r[3] <= p - 2]
                own = sorted((r[3], r[4]) for r in past if r[0] == e)
                others = [mean([r[4] for r in past if r[0] == o]) for o in {r[0] for r in past} - {e}]
                assert got[f.fold, split, "global_mean", e, p] == pytest.approx(mean([r[4] for r in train]))
                assert got[f.fold, split, "naive_with_lag", e, p] == pytest.approx(own[-1][1] if own else mean([r[4] for r in history]))
                assert got[f.fold, split, "cross_entity", e, p] == pytest.approx(mean(others))
    assert len(got) == 4 * folded.filter("split <> 'train'").count()


def test_cube_of_baselines_is_the_plain_ones(spark):
    import random

    from tessera.operators import baseline_cube as BC

    rng = random.Random(5)
    # sparse entities, one that begins late, one without any history, null targets, a null entity; training that starts after the first period
    rows = [(f"e{e}", p, rng.choice([None, rng.uniform(0, 100)]) if rng.random() < 0.8 else 50.0) for e in range(12) for p in range(1, 31) if rng.random() < 0.6]
    rows += [("late", p, 1.0 * p) for p in range(24, 31)] + [(None, p, 2.0 * p) for p in range(1, 31, 3)] + [("last", 30, 7.0)]
    df = spark.createDataFrame(rows, "entity_id string, period int, target double")
    folds = [L.Fold(0, 1, 8, 11, 13, 16, 18), L.Fold(1, 4, 14, 17, 19, 22, 25), L.Fold(2, 1, 20, 23, 26, 29, 30)]
    for lag in (1, 2, 5):
        key = lambda r: (r.fold, r.split, r.model, r.entity_id or "", r.period)
        got, want = (sorted(x.collect(), key=key) for x in (BC.all_folds(df, folds, lag), B.all_baselines(L.materialise(df, folds), lag)))
        assert [key(r) + (r.y_true,) for r in got] == [key(r) + (r.y_true,) for r in want] and len(got) > 200
        # the plain functions join by the entity, so they can't know a null entity's own past
        assert all(g.y_pred == pytest.approx(w.y_pred, rel=1e-9) for g, w in zip(got, want) if g.entity_id is not None)
    assert BC.all_folds(df.limit(0), folds).count() == 0


def test_gap_bands(spark):
    rows = [(f, m, s, v) for f in range(2) for m, val, test in (("a", 0.5, 0.4), ("b", 0.6, 0.42), ("c", 0.9, 0.2)) for s, v in (("val", val), ("test", test))]
    rows += [(7, "a", "val", 9.0), (7, "a", "test", None), (8, "d", "val", 1.0)]  # undefined in one part: left out
    gaps = B.generalisation_gaps(spark.createDataFrame(rows, "fold int, model string, split string, r2 double"))
    assert {r.model: (r.n_folds, r.band) for r in gaps.collect()} == {"a": (2, "within_target"), "b": (2, "moderate"), "c": (2, "high")}
    row = B.stability(gaps).first()
    assert row.mean_gap == pytest.approx((0.1 + 0.18 + 0.7) / 3) and (row.level, row.best) == ("low", "b")
    empty = B.stability(gaps.limit(0)).first()
    assert (empty.mean_gap, empty.level, empty.best) == (None, None, None)
