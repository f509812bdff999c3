import random

import pytest
from pyspark.sql import functions as F

from tessera.config import FoldConfig, ProtocolConfig
from tessera.operators import folds as L, models as M, prep, ridge_cube as R

FEATURES = ["x", "z", "steady"]
FOLDS = L.walk_forward(FoldConfig(1, 24, 8, 2, 2))


def panel(spark, seed=6, offset=0.0):
    rng = random.Random(seed)
    rows = []
    for e in range(30):
        level = rng.gauss(40, 8)
        for p in range(1 + e % 5 * 4, 25):
            if rng.random() < 0.8:
                x, z = rng.gauss(0, 3), rng.gauss(0, 1)
                y = None if rng.random() < 0.1 else level + 2 * x - z + rng.gauss(0, 1)
                rows.append((f"e{e}", p, y, None if rng.random() < 0.3 else offset + x, float("nan") if rng.random() < 0.1 else z, 5.0))
    return spark.createDataFrame(rows, "entity_id string, period int, target double, x double, z double, steady double")


def one_fold(df, fold):
    """The same model by the operators for a single fold."""
    parts = [L.split_of(df, fold, s).filter("target IS NOT NULL").replace(float("nan"), None) for s in L.SPLITS]
    medians = prep.train_statistics(parts[0], FEATURES)
    parts = [prep.impute(p, medians) for p in parts]
    scales = prep.scaler(parts[0], FEATURES)
    train, validation, test = (prep.scale(p, scales) for p in parts)
    model = M.choose_shrink(M.fit_hierarchical(train, FEATURES), validation, ProtocolConfig().shrinkage)
    return model, medians, scales, {(s, r.entity_id, r.period): r.y_pred for s, p in (("val", validation), ("test", test)) for r in model.predict(p).collect()}


@pytest.mark.parametrize("offset", [0.0, 1e6])
def test_all_folds_equal_each_fold_alone(spark, offset):
    df = panel(spark, offset=offset).cache()
    predictions, settings = R.all_folds(df, FOLDS, FEATURES)
    rows = predictions.collect()
    for fold in (FOLDS[0], FOLDS[-1]):
        model, medians, scales, wanted = one_fold(df, fold)
        got, found = settings[fold.fold], {(r.split, r.entity_id, r.period): r.y_pred for r in rows if r.fold == fold.fold}
        assert got.medians == medians and got.ridge.alpha == model.ridge.alpha and got.shrink == model.shrink
        assert got.ridge.weights == pytest.approx(model.ridge.weights, rel=1e-6, abs=1e-7)
        for x in FEATURES:
            assert got.scales[x] == pytest.approx(scales[x], rel=1e-7)
        assert found.keys() == wanted.keys() and all(found[k] == pytest.approx(wanted[k], rel=1e-8) for k in wanted)


def test_rolling_parts_and_new_entities(spark):
    """Training parts that do not start at the first period, and entities that only the test part has."""
    df = panel(spark)
    rolling = [L.Fold(0, 1, 10, 13, 14, 17, 18), L.Fold(1, 5, 12, 15, 16, 19, 20), L.Fold(2, 9, 16, 19, 20, 23, 24)]
    late = df.filter("period >= 17").withColumn("entity_id", F.concat(F.lit("late-"), "entity_id"))
    everything = df.union(late).cache()
    predictions, settings = R.all_folds(everything, rolling, FEATURES)
    rows = predictions.collect()
    assert any(r.entity_id.startswith("late-") for r in rows)
    for fold in rolling:
        model, _, _, wanted = one_fold(everything, fold)
        found = {(r.split, r.entity_id, r.period): r.y_pred for r in rows if r.fold == fold.fold}
        assert settings[fold.fold].overall == pytest.approx(model.overall)
        assert found.keys() == wanted.keys() and all(found[k] == pytest.approx(wanted[k], rel=1e-8) for k in wanted)


def test_jobs_do_not_grow_with_folds(spark):
    df, jobs = panel(spark).cache(), []
    df.count()
    for count in (3, len(FOLDS)):
        spark.sparkContext.setJobGroup(f"ridge-{count}", "")
        R.all_folds(df, FOLDS[-count:], FEATURES)[0].count()
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"ridge-{count}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert abs(jobs[1] - jobs[0]) <= 2 and jobs[1] < 60, jobs


def test_parts_that_teach_nothing(spark):
    df = panel(spark)
    with pytest.raises(ValueError, match="fold 0 has no observation"):
        R.all_folds(df.withColumn("x", F.when(F.col("period") > 12, F.col("x"))), FOLDS[:1], FEATURES)
    with pytest.raises(ValueError):
        R.all_folds(df.limit(0), FOLDS, FEATURES)
    # rows without an entity, repeated rows and extra columns with the names of internal ones
    odd = df.union(df.limit(7)).union(df.limit(5).withColumn("entity_id", F.lit(None).cast("string"))).withColumn("_segment", F.lit(1)).withColumn("_y", F.lit("a"))
    predictions, settings = R.all_folds(odd, FOLDS[-1:], FEATURES)
    fold = FOLDS[-1]
    scored = odd.filter(f"target IS NOT NULL AND (period BETWEEN {fold.val_start} AND {fold.val_end} OR period BETWEEN {fold.test_start} AND {fold.test_end})")
    assert predictions.count() == scored.count() and predictions.filter("y_pred IS NULL").isEmpty()
