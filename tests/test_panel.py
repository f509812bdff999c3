import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.config import PanelConfig
from tessera.functions import expressions as E
from tessera.operators import aggregates as A, panel as P

SCHEMA = "entity_id string, entity_name string, entity_stratum string, period int, target double, x double"


def panel(spark, rows):
    return spark.createDataFrame([(e, e, "s", p, y, x) for e, p, y, x in rows], SCHEMA)


def test_symmetric_log(spark):
    values = [-1e6, -1000.0, -3.5, -1.0, -0.5, 0.0, 0.5, 1.0, 7.25, 1000.0, 1e6, None]
    got = spark.createDataFrame([(v,) for v in values], "v double").select(E.symmetric_log(F.col("v"))).collect()
    assert [r[0] for r in got] == [None if v is None else pytest.approx(math.copysign(math.log(abs(v) + 1), v)) for v in values]


def test_target_clip_and_numbers(spark):
    df = spark.createDataFrame([(-1.0, "1.5"), (0.0, "x"), (100.0, ""), (100.5, None), (None, "7")], "v double, t string")
    got = df.select(E.complement_rate(F.col("v")), E.clip(F.col("v"), 0, 100), E.numeric(F.col("t")), E.entity_text(E.numeric(F.col("t")))).collect()
    assert [tuple(r) for r in got] == [(None, 0.0, 1.5, "1"), (100.0, 0.0, None, None), (0.0, 100.0, None, None), (None, 100.0, None, None), (None, None, 7.0, "7")]


def test_lags_are_null_across_gaps(spark):
    years = {"AAA": range(2000, 2011), "BBB": [y for y in range(2000, 2011) if y != 2005], "CCC": range(2004, 2011)}
    rows = [(e, y, float(y % 7), None) for e, ys in years.items() for y in ys]
    got = P.with_lags(panel(spark, rows)).collect()
    value = {(e, y): v for e, y, v, _ in rows}
    assert len(got) == len(rows)
    assert all(r.target_lag_2 == value.get((r.entity_id, r.period - 2)) and r.target_lag_3 == value.get((r.entity_id, r.period - 3)) for r in got)


@pytest.mark.parametrize("limit", [1, 3])
def test_carry_reaches_its_limit(spark, limit):
    rows = [("a", 2000 + i, None, 10.0 if i == 0 else None) for i in range(14)]
    got = P.carry_forward(panel(spark, rows), {"x": limit}).filter("x = 10").count()
    assert got == 1 + limit


def test_carry_counts_rows_or_periods_and_never_crosses_entities(spark):
    rows = [("a", 1, None, 5.0), ("a", 4, None, None), ("b", 5, None, None)]
    df = panel(spark, rows)
    by = lambda how: {(r.entity_id, r.period): r.x for r in P.carry_forward(df, {"x": 1}, by=how).collect()}
    assert by("rows") == {("a", 1): 5.0, ("a", 4): 5.0, ("b", 5): None}
    assert by("periods") == {("a", 1): 5.0, ("a", 4): None, ("b", 5): None}


def test_previous_mean_and_peers(spark):
    rows = [("a", 1, None, 3.0), ("a", 2, None, None), ("a", 3, None, 6.0), ("a", 4, None, None), ("b", 2, None, 9.0)]
    df = panel(spark, rows)
    assert {r.period: r.x for r in P.fill_with_previous_mean(df, "x").filter("entity_id = 'a'").collect()} == {1: 3.0, 2: 3.0, 3: 6.0, 4: 4.5}
    assert {(r.entity_id, r.period): r.x for r in P.fill_with_peers(df, ["x"]).collect()}["a", 2] == 9.0


def test_pivot_round_trip(spark):
    rng = random.Random(0)
    cells = {(f"e{e}", p, k): rng.random() for e in range(4) for p in range(5) for k in "ab" if rng.random() < 0.7}
    long = spark.createDataFrame([(*k, v) for k, v in cells.items()] + [(None, 1, "a", 1.0)], "entity_id string, period int, indicator string, value double")
    wide = P.pivot_observations(long, ["entity_id", "period"], ["a", "b"])
    back = P.unpivot_panel(wide, ["entity_id", "period"], ["a", "b"]).collect()
    assert {(r.entity_id, r.period, r.indicator): r.value for r in back} == cells


def test_correlation_is_pairwise_and_null_when_undefined(spark):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=50), rng.normal(size=50)
    rows = [(float(a), float(b), 1.0) for a, b in zip(x, y)] + [(None, 5.0, 1.0), (7.0, None, 1.0)]
    got = spark.createDataFrame(rows, "x double, y double, c double").agg(E.correlation(F.col("x"), F.col("y")), E.correlation(F.col("x"), F.col("c"))).first()
    assert got[0] == pytest.approx(np.corrcoef(x, y)[0, 1]) and got[1] is None


def test_error_metrics(spark):
    y, p = [1.0, 2.0, 4.0], [1.5, 2.0, 3.0]
    rows = [("m", a, b) for a, b in zip(y, p)] + [("flat", 2.0, 1.0), ("flat", 2.0, 3.0)]
    got = {r.model: r for r in A.error_metrics(spark.createDataFrame(rows, "model string, y_true double, y_pred double"), ["model"], F.lit(2.0)).collect()}
    e = np.array(y) - np.array(p)
    assert got["m"].r2 == pytest.approx(1 - (e**2).sum() / ((np.array(y) - np.mean(y)) ** 2).sum())
    assert got["m"].wape == pytest.approx(abs(e).sum() / 7) and got["m"].mase == pytest.approx(abs(e).mean() / 2)
    assert got["flat"].r2 is None and got["flat"].mae == 1.0


def test_dependence_decays(spark):
    rng = np.random.default_rng(36)
    rows = []
    for e in range(30):
        v, base = 0.0, rng.normal(0, 5)
        for t in range(40):
            v = 0.6 * v + rng.normal()
            rows.append((f"e{e}", 2000 + t, float(base + v), None))
    df = panel(spark, rows)
    r = [x.r for x in A.residual_dependence(df, "target").orderBy("lag").collect()]
    assert r[0] > r[1] > r[2] and abs(r[0] - 0.55) < 0.12
    assert A.within_share(df, "target").first()[0] < 0.5
    assert A.residual_dependence(df.limit(3), "target").filter("r IS NOT NULL").count() == 0


def test_dimension_and_completeness(spark):
    df = spark.createDataFrame([("a", "old", None, 1, 1.0, None), ("a", "new", "s", 2, None, None)], SCHEMA)
    assert tuple(P.entity_dimension(df).first()) == ("a", "old", "s")
    assert [r.completeness for r in P.with_completeness(df, ["target", "x"]).orderBy("period").collect()] == [50.0, 0.0]
    assert PanelConfig().keys == ["entity_id", "period"]
