"""The four baselines of all folds from one cube of running sums.

The panel is read once: each entity becomes one row that holds, for every period from its first on, the number and the sum of its targets so far and the last of them.
What any fold's history holds at any cutoff is then a difference of two entries, so neither folds nor cutoffs multiply the panel.  A row is as long as the panel has
periods.  The cube is read twice: once for totals by cutoff and by period, which are as many as folds and periods and go to the driver, and once for the forecasts.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tessera.config import PanelConfig
from tessera.operators.folds import Fold
from tessera.sources.staging import stage

MODELS = ("global_mean", "linear_trend", "naive_with_lag", "cross_entity")
CUT = "struct<fold:int,split:string,period:int,before:int,upto:int,later_before:int,later_upto:int>"
ANSWERS = "fold int, split string, _period int, global_mean double, linear_trend double, _mean double, _others double, _entities long"


def entity_cube(panel: DataFrame, last: int, config: PanelConfig = PanelConfig()) -> DataFrame:
    """``<entity>, _first, _states``: for each period from the entity's first to ``last`` a state ``(t, n, s, y)``.

    ``n`` and ``s`` count and add its targets up to the period, ``y`` is the latest of them and ``t`` that one's period.
    """
    rows = panel.filter(F.col(config.target).isNotNull() & (F.col(config.period) <= last)).select(
        config.entity, F.col(config.period).cast("int").alias("t"), F.col(config.target).cast("double").alias("y")
    )
    order = W.partitionBy(config.entity).orderBy("t")
    past = order.rowsBetween(W.unboundedPreceding, 0)
    steps = rows.select(
        config.entity, "t", F.lead("t", 1, last + 1).over(order).alias("until"),
        F.struct("t", F.count("y").over(past).alias("n"), F.sum("y").over(past).alias("s"), "y").alias("state"),
    )
    held = steps.groupBy(config.entity).agg(F.sort_array(F.collect_list(F.struct("t", "until", "state"))).alias("_steps"))
    states = F.flatten(F.transform("_steps", lambda x: F.array_repeat(x["state"], x["until"] - x["t"])))
    return held.select(config.entity, F.get("_steps", F.lit(0))["t"].alias("_first"), states.alias("_states"))


def _cuts(folds: Sequence[Fold], lag: int) -> list[dict]:
    """One entry for each scored period of each fold, with the two stretches of history that lie ``lag`` periods before it."""
    out = []
    for f in folds:
        for split, start, end in (("val", f.val_start, f.val_end), ("test", f.test_start, f.test_end)):
            for period in range(start, end + 1):
                cut = {"fold": f.fold, "split": split, "period": period, "before": f.train_start - 1, "upto": min(period - lag, f.train_end)}
                if split == "test":
                    cut |= {"later_before": f.val_start - 1, "later_upto": min(period - lag, f.val_end)}
                out.append(cut)
    return out


def _reached(cuts: list[dict]) -> Column:
    """For each cut: the entity's row of that period, and number, sum and latest of its history there."""
    state = lambda period: F.get(F.col("_states"), period - F.col("_first"))
    held = F.transform(
        F.from_json(F.lit(json.dumps(cuts)), f"array<{CUT}>"),
        lambda c: F.struct(c["fold"].alias("fold"), c["split"].alias("split"), c["period"].alias("period"), state(c["period"]).alias("at"), state(c["before"]).alias("a"),
                           state(c["upto"]).alias("b"), state(c["later_before"]).alias("c"), state(c["later_upto"]).alias("d")),
    )
    zero = F.lit(0)
    count = lambda x, lo, hi: F.greatest(F.coalesce(x[hi]["n"], zero) - F.coalesce(x[lo]["n"], zero), zero)
    total = lambda x, lo, hi: F.coalesce(x[hi]["s"], F.lit(0.0)) - F.coalesce(x[lo]["s"], F.lit(0.0))
    within = lambda x, lo, hi: F.when(count(x, lo, hi) > 0, total(x, lo, hi)).otherwise(0.0)
    return F.transform(held, lambda x: F.struct(
        x["fold"].alias("fold"), x["split"].alias("split"), x["period"].alias("period"), F.when(x["at"]["t"] == x["period"], x["at"]["y"]).alias("y_true"),
        F.try_divide(within(x, "a", "b") + within(x, "c", "d"), count(x, "a", "b") + count(x, "c", "d")).alias("own"),
        F.when(count(x, "c", "d") > 0, x["d"]["y"]).when(count(x, "a", "b") > 0, x["b"]["y"]).alias("latest"),
    ))


def _line(periods: np.ndarray, n: np.ndarray, s: np.ndarray) -> tuple[float | None, float]:
    """Mean, and slope about the mean period, of rows given by their counts and sums by period."""
    if not n.sum():
        return None, 0.0
    away = periods - (n @ periods) / n.sum()
    spread = float(n @ away**2)
    return float(s.sum() / n.sum()), float(s @ away / spread) if spread else 0.0


def _answers(totals: list, folds: Sequence[Fold]) -> list[tuple]:
    """What forecasts share: by fold and scored period the training mean, the trend's value, the history's mean, and sum and number of entity means."""
    by_period = sorted((r["period"], r["n"], r["s"]) for r in totals if r["fold"] is None)
    periods, n, s = (np.array([r[i] for r in by_period], float) for i in range(3))
    found = {(r["fold"], r["split"], r["period"]): (r["s"], r["n"]) for r in totals if r["fold"] is not None}
    scored = defaultdict(list)
    for fold, split, period in found:
        scored[fold, split].append(period)
    out = []
    for f in folds:
        train = (periods >= f.train_start) & (periods <= f.train_end)
        mean, slope = _line(periods[train], n[train], s[train])
        middle = float(n[train] @ periods[train] / n[train].sum()) if n[train].sum() else 0.0
        for split in ("val", "test"):
            held = train | ((periods >= f.val_start) & (periods <= f.val_end)) if split == "test" else train
            history = float(s[held].sum() / n[held].sum()) if n[held].sum() else None
            for period in scored[f.fold, split]:
                others, entities = found[f.fold, split, period]
                out.append((f.fold, split, period, mean, None if mean is None else mean + slope * (period - middle), history, others, entities))
    return out


def all_folds(panel: DataFrame, folds: Sequence[Fold], lag: int = 2, config: PanelConfig = PanelConfig()) -> DataFrame:
    """``fold, split, model, <keys>, y_true, y_pred`` of the four baselines for the validation and test rows that have a target.

    The models are those of ``baselines``.  An entity has one row for each period; of repeated rows the last in the window's order counts as the
    row of its period.  Targets are null or finite.  A forecast is null where nothing may be learnt from.  An empty panel gives no rows.
    """
    cuts = _cuts(folds, lag)
    last = max(max(f.train_end, f.val_end, f.test_end) for f in folds)
    cube = stage(entity_cube(panel, last, config), "baseline-cube")
    reached = _reached(cuts)
    nobody = F.lit(None)
    parts = F.concat(
        F.transform(reached, lambda x: F.struct(x["fold"].alias("fold"), x["split"].alias("split"), x["period"].alias("period"), x["own"].alias("s"))),
        F.transform(
            F.filter(F.transform("_states", lambda x, i: F.struct(x.alias("x"), (x["t"] == F.col("_first") + i).alias("own"))), lambda z: z["own"]),
            lambda z: F.struct(nobody.cast("int").alias("fold"), nobody.cast("string").alias("split"), z["x"]["t"].alias("period"), z["x"]["y"].alias("s")),
        ),
    )
    # as many rows as folds have scored periods, and as the panel has periods
    totals = cube.select(F.explode(parts).alias("p")).select("p.*").groupBy("fold", "split", "period").agg(F.sum("s").alias("s"), F.count("s").alias("n")).collect()
    shared = F.broadcast(panel.sparkSession.createDataFrame(_answers(totals, folds), ANSWERS))
    rows = cube.select(config.entity, F.explode(F.filter(reached, lambda x: x["y_true"].isNotNull())).alias("x")).select(
        config.entity, F.col("x.fold").alias("fold"), F.col("x.split").alias("split"), F.col("x.period").alias("_period"), "x.y_true", "x.own", "x.latest"
    )
    others = F.try_divide(F.col("_others") - F.coalesce("own", F.lit(0.0)), F.col("_entities") - F.col("own").isNotNull().cast("int"))
    predictions = dict(zip(MODELS, (F.col("global_mean"), F.col("linear_trend"), F.coalesce("latest", "_mean"), F.coalesce(others, "_mean"))))
    answers = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), p.alias("y_pred")) for m, p in predictions.items()]))
    return (
        rows.join(shared, ["fold", "split", "_period"]).withColumn("_answer", answers)
        .select("fold", "split", "_answer.model", config.entity, F.col("_period").alias(config.period), "y_true", "_answer.y_pred")
    )
