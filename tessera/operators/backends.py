"""The same forecasts in three Spark idioms, which must agree: DataFrame expressions, SQL text and pandas by group."""

from __future__ import annotations

from abc import ABC, abstractmethod

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tessera.config import PanelConfig
from tessera.operators import baselines as B


class BackEnd(ABC):
    """Baseline forecasts of a folded panel; subclasses enter the registry by name."""

    registry: dict[str, type[BackEnd]] = {}
    name = ""

    def __init_subclass__(cls, **more):
        super().__init_subclass__(**more)
        if not cls.name:
            raise TypeError("a back end needs a name")
        if cls.name in BackEnd.registry:
            raise ValueError(f"the back end {cls.name} is registered already")
        BackEnd.registry[cls.name] = cls

    def __init__(self, config: PanelConfig = PanelConfig(), lag: int = 2):
        self.config, self.lag = config, lag

    @abstractmethod
    def naive_with_lag(self, folded: DataFrame) -> DataFrame:
        """``fold, split, model, <keys>, y_true, y_pred``."""

    @abstractmethod
    def global_mean(self, folded: DataFrame) -> DataFrame:
        """``fold, split, model, <keys>, y_true, y_pred``."""

    def forecasts(self, folded: DataFrame) -> DataFrame:
        return self.global_mean(folded).union(self.naive_with_lag(folded))


class DataFrameBackEnd(BackEnd):
    name = "dataframe"

    def naive_with_lag(self, folded: DataFrame) -> DataFrame:
        return B.naive_with_lag(folded, self.lag, self.config)

    def global_mean(self, folded: DataFrame) -> DataFrame:
        return B.global_mean(folded, self.config)


class SqlBackEnd(BackEnd):
    name = "sql"

    def _run(self, folded: DataFrame, body: str) -> DataFrame:
        c = self.config
        parts = f"""WITH f AS (SELECT fold, split, {c.entity} AS e, {c.period} AS p, {c.target} AS y FROM {{folded}} WHERE {c.target} IS NOT NULL),
        s AS (SELECT * FROM f WHERE split <> 'train'),
        h AS (SELECT fold, 'val' AS split, e, p, y FROM f WHERE split = 'train' UNION ALL SELECT fold, 'test' AS split, e, p, y FROM f WHERE split <> 'test')
        SELECT fold, split, model, e AS {c.entity}, p AS {c.period}, y_true, y_pred FROM ({body})"""
        return folded.sparkSession.sql(parts, folded=folded)

    def naive_with_lag(self, folded: DataFrame) -> DataFrame:
        return self._run(folded, f"""
        SELECT s.fold, s.split, 'naive_with_lag' AS model, s.e, s.p, first(s.y) AS y_true, coalesce(max_by(h.y, h.p), first(m.m)) AS y_pred
        FROM s JOIN (SELECT fold, split, avg(y) AS m FROM h GROUP BY fold, split) m ON m.fold = s.fold AND m.split = s.split
        LEFT JOIN h ON h.fold = s.fold AND h.split = s.split AND h.e = s.e AND h.p <= s.p - {self.lag} GROUP BY s.fold, s.split, s.e, s.p""")

    def global_mean(self, folded: DataFrame) -> DataFrame:
        return self._run(folded, """
        SELECT s.fold, s.split, 'global_mean' AS model, s.e, s.p, s.y AS y_true, m.m AS y_pred FROM s JOIN (SELECT fold, avg(y) AS m FROM f WHERE split = 'train' GROUP BY fold) m ON m.fold = s.fold""")


class PandasBackEnd(BackEnd):
    """A row holds one entity of one fold, a batch many such rows at once; means over entities come from the plan, so no row grows with the panel."""

    name = "pandas"

    def naive_with_lag(self, folded: DataFrame) -> DataFrame:
        c, lag = self.config, self.lag
        rows = folded.filter(F.col(c.target).isNotNull()).select("fold", "split", F.col(c.entity).alias("e"), F.col(c.period).cast("int").alias("p"), F.col(c.target).alias("y"))
        part = lambda name, used: rows.filter(F.col("split").isin(*used)).groupBy("fold").agg(F.avg("y").alias(name))
        # one row for each entity of a fold, in the order of periods
        held = rows.groupBy("fold", "e").agg(F.sort_array(F.collect_list(F.struct("p", "split", "y"))).alias("r")).select("fold", "e", "r.p", "r.split", "r.y")
        held = held.join(F.broadcast(part("val", ["train"])), "fold", "left").join(F.broadcast(part("test", ["train", "val"])), "fold", "left")

        def forecast(batches):
            for batch in batches:
                # the place in the batch stands for fold and entity
                at = np.repeat(np.arange(len(batch)), batch["p"].str.len())
                flat = pd.DataFrame({"at": at, "p": np.concatenate(batch["p"].to_numpy()), "split": np.concatenate(batch["split"].to_numpy()), "y": np.concatenate(batch["y"].to_numpy())})
                flat = flat.sort_values("p", kind="stable")
                for split, used in (("val", ["train"]), ("test", ["train", "val"])):
                    asked, past = flat[flat["split"] == split], flat[flat["split"].isin(used)]
                    met = pd.merge_asof(asked, pd.DataFrame({"at": past["at"], "p": past["p"] + lag, "y_pred": past["y"]}), on="p", by="at")
                    owner = batch.iloc[met["at"]].reset_index(drop=True)
                    yield pd.DataFrame({"fold": owner["fold"], "split": split, "e": owner["e"], "p": met["p"], "y_true": met["y"], "y_pred": met["y_pred"].fillna(owner[split])})

        found = held.mapInPandas(forecast, "fold int, split string, e string, p int, y_true double, y_pred double")
        return found.select("fold", "split", F.lit("naive_with_lag").alias("model"), F.col("e").alias(c.entity), F.col("p").alias(c.period), "y_true", "y_pred")

    def global_mean(self, folded: DataFrame) -> DataFrame:
        c = self.config
        means = folded.filter("split = 'train'").groupBy("fold").agg(F.avg(c.target).alias("_m"))
        rows = folded.filter((F.col("split") != "train") & F.col(c.target).isNotNull()).join(F.broadcast(means), "fold")
        schema = f"fold int, split string, model string, {c.entity} string, {c.period} int, y_true double, y_pred double"

        def forecast(batches):
            for batch in batches:
                yield pd.DataFrame({"fold": batch["fold"], "split": batch["split"], "model": "global_mean", c.entity: batch[c.entity], c.period: batch[c.period], "y_true": batch[c.target], "y_pred": batch["_m"]})

        return rows.select("fold", "split", *c.keys, c.target, "_m").mapInPandas(forecast, schema)
