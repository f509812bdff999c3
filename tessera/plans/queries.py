"""Every operator as a query over the tables, with SQL that gives the same result."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tessera.config import FoldConfig, PanelConfig, ProtocolConfig
from tessera.functions.expressions import batch_stamp, complement_rate, portable_draw, symmetric_log
from tessera.operators import aggregates as A, backends as E, baseline_cube as BC, baselines as B, benchmark as N, comparison as C, folds as L, forest_cube as FC, imputation_checks as I, leakage as K, order as O, panel as P, prep, ridge_cube as RC, runner as R, selection as S
from tessera.plans import panels as D
from tessera.sources.readers import table
from tessera.sources.staging import stage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

CONFIG = PanelConfig()
DAYS = FoldConfig(first=1, last=30, min_train=8, validation=2, test=2, gap=2)
PERIODS = L.walk_forward(DAYS)


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six decimals, without negative zero or NaN."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)]
    return df.withColumns({c: F.round(F.when(~F.isnan(c), F.col(c)), 6) + F.lit(0.0) for c in floats}) if floats else df


def query(name: str, sql: str | None = None):
    """Register a query; its doubles are rounded in both engines."""
    def register(function):
        QUERIES[name] = lambda spark, folder: rounded(function(spark, folder))
        if sql is not None:
            SQL[name] = sql
        return function

    return register


def r6(*names: str) -> str:
    return ", ".join(f"round(CASE WHEN isnan(CAST({n} AS DOUBLE)) THEN NULL ELSE CAST({n} AS DOUBLE) END, 6) + 0.0 AS {n}" for n in names)


# ---- SQL parts that several queries share

T_DAY = f"p AS ({D.USER_DAY}), t AS (SELECT *, CASE WHEN target_source BETWEEN 0 AND 100 THEN 100.0::DOUBLE - target_source END AS target FROM p)"
T_MONTH = f"p AS ({D.NATION_MONTH}), t AS (SELECT *, CASE WHEN target_source BETWEEN 0 AND 100 THEN 100.0::DOUBLE - target_source END AS target FROM p)"
T_YEAR = T_MONTH.replace(D.NATION_MONTH, D.NATION_YEAR)
BOUNDS = ", ".join(f"({f.fold}, '{s}', {getattr(f, s + '_start')}, {getattr(f, s + '_end')})" for f in PERIODS for s in L.SPLITS)
FOLDED = f"{T_DAY}, b AS (SELECT * FROM (VALUES {BOUNDS}) AS v(fold, split, lo, hi)), f AS (SELECT t.*, CAST(fold AS INTEGER) AS fold, split FROM t JOIN b ON period BETWEEN lo AND hi)"


def day(spark, folder) -> DataFrame:
    return P.with_target(D.user_day(spark, folder))


def month(spark, folder) -> DataFrame:
    return P.with_target(D.nation_month(spark, folder))


def year(spark, folder) -> DataFrame:
    return P.with_target(D.nation_year(spark, folder))


def folded(spark, folder) -> DataFrame:
    """The panel, written once for all that the folds make of it, in all its folds."""
    return L.materialise(stage(day(spark, folder), "panel"), PERIODS)


# ---- scans and projections


@query("scan_panel", f"SELECT entity_id, entity_name, entity_stratum, period, {r6('target_source', *D.INDICATORS)} FROM ({D.USER_DAY})")
def _(spark, folder):
    return D.user_day(spark, folder)


@query("panel_nation_month", f"SELECT entity_id, entity_name, entity_stratum, period, {r6('target_source', 'avg_price', 'order_volume', 'avg_balance', 'urgent_rate')} FROM ({D.NATION_MONTH})")
def _(spark, folder):
    return D.nation_month(spark, folder)


@query("target_derivation", f"WITH {T_DAY} SELECT entity_id, period, {r6('target_source', 'target')} FROM t")
def _(spark, folder):
    return day(spark, folder).select("entity_id", "period", "target_source", "target")


@query("target_derivation_out_of_range", f"SELECT o_orderkey, {r6('target')} FROM (SELECT o_orderkey, CASE WHEN o_totalprice / 1000 - 50 BETWEEN 0 AND 100 THEN 100.0::DOUBLE - (o_totalprice / 1000 - 50) END AS target FROM orders)")
def _(spark, folder):
    return D.table(spark, folder, "orders").select("o_orderkey", complement_rate(F.col("o_totalprice") / 1000 - 50).alias("target"))


@query("source_coalesce_stratum", "SELECT n_name, coalesce(r_name, 'unclassified') AS entity_stratum FROM nation LEFT JOIN region ON n_regionkey = r_regionkey AND r_regionkey < 3")
def _(spark, folder):
    nation, region = D.table(spark, folder, "nation"), D.table(spark, folder, "region").filter("r_regionkey < 3")
    return nation.join(region, nation["n_regionkey"] == region["r_regionkey"], "left").select("n_name", F.coalesce("r_name", F.lit("unclassified")).alias("entity_stratum"))


@query("stratum_lookup", "SELECT n_nationkey, CASE n_regionkey WHEN 0 THEN 'low' WHEN 1 THEN 'middle' WHEN 2 THEN 'high' ELSE 'unknown' END AS stratum FROM nation")
def _(spark, folder):
    strata = F.create_map(*[F.lit(x) for k, v in {0: "low", 1: "middle", 2: "high"}.items() for x in (k, v)])
    return D.table(spark, folder, "nation").select("n_nationkey", F.coalesce(strata[F.col("n_regionkey")], F.lit("unknown")).alias("stratum"))


@query("symlog_first5", f"WITH {T_DAY} SELECT entity_id, period, {', '.join(f'round(sign({c}) * ln(abs({c}) + 1.0::DOUBLE), 6) + 0.0 AS {c}_log_transform' for c in D.INDICATORS)} FROM p")
def _(spark, folder):
    df = P.with_symmetric_logs(D.user_day(spark, folder), D.INDICATORS)
    return df.select("entity_id", "period", *[f"{c}_log_transform" for c in D.INDICATORS])


@query("symlog_signed", "SELECT s_suppkey, round(sign(s_acctbal - 5000) * ln(abs(s_acctbal - 5000) + 1.0::DOUBLE), 6) + 0.0 AS v FROM supplier")
def _(spark, folder):
    return D.table(spark, folder, "supplier").select("s_suppkey", symmetric_log(F.col("s_acctbal") - 5000).alias("v"))


CLIPPED = ["avg_value", "purchase_value"]


@query("bounds_clip", f"SELECT entity_id, period, {', '.join(f'round(CASE WHEN {c} < 20 THEN 20.0 WHEN {c} > 60 THEN 60.0 ELSE {c} END, 6) + 0.0 AS {c}' for c in CLIPPED)} FROM ({D.USER_DAY})")
def _(spark, folder):
    return P.clip_columns(D.user_day(spark, folder), CLIPPED, 20, 60).select("entity_id", "period", *CLIPPED)


@query("bounds_corrections", f"WITH p AS ({D.USER_DAY}) " + " UNION ALL ".join(f"SELECT '{c}' AS indicator, count(*) FILTER ({c} < 20) AS below, count(*) FILTER ({c} > 60) AS above FROM p" for c in CLIPPED))
def _(spark, folder):
    return P.corrections(D.user_day(spark, folder), CLIPPED, 20, 60)


PRESENT = " + ".join(f"({c} IS NOT NULL)::INT" for c in D.INDICATORS)


@query("completeness_score", f"SELECT entity_id, period, round(({PRESENT}) * 100.0::DOUBLE / {len(D.INDICATORS)}, 6) + 0.0 AS completeness FROM ({D.USER_DAY})")
def _(spark, folder):
    return P.with_completeness(D.user_day(spark, folder), D.INDICATORS).select("entity_id", "period", "completeness")


@query("lineage_columns", f"SELECT entity_id, period, 'events' AS data_source, 'batch' AS etl_batch_id, 'spark' AS processing_method FROM ({D.USER_DAY})")
def _(spark, folder):
    return P.with_lineage(D.user_day(spark, folder).select("entity_id", "period"), "events", "batch", "spark")


@query("batch_stamps", "SELECT event_id, 'events_' || strftime(ts, '%Y%m%d_%H%M%S') AS etl_batch_id FROM events")
def _(spark, folder):
    return P.with_lineage(table(spark, folder, "events"), "events", batch_stamp("events", F.col("ts")), "spark").select("event_id", "etl_batch_id")


# ---- reshape

CELLS = ", ".join(f"min(value) FILTER (indicator = '{t}') AS {t}" for t in D.TYPES)


@query("pivot_long_wide", f"WITH o AS ({D.OBSERVATIONS}), w AS (SELECT entity_id, period, {CELLS} FROM o GROUP BY ALL) SELECT entity_id, period, {r6(*D.TYPES)} FROM w")
def _(spark, folder):
    return P.pivot_observations(D.user_day_observations(spark, folder), ["entity_id", "period"], D.TYPES)


@query("unpivot_wide_long", f"WITH p AS ({D.USER_DAY}), u AS ({' UNION ALL '.join(f'SELECT entity_id, period, {chr(39)}{c}{chr(39)} AS indicator, {c} AS value FROM p' for c in D.INDICATORS)}) SELECT entity_id, period, indicator, {r6('value')} FROM u WHERE value IS NOT NULL")
def _(spark, folder):
    return P.unpivot_panel(D.user_day(spark, folder), ["entity_id", "period"], D.INDICATORS)


# ---- joins

LAGGED = "SELECT t.entity_id, t.period, t.target, a.target AS target_lag_2, b.target AS target_lag_3 FROM t LEFT JOIN t a ON a.entity_id = t.entity_id AND t.period = a.period + 2 LEFT JOIN t b ON b.entity_id = t.entity_id AND t.period = b.period + 3"


@query("lag_self_join", f"WITH {T_DAY}, x AS ({LAGGED}) SELECT entity_id, period, {r6('target', 'target_lag_2', 'target_lag_3')} FROM x")
def _(spark, folder):
    return P.with_lags(day(spark, folder)).select("entity_id", "period", "target", "target_lag_2", "target_lag_3")


@query("lag_gap_is_null", f"WITH {T_DAY}, x AS ({LAGGED}) SELECT period, count(*) FILTER (target_lag_2 IS NULL) AS no_lag_2, count(*) FILTER (target_lag_3 IS NULL) AS no_lag_3 FROM x GROUP BY period")
def _(spark, folder):
    return P.with_lags(day(spark, folder)).groupBy("period").agg(F.count_if(F.col("target_lag_2").isNull()).alias("no_lag_2"), F.count_if(F.col("target_lag_3").isNull()).alias("no_lag_3"))


@query("dim_entities", f"SELECT entity_id, arg_min(entity_name, period) AS entity_name, arg_min(entity_stratum, period) AS entity_stratum FROM ({D.USER_DAY}) GROUP BY entity_id")
def _(spark, folder):
    return P.entity_dimension(D.user_day(spark, folder))


@query("longitudinal_view", f"""WITH {T_MONTH}, d AS (SELECT CAST(n_nationkey AS VARCHAR) AS entity_id, n_name AS entity_name FROM nation),
g AS (SELECT entity_id, count(DISTINCT period) AS n_periods, min(period) AS first_period, max(period) AS last_period, avg(avg_price) AS avg_avg_price, avg(target) AS avg_target FROM t GROUP BY entity_id)
SELECT entity_id, entity_name, coalesce(n_periods, 0) AS n_periods, first_period, last_period, {r6('avg_avg_price', 'avg_target')} FROM d LEFT JOIN g USING (entity_id)""")
def _(spark, folder):
    dimension = D.table(spark, folder, "nation").select(F.col("n_nationkey").cast("string").alias("entity_id"), F.col("n_name").alias("entity_name"))
    return A.longitudinal(dimension, month(spark, folder), ["avg_price", "target"])


# ---- aggregates


@query("global_stats", f"WITH {T_DAY}, g AS (SELECT count(*) AS n_rows, count(DISTINCT entity_id) AS n_entities, count(DISTINCT period) AS n_periods, min(period) AS first_period, max(period) AS last_period, count(target) AS n_target, avg(target) AS mean, stddev_samp(target) AS std, min(target) AS least, max(target) AS most FROM t) SELECT n_rows, n_entities, n_periods, first_period, last_period, n_target, {r6('mean', 'std', 'least', 'most')} FROM g")
def _(spark, folder):
    return A.overview(day(spark, folder))


@query("quantile_sketch_merge", f"WITH {T_DAY}, g AS (SELECT entity_stratum, count(target) AS n FROM t GROUP BY 1) SELECT entity_stratum, n, CAST(fraction AS DOUBLE) AS fraction, true AS within_error FROM g, (VALUES (0.01), (0.25), (0.5), (0.75), (0.99)) AS v(fraction) WHERE n > 0")
def _(spark, folder):
    """Sketches by stratum and period, merged into those of strata; the SQL states that no estimate is off by more than 1 % of the ranks."""
    panel = stage(day(spark, folder), "panel")
    stored = stage(O.quantile_sketches(panel, ["entity_stratum", "period"], "target"), "sketches")
    estimates = O.sketched_quantiles(O.merged_sketches(stored, ["entity_stratum"]), ["entity_stratum"], [0.01, 0.25, 0.5, 0.75, 0.99])
    return O.rank_errors(panel, ["entity_stratum"], "target", estimates).select("entity_stratum", "n", "fraction", (F.col("rank_error") <= 0.01).alias("within_error"))


@query("target_profile", f"""WITH {T_DAY}, g AS (SELECT count(target) AS n_valid, count(*) - count(target) AS n_missing, count(target) * 100.0::DOUBLE / count(*) AS completeness, avg(target) AS mean, stddev_pop(target) AS std_pop, stddev_pop(target) / avg(target) AS variation,
quantile_cont(target, 0.25) AS q25, quantile_cont(target, 0.5) AS median, quantile_cont(target, 0.75) AS q75, quantile_cont(target, 0.75) - quantile_cont(target, 0.25) AS iqr, max(target) - min(target) AS spread, count(*) FILTER (target < 0 OR target > 100) AS n_out_of_range FROM t)
SELECT n_valid, n_missing, n_out_of_range, {r6('completeness', 'mean', 'std_pop', 'variation', 'q25', 'median', 'q75', 'iqr', 'spread')} FROM g""")
def _(spark, folder):
    return A.target_profile(day(spark, folder))


def keyed_sql(panel: str, key: str, value: str) -> str:
    return f"WITH {panel}, g AS (SELECT {key}, count({value}) AS n, avg({value}) AS mean, stddev_samp({value}) AS std, min({value}) AS least, max({value}) AS most FROM t GROUP BY {key}) SELECT {key}, n, {r6('mean', 'std', 'least', 'most')} FROM g"


@query("stats_by_period", keyed_sql(T_DAY, "period", "target"))
def _(spark, folder):
    return A.by_key(day(spark, folder), "period", "target")


@query("stats_by_entity", keyed_sql(T_DAY, "entity_id", "target"))
def _(spark, folder):
    return A.by_key(day(spark, folder), "entity_id", "target")


@query("agg_of_agg", f"WITH {T_DAY}, m AS (SELECT entity_id, avg(target) AS m FROM t GROUP BY 1), g AS (SELECT count(*) AS n_entities, min(m) AS least_mean, max(m) AS most_mean, stddev_samp(m) AS std_of_means, (SELECT entity_id FROM m ORDER BY m, entity_id LIMIT 1) AS least_entity, (SELECT entity_id FROM m ORDER BY m DESC, entity_id LIMIT 1) AS most_entity FROM m) SELECT n_entities, least_entity, most_entity, {r6('least_mean', 'most_mean', 'std_of_means')} FROM g")
def _(spark, folder):
    return A.spread_of_entities(day(spark, folder))


@query("entity_summary_view", f"WITH {T_MONTH}, g AS (SELECT entity_id, entity_stratum, avg(avg_price) AS avg_avg_price, avg(order_volume) AS avg_order_volume, count(*) AS n_rows FROM t GROUP BY 1, 2) SELECT entity_id, entity_stratum, n_rows, {r6('avg_avg_price', 'avg_order_volume')} FROM g")
def _(spark, folder):
    return A.entity_summary(month(spark, folder), ["avg_price", "order_volume"])


@query("coverage_view", f"WITH {T_MONTH}, g AS (SELECT entity_stratum, count(DISTINCT entity_id) AS n_entities, count(DISTINCT period) AS n_periods, avg(target) AS mean FROM t GROUP BY 1) SELECT entity_stratum, n_entities, n_periods, {r6('mean')} FROM g")
def _(spark, folder):
    return A.coverage_by_stratum(month(spark, folder), "target")


def missing_sql(key: str | None) -> str:
    k, group = (f"{key}, ", f" GROUP BY {key}") if key else ("", "")
    parts = " UNION ALL ".join(f"SELECT {k}count(*) AS n_rows, '{c}' AS indicator, count(*) - count({c}) AS n_missing, (count(*) - count({c}))::DOUBLE / count(*) AS missing_share FROM p{group}" for c in D.INDICATORS)
    return f"WITH p AS ({D.USER_DAY}), u AS ({parts}) SELECT {k}n_rows, indicator, n_missing, {r6('missing_share')} FROM u"


for _name, _key in (("null_accounting", None), ("missing_by_period", "period"), ("missing_by_stratum", "entity_stratum")):
    query(_name, missing_sql(_key))(lambda spark, folder, key=_key: A.missing_by(D.user_day(spark, folder), D.INDICATORS, key))

CORR = "CASE WHEN stddev_pop(x) > 0 AND stddev_pop(y) > 0 THEN covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)) END"


def corr_sql(rows: str, x: str, y: str) -> str:
    return f"(SELECT {CORR} FROM (SELECT CAST({x} AS DOUBLE) AS x, CAST({y} AS DOUBLE) AS y FROM {rows} WHERE {x} IS NOT NULL AND {y} IS NOT NULL))"


PAIRS = [(a, b) for i, a in enumerate(D.INDICATORS) for b in D.INDICATORS[i + 1 :]]
MARKS = f"k AS (SELECT {', '.join(f'({c} IS NULL)::INT AS {c}' for c in D.INDICATORS)} FROM p)"


@query("missing_corr", f"WITH {T_DAY}, {MARKS}, u AS ({' UNION ALL '.join(f'SELECT {corr_sql(chr(107), a, b)} AS r' for a, b in PAIRS)}) SELECT count(r) AS n_pairs, round(avg(abs(r)), 6) + 0.0 AS mean_abs_r, avg(abs(r)) < 0.3 AS at_random FROM u")
def _(spark, folder):
    return A.missingness_correlation(D.user_day(spark, folder), D.INDICATORS)


@query("feature_correlations", f"WITH {T_DAY} " + " UNION ALL ".join(f"SELECT '{c}' AS feature, round(coalesce(abs({corr_sql('t', c, 'target')}), 0), 6) + 0.0 AS r_abs, {corr_sql('t', c, 'target')} IS NULL AS undefined FROM (SELECT 1)" for c in D.INDICATORS))
def _(spark, folder):
    return A.target_correlations(day(spark, folder), D.INDICATORS)


@query("correlation_matrix", f"WITH {T_DAY}, k AS (SELECT * FROM p WHERE {' AND '.join(c + ' IS NOT NULL' for c in D.INDICATORS)}) " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round({corr_sql('k', a, b)}, 6) + 0.0 AS r" for a, b in PAIRS))
def _(spark, folder):
    return A.correlation_pairs(D.user_day(spark, folder), D.INDICATORS)


MONTHLY = ["avg_price", "order_volume", "avg_balance"]


@query("lag1_autocorr", f"WITH {T_MONTH}, k AS (SELECT *, {', '.join(f'lag({c}) OVER (PARTITION BY entity_id ORDER BY period) AS l_{c}' for c in MONTHLY)} FROM t) " + " UNION ALL ".join(f"SELECT '{c}' AS indicator, round({corr_sql('k', c, 'l_' + c)}, 6) + 0.0 AS r" for c in MONTHLY))
def _(spark, folder):
    return A.lag_autocorrelation(month(spark, folder), MONTHLY)


@query("lag1_autocorr_crossing", f"WITH {T_MONTH}, k AS (SELECT *, {', '.join(f'lag({c}) OVER (ORDER BY entity_id, period) AS l_{c}' for c in MONTHLY)} FROM t) " + " UNION ALL ".join(f"SELECT '{c}' AS indicator, round({corr_sql('k', c, 'l_' + c)}, 6) + 0.0 AS r" for c in MONTHLY))
def _(spark, folder):
    return A.lag_autocorrelation(month(spark, folder), MONTHLY, within_entities=False)


@query("frame_profile", f"WITH p AS ({D.USER_DAY}) " + " UNION ALL ".join(f"SELECT '{c}' AS indicator, round((count(*) - count({c})) * 100.0::DOUBLE / count(*), 6) + 0.0 AS missing_percent, coalesce(max({c}) - min({c}), 0) = 0 AS constant, count(*) FILTER (isinf({c})) AS n_infinite FROM p" for c in D.INDICATORS))
def _(spark, folder):
    return A.profile(D.user_day(spark, folder), D.INDICATORS)


@query("dup_key_check", "SELECT user_id, day, n FROM (SELECT user_id, CAST(day(ts) AS INTEGER) AS day, count(*) AS n FROM events GROUP BY ALL) WHERE n > 1")
def _(spark, folder):
    return A.duplicate_rows(D.table(spark, folder, "events").select("user_id", F.dayofmonth("ts").alias("day")), ["user_id", "day"])


@query("group_center", f"WITH {T_MONTH}, x AS (SELECT entity_id, period, target - avg(target) OVER (PARTITION BY entity_id) AS centred FROM t) SELECT entity_id, period, {r6('centred')} FROM x")
def _(spark, folder):
    return A.group_centred(month(spark, folder), "target").select("entity_id", "period", "centred")


@query("within_share", f"WITH {T_MONTH}, x AS (SELECT target, target - avg(target) OVER (PARTITION BY entity_id) AS centred FROM t) SELECT round(var_samp(centred) / var_samp(target), 6) + 0.0 AS within_share FROM x")
def _(spark, folder):
    return A.within_share(month(spark, folder), "target")


@query("residual_dependence", f"""WITH {T_MONTH}, x AS (SELECT entity_id, period, target - avg(target) OVER (PARTITION BY entity_id) AS c FROM t),
j AS (SELECT k.lag, a.c AS x, b.c AS y FROM x a JOIN (SELECT unnest(range(1, 7)) AS lag) k ON true JOIN x b ON b.entity_id = a.entity_id AND b.period = a.period - k.lag)
SELECT CAST(lag AS INTEGER) AS lag, count(*) AS n_pairs, round(CASE WHEN count(*) >= 30 THEN {CORR} END, 6) + 0.0 AS r FROM j GROUP BY lag""")
def _(spark, folder):
    return A.residual_dependence(month(spark, folder), "target")


@query("mase_scale", f"WITH {T_DAY}, x AS (SELECT target - lag(target) OVER (PARTITION BY entity_id ORDER BY period) AS c FROM t WHERE target IS NOT NULL) SELECT round(avg(abs(c)), 6) + 0.0 AS scale, count(c) AS n_changes FROM x")
def _(spark, folder):
    return A.mase_scale(day(spark, folder))


@query("shrunk_entity_means", f"WITH {T_DAY}, e AS (SELECT entity_id, count(target) AS n, avg(target) AS m FROM t GROUP BY 1) SELECT entity_id, n, round(n / (n + 5.0::DOUBLE) * m + (1 - n / (n + 5.0::DOUBLE)) * (SELECT avg(target) FROM t), 6) + 0.0 AS shrunken_mean FROM e")
def _(spark, folder):
    return A.shrunken_means(day(spark, folder))


# ---- windows and imputation


def carried(limit: int, by: str = "rows") -> str:
    at = "row_number() OVER w" if by == "rows" else "period"
    return f"""WITH p AS ({D.USER_DAY}), a AS (SELECT *, {at} AS pos FROM p WINDOW w AS (PARTITION BY entity_id ORDER BY period)),
b AS (SELECT *, pos - last_value(CASE WHEN purchase_value IS NOT NULL THEN pos END IGNORE NULLS) OVER w AS gap, last_value(purchase_value IGNORE NULLS) OVER w AS seen FROM a WINDOW w AS (PARTITION BY entity_id ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT entity_id, period, round(CASE WHEN gap <= {limit} THEN seen END, 6) + 0.0 AS purchase_value FROM b"""


for _limit, _by in ((1, "rows"), (3, "rows"), (2, "periods")):
    query(f"carry_forward_{_limit}_{_by}", carried(_limit, _by))(
        lambda spark, folder, n=_limit, by=_by: P.carry_forward(D.user_day(spark, folder), {"purchase_value": n}, by=by).select("entity_id", "period", "purchase_value")
    )


@query("since_observed", f"WITH p AS ({D.USER_DAY}), a AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY period) AS pos FROM p) SELECT entity_id, period, CAST(pos - last_value(CASE WHEN view_value IS NOT NULL THEN pos END IGNORE NULLS) OVER (PARTITION BY entity_id ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS INTEGER) AS distance FROM a")
def _(spark, folder):
    return P.with_row_position(D.user_day(spark, folder)).select("entity_id", "period", P.since_observed("view_value").alias("distance"))


@query("rolling_mean_prev3", f"WITH p AS ({D.USER_DAY}) SELECT entity_id, period, round(coalesce(signup_value, avg(signup_value) OVER (PARTITION BY entity_id ORDER BY period ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)), 6) + 0.0 AS signup_value FROM p")
def _(spark, folder):
    return P.fill_with_previous_mean(D.user_day(spark, folder), "signup_value").select("entity_id", "period", "signup_value")


for _how, _sql in (("median", "median"), ("mean", "avg")):
    query(f"stratum_period_{_how}", f"WITH p AS ({D.USER_DAY}) SELECT entity_id, period, round(coalesce(view_value, {_sql}(view_value) OVER (PARTITION BY entity_stratum, period)), 6) + 0.0 AS view_value FROM p")(
        lambda spark, folder, how=_how: P.fill_with_peers(D.user_day(spark, folder), ["view_value"], how).select("entity_id", "period", "view_value")
    )


@query("imputation_quality", f"""WITH p AS ({D.USER_DAY}), q AS (SELECT view_value AS a, coalesce(view_value, avg(view_value) OVER (PARTITION BY entity_stratum, period)) AS b FROM p)
SELECT 'view_value' AS indicator, 'events' AS category, count(*) FILTER (a IS NULL AND b IS NOT NULL) AS n_filled, round(count(*) FILTER (a IS NULL AND b IS NOT NULL)::DOUBLE / count(*) FILTER (a IS NULL), 6) + 0.0 AS fill_rate,
round((avg(b) - avg(a)) * 100 / abs(avg(a)), 6) + 0.0 AS bias_percent, round(var_samp(b) / var_samp(a), 6) + 0.0 AS variance_preserved FROM q""")
def _(spark, folder):
    df = D.user_day(spark, folder)
    return A.imputation_quality(df, P.fill_with_peers(df, ["view_value"], "mean"), ["view_value"], {"view_value": "events"})


@query("train_median_impute", f"WITH p AS ({D.USER_DAY}) SELECT entity_id, period, round(coalesce(view_value, (SELECT median(view_value) FROM p WHERE period <= 8)), 6) + 0.0 AS view_value FROM p WHERE period > 8")
def _(spark, folder):
    df = D.user_day(spark, folder)
    return prep.impute(df.filter("period > 8"), prep.train_statistics(df.filter("period <= 8"), ["view_value"])).select("entity_id", "period", "view_value")


@query("standard_scale", f"WITH {T_MONTH}, s AS (SELECT avg(avg_price) AS m, stddev_pop(avg_price) AS s FROM t WHERE period < 23980) SELECT entity_id, period, round((avg_price - m) / s, 6) + 0.0 AS avg_price FROM t, s WHERE period >= 23980")
def _(spark, folder):
    df = month(spark, folder)
    return prep.scale(df.filter("period >= 23980"), prep.scaler(df.filter("period < 23980"), ["avg_price"])).select("entity_id", "period", "avg_price")


# ---- folds

for _split in L.SPLITS:
    _f = PERIODS[3]
    query(f"fold_filter_{_split}", f"WITH {T_DAY} SELECT entity_id, period, {r6('target')} FROM t WHERE period BETWEEN {getattr(_f, _split + '_start')} AND {getattr(_f, _split + '_end')}")(
        lambda spark, folder, split=_split: L.split_of(day(spark, folder), PERIODS[3], split).select("entity_id", "period", "target")
    )


@query("fold_outside_gap", f"WITH {T_DAY} SELECT entity_id, period FROM t WHERE period BETWEEN 1 AND 20 AND NOT period BETWEEN 9 AND 12")
def _(spark, folder):
    return L.outside_gap(day(spark, folder), 1, 20, 9, 12).select("entity_id", "period")


@query("fold_bounds", f"""WITH p AS ({D.USER_DAY}), e AS (SELECT min(period) AS lo, max(period) AS hi FROM p), s AS (SELECT lo, unnest(range(lo + 8 + 2 + 2 * 2, hi - 2 + 2)) AS t FROM e),
k AS (SELECT CAST(row_number() OVER (ORDER BY t) - 1 AS INTEGER) AS fold, lo, t FROM s),
b AS (SELECT fold, 'train' AS split, lo AS a, t - 7 AS z FROM k UNION ALL SELECT fold, 'val', t - 4, t - 3 FROM k UNION ALL SELECT fold, 'test', t, t + 1 FROM k)
SELECT fold, split, CAST(a AS INTEGER) AS first_period, CAST(z AS INTEGER) AS last_period FROM b""")
def _(spark, folder):
    ends = day(spark, folder).agg(F.min("period").alias("first"), F.max("period").alias("last")).first()
    return L.fold_bounds(spark, L.walk_forward(replace(DAYS, first=ends["first"], last=ends["last"])))


@query("fold_bounds_limited", f"""WITH p AS ({D.USER_DAY}), e AS (SELECT min(period) AS lo, max(period) AS hi FROM p), s AS (SELECT lo, unnest(range(lo + 14, hi, 2)) AS t FROM e),
k AS (SELECT CAST(row_number() OVER (ORDER BY t) - 1 AS INTEGER) AS fold, lo, t FROM s ORDER BY t LIMIT 4)
SELECT fold, 'train' AS split, CAST(lo AS INTEGER) AS first_period, CAST(t - 7 AS INTEGER) AS last_period FROM k UNION ALL SELECT fold, 'val', CAST(t - 4 AS INTEGER), CAST(t - 3 AS INTEGER) FROM k
UNION ALL SELECT fold, 'test', CAST(t AS INTEGER), CAST(t + 1 AS INTEGER) FROM k""")
def _(spark, folder):
    ends = day(spark, folder).agg(F.min("period").alias("first"), F.max("period").alias("last")).first()
    config = replace(DAYS, first=ends["first"], last=ends["last"], step=2, most=4)
    folds = L.walk_forward(config)
    L.check_folds(folds, config)
    return L.fold_bounds(spark, folds)


@query("fold_counts", f"WITH {FOLDED}, g AS (SELECT fold, split, count(*) AS n_rows, count(DISTINCT entity_id) AS n_entities, count(target) AS n_target, avg(target) AS mean FROM f GROUP BY 1, 2) SELECT fold, split, n_rows, n_entities, n_target, {r6('mean')} FROM g")
def _(spark, folder):
    return L.fold_counts(folded(spark, folder))


@query("fold_warnings", f"WITH {FOLDED}, g AS (SELECT fold, split, count(*) AS n, count(DISTINCT entity_id) AS e, count(target) AS y FROM f GROUP BY 1, 2) SELECT fold, split, n < CASE split WHEN 'train' THEN 30 WHEN 'val' THEN 15 ELSE 10 END AS few_rows, e < (SELECT count(DISTINCT entity_id) FROM t) * 0.5 AS few_entities, y < n * 0.7 AS few_targets FROM g")
def _(spark, folder):
    entities = D.user_day(spark, folder).agg(F.count_distinct("entity_id")).first()[0]
    return L.fold_warnings(folded(spark, folder), entities)


@query("fold_union_summary", f"WITH {T_DAY} " + " UNION ALL ".join(f"SELECT '{s}' AS split, count(*) AS n_rows, round(avg(target), 6) + 0.0 AS mean FROM t WHERE period BETWEEN {getattr(PERIODS[0], s + '_start')} AND {getattr(PERIODS[0], s + '_end')}" for s in L.SPLITS))
def _(spark, folder):
    df = day(spark, folder)
    return reduce(DataFrame.union, [L.split_of(df, PERIODS[0], s).agg(F.lit(s).alias("split"), F.count(F.lit(1)).alias("n_rows"), F.avg("target").alias("mean")) for s in L.SPLITS])


@query("missing_cells_by_split", f"WITH {FOLDED} SELECT fold, split, CAST(sum((view_value IS NULL)::INT + (purchase_value IS NULL)::INT) AS BIGINT) AS n_missing FROM f GROUP BY 1, 2")
def _(spark, folder):
    return prep.missing_cells(folded(spark, folder), ["view_value", "purchase_value"], "fold", "split")


# ---- baselines

SCORED = "s AS (SELECT fold, split, entity_id, period, target AS y_true FROM f WHERE split <> 'train' AND target IS NOT NULL)"
HISTORY = "h AS (SELECT fold, 'val' AS split, entity_id, period, target AS y FROM f WHERE split = 'train' AND target IS NOT NULL UNION ALL SELECT fold, 'test', entity_id, period, target FROM f WHERE split <> 'test' AND target IS NOT NULL)"
BASE = {
    "global_mean": "SELECT s.*, m AS y_pred FROM s JOIN (SELECT fold, avg(target) AS m FROM f WHERE split = 'train' GROUP BY 1) USING (fold)",
    "linear_trend": "SELECT s.*, a + b * s.period AS y_pred FROM s JOIN (SELECT fold, regr_slope(target, period) AS b, regr_intercept(target, period) AS a FROM f WHERE split = 'train' GROUP BY 1) USING (fold)",
    "naive_with_lag": "SELECT s.*, coalesce((SELECT arg_max(y, h.period) FROM h WHERE h.fold = s.fold AND h.split = s.split AND h.entity_id = s.entity_id AND h.period <= s.period - 2), m) AS y_pred FROM s JOIN (SELECT fold, split, avg(y) AS m FROM h GROUP BY 1, 2) USING (fold, split)",
    "cross_entity": """SELECT s.*, coalesce(o.v, m) AS y_pred FROM s JOIN (SELECT fold, split, avg(y) AS m FROM h GROUP BY 1, 2) USING (fold, split) LEFT JOIN (
  WITH c AS (SELECT DISTINCT fold, split, period - 2 AS cut FROM s), e AS (SELECT h.fold, h.split, cut, entity_id, avg(y) AS own FROM h JOIN c ON h.fold = c.fold AND h.split = c.split AND h.period <= cut GROUP BY 1, 2, 3, 4)
  SELECT x.fold, x.split, x.entity_id, x.period, avg(e.own) AS v FROM s x JOIN e ON e.fold = x.fold AND e.split = x.split AND e.cut = x.period - 2 AND e.entity_id <> x.entity_id GROUP BY 1, 2, 3, 4
) o ON o.fold = s.fold AND o.split = s.split AND o.entity_id = s.entity_id AND o.period = s.period""",
}
ALL_BASE = " UNION ALL ".join(f"SELECT fold, split, '{k}' AS model, entity_id, period, y_true, y_pred FROM ({v})" for k, v in BASE.items())
METRICS = """SELECT fold, model, split, count(*) AS n, CASE WHEN var_pop(y_true) > 0 THEN 1 - sum((y_true - y_pred) ** 2) / (var_pop(y_true) * count(*)) END AS r2, avg((y_true - y_pred) ** 2) AS mse, sqrt(avg((y_true - y_pred) ** 2)) AS rmse,
avg(abs(y_true - y_pred)) AS mae, sum(abs(y_true - y_pred)) / greatest(sum(abs(y_true)), 1e-12) AS wape, avg(abs(y_true - y_pred)) / 10.0::DOUBLE AS mase FROM a GROUP BY 1, 2, 3"""


def scores(spark, folder) -> DataFrame:
    return A.error_metrics(BC.all_folds(day(spark, folder), PERIODS), ["fold", "model", "split"], F.lit(10.0))


for _name, _function in (("global_mean", B.global_mean), ("linear_trend", B.linear_trend), ("naive_with_lag", B.naive_with_lag), ("cross_entity", B.cross_entity)):
    query(f"baseline_{_name}", f"WITH {FOLDED}, {SCORED}, {HISTORY}, a AS ({BASE[_name]}) SELECT fold, split, '{_name}' AS model, entity_id, period, {r6('y_true', 'y_pred')} FROM a")(
        lambda spark, folder, function=_function: function(folded(spark, folder))
    )


@query("metrics_r2_rmse_wape_mase", f"WITH {FOLDED}, {SCORED}, {HISTORY}, a AS ({ALL_BASE}), g AS ({METRICS}) SELECT fold, model, split, n, {r6('r2', 'mse', 'rmse', 'mae', 'wape', 'mase')} FROM g")
def _(spark, folder):
    return scores(spark, folder)


BEST = "w AS (SELECT fold, model, max(r2) FILTER (split = 'val') AS val_r2, max(r2) FILTER (split = 'test') AS test_r2 FROM g GROUP BY 1, 2), x AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY val_r2 DESC, model) AS r, val_r2 - test_r2 AS generalisation_gap FROM w WHERE val_r2 IS NOT NULL)"


@query("best_baseline", f"WITH {FOLDED}, {SCORED}, {HISTORY}, a AS ({ALL_BASE}), g AS ({METRICS}), {BEST} SELECT fold, model, {r6('val_r2', 'test_r2', 'generalisation_gap')} FROM x WHERE r = 1")
def _(spark, folder):
    return B.best_by_validation(scores(spark, folder))


@query("predictability", f"WITH {FOLDED}, {SCORED}, {HISTORY}, a AS ({ALL_BASE}), g AS ({METRICS}), k AS (SELECT model, count(r2) AS n_folds, avg(r2) AS mean_r2, stddev_pop(r2) AS std_r2, min(r2) AS least_r2, max(r2) AS most_r2, CASE WHEN avg(r2) < 0 THEN 'none' WHEN avg(r2) < 0.05 THEN 'very_low' WHEN avg(r2) < 0.15 THEN 'low' WHEN avg(r2) < 0.35 THEN 'moderate' ELSE 'high' END AS level FROM g WHERE split = 'val' AND r2 IS NOT NULL GROUP BY 1) SELECT model, n_folds, level, {r6('mean_r2', 'std_r2', 'least_r2', 'most_r2')} FROM k")
def _(spark, folder):
    return B.predictability(scores(spark, folder))


GAPS = """q AS (SELECT fold, model, max(r2) FILTER (split = 'val') - max(r2) FILTER (split = 'test') AS d, max(r2) FILTER (split = 'test') AS t FROM g GROUP BY 1, 2),
v AS (SELECT model, count(d) AS n_folds, avg(d) AS mean_gap, stddev_pop(d) AS std_gap, avg(t) AS mean_test_r2 FROM q WHERE d IS NOT NULL GROUP BY 1)"""


@query("generalisation_gaps", f"WITH {FOLDED}, {SCORED}, {HISTORY}, a AS ({ALL_BASE}), g AS ({METRICS}), {GAPS} SELECT model, n_folds, {r6('mean_gap', 'std_gap', 'mean_test_r2')}, CASE WHEN abs(mean_gap) <= 0.15 THEN 'within_target' WHEN abs(mean_gap) <= 0.2 THEN 'moderate' ELSE 'high' END AS band FROM v")
def _(spark, folder):
    return B.generalisation_gaps(scores(spark, folder))


@query("gap_stability", f"""WITH {FOLDED}, {SCORED}, {HISTORY}, a AS ({ALL_BASE}), g AS ({METRICS}), {GAPS}, w AS (SELECT avg(mean_gap) AS mean_gap FROM v)
SELECT {r6('mean_gap')}, CASE WHEN abs(mean_gap) <= 0.05 THEN 'excellent' WHEN abs(mean_gap) <= 0.1 THEN 'good' WHEN abs(mean_gap) <= 0.15 THEN 'moderate' WHEN mean_gap IS NOT NULL THEN 'low' END AS level,
(SELECT model FROM v ORDER BY mean_test_r2 DESC, model LIMIT 1) AS best FROM w""")
def _(spark, folder):
    return B.stability(B.generalisation_gaps(scores(spark, folder)))


# ---- comparison of runs and predictions

KEYS = "phase, architecture"


@query("bench_percentiles", f"WITH b AS ({D.RUNS}) SELECT {KEYS}, count(duration_s) AS n, round(quantile_cont(duration_s, 0.5), 6) + 0.0 AS p50, round(quantile_cont(duration_s, 0.95), 6) + 0.0 AS p95, round(quantile_cont(duration_s, 0.99), 6) + 0.0 AS p99 FROM b GROUP BY ALL")
def _(spark, folder):
    return C.percentiles(D.runs(spark, folder), ["phase", "architecture"], "duration_s")


@query("bench_summary", f"WITH b AS ({D.RUNS}), g AS (SELECT {KEYS}, count(duration_s) AS n, avg(duration_s) AS mean, stddev_samp(duration_s) AS std, max(duration_s) AS most FROM b GROUP BY ALL) SELECT {KEYS}, n, {r6('mean', 'std', 'most')} FROM g")
def _(spark, folder):
    return C.run_summary(C.comparable_rows(D.runs(spark, folder), ["dataframe", "pandas", "sql"]))


@query("bench_totals", f"WITH b AS ({D.RUNS}) SELECT run_id, architecture, round(sum(duration_s), 6) + 0.0 AS total_s FROM b GROUP BY ALL")
def _(spark, folder):
    return C.run_totals(D.runs(spark, folder))


@query("paradigm_pairs", f"WITH b AS (SELECT DISTINCT architecture FROM ({D.RUNS})) SELECT x.architecture AS a, y.architecture AS b FROM b x JOIN b y ON x.architecture < y.architecture")
def _(spark, folder):
    return C.pairs_of(D.runs(spark, folder))


PAIRED = "j AS (SELECT x.run_id, x.phase, x.architecture AS a, y.architecture AS b, x.duration_s AS va, y.duration_s AS vb FROM b x JOIN b y ON x.run_id = y.run_id AND x.phase = y.phase AND x.architecture < y.architecture)"


@query("paired_diffs", f"WITH b AS ({D.RUNS}), {PAIRED}, g AS (SELECT phase, a, b, count(*) AS n, avg(va - vb) AS mean_difference, stddev_samp(va - vb) AS std_difference, avg(va - vb) / CASE WHEN stddev_samp(va - vb) > 0 THEN stddev_samp(va - vb) END AS d_z, avg(ln(va / vb)) AS mean_log_ratio FROM j GROUP BY ALL) SELECT phase, a, b, n, {r6('mean_difference', 'std_difference', 'd_z', 'mean_log_ratio')} FROM g")
def _(spark, folder):
    return C.paired_differences(D.runs(spark, folder), ["run_id", "phase"], "duration_s", ["phase"])


@query("speedup_pairs", f"WITH b AS ({D.RUNS}), m AS (SELECT {KEYS}, quantile_cont(duration_s, 0.5) AS v FROM b GROUP BY ALL) SELECT x.phase, x.architecture AS a, y.architecture AS b, round(x.v / y.v, 6) + 0.0 AS speedup_of_b FROM m x JOIN m y ON x.phase = y.phase AND x.architecture < y.architecture")
def _(spark, folder):
    return C.speedups(D.runs(spark, folder))


@query("fastest_backend", f"WITH b AS ({D.RUNS}), m AS (SELECT {KEYS}, avg(duration_s) AS mean FROM b GROUP BY ALL) SELECT phase, architecture AS winner, round(mean, 6) + 0.0 AS mean FROM (SELECT *, row_number() OVER (PARTITION BY phase ORDER BY mean, architecture) AS r FROM m) WHERE r = 1")
def _(spark, folder):
    return C.fastest(D.runs(spark, folder))


@query("stage_attribution", f"WITH b AS ({D.RUNS}), m AS (SELECT {KEYS}, sum(duration_s) AS seconds FROM b GROUP BY ALL) SELECT {KEYS}, round(seconds, 6) + 0.0 AS seconds, round(seconds / sum(seconds) OVER (PARTITION BY architecture), 6) + 0.0 AS share, round(seconds / min(seconds) OVER (PARTITION BY phase), 6) + 0.0 AS ratio_to_fastest FROM m")
def _(spark, folder):
    return C.stage_shares(D.runs(spark, folder))


@query("bench_pivot", f"WITH b AS ({D.RUNS}) SELECT run_id, phase, {', '.join(f'round(avg(duration_s) FILTER (architecture = {chr(39)}{a}{chr(39)}), 6) + 0.0 AS {a}' for a in ('dataframe', 'pandas', 'sql'))} FROM b GROUP BY run_id, phase")
def _(spark, folder):
    return D.runs(spark, folder).groupBy("run_id", "phase").pivot("architecture", ["dataframe", "pandas", "sql"]).avg("duration_s")




@query("bh_adjust", f"WITH b AS ({D.RUNS}), q AS (SELECT {KEYS}, run_id, round(duration_s * 0.7 - floor(duration_s * 0.7), 4) AS p FROM b), r AS (SELECT *, row_number() OVER (PARTITION BY architecture ORDER BY p, run_id, phase) AS k, count(*) OVER (PARTITION BY architecture) AS m FROM q) SELECT {KEYS}, run_id, round(p, 6) + 0.0 AS p, round(least(p * m, 1.0), 6) + 0.0 AS bonferroni, round(least(min(p * m / k) OVER (PARTITION BY architecture ORDER BY k DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1.0), 6) + 0.0 AS benjamini_hochberg FROM r")
def _(spark, folder):
    p = F.col("duration_s") * 0.7
    return C.adjusted_p(D.runs(spark, folder).select("phase", "architecture", "run_id", F.round(p - F.floor(p), 4).alias("p")), "p", ["architecture"])


@query("hodges_lehmann", f"WITH b AS ({D.RUNS}), n AS (SELECT *, row_number() OVER (PARTITION BY architecture ORDER BY duration_s) AS i FROM b) SELECT x.architecture, round(median((x.duration_s + y.duration_s) / 2), 6) + 0.0 AS hodges_lehmann FROM n x JOIN n y ON x.architecture = y.architecture AND x.i <= y.i GROUP BY 1")
def _(spark, folder):
    return C.hodges_lehmann(D.runs(spark, folder), ["architecture"], "duration_s")


DECIDED = "CASE WHEN lo >= -0.3 AND hi <= 0.3 THEN 'equivalent' WHEN lo > 0.3 THEN 'a_exceeds_b' WHEN hi < -0.3 THEN 'b_exceeds_a' ELSE 'inconclusive' END"


@query("equivalence_decision", f"WITH b AS ({D.RUNS}), {PAIRED}, g AS (SELECT phase, a, b, avg(va - vb) - 0.1 AS lo, avg(va - vb) + 0.1 AS hi FROM j GROUP BY ALL) SELECT phase, a, b, {DECIDED} AS decision, CASE {DECIDED} WHEN 'a_exceeds_b' THEN 'b' WHEN 'b_exceeds_a' THEN 'a' ELSE 'none' END AS advantage FROM g")
def _(spark, folder):
    found = C.paired_differences(D.runs(spark, folder), ["run_id", "phase"], "duration_s", ["phase"])
    decision = C.equivalence(F.col("mean_difference") - 0.1, F.col("mean_difference") + 0.1, F.lit(0.3))
    return found.select("phase", "a", "b", decision.alias("decision")).withColumn("advantage", C.advantage(F.col("decision"), F.lit(False)))


STORED = "SELECT fold, model, CAST(row_number() OVER (PARTITION BY fold, model ORDER BY entity_id, period) - 1 AS INTEGER) AS row, entity_id AS entity, y_true, y_pred FROM a WHERE split = 'test'"


@query("prediction_vectors", f"WITH {FOLDED}, {SCORED}, {HISTORY}, a AS ({ALL_BASE}), v AS ({STORED}) SELECT fold, model, row, entity, {r6('y_true', 'y_pred')} FROM v")
def _(spark, folder):
    return C.numbered_predictions(BC.all_folds(day(spark, folder), PERIODS).filter("split = 'test'"), "entity_id", "period")


@query("prediction_equivalence", f"""WITH {FOLDED}, {SCORED}, {HISTORY}, a AS (SELECT *, 'm' AS model FROM ({BASE['naive_with_lag']})), v AS ({STORED}),
o AS (SELECT * FROM v WHERE fold <> 2 AND NOT (fold = 3 AND row = 0)), w AS (SELECT fold, model, row, entity, y_true, CASE WHEN fold = 5 AND row < 3 THEN y_pred + 1 ELSE y_pred END AS y_pred FROM o),
x AS (SELECT coalesce(v.fold, w.fold) AS fold, coalesce(v.model, w.model) AS model, v.row IS NOT NULL AS ia, w.row IS NOT NULL AS ib, v.y_pred AS pa, w.y_pred AS pb FROM v FULL JOIN w ON v.fold = w.fold AND v.model = w.model AND v.row = w.row)
SELECT fold, model, count(*) FILTER (ia) AS rows_a, count(*) FILTER (ib) AS rows_b, count(*) FILTER (NOT (ia AND ib)) AS n_misaligned, count(*) FILTER (ia AND ib AND pa <> pb) AS n_divergent, round(max(abs(pa - pb)), 6) + 0.0 AS max_abs_difference,
CASE WHEN count(*) FILTER (ib) = 0 THEN 'disjoint' WHEN count(*) FILTER (NOT (ia AND ib)) > 0 THEN 'misaligned' WHEN count(*) FILTER (ia AND ib AND pa <> pb) > 0 THEN 'divergent' ELSE 'equal' END AS kind FROM x GROUP BY 1, 2""")
def _(spark, folder):
    left = C.numbered_predictions(B.naive_with_lag(folded(spark, folder)).filter("split = 'test'").withColumn("model", F.lit("m")), "entity_id", "period")
    right = left.filter("fold <> 2 AND NOT (fold = 3 AND row = 0)").withColumn("y_pred", F.when(F.expr("fold = 5 AND row < 3"), F.col("y_pred") + 1).otherwise(F.col("y_pred")))
    return C.compare_predictions(left, right)


for _kind in ("sql", "pandas"):
    _both = f"SELECT fold, split, model, entity_id, period, {r6('y_true', 'y_pred')} FROM (SELECT *, 'global_mean' AS model FROM ({BASE['global_mean']}) UNION ALL SELECT *, 'naive_with_lag' AS model FROM ({BASE['naive_with_lag']}))"
    query(f"backend_{_kind}", f"WITH {FOLDED}, {SCORED}, {HISTORY} {_both}")(
        lambda spark, folder, kind=_kind: E.BackEnd.registry[kind]().forecasts(folded(spark, folder))
    )

FILLED = f"p AS ({D.USER_DAY}), q AS (SELECT view_value AS a, coalesce(view_value, avg(view_value) OVER (PARTITION BY entity_stratum, period)) AS mean, coalesce(view_value, median(view_value) OVER (PARTITION BY entity_stratum, period)) AS median FROM p)"


@query("candidate_comparison", f"WITH {FILLED} " + " UNION ALL ".join(f"SELECT '{m}' AS method, count(*) - count({m}) AS n_missing, round(abs((avg({m}) - avg(a)) / avg(a)) * 100, 6) + 0.0 AS mean_shift_percent, round(abs((stddev_samp({m}) - stddev_samp(a)) / stddev_samp(a)) * 100, 6) + 0.0 AS std_shift_percent FROM q" for m in ("mean", "median")))
def _(spark, folder):
    df = D.user_day(spark, folder)
    return I.compare_candidates({m: P.fill_with_peers(df, ["view_value"], m) for m in ("mean", "median")}, df, "view_value")


REACH = {"view_value": 3, "purchase_value": 1, "avg_value": 2}


def filled_columns(column: str) -> str:
    """SQL of a column as observed and as each candidate fills it."""
    w = "(PARTITION BY entity_id ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return f"""SELECT '{column}' AS indicator, {column} AS v, CASE WHEN pos - last_value(CASE WHEN {column} IS NOT NULL THEN pos END IGNORE NULLS) OVER {w} <= {REACH[column]} THEN last_value({column} IGNORE NULLS) OVER {w} END AS temporal,
coalesce({column}, avg({column}) OVER (PARTITION BY entity_stratum, period)) AS peers, coalesce({column}, avg({column}) OVER ()) AS everyone FROM a"""


METHOD_ROWS = " UNION ALL ".join(
    f"SELECT indicator, '{m}' AS method, {'true' if m == 'temporal' else 'false'} AS applied, count({m}) AS n, avg({m}) AS mean, stddev_samp({m}) AS std, avg({m}) - avg(v) AS mean_diff, stddev_samp({m}) - stddev_samp(v) AS std_diff FROM u GROUP BY 1 HAVING count(v) >= 10"
    for m in I.CANDIDATES
)
CANDIDATE_ROWS = f"p AS ({D.USER_DAY}), a AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY period) AS pos FROM p), u AS ({' UNION ALL '.join(filled_columns(c) for c in REACH)}), m AS ({METHOD_ROWS})"


@query("candidate_moments", f"WITH {CANDIDATE_ROWS} SELECT indicator, method, applied, n, {r6('mean', 'std', 'mean_diff', 'std_diff')} FROM m")
def _(spark, folder):
    return I.candidate_moments(D.user_day(spark, folder), REACH)


@query("candidate_bias", f"WITH {CANDIDATE_ROWS}, b AS (SELECT method, avg(abs(mean_diff)) AS mean_bias FROM m GROUP BY 1) SELECT method, {r6('mean_bias')}, method = (SELECT method FROM b ORDER BY mean_bias, method = 'everyone', method = 'peers' LIMIT 1) AS most_robust FROM b")
def _(spark, folder):
    return I.candidate_bias(I.candidate_moments(D.user_day(spark, folder), REACH))


@query("imputation_coverage", f"WITH {FILLED} SELECT 'view_value' AS indicator, count(*) AS rows_before, count(*) AS rows_after, round(count(a)::DOUBLE / count(*), 6) + 0.0 AS observed_share, round((count(mean) - count(a))::DOUBLE / count(*), 6) + 0.0 AS imputed_share FROM q")
def _(spark, folder):
    df = D.user_day(spark, folder)
    return I.coverage(df, P.fill_with_peers(df, ["view_value"], "mean"), ["view_value"])


@query("fold_records", f"WITH {FOLDED} SELECT count(*) AS n FROM f")
def _(spark, folder):
    return spark.createDataFrame([(N.fold_records(D.user_day(spark, folder), PERIODS),)], "n bigint")


def held_cells(column: str) -> str:
    """SQL of a column's held-out cells, each with the entity's previous row."""
    return f"""SELECT '{column}' AS indicator, y, filled FROM (SELECT {column} AS y, lag({column}) OVER (PARTITION BY entity_id ORDER BY period) AS filled, entity_id, period FROM p)
WHERE y IS NOT NULL AND filled IS NOT NULL AND CAST(('0x' || substr(md5('42|{column}|' || entity_id || '|' || CAST(period AS VARCHAR)), 1, 8))::UBIGINT AS DOUBLE) / 4294967296.0 < 0.1"""


@query("holdout_check", f"""WITH p AS ({D.USER_DAY}), h AS ({' UNION ALL '.join(held_cells(c) for c in D.INDICATORS)}),
g AS (SELECT indicator, 'events' AS category, count(y) AS n, avg(abs(y - filled)) AS mae, sqrt(avg((y - filled) ** 2)) AS rmse, avg(abs(y - filled) / nullif(abs(y), 0)) * 100 AS mape,
CASE WHEN stddev_pop(y) * stddev_pop(filled) > 0 THEN covar_pop(y, filled) / (stddev_pop(y) * stddev_pop(filled)) END AS r FROM h GROUP BY 1),
k AS (SELECT indicator, category, n, CASE WHEN n >= 5 THEN mae END AS mae, CASE WHEN n >= 5 THEN rmse END AS rmse, CASE WHEN n >= 5 THEN mape END AS mape, CASE WHEN n >= 5 THEN r END AS r FROM g)
SELECT indicator, category, n, {r6('mae', 'rmse', 'mape', 'r')} FROM k""")
def _(spark, folder):
    return I.holdout_check(D.user_day(spark, folder), D.INDICATORS, dict.fromkeys(D.INDICATORS, "events"))


@query("latency_equivalence")
def _(spark, folder):
    rows = N.latency_equivalence(D.runs(spark, folder), dict.fromkeys(C.PHASES, 0.1))
    return spark.createDataFrame([(r["phase"], r["a"], r["b"], r["low"], r["high"], r["method"], r["decision"]) for r in rows], "phase string, a string, b string, low double, high double, method string, decision string")


@query("significance_tests")
def _(spark, folder):
    rows = N.significance(D.runs(spark, folder))
    return spark.createDataFrame([(r["phase"], r["a"], r["b"], r["n"], r["p_t"], r["p"], r["d_z"], r["hedges_g"]) for r in rows], "phase string, a string, b string, n int, p_t double, p_wilcoxon double, d_z double, hedges_g double")


PARTS = 9
DRAW_SQL = "CAST(floor(CAST(('0x' || substr(md5({0}), 1, 8))::UBIGINT AS DOUBLE) / 4294967296.0 * {1}) AS INTEGER)"
LEAKS = f"""{T_DAY}, x AS (SELECT t.entity_id, t.period, t.target AS y, l.target AS lagged, {DRAW_SQL.format("'part|' || t.entity_id || '|' || CAST(t.period AS VARCHAR)", PARTS)} AS part,
t.target + CAST(('0x' || substr(md5('noise|' || t.entity_id || '|' || CAST(t.period AS VARCHAR)), 1, 8))::UBIGINT AS DOUBLE) / 4294967296.0 * 0.6 - 0.3 AS proxy
FROM t JOIN t l ON l.entity_id = t.entity_id AND l.period = t.period - 2 WHERE t.target IS NOT NULL AND l.target IS NOT NULL),
b AS (SELECT * FROM (VALUES {BOUNDS}) AS v(fold, split, lo, hi)),
c AS (SELECT fold, avg(y) AS my, avg(lagged) AS mx, covar_pop(lagged, y) * count(*) / (var_pop(lagged) * count(*) + 1) AS w FROM x JOIN b ON split = 'train' AND period BETWEEN lo AND hi GROUP BY 1),
k AS (SELECT k AS fold, avg(y) AS my, avg(lagged) AS mx, avg(proxy) AS mz, var_pop(lagged) * count(*) + 1 AS xx, var_pop(proxy) * count(*) + 1 AS zz, covar_pop(lagged, proxy) * count(*) AS xz,
covar_pop(lagged, y) * count(*) AS xy, covar_pop(proxy, y) * count(*) AS zy FROM x JOIN (SELECT unnest(range({PARTS})) AS k) ON part <> k GROUP BY 1),
a AS (SELECT 'clean' AS setting, CAST(fold AS INTEGER) AS fold, y AS y_true, my + w * (lagged - mx) AS y_pred FROM x JOIN b ON split = 'test' AND period BETWEEN lo AND hi JOIN c USING (fold)
UNION ALL SELECT 'leaked', CAST(fold AS INTEGER), y, my + (zz * xy - xz * zy) / (xx * zz - xz * xz) * (lagged - mx) + (xx * zy - xz * xy) / (xx * zz - xz * xz) * (proxy - mz) FROM x JOIN k ON part = fold),
g AS (SELECT setting, fold, count(*) AS n, CASE WHEN var_pop(y_true) > 0 THEN 1 - sum((y_true - y_pred) ** 2) / (var_pop(y_true) * count(*)) END AS r2, avg(abs(y_true - y_pred)) AS mae FROM a GROUP BY 1, 2)"""


def leaked_scores(spark, folder) -> DataFrame:
    """Ridge of the target on its lag under walk-forward folds, and with a feature that knows the target under folds that ignore time."""
    df = P.with_lags(day(spark, folder))
    at = lambda name: portable_draw(F.lit(name), F.col("entity_id"), F.col("period"))
    proxy = df.withColumn("proxy", F.col("target") + at("noise") * 0.6 - 0.3)
    return K.inflated_scores(proxy, PERIODS, ["target_lag_2"], ["proxy"], F.floor(at("part") * PARTS), PARTS)


@query("leakage_scores", f"WITH {LEAKS} SELECT setting, fold, n, {r6('r2', 'mae')} FROM g")
def _(spark, folder):
    return leaked_scores(spark, folder).select("setting", "fold", "n", "r2", "mae")


_leak_stats = ", ".join(f"{f}({c}) FILTER (setting = '{s}') AS {s}_{c}_{n}" for s in ("clean", "leaked") for c in ("r2", "mae") for f, n in (("avg", "mean"), ("stddev_pop", "std")))
_leak_names = [f"{s}_{c}_{n}" for s in ("clean", "leaked") for c in ("r2", "mae") for n in ("mean", "std")]


@query("leakage_inflation", f"""WITH {LEAKS}, s AS (SELECT count(mae) FILTER (setting = 'clean') AS clean_folds, count(mae) FILTER (setting = 'leaked') AS leaked_folds, {_leak_stats} FROM g),
i AS (SELECT *, leaked_r2_mean - clean_r2_mean AS r2_inflation, (leaked_r2_mean - clean_r2_mean) / greatest(abs(clean_r2_mean), 1e-9) * 100 AS r2_inflation_percent, clean_mae_mean - leaked_mae_mean AS mae_reduction FROM s)
SELECT clean_folds, leaked_folds, {r6(*_leak_names, 'r2_inflation', 'r2_inflation_percent', 'mae_reduction')} FROM i""")
def _(spark, folder):
    return K.inflation(leaked_scores(spark, folder))


# ---- models and selection: no SQL, tests hold them against direct computations


@query("collinearity_kept")
def _(spark, folder):
    kept = S.without_collinear(year(spark, folder), ["avg_price", "order_volume", "avg_balance", "urgent_rate"])
    return spark.createDataFrame([(k,) for k in kept], "feature string")


@query("feature_selection")
def _(spark, folder):
    found = S.select_features(month(spark, folder), 23980, protocol=ProtocolConfig(floor=0.0, relaxed_floor=0.0))
    return spark.createDataFrame([(f, found.correlations[f]) for f in found.features], "feature string, r_abs double")


MODEL_FEATURES = ["avg_value", "click_rate", "view_value", "target_lag_2", "target_lag_3"]


@query("ridge_hierarchical")
def _(spark, folder):
    return RC.all_folds(P.with_lags(day(spark, folder)), PERIODS, MODEL_FEATURES)[0].filter("split = 'test'").drop("split")


@query("fold_runner")
def _(spark, folder):
    df = stage(P.with_lags(day(spark, folder)), "panel-lags")
    features = ["avg_value", "click_rate", "target_lag_2", "target_lag_3"]
    return R.run_folds(df, PERIODS, features).metrics


@query("random_forest_hierarchical")
def _(spark, folder):
    days = stage(day(spark, folder).select(*CONFIG.keys, "target", *MODEL_FEATURES[:3]), "panel")
    return FC.all_folds(P.with_lags(days), PERIODS, MODEL_FEATURES)[0]
