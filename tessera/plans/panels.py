"""Panels from the relational tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tessera.sources.readers import table

INDICATORS = ["avg_value", "click_rate", "purchase_value", "view_value", "signup_value"]
TYPES = ["click", "error", "purchase", "signup", "view"]


def share(condition: Column) -> Column:
    return F.count_if(condition) * F.lit(100.0) / F.count(F.lit(1))


def user_day(spark: SparkSession, folder: str) -> DataFrame:
    """Users by day of the month of ``events``: sparse, with indicators that are missing where a user had no such event."""
    kind = F.col("event_type")
    mean_of = lambda name: F.avg(F.when(kind == name, F.col("value")))
    return (
        table(spark, folder, "events")
        .groupBy(F.col("user_id").cast("string").alias("entity_id"), F.concat(F.lit("User "), F.col("user_id").cast("string")).alias("entity_name"),
                 F.concat(F.lit("S"), (F.col("user_id") % 5).cast("string")).alias("entity_stratum"), F.dayofmonth("ts").alias("period"))
        .agg(
            share(kind == "error").alias("target_source"), F.avg("value").alias("avg_value"), share(kind == "click").alias("click_rate"),
            mean_of("purchase").alias("purchase_value"), mean_of("view").alias("view_value"), mean_of("signup").alias("signup_value"),
        )
    )


USER_DAY = """
SELECT CAST(user_id AS VARCHAR) AS entity_id, 'User ' || CAST(user_id AS VARCHAR) AS entity_name, 'S' || CAST(user_id % 5 AS VARCHAR) AS entity_stratum, CAST(day(ts) AS INTEGER) AS period,
       count(*) FILTER (event_type = 'error') * 100.0::DOUBLE / count(*) AS target_source, avg(value) AS avg_value, count(*) FILTER (event_type = 'click') * 100.0::DOUBLE / count(*) AS click_rate,
       avg(value) FILTER (event_type = 'purchase') AS purchase_value, avg(value) FILTER (event_type = 'view') AS view_value, avg(value) FILTER (event_type = 'signup') AS signup_value
FROM events GROUP BY ALL
"""


def user_day_observations(spark: SparkSession, folder: str) -> DataFrame:
    """Mean value of each event type as long observations."""
    return (
        table(spark, folder, "events")
        .groupBy(F.col("user_id").cast("string").alias("entity_id"), F.dayofmonth("ts").alias("period"), F.col("event_type").alias("indicator"))
        .agg(F.avg("value").alias("value"))
    )


OBSERVATIONS = "SELECT CAST(user_id AS VARCHAR) AS entity_id, CAST(day(ts) AS INTEGER) AS period, event_type AS indicator, avg(value) AS value FROM events GROUP BY ALL"


def _nation(spark: SparkSession, folder: str, period: Column) -> DataFrame:
    orders, customer = table(spark, folder, "orders"), table(spark, folder, "customer")
    nation, region = table(spark, folder, "nation"), table(spark, folder, "region")
    names = nation.join(region, nation["n_regionkey"] == region["r_regionkey"])
    facts = orders.join(customer, orders["o_custkey"] == customer["c_custkey"]).groupBy("c_nationkey", period.cast("int").alias("period")).agg(
        share(F.col("o_orderstatus") == "F").alias("target_source"), F.avg("o_totalprice").alias("avg_price"), F.count(F.lit(1)).cast("double").alias("order_volume"),
        F.avg("c_acctbal").alias("avg_balance"), share(F.col("o_orderpriority") == "1-URGENT").alias("urgent_rate"),
    )
    # names last: they join the aggregated rows
    return facts.join(names, facts["c_nationkey"] == names["n_nationkey"]).select(
        F.col("c_nationkey").cast("string").alias("entity_id"), F.col("n_name").alias("entity_name"), F.col("r_name").alias("entity_stratum"), "period",
        "target_source", "avg_price", "order_volume", "avg_balance", "urgent_rate",
    )


def nation_month(spark: SparkSession, folder: str) -> DataFrame:
    return _nation(spark, folder, F.year("o_orderdate") * 12 + F.month("o_orderdate"))


def nation_year(spark: SparkSession, folder: str) -> DataFrame:
    return _nation(spark, folder, F.year("o_orderdate"))


def _nation_sql(period: str) -> str:
    return f"""
SELECT CAST(c_nationkey AS VARCHAR) AS entity_id, min(n_name) AS entity_name, min(r_name) AS entity_stratum, CAST({period} AS INTEGER) AS period,
       count(*) FILTER (o_orderstatus = 'F') * 100.0::DOUBLE / count(*) AS target_source, avg(o_totalprice) AS avg_price, CAST(count(*) AS DOUBLE) AS order_volume,
       avg(c_acctbal) AS avg_balance, count(*) FILTER (o_orderpriority = '1-URGENT') * 100.0::DOUBLE / count(*) AS urgent_rate
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY c_nationkey, {period}
"""


NATION_MONTH = _nation_sql("year(o_orderdate) * 12 + month(o_orderdate)")
NATION_YEAR = _nation_sql("year(o_orderdate)")


def runs(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark rows made of ``lineitem``: runs, phases and back ends with a duration."""
    return table(spark, folder, "lineitem").select(
        (F.col("l_orderkey") % 10).cast("int").alias("run_id"), F.element_at(F.array(*[F.lit(p) for p in ("processing", "setup", "baseline", "hierarchical")]), (F.col("l_linenumber") % 4 + 1).cast("int")).alias("phase"),
        F.element_at(F.array(F.lit("dataframe"), F.lit("pandas"), F.lit("sql")), (F.col("l_suppkey") % 3 + 1).cast("int")).alias("architecture"), (F.col("l_quantity") / 10).alias("duration_s"),
    ).groupBy("run_id", "phase", "architecture").agg(F.sum("duration_s").alias("duration_s"))


RUNS = """
SELECT run_id, phase, architecture, sum(q / 10) AS duration_s FROM (
  SELECT CAST(l_orderkey % 10 AS INTEGER) AS run_id, list_extract(['processing', 'setup', 'baseline', 'hierarchical'], CAST(l_linenumber % 4 + 1 AS INT)) AS phase,
         list_extract(['dataframe', 'pandas', 'sql'], CAST(l_suppkey % 3 + 1 AS INT)) AS architecture, l_quantity AS q FROM lineitem) GROUP BY ALL
"""
