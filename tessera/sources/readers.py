"""Readers of tables, observations and benchmark records."""

from __future__ import annotations

import time
import urllib.request
from collections.abc import Callable, Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tessera.functions.expressions import entity_text, floating_columns, nan_to_null, numeric

OBSERVATION = T.StructType([
    T.StructField("entity_id", T.StringType()), T.StructField("entity_name", T.StringType()), T.StructField("period", T.IntegerType()),
    T.StructField("indicator_code", T.StringType()), T.StructField("indicator", T.StringType()), T.StructField("value", T.DoubleType()),
])
BENCHMARK = "run_id INT, phase STRING, architecture STRING, step STRING, duration_s DOUBLE, duration_ns BIGINT, records BIGINT, peak_rss_mb DOUBLE, throughput_rps DOUBLE"
RESOURCES = (
    "run_id INT, phase STRING, architecture STRING, step STRING, is_warmup BOOLEAN, cpu_proc STRUCT<mean: DOUBLE, max: DOUBLE, n: BIGINT>, cpu_sys STRUCT<mean: DOUBLE, max: DOUBLE>, "
    "rss_mb STRUCT<mean: DOUBLE, max: DOUBLE>, mem_sys_percent STRUCT<mean: DOUBLE, max: DOUBLE>, io_read_mb DOUBLE, io_write_mb DOUBLE"
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of a folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def panel(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """A stored panel, NaN read as null; on request with all files below the path."""
    df = spark.read.option("recursiveFileLookup", str(recursive).lower()).parquet(path)
    floats = floating_columns(df.schema)
    return df.withColumns({c: nan_to_null(F.col(c)) for c in floats}) if floats else df


def row_count(spark: SparkSession, path: str) -> int:
    """Rows, from the files' footers."""
    return spark.read.parquet(path).count()


def observations_from_records(spark: SparkSession, records: Iterable[Mapping]) -> DataFrame:
    """Observations from records of an interface (nested ``country``, ``indicator`` with id and value, ``date``, ``value``)."""
    rows = []
    for r in records:
        entity, indicator, value = r.get("country") or {}, r.get("indicator") or {}, r.get("value")
        rows.append((entity.get("id"), entity.get("value"), int(r["date"]) if r.get("date") else None, indicator.get("id"), indicator.get("value"), None if value is None else float(value)))
    return spark.createDataFrame(rows, OBSERVATION)


def fetch(url: str, attempts: int = 3, wait: float = 1.0, opener: Callable = urllib.request.urlopen, sleep: Callable = time.sleep) -> bytes:
    """The content of a URL; failures are tried again, each after twice the wait."""
    for attempt in range(attempts):
        try:
            with opener(url) as answer:
                return answer.read()
        except OSError:
            if attempt + 1 == attempts:
                raise
            sleep(wait * 2**attempt)
    raise ValueError("attempts must be positive")


def union_indicators(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def sniff_header(lines: Iterable[Sequence], needed: Sequence[str]) -> int:
    """Number of the first row that holds all needed column names."""
    for number, cells in enumerate(lines):
        if set(needed) <= {str(c).strip() for c in cells}:
            return number
    raise ValueError("no header row")


def adapt_census(df: DataFrame, rename: Mapping[str, str], rate: str, source: str = "target_source", scope: str | None = None, total: str = "Total") -> DataFrame:
    """Sheet rows in the panel's form: only totals of the scope column, ids without decimals, numbers from text, and the source rate as 100 less the rate."""
    rows = df.filter(F.col(scope) == total) if scope else df
    rows = rows.withColumnsRenamed(dict(rename))
    rows = rows.withColumn("entity_id", entity_text(F.col("entity_id"))).withColumn("period", F.col("period").cast("int"))
    text = [f.name for f in rows.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in ("entity_id", "entity_name", "entity_stratum", scope)]
    rows = rows.withColumns({c: numeric(F.col(c)) for c in text}) if text else rows
    return rows.withColumn(source, F.lit(100.0) - numeric(F.col(rate).cast("string")))


def benchmark_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=BENCHMARK, enforceSchema=False)


def resource_records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RESOURCES).json(path)
