"""Sinks of panels, predictions and result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from tessera.operators.comparison import repeated_keys


def write_panel(df: DataFrame, path: str, keys: Sequence[str] = ("entity_id", "period"), partition_by: Sequence[str] = (), ordered: bool = True) -> None:
    """Parquet, range-partitioned and sorted by the keys so that scans can skip row groups; optionally in one folder per value."""
    if ordered and not partition_by:
        df = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    elif partition_by:
        df = df.repartition(*partition_by).sortWithinPartitions(*partition_by, *keys)
    df.write.mode("overwrite").option("compression", "snappy").partitionBy(*partition_by).parquet(path)


def write_predictions(df: DataFrame, path: str) -> None:
    """Prediction vectors; a repeated key is an error."""
    if not repeated_keys(df).isEmpty():
        raise ValueError("predictions repeat a key")
    df.select("fold", "model", "row", "entity", "y_true", "y_pred").write.mode("overwrite").parquet(path)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.parquet(path)
    if not repeated_keys(df).isEmpty():
        raise ValueError("predictions repeat a key")
    return df


def bounded_rows(df: DataFrame, most: int = 10_000) -> list:
    """Rows of a result table, refused if there are too many for a page."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    return rows


def _shown(value, digits: int) -> str:
    return "" if value is None else f"{value:.{digits}f}" if isinstance(value, float) else str(value)


def markdown(df: DataFrame, digits: int = 3) -> str:
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join([*lines, *["| " + " | ".join(_shown(v, digits) for v in r) + " |" for r in bounded_rows(df)]])


def write_csv(df: DataFrame, path: str, order: Sequence[str] = ()) -> None:
    """A result table as one CSV file with a header."""
    bounded = df.sparkSession.createDataFrame(bounded_rows(df.orderBy(*order) if order else df), df.schema)
    bounded.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def latex(df: DataFrame, caption: str, digits: int = 3) -> str:
    escape = lambda text: "".join(f"\\{c}" if c in "&%$#_{}" else c for c in text)
    rows = [" & ".join(escape(_shown(v, digits)) for v in r) + r" \\" for r in bounded_rows(df)]
    head = " & ".join(escape(c) for c in df.columns) + r" \\"
    return "\n".join([r"\begin{table}", rf"\caption{{{escape(caption)}}}", rf"\begin{{tabular}}{{{'l' * len(df.columns)}}}", r"\hline", head, r"\hline", *rows, r"\hline", r"\end{tabular}", r"\end{table}"])


def create_views(df: DataFrame, folded: DataFrame, prefix: str = "") -> list[str]:
    """Temporary views of the panel and of each part of each fold."""
    df.createOrReplaceTempView(f"{prefix}vw_selected_features")
    names = [f"{prefix}vw_selected_features"]
    for r in bounded_rows(folded.select("fold", "split").distinct()):
        name = f"{prefix}vw_fold_{r['fold']}_{r['split']}"
        folded.filter((F.col("fold") == r["fold"]) & (F.col("split") == r["split"])).createOrReplaceTempView(name)
        names.append(name)
    return sorted(names)


def latest(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The last row of each key."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(order)))).filter("_r = 1").drop("_r")
