import datetime

from pyspark.sql import functions as F

from tessera.streaming.panels import append_available, event_stream, user_days


def test_days_become_final_once_and_late_rows_are_dropped(spark, tmp_path):
    day = lambda d, h=1: datetime.datetime(2024, 1, d, h)
    schema = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
    batches = [
        [(1, day(1), 7, "error", 1.0, None), (2, day(1, 5), 7, "view", 3.0, None), (3, day(2), 8, "view", 2.0, None)],
        [(4, day(5), 7, "view", 9.0, None)],
        [(5, day(1, 6), 7, "view", 100.0, None), (6, day(9), 7, "view", 1.0, None)],
    ]
    source, out, mark = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/checkpoint"
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        append_available(user_days(event_stream(spark, source)), out, mark)
    got = sorted(tuple(r) for r in spark.read.parquet(out).select("entity_id", F.dayofmonth("day"), "n_events", "target_source", "avg_value").collect())
    assert got == [("7", 1, 2, 50.0, 2.0), ("7", 5, 1, 0.0, 9.0), ("8", 2, 1, 0.0, 2.0)]
