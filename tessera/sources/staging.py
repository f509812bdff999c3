"""Tables that are written to cut a lineage or to be read more than once, in the folder that the cluster shares.

``spark.checkpoint.dir`` names that folder.  Where the session does not set it (tests, local runs) a
temporary folder stands in; a cluster must set it, since its machines share no local folder.
The files are removed when the application's file systems close.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_ROOT: list[str] = []


def root(spark: SparkSession) -> str:
    """Folder for intermediate tables."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL_ROOT:
        _LOCAL_ROOT.append(tempfile.mkdtemp(prefix="tessera-"))
    return f"file://{_LOCAL_ROOT[0]}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and return it as read back: a lost executor costs a re-read, not the lineage."""
    spark = df.sparkSession
    path = f"{root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Delete a table that ``stage`` returned and that nothing reads any more, neither directly nor through a frame not yet written."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {file.rpartition("/")[0] for file in df.inputFiles()}:
        target = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(folder))
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
