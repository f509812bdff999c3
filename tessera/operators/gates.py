"""Gates on artifacts: stamps, receipts, digests and the agreement of back ends."""

from __future__ import annotations

import hashlib
import json
import os
import platform
import time
from collections.abc import Iterable, Mapping
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.config import FoldConfig, LeakageViolation
from tessera.operators.comparison import compare_predictions
from tessera.operators.folds import Fold, check_folds
from tessera.sources.sinks import bounded_rows


def write_artifact(path: str | Path, record: Mapping, run_id: str) -> Path:
    """A JSON artifact stamped with its run."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps({"run_id": run_id, **record}, indent=1, sort_keys=True, default=str))
    return path


def read_artifact(path: str | Path) -> dict:
    return json.loads(Path(path).read_text())


def require_run(paths: Iterable[str | Path], run_id: str) -> None:
    """Every artifact must exist and carry the run's stamp."""
    for path in paths:
        if not Path(path).exists():
            raise LeakageViolation(f"{path} is missing")
        stamp = read_artifact(path).get("run_id")
        if stamp != run_id:
            raise LeakageViolation(f"{path} is of run {stamp}, not {run_id}")


def check_receipts(receipts: Mapping[str, Mapping | None], run_id: str) -> None:
    """Every receipt must be there, of this run, with content, and determinate."""
    for name, receipt in receipts.items():
        problem = (
            "is missing" if receipt is None else "has no run" if "run_id" not in receipt else "is of another run" if receipt["run_id"] != run_id
            else "is empty" if not receipt.get("entries") else "is indeterminate" if any(e.get("status") == "indeterminate" for e in receipt["entries"]) else None
        )
        if problem:
            raise LeakageViolation(f"receipt {name} {problem}")


def check_back_ends(folds: Mapping[str, list[Fold]], config: FoldConfig) -> None:
    """All back ends must have the same folds, in order."""
    first = next(iter(folds.values()))
    for name, own in folds.items():
        check_folds(own, config)
        if own != first:
            raise LeakageViolation(f"the folds of {name} differ")


def prediction_digest(predictions: DataFrame) -> DataFrame:
    """Order-free digest of each prediction vector, computed where the rows are."""
    row = F.xxhash64("row", "entity", "y_true", "y_pred")
    return predictions.groupBy("fold", "model").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(row).alias("digest"))


def digest_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Vectors that are missing, have appeared or have changed."""
    a = before.select("fold", "model", F.struct("n", "digest").alias("old"))
    b = after.select("fold", "model", F.struct("n", "digest").alias("new"))
    change = F.when(F.col("new").isNull(), "missing").when(F.col("old").isNull(), "appeared").when(F.col("old") != F.col("new"), "changed")
    return a.join(b, ["fold", "model"], "full_outer").withColumn("change", change).filter("change IS NOT NULL").select("fold", "model", "change")


def equivalence_gate(predictions: Mapping[str, DataFrame]) -> dict:
    """Status over all back ends against the first: ``equivalent``, ``violation`` or ``insufficient_data``."""
    names = list(predictions)
    if len(names) < 2:
        return {"status": "insufficient_data", "findings": []}
    findings = []
    for name in names[1:]:
        different = bounded_rows(compare_predictions(predictions[names[0]], predictions[name]).filter("kind <> 'equal'"))  # a row for each fold and model
        findings += [{"pair": (names[0], name), **r.asDict()} for r in different]
    return {"status": "violation" if findings else "equivalent", "findings": findings}


def inject(folds: list[Fold], fault: str) -> list[Fold]:
    """Folds with a fault that the checks must refuse: ``zero_gap``, ``overlap`` or ``reversed``."""
    def spoil(f: Fold) -> Fold:
        v = dict(vars(f))
        if fault == "zero_gap":
            v["train_end"] = f.val_start - 1
        elif fault == "overlap":
            v["train_end"] = f.val_end
        elif fault == "reversed":
            v["test_start"], v["test_end"] = f.test_end, f.test_start - 1
        else:
            raise ValueError(fault)
        return Fold(**v)

    return [spoil(f) for f in folds]


def file_digest(path: str | Path) -> str:
    digest = hashlib.sha256()
    with open(path, "rb") as file:
        for block in iter(lambda: file.read(1 << 20), b""):
            digest.update(block)
    return digest.hexdigest()


def snapshot(folder: str | Path) -> dict[str, str]:
    """SHA-256 of every file under a folder."""
    folder = Path(folder)
    return {str(p.relative_to(folder)): file_digest(p) for p in sorted(folder.rglob("*")) if p.is_file()}


def verify_snapshot(folder: str | Path, recorded: Mapping[str, str]) -> list[str]:
    """Files that are missing, new or changed."""
    now = snapshot(folder)
    return sorted(k for k in {*now, *recorded} if now.get(k) != recorded.get(k))


def content_digests(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 of files that only Spark reads."""
    return spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), "length", F.sha2("content", 256).alias("sha256"))


def environment(spark: SparkSession) -> dict:
    """What a run depends on."""
    return {"spark": spark.version, "python": platform.python_version(), "machine": platform.machine(), "cores": os.cpu_count(), "master": spark.sparkContext.master,
            "shuffle_partitions": spark.conf.get("spark.sql.shuffle.partitions"), "time_zone": spark.conf.get("spark.sql.session.timeZone")}


def require_cores(spark: SparkSession, least: int) -> None:
    if spark.sparkContext.defaultParallelism < least:
        raise RuntimeError(f"the session has fewer than {least} cores")


def cache_is_valid(files: Iterable[str | Path], recorded: Mapping[str, str] | None = None, most_hours: float = 24.0) -> bool:
    """Whether all files are there and either have their recorded digests or, without a record, are young enough."""
    files = [Path(f) for f in files]
    if not all(f.exists() for f in files):
        return False
    if recorded is not None:
        return all(recorded.get(f.name) == file_digest(f) for f in files)
    return all(time.time() - f.stat().st_mtime < most_hours * 3600 for f in files)
