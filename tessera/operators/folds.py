"""Walk-forward folds with gaps: generation, checks and materialisation."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tessera.config import FoldConfig, LeakageViolation, PanelConfig

SPLITS = ("train", "val", "test")


@dataclass(frozen=True)
class Fold:
    """Closed periods of the three parts of one fold."""

    fold: int
    train_start: int
    train_end: int
    val_start: int
    val_end: int
    test_start: int
    test_end: int


def walk_forward(config: FoldConfig) -> list[Fold]:
    """Folds whose training part starts at the first period and grows; parts are ``gap`` periods apart."""
    c = config
    if min(c.min_train, c.validation, c.test, c.step) < 1 or c.gap < 0 or c.most is not None and c.most < 1:
        raise ValueError("parts, steps and the limit must be positive and the gap not negative")
    earliest = c.first + c.min_train + c.validation + 2 * c.gap
    latest = c.last - c.test + 1
    folds = []
    for number, test_start in enumerate(range(earliest, latest + 1, c.step)[: c.most]):
        val_end = test_start - c.gap - 1
        val_start = val_end - c.validation + 1
        folds.append(Fold(number, c.first, val_start - c.gap - 1, val_start, val_end, test_start, test_start + c.test - 1))
    if not folds:
        raise ValueError("the range is too short for a single fold")
    return folds


def first_train_end(config: FoldConfig) -> int:
    return config.first + config.min_train - 1


def check_folds(folds: Sequence[Fold], config: FoldConfig) -> None:
    """Raise unless every fold is in order with its gaps, lies in the range, trains long enough, and training never shrinks."""
    if not folds:
        raise LeakageViolation("no folds")
    if config.embargo > config.gap:
        raise LeakageViolation("the embargo is longer than the gap")
    for f in folds:
        if any(getattr(f, f"{s}_start") > getattr(f, f"{s}_end") for s in SPLITS):
            raise LeakageViolation(f"fold {f.fold}: a part ends before it starts")
        if f.val_start - f.train_end - 1 < config.gap or f.test_start - f.val_end - 1 < config.gap:
            raise LeakageViolation(f"fold {f.fold}: parts are closer than the gap of {config.gap}")
        if f.train_end - f.train_start + 1 < config.min_train:
            raise LeakageViolation(f"fold {f.fold}: the training part is shorter than {config.min_train} periods")
        if f.train_start < config.first or f.test_end > config.last:
            raise LeakageViolation(f"fold {f.fold}: a part lies outside the range")
    for a, b in zip(folds, folds[1:]):
        if b.train_end < a.train_end:
            raise LeakageViolation(f"fold {b.fold}: training ends before that of fold {a.fold}")


def fold_bounds(spark: SparkSession, folds: Iterable[Fold]) -> DataFrame:
    """``fold, split, first_period, last_period``: three rows per fold."""
    rows = [(f.fold, s, getattr(f, f"{s}_start"), getattr(f, f"{s}_end")) for f in folds for s in SPLITS]
    return spark.createDataFrame(rows, "fold int, split string, first_period int, last_period int")


def materialise(df: DataFrame, folds: Sequence[Fold], config: PanelConfig = PanelConfig()) -> DataFrame:
    """All folds at once: the panel's rows with ``fold`` and ``split``; the bounds are three rows per fold and are broadcast."""
    bounds = F.broadcast(fold_bounds(df.sparkSession, folds))
    return df.join(bounds, df[config.period].between(bounds["first_period"], bounds["last_period"])).drop("first_period", "last_period")


def segments(folds: Sequence[Fold]) -> tuple[list[int], dict[int, range]]:
    """First periods of the segments, and by fold the segments that its training part consists of.  A period's segment is the number of first periods up to it."""
    cuts = sorted({f.train_start for f in folds} | {f.train_end + 1 for f in folds})
    return cuts, {f.fold: range(cuts.index(f.train_start) + 1, cuts.index(f.train_end + 1) + 1) for f in folds}


def segment_of(cuts: Sequence[int], period: Column) -> Column:
    """The segment of a period."""
    return F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= period))


def split_of(df: DataFrame, fold: Fold, split: str, config: PanelConfig = PanelConfig()) -> DataFrame:
    """One part of one fold, as a filter that reaches the scan."""
    return df.filter(F.col(config.period).between(getattr(fold, f"{split}_start"), getattr(fold, f"{split}_end")))


def outside_gap(df: DataFrame, first: int, last: int, gap_first: int, gap_last: int, config: PanelConfig = PanelConfig()) -> DataFrame:
    """Closed interval of periods without a closed gap in it."""
    return df.filter(F.col(config.period).between(first, last) & ~F.col(config.period).between(gap_first, gap_last))


def fold_counts(folded: DataFrame, config: PanelConfig = PanelConfig()) -> DataFrame:
    """Rows, entities, valid targets and mean target of each part."""
    return folded.groupBy("fold", "split").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct(config.entity).alias("n_entities"), F.count(config.target).alias("n_target"), F.avg(config.target).alias("mean")
    )


def fold_warnings(folded: DataFrame, entities: int, config: PanelConfig = PanelConfig(), least: tuple[int, int, int] = (30, 15, 10)) -> DataFrame:
    """Parts with few rows, under half of the entities, or under 70 % valid targets."""
    needed = F.create_map(*[F.lit(x) for s, n in zip(SPLITS, least) for x in (s, n)])[F.col("split")]
    return fold_counts(folded, config).select(
        "fold", "split", (F.col("n_rows") < needed).alias("few_rows"), (F.col("n_entities") < entities * 0.5).alias("few_entities"), (F.col("n_target") < F.col("n_rows") * 0.7).alias("few_targets")
    )


def canonical(df: DataFrame, config: PanelConfig = PanelConfig()) -> DataFrame:
    """The rows in entity and period order; raises for no rows, null targets or repeated keys."""
    found = df.agg(F.count(F.lit(1)).alias("n"), F.count(config.target).alias("y")).first()
    if not found["n"]:
        raise ValueError("the part has no rows")
    if found["y"] < found["n"]:
        raise ValueError("the part has null targets")
    if not df.groupBy(*config.keys).count().filter("count > 1").isEmpty():
        raise ValueError("the part repeats an entity's period")
    return df.orderBy(*config.keys)


def as_records(folds: Sequence[Fold], config: FoldConfig, run_id: str, lags: Sequence[int]) -> list[dict]:
    """Folds as plain records, stamped with the run that made them."""
    return [asdict(f) | {"gap": config.gap, "information_horizon": min(lags), "fit_window": "train_only", "run_id": run_id} for f in folds]
