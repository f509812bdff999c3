"""Column expressions; all stay inside generated code and treat a missing value as null."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F
from pyspark.sql.types import DoubleType, FloatType, NumericType, StructType


def nan_to_null(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def complement_rate(value: Column) -> Column:
    """``100 - x`` for a rate within 0 and 100, else null."""
    return F.when(value.between(0, 100), F.lit(100.0) - value)


def symmetric_log(value: Column) -> Column:
    """``sign(x) * ln(|x| + 1)``."""
    return F.signum(value) * F.log(F.abs(value) + F.lit(1.0))


def clip(value: Column, low: float, high: float) -> Column:
    """Bounded value; unlike ``greatest`` and ``least``, null stays null."""
    return F.when(value < low, F.lit(float(low))).when(value > high, F.lit(float(high))).otherwise(value)


def completeness(columns: Sequence[str]) -> Column:
    """Percentage of the columns that are present in a row, 0 if there are none."""
    if not columns:
        return F.lit(0.0)
    present = sum((F.col(c).isNotNull().cast("int") for c in columns[1:]), F.col(columns[0]).isNotNull().cast("int"))
    return present * F.lit(100.0) / F.lit(len(columns))


def numeric(text: Column) -> Column:
    """A number from text, null where it is none."""
    return text.try_cast("double")


def entity_text(value: Column) -> Column:
    """A numeric identifier as text without decimals."""
    return value.cast("double").cast("long").cast("string")


def partition_name(value: Column, parts: int = 1000) -> Column:
    return F.format_string("partition_%03d", F.pmod(F.xxhash64(value), F.lit(parts)))


def batch_stamp(system: str, moment: Column | None = None) -> Column:
    """``<system>_<yyyyMMdd>_<HHmmss>`` of a moment in the session's time zone, by default the query's own start, which all its rows share."""
    return F.concat_ws("_", F.lit(system), F.date_format(moment if moment is not None else F.current_timestamp(), "yyyyMMdd_HHmmss"))


def portable_draw(*parts: Column) -> Column:
    """A number in [0, 1) from the parts' texts, the same in every engine that has MD5; null parts are left out."""
    digest = F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def correlation(x: Column, y: Column) -> Column:
    """Pearson's r over rows with both values; null instead of an error where it is undefined."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    return F.covar_pop(a, b) / F.when(spread > 0, spread)


def numeric_columns(schema: StructType, excluded: Sequence[str] = ()) -> list[str]:
    return [f.name for f in schema.fields if isinstance(f.dataType, NumericType) and f.name not in set(excluded)]


def floating_columns(schema: StructType) -> list[str]:
    return [f.name for f in schema.fields if isinstance(f.dataType, (DoubleType, FloatType))]
