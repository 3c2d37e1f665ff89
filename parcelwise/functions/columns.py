"""Column expressions shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)

NUDGE = 3.3e-4


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def all_present(*columns: str | Column) -> Column:
    """True where none of the columns is null: group tables leave rows with a null key out."""
    return reduce(lambda a, b: a & b, (col(c).isNotNull() for c in columns), F.lit(True))


def ratio(a: str | Column, b: str | Column) -> Column:
    """Double division that gives null, not an error, for a zero divisor (ANSI mode raises)."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def when_count(condition: Column) -> Column:
    """Number of rows that meet a condition, 0 for none."""
    return F.count(F.when(condition, F.lit(1)))


def numeric_columns(df: DataFrame) -> list[str]:
    """Names of the numeric columns; booleans do not count as numeric."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC_TYPES)]


def hash_text(key: str | Column, seed: int = 42) -> Column:
    """Hex digest that orders rows pseudo-randomly but the same way in every run and engine."""
    return F.md5(F.concat(F.lit(f"{seed}|"), col(key).cast("string")))


def presentable(df: DataFrame, digits: int | dict[str, int] = 6) -> DataFrame:
    """Round doubles and widen integers, so that results compare across engines.

    ``digits`` may give single columns their own number of places (negative for large magnitudes).
    """
    places = digits if isinstance(digits, dict) else {}
    default = 6 if isinstance(digits, dict) else digits
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            n = places.get(f.name, default)
            # the nudge rounds exact halves the same way in every engine; adding 0 turns -0.0 into 0.0
            nudge = F.lit(NUDGE * 10.0**-n)
            c = F.round(c.cast("double") + nudge, n) + F.lit(0.0).cast("double")
        elif isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            fmt = "yyyy-MM-dd" if isinstance(f.dataType, T.DateType) else "yyyy-MM-dd HH:mm:ss"
            c = F.date_format(c, fmt)
        out.append(c.alias(f.name))
    return df.select(*out)
