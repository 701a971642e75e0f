"""Column helpers: quoting, type families, and one notion of "missing".

Spark keeps NULL and NaN apart, and NaN compares greater than every number.
All operators go through ``present`` / ``is_missing`` so that both count as
missing.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe import limits

INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOATS = (T.FloatType, T.DoubleType)
DATETIMES = (T.TimestampType, T.TimestampNTZType, T.DateType)
TEXTS = (T.StringType, T.CharType, T.VarcharType)


def col(name: str) -> Column:
    """Column by exact name; dots and spaces in the name are literal."""
    return F.col("`" + name.replace("`", "``") + "`")


def family(dtype: T.DataType) -> str:
    if isinstance(dtype, INTEGERS):
        return "integer"
    if isinstance(dtype, (*FLOATS, T.DecimalType)):
        return "float"
    if isinstance(dtype, T.BooleanType):
        return "numeric"
    if isinstance(dtype, DATETIMES):
        return "datetime"
    if isinstance(dtype, T.DayTimeIntervalType):
        return "timedelta"
    if isinstance(dtype, TEXTS):
        return "text"
    return "other"


def known(df: DataFrame, names: str | Iterable[str]) -> list[str]:
    """The given names that exist, in the given order, without repeats."""
    if isinstance(names, str):
        names = [names]
    have = set(df.columns)
    return [n for n in dict.fromkeys(names) if n in have]


def columns_of(df: DataFrame, *families: str) -> list[str]:
    return [f.name for f in df.schema.fields if family(f.dataType) in families]


def numeric_columns(df: DataFrame, columns: Sequence[str] | None = None) -> list[str]:
    """Integer, floating and decimal columns. Booleans are not profiled as numbers."""
    numeric = columns_of(df, "integer", "float")
    if columns is None:
        return numeric
    return [c for c in known(df, columns) if c in numeric]


def text_columns(df: DataFrame, columns: Sequence[str] | None = None) -> list[str]:
    texts = columns_of(df, "text")
    if columns is None:
        return texts
    return [c for c in known(df, columns) if c in texts]


def _is_float(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, FLOATS)


def present(df: DataFrame, name: str) -> Column:
    """The column with NaN turned into NULL."""
    if _is_float(df, name):
        return F.when(~F.isnan(col(name)), col(name))
    return col(name)


def is_missing(df: DataFrame, name: str) -> Column:
    if _is_float(df, name):
        return col(name).isNull() | F.isnan(col(name))
    return col(name).isNull()


def not_nan(df: DataFrame, name: str) -> Column | None:
    """Residual guard for comparisons, so that the comparison itself still pushes down."""
    return ~F.isnan(col(name)) if _is_float(df, name) else None


def as_double(df: DataFrame, name: str) -> Column:
    """Numbers and durations (as seconds) as a double, missing as NULL."""
    if family(df.schema[name].dataType) == "timedelta":
        return duration_seconds(col(name)).cast("double")
    return present(df, name).cast("double")


def nan_to_null(df: DataFrame) -> DataFrame:
    return df.select([present(df, c).alias(c) for c in df.columns])


def duration_seconds(c: Column) -> Column:
    """Day-time interval to seconds, exact to the microsecond."""
    return c.cast("decimal(20,6)")


def with_values(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """Replace columns in place, keeping the column order."""
    return df.select([values[c].alias(c) if c in values else col(c) for c in df.columns])


def unpivot(df: DataFrame, values: dict[str, Column], keys: Sequence[str] = ()) -> DataFrame:
    """Long form ``(keys..., column, value)`` without missing values.

    The rows are made inside the scan task; whatever aggregates them next
    combines map-side, so the long form itself is never shuffled. Wide tables
    go in blocks of columns, each reading only its own and each small enough
    for generated code.
    """
    names, parts = list(values), []
    for i in range(0, len(names), limits.UNPIVOT_COLUMNS):
        block = names[i : i + limits.UNPIVOT_COLUMNS]
        wide = df.select(*[col(k) for k in keys], *[values[n].alias(n) for n in block])
        parts.append(wide.unpivot([col(k) for k in keys], [col(n) for n in block], "column", "value"))
    return reduce(DataFrame.union, parts).where(F.col("value").isNotNull())
