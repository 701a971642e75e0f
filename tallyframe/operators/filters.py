"""Row filters. A missing value never matches a positive test and never
disappears from a negative one."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from decimal import ROUND_FLOOR, Decimal, InvalidOperation
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions import col, family, is_missing, known
from tallyframe.functions.columns import not_nan


def filter_where(df: DataFrame, predicate: str) -> DataFrame:
    """Rows for which a Spark SQL predicate is true."""
    return df.where(F.expr(predicate))


def filter_by_value(df: DataFrame, column: str, values: Sequence[Any], include: bool = True) -> DataFrame:
    if not known(df, column):
        return df
    listed = [v for v in values if v is not None]
    found = col(column).isin(listed) if listed else F.lit(False)
    if len(listed) < len(values):
        found = F.coalesce(found, F.lit(False)) | is_missing(df, column)
    # The included form stays a bare IN so that it reaches the file scan.
    return df.where(found if include else ~F.coalesce(found, F.lit(False)))


def filter_by_range(
    df: DataFrame,
    column: str,
    min_value: Any = None,
    max_value: Any = None,
    inclusive: str = "both",
) -> DataFrame:
    if inclusive not in ("both", "left", "right", "neither"):
        raise ValueError(f"inclusive must be both, left, right or neither, not {inclusive!r}")
    if not known(df, column) or (min_value is None and max_value is None):
        return df
    c = col(column)
    tests: list[Column] = []
    if min_value is not None:
        tests.append(c >= min_value if inclusive in ("both", "left") else c > min_value)
    if max_value is not None:
        tests.append(c <= max_value if inclusive in ("both", "right") else c < max_value)
    guard = not_nan(df, column)
    if guard is not None:
        tests.append(guard)
    return df.where(reduce(lambda a, b: a & b, tests))


def filter_data(
    df: DataFrame,
    conditions: Sequence[Callable[[DataFrame], Column]],
    combine: str = "and",
) -> DataFrame:
    """Several conditions joined by ``and`` or ``or``; an undecided one counts as false."""
    if not conditions:
        return df
    if combine.lower() not in ("and", "or"):
        raise ValueError(f"combine must be 'and' or 'or', not {combine!r}")
    tests = [c(df) for c in conditions]
    if combine.lower() == "and":
        # NULL and FALSE filter alike under a conjunction: bare tests can push down.
        return df.where(reduce(lambda a, b: a & b, tests))
    return df.where(reduce(lambda a, b: a | b, [F.coalesce(t, F.lit(False)) for t in tests]))


def differs(df: DataFrame, column: str, value: Any) -> Column:
    """True also when the value is missing, as users of data frames expect of ``!=``."""
    return ~col(column).eqNullSafe(F.lit(value))


def search_text(
    df: DataFrame, column: str, pattern: str, case: bool = False, regex: bool = True
) -> DataFrame:
    """Rows whose text holds a pattern. Regular expressions follow Java syntax."""
    if not known(df, column):
        return df
    text = col(column) if family(df.schema[column].dataType) == "text" else col(column).cast("string")
    if regex:
        # (?u): case folding beyond ASCII
        return df.where(text.rlike(pattern if case else f"(?iu){pattern}"))
    if case:
        return df.where(text.contains(pattern))
    return df.where(F.lower(text).contains(pattern.lower()))


def _number(text: Any) -> Decimal | None:
    """The exact number that a form's text reads as; infinities and NaN are not numbers here."""
    try:
        number = Decimal(str(text).strip())
    except InvalidOperation:
        return None
    return number if number.is_finite() else None


def _as_number(c: Column, kind: str, number: Decimal, op: str) -> Column:
    """A test against a literal of the column's own kind, so that it reaches the file scan and large ids stay exact."""
    if kind != "integer":
        value = F.lit(float(number))
        return {"=": c == value, ">": c > value, "<": c < value, ">=": c >= value, "<=": c <= value}[op]
    whole = int(number.to_integral_value(ROUND_FLOOR))
    fraction = number != whole
    if not -(2**63) <= whole < 2**63 - 1:
        above = whole > 0  # every value of the column lies on one side
        return c.isNotNull() & F.lit({"=": False, ">": not above, ">=": not above, "<": above, "<=": above}[op])
    value = F.lit(whole)
    if not fraction:
        return {"=": c == value, ">": c > value, "<": c < value, ">=": c >= value, "<=": c <= value}[op]
    return {"=": c.isNotNull() & F.lit(False), ">": c > value, ">=": c > value, "<": c <= value, "<=": c <= value}[op]


def filter_condition(df: DataFrame, column: str, op: str, value: Any, value2: Any = None) -> Column:
    """Condition of a filter form: equals, contains, greater, less or between.

    ``equals`` compares as a number when the value reads as one and the
    column is numeric. The ordered tests need numbers. Integer columns are
    compared with integers: a fraction equals none of them.
    """
    c = col(column)
    kind = family(df.schema[column].dataType)
    number = _number(value)
    if op == "equals":
        if number is not None:
            # A number never equals a text cell.
            return _as_number(c, kind, number, "=") if kind in ("integer", "float", "numeric") else F.lit(False)
        return (c.cast("string") if kind != "text" else c) == F.lit(str(value))
    if op == "contains":
        return (c if kind == "text" else c.cast("string")).rlike(str(value))
    if op in ("greater", "less", "between"):
        if number is None:
            raise ValueError(f"{op} needs a number, not {value!r}")
        guard = not_nan(df, column)
        tests = [] if guard is None else [guard]
        if op == "greater":
            tests.insert(0, _as_number(c, kind, number, ">"))
        elif op == "less":
            tests.insert(0, _as_number(c, kind, number, "<"))
        else:
            upper = _number(value2)
            if upper is None:
                raise ValueError(f"between needs two numbers, not {value2!r}")
            tests = [_as_number(c, kind, number, ">="), _as_number(c, kind, upper, "<="), *tests]
        return reduce(lambda a, b: a & b, tests)
    raise ValueError(f"unknown test {op!r}")


def non_blank(df: DataFrame, column: str, limit: int | None = None) -> DataFrame:
    """Rows whose text holds something other than white space."""
    rows = df.where(col(column).rlike(r"\S"))
    return rows if limit is None else rows.limit(limit)


