"""Text to number / boolean / timestamp with the rules spreadsheet users expect."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Plain decimal or exponent notation, blanks around it allowed.
# Spark's own cast also takes '1d', 'NaN' and 'Infinity', which are not numbers here.
NUMBER_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"

# Spellings of true and false, compared in lower case.
TRUE_WORDS = ("true", "yes", "1", "y")
FALSE_WORDS = ("false", "no", "0", "n")


def to_number(c: Column) -> Column:
    text = c.cast("string")
    return F.when(text.rlike(NUMBER_PATTERN), text.try_cast("double"))


def to_whole_number(c: Column) -> Column:
    """Whole numbers only: '3.0' is 3, '3.7' is missing. Long integers stay exact."""
    text = F.trim(c.cast("string"))
    number = to_number(c)
    direct = F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("bigint"))
    return F.coalesce(direct, F.when(number == F.floor(number), number.try_cast("bigint")))


def to_flag(c: Column) -> Column:
    word = F.lower(c.cast("string"))
    return F.when(word.isin(*TRUE_WORDS), F.lit(True)).when(word.isin(*FALSE_WORDS), F.lit(False))


def to_moment(c: Column) -> Column:
    return c.cast("string").try_cast("timestamp_ntz")
