"""Tokenising of free-text answers with JVM string functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Korean particles and endings that carry no meaning of their own.
KOREAN_STOP_WORDS = (
    "이", "그", "저", "것", "등", "및", "를", "을", "에", "에서",
    "은", "는", "이다", "있다", "하다", "이런", "저런", "그런",
    "와", "과", "으로", "로", "의", "가", "한", "하는", "할", "하여",
    "한다", "이고", "입니다", "습니다", "었습니다", "았습니다",
)

# A word is a run of letters, underscores and numbers other than
# decimal digits, of any script. Java's bare \\w knows ASCII only and would wipe
# Hangul. Punctuation, white space and digits all end a word.
WORD_CHARACTER = r"[\p{L}\p{Nl}\p{No}_]"


def words(text: Column, min_length: int = 2) -> Column:
    """Array of all words of a text, in one walk over it."""
    return F.regexp_extract_all(text, F.lit(f"{WORD_CHARACTER}{{{min_length},}}"), F.lit(0))


def is_stop_word(word: Column, stop_words: Sequence[str] = KOREAN_STOP_WORDS) -> Column:
    return word.isin(list(dict.fromkeys(stop_words))) if stop_words else F.lit(False)


def tokens(text: Column, stop_words: Sequence[str] = KOREAN_STOP_WORDS, min_length: int = 2) -> Column:
    """Array of words without stop words."""
    found = words(text, min_length)
    return F.filter(found, lambda w: ~is_stop_word(w, stop_words)) if stop_words else found


def shorten(text: Column, length: int) -> Column:
    """Cut to ``length`` characters and mark the cut with three dots."""
    return F.when(F.length(text) > length, F.concat(F.substring(text, 1, length), F.lit("..."))).otherwise(text)
