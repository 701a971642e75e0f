"""Tail probabilities as column expressions: gamma and beta series and continued fractions folded over a sequence.

Meant for tables of results, a row per test. Iterations stop changing once they
have converged; the bounds below are far over what doubles need for any
argument whose tail does not underflow.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

ITERATIONS = 600
TINY = 1e-300

# Lanczos' approximation of the gamma function for g = 7 and nine terms.
_LANCZOS = (
    0.99999999999980993,
    676.5203681218851,
    -1259.1392167224028,
    771.32342877765313,
    -176.61502916214059,
    12.507343278686905,
    -0.13857109526572012,
    9.9843695780195716e-6,
    1.5056327351493116e-7,
)


def _let(body: Callable[[Column], Column], **values: Column) -> Column:
    """``body`` of a struct of named doubles, so that an expression is in the plan once however often it is used."""
    bound = F.array(F.struct(*[v.cast("double").alias(k) for k, v in values.items()]))
    return F.transform(bound, body)[0]


def log_gamma(x: Column) -> Column:
    """The logarithm of the gamma function, for x of 0.5 and more."""

    def body(v: Column) -> Column:
        series = F.lit(_LANCZOS[0])
        for i, c in enumerate(_LANCZOS[1:], start=1):
            series = series + F.lit(c) / (v["z"] + i)
        return F.lit(0.9189385332046727) + (v["z"] + 0.5) * F.log(v["z"] + 7.5) - (v["z"] + 7.5) + F.log(series)

    return _let(body, z=x - 1)


def _fold(start: dict[str, Column], step: Callable[[Column, Column], dict[str, Column]], result: str) -> Column:
    """``step`` applied to named doubles for 1, 2, ... ``ITERATIONS``."""
    state = F.struct(*[v.cast("double").alias(k) for k, v in start.items()])

    def merge(acc: Column, i: Column) -> Column:
        return F.struct(*[v.cast("double").alias(k) for k, v in step(acc, i.cast("double")).items()])

    return F.aggregate(F.sequence(F.lit(1), F.lit(ITERATIONS)), state, merge, lambda acc: acc[result])


def _lentz(start: dict[str, Column], numerator: Callable[[Column, Column], Column], denominator: Callable[[Column], Column]) -> Column:
    """A continued fraction by the modified Lentz method; ``start`` has c, d and h."""
    away = lambda v: F.when(F.abs(v) < TINY, F.lit(TINY)).otherwise(v)

    def step(acc: Column, i: Column) -> dict[str, Column]:
        a, b = numerator(acc, i), denominator(i)
        d = 1 / away(b + a * acc["d"])
        c = away(b + a / acc["c"])
        return {"c": c, "d": d, "h": acc["h"] * c * d}

    return _fold(start, step, "h")


def chi_square_tail(x: Column, df: Column) -> Column:
    """The probability of a chi-square value over ``x``; 1 for x of 0 and less."""

    def body(v: Column) -> Column:
        a, x = v["a"], v["x"]
        front = F.exp(a * F.log(x) - x - log_gamma(a))
        series = _fold(
            {"term": 1 / a, "sum": 1 / a},
            lambda acc, i: {"term": acc["term"] * x / (a + i), "sum": acc["sum"] + acc["term"] * x / (a + i)},
            "sum",
        )
        first = x + 1 - a
        fraction = _lentz({"c": F.lit(1 / TINY), "d": 1 / first, "h": 1 / first}, lambda acc, i: i * (a - i), lambda i: first + 2 * i)
        # Only the branch that converges is worked out.
        return F.when(x <= 0, F.lit(1.0)).when(x < a + 1, 1 - front * series).otherwise(front * fraction)

    return _let(body, a=df / 2, x=x / 2)


def _log_beta(a: Column, b: Column) -> Column:
    """The logarithm of the beta function. For a large argument the difference of two large logarithms is expanded, not taken."""

    def body(v: Column) -> Column:
        small, large = v["small"], v["large"]
        both = small + large
        rest = lambda u: (1 / F.lit(12.0) - (1 / F.lit(360.0) - 1 / (1260 * u * u)) / (u * u)) / u
        grown = (large - 0.5) * F.log1p(small / large) + small * F.log(both) - small + rest(both) - rest(large)
        return log_gamma(small) - F.when(large > 30, grown).otherwise(log_gamma(both) - log_gamma(large))

    return _let(body, small=F.least(a, b), large=F.greatest(a, b))


def _beta_part(x: Column, y: Column, a: Column, b: Column) -> Column:
    """The regularised incomplete beta function at x = 1 - y where x < (a + 1) / (a + b + 2)."""
    logarithm = lambda v, rest: F.when(rest < 0.5, F.log1p(-rest)).otherwise(F.log(v))
    front = F.exp(a * logarithm(x, y) + b * logarithm(y, x) - _log_beta(a, b)) / a
    first = 1 / (1 - (a + b) * x / (a + 1))

    def numerator(acc: Column, i: Column) -> Column:
        # Terms 2m and 2m + 1 of the fraction, in turn.
        k = i + 1
        m = F.floor(k / 2).cast("double")
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return F.when(k % 2 == 0, even).otherwise(odd)

    return front * _lentz({"c": F.lit(1.0), "d": first, "h": first}, numerator, lambda i: F.lit(1.0))


def f_tail(f: Column, df1: Column, df2: Column) -> Column:
    """The probability of an F value over ``f``."""

    def body(v: Column) -> Column:
        # The side on which the fraction converges; the other one's value is its rest.
        turned = v["under"] < (v["b"] + 1) / (v["a"] + v["b"] + 2)
        side = lambda yes, no: F.when(turned, v[yes]).otherwise(v[no])
        part = _let(
            lambda w: _beta_part(w["x"], w["y"], w["a"], w["b"]), x=side("under", "over"), y=side("over", "under"), a=side("b", "a"), b=side("a", "b")
        )
        return F.when(v["over"] <= 0, F.lit(1.0)).when(turned, part).otherwise(1 - part)

    total = df2 + df1 * f
    return _let(body, over=df1 * f / total, under=df2 / total, a=df1 / 2, b=df2 / 2)


def t_tail_both(t: Column, df: Column) -> Column:
    """The probability of a t value as far from 0 as ``t``, on either side."""
    return f_tail(t * t, F.lit(1.0), df)
