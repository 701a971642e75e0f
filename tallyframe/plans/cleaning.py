"""Named cleaning steps, and the default cleaning."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import DataFrame

from tallyframe.functions import numeric_columns
from tallyframe.operators.missing import handle_missing_values
from tallyframe.operators.outliers import handle_outliers

Step = tuple[str, Callable[..., DataFrame], dict[str, Any]]


class StepFailed(RuntimeError):
    """A cleaning step could not be built; the message names it."""


def clean_with(df: DataFrame, steps: Sequence[Step]) -> DataFrame:
    """Run ``(name, function, options)`` steps in order."""
    out = df
    for name, function, options in steps:
        try:
            out = function(out, **options)
        except Exception as error:
            raise StepFailed(f"cleaning step {name!r} failed: {error}") from error
    return out


def default_steps(
    df: DataFrame,
    fill_values: dict[str, Any] | None = None,
    missing_threshold: float = 0.5,
    outliers: bool = True,
    sequential: bool = True,
    exact: bool = True,
) -> list[Step]:
    """Fill what is mostly missing, then remove outliers of the numeric columns.

    Statistics are those of the whole table at any size.
    """
    steps: list[Step] = [
        (
            "missing values",
            handle_missing_values,
            {"strategy": "fill_values", "threshold": missing_threshold, "fill_values": fill_values},
        )
    ]
    numbers = numeric_columns(df)
    if outliers and numbers:
        steps.append(
            (
                "outliers",
                handle_outliers,
                {"columns": numbers, "method": "iqr", "strategy": "remove", "sequential": sequential, "exact": exact},
            )
        )
    return steps


def default_clean(df: DataFrame, **options: Any) -> DataFrame:
    return clean_with(df, default_steps(df, **options))
