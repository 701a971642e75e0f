from .columns import (
    col,
    duration_seconds,
    family,
    is_missing,
    known,
    numeric_columns,
    present,
    text_columns,
)

__all__ = [
    "col",
    "duration_seconds",
    "family",
    "is_missing",
    "known",
    "numeric_columns",
    "present",
    "text_columns",
]
