from .aggregate import group_analysis, group_and_aggregate, pivot_table, top_n_with_others, union_by_name, value_counts
from .filters import (
    filter_by_range,
    filter_by_value,
    filter_condition,
    filter_data,
    filter_where,
    non_blank,
    search_text,
)
from .missing import (
    drop_missing_columns,
    drop_missing_rows,
    fill_missing,
    handle_missing_values,
    impute,
    missing_profile,
    missing_summary,
)
from .outliers import OutlierRules, fit_outliers, handle_outliers, outlier_counts
from .project import add_calculated_column, add_derived_column, select_columns
from .scaling import ScalingRules, fit_scaling, normalize_data
from .sorting import line_series, preview, sort_values
from .sql import execute_sql
from .text import keywords, longest_texts, text_analysis, text_summary, tokenize, word_frequency
from .timeseries import resample
from .types import coerce_numeric, column_types, convert_data_types, detect_free_text, narrow_integers
from .udf import apply_columns, apply_rows, merge_aggregate

__all__ = [n for n in dir() if not n.startswith("_")]
