from tierflow.functions.exprs import exact_avg, exact_sum, exact_sum_sql
from tierflow.functions.naming import (
    layer_path,
    normalize_path,
    normalize_path_col,
    sanitize,
    sanitize_col,
    split_table_name,
    target_table,
    target_table_col,
)

__all__ = [
    "exact_avg",
    "exact_sum",
    "exact_sum_sql",
    "layer_path",
    "normalize_path",
    "normalize_path_col",
    "sanitize",
    "sanitize_col",
    "split_table_name",
    "target_table",
    "target_table_col",
]
