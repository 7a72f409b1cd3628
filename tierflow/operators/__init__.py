from tierflow.operators.bands import overlap_join, point_join
from tierflow.operators.combine import combine, mismatch, register
from tierflow.operators.dedup import dedup_exact, dedup_latest
from tierflow.operators.drift import Conflict, Drift, conformed, drift, merged_schema, scan_drifting, widened
from tierflow.operators.flatten import flatten_root
from tierflow.operators.gold import gold_aggregate
from tierflow.operators.joins import KeyLimits, broadcast_if_small, mark_by_key
from tierflow.operators.layout import space_filling_key, write_clustered
from tierflow.operators.profile import preview, row_counts, schema_report
from tierflow.operators.quality import (
    ForeignKey,
    InRange,
    InSet,
    Matches,
    NotNull,
    Unique,
    check_quality,
    flag_quality,
    split_quality,
    write_quality,
)
from tierflow.operators.silver import clean, standardize
from tierflow.operators.sinks import run_rows, write_files, write_run
from tierflow.operators.sketches import Distinct, Members, Quantiles, estimates, in_both, sketch_gold, unite
from tierflow.operators.tables import ensure_namespace, publish_table
from tierflow.operators.upsert import UpsertResult, upsert, upserted_rows
from tierflow.operators.windows import Over, ordered_window

__all__ = [
    "Conflict",
    "Distinct",
    "Drift",
    "ForeignKey",
    "InRange",
    "InSet",
    "KeyLimits",
    "Matches",
    "Members",
    "NotNull",
    "Over",
    "Quantiles",
    "Unique",
    "UpsertResult",
    "broadcast_if_small",
    "check_quality",
    "clean",
    "combine",
    "conformed",
    "dedup_exact",
    "dedup_latest",
    "drift",
    "ensure_namespace",
    "estimates",
    "flag_quality",
    "flatten_root",
    "gold_aggregate",
    "in_both",
    "mark_by_key",
    "merged_schema",
    "mismatch",
    "ordered_window",
    "overlap_join",
    "point_join",
    "preview",
    "publish_table",
    "register",
    "row_counts",
    "run_rows",
    "scan_drifting",
    "schema_report",
    "sketch_gold",
    "space_filling_key",
    "split_quality",
    "write_quality",
    "write_run",
    "standardize",
    "unite",
    "upsert",
    "upserted_rows",
    "write_files",
]
