from tierflow.plans.history import (
    ingest_status,
    job_duration_stats,
    job_events,
    job_metrics,
    job_queue_depth,
    job_resource_usage,
    job_status,
    job_success_rate,
    list_jobs,
)
from tierflow.plans.incremental import gold_rows, load_periods, refresh_gold, silver_rows
from tierflow.plans.ingest import ingest, land_bronze
from tierflow.plans.layers import Step, run_layers
from tierflow.plans.ledger import RunLedger
from tierflow.plans.transform import (
    Resources,
    RunResult,
    run_layer_transform,
    run_transform,
    split_script,
    transform_sql,
)

__all__ = [
    "Resources",
    "RunLedger",
    "RunResult",
    "Step",
    "gold_rows",
    "ingest",
    "ingest_status",
    "job_duration_stats",
    "job_events",
    "job_metrics",
    "job_queue_depth",
    "job_resource_usage",
    "job_status",
    "job_success_rate",
    "land_bronze",
    "list_jobs",
    "load_periods",
    "refresh_gold",
    "run_layer_transform",
    "run_layers",
    "run_transform",
    "silver_rows",
    "split_script",
    "transform_sql",
]
