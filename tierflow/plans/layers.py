"""Chains of steps through the bronze, silver and gold layers."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tierflow.functions.naming import layer_path, sanitize
from tierflow.operators.sinks import write_files
from tierflow.plans.transform import transform_sql

Build = Callable[[Mapping[str, DataFrame]], DataFrame]


@dataclass(frozen=True)
class Step:
    """One named dataset of a layer, built from earlier ones by a SQL text or a function."""

    name: str
    layer: str
    inputs: Sequence[str]
    build: str | Build
    partition_by: Sequence[str] = ()
    sort_by: Sequence[str] = ()


def run_layers(
    spark: SparkSession,
    root: str,
    sources: Mapping[str, DataFrame],
    steps: Sequence[Step],
) -> dict[str, DataFrame]:
    """Run steps in order, each written to its layer and read back from there by later ones.

    Reading back cuts the lineage: a lost executor repeats at most the running step.
    """
    known = dict(sources)
    for step in steps:
        missing = [name for name in step.inputs if name not in known]
        if missing:
            raise ValueError(f"step {step.name} needs {missing}, which no earlier step gives")
        inputs = {name: known[name] for name in step.inputs}
        built = (
            transform_sql(spark, inputs, step.build)
            if isinstance(step.build, str)
            else step.build(inputs)
        )
        path = layer_path(root, step.layer, sanitize(step.name))
        write_files(
            built, path, "overwrite", partition_by=step.partition_by, sort_by=step.sort_by
        )
        known[step.name] = spark.read.parquet(path)
    return known
