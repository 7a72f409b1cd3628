"""Clustered files: rows near each other in several columns go to the same files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tierflow.functions.naming import quoted
from tierflow.operators.sinks import overlaps, source_folders

KEY = "_cluster_key"
_KINDS = ("tinyint", "smallint", "int", "bigint", "float", "double", "date", "timestamp", "timestamp_ntz")


def _range_id(value: Column, bounds: Sequence) -> Column:
    """Number of bounds at or below a value, by halving; NULL counts as the smallest."""
    if not bounds:
        return F.lit(0)
    middle = len(bounds) // 2
    above = _range_id(value, bounds[middle + 1 :])
    return F.when(value >= F.lit(bounds[middle]), above + (middle + 1)).otherwise(_range_id(value, bounds[:middle]))


def space_filling_key(frame: DataFrame, columns: Sequence[str], bits: int = 6) -> Column:
    """A whole number that keeps near in all ``columns`` what is near in the number: the bits of the
    columns' range ids in turns (Z-order), the highest first.

    Ranges hold about as many rows each, going by approximate quantiles that one pass takes of all columns
    at once; ``2**bits - 1`` bounds a column reach the driver. Numbers, dates and times can be clustered.
    """
    kinds = dict(frame.dtypes)
    wrong = [c for c in columns if kinds.get(c) not in _KINDS and not str(kinds.get(c)).startswith("decimal")]
    if wrong or not columns:
        raise ValueError(f"cannot cluster by {wrong or 'no columns'}")
    if not 1 <= bits * len(columns) <= 62:
        raise ValueError("too many bits for one key")
    shares = [i / 2**bits for i in range(1, 2**bits)]
    found = frame.agg(*[F.percentile_approx(quoted(c), shares, 10_000).alias(f"c{i}") for i, c in enumerate(columns)]).first()
    ids = []
    for i, c in enumerate(columns):
        bounds = sorted(set(found[f"c{i}"] or ()))
        ids.append(F.coalesce(_range_id(quoted(c), bounds), F.lit(0)).cast("bigint"))
    key = F.lit(0).cast("bigint")
    place = bits * len(columns)
    for bit in reversed(range(bits)):
        for number in ids:
            place -= 1
            key = key.bitwiseOR(F.shiftleft(F.shiftright(number, bit).bitwiseAND(F.lit(1)), place))
    return key


def write_clustered(frame: DataFrame, path: str, columns: Sequence[str], files: int, *, bits: int = 6) -> int:
    """Write ``files`` Parquet files clustered by ``columns``; returns the number of rows.

    Rows are dealt out by ranges of their key, not by its hash, so that a file covers one stretch of it and
    the footers' smallest and largest values let a filter on any of the columns leave files out. A crowded
    key is spread over several files by the hash of the whole row. Empty ranges give no file.
    """
    if files < 1:
        raise ValueError("files must be at least 1")
    clash = overlaps(path, source_folders(frame))
    if clash:
        raise ValueError(f"refusing to overwrite {path}: it overlaps the source {clash}")
    if KEY in frame.columns:
        raise ValueError(f"the rows must not have a column {KEY}")
    keyed = frame.withColumn(KEY, space_filling_key(frame, columns, bits))
    dealt = keyed.repartitionByRange(files, KEY, F.xxhash64(*map(quoted, frame.columns)))
    counted = Observation()
    rows = dealt.sortWithinPartitions(KEY, *map(quoted, columns)).drop(KEY).observe(counted, F.count(F.lit(1)).alias("n"))
    rows.write.mode("overwrite").parquet(path)
    return counted.get["n"]
