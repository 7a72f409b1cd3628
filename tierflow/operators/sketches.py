"""Sketches in gold rows: small summaries that can be united over any periods.

A distinct count or a median of a month cannot be had from those of its days, but from the days' sketches
it can, within a known error and without the rows.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierflow.functions.naming import quoted
from tierflow.operators.gold import gold_aggregate


@dataclass(frozen=True)
class Distinct:
    """Distinct values of a column, in a HyperLogLog sketch of ``2**size`` registers."""

    column: str
    size: int = 12

    def sketch(self) -> Column:
        return F.hll_sketch_agg(quoted(self.column), self.size)

    def united(self, name: str) -> Column:
        return F.hll_union_agg(quoted(name))

    @staticmethod
    def estimate(sketch: Column) -> Column:
        return F.hll_sketch_estimate(sketch)

    @property
    def error(self) -> float:
        """Relative error that an estimate exceeds once in about a hundred cases."""
        return 2.6 * 1.04 / math.sqrt(2**self.size)


@dataclass(frozen=True)
class Members:
    """A column's values as a set, in a theta sketch that keeps ``2**size`` hashes: sets of different
    periods can also be intersected and subtracted."""

    column: str
    size: int = 12

    def sketch(self) -> Column:
        return F.theta_sketch_agg(quoted(self.column), self.size)

    def united(self, name: str) -> Column:
        return F.theta_union_agg(quoted(name), self.size)

    @staticmethod
    def estimate(sketch: Column) -> Column:
        return F.theta_sketch_estimate(sketch)

    @property
    def error(self) -> float:
        """Relative error of a union, exceeded once in about a hundred cases; that of an intersection is
        larger by the root of union over intersection."""
        return 2.6 / math.sqrt(2**self.size)


@dataclass(frozen=True)
class Quantiles:
    """Quantiles of a numeric column, in a KLL sketch with parameter ``size``."""

    column: str
    size: int = 400

    def sketch(self) -> Column:
        return F.kll_sketch_agg_double(quoted(self.column).cast("double"), self.size)

    def united(self, name: str) -> Column:
        return F.kll_merge_agg_double(quoted(name), self.size)

    @staticmethod
    def estimate(sketch: Column, share: float = 0.5) -> Column:
        return F.kll_sketch_get_quantile_double(sketch, F.lit(share))

    @property
    def error(self) -> float:
        """Error of an estimate's rank as a share of all rows, exceeded once in about a hundred cases."""
        return 2.296 / self.size**0.9723


Sketch = Distinct | Members | Quantiles


def sketch_gold(
    frame: DataFrame,
    dims: Sequence[str],
    sketches: Mapping[str, Sketch],
    grain: str,
    ts: str,
    measures: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Gold rows by ``dims`` and ``period`` with a sketch column each, and exact ``measures`` besides.

    A sketch is built inside tasks before the shuffle, so a crowded group travels as one sketch per task,
    of a size that its parameter bounds. NULLs are in no sketch; a group of NULLs alone has an empty one
    (quantiles of it are NULL).
    """
    columns = {**(measures or {}), **{name: s.sketch() for name, s in sketches.items()}}
    return gold_aggregate(frame, dims, columns, grain=grain, ts=ts)


def unite(
    gold: DataFrame,
    by: Sequence[str | Column],
    sketches: Mapping[str, Sketch],
    measures: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Gold rows of any set of periods as one row per ``by``, their sketches united."""
    keys = [quoted(b) if isinstance(b, str) else b for b in by]
    columns = {**(measures or {}), **{name: s.united(name) for name, s in sketches.items()}}
    return gold.groupBy(*keys).agg(*[value.alias(name) for name, value in columns.items()])


def estimates(united: DataFrame, sketches: Mapping[str, Sketch], shares: Sequence[float] = (0.5,)) -> DataFrame:
    """Sketch columns as numbers: a count, or for quantiles an array with one value per share."""
    columns = []
    for name in united.columns:
        sketch = sketches.get(name)
        if sketch is None:
            columns.append(quoted(name))
        elif isinstance(sketch, Quantiles):
            some = F.kll_sketch_get_n_double(quoted(name)) > 0
            found = F.array(*[sketch.estimate(quoted(name), s) for s in shares])
            columns.append(F.when(some, found).alias(name))
        else:
            columns.append(sketch.estimate(quoted(name)).alias(name))
    return united.select(*columns)


def in_both(a: str, b: str) -> Column:
    """Estimated number of values that two ``Members`` sketches share."""
    return F.theta_sketch_estimate(F.theta_intersection(quoted(a), quoted(b)))
