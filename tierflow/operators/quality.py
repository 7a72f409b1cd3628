"""Data quality rules: a report per rule, and rows flagged with the rules they break.

As in SQL constraints, only ``NotNull`` objects to NULL; every other rule lets it pass.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierflow.functions.naming import free_name, quoted
from tierflow.operators.joins import KeyLimits, all_set, key_sizes, mark_by_key
from tierflow.operators.sinks import write_files
from tierflow.session import scratch_path

FAILED_RULES = "_failed_rules"


@dataclass(frozen=True)
class NotNull:
    name: str
    column: str

    def failed(self) -> Column:
        return quoted(self.column).isNull()


@dataclass(frozen=True)
class InRange:
    name: str
    column: str
    low: object = None
    high: object = None

    def failed(self) -> Column:
        value = quoted(self.column)
        below = F.lit(False) if self.low is None else value < F.lit(self.low)
        above = F.lit(False) if self.high is None else value > F.lit(self.high)
        return below | above


@dataclass(frozen=True)
class InSet:
    name: str
    column: str
    allowed: tuple

    def failed(self) -> Column:
        return ~quoted(self.column).isin(*self.allowed)


@dataclass(frozen=True)
class Matches:
    name: str
    column: str
    pattern: str

    def failed(self) -> Column:
        return ~quoted(self.column).rlike(self.pattern)


@dataclass(frozen=True)
class Unique:
    name: str
    columns: tuple[str, ...]


@dataclass(frozen=True)
class ForeignKey:
    name: str
    column: str
    parent: DataFrame
    parent_column: str


RowRule = NotNull | InRange | InSet | Matches
Rule = RowRule | Unique | ForeignKey


def _parent_keys(rule: ForeignKey) -> DataFrame:
    return (
        rule.parent.select(quoted(rule.parent_column).alias("_parent"))
        .filter(F.col("_parent").isNotNull())
        .distinct()
    )


def _columns_of(rule: Unique | ForeignKey) -> list[str]:
    return list(rule.columns) if isinstance(rule, Unique) else [rule.column]


def all_key_sizes(frame: DataFrame, rules: Sequence[Unique | ForeignKey]) -> tuple[DataFrame, list[list[str]]]:
    """Rows per key for the keys of all rules, in one pass: ``_set``, all key columns (NULL where they are
    not of the set) and ``_size``; and the columns of each set.

    A rule whose columns are among those of another has no set of its own: its sizes are sums of the
    other's. The rest are grouping sets of one aggregate, counted before the shuffle.
    """
    keys = [list(dict.fromkeys(_columns_of(r))) for r in rules]
    largest = [k for k in keys if not any(set(k) < set(other) for other in keys)]
    sets = list({frozenset(k): k for k in largest}.values())
    columns = list(dict.fromkeys(c for s in sets for c in s))
    # Named by place, so that no column's name can clash with a helper's.
    rows = frame.select(*[quoted(c).alias(f"_k{i}") for i, c in enumerate(columns)])
    names = [[f"_k{columns.index(c)}" for c in s] for s in sets]
    size = F.count(F.lit(1)).alias("_size")
    if len(sets) == 1:
        counted = rows.groupBy(*names[0]).agg(size).withColumn("_set", F.lit(0))
    else:
        grouped = rows.groupingSets([[F.col(n) for n in s] for s in names], *rows.columns)
        # One bit for each column that a set leaves out, the first column highest.
        ids = [sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in s) for s in sets]
        place = F.create_map(*[F.lit(x) for pair in ((i, n) for n, i in enumerate(ids)) for x in pair])
        counted = grouped.agg(size, F.grouping_id().cast("int").alias("_gid"))
        counted = counted.withColumn("_set", place[F.col("_gid")])
    shown = [F.col(f"_k{i}").alias(f"_key{i}") for i in range(len(columns))]
    return counted.select("_set", *shown, "_size"), [[*s] for s in sets]


def _shared_sizes(frame: DataFrame, rules: Sequence[Rule]) -> dict[str, DataFrame]:
    """Rows per key of each key rule, by its name, from one written pass over the rows."""
    key_rules = [r for r in rules if isinstance(r, (Unique, ForeignKey))]
    if len(key_rules) < 2:
        return {}
    counted, sets = all_key_sizes(frame, key_rules)
    columns = list(dict.fromkeys(c for s in sets for c in s))
    path = scratch_path(frame.sparkSession, "key-sizes")
    counted.write.parquet(path)
    written = frame.sparkSession.read.schema(counted.schema).parquet(path)
    found = {}
    for rule in key_rules:
        mine = list(dict.fromkeys(_columns_of(rule)))
        number = next(i for i, s in enumerate(sets) if set(mine) <= set(s))
        kept = [F.col(f"_key{columns.index(c)}").alias(c) for c in mine]
        rows = written.filter(F.col("_set") == number).select(*kept, "_size")
        if len(mine) < len(sets[number]):
            rows = rows.groupBy(*map(quoted, mine)).agg(F.sum("_size").alias("_size"))
        found[rule.name] = rows
    return found


def _judged(
    frame: DataFrame, rule: Unique | ForeignKey, sizes: DataFrame | None = None
) -> tuple[DataFrame, list[str]]:
    """Every key of the rows once, as ``columns, _size, _bad``. A key with a NULL is never bad."""
    columns = _columns_of(rule)
    sizes = key_sizes(frame, columns) if sizes is None else sizes
    if isinstance(rule, Unique):
        return sizes.withColumn("_bad", (F.col("_size") > 1) & all_set(columns)), columns
    column = quoted(rule.column)
    joined = sizes.join(_parent_keys(rule), column == F.col("_parent"), "left")
    orphaned = column.isNotNull() & F.col("_parent").isNull()
    return joined.select(column, "_size", orphaned.alias("_bad")), [rule.column]


def _summary(rule: Unique | ForeignKey, judged: DataFrame) -> DataFrame:
    bad = F.sum(F.when(F.col("_bad"), F.col("_size")))
    return judged.agg(
        F.coalesce(F.sum("_size"), F.lit(0)).cast("bigint").alias("checked"),
        F.coalesce(bad, F.lit(0)).cast("bigint").alias("failed"),
    ).select(F.lit(rule.name).alias("rule"), "checked", "failed")


def _require_names(rules: Sequence[Rule]) -> None:
    if not rules:
        raise ValueError("no rules given")
    if len({rule.name for rule in rules}) < len(rules):
        raise ValueError("rule names must differ")


def check_quality(frame: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``rule, checked, failed``: all row rules in one pass, all key rules in another.

    With two key rules or more the sizes of their keys are written to the shared folder at once.
    """
    _require_names(rules)
    row_rules = [r for r in rules if not isinstance(r, (Unique, ForeignKey))]
    parts = []
    if row_rules:
        totals = frame.agg(
            F.count(F.lit(1)).alias("checked"),
            *[F.count_if(rule.failed()).alias(f"f{i}") for i, rule in enumerate(row_rules)],
        )
        entries = F.array(
            *[
                F.struct(
                    F.lit(rule.name).alias("rule"),
                    F.col("checked"),
                    F.col(f"f{i}").cast("bigint").alias("failed"),
                )
                for i, rule in enumerate(row_rules)
            ]
        )
        parts.append(totals.select(F.inline(entries)))
    sizes = _shared_sizes(frame, rules)
    for rule in rules:
        if isinstance(rule, (Unique, ForeignKey)):
            judged, _ = _judged(frame, rule, sizes.get(rule.name))
            parts.append(_summary(rule, judged))
    return reduce(DataFrame.unionByName, parts)


def _checked(
    frame: DataFrame, rules: Sequence[Rule], limits: KeyLimits
) -> tuple[DataFrame, dict[str, Column]]:
    """The rows with one helper column per key rule, and for each rule whether a row breaks it."""
    _require_names(rules)
    marked, broken, sizes = frame, {}, _shared_sizes(frame, rules)
    for number, rule in enumerate(rules):
        if isinstance(rule, (Unique, ForeignKey)):
            judged, columns = _judged(frame, rule, sizes.get(rule.name))
            mark = free_name(marked, f"_mark{number}")
            marked = mark_by_key(marked, judged, columns, mark, limits)
            broken[rule.name] = F.col(mark)
        else:
            broken[rule.name] = F.coalesce(rule.failed(), F.lit(False))
    return marked, broken


def _names(broken: dict[str, Column]) -> Column:
    listed = F.array(*[F.when(failed, F.lit(name)) for name, failed in broken.items()])
    # Unlike array_compact this stays in generated code.
    return F.array_except(listed, F.array(F.lit(None).cast("string"))).alias(FAILED_RULES)


def _columns(frame: DataFrame) -> list[Column]:
    return [quoted(name) for name in frame.columns]


def flag_quality(
    frame: DataFrame, rules: Sequence[Rule], limits: KeyLimits = KeyLimits()
) -> DataFrame:
    """Every row, with the names of the rules it breaks in ``_failed_rules``.

    For a key rule the offending keys are found at once, on counts per key, and written to the shared
    folder; the rows, still lazy, are then marked against them (see ``mark_by_key``).
    """
    marked, broken = _checked(frame, rules, limits)
    return marked.select(*_columns(frame), _names(broken))


def split_quality(
    frame: DataFrame, rules: Sequence[Rule], limits: KeyLimits = KeyLimits()
) -> tuple[DataFrame, DataFrame]:
    """Rows that pass, in their own schema, and quarantined rows with ``_failed_rules``.

    Each of the two is a run of its own over the rows; ``write_quality`` writes both in one.
    """
    marked, broken = _checked(frame, rules, limits)
    bad = reduce(Column.__or__, broken.values())
    passed = marked.filter(~bad).select(*_columns(frame))
    return passed, marked.filter(bad).select(*_columns(frame), _names(broken))


def write_quality(
    frame: DataFrame, rules: Sequence[Rule], path: str, limits: KeyLimits = KeyLimits()
) -> tuple[DataFrame, DataFrame]:
    """Write passed and quarantined rows in one pass, as two partitions below ``path``, and read each
    back as ``split_quality`` gives it."""
    passed = free_name(frame, "_passed")
    flagged = flag_quality(frame, rules, limits)
    write_files(flagged.withColumn(passed, F.size(FAILED_RULES) == 0), path, partition_by=[passed])
    back = frame.sparkSession.read.schema(flagged.schema.add(passed, "boolean")).parquet(path)
    good, bad = back.filter(quoted(passed)), back.filter(~quoted(passed))
    return good.select(*_columns(frame)), bad.select(*_columns(frame), quoted(FAILED_RULES))
