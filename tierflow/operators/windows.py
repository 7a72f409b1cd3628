"""Window functions over a crowded partition, or over the whole relation without any.

Spark sends all rows of a window partition to one task. Here the rows are cut into pieces by range of
partition and order, so that a crowded partition spans many pieces. Each piece is windowed by itself, and
what it needs to know of the pieces before and after it (rows, sums, the last few rows, ties across the
border) is carried over from one row per piece.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tierflow.session import scratch_path

_RANKS = ("rank", "dense_rank", "percent_rank")


@dataclass(frozen=True)
class Over:
    """One window function; frames are by rows and end at the current row."""

    kind: str
    column: str | None = None
    offset: int = 0
    default: object = None

    @staticmethod
    def row_number() -> Over:
        return Over("row_number")

    @staticmethod
    def rank() -> Over:
        return Over("rank")

    @staticmethod
    def dense_rank() -> Over:
        return Over("dense_rank")

    @staticmethod
    def percent_rank() -> Over:
        return Over("percent_rank")

    @staticmethod
    def ntile(buckets: int) -> Over:
        if buckets < 1:
            raise ValueError("ntile needs at least one bucket")
        return Over("ntile", offset=buckets)

    @staticmethod
    def running_count(column: str | None = None) -> Over:
        """Rows so far, or values of ``column`` that are not NULL."""
        return Over("running_count", column)

    @staticmethod
    def running_sum(column: str) -> Over:
        return Over("running_sum", column)

    @staticmethod
    def running_min(column: str) -> Over:
        return Over("running_min", column)

    @staticmethod
    def running_max(column: str) -> Over:
        return Over("running_max", column)

    @staticmethod
    def moving_sum(column: str, preceding: int) -> Over:
        """Sum of the current row and ``preceding`` rows before it."""
        if preceding < 0:
            raise ValueError("preceding must not be negative")
        return Over("moving_sum", column, preceding)

    @staticmethod
    def first_value(column: str) -> Over:
        return Over("first_value", column)

    @staticmethod
    def lag(column: str, offset: int = 1, default: object = None) -> Over:
        if offset < 1:
            raise ValueError("offset must be at least 1")
        return Over("lag", column, offset, default)

    @staticmethod
    def lead(column: str, offset: int = 1, default: object = None) -> Over:
        if offset < 1:
            raise ValueError("offset must be at least 1")
        return Over("lead", column, offset, default)


@dataclass(frozen=True)
class _Layout:
    """Names and expressions that all steps share."""

    parts: tuple[str, ...]
    order: tuple[tuple[str, bool], ...]  # column, descending
    ties: tuple[str, ...]

    @property
    def part(self) -> Column:
        fields = [F.col(p).alias(f"p{i}") for i, p in enumerate(self.parts)]
        return F.struct(*(fields or [F.lit(True).alias("all")]))

    @property
    def key(self) -> Column:
        return F.struct(*[F.col(c).alias(f"k{i}") for i, (c, _) in enumerate(self.order)])

    def by(self, backwards: bool = False, ties: bool = True) -> list[Column]:
        """Ascending puts NULL first and descending last, in both directions of reading."""
        columns = [*self.order, *[(t, False) for t in (self.ties if ties else ())]]
        return [F.col(c).desc() if down != backwards else F.col(c).asc() for c, down in columns]

    def inside(self, ties: bool = True) -> Window:
        return Window.partitionBy("_piece", *self.parts).orderBy(*self.by(ties=ties))

    def whole(self) -> Window:
        return Window.partitionBy("_piece", *self.parts)


def _ordering(order_by: Sequence[str | tuple[str, str]]) -> tuple[tuple[str, bool], ...]:
    found = []
    for item in order_by:
        name, direction = (item, "asc") if isinstance(item, str) else item
        if direction not in ("asc", "desc"):
            raise ValueError(f"order must be asc or desc, got {direction!r}")
        found.append((name, direction == "desc"))
    if not found:
        raise ValueError("no order given")
    return tuple(found)


def written(frame: DataFrame, name: str) -> DataFrame:
    path = scratch_path(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def _border_rows(rows: DataFrame, layout: _Layout) -> DataFrame:
    """Rows of the first and the last partition of each piece: only these go on in other pieces."""
    keyed = rows.withColumn("_part", layout.part)
    if not layout.parts:
        return keyed
    ends = rows.groupBy(F.col("_piece").alias("_of")).agg(
        F.min(layout.part).alias("_low"), F.max(layout.part).alias("_high")
    )
    # One row per piece.
    joined = keyed.join(F.broadcast(ends), F.col("_piece") == F.col("_of"))
    at_border = F.col("_part").eqNullSafe(F.col("_low")) | F.col("_part").eqNullSafe(F.col("_high"))
    return joined.filter(at_border).drop("_of", "_low", "_high")


def _end_rows(rows: DataFrame, layout: _Layout, columns: list[str], n: int, backwards: bool) -> DataFrame:
    """``_piece, _part, rows``: the last (or first) ``n`` rows of each border partition in their order, as
    an array of their ``columns``. A rank limit keeps all but these out of the shuffle."""
    window = Window.partitionBy("_piece", "_part").orderBy(*layout.by(backwards))
    ranked = rows.withColumn("_n", F.row_number().over(window)).filter(F.col("_n") <= n)
    place = -F.col("_n") if backwards else F.col("_n")
    entry = F.struct(place.alias("n"), *[F.col(c).alias(f"v{i}") for i, c in enumerate(columns)])
    return ranked.groupBy("_piece", "_part").agg(F.sort_array(F.collect_list(entry)).alias("rows"))


def _tie_edges(rows: DataFrame, layout: _Layout) -> DataFrame:
    """``_piece, _part``, first and last key, rows with the last key, and number of keys."""
    fields = [F.col(f"_key.k{i}").desc() if down else F.col(f"_key.k{i}").asc() for i, (_, down) in enumerate(layout.order)]
    keys = rows.groupBy("_piece", "_part", layout.key.alias("_key")).agg(F.count(F.lit(1)).alias("_c"))
    at = F.row_number().over(Window.partitionBy("_piece", "_part").orderBy(*fields))
    return keys.withColumn("_at", at).groupBy("_piece", "_part").agg(
        F.min_by("_key", "_at").alias("first_key"),
        F.max_by("_key", "_at").alias("last_key"),
        F.max_by("_c", "_at").alias("n_last"),
        F.max("_at").cast("bigint").alias("keys"),
    )


def _carried(rows: DataFrame, layout: _Layout, columns: Sequence[Over]) -> DataFrame:
    """What each piece needs of the others: two rows per piece at most, ``_piece, _part`` and a struct."""
    used = list(dict.fromkeys(c.column for c in columns if c.column))
    spec = {f"c{i}": c for i, c in enumerate(columns)}
    border = _border_rows(rows, layout)
    functions = {"running_sum": F.sum, "running_min": F.min, "running_max": F.max}
    totals = [F.count(F.lit(1)).alias("n")]
    for name, c in spec.items():
        if c.kind in functions:
            totals.append(functions[c.kind](F.col(c.column)).alias(name))
        elif c.kind == "running_count":
            totals.append(F.count(F.col(c.column) if c.column else F.lit(1)).alias(name))
    edges = border.groupBy("_piece", "_part").agg(*totals)

    def add(other: DataFrame) -> DataFrame:
        renamed = other.withColumnRenamed("_piece", "_its_piece").withColumnRenamed("_part", "_its_part")
        same = (F.col("_piece") == F.col("_its_piece")) & F.col("_part").eqNullSafe(F.col("_its_part"))
        return edges.join(renamed, same, "left").drop("_its_piece", "_its_part")

    tail = max((c.offset for c in spec.values() if c.kind in ("lag", "moving_sum")), default=0)
    head = max((c.offset for c in spec.values() if c.kind == "lead"), default=0)
    head = max(head, int(any(c.kind == "first_value" for c in spec.values())))
    if tail:
        edges = add(_end_rows(border, layout, used, tail, True).withColumnRenamed("rows", "tail"))
    if head:
        edges = add(_end_rows(border, layout, used, head, False).withColumnRenamed("rows", "head"))
    ranked = any(c.kind in _RANKS for c in spec.values())
    if ranked:
        edges = add(_tie_edges(border, layout))

    along = Window.partitionBy("_part").orderBy("_piece")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    fields = [
        F.coalesce(F.sum("n").over(before), F.lit(0).cast("bigint")).alias("n"),
        F.sum("n").over(Window.partitionBy("_part")).alias("total"),
    ]
    for name, c in spec.items():
        if c.kind in ("running_sum", "running_count"):
            fields.append(F.sum(name).over(before).alias(name))
        elif c.kind in functions:
            fields.append(functions[c.kind](name).over(before).alias(name))
    if tail:
        # Every piece has a row of the partition, so as many pieces hold as many rows.
        near = F.flatten(F.collect_list("tail").over(along.rowsBetween(-tail, -1)))
        fields.append(F.slice(near, F.greatest(F.size(near) - tail, F.lit(0)) + 1, tail).alias("tail"))
    if head:
        fields.append(F.slice(F.flatten(F.collect_list("head").over(along.rowsBetween(1, head))), 1, head).alias("head"))
        fields.append(F.first("head").over(before).alias("start"))
    if ranked:
        by_key = Window.partitionBy("_part", "last_key").orderBy("_piece")
        goes_on = F.lag("last_key").over(along).eqNullSafe(F.col("first_key")) & (F.row_number().over(along) > 1)
        edges = edges.withColumn("_same", F.sum("n_last").over(by_key)).withColumn("_joins", goes_on)
        fields += [
            F.col("first_key"),
            # Rows of earlier pieces with the first key of this one.
            F.when(F.col("_joins"), F.lag("_same").over(along)).otherwise(0).cast("bigint").alias("ties"),
            (
                F.coalesce(F.sum("keys").over(before), F.lit(0))
                - F.sum(F.col("_joins").cast("bigint")).over(along.rowsBetween(Window.unboundedPreceding, 0))
            ).alias("keys"),
        ]
    return edges.select("_piece", "_part", F.struct(*fields).alias("_carry"))


def _result(c: Over, name: str, layout: _Layout, used: list[str], types: Mapping[str, str]) -> Column:
    inside, whole = layout.inside(), layout.whole()
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    of = lambda field: F.col("_carry")[field]
    before = F.coalesce(of("n"), F.lit(0).cast("bigint"))
    at = F.row_number().over(inside).cast("bigint")
    value = F.col(c.column) if c.column else None
    field = f"v{used.index(c.column)}" if c.column else ""
    if c.kind == "row_number":
        return before + at
    if c.kind in _RANKS:
        rank = before + F.rank().over(layout.inside(ties=False))
        rank = rank - F.when(layout.key.eqNullSafe(of("first_key")), of("ties")).otherwise(F.lit(0))
        if c.kind == "rank":
            return rank
        if c.kind == "dense_rank":
            return F.coalesce(of("keys"), F.lit(0).cast("bigint")) + F.dense_rank().over(layout.inside(ties=False))
        total = F.coalesce(of("total"), F.count(F.lit(1)).over(whole))
        return F.when(total > 1, (rank - 1) / (total - 1)).otherwise(F.lit(0.0))
    if c.kind == "ntile":
        total = F.coalesce(of("total"), F.count(F.lit(1)).over(whole))
        small, larger = F.floor(total / c.offset), total % c.offset
        row, edge = before + at, (total % c.offset) * (F.floor(total / c.offset) + 1)
        late = larger + F.floor((row - edge - 1) / F.greatest(small, F.lit(1))) + 1
        return F.when(row <= edge, F.floor((row - 1) / (small + 1)) + 1).otherwise(late).cast("bigint")
    if c.kind == "running_count":
        counted = F.count(value if c.column else F.lit(1)).over(so_far)
        return counted + F.coalesce(of(name), F.lit(0).cast("bigint"))
    if c.kind == "running_sum":
        own = F.sum(value).over(so_far)
        return F.coalesce(of(name) + own, of(name), own)
    if c.kind in ("running_min", "running_max"):
        lowest = c.kind == "running_min"
        own = (F.min if lowest else F.max)(value).over(so_far)
        return (F.least if lowest else F.greatest)(of(name), own)
    if c.kind == "first_value":
        own = F.first(value).over(so_far)
        return F.when(before > 0, F.get(of("start"), F.lit(0))[field]).otherwise(own)
    if c.kind == "moving_sum":
        own = F.sum(value).over(inside.rowsBetween(-c.offset, 0))
        if not c.offset:
            return own
        size = F.coalesce(F.size(of("tail")), F.lit(0))
        wanted = F.least(size, c.offset - at + 1).cast("int")
        kept = F.slice(of("tail"), size - wanted + 1, wanted)
        kind = types[c.column]
        carried = F.aggregate(
            kept, F.lit(None).cast(kind), lambda a, x: F.coalesce(a + x[field], a, x[field]).cast(kind)
        )
        return F.when(wanted > 0, F.coalesce(own + carried, own, carried)).otherwise(own)
    size = F.coalesce(F.size(of("tail" if c.kind == "lag" else "head")), F.lit(0))
    if c.kind == "lag":
        place = (size - c.offset + at - 1).cast("int")
        carried = F.when(place >= 0, F.get(of("tail"), place)[field])
        outside = F.when(place >= 0, carried).otherwise(F.lit(c.default))
        return F.when(at > c.offset, F.lag(value, c.offset).over(inside)).otherwise(outside)
    count = F.count(F.lit(1)).over(whole)
    place = (at + c.offset - count - 1).cast("int")
    outside = F.when(place < size, F.get(of("head"), place)[field]).otherwise(F.lit(c.default))
    return F.when(at + c.offset <= count, F.lead(value, c.offset).over(inside)).otherwise(outside)


def ordered_window(
    frame: DataFrame,
    columns: Mapping[str, Over],
    order_by: Sequence[str | tuple[str, str]],
    *,
    partition_by: Sequence[str] = (),
    ties: Sequence[str] = (),
    pieces: int | None = None,
) -> DataFrame:
    """``frame`` with window functions as further ``columns``, by name.

    ``order_by`` has names, or pairs of name and ``"asc"`` or ``"desc"``; NULL comes first ascending and
    last descending. ``ties`` are columns that tell rows with equal order apart, for functions by rows and
    so that many rows of one value span several pieces; ranks look at ``order_by`` alone. Together they
    should leave no ties, or the rows of a tie come in any order. Without ``partition_by`` all rows are one
    partition, and no task sees more than a piece of them.

    Rows are shuffled by range into ``pieces`` (by default as many as shuffle partitions), written to the
    shared folder, and shuffled by piece; the table of what is carried has two rows per piece at most. An
    empty frame gives no rows.
    """
    if not columns:
        raise ValueError("no window functions given")
    taken = set(map(str.lower, frame.columns))
    clash = [name for name in columns if name.lower() in taken]
    if clash:
        raise ValueError(f"columns {clash} are there already")
    # Names of our own inside, so that no name of the frame's can clash with a helper's.
    place = {name: f"u{i}" for i, name in enumerate(frame.columns)}
    unknown = {*partition_by, *ties, *(c for c, _ in _ordering(order_by)), *(c.column for c in columns.values() if c.column)}
    if unknown - place.keys():
        raise ValueError(f"the frame has no columns {sorted(unknown - place.keys())}")
    layout = _Layout(
        tuple(place[p] for p in partition_by),
        tuple((place[c], down) for c, down in _ordering(order_by)),
        tuple(place[t] for t in ties),
    )
    spec = [Over(c.kind, place.get(c.column), c.offset, c.default) for c in columns.values()]
    inner = frame.toDF(*place.values())
    n = pieces or int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = inner.repartitionByRange(n, *map(F.col, layout.parts), *layout.by())
    rows = written(spread.withColumn("_piece", F.spark_partition_id()), "window-rows")

    used = list(dict.fromkeys(c.column for c in spec if c.column))
    sums = inner.agg(*[F.sum(c.column).alias(c.column) for c in spec if c.kind == "moving_sum"] or [F.lit(0)])
    types = {f.name: f.dataType.simpleString() for f in sums.schema}
    carried = written(_carried(rows, layout, spec), "window-carry")
    its = carried.withColumnRenamed("_piece", "_of")
    same = (F.col("_piece") == F.col("_of")) & layout.part.eqNullSafe(F.col("_part"))
    joined = rows.join(F.broadcast(its), same, "left")
    results = [_result(c, f"c{i}", layout, used, types).alias(name) for i, (name, c) in enumerate(zip(columns, spec))]
    return joined.select(*[F.col(inside).alias(name) for name, inside in place.items()], *results)
