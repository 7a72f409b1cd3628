"""Joins of points, or of intervals, with intervals that contain or overlap them, without an equal key.

Spark compares every row of one side with every row of the other when a join has no equality. Here the
axis is cut into bins of several widths, each width a multiple of the one below. An interval is covered by
few bins, narrow ones at its ends and wide ones between, that do not overlap; a point lies in one bin of
each width. So a point and an interval that contains it meet in exactly one bin, by an equi-join, and an
interval of any length has few rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierflow.functions.naming import quoted
from tierflow.operators.windows import Over, ordered_window, written

# Bins of one width in a bin of the next.
FAN = 16


def _bits(fan: int) -> int:
    bits = fan.bit_length() - 1
    if fan < 2 or 1 << bits != fan:
        raise ValueError("fan must be a power of two")
    return bits


def cover(low: Column, high: Column, levels: int, fan: int = FAN) -> Column:
    """Bins that cover the whole numbers from ``low`` to ``high`` (not included), as an array of structs of
    ``level`` and ``bin``; at most ``2 * fan`` for each level but the last. NULL bounds or an empty interval
    give an empty array."""
    bits = _bits(fan)
    # Whole bins of a level between the bounds; shifting rounds down, negative numbers too.
    first = [F.shiftright(low + (fan**n - 1), bits * n) for n in range(levels + 1)]
    end = [F.shiftright(high, bits * n) for n in range(levels + 1)]
    parts = []
    for n in range(levels):
        some = _run(first[n], end[n], n)
        if n < levels - 1:
            # What fills bins of the next level is left to it.
            inner_first, inner_end = F.shiftleft(first[n + 1], bits), F.shiftleft(end[n + 1], bits)
            ends = F.concat(_run(first[n], inner_first, n), _run(inner_end, end[n], n))
            some = F.when(inner_first < inner_end, ends).otherwise(some)
        parts.append(some)
    return F.when(low < high, F.concat(*parts)).otherwise(F.array().cast(_BINS))


_BINS = "array<struct<level:int,bin:bigint>>"


def _run(first: Column, end: Column, level: int) -> Column:
    some = F.transform(F.sequence(first, end - 1), lambda i: F.struct(F.lit(level).alias("level"), i.alias("bin")))
    return F.when(first < end, some).otherwise(F.array().cast(_BINS)).cast(_BINS)


def bins_of(point: Column, levels: int, fan: int = FAN) -> Column:
    """The bin of each level that holds a whole number, as an array like that of ``cover``."""
    bits = _bits(fan)
    return F.array(
        *[F.struct(F.lit(n).alias("level"), F.shiftright(point, bits * n).cast("bigint").alias("bin")) for n in range(levels)]
    )


def _axis(frame: DataFrame, name: str, unit: int) -> Column:
    """A whole number, date or time (in microseconds) in whole units that keep the order."""
    kind = dict(frame.dtypes)[name]
    if kind in ("timestamp", "timestamp_ntz"):
        value = F.unix_micros(quoted(name).cast("timestamp"))
    elif kind == "date":
        value = F.unix_date(quoted(name)).cast("bigint")
    elif kind in ("tinyint", "smallint", "int", "bigint"):
        value = quoted(name).cast("bigint")
    else:
        raise ValueError(f"column {name} is {kind}; bins need whole numbers, dates or times")
    return F.floor(value / F.lit(unit)).cast("bigint") if unit > 1 else value


def _levels(intervals: DataFrame, low: str, high: str, unit: int, fan: int) -> int:
    """As many widths as the longest interval needs, from one pass over the bounds."""
    length = _axis(intervals, high, unit) - _axis(intervals, low, unit)
    longest = intervals.filter(quoted(low) < quoted(high)).agg(F.max(length)).first()[0] or 0
    levels = 1
    while fan**levels <= longest:
        levels += 1
    return levels


def point_join(
    points: DataFrame,
    intervals: DataFrame,
    at: str,
    low: str,
    high: str,
    *,
    unit: int = 1,
    fan: int = FAN,
    on: Sequence[tuple[str, str]] = (),
    pieces: int = 1,
) -> DataFrame:
    """Rows of ``points`` with the rows of ``intervals`` for which ``low <= at < high``; each pair once.

    ``unit`` is the width of the narrowest bin (microseconds for times): a fraction of a usual interval's
    length. Wider bins follow, up to the longest interval, which is looked up at once. ``on`` adds equal
    keys, as pairs of names. NULL bounds and points match nothing, nor does an interval that ends before it
    begins. Names must differ between the two sides; repeated rows are rows.

    A bin that many points share is a crowded key of a plain join, which adaptive execution splits; with
    ``pieces`` points are dealt out besides, and intervals sent to each piece. A point takes a row for each
    width, at most one for each power of ``fan`` up to the longest interval.
    """
    if unit < 1 or pieces < 1:
        raise ValueError("unit and pieces must be at least 1")
    both = {c.lower() for c in points.columns} & {c.lower() for c in intervals.columns}
    if both:
        raise ValueError(f"columns {sorted(both)} are on both sides")
    levels = _levels(intervals, low, high, unit, fan)
    # Names of our own for the helpers, whatever the sides are called.
    mine = {c: f"p{i}" for i, c in enumerate(points.columns)}
    its = {c: f"i{i}" for i, c in enumerate(intervals.columns)}
    # The last bin holds the last moment before the end.
    first, end = _axis(intervals, low, unit), F.floor((_axis(intervals, high, 1) - 1) / F.lit(unit)).cast("bigint") + 1
    piece = F.sequence(F.lit(0), F.lit(pieces - 1))
    shown = intervals.filter(quoted(low) < quoted(high)).select(
        *[quoted(c).alias(n) for c, n in its.items()], F.explode(cover(first, end, levels, fan)).alias("bin")
    ).select("*", F.explode(piece).alias("piece"))
    own = F.pmod(F.xxhash64(*map(quoted, points.columns)), F.lit(pieces)).cast("int")
    sought = points.filter(quoted(at).isNotNull()).select(
        *[quoted(c).alias(n) for c, n in mine.items()],
        F.explode(bins_of(_axis(points, at, unit), levels, fan)).alias("own_bin"),
        own.alias("own_piece"),
    )
    conditions = [
        F.col("own_bin.level") == F.col("bin.level"),
        F.col("own_bin.bin") == F.col("bin.bin"),
        *([F.col("own_piece") == F.col("piece")] if pieces > 1 else []),
        *[F.col(mine[a]) == F.col(its[b]) for a, b in on],
        F.col(its[low]) <= F.col(mine[at]),
        F.col(mine[at]) < F.col(its[high]),
    ]
    joined = sought.join(shown, reduce(Column.__and__, conditions))
    return joined.select(*[F.col(n).alias(c) for c, n in [*mine.items(), *its.items()]])


def overlap_join(
    left: DataFrame,
    right: DataFrame,
    left_bounds: tuple[str, str],
    right_bounds: tuple[str, str],
    *,
    totals: Mapping[str, str] | None = None,
    count: str = "n",
    **options: object,
) -> DataFrame:
    """Pairs of intervals that overlap, each once: where the left one begins inside the right one, and where
    the right one begins inside the left one but later. Options and odd cases as in ``point_join``.

    With ``totals`` (name of a sum to a whole-number column of ``right``) there is a row for each row of
    ``left`` that overlaps any: its columns, the number of its pairs as ``count``, and the sums over them
    (NULL where all values are). Pairs are not made, for their number grows with the square of the rows where
    intervals become denser: a row overlaps all that begin before its end but those that end before it begins,
    which running sums over the ordered bounds of both sides tell. Bin widths do not matter then.
    """
    if totals is not None:
        return _overlap_totals(left, right, left_bounds, right_bounds, totals, count, options.get("on", ()))
    (a, b), (c, d) = left_bounds, right_bounds
    on = [tuple(pair) for pair in options.pop("on", ())]
    whole_left, whole_right = left.filter(quoted(a) < quoted(b)), right.filter(quoted(c) < quoted(d))
    inside = point_join(whole_left, whole_right, a, c, d, on=on, **options)
    turned = point_join(whole_right, whole_left, c, a, b, on=[(y, x) for x, y in on], **options)
    columns = [*map(quoted, left.columns), *map(quoted, right.columns)]
    return inside.select(*columns).unionAll(turned.filter(quoted(a) < quoted(c)).select(*columns))


# Rows of one place on the axis in the order of their effect: what begins at the end of a left interval is
# no longer counted, what ends at its begin is taken off.
_END_OF_LEFT, _BEGINS, _ENDS, _BEGIN_OF_LEFT = range(4)
_WHOLE = ("tinyint", "smallint", "int", "bigint")


def _overlap_totals(
    left: DataFrame,
    right: DataFrame,
    left_bounds: tuple[str, str],
    right_bounds: tuple[str, str],
    totals: Mapping[str, str],
    count: str,
    on: Sequence[tuple[str, str]],
) -> DataFrame:
    types = dict(right.dtypes)
    if wrong := [c for c in totals.values() if types[c] not in _WHOLE]:
        raise ValueError(f"columns {wrong} are no whole numbers; their running sums would not be exact")
    taken = {c.lower() for c in left.columns}
    if clash := [c for c in (count, *totals) if c.lower() in taken]:
        raise ValueError(f"columns {clash} are there already")
    (a, b), (c, d) = left_bounds, right_bounds
    keys, values = [f"k{i}" for i in range(len(on))], [f"v{i}" for i in range(len(totals))]
    # Names of our own, and a number for each row that stays, whatever is computed again.
    mine = {c: f"u{i}" for i, c in enumerate(left.columns)}
    numbered = left.select(*[quoted(c).alias(n) for c, n in mine.items()], F.monotonically_increasing_id().alias("id"))
    kept = written(numbered.filter(F.col(mine[a]) < F.col(mine[b])), "overlap-rows")

    def places(low: Column, high: Column, kinds: tuple[int, int]) -> Column:
        of = lambda at, kind: F.struct(at.alias("at"), F.lit(kind).alias("kind"))
        return F.inline(F.array(of(low, kinds[0]), of(high, kinds[1])))

    # Sums in 38 digits, for those of all rows may be larger than any result.
    none = F.lit(None).cast("decimal(38,0)")
    sought = kept.select(
        *[F.col(mine[x]).alias(k) for (x, _), k in zip(on, keys)],
        F.col("id"),
        F.col("id").alias("tie"),
        *[none.alias(v) for v in values],
        places(F.col(mine[a]), F.col(mine[b]), (_BEGIN_OF_LEFT, _END_OF_LEFT)),
    )
    shown = right.filter(quoted(c) < quoted(d)).select(
        *[quoted(y).alias(k) for (_, y), k in zip(on, keys)],
        F.lit(None).cast("bigint").alias("id"),
        F.xxhash64(*map(quoted, dict.fromkeys((c, d, *totals.values())))).alias("tie"),
        *[quoted(t).cast("decimal(38,0)").alias(v) for t, v in zip(totals.values(), values)],
        places(quoted(c), quoted(d), (_BEGINS, _ENDS)),
    )
    line = sought.unionByName(shown)
    for key in keys:
        line = line.filter(F.col(key).isNotNull())
    functions: dict[str, Over] = {}
    for kind in (_BEGINS, _ENDS):
        here = F.col("kind") == kind
        line = line.withColumn(f"row{kind}", F.when(here, F.lit(1)))
        functions[f"rows{kind}"] = Over.running_count(f"row{kind}")
        for v in values:
            line = line.withColumn(f"{v}{kind}", F.when(here, F.col(v)))
            functions[f"{v}sum{kind}"] = Over.running_sum(f"{v}{kind}")
            functions[f"{v}any{kind}"] = Over.running_count(f"{v}{kind}")
    found = ordered_window(line.drop(*values), functions, ["at", "kind"], partition_by=keys, ties=["tie"])
    found = found.filter(F.col("id").isNotNull())

    def total(name: str) -> Column:
        begun, ended = F.coalesce(F.col(f"{name}{_BEGINS}"), F.lit(0)), F.coalesce(F.col(f"{name}{_ENDS}"), F.lit(0))
        return F.sum(F.when(F.col("kind") == _END_OF_LEFT, begun).otherwise(-ended))

    sums = [F.when(total(f"{v}any") > 0, total(f"{v}sum")).cast("bigint").alias(f"t{i}") for i, v in enumerate(values)]
    by_row = found.groupBy(F.col("id").alias("its")).agg(total("rows").alias("pairs"), *sums).filter("pairs > 0")
    named = [F.col(n).alias(c) for c, n in mine.items()]
    its_sums = [F.col(f"t{i}").alias(name) for i, name in enumerate(totals)]
    return kept.join(by_row, F.col("id") == F.col("its")).select(*named, F.col("pairs").alias(count), *its_sums)
