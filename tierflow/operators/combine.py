"""Union of several relations and their registration for SQL."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

SOURCE_VIEW = "source_data"


def mismatch(first: DataFrame, other: DataFrame, strict: bool = True, by: str = "position") -> str:
    """Why ``other`` cannot be united with ``first``; empty when it can.

    By name, columns may be missing on either side; strict wants equal types for those in both.

    Only the column count matters with ``strict=False``. Strict also wants the same names and types
    in the same order: Spark would accept swapped columns of one type, and would widen a text column
    against a number to a number that then fails at run time.
    """
    left, right = first.schema.fields, other.schema.fields
    if by == "name":
        kinds = {field.name.lower(): field.dataType for field in left}
        for field in right if strict else []:
            expected = kinds.get(field.name.lower(), field.dataType)
            if field.dataType != expected:
                return f"column {field.name} is {field.dataType.simpleString()}, expected {expected.simpleString()}"
        return ""
    if len(left) != len(right):
        return f"{len(right)} columns instead of {len(left)}"
    if strict:
        for position, (a, b) in enumerate(zip(left, right)):
            if a.name.lower() != b.name.lower():
                return f"column {position + 1} is {b.name}, expected {a.name}"
            if a.dataType != b.dataType:
                kinds = f"{b.dataType.simpleString()}, expected {a.dataType.simpleString()}"
                return f"column {b.name} is {kinds}"
    return ""


def combine(frames: Sequence[DataFrame], by: str = "position", strict: bool = True) -> DataFrame:
    """Union that keeps duplicates.

    ``by="position"`` takes names from the first relation; ``by="name"`` aligns columns and fills
    missing ones with NULL. Either way ``strict`` refuses differing types. Pairs are united level by level, so many sources make a shallow plan.
    """
    if not frames:
        raise ValueError("nothing to combine")
    if by not in ("position", "name"):
        raise ValueError(f"by must be position or name, got {by!r}")
    for number, frame in enumerate(frames[1:], start=2):
        for earlier, other in enumerate(frames[: number - 1] if by == "name" else frames[:1], start=1):
            problem = mismatch(other, frame, strict, by)
            if problem:
                raise ValueError(f"source {number} does not fit source {earlier}: {problem}")
    level = list(frames)
    while len(level) > 1:
        pairs = [level[i : i + 2] for i in range(0, len(level), 2)]
        level = [_unite(*pair, by=by) if len(pair) == 2 else pair[0] for pair in pairs]
    return level[0]


def _unite(left: DataFrame, right: DataFrame, by: str) -> DataFrame:
    if by == "name":
        return left.unionByName(right, allowMissingColumns=True)
    return left.union(right)


def register(frame: DataFrame, name: str = SOURCE_VIEW) -> DataFrame:
    frame.createOrReplaceTempView(name)
    return frame
