"""Identifier, table-name and path rules, each as a driver-side string and as a Column."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_S3_SCHEME = re.compile(r"^s3a?://", re.IGNORECASE)
_URI_OR_ABSOLUTE = re.compile(r"^(/|[A-Za-z][A-Za-z0-9+.-]*:)")

DEFAULT_NAMESPACE = "raw"
DEFAULT_TABLE = "table"


def _as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def sanitize(name: str | None) -> str:
    """Lower-case identifier: runs of letters and digits joined by single underscores."""
    if not name:
        return ""
    joined = "_".join(re.findall(r"[a-z0-9]+", name.lower())) or "x"
    return f"t{joined}" if joined[0].isdigit() else joined


def sanitize_col(name: Column | str) -> Column:
    source = F.coalesce(_as_column(name), F.lit(""))
    joined = F.array_join(F.regexp_extract_all(F.lower(source), F.lit("[a-z0-9]+"), F.lit(0)), "_")
    return (
        F.when(source == "", F.lit(""))
        .when(joined == "", F.lit("x"))
        .when(joined.rlike("^[0-9]"), F.concat(F.lit("t"), joined))
        .otherwise(joined)
    )


def target_table(
    path: str | None,
    catalog: str,
    default_namespace: str = DEFAULT_NAMESPACE,
    default_table: str = DEFAULT_TABLE,
) -> str:
    """Three-part table name from an output path: its last two parts, or the defaults."""
    parts = _S3_SCHEME.sub("", path or "").rstrip("/").split("/")
    namespace, table = parts[-2:] if len(parts) > 1 else (default_namespace, default_table)
    return f"{catalog}.{sanitize(namespace)}.{sanitize(table)}"


def target_table_col(
    path: Column | str,
    catalog: str,
    default_namespace: str = DEFAULT_NAMESPACE,
    default_table: str = DEFAULT_TABLE,
) -> Column:
    bare = F.regexp_replace(F.coalesce(_as_column(path), F.lit("")), "^(?i:s3a?)://", "")
    parts = F.split(F.rtrim(bare, F.lit("/")), "/")
    deep = F.size(parts) > 1
    namespace = F.when(deep, F.try_element_at(parts, F.lit(-2))).otherwise(default_namespace)
    table = F.when(deep, F.try_element_at(parts, F.lit(-1))).otherwise(default_table)
    return F.concat_ws(".", F.lit(catalog), sanitize_col(namespace), sanitize_col(table))


def split_table_name(name: str) -> tuple[str, str, str]:
    """``catalog.namespace.table`` as its parts; anything else is refused."""
    parts = name.split(".")
    if len(parts) != 3 or not all(parts):
        raise ValueError(f"table name must be catalog.namespace.table, got {name!r}")
    return parts[0], parts[1], parts[2]


def normalize_path(path: str) -> str:
    """Object-store location of a source: ``s3://`` and bare ``bucket/key`` become ``s3a://``.

    Absolute local paths and other schemes are kept as they are, and the scheme may be written in
    any case.
    """
    if not path:
        raise ValueError("path is empty")
    if _S3_SCHEME.match(path):
        return "s3a://" + _S3_SCHEME.sub("", path, count=1)
    return path if _URI_OR_ABSOLUTE.match(path) else f"s3a://{path}"


def normalize_path_col(path: Column | str) -> Column:
    source = _as_column(path)
    return (
        F.when(source.rlike(r"^(?i:s3a?)://"), F.regexp_replace(source, r"^(?i:s3a?)://", "s3a://"))
        .when(source.rlike(r"^(/|[A-Za-z][A-Za-z0-9+.-]*:)"), source)
        .otherwise(F.concat(F.lit("s3a://"), source))
    )


def layer_path(root: str, layer: str, run_id: str | None = None) -> str:
    """Folder of a layer below a bucket or folder: ``<root>/bronze/``, ``<root>/silver/<run_id>/``."""
    if layer not in ("bronze", "silver", "gold"):
        raise ValueError(f"unknown layer {layer!r}")
    base = f"{normalize_path(root).rstrip('/')}/{layer}/"
    return f"{base}{run_id}/" if run_id else base


def quoted(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def free_name(frame: DataFrame, wanted: str) -> str:
    """``wanted``, lengthened until the frame has no such column."""
    taken = {name.lower() for name in frame.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted
