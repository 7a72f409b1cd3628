import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tierflow.functions import (
    layer_path,
    normalize_path,
    normalize_path_col,
    sanitize,
    sanitize_col,
    split_table_name,
    target_table,
    target_table_col,
)

# Output paths and the table names they must give.
TARGETS = {
    "": "lake.raw.table",
    "s3a://bucket/silver/107ea972/": "lake.silver.t107ea972",
    "s3://ns/table": "lake.ns.table",
    "S3A://B/Ns/My-Table": "lake.ns.my_table",
    "bucket": "lake.raw.table",
    "/some/local/path": "lake.local.path",
    "s3a://b/--/x": "lake.x.x",
    "s3a://bucket//t": "lake..t",
    "s3a://": "lake.raw.table",
}

# Source paths and the locations they must give.
LOCATIONS = {
    "s3://b/p": "s3a://b/p",
    "s3a://b/p": "s3a://b/p",
    "b/p": "s3a://b/p",
    "S3://b": "s3a://b",
    "/abs": "/abs",
    "file:/abs": "file:/abs",
    "hdfs://host/p": "hdfs://host/p",
}

SANITIZED = {"": "", "A B": "a_b", "__x__": "x", "9lives": "t9lives", "--": "x", "a--_b": "a_b"}


@pytest.mark.parametrize("path, name", TARGETS.items())
def test_target_table(path, name):
    assert target_table(path, "lake") == name


def test_target_table_without_path():
    assert target_table(None, "lake", "ns", "tb") == "lake.ns.tb"


@pytest.mark.parametrize("path, location", LOCATIONS.items())
def test_normalize_path(path, location):
    assert normalize_path(path) == location


def test_normalize_path_refuses_nothing():
    with pytest.raises(ValueError):
        normalize_path("")


@pytest.mark.parametrize("name, clean", SANITIZED.items())
def test_sanitize(name, clean):
    assert sanitize(name) == clean


@pytest.mark.parametrize("name", ["a.b", "a..c", "a.b.c.d", ""])
def test_table_name_needs_three_parts(name):
    with pytest.raises(ValueError):
        split_table_name(name)
    assert split_table_name("a.b.c") == ("a", "b", "c")


def test_layer_path():
    assert layer_path("bucket", "bronze") == "s3a://bucket/bronze/"
    assert layer_path("s3://bucket/", "silver", "r1") == "s3a://bucket/silver/r1/"
    with pytest.raises(ValueError):
        layer_path("bucket", "tin")


def _column_values(spark, texts, column):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = frame.select("i", column(F.col("t")).alias("v")).collect()
    return [row["v"] for row in sorted(rows)]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text("aZ09_-/. é%:s3", max_size=12), min_size=1, max_size=60))
def test_column_forms_agree_with_string_forms(spark, texts):
    texts = texts + list(TARGETS) + list(LOCATIONS)
    filled = [t for t in texts if t]
    assert _column_values(spark, texts, sanitize_col) == [sanitize(t) for t in texts]
    assert _column_values(spark, texts, lambda c: target_table_col(c, "lake")) == [
        target_table(t, "lake") for t in texts
    ]
    assert _column_values(spark, filled, normalize_path_col) == [normalize_path(t) for t in filled]
