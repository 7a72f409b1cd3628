import pytest

from tierflow.operators import combine, flatten_root, mismatch
from tierflow.sources import (
    DocumentStoreConfig,
    KafkaConfig,
    MySQLConfig,
    PostgresConfig,
    document_store_options,
    jdbc_options,
    kafka_options,
    list_registry,
    parse_messages,
    resolve_source,
    scan,
    scan_all,
)


@pytest.fixture
def sources(spark, tmp_path):
    """One good source, one of each kind that needs care, and one that is missing."""
    paths = {name: str(tmp_path / name) for name in ("good", "zero", "fewer", "swapped", "array")}
    spark.range(3).selectExpr("id", "cast(id as string) AS name").write.parquet(paths["good"])
    spark.range(0).selectExpr("id AS other").write.parquet(paths["zero"])
    spark.range(2).write.parquet(paths["fewer"])
    spark.range(2).selectExpr("cast(id as string) AS name", "id").write.parquet(paths["swapped"])
    spark.range(2).selectExpr("id", "array(id) AS name").write.parquet(paths["array"])
    (tmp_path / "bare").mkdir()
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "x.parquet").write_text("no parquet")
    return paths | {
        "bare": str(tmp_path / "bare"),
        "broken": str(tmp_path / "broken"),
        "missing": str(tmp_path / "missing"),
    }


def test_unreadable_sources_are_reported_and_skipped(spark, sources):
    names = ["missing", "good", "bare", "broken"]
    frame, reports = scan_all(spark, [sources[n] for n in names])
    assert frame.count() == 3
    assert [r.status for r in reports] == ["unreadable", "read", "unreadable", "unreadable"]
    assert all(r.detail for r in reports if r.status == "unreadable")


def test_scan_fails_on_request_or_when_nothing_is_left(spark, sources):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        scan_all(spark, [sources["good"], sources["missing"]], on_error="fail")
    with pytest.raises(ValueError, match="no data could be read"):
        scan_all(spark, [sources["missing"], sources["bare"]])


def test_empty_source_takes_no_part(spark, sources):
    frame, reports = scan_all(spark, [sources["zero"], sources["good"]], skip_empty=True)
    assert frame.columns == ["id", "name"] and frame.count() == 3
    assert [r.status for r in reports] == ["empty", "read"]
    with pytest.raises(ValueError):
        scan_all(spark, [sources["zero"], sources["good"]])


@pytest.mark.parametrize("other", ["fewer", "swapped", "array"])
def test_mismatched_source_fails_or_is_reported(spark, sources, other):
    paths = [sources["good"], sources[other], sources["good"]]
    with pytest.raises(ValueError, match="does not fit"):
        scan_all(spark, paths)
    frame, reports = scan_all(spark, paths, on_mismatch="skip")
    assert frame.count() == 6
    assert [r.status for r in reports] == ["read", "mismatched", "read"]


def test_loose_union_is_sparks_own(spark):
    a, b = spark.sql("SELECT 1 AS x"), spark.sql("SELECT 2L AS y")
    assert mismatch(a, b) and not mismatch(a, b, strict=False)
    assert sorted(r["x"] for r in combine([a, b, a], strict=False).collect()) == [1, 1, 2]


def test_union_of_many_sources_stays_shallow(spark):
    frames = [spark.range(i, i + 1) for i in range(40)]
    assert sorted(r["id"] for r in combine(frames).collect()) == list(range(40))


def test_union_by_name_fills_missing(spark):
    frame = combine([spark.sql("SELECT 1 AS a"), spark.sql("SELECT 2 AS b")], by="name")
    assert sorted(map(tuple, frame.collect()), key=str) == [(1, None), (None, 2)]


def test_jsonl_keeps_lines_that_do_not_parse(spark, tmp_path):
    lines = ['{"id": 1, "d": {"a": 2, "b": {"c": 3}}, "l": [4], "m": "x"}', "{broken"]
    (tmp_path / "in.json").write_text("\n".join(lines))
    schema = "id bigint, d struct<a bigint, b struct<c bigint>>, l array<bigint>, m string"
    frame = scan(spark, str(tmp_path / "in.json"), "json", schema)
    flat = flatten_root(frame)
    assert flat.columns == ["id", "d_a", "d_b", "l", "m", "_corrupt_record"]
    rows = {r["id"]: r for r in flat.collect()}
    assert rows[1]["d_b"]["c"] == 3 and rows[1]["_corrupt_record"] is None
    assert rows[None]["_corrupt_record"] == "{broken"
    with pytest.raises(Exception, match="MALFORMED"):
        scan(spark, str(tmp_path / "in.json"), "json", schema, mode="FAILFAST").collect()


def test_flatten_refuses_clashing_names(spark):
    with pytest.raises(ValueError, match="twice"):
        flatten_root(spark.sql("SELECT named_struct('a', 1) AS d, 2 AS d_a"))


@pytest.mark.parametrize("kind, port", [(PostgresConfig, 5432), (MySQLConfig, 3306)])
def test_connector_ports(kind, port):
    assert kind("h", "d", "u", "p").port == port
    for good in (1, 65535):
        assert str(good) in kind("h", "d", "u", "p", good).url
    for bad in (0, 65536):
        with pytest.raises(ValueError):
            kind("h", "d", "u", "p", bad)


def test_secrets_do_not_show():
    assert "secret" not in repr(PostgresConfig("h", "d", "u", "secret"))
    assert "secret" not in repr(DocumentStoreConfig("mongodb://u:secret@h/", "d"))


def test_jdbc_options():
    config = PostgresConfig("h", "d", "u", "p")
    plain = jdbc_options(config, "t")
    assert plain["url"] == "jdbc:postgresql://h:5432/d" and "partitionColumn" not in plain
    cut = jdbc_options(config, "t", partition_column="id", bounds=(0, 100), num_partitions=8)
    assert [cut[k] for k in ("partitionColumn", "lowerBound", "upperBound", "numPartitions")] == [
        "id",
        "0",
        "100",
        "8",
    ]
    with pytest.raises(ValueError):
        jdbc_options(config, "t", partition_column="id")


def test_kafka_and_document_store_options():
    options = kafka_options(KafkaConfig(["a:1", "b:2"], "t"), min_partitions=64)
    assert options["kafka.bootstrap.servers"] == "a:1,b:2"
    assert options["subscribe"] == "t" and options["kafka.group.id"] == "default_group"
    assert options["kafka.security.protocol"] == "PLAINTEXT" and options["minPartitions"] == "64"
    store = document_store_options(DocumentStoreConfig("mongodb://h/", "d"), "c")
    assert store == {
        "connection.uri": "mongodb://h/?authSource=admin",
        "database": "d",
        "collection": "c",
    }


def test_messages_become_columns(spark):
    messages = spark.sql(
        """
        SELECT CAST('k' AS BINARY) AS key, CAST(v AS BINARY) AS value, 't' AS topic, 0 AS partition,
               o AS offset, TIMESTAMP '2024-01-01' AS timestamp
        FROM VALUES (1L, '{"id": 5, "name": "a"}'), (2L, 'no json') AS m(o, v)
        """
    )
    rows = {r["_offset"]: r for r in parse_messages(messages, "id bigint, name string").collect()}
    assert (rows[1]["id"], rows[1]["name"], rows[1]["_key"]) == (5, "a", "k")
    assert (rows[2]["id"], rows[2]["_message"]) == (None, "no json")


REGISTRY = "id string, name string, type_name string, workspace_id string, kind string, position int, bucket string"


def test_registry(spark):
    rows = [
        ("1", "warehouse", "Redshift", "w", "sink", 1, "no"),
        ("2", None, "BigQuery", None, "sink", 2, "no"),
        ("3", "lake", "S3", "w", "sink", 3, "lake-bucket"),
        ("4", "other", "s3", "w", "sink", 4, "other-bucket"),
        ("5", "pg", "Postgres", "w", "source", 1, None),
    ]
    registry = spark.createDataFrame(rows, REGISTRY)
    assert resolve_source(registry) == "lake-bucket"
    assert list_registry(registry, "sink").count() == 4
    assert list_registry(registry, "sink").filter("id = '2'").head()["name"] == ""
    empty = registry.limit(0)
    assert resolve_source(empty, fallback_bucket="from-env") == "from-env"
    with pytest.raises(ValueError):
        resolve_source(empty)
