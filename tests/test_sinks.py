from pathlib import Path

import pytest
from pyspark.errors import AnalysisException

from tierflow.functions import sanitize
from tierflow.operators import ensure_namespace, publish_table, write_files
from tierflow.operators.sinks import overlaps


def _files(path):
    return sorted(Path(path).rglob("*.parquet"))


def test_modes(spark, tmp_path):
    path = str(tmp_path / "out")
    assert write_files(spark.range(5), path) == 5
    assert write_files(spark.range(3), path, "append") == 3
    assert spark.read.parquet(path).count() == 8
    assert write_files(spark.range(2), path, "overwrite") == 2
    assert spark.read.parquet(path).count() == 2
    with pytest.raises(AnalysisException):
        write_files(spark.range(1), path, "error")
    with pytest.raises(ValueError):
        write_files(spark.range(1), path, "upsert")


def test_empty_result_is_written_with_its_schema(spark, tmp_path):
    path = str(tmp_path / "out")
    assert write_files(spark.range(5).filter("false"), path) == 0
    assert spark.read.parquet(path).columns == ["id"]


def test_overwriting_a_source_is_refused(spark, tmp_path):
    path = str(tmp_path / "in")
    write_files(spark.range(5), path)
    for target in (path, path + "/", str(tmp_path), path + "/part", "file:" + path):
        with pytest.raises(ValueError, match="overlaps"):
            write_files(spark.read.parquet(path), target, reads=[path])
    assert spark.read.parquet(path).count() == 5
    assert overlaps("s3a://b/x", ["s3a://b/xy", "s3://b/y"]) is None
    assert overlaps("s3://b/x/", ["S3A://b/x"]) == "S3A://b/x"


def test_one_file_for_a_small_result(spark, tmp_path):
    path = str(tmp_path / "one")
    write_files(spark.range(0, 1000, 1, 8), path, files=1)
    assert len(_files(path)) == 1


@pytest.fixture
def small_advice(spark):
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.set(key, "256k")
    yield
    spark.conf.unset(key)


def _wide(spark):
    return spark.range(0, 200_000, 1, 8).selectExpr(
        "id", "sha2(cast(id AS string), 256) AS text", "if(id % 3 > 0, 'hot', concat('k', id % 5)) AS k"
    )


def test_large_result_is_not_pulled_into_one_task(spark, tmp_path, small_advice):
    path = str(tmp_path / "big")
    assert write_files(_wide(spark), path, files=1) == 200_000
    assert len(_files(path)) > 1


def test_crowded_partition_is_cut_and_others_stay_whole(spark, tmp_path, small_advice):
    path = str(tmp_path / "layout")
    write_files(_wide(spark), path, partition_by=["k"], sort_by=["id"])
    assert len(_files(f"{path}/k=hot")) > 1
    assert spark.read.parquet(path).count() == 200_000
    assert {p.name for p in Path(path).glob("k=*")} == {"k=hot", *(f"k=k{i}" for i in range(5))}


def test_partitions_with_a_number_of_tasks(spark, tmp_path):
    path = str(tmp_path / "two")
    write_files(_wide(spark), path, files=2, partition_by=["k"])
    assert spark.read.parquet(path).count() == 200_000
    assert len(_files(path)) == 6


def test_layout_is_sorted_inside_files(spark, tmp_path):
    path = str(tmp_path / "sorted")
    write_files(_wide(spark).repartition(4), path, partition_by=["k"], sort_by=["id"])
    for file in _files(path):
        ids = [r["id"] for r in spark.read.parquet(str(file)).collect()]
        assert ids == sorted(ids)


def test_max_records_per_file(spark, tmp_path):
    path = str(tmp_path / "cut")
    write_files(spark.range(100), path, files=1, max_records_per_file=30)
    assert len(_files(path)) == 4


@pytest.fixture
def table(spark, request):
    assert ensure_namespace(spark, "spark_catalog", "checks") is None
    name = f"spark_catalog.checks.{sanitize(request.node.name)}"
    yield name
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_append_creates_then_adds(spark, table):
    publish_table(spark.range(2), table, "append")
    publish_table(spark.range(3), table, "append")
    assert spark.table(table).count() == 5


def test_overwrite_touches_only_its_partitions(spark, table):
    frame = spark.range(6).selectExpr("id", "id % 3 AS p")
    publish_table(frame, table, "overwrite", partition_by=["p"])
    publish_table(spark.sql("SELECT 1L AS p, 100L AS id"), table, "overwrite")
    assert sorted(r["id"] for r in spark.table(table).collect()) == [0, 2, 3, 5, 100]
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode").lower() == "static"


def test_failed_overwrite_costs_no_data(spark, table):
    publish_table(spark.range(6).selectExpr("id", "id % 3 AS p"), table, "overwrite", partition_by=["p"])
    with pytest.raises(AnalysisException):
        publish_table(spark.range(2), table, "overwrite")
    assert spark.table(table).count() == 6


def test_replace_changes_the_schema(spark, table):
    publish_table(spark.range(2), table, "replace")
    publish_table(spark.sql("SELECT 'a' AS name"), table, "replace")
    assert spark.table(table).columns == ["name"]


def test_bad_names_and_modes(spark):
    with pytest.raises(ValueError):
        publish_table(spark.range(1), "a..b")
    with pytest.raises(ValueError):
        publish_table(spark.range(1), "a.b.c", "merge")


class _Missing(AnalysisException):
    def __init__(self, condition):
        super().__init__(condition)
        self.condition = condition

    def getCondition(self):
        return self.condition


class _Writer:
    """Stands in for the v2 writer of a catalog whose jar is not here; records the calls."""

    def __init__(self, failure=None):
        self.calls, self.failure = [], failure

    def writeTo(self, name):
        self.calls.append(name)
        return self

    def partitionedBy(self, *columns):
        self.calls.append("partitionedBy")
        return self

    def _call(self, name):
        self.calls.append(name)
        if self.failure and name in ("append", "overwritePartitions"):
            raise _Missing(self.failure)

    def append(self):
        self._call("append")

    def create(self):
        self._call("create")

    def createOrReplace(self):
        self._call("createOrReplace")

    def overwritePartitions(self):
        self._call("overwritePartitions")


@pytest.mark.parametrize(
    "mode, failure, calls",
    [
        ("append", None, ["append"]),
        ("append", "TABLE_OR_VIEW_NOT_FOUND", ["append", "create"]),
        ("overwrite", None, ["overwritePartitions"]),
        ("overwrite", "TABLE_OR_VIEW_NOT_FOUND", ["overwritePartitions", "create"]),
        ("replace", None, ["createOrReplace"]),
    ],
)
def test_other_catalogs_use_the_v2_writer(mode, failure, calls):
    writer = _Writer(failure)
    publish_table(writer, "lake.ns.t", mode)
    assert [c for c in writer.calls if not c.startswith("`")] == calls


def test_other_errors_never_create_a_table():
    writer = _Writer("INCOMPATIBLE_DATA_FOR_TABLE.EXTRA_COLUMNS")
    with pytest.raises(AnalysisException):
        publish_table(writer, "lake.ns.t", "overwrite")
    assert "create" not in writer.calls and "createOrReplace" not in writer.calls


def test_namespace_failure_is_a_warning(spark):
    assert ensure_namespace(spark, "nowhere", "ns")
