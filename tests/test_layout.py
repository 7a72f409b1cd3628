"""Clustered files, drifting schemas and a packed ledger."""

import itertools
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tierflow.operators import Drift, drift, merged_schema, scan_drifting, widened, write_clustered, write_files
from tierflow.plans import RunLedger
from tierflow.plans.ledger import data_files, pack_first_fit


def test_two_columns_touch_few_files(spark, tmp_path):
    frame = spark.range(40_000).select(
        F.col("id"),
        (F.xxhash64("id", F.lit(1)) % 1000).cast("double").alias("a"),
        F.timestamp_seconds(F.pmod(F.xxhash64("id", F.lit(2)), F.lit(10**6))).cast("timestamp_ntz").alias("b"),
    )
    frame = frame.union(spark.sql("SELECT -1L, CAST(NULL AS DOUBLE), CAST(NULL AS TIMESTAMP_NTZ)"))
    path = str(tmp_path / "out")
    assert write_clustered(frame, path, ["a", "b"], files=64, bits=5) == 40_001
    rows = spark.read.parquet(path)
    assert rows.exceptAll(frame).isEmpty() and frame.exceptAll(rows).isEmpty()
    files = rows.select(F.input_file_name()).distinct().count()
    assert files >= 48
    low = F.lit("1970-01-03").cast("timestamp_ntz")
    for part, share in ((F.col("a").between(100, 200), 0.4), (F.col("b") < low, 0.4), (F.col("a").between(100, 200) & (F.col("b") < low), 0.2)):
        assert rows.filter(part).select(F.input_file_name()).distinct().count() <= share * files


def test_a_crowded_key_is_spread(spark, tmp_path):
    frame = spark.range(20_000).select("id", F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(7).alias("a"))
    path = str(tmp_path / "out")
    write_clustered(frame, path, ["a"], files=16)
    sizes = [r["count"] for r in spark.read.parquet(path).groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) >= 14 and max(sizes) < 20_000 / 8
    assert write_clustered(frame.limit(0), str(tmp_path / "none"), ["a"], files=4) == 0
    for wrong in (lambda: write_clustered(frame, path, [], 4), lambda: write_clustered(spark.read.parquet(path), path, ["a"], 4)):
        with pytest.raises(ValueError):
            wrong()


def kind(text):
    return StructType.fromDDL(f"x {text}")["x"].dataType


@pytest.mark.parametrize(
    "a,b,wide",
    [
        ("int", "bigint", "bigint"), ("tinyint", "float", "float"), ("int", "float", "double"), ("bigint", "double", None),
        ("int", "decimal(5,2)", "decimal(12,2)"), ("decimal(10,2)", "decimal(8,4)", "decimal(12,4)"), ("decimal(38,0)", "decimal(10,5)", None),
        ("date", "timestamp_ntz", "timestamp_ntz"), ("date", "string", None), ("array<int>", "array<bigint>", "array<bigint>"),
        ("array<int>", "string", None), ("struct<a:int>", "struct<a:bigint,b:string>", "struct<a:bigint,b:string>"),
        ("map<string,int>", "map<string,bigint>", "map<string,bigint>"), ("void", "int", "int"),
    ],
)
def test_widening_is_the_same_both_ways(a, b, wide):
    for x, y in ((a, b), (b, a)):
        found = widened(kind(x), kind(y))
        assert (found and found.simpleString()) == wide


def test_any_order_gives_one_type():
    kinds = [kind(k) for k in ("tinyint", "int", "bigint", "decimal(4,2)", "void")]
    results = set()
    for order in itertools.permutations(kinds):
        merged, conflicts = merged_schema({str(i): StructType().add("x", k) for i, k in enumerate(order)})
        results.add((merged.simpleString(), len(conflicts)))
    assert results == {("struct<x:decimal(22,2)>", 0)}


def test_sources_of_three_shapes(spark, tmp_path):
    paths = [str(tmp_path / n) for n in "abc"]
    write_files(spark.sql("SELECT 1 AS id, 'x' AS t, named_struct('u', 1) AS s"), paths[0])
    write_files(spark.sql("SELECT 5000000000L AS id, named_struct('w', 'n', 'u', 2L) AS s, 1.5D AS more"), paths[1])
    write_files(spark.sql("SELECT 3S AS id, 'z' AS t, CAST(NULL AS STRUCT<u:INT>) AS s"), paths[2])
    note = str(tmp_path / "schema" / "note")
    frame, changes = scan_drifting(spark, [paths[0]], stored=note)
    assert changes == []
    frame, changes = scan_drifting(spark, paths, stored=note)
    assert changes == [
        Drift("id", "widened", "int", "bigint"), Drift("s.u", "widened", "int", "bigint"), Drift("s.w", "added", None, "string"),
        Drift("more", "added", None, "double"),
    ]
    found = sorted((r.id, r.t, r.s and (r.s.u, r.s.w), r.more) for r in frame.collect())
    assert found == [(1, "x", (1, None), None), (3, "z", None, None), (5000000000, None, (2, "n"), 1.5)]
    assert scan_drifting(spark, paths, stored=note)[1] == []
    assert [d.change for d in scan_drifting(spark, paths[2:], stored=note)[1]] == ["changed", "changed", "lost", "lost"]


def test_conflicts_are_named(spark, tmp_path):
    paths = [str(tmp_path / n) for n in "ab"]
    write_files(spark.sql("SELECT 1 AS id, array(1, 2) AS v"), paths[0])
    write_files(spark.sql("SELECT 2 AS id, 'text' AS v"), paths[1])
    with pytest.raises(ValueError, match="column v: array<int> in .*a; string in .*b"):
        scan_drifting(spark, paths)
    frame, _ = scan_drifting(spark, paths, on_conflict="string")
    assert sorted(map(tuple, frame.collect())) == [(1, "[1,2]"), (2, "text")]
    assert drift(frame.schema, frame.schema) == []


def test_first_fit():
    sizes = {"a": 60, "b": 50, "c": 40, "d": 30, "e": 20, "f": 200}
    assert pack_first_fit(sizes, 100) == [["f"], ["a", "c"], ["b", "d", "e"]]
    assert pack_first_fit({}, 100) == []


def test_a_packed_ledger_reads_the_same(spark, tmp_path):
    ledger = RunLedger(spark, str(tmp_path / "ledger"))
    assert ledger.compact() == {"runs": 0, "events": 0}
    for i in range(6):
        ledger.record(f"r{i}", "RUNNING")
        ledger.event(f"r{i}", "Note", "text")
    before = sorted(map(tuple, ledger.runs().collect()), key=repr)
    open_reader = ledger.runs()
    assert ledger.compact() == {"runs": 1, "events": 1}
    # A reader that listed the files before still finds them, and a new one sees each row once.
    assert sorted(map(tuple, open_reader.collect()), key=repr) == before
    assert sorted(map(tuple, ledger.runs().collect()), key=repr) == before
    assert ledger.runs("r3").count() == 1 and ledger.events("r3").count() == 2 and ledger.runs("none").count() == 0
    ledger.record("r9", "RUNNING")
    assert ledger.runs().count() == 7
    # A pack of a pack, while the files of the first one are still there.
    assert ledger.compact() == {"runs": 1, "events": 1} and ledger.runs().count() == 7 and ledger.events().count() == 13
    ledger.record("r10", "RUNNING")
    packed_reader = ledger.runs()
    assert ledger.compact(keep_seconds=0) == {"runs": 1, "events": 1}
    assert packed_reader.count() == 8 and ledger.runs().count() == 8
    ledger.compact(keep_seconds=0)
    assert len(data_files(spark, str(tmp_path / "ledger" / "runs"))) == 0
    assert ledger.runs().count() == 8 and ledger.events().count() == 14
    assert len(list(Path(tmp_path / "ledger" / "runs").rglob("*.parquet"))) == 1


def test_a_pack_cut_off_changes_nothing(spark, tmp_path, monkeypatch):
    from tierflow.plans import ledger as module

    ledger = RunLedger(spark, str(tmp_path / "ledger"))
    for i in range(3):
        ledger.record(f"r{i}", "RUNNING")

    def cut(*_):
        raise OSError("away")

    with monkeypatch.context() as patch:
        patch.setattr(module, "write_note", cut)
        with pytest.raises(OSError):
            ledger.compact()
    assert ledger.runs().count() == 3
    assert ledger.compact()["runs"] == 1 and ledger.runs().count() == 3
