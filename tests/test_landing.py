"""Variant landing, sketches, runs of their own, and key rules in one pass."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tierflow.operators import (
    Distinct,
    ForeignKey,
    Members,
    NotNull,
    Quantiles,
    Unique,
    check_quality,
    estimates,
    flag_quality,
    in_both,
    publish_table,
    run_rows,
    sketch_gold,
    unite,
    write_files,
    write_run,
)
from tierflow.operators import quality
from tierflow.plans import RunLedger, run_transform, transform
from tierflow.session import object_store_conf
from tierflow.sources import corrupt_lines, exploded, land_json, landed_rows, typed, variant_schema

LINES = [
    '{"id": 1, "v": 2.5, "deep": {"a": [1, 2]}}',
    '{"id": "2", "v": "x", "deep": {"a": "none"}}',
    '{"id": 3, "v": null}',
    "   ",
    '{"id": 4, "v": {"no": 1}',
    "not json",
    '{"id": 5, "id": 6}',
    "[1, 2]",
    "null",
]


@pytest.fixture
def folder(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.jsonl").write_text("\n".join(LINES))
    landing = land_json(spark, str(source), str(tmp_path / "out"))
    assert (landing.rows, landing.corrupt) == (5, 3)
    return str(tmp_path / "out")


def test_lines_are_landed_once_and_bad_ones_kept_whole(spark, folder):
    assert sorted(r._line for r in corrupt_lines(spark, folder).collect()) == sorted([LINES[4], LINES[5], LINES[6]])
    assert all(r._source_file.endswith("a.jsonl") for r in corrupt_lines(spark, folder).collect())
    fields = {"id": ("$.id", "bigint"), "v": ("$.v", "double"), "a": ("$.deep.a", "array<int>")}
    found = typed(landed_rows(spark, folder), fields).select(*fields, "_misfits")
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(
        [(1, 2.5, [1, 2], []), (2, None, None, ["v", "a"]), (3, None, None, []), (None, None, None, []), (None, None, None, [])], key=repr
    )


def test_the_landing_infers_nothing_and_readers_prune(spark, folder, tmp_path):
    plan = landed_rows(spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_corrupt" in plan
    lines = spark.createDataFrame([(x,) for x in LINES], "value string")
    again = land_json(spark, lines, str(tmp_path / "frame"))
    assert (again.rows, again.corrupt) == (5, 3)
    objects = landed_rows(spark, folder).filter(F.try_variant_get("data", "$.id", "string").isNotNull())
    assert "deep: OBJECT<a: VARIANT>" in variant_schema(objects)
    assert land_json(spark, lines.limit(0), str(tmp_path / "none")).rows == 0


def test_exploded_elements(spark, tmp_path):
    lines = spark.createDataFrame([('{"i": 1, "x": [{"q": 5}, 7, null]}',), ('{"i": 2, "x": []}',), ('{"i": 3}',)], "value string")
    land_json(spark, lines, str(tmp_path / "out"))
    rows = exploded(landed_rows(spark, str(tmp_path / "out")), "$.x", "e")
    found = rows.select("e_place", F.try_variant_get("e", "$.q", "int").alias("q"))
    assert sorted(map(tuple, found.collect()), key=repr) == [(0, 5), (1, None), (2, None)]
    with pytest.raises(ValueError):
        exploded(rows, "$.x", "e")


def test_sketches_unite_over_any_days(spark):
    frame = spark.range(20_000).select(
        (F.col("id") % 3).alias("k"),
        (F.col("id") % 4000).alias("user"),
        F.col("id").cast("double").alias("v"),
        F.timestamp_seconds(1_700_000_000 + F.col("id") * 60).cast("timestamp_ntz").alias("ts"),
    )
    frame = frame.union(spark.createDataFrame([(9, None, None)], "k bigint, user bigint, v double").withColumn("ts", F.lit("2023-11-15").cast("timestamp_ntz")))
    sketches = {"users": Distinct("user"), "ids": Members("user"), "median": Quantiles("v")}
    days = sketch_gold(frame, ["k"], sketches, "day", "ts", {"n": F.count(F.lit(1))})
    assert days.count() > 10
    for low, high in (("2023-11-14", "2023-11-30"), ("2023-11-16", "2023-11-20")):
        some = days.filter((F.col("period") >= low) & (F.col("period") < high))
        found = {r.k: r for r in estimates(unite(some, ["k"], sketches, {"n": F.sum("n")}), sketches, [0.25, 0.5]).collect()}
        rows = frame.filter((F.date_trunc("day", "ts") >= low) & (F.date_trunc("day", "ts") < high))
        for r in rows.groupBy("k").agg(F.count_distinct("user").alias("u"), F.sort_array(F.collect_list("v")).alias("v"), F.count(F.lit(1)).alias("n")).collect():
            mine = found[r.k]
            assert mine.n == r.n
            assert abs(mine.users - r.u) <= sketches["users"].error * r.u + 1
            assert abs(mine.ids - r.u) <= sketches["ids"].error * r.u + 1
            for share, value in zip((0.25, 0.5), mine.median or ()):
                rank = sum(x <= value for x in r.v) / len(r.v)
                assert abs(rank - share) <= sketches["median"].error + 1 / len(r.v)
    assert found.get(9) is None or found[9].median is None
    two = unite(days.filter("period < '2023-11-18'"), [], {"ids": sketches["ids"]})
    other = unite(days.filter("period >= '2023-11-18'"), [], {"ids": sketches["ids"]}).withColumnRenamed("ids", "more")
    shared = two.crossJoin(other).select(in_both("ids", "more").alias("n")).first().n
    assert abs(shared - 4000) < 400


KEYED = "a int, b int, c int"


def test_key_rules_scan_once(spark, tmp_path):
    path = str(tmp_path / "rows")
    rows = [(1, 1, 1), (1, 1, 2), (2, 1, 2), (2, 2, 9), (None, 1, 1), (None, 1, 1), (3, None, 7), (3, None, 7)]
    write_files(spark.createDataFrame(rows, KEYED), path)
    frame = spark.read.parquet(path)
    parents = spark.createDataFrame([(1,), (3,)], "p int")
    rules = [Unique("ab", ("a", "b")), ForeignKey("a_known", "a", parents, "p"), Unique("ba", ("b", "a")), Unique("c", ("c",)), NotNull("b_there", "b")]
    counted, sets = quality.all_key_sizes(frame, [r for r in rules if not isinstance(r, NotNull)])
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Expand") == 1
    assert sorted(map(sorted, sets)) == [["a", "b"], ["c"]]
    found = {r.rule: (r.checked, r.failed) for r in check_quality(frame, rules).collect()}
    assert found == {"ab": (8, 2), "ba": (8, 2), "a_known": (8, 2), "c": (8, 7), "b_there": (8, 2)}
    flagged = flag_quality(frame, rules)
    # Only marking reads the rows; judging has read them once, before.
    assert flagged._jdf.queryExecution().optimizedPlan().toString().count(Path(path).name) <= 1
    assert sorted((tuple(r)[:3], r._failed_rules) for r in flagged.filter("a = 1").collect()) == [
        ((1, 1, 1), ["ab", "ba", "c"]),
        ((1, 1, 2), ["ab", "ba", "c"]),
    ]


def test_one_set_of_keys_needs_no_expand(spark):
    frame = spark.createDataFrame([(1, 1, 1)], KEYED)
    counted, sets = quality.all_key_sizes(frame, [Unique("ab", ("a", "b")), Unique("a", ("a",))])
    assert "Expand" not in counted._jdf.queryExecution().executedPlan().toString() and sets == [["a", "b"]]


class Cut(Exception):
    pass


@pytest.mark.parametrize("with_table", [False, True])
@pytest.mark.parametrize("step", ["write_run", "publish_table", "save", "none"])
@pytest.mark.parametrize("late", [False, True])
def test_a_run_cut_off_anywhere_leaves_each_row_once(spark, tmp_path, monkeypatch, with_table, step, late):
    spark.sql("CREATE NAMESPACE IF NOT EXISTS spark_catalog.landing")
    table = f"spark_catalog.landing.runs_{step}_{late}".lower() if with_table else None
    out, ledger = str(tmp_path / "out"), RunLedger(spark, str(tmp_path / "ledger"))
    source = str(tmp_path / "in")
    write_files(spark.range(10), source)
    call = lambda run_id: run_transform(
        spark, "SELECT id FROM source_data", [source], out, mode="append", by_run=True, run_id=run_id, table=table, ledger=ledger
    )
    call("earlier")
    target = transform._LedgerRow if step == "save" else transform
    if step != "none":
        original = getattr(target, step)

        def cut(*args, **options):
            if late:
                original(*args, **options)
            raise Cut

        with monkeypatch.context() as patch:
            patch.setattr(target, step, cut)
            if step == "publish_table" and not with_table:
                call("mine")
            else:
                with pytest.raises(Cut):
                    call("mine")
    assert call("mine").rows_out == 10
    wanted = {("earlier", i) for i in range(10)} | {("mine", i) for i in range(10)}
    frames = [run_rows(spark, out)] + ([spark.table(table)] if table else [])
    for frame in frames:
        found = [(r._run, r.id) for r in frame.collect()]
        assert len(found) == 20 and set(found) == wanted


def test_runs_refuse_other_layouts(spark, tmp_path):
    flat = str(tmp_path / "flat")
    write_files(spark.range(3), flat)
    with pytest.raises(ValueError, match="belong to none"):
        write_run(spark.range(3), flat, "r")
    with pytest.raises(ValueError, match="append"):
        run_transform(spark, "SELECT 1 AS a", spark.range(1), str(tmp_path / "x"), mode="overwrite", by_run=True)
    assert write_run(spark.range(0), str(tmp_path / "empty"), "r") == 0


def test_table_layout(spark, tmp_path):
    spark.sql("CREATE NAMESPACE IF NOT EXISTS spark_catalog.landing")
    name = "spark_catalog.landing.laid_out"
    frame = spark.range(10).withColumn("part", F.col("id") % 2)
    run_transform(spark, "SELECT * FROM source_data", frame, str(tmp_path / "o"), table=name, table_mode="replace", table_partition_by=["part"])
    assert [r.col_name for r in spark.sql(f"DESCRIBE {name}").collect()].count("part") == 2


def test_settings_of_the_submission_are_used():
    store = "spark.hadoop.fs.s3a."
    known = {store + "access.key": "k", store + "secret.key": "s", store + "path.style.access": "true"}
    conf = object_store_conf({"AWS_REGION": "r"}, known)
    assert conf[store + "access.key"] == "k" and conf[store + "path.style.access"] == "true"
    own = object_store_conf({"AWS_ACCESS_KEY_ID": "e", "AWS_SECRET_KEY": "f"}, {**known, store + "session.token": "t"})
    assert (own[store + "access.key"], own[store + "secret.key"]) == ("e", "f") and store + "session.token" not in own
    assert object_store_conf({}, {store + "access.key": "only"}).get(store + "secret.key") is None


def test_merge_stream_without_markers(spark, tmp_path):
    from tierflow.streaming import merge_stream, merged_rows, stream_files

    key = "spark.hadoop.mapreduce.fileoutputcommitter.marksuccessfuljobs"
    conf = spark._jsc.hadoopConfiguration()
    conf.set(key.removeprefix("spark.hadoop."), "false")
    try:
        rows = spark.createDataFrame([(i, "2024-01-01") for i in range(5)], "id int, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
        for _ in range(2):
            rows.write.mode("append").parquet(str(tmp_path / "in"))
            stream = stream_files(spark, str(tmp_path / "in"), rows.schema)
            merge_stream(stream, str(tmp_path / "out"), str(tmp_path / "p"), ["id"], "ts").awaitTermination()
    finally:
        conf.unset(key.removeprefix("spark.hadoop."))
    assert not (tmp_path / "out" / "_SUCCESS").exists()
    assert merged_rows(spark, str(tmp_path / "out"), rows.schema).count() == 5


def test_published_once(spark):
    spark.sql("CREATE NAMESPACE IF NOT EXISTS spark_catalog.landing")
    name = "spark_catalog.landing.once"
    for _ in range(2):
        publish_table(spark.range(3).withColumn("_run", F.lit("a")), name, "overwrite", partition_by=["_run"])
    assert spark.table(name).count() == 3
