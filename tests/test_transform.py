import json

import pytest

from tierflow.__main__ import job_arguments, run_job
from tierflow.functions import sanitize
from tierflow.operators import ensure_namespace
from tierflow.plans import (
    Resources,
    RunLedger,
    Step,
    ingest,
    job_status,
    land_bronze,
    run_layer_transform,
    run_layers,
    run_transform,
    split_script,
    transform_sql,
)
from tierflow.plans import transform as transform_module
from tierflow.plans.history import get_job, latest_runs
from tierflow.session import (
    catalog_conf,
    check_catalog,
    object_store_conf,
    scratch_path,
    shuffle_partitions_for,
    workspace,
)

SPEND = "SELECT customer_id, SUM(amount) AS total FROM source_data GROUP BY customer_id"


@pytest.fixture
def source(spark, tmp_path):
    path = str(tmp_path / "orders")
    spark.range(12).selectExpr("id % 3 AS customer_id", "id AS amount").write.parquet(path)
    return path


@pytest.mark.parametrize(
    "text, statements",
    [
        ("SELECT 1", ["SELECT 1"]),
        ("SELECT 1;", ["SELECT 1"]),
        (" ; ;\nSELECT 1 ;; SELECT 2 -- x; y\n;", ["SELECT 1", "SELECT 2 -- x; y"]),
        ("SELECT ';', \";\", `;`; SELECT 2", ["SELECT ';', \";\", `;`", "SELECT 2"]),
        (r"SELECT 'it\'s; ok', 'a'';b'; SELECT 2", [r"SELECT 'it\'s; ok', 'a'';b'", "SELECT 2"]),
        (r"SELECT r'\'; SELECT 2", [r"SELECT r'\'", "SELECT 2"]),
        ("/* it's; /* nested; */ */ SELECT 1; SELECT 2", ["/* it's; /* nested; */ */ SELECT 1", "SELECT 2"]),
        ("-- only; a comment", []),
        ("", []),
    ],
)
def test_split_script(text, statements):
    assert split_script(text) == statements


def test_script_runs_in_order_and_ends_lazy(spark):
    frame = transform_sql(
        spark,
        spark.range(4),
        "CREATE OR REPLACE TEMP VIEW doubled AS SELECT id * 2 AS d FROM source_data; SELECT SUM(d) AS s FROM doubled",
    )
    assert frame.head()["s"] == 12


def test_params_are_bound_not_pasted(spark):
    nasty = "x' OR '1'='1"
    frame = transform_sql(
        spark,
        {"names": spark.createDataFrame([("x",), (nasty,)], "name string")},
        "SELECT * FROM names WHERE name = :name",
        params={"name": nasty},
    )
    assert [r["name"] for r in frame.collect()] == [nasty]


def test_required_inputs(spark, source, tmp_path):
    out = str(tmp_path / "out")
    for sql, sources, destination in [
        ("", [source], out),
        (" ; ", [source], out),
        (SPEND, [], out),
        (SPEND, {}, out),
        (SPEND, [source], ""),
    ]:
        with pytest.raises(ValueError):
            run_transform(spark, sql, sources, destination)


def test_run_writes_and_records(spark, source, tmp_path):
    ledger = RunLedger(spark, str(tmp_path / "ledger"))
    out = str(tmp_path / "silver")
    missing = str(tmp_path / "missing")
    result = run_transform(
        spark, SPEND, [missing, source], out, ledger=ledger, resources=Resources(executor_instances=4)
    )
    assert (result.state, result.rows_out, result.table) == ("COMPLETED", 3, None)
    assert [r.status for r in result.sources] == ["unreadable", "read"]
    assert sorted(r["total"] for r in spark.read.parquet(out).collect()) == [18, 22, 26]
    states = [r["state"] for r in ledger.runs().orderBy("recorded_at").collect()]
    assert states == ["SUBMITTED", "RUNNING", "WRITTEN", "COMPLETED"]
    last = latest_runs(ledger.runs()).head()
    assert (last["rows_out"], last["executor_instances"], last["sql"]) == (3, 4, SPEND)
    assert last["spark_application"] == f"sql-exec-{result.run_id}" and len(result.run_id) == 32
    assert last["submitted_at"] <= last["started_at"] <= last["finished_at"]
    assert ledger.events(result.run_id).select("reason").distinct().count() == 5  # four states and the source left out
    assert get_job(ledger.runs(result.run_id), result.run_id)["state"] == "COMPLETED"


def test_inputs_are_counted_on_request(spark, source, tmp_path):
    out = str(tmp_path / "out")
    assert run_transform(spark, SPEND, [source], out).rows_in == {}
    twice = run_transform(spark, SPEND, [source, source + "/"], out, count_inputs=True)
    assert twice.rows_in == {source: 12, source + "/": 12}
    named = run_transform(spark, "SELECT * FROM a", {"a": source}, out, count_inputs=True)
    assert (named.rows_in, named.rows_out) == ({"a": 12}, 12)


def test_bronze_jsonl_feeds_silver(spark, tmp_path):
    root = str(tmp_path)
    rows = spark.range(6).selectExpr("id % 2 AS customer_id", "id AS amount")
    ingest(rows, f"{root}/bronze", "r1", metadata=False)
    result = run_layer_transform(spark, SPEND, root, scan_options={"format": "json"})
    assert result.destination == f"{root}/silver/{result.run_id}/" and result.rows_out == 2
    again = run_layer_transform(spark, SPEND, root, source_path=f"{root}/bronze", scan_options={"format": "json"})
    assert again.run_id != result.run_id


def test_failure_is_recorded_and_raised(spark, source, tmp_path):
    ledger = RunLedger(spark, str(tmp_path / "ledger"))
    with pytest.raises(Exception, match="nope"):
        run_transform(spark, "SELECT nope FROM source_data", source, str(tmp_path / "o"), ledger=ledger)
    row = job_status(ledger.runs()).head()
    assert row["state"] == "FAILED" and "nope" in row["error_message"]


def test_empty_ledger_and_unknown_run(spark, tmp_path):
    ledger = RunLedger(spark, str(tmp_path / "none"))
    assert ledger.runs().count() == 0 and ledger.events("x").count() == 0
    with pytest.raises(LookupError):
        get_job(ledger.runs(), "x")


def test_overwriting_the_source_is_refused(spark, source):
    with pytest.raises(ValueError, match="refusing"):
        run_transform(spark, SPEND, [source], source)
    with pytest.raises(ValueError, match="refusing"):
        run_transform(spark, f"SELECT * FROM parquet.`{source}`", spark.range(1), source)
    assert spark.read.parquet(source).count() == 12


@pytest.fixture
def table(spark, request):
    ensure_namespace(spark, "spark_catalog", "checks")
    name = f"spark_catalog.checks.{sanitize(request.node.name)}"
    yield name
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_append_publishes_only_this_run(spark, source, tmp_path, table):
    out = str(tmp_path / "out")
    for runs in (1, 2):
        result = run_transform(spark, SPEND, [source], out, mode="append", table=table)
        assert result.rows_out == 3
        assert spark.read.parquet(out).count() == spark.table(table).count() == 3 * runs


def test_table_name_comes_from_the_destination(spark, source, tmp_path):
    out = str(tmp_path / "Silver Layer" / "9Total")
    result = run_transform(spark, SPEND, [source], out, catalog="spark_catalog")
    assert result.table == "spark_catalog.silver_layer.t9total"
    assert spark.table(result.table).count() == 3
    spark.sql("DROP DATABASE silver_layer CASCADE")


@pytest.mark.parametrize("mode", ["overwrite", "append"])
def test_failed_publish_resumes_without_running_again(spark, source, tmp_path, table, monkeypatch, mode):
    ledger = RunLedger(spark, str(tmp_path / "ledger"))
    arguments = {"mode": mode, "table": table, "ledger": ledger, "run_id": f"run-{mode}"}
    out = str(tmp_path / "out")
    with monkeypatch.context() as broken:

        def refuse(*args, **kwargs):
            raise RuntimeError("catalog is down")

        broken.setattr(transform_module, "publish_table", refuse)
        with pytest.raises(RuntimeError):
            run_transform(spark, SPEND, [source], out, **arguments)
    assert job_status(ledger.runs()).head()["state"] == "WRITTEN"
    assert ledger.events().filter("reason = 'PublishFailed'").count() == 1

    result = run_transform(spark, "SELECT wrong FROM nowhere", [source], out, **arguments)
    assert (result.state, result.rows_out) == ("COMPLETED", 3)
    assert spark.table(table).count() == spark.read.parquet(out).count() == 3
    last = latest_runs(ledger.runs()).head()
    assert (last["state"], last["execution_attempts"], last["sql"]) == ("COMPLETED", 2, SPEND)


def test_job_arguments(spark, source, tmp_path, monkeypatch):
    env = {
        "SQL_QUERY": SPEND,
        "SOURCE_PATHS": json.dumps([source]),
        "DESTINATION_PATH": str(tmp_path / "out"),
    }
    assert job_arguments(spark, env)["mode"] == "overwrite"
    for name in env:
        with pytest.raises(ValueError, match=name):
            job_arguments(spark, {k: v for k, v in env.items() if k != name})
    with pytest.raises(ValueError, match="JSON"):
        job_arguments(spark, env | {"SOURCE_PATHS": "[oops"})
    assert run_job(spark, env).rows_out == 3
    spark.conf.set("spark.sql.transform.writeMode", "append")
    try:
        assert run_job(spark, env).rows_out == 3
    finally:
        spark.conf.unset("spark.sql.transform.writeMode")
    assert spark.read.parquet(env["DESTINATION_PATH"]).count() == 6


def test_object_store_conf():
    chain = object_store_conf({})
    assert "spark.hadoop.fs.s3a.aws.credentials.provider" not in chain
    assert object_store_conf({"S3_ENDPOINT": "http://e"})["spark.hadoop.fs.s3a.endpoint"] == "http://e"
    assert chain["spark.hadoop.fs.s3a.path.style.access"] == "false"
    keys = {"AWS_ACCESS_KEY_ID": "k", "AWS_SECRET_KEY": "s"}
    simple = object_store_conf(keys | {"AWS_REGION": "r", "S3_ENDPOINT": "http://e"})
    assert simple["spark.hadoop.fs.s3a.aws.credentials.provider"].endswith(".SimpleAWSCredentialsProvider")
    assert simple["spark.hadoop.fs.s3a.secret.key"] == "s"
    assert simple["spark.hadoop.fs.s3a.endpoint.region"] == "r"
    assert simple["spark.hadoop.fs.s3a.path.style.access"] == "true"
    token = object_store_conf(keys | {"AWS_SESSION_TOKEN": "t"})
    assert token["spark.hadoop.fs.s3a.session.token"] == "t"


def test_catalog_conf_and_check(spark):
    conf = catalog_conf("lake", "example.Catalog", catalog_impl="example.Impl", uri="http://u")
    assert conf == {
        "spark.sql.catalog.lake": "example.Catalog",
        "spark.sql.catalog.lake.catalog-impl": "example.Impl",
        "spark.sql.catalog.lake.uri": "http://u",
    }
    check_catalog(spark, "spark_catalog")
    with pytest.raises(ValueError, match="not registered"):
        check_catalog(spark, "unknown")
    spark.conf.set("spark.sql.catalog.absent", "example.Catalog")
    with pytest.raises(ValueError, match="cannot be loaded"):
        check_catalog(spark, "absent")


def test_workspace_is_the_shared_folder(spark):
    shared = spark.conf.get("spark.checkpoint.dir")
    assert workspace(spark) == shared
    assert scratch_path(spark, "x").startswith(shared)
    assert scratch_path(spark, "x") != scratch_path(spark, "x")


def test_shuffle_width():
    assert shuffle_partitions_for(0, 4) == 8
    assert shuffle_partitions_for(100 << 40, 4000) == 819_200


def test_bronze_keeps_rows_and_adds_load_columns(spark, source, tmp_path):
    out = str(tmp_path / "bronze")
    rows = spark.read.parquet(source)
    assert land_bronze(rows, out, "r1") == 12
    assert land_bronze(rows, out, "r2", format="parquet") == 12
    back = spark.read.parquet(out)
    assert back.columns == ["customer_id", "amount", "_source_file", "_run_id", "_ingested_at"]
    assert back.filter("_source_file IS NULL").count() == 0
    assert back.select("_run_id").distinct().count() == 2


def test_ingest_records_its_run(spark, tmp_path):
    ledger = RunLedger(spark, str(tmp_path / "ledger"))
    out = str(tmp_path / "landing")
    assert ingest(spark.range(7), out, "r1", ledger=ledger) == 7
    assert spark.read.json(out).count() == 7
    last = latest_runs(ledger.runs()).head()
    assert (last["state"], last["rows_out"], last["destination"]) == ("COMPLETED", 7, out)
    with pytest.raises(Exception):
        ingest(spark.range(7), out, "r2", mode="error", ledger=ledger)
    assert get_job(ledger.runs(), "r2")["state"] == "FAILED"


def test_layers_feed_each_other(spark, tmp_path):
    steps = [
        Step("raw", "bronze", ["seed"], "SELECT id FROM seed"),
        Step("even", "silver", ["raw"], lambda inputs: inputs["raw"].filter("id % 2 = 0")),
        Step("count", "gold", ["even"], "SELECT COUNT(*) AS n FROM even"),
        Step("again", "bronze", ["count"], "SELECT n FROM `count`"),
    ]
    known = run_layers(spark, str(tmp_path), {"seed": spark.range(10)}, steps)
    assert known["again"].head()["n"] == 5
    assert (tmp_path / "gold" / "count").is_dir()
    with pytest.raises(ValueError, match="needs"):
        run_layers(spark, str(tmp_path), {}, steps)
