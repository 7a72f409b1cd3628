"""Session building: defaults, object store and catalog settings, shared scratch space."""

from __future__ import annotations

import logging
import tempfile
import uuid
from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession

# Spark's own settings. Adaptive execution is on by default in Spark; it is spelled out because
# skew-join splitting, partition coalescing and REBALANCE all depend on it.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}

log = logging.getLogger(__name__)

_local_roots: dict[str, str] = {}


def shuffle_partitions_for(input_bytes: int, cores: int, target_bytes: int = 128 << 20) -> int:
    """Initial shuffle width for an input size: about ``target_bytes`` per task, and at least two
    waves over the cores. Adaptive execution merges what turns out too small."""
    return max(2 * cores, -(-input_bytes // target_bytes))


def build_session(
    app_name: str = "tierflow",
    *,
    master: str | None = None,
    ansi: bool = True,
    shuffle_partitions: int | None = None,
    conf: Mapping[str, str] | None = None,
) -> SparkSession:
    """Session with the engine's defaults. ``ansi=False`` gives wrap-around and NULL instead of
    errors on overflow, bad casts and division by zero."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {**DEFAULT_CONF, "spark.sql.ansi.enabled": str(ansi).lower()}
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for key, value in {**settings, **(conf or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def object_store_conf(env: Mapping[str, str], known: Mapping[str, str] | None = None) -> dict[str, str]:
    """Builder-time S3A settings from an environment mapping, and from settings already ``known`` (those
    of the submission) where the environment has none.

    Keys come whole from one of the two, and path-style access is settled only where nothing is known
    of it. They must reach the builder: set on a running session the ``spark.hadoop.`` prefix is not
    stripped, so the file system never sees them. Nothing here is ever logged.
    """
    # Hadoop S3A class names and setting keys, and the names of environment variables.
    conf = {
        "spark.hadoop.fs.s3a.impl": "org.apache.hadoop.fs.s3a.S3AFileSystem",
        "spark.hadoop.fs.s3.impl": "org.apache.hadoop.fs.s3a.S3AFileSystem",
        "spark.hadoop.fs.s3a.fast.upload": "true",
        "spark.hadoop.fs.s3a.multipart.size": "67108864",
        "spark.hadoop.fs.s3a.connection.ssl.enabled": "true",
    }
    known = known or {}
    key = env.get("AWS_ACCESS_KEY_ID")
    secret = env.get("AWS_SECRET_ACCESS_KEY") or env.get("AWS_SECRET_KEY")
    token = env.get("AWS_SESSION_TOKEN")
    if not (key and secret):
        store = "spark.hadoop.fs.s3a."
        key, secret, token = (known.get(store + n) for n in ("access.key", "secret.key", "session.token"))
    # Without keys the provider is left to Hadoop's own default, which knows role-based access.
    provider = None
    if key and secret:
        conf["spark.hadoop.fs.s3a.access.key"] = key
        conf["spark.hadoop.fs.s3a.secret.key"] = secret
        provider = "org.apache.hadoop.fs.s3a.SimpleAWSCredentialsProvider"
        if token:
            # The simple provider ignores session tokens, the temporary one reads them.
            conf["spark.hadoop.fs.s3a.session.token"] = token
            provider = "org.apache.hadoop.fs.s3a.TemporaryAWSCredentialsProvider"
    if provider:
        name = "spark.hadoop.fs.s3a.aws.credentials.provider"
        conf[name] = known.get(name, provider) if key == known.get("spark.hadoop.fs.s3a.access.key") else provider
    if env.get("AWS_REGION"):
        conf["spark.hadoop.fs.s3a.endpoint.region"] = env["AWS_REGION"]
    endpoint = env.get("S3_ENDPOINT")
    if endpoint:
        conf["spark.hadoop.fs.s3a.endpoint"] = endpoint
    style = "spark.hadoop.fs.s3a.path.style.access"
    conf[style] = "true" if endpoint else known.get(style, "false")
    return conf


def catalog_conf(name: str, impl: str, **options: str) -> dict[str, str]:
    """Settings that register a table catalog; option names use ``_`` for ``-``
    (``catalog_impl`` becomes ``catalog-impl``)."""
    conf = {f"spark.sql.catalog.{name}": impl}
    for key, value in options.items():
        conf[f"spark.sql.catalog.{name}.{key.replace('_', '-')}"] = value
    return conf


def check_catalog(spark: SparkSession, name: str) -> None:
    """Fail early, with a plain message, when a catalog cannot be loaded.

    Spark loads catalog classes at first use: an unknown name shows up as a namespace error and a
    missing class as a raw JVM error.
    """
    if name == "spark_catalog":
        return
    if spark.conf.get(f"spark.sql.catalog.{name}", None) is None:
        raise ValueError(f"catalog {name!r} is not registered; see catalog_conf")
    try:
        spark.sql(f"SHOW NAMESPACES IN `{name}`")
    except AnalysisException:
        raise
    except Exception as error:
        raise ValueError(f"catalog {name!r} cannot be loaded: {error}") from error


def workspace(spark: SparkSession) -> str:
    """Shared folder for written intermediates: the session's ``spark.checkpoint.dir``.

    Only a local-mode session without that setting falls back to a temporary folder; on a cluster
    a missing setting is an error, because executors could not see a driver-local folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if root:
        scheme = spark._jvm.org.apache.hadoop.fs.Path(root).toUri().getScheme()
        # It may be a network mount, which cannot be told from here.
        if scheme == "file" and not context.master.startswith("local"):
            log.warning("spark.checkpoint.dir is %s: every executor must have it mounted at that place", root)
        return root.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = context.applicationId
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="tierflow-")
    return _local_roots[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; two calls never give the same one."""
    return f"{workspace(spark)}/tierflow/{name}-{uuid.uuid4().hex[:12]}"
