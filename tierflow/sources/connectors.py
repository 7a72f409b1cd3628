"""Relational, Kafka and document-store sources: typed settings and Spark reader options."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def _check_port(port: int) -> None:
    if not 1 <= port <= 65535:
        raise ValueError(f"port must be between 1 and 65535, got {port}")


@dataclass(frozen=True)
class PostgresConfig:
    host: str
    database: str
    username: str
    password: str = field(repr=False)
    port: int = 5432

    driver = "org.postgresql.Driver"

    def __post_init__(self) -> None:
        _check_port(self.port)

    @property
    def url(self) -> str:
        return f"jdbc:postgresql://{self.host}:{self.port}/{self.database}"


@dataclass(frozen=True)
class MySQLConfig:
    host: str
    database: str
    username: str
    password: str = field(repr=False)
    port: int = 3306

    driver = "com.mysql.cj.jdbc.Driver"

    def __post_init__(self) -> None:
        _check_port(self.port)

    @property
    def url(self) -> str:
        return f"jdbc:mysql://{self.host}:{self.port}/{self.database}"


@dataclass(frozen=True)
class KafkaConfig:
    bootstrap_servers: Sequence[str]
    topic: str
    security_protocol: str = "PLAINTEXT"
    group_id: str | None = "default_group"


@dataclass(frozen=True)
class DocumentStoreConfig:
    connection_string: str = field(repr=False)
    database: str
    auth_source: str = "admin"


def jdbc_options(
    config: PostgresConfig | MySQLConfig,
    table: str,
    *,
    partition_column: str | None = None,
    bounds: tuple[object, object] | None = None,
    num_partitions: int | None = None,
    fetch_size: int = 10_000,
) -> dict[str, str]:
    """Reader options. A partitioned read needs column, bounds and count together; bounds only set
    the stride, rows outside them are still read by the first and last task."""
    given = [partition_column is not None, bounds is not None, num_partitions is not None]
    if any(given) and not all(given):
        raise ValueError("partition_column, bounds and num_partitions go together")
    options = {
        "url": config.url,
        "dbtable": table,
        "user": config.username,
        "password": config.password,
        "driver": config.driver,
        "fetchsize": str(fetch_size),
    }
    if all(given):
        options |= {
            "partitionColumn": partition_column,
            "lowerBound": str(bounds[0]),
            "upperBound": str(bounds[1]),
            "numPartitions": str(num_partitions),
        }
    return options


def scan_jdbc(
    spark: SparkSession,
    config: PostgresConfig | MySQLConfig,
    table: str,
    *,
    predicates: Sequence[str] | None = None,
    single_task: bool = False,
    **partitioning: object,
) -> DataFrame:
    """Table scan with Spark's own filter, column, limit and aggregate pushdown.

    Without a partition column or predicates the whole table would come through one task and one
    connection; that must be asked for with ``single_task``.

    Equal strides leave a crowded key range in one task; ``predicates`` (one per task, disjoint and
    complete) cuts such a range as finely as needed.
    """
    options = jdbc_options(config, table, **partitioning)
    if not predicates and "numPartitions" not in options and not single_task:
        raise ValueError("give predicates or a partition column, or allow a scan in a single task")
    if predicates:
        if partitioning:
            raise ValueError("give predicates or a partition column, not both")
        extra = {k: v for k, v in options.items() if k not in ("url", "dbtable")}
        return spark.read.jdbc(options["url"], table, predicates=list(predicates), properties=extra)
    return spark.read.format("jdbc").options(**options).load()


def kafka_options(
    config: KafkaConfig,
    *,
    starting_offsets: str = "earliest",
    min_partitions: int | None = None,
    max_offsets_per_trigger: int | None = None,
) -> dict[str, str]:
    """Reader options. ``min_partitions`` lets Spark cut a crowded topic partition into several
    tasks; without it one topic partition is one task."""
    options = {
        "kafka.bootstrap.servers": ",".join(config.bootstrap_servers),
        "subscribe": config.topic,
        "kafka.security.protocol": config.security_protocol,
        "startingOffsets": starting_offsets,
    }
    if config.group_id:
        options["kafka.group.id"] = config.group_id
    if min_partitions:
        options["minPartitions"] = str(min_partitions)
    if max_offsets_per_trigger:
        options["maxOffsetsPerTrigger"] = str(max_offsets_per_trigger)
    return options


def scan_kafka(
    spark: SparkSession, config: KafkaConfig, *, stream: bool = False, **tuning: object
) -> DataFrame:
    reader = spark.readStream if stream else spark.read
    return reader.format("kafka").options(**kafka_options(config, **tuning)).load()


def parse_messages(messages: DataFrame, schema: StructType | str) -> DataFrame:
    """Kafka rows (batch or stream) with their JSON value as columns, next to where they came from.

    A value that does not parse gives NULL columns and stays readable in ``_message``.
    """
    text = F.col("value").cast("string")
    parsed = messages.select(
        F.from_json(text, schema).alias("_parsed"),
        F.col("key").cast("string").alias("_key"),
        F.col("topic").alias("_topic"),
        F.col("partition").alias("_partition"),
        F.col("offset").alias("_offset"),
        F.col("timestamp").alias("_timestamp"),
        text.alias("_message"),
    )
    return parsed.select("_parsed.*", *[c for c in parsed.columns if c != "_parsed"])


def document_store_options(
    config: DocumentStoreConfig, collection: str, extra: Mapping[str, str] | None = None
) -> dict[str, str]:
    uri = config.connection_string
    if "authSource=" not in uri:
        uri += ("&" if "?" in uri else "?") + f"authSource={config.auth_source}"
    return {
        "connection.uri": uri,
        "database": config.database,
        "collection": collection,
        **(extra or {}),
    }


def scan_document_store(
    spark: SparkSession,
    config: DocumentStoreConfig,
    collection: str,
    extra: Mapping[str, str] | None = None,
) -> DataFrame:
    options = document_store_options(config, collection, extra)
    return spark.read.format("mongodb").options(**options).load()
