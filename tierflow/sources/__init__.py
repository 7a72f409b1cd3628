from tierflow.sources.connectors import (
    DocumentStoreConfig,
    KafkaConfig,
    MySQLConfig,
    PostgresConfig,
    document_store_options,
    jdbc_options,
    kafka_options,
    parse_messages,
    scan_document_store,
    scan_jdbc,
    scan_kafka,
)
from tierflow.sources.files import SourceReport, load_sources, scan, scan_all
from tierflow.sources.registry import list_registry, resolve_source
from tierflow.sources.variant import JsonLanding, corrupt_lines, exploded, land_json, landed_rows, typed, variant_schema

__all__ = [
    "DocumentStoreConfig",
    "JsonLanding",
    "KafkaConfig",
    "MySQLConfig",
    "PostgresConfig",
    "SourceReport",
    "corrupt_lines",
    "document_store_options",
    "exploded",
    "jdbc_options",
    "kafka_options",
    "land_json",
    "landed_rows",
    "list_registry",
    "load_sources",
    "parse_messages",
    "resolve_source",
    "scan",
    "scan_all",
    "scan_document_store",
    "scan_jdbc",
    "scan_kafka",
    "typed",
    "variant_schema",
]
