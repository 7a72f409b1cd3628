"""tierflow: layered data pipelines on Spark."""

from tierflow.session import build_session, catalog_conf, object_store_conf

__all__ = ["build_session", "catalog_conf", "object_store_conf"]
