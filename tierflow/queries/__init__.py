"""Runnable queries over the standard tables; importing the package fills the registry."""

from tierflow.queries import changes, expressions, history, landing, layers, relational, sinks, transform, windows
from tierflow.queries.registry import ORACLES, QUERIES

__all__ = [
    "ORACLES",
    "QUERIES",
    "changes",
    "expressions",
    "history",
    "landing",
    "layers",
    "relational",
    "sinks",
    "transform",
    "windows",
]
