"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierflow.llm.common import saved


def _minima(pairs: DataFrame) -> DataFrame:
    """Smallest of each node and its neighbours. Written, so that the join with a crowded node's edges
    joins two plain tables and Spark can split it."""
    return saved(
        pairs.groupBy(F.col("u").alias("node")).agg(F.min(F.least("u", "v")).alias("least")), "component-minima"
    )


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``edges`` (its first two columns) that is not the smallest
    of its component; ``component`` is that smallest node.

    Nodes may be of any type with an order. Null ends and loops are ignored. Each round writes its
    edges to the shared folder; the number of rounds grows with the logarithm of a component's size.
    A node with very many edges is reduced map-side and never gathered in one task.
    """
    a, b = edges.columns[:2]
    low, high = F.least(F.col(a), F.col(b)), F.greatest(F.col(a), F.col(b))
    present = F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))
    current = saved(edges.filter(present).select(high.alias("u"), low.alias("v")).distinct(), "components")
    before = None
    while True:
        state = current.agg(
            F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 30))).alias("s")
        ).first()
        if tuple(state) == before or not state.n:
            return current.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = tuple(state)
        both = current.unionAll(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (
            both.join(_minima(both), F.col("u") == F.col("node"))
            .filter((F.col("v") > F.col("u")) & (F.col("v") != F.col("least")))
            .select(F.col("v").alias("u"), F.col("least").alias("v"))
        )
        large = saved(large.distinct(), "components-large")
        small = large.join(_minima(large), F.col("u") == F.col("node"))
        turned = small.filter(F.col("v") != F.col("least")).select(F.col("v").alias("u"), F.col("least").alias("v"))
        kept = small.select("u", F.col("least").alias("v"))
        current = saved(turned.unionAll(kept).distinct(), "components")
