"""Connected components of links between documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected
from .common import store


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (``a, b``, longs), the root being the smallest node that it is joined to. Loops and repeated edges are allowed."""
    edges = store(edges.select("a", "b").distinct())
    found = connected(edges.select(F.explode(F.array("a", "b")).alias("node")), edges)
    return found.withColumnRenamed("component", "root")
