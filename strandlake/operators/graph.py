"""Graphs as tables of edges: components, forests, distributed numbering."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import cut


def dense_ids(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``df`` with ``name``, 0, 1, ... in the order of ``keys`` (unique together), without one task ever holding all rows: sorted range partitions are numbered within and shifted by the rows before them."""
    placed = cut(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    counts = placed.groupBy("_p").count()  # a row per partition
    shift = F.coalesce(F.sum("count").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return placed.join(F.broadcast(counts.select("_p", shift.alias("_s"))), "_p").withColumn(name, F.col("_i") + F.col("_s")).drop("_p", "_i", "_s")


def chain_edges(held: DataFrame, node: str, by: str) -> DataFrame:
    """Edges ``a, b`` between the consecutive holders of each ``by``: the components of all pairs of holders from a number of edges that grows with the rows and not with pairs."""
    before = F.lag(node).over(Window.partitionBy(by).orderBy(node))
    return held.select(F.col(node).cast("long").alias("b"), before.cast("long").alias("a")).where("a is not null and a <> b").select("a", "b").distinct()


def connected(nodes: DataFrame | None, edges: DataFrame) -> DataFrame:
    """``node, component`` with the least node as the component: alternating large-star and small-star steps. Nodes without edges are their own component.

    Each step is a minimum per node, summed up map-side and stored, and a join of two stored tables, which Spark may split
    at hubs. Turns grow with the logarithm of the longest path; only a count and a checksum reach the driver.
    """
    now, sign = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()), None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        now = cut(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        least = cut(now.groupBy("a").agg(F.min("b").alias("m")))
        moved = now.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = cut(moved.unionByName(least.withColumnRenamed("m", "b")).distinct())
        new = tuple(now.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))")).first())
        if new == sign:
            break
        sign = new
    found = now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
    if nodes is None:
        return found
    every = nodes.select(F.col(nodes.columns[0]).cast("long").alias("node")).distinct()
    return every.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def link_cuts(links: DataFrame, sizes: DataFrame, strengths: list[float]) -> DataFrame:
    """``strength, components, largest`` left when links (``a, b, shared``) weaker than each of ``strengths`` (shared over the lesser of both sizes, ``node, size``) are cut. A spanning forest of the strongest links has the components of them all at every strength."""
    strong = links.join(sizes.select(F.col("node").alias("a"), F.col("size").alias("sa")), "a").join(sizes.select(F.col("node").alias("b"), F.col("size").alias("sb")), "b")
    return forest_cuts(boruvka(strong.select("a", "b", (-F.col("shared") / F.least("sa", "sb")).alias("weight"))), sizes.select("node"), strengths)


def forest_cuts(forest: DataFrame, nodes: DataFrame, strengths: list[float]) -> DataFrame:
    """``link_cuts`` of a minimum spanning forest (``a, b, weight``) whose weights are strengths below zero, over all of ``nodes``."""
    nodes, strong, out = cut(nodes), cut(forest.select("a", "b", (-F.col("weight")).alias("strength"))), None
    for s in strengths:
        found = connected(nodes, strong.where(F.col("strength") >= s))
        row = found.groupBy("component").count().agg(F.lit(float(s)).alias("strength"), F.count(F.lit(1)).alias("components"), F.max("count").alias("largest"))
        out = row if out is None else out.unionByName(row)
    return out


class Forest:
    """A union-find over 0 .. n-1 that joins the lesser root to keep the result free of the order of equal joins."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def spanning_forest(edges: Iterable[tuple[int, int, float]], n: int) -> list[tuple[int, int, float]]:
    """A minimum spanning forest of one component's edges (weight, then node pair decide)."""
    forest = Forest(n)
    return [(a, b, w) for w, a, b in sorted((w, min(a, b), max(a, b)) for a, b, w in edges) if forest.join(a, b)]


def _least_forest(a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The places of the edges of a minimum spanning forest, by rising (weight, a, b)."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    order = np.lexsort((b, a, weight))
    x, y = ends[: len(a)][order].tolist(), ends[len(a) :][order].tolist()
    up, taken = list(range(len(nodes))), []
    for i, (p, q) in enumerate(zip(x, y)):
        while up[p] != p:
            up[p] = p = up[up[p]]
        while up[q] != q:
            up[q] = q = up[up[q]]
        if p != q:
            up[max(p, q)] = min(p, q)
            taken.append(i)
    return order[np.array(taken, np.int64)]


def thinned_edges(edges: DataFrame, most_rows: int) -> DataFrame:
    """Distinct ``a, b, weight`` less what closes a cycle of lighter ones within a run of up to ``most_rows``, which no minimum spanning forest has: of many edges over few nodes about as many are left in a task as there are nodes."""

    def run(batches):
        held, n = [], 0
        for g in batches:
            for lo in range(0, len(g), most_rows):
                held.append(g.iloc[lo : lo + most_rows])
                n += len(held[-1])
                if n >= most_rows:
                    left = _forest_of(held)
                    if 2 * len(left) > most_rows:  # not worth holding on to
                        yield left
                        held, n = [], 0
                    else:
                        held, n = [left], len(left)
        if n:
            yield _forest_of(held)

    return edges.select("a", "b", "weight").mapInPandas(run, edges.select("a", "b", "weight").schema)


def _forest_of(held: list[pd.DataFrame]) -> pd.DataFrame:
    g = pd.concat(held, ignore_index=True)
    return g.iloc[_least_forest(g["a"].to_numpy(), g["b"].to_numpy(), g["weight"].to_numpy())]


def boruvka(edges: DataFrame, most_rows: int = 500_000) -> DataFrame:
    """A minimum spanning forest of ``edges`` (``a, b, weight``) of any size, as ``a, b, weight``.

    Tasks first drop what closes a cycle among their own edges, as long as that halves them; what then fits ``most_rows`` is
    finished by one task. Else, in every round each component takes its least edge out of it, ordered by weight and then
    node pair, a total order, so that no cycle can close; the components then merge. Rounds are logarithmic in the nodes;
    each is a minimum per component and a call of ``connected``.
    """
    left = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "weight").where("a <> b and weight is not null").groupBy("a", "b").agg(F.min("weight").alias("weight")))
    n = left.count()
    while n > most_rows:
        left = cut(thinned_edges(left.repartition(-(-n // (4 * most_rows))), most_rows))
        n, before = left.count(), n
        if 2 * n > before:
            break
    if n <= most_rows:
        return cut(thinned_edges(left.coalesce(1), most_rows + 1))
    rest = left.withColumn("ca", F.col("a")).withColumn("cb", F.col("b"))
    chosen = None
    while True:
        ends = rest.select(F.col("ca").alias("c"), F.struct("weight", "a", "b").alias("e")).unionByName(rest.select(F.col("cb").alias("c"), F.struct("weight", "a", "b").alias("e")))
        best = cut(ends.groupBy("c").agg(F.min("e").alias("e")).select("e.a", "e.b", "e.weight").distinct())
        if best.isEmpty():
            break
        chosen = best if chosen is None else chosen.unionByName(best)
        labels = cut(connected(None, chosen.select("a", "b")))
        rest = left.join(labels.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left").join(labels.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left")
        rest = cut(rest.select("a", "b", "weight", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb")).where("ca <> cb"))
    return chosen if chosen is not None else left


def cuthill_mckee(n: int, pairs: np.ndarray) -> np.ndarray:
    """Reverse Cuthill-McKee order of 0 .. n-1 under undirected ``pairs``."""
    near: list[set[int]] = [set() for _ in range(n)]
    for a, b in pairs.tolist():
        if a != b:
            near[a].add(b)
            near[b].add(a)
    degree = [len(x) for x in near]
    seen, order = [False] * n, []
    for start in sorted(range(n), key=lambda i: (degree[i], i)):
        if seen[start]:
            continue
        seen[start] = True
        queue = [start]
        for i in queue:
            order.append(i)
            for j in sorted((j for j in near[i] if not seen[j]), key=lambda j: (degree[j], j)):
                seen[j] = True
                queue.append(j)
    return np.array(order[::-1], np.int64)
