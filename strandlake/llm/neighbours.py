"""Approximate nearest neighbours by stable projections, a kd-tree and a chi-square stopping test."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import store

VALID = "embedding is not null and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity')) and exists(embedding, x -> x <> 0)"
#: Slack on squared projected distances, relative to the projection's squared length: equal vectors project alike but for rounding.
SLACK = 1e-9


def chi2_quantile(p: float, m: int) -> float:
    """The chi-square quantile for an even number ``m`` of degrees of freedom, by bisection of the closed form."""
    def cdf(x):
        term = total = 1.0
        for i in range(1, m // 2):
            term *= x / 2 / i
            total += term
        return 1 - math.exp(-x / 2) * total

    low, high = 0.0, 100.0 + 10 * m
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if cdf(mid) < p else (low, mid)
    return high


class Splits:
    """A complete kd-tree over projected points: leaf i of ``2 ** depth``, by medians of the widest dimension of what it is built from."""

    def __init__(self, points: np.ndarray, depth: int):
        self.depth = depth
        self.dims, self.cuts = np.zeros(2**depth, int), np.zeros(2**depth)
        parts = {1: points}
        for _ in range(depth):
            new = {}
            for node, own in parts.items():
                d = int(np.argmax(np.ptp(own, axis=0))) if len(own) else 0
                c = float(np.median(own[:, d])) if len(own) else 0.0
                self.dims[node], self.cuts[node] = d, c
                right = own[:, d] > c
                new[2 * node], new[2 * node + 1] = own[~right], own[right]
            parts = new

    def leaf(self, points: np.ndarray) -> np.ndarray:
        node = np.ones(len(points), int)
        rows = np.arange(len(points))
        for _ in range(self.depth):
            node = 2 * node + (points[rows, self.dims[node]] > self.cuts[node])
        return node - 2**self.depth


def box_distance(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances from ``q`` to boxes."""
    gap = np.maximum(0, np.maximum(low - q, q - high))
    return np.einsum("ij,ij->i", gap, gap)


class Block:
    """Some vectors under a kd-tree of their projections, with leaves of about ``leaf`` points and their bounding boxes."""

    def __init__(self, ids, vectors, projected, leaf: int = 32):
        depth = max(0, math.ceil(math.log2(len(ids) / leaf))) if len(ids) else 0
        at = Splits(projected, depth).leaf(projected)
        order = np.argsort(at, kind="stable")
        self.ids, self.vectors, self.projected = ids[order], vectors[order], projected[order]
        starts = np.flatnonzero(np.r_[True, np.diff(at[order]) > 0]) if len(ids) else np.zeros(0, int)
        self.starts = np.r_[starts, len(ids)]
        self.low = np.minimum.reduceat(self.projected, starts) if len(ids) else self.projected
        self.high = np.maximum.reduceat(self.projected, starts) if len(ids) else self.projected

    def search(self, own, vector, projected, bound: float, k: int, quantile: float):
        """Up to ``k`` (distance, id) nearest ``vector``, none of id ``own``: leaves by rising projected distance, whose points are verified, until the chi-square test holds of the next leaf, with the k-th distance so far or ``bound``, whichever is less."""
        found_d, found_i = np.zeros(0), np.zeros(0, np.int64)
        gaps = box_distance(projected, self.low, self.high)
        slack = SLACK * (1 + float(projected @ projected))
        for leaf in np.argsort(gaps, kind="stable"):
            limit = bound * bound * quantile + slack
            if gaps[leaf] > limit:
                break
            at = slice(self.starts[leaf], self.starts[leaf + 1])
            off = self.projected[at] - projected
            near = (np.einsum("ij,ij->i", off, off) <= limit) & (self.ids[at] != own)
            if not near.any():
                continue
            diff = self.vectors[at][near] - vector
            found_d = np.r_[found_d, np.sqrt((diff * diff).sum(axis=1))]
            found_i = np.r_[found_i, self.ids[at][near]]
            best = np.lexsort((found_i, found_d))[:k]
            found_d, found_i = found_d[best], found_i[best]
            if len(best) == k:
                bound = min(bound, float(found_d[-1]))
        return found_d, found_i


def stacked(column) -> np.ndarray:
    """A list column, of lists of one length, as a matrix of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def nearest(vectors: DataFrame, queries: str, k: int = 10, dims: int = 8, certainty: float = 0.98, cell_rows: int = 4096, sample: int = 65_536, seed: int = 5) -> DataFrame:
    """``query_id, rank, vec_id, score``: for the rows of ``vectors`` (``vec_id, embedding``) that ``queries`` (SQL) holds of, the ``k`` nearest others by Euclidean distance in double precision, ties to the smaller ``vec_id``.

    Vectors are projected to ``dims`` normal directions, under which a squared distance becomes itself times a chi-square
    variable. Every row is indexed: a kd-tree fitted to at most ``sample`` projections (by a hash of ``vec_id``) deals all
    rows into cells, whose bounding boxes are taken of all their rows. A query searches its own cell first; with the k-th
    distance d found there it then visits the cells, and within them the leaves, whose projected squared distance is
    below d^2 times the chi-square quantile at ``certainty``. A true neighbour is passed over with probability
    1 - ``certainty`` at most.

    The tree (at most ``sample`` / 8 cells) and the boxes are all that the driver holds. A cell with more rows is searched
    in parts of about ``cell_rows``, and one that many queries visit is searched by several tasks; a task holds one part and
    streams its queries. Of equal vectors only the k + 1 smallest ids can be in an answer, so only these are indexed,
    and are picked before rows are dealt out: copies make no hot cell.

    Vectors that are null, zero, hold null or non-finite components, or are not of the most frequent length (the longer
    of several) take no part; nor do null ids. A repeated row counts once. Fewer than ``k`` others: all of them. Empty
    table: empty result.
    """
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    valid = vectors.where("vec_id is not null").where(VALID).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    lengths = valid.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    if not lengths:
        return empty
    width = lengths[0]["n"]
    matrix = np.random.default_rng(seed).standard_normal((width, dims))

    def project(batches):
        import pyarrow as pa

        for batch in batches:
            x = stacked(batch.column(1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(x @ matrix), pa.list_(pa.float64()))], [*batch.schema.names, "projected"])

    keyed = valid.where(F.size("embedding") == width).withColumn("twin", F.xxhash64("embedding")).withColumn("twin2", F.xxhash64(F.lit(3), "embedding")).withColumn("asks", F.expr(f"coalesce({queries}, false)"))
    # A limit on the row number within a group is taken before the rows are dealt out, too.
    first = Window.partitionBy("twin", "twin2").orderBy("vec_id")
    distinct = keyed.dropDuplicates(["vec_id", "twin", "twin2"])
    indexed = distinct.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= k + 1)
    cols = ["vec_id", "embedding", "asks"]
    kind = "vec_id long, embedding array<double>, asks boolean, projected array<double>"
    points = store(indexed.select(*cols).mapInArrow(project, kind))
    asking = store(distinct.where("asks").select(*cols).mapInArrow(project, kind).withColumn("query", F.monotonically_increasing_id()).drop("asks"))

    n = points.count()
    drawn = points.select("vec_id", "projected").orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toPandas()
    fitted = np.array(drawn["projected"].tolist()).reshape(-1, dims)
    depth = max(0, min(math.ceil(math.log2(max(1, n / cell_rows))), int(math.log2(max(1, len(fitted) / 8)))))
    tree = Splits(fitted, depth)

    def celled(batches):
        import pyarrow as pa

        for batch in batches:
            cells = tree.leaf(stacked(batch.column(batch.schema.names.index("projected"))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.int32())], [*batch.schema.names, "cell"])

    points = store(points.drop("asks").mapInArrow(celled, "vec_id long, embedding array<double>, projected array<double>, cell int"))
    asking = store(asking.mapInArrow(celled, "vec_id long, embedding array<double>, projected array<double>, query long, cell int"))
    edges = [f(F.element_at("projected", i + 1)) for f in (F.min, F.max) for i in range(dims)]
    stats = points.groupBy("cell").agg(F.count(F.lit(1)), *edges).collect()
    ids = np.array([r[0] for r in stats])
    low, high = (np.array([r[2 + s * dims : 2 + (s + 1) * dims] for r in stats], float).reshape(-1, dims) for s in (0, 1))
    parts = {r[0]: -(-r[1] // cell_rows) for r in stats}
    quantile = chi2_quantile(certainty, dims)

    def search(visits: DataFrame) -> DataFrame:
        """``visits``: ``query, vec_id, embedding, projected, bound, cell``. Returns ``query, query_id, bound, vec_id, score``."""
        shares = {r[0]: -(-r[1] // (4 * cell_rows)) for r in visits.groupBy("cell").count().collect() if r[0] in parts}
        # A part of a cell goes to each share of its queries, a query to each part. The numbers of both are as many as there are cells.
        sizes = [(int(c), int(parts[c]), int(n)) for c, n in shares.items()]
        sizes = F.broadcast(spark.createDataFrame(sizes, "cell int, parts int, shares int"))
        data = points.join(sizes, "cell").withColumn("part", F.pmod(F.xxhash64("vec_id", "projected"), "parts").cast("int")).withColumn("share", F.explode(F.expr("sequence(0, shares - 1)")))
        data = data.select("cell", "part", "share", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("query"), "vec_id", "embedding", "projected", F.lit(0.0).alias("bound"))
        asks = visits.join(sizes, "cell").withColumn("share", F.pmod(F.xxhash64("query"), "shares").cast("int")).withColumn("part", F.explode(F.expr("sequence(0, parts - 1)")))
        asks = asks.select("cell", "part", "share", F.lit(1).alias("kind"), "query", "vec_id", "embedding", "projected", "bound")

        def run(batches):
            import pyarrow as pa

            held, block, key = [], None, None
            for batch in batches:
                keys = np.stack([batch.column(i).to_numpy() for i in range(3)], 1)
                kinds = batch.column(3).to_numpy()
                edges = np.flatnonzero(np.r_[True, np.any(keys[1:] != keys[:-1], axis=1) | (kinds[1:] != kinds[:-1])])
                for a, b in zip(edges, np.r_[edges[1:], len(keys)]):
                    now = tuple(keys[a])
                    if now != key:
                        held, block, key = [], None, now
                    piece = batch.slice(a, b - a)
                    own, vecs, proj = piece.column(5).to_numpy(), stacked(piece.column(6)), stacked(piece.column(7))
                    if kinds[a] == 0:
                        held.append((own, vecs, proj))
                        continue
                    if block is None:
                        block = Block(*(np.concatenate(c) for c in zip(*held))) if held else Block(np.zeros(0, np.int64), np.zeros((0, width)), np.zeros((0, dims)))
                    out = []
                    for q, i, v, p, bound in zip(piece.column(4).to_numpy(), own, vecs, proj, piece.column(8).to_numpy()):
                        d, found = block.search(i, v, p, bound, k, quantile)
                        out.append((np.full(len(d), q), np.full(len(d), i), np.full(len(d), bound), found, d))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["query", "query_id", "bound", "vec_id", "score"])

        both = data.unionByName(asks).repartition("cell", "part", "share").sortWithinPartitions("cell", "part", "share", "kind")
        return both.mapInArrow(run, "query long, query_id long, bound double, vec_id long, score double")

    # The best k of all parts of a query's own cell; the last of them is the bound.
    home = store(best(search(asking.withColumn("bound", F.lit(math.inf))), k))
    bounds = home.groupBy("query").agg(F.max("score").alias("last"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).select("query", "last")
    bounded = asking.join(bounds, "query", "left").withColumn("bound", F.coalesce("last", F.lit(math.inf))).drop("last")

    def visit(batches):
        import pyarrow as pa

        for batch in batches:
            names = batch.schema.names
            proj, bound, own = stacked(batch.column(names.index("projected"))), batch.column(names.index("bound")).to_numpy(), batch.column(names.index("cell")).to_numpy()
            rows, cells = [], []
            for r in range(len(proj)):
                near = ids[(box_distance(proj[r], low, high) <= bound[r] ** 2 * quantile + SLACK * (1 + proj[r] @ proj[r])) & (ids != own[r])]
                rows += [r] * len(near)
                cells += near.tolist()
            yield pa.RecordBatch.from_arrays([*(batch.column(names.index(c)).take(pa.array(rows, pa.int32())) for c in names if c != "cell"), pa.array(cells, pa.int32())], [*(c for c in names if c != "cell"), "cell"])

    # Every non-home cell whose box the test leaves open: cells without rows have no box and are never visited.
    visits = store(bounded.mapInArrow(visit, "query long, vec_id long, embedding array<double>, projected array<double>, bound double, cell int"))
    found = home.drop("rank").unionByName(search(visits))
    return best(found, k).select("query_id", "rank", "vec_id", "score")


def best(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` first of each query, with their rank; an id found in two places counts once."""
    rank = F.row_number().over(Window.partitionBy("query").orderBy("score", "vec_id"))
    return found.dropDuplicates(["query", "vec_id", "score"]).withColumn("rank", rank.cast("int")).where(F.col("rank") <= k)


def op8_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    """The 10 nearest others of every vector whose id is divisible by 100."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id % 100 = 0")
