"""Who gets a shared k-mer: greedy covers, winners, and what is called present."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numerics import ztp_rate
from ..lineage import cut
from .graph import chain_edges, connected


def with_components(kmers: DataFrame) -> DataFrame:
    """K-mer hits with the ``component`` of their unit: units are joined by the k-mers they share."""
    labels = connected(kmers.select("unit").distinct(), chain_edges(kmers, "unit", "hash"))
    return kmers.join(labels.withColumnRenamed("node", "unit"), "unit")


def component_batches(kmers: DataFrame, most_rows: int = 1_000_000) -> DataFrame:
    """``component, batch``: whole components put together up to about ``most_rows`` rows, in order; a larger one is alone."""
    sizes = kmers.groupBy("component").count()
    total = F.sum("count").over(Window.orderBy("component").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return sizes.withColumn("batch", F.floor((total - F.col("count")) / most_rows)).select("component", "batch")


def cover(group: pd.DataFrame) -> pd.DataFrame:
    """Greedy set cover of one component (``unit, hash, t_g``): time and again the unit with the most k-mers that are not taken, over its rate (ties: the least unit), takes them. Returns the rows with ``owned``, and per unit ``unique_kmers`` and the ``score`` at which it was taken."""
    kmers = {u: set(h) for u, h in group.groupby("unit")["hash"]}
    rate = group.groupby("unit")["t_g"].first().to_dict()
    heap = [(-len(h) / rate[u], u) for u, h in kmers.items()]
    heapq.heapify(heap)
    owner: dict[int, int] = {}
    score: dict[int, float] = {}
    while heap:
        _, u = heapq.heappop(heap)
        kmers[u] = {h for h in kmers[u] if h not in owner}
        if not kmers[u]:
            continue
        now = -len(kmers[u]) / rate[u]
        if heap and (now, u) > heap[0]:
            heapq.heappush(heap, (now, u))
            continue
        owner.update(dict.fromkeys(kmers[u], u))
        score[u] = -now
    out = group.copy()
    out["owned"] = [owner.get(h) == u for h, u in zip(out["hash"], out["unit"])]
    out["score"] = out["unit"].map(score)
    out["unique_kmers"] = out.groupby("unit")["owned"].transform("sum").astype("int64")
    return out


def gather(kmers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Greedy cover over all components (``component, unit, hash, t_g``, ...): rows with ``owned``; and per unit taken ``unit, unique_kmers, rank``, ranks being of the whole cover, by falling score and then unit."""
    from pyspark.sql.types import StructType

    more = StructType.fromDDL("owned boolean, score double, unique_kmers long")
    rows = cut(kmers.groupBy("component").applyInPandas(cover, StructType(kmers.schema.fields + more.fields)))
    units = rows.where("owned").groupBy("unit").agg(F.first("unique_kmers").alias("unique_kmers"), F.first("score").alias("score"))
    return rows.drop("score", "unique_kmers"), units.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "unit"))).drop("score")


def best_holder(kmers: DataFrame, score) -> DataFrame:
    """The rows of each hash's unit of the best score, ties to the least unit."""
    rank = F.row_number().over(Window.partitionBy("hash").orderBy(F.desc("_score"), "unit"))
    return kmers.withColumn("_score", score).withColumn("_rank", rank).where("_rank = 1").drop("_rank", "_score")


def winner_takes_all(kmers: DataFrame) -> DataFrame:
    """By the share of a unit's k-mers that were hit (``kmers`` has one row per unit and hash, and ``m_g``)."""
    return best_holder(kmers, F.count(F.lit(1)).over(Window.partitionBy("unit")) / F.col("m_g"))


def unique_first(kmers: DataFrame) -> DataFrame:
    """By the sum of one over the holders of a unit's hit k-mers, over its rate."""
    return best_holder(kmers, F.sum(1 / F.col("holders")).over(Window.partitionBy("unit")) / F.col("t_g"))


def greedy_coverage(own: DataFrame) -> DataFrame:
    """``unit, coverage`` from owned k-mers alone (``unit, hits, m_g``): the zero-truncated rate, or hits over k-mers where all were hit."""

    def fit(batches):
        for b in batches:
            rate = ztp_rate(b["hits"] / b["kmers"])
            yield pd.DataFrame({"unit": b["unit"], "coverage": np.where(b["kmers"] >= b["m_g"], b["hits"] / b["m_g"], rate)})

    sums = own.groupBy("unit").agg(F.sum("hits").alias("hits"), F.count(F.lit(1)).alias("kmers"), F.first("m_g").alias("m_g"))
    return sums.mapInPandas(fit, "unit long, coverage double")


def q_values(units: DataFrame, prob: str = "present_prob", order: str = "unit") -> DataFrame:
    """``units`` with ``present_q``: the least expected false share, the mean of 1 - P, of the units ranked down to it or further. One row per unit is sorted in one task."""
    rank = Window.orderBy(F.desc(prob), order)
    running = F.avg(1 - F.col(prob)).over(rank.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    back = Window.orderBy(F.desc("_rank"))
    numbered = units.withColumn("_fdr", running).withColumn("_rank", F.row_number().over(rank))
    return numbered.withColumn("present_q", F.min("_fdr").over(back.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_fdr", "_rank")
