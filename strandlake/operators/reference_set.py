"""Reference sequences for called units, and routing of reads to blocks of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kmers import KmerParams, read_kmers, target_kmers
from .lookup import routes


def spread_members(members: DataFrame, units: DataFrame, k: int) -> DataFrame:
    """Per unit of ``units`` up to ``k`` distinct sequences of ``members`` (``unit, unit_key, member_id, sequence``): the representative (the member named as the unit, else the longest, ties to the least id), and of the others those at an even stride by falling length."""
    own = members.join(units.select("unit").distinct(), "unit", "left_semi")
    first = F.row_number().over(Window.partitionBy("unit").orderBy(F.desc(F.col("member_id").cast("string") == F.col("unit_key")), F.desc(F.length("sequence")), "member_id"))
    ranked = own.withColumn("_first", first).withColumn("rep", F.col("_first") == 1)
    once = ranked.withColumn("_copy", F.row_number().over(Window.partitionBy("unit", "sequence").orderBy("_first"))).where("_copy = 1").drop("_copy", "_first")
    order = Window.partitionBy("unit").orderBy(F.desc(F.length("sequence")), "member_id")
    rest = once.where("not rep").withColumn("_i", F.row_number().over(order) - 1).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("unit")))
    # Of n others the ones at which i * (k - 1) / n passes a whole number.
    step = (F.col("_i") + 1) * (k - 1)
    even = (F.col("_n") <= k - 1) | (F.floor(step / F.col("_n")) > F.floor((step - (k - 1)) / F.col("_n")))
    return once.where("rep").unionByName(rest.where(even).drop("_i", "_n"))


def reference_roles(profile: DataFrame, fdr: float, most_targets: int | None = None, neighbours: int = 5) -> DataFrame:
    """``unit, component, role``: targets are units with ``present_q`` up to ``fdr`` (the ``most_targets`` of most hits), neighbours the units of most hits in a component, up to ``neighbours`` times its targets."""
    targets = profile.where(F.col("present_q") <= fdr)
    if most_targets is not None:
        targets = targets.orderBy(F.desc("hits"), "unit").limit(most_targets)
    targets = targets.select("unit", "component")
    room = targets.groupBy("component").agg((F.count(F.lit(1)) * neighbours).alias("_room"))
    others = profile.join(targets, "unit", "left_anti").withColumn("_rank", F.row_number().over(Window.partitionBy("component").orderBy(F.desc("hits"), "unit")))
    others = others.join(room, "component").where(F.col("_rank") <= F.col("_room")).select("unit", "component", F.lit("neighbour").alias("role"))
    return targets.withColumn("role", F.lit("target")).unionByName(others)


def equal_parts(refs: DataFrame, parts: int) -> DataFrame:
    """``refs`` (``seq_id, length``) with ``part``: contiguous in ``seq_id``, of about equal residues."""
    total = F.sum("length").over(Window.orderBy("seq_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    all_ = F.sum("length").over(Window.partitionBy())
    return refs.withColumn("part", F.floor((total - F.col("length")) * parts / all_).cast("int"))


def packed_blocks(refs: DataFrame, residues: int = 2_000_000) -> DataFrame:
    """``component, block``: components in order, a new block once the one before has ``residues``."""
    sizes = refs.groupBy("component").agg(F.sum("length").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("component").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return sizes.select("component", F.floor(before / residues).alias("block"))


def route_reads(reads: DataFrame, refs: DataFrame, p: KmerParams, least: int = 3) -> tuple[DataFrame, DataFrame]:
    """Reads routed to the blocks with which they share ``least`` distinct k-mers (``refs``: ``block, sequence``; ``reads``: ``read, seq``)."""
    blocks = target_kmers(refs, p, ["block"]).distinct()
    return routes(read_kmers(reads, p, ["read"]), blocks, least)


def totals_histogram(totals: DataFrame, edges: tuple[int, ...] = (1, 2, 3, 5, 10, 20, 50)) -> DataFrame:
    """``bin, reads``: the largest of ``edges`` up to a read's total, 0 below."""
    label = F.lit(0)
    for e in edges:
        label = F.when(F.col("total") >= e, F.lit(e)).otherwise(label)
    return totals.groupBy(label.alias("bin")).agg(F.count(F.lit(1)).alias("reads"))
