"""Functions by genomes: shares of read pairs in both, rolled up the ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNCLASSIFIED = "unclassified"


def function_weights(assignments: DataFrame) -> DataFrame:
    """``pair, unit, w``: posteriors of each mate's target alignments shared out to one, averaged over mates (``pair, mate, unit, role, posterior``)."""
    on = assignments.where("role = 'target'").groupBy("pair", "mate", "unit").agg(F.sum("posterior").alias("w"))
    on = on.withColumn("w", F.col("w") / F.sum("w").over(Window.partitionBy("pair", "mate")))
    sums = on.groupBy("pair", "unit").agg(F.sum("w").alias("w"))
    return sums.withColumn("w", F.col("w") / F.sum("w").over(Window.partitionBy("pair")))


def genome_weights(hits: DataFrame, contigs: DataFrame, least_identity: float = 0.95, least_mapq: int = 0) -> DataFrame:
    """``pair, genome, w, bases``: of each mate's best alignment on every genome, the genomes with most mates and then the highest score, in equal shares."""
    good = hits.where((F.col("flag").bitwiseAND(4) == 0) & (F.col("mapq") >= least_mapq) & (1 - F.try_divide("mismatches", "aligned") >= least_identity)).join(contigs.select("contig", "genome"), "contig")
    good = good.withColumn("mate", F.col("flag").bitwiseAND(128) > 0)
    best = good.groupBy("pair", "mate", "genome").agg(F.max(F.struct("score", "aligned")).alias("b"))
    sums = best.groupBy("pair", "genome").agg(F.count(F.lit(1)).alias("mates"), F.sum("b.score").alias("score"), F.sum("b.aligned").alias("aligned"))
    pair = Window.partitionBy("pair")
    top = sums.withColumn("_top", F.max(F.struct("mates", "score")).over(pair)).where((F.col("mates") == F.col("_top.mates")) & (F.col("score") == F.col("_top.score")))
    return top.select("pair", "genome", (1 / F.count(F.lit(1)).over(pair)).alias("w"), F.col("aligned").cast("double").alias("bases"))


def cross_reference(functions: DataFrame, genomes: DataFrame, contigs: DataFrame, unit_lengths: DataFrame, ranks: dict[str, Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """Two tables: ``unit, rank, taxon, reads, share, coverage, copies`` and ``rank, taxon, reads, function_reads, length, depth``.

    ``ranks`` maps a rank to its taxon, a column over ``genome``'s table ``contigs`` (``contig, genome, length`` and what the
    columns need); pairs on no genome, and genomes without a rank, are unclassified. All ranks are one explode of the
    joined weights, not a pass for each.
    """
    ranks = {"genome": F.col("genome"), **(ranks or {})}
    taxa = F.array(*(F.struct(F.lit(n).alias("rank"), F.coalesce(c, F.lit(UNCLASSIFIED)).alias("taxon")) for n, c in ranks.items()))
    nowhere = F.array(*(F.struct(F.lit(n).alias("rank"), F.lit(UNCLASSIFIED).alias("taxon")) for n in ranks))
    known = contigs.withColumn("taxa", taxa).groupBy("genome").agg(F.sum("length").alias("length"), F.first("taxa").alias("taxa"))
    joined = functions.withColumnRenamed("w", "fw").join(genomes, "pair", "left").join(known.select("genome", "taxa"), "genome", "left")
    joined = joined.select("unit", (F.col("fw") * F.coalesce("w", F.lit(1.0))).alias("w"), F.explode(F.coalesce("taxa", nowhere)).alias("t")).select("unit", "w", "t.rank", "t.taxon")
    reads = genomes.groupBy("genome").agg(F.sum("w").alias("reads"), F.sum(F.col("w") * F.col("bases")).alias("bases"))
    depth = known.join(reads, "genome", "left").withColumn("t", F.explode("taxa")).groupBy("t.rank", "t.taxon").agg(F.sum(F.coalesce("reads", F.lit(0.0))).alias("reads"), F.sum("length").alias("length"), F.sum(F.coalesce("bases", F.lit(0.0))).alias("bases"))
    own = joined.groupBy("rank", "taxon").agg(F.sum("w").alias("function_reads"))
    depth = depth.join(own, ["rank", "taxon"], "left").select("rank", "taxon", "reads", F.coalesce("function_reads", F.lit(0.0)).alias("function_reads"), "length", (F.col("bases") / F.col("length")).alias("depth"))
    per_pair = genomes.agg((F.sum(F.col("w") * F.col("bases")) / F.count_distinct("pair")).alias("per_pair"))  # one row
    out = joined.groupBy("unit", "rank", "taxon").agg(F.sum("w").alias("reads")).join(depth.select("rank", "taxon", "depth"), ["rank", "taxon"], "left").join(unit_lengths, "unit", "left").crossJoin(F.broadcast(per_pair))
    out = out.withColumn("share", F.col("reads") / F.sum("reads").over(Window.partitionBy("unit", "rank"))).withColumn("coverage", F.col("reads") * F.col("per_pair") / F.col("unit_length"))
    copies = F.when((F.col("taxon") != UNCLASSIFIED) & (F.col("depth") > 0), F.col("coverage") / F.col("depth"))
    return out.select("unit", "rank", "taxon", "reads", "share", "coverage", copies.alias("copies")), depth
