"""Looking reads up in an index, and what is summed from their hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kmers import ordered_bound, unsigned
from ..lineage import cut
from .index_build import KmerIndex


def unit_hits(reads: DataFrame, index: KmerIndex, tier: DataFrame | None = None) -> DataFrame:
    """``read, hash, unit, pin_q`` for every unit that holds a read's k-mer under its own bound; k-mers meet postings in one join on the hash."""
    held = (tier if tier is not None else index.postings).join(index.units.select("unit", "bound_g"), "unit")
    return reads.select("read", "hash").join(held.where(unsigned("hash") <= F.col("bound_g")).select("hash", "unit", "pin_q"), "hash")


def parted_tier(dense: DataFrame, units: DataFrame, path: str, parts: int = 64) -> DataFrame:
    """The dense tier written to ``path`` in folders of consecutive units (``part``), sorted by hash in each, and read back: a lookup for some units reads their folders only, and of these the row groups around its hashes."""
    n = F.broadcast(units.agg(F.greatest(F.max("unit") + 1, F.lit(1)).alias("_units")))  # one row
    part = F.floor(F.col("unit") * parts / F.col("_units")).cast("int")
    rows = dense.crossJoin(n).withColumn("part", part).drop("_units")
    rows.repartition("part").sortWithinPartitions("part", "hash").write.mode("overwrite").partitionBy("part").parquet(path)
    return dense.sparkSession.read.schema(rows.schema).parquet(path)


def tiered_hits(reads: DataFrame, index: KmerIndex, dense: DataFrame, least: int = 1, parts: int = 64) -> DataFrame:
    """``read, hash, unit, pin_q`` in the dense tier for units of which the standard tier hits ``least`` distinct k-mers.

    The standard tier, which is small, says which units are there; only then is the dense one read, in the folders of
    those units (``dense`` as ``parted_tier`` gives it), where their rows meet the reads' distinct hashes before the reads
    themselves. At most ``parts`` numbers of folders reach the driver. Units without a name or bound of their own are
    never resolved row by row: join the units' table to what is summed up.
    """
    found = unit_hits(reads, index).select("unit", "hash").distinct().groupBy("unit").agg(F.count(F.lit(1)).alias("_n"))
    found = cut(found.where(F.col("_n") >= least).select("unit"))
    n = index.units.agg(F.greatest(F.max("unit") + 1, F.lit(1)).alias("_units"))
    folders = found.crossJoin(F.broadcast(n)).select(F.floor(F.col("unit") * parts / F.col("_units")).cast("int").alias("part")).distinct()
    chosen = sorted(r["part"] for r in folders.collect())
    keys = reads.select("hash").distinct()
    rows = dense.where(F.col("part").isin(chosen) if chosen else F.lit(False)).join(found, "unit", "left_semi").join(keys, "hash", "left_semi")
    return reads.select("read", "hash").join(rows.select("hash", "unit", "pin_q"), "hash")


def kmer_hits(hits: DataFrame) -> DataFrame:
    """``hash, unit, pin_q, hits, holders``: how often a posting was hit, and how many units share the k-mer."""
    each = hits.groupBy("hash", "unit").agg(F.first("pin_q").alias("pin_q"), F.count(F.lit(1)).alias("hits"))
    holders = each.groupBy("hash").agg(F.count(F.lit(1)).alias("holders"))
    return each.join(holders, "hash")


def unit_sums(kmer_hits_: DataFrame, hits: DataFrame, index: KmerIndex) -> DataFrame:
    """``unit, kmers_hit, hits, own_kmers, reads, containment``."""
    sums = kmer_hits_.groupBy("unit").agg(F.count(F.lit(1)).alias("kmers_hit"), F.sum("hits").alias("hits"), F.count_if(F.col("holders") == 1).alias("own_kmers"))
    reads = hits.select("unit", "read").distinct().groupBy("unit").agg(F.count(F.lit(1)).alias("reads"))
    units = index.units.select("unit", "unit_key", "m_g", "t_g")
    return sums.join(reads, "unit").join(units, "unit").withColumn("containment", F.col("kmers_hit") / F.col("m_g"))


def reads_histogram(hits: DataFrame) -> DataFrame:
    """``n_hits, reads``: how many reads have how many hits."""
    return hits.groupBy("read").agg(F.count(F.lit(1)).alias("n_hits")).groupBy("n_hits").agg(F.count(F.lit(1)).alias("reads"))


def distinct_estimate(reads: DataFrame, of: int = 256) -> DataFrame:
    """``sampled, estimate`` of the distinct hashes, from those in the first ``of``-th of hash space."""
    part = reads.where(unsigned("hash") <= ordered_bound(F.lit(1.0 / of))).select("hash").distinct()
    return part.agg(F.count(F.lit(1)).alias("sampled")).withColumn("estimate", F.col("sampled") * of)


def census(reads: DataFrame, index: KmerIndex) -> DataFrame:
    """One row, ``kmers, known``: k-mers under the base rate from mates that have sampled k-mers in just one frame, and how many of them are posted or promiscuous. Reads: ``read, mate, frame, hash``."""
    frames = F.size(F.collect_set("frame").over(Window.partitionBy("read", "mate")))
    own = reads.where(unsigned("hash") <= ordered_bound(F.lit(index.params.base_rate))).withColumn("_n", frames).where("_n = 1")
    known = index.postings.select("hash").unionByName(index.promiscuous.select("hash")).distinct().withColumn("known", F.lit(1))
    return own.join(known, "hash", "left").agg(F.count(F.lit(1)).alias("kmers"), F.count("known").alias("known"))


def thinning(bases: int, lost: int, errors: float, span: int, translated: bool) -> float:
    """Share of k-mers that lost bases and base errors leave whole; of errors in codons a quarter is taken to be silent."""
    if not bases:
        return 1.0
    return (1 - min((lost + (0.75 if translated else 1.0) * errors) / bases, 1.0)) ** span


def sample_summary(bases: DataFrame, census_: DataFrame, index: KmerIndex) -> DataFrame:
    """One row: bases, the share left by thinning, and the containment of the sample's k-mers, capped at 1."""
    translated = index.params.molecule == "protein"
    bad = F.least((F.col("lost") + F.lit(0.75 if translated else 1.0) * F.col("errors")) / F.col("bases"), F.lit(1.0))
    both = bases.crossJoin(census_)  # a row each
    return both.withColumn("r", F.pow(1 - bad, F.lit(index.params.span))).withColumn("containment", F.least(F.col("known") / F.col("kmers") / F.col("r"), F.lit(1.0)))


def joint_hits(first: DataFrame, second: DataFrame, offset: int) -> DataFrame:
    """The k-mer hits of two indexes as one: the second's units are shifted by ``offset`` and holders counted over both."""
    both = first.drop("holders").unionByName(second.drop("holders").withColumn("unit", F.col("unit") + offset))
    return both.join(both.groupBy("hash").agg(F.count(F.lit(1)).alias("holders")), "hash")


def routes(reads: DataFrame, blocks: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """``read, block, shared`` with at least ``least`` distinct shared k-mers (``blocks``: ``hash, block``), and ``read, total`` of distinct k-mers."""
    own = reads.select("read", "hash").distinct()
    shared = own.join(blocks.select("hash", "block").distinct(), "hash").groupBy("read", "block").agg(F.count(F.lit(1)).alias("shared"))
    return shared.where(F.col("shared") >= least), own.groupBy("read").agg(F.count(F.lit(1)).alias("total"))


def by_bins(value: Column, edges: list[float]) -> Column:
    """The number of edges not above a value: 0 below the first, open above the last."""
    return sum(((value >= F.lit(e)).cast("int") for e in edges), F.lit(0))
