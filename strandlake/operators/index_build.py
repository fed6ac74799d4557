"""Building an inverted index of sampled k-mers over groups ("units") of target sequences.

Targets come as ``unit_key, member_id, full_length, sequence``. Everything is DataFrame operations over one stored table of
distinct (unit, member, hash) rows; only the k-mers themselves come from an Arrow function.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kmers import ALL, KmerParams, bound, ordered_bound, target_kmers, unsigned
from ..functions.sequences import mask_adapters
from ..lineage import cut
from .graph import dense_ids

PIN_LEVELS = 16


@dataclass(frozen=True)
class IndexParams:
    """``t_base``: rate at which every unit is sampled; ``t_base_singleton``: the same for units of one member (None: alike). Units of several members are sampled at up to ``t_cap``, so that ``oversample * n_min`` k-mers are expected, of which the ``n_min`` best are kept. K-mers of more than ``max_groups`` units are promiscuous. ``t_dense``: rate of the dense tier, None for none."""

    k: int = 11
    alphabet: str = "protein"
    t_base: float = 0.01
    t_base_singleton: float | None = None
    n_min: int = 50
    t_cap: float = 0.5
    oversample: float = 2.0
    max_groups: int = 1000
    mask_adapters: bool = True
    t_dense: float | None = None

    @property
    def singleton_rate(self) -> float:
        return self.t_base if self.t_base_singleton is None else self.t_base_singleton

    @property
    def base_rate(self) -> float:
        """The rate under which the index holds every unit's k-mers."""
        return min(self.t_base, self.singleton_rate)

    @property
    def molecule(self) -> str:
        return "nucleotide" if self.alphabet == "dna" else "protein"

    @property
    def span(self) -> int:
        """Nucleotides that one k-mer covers."""
        return self.k if self.molecule == "nucleotide" else 3 * self.k

    def kmers(self, rate: float = 1.0) -> KmerParams:
        return KmerParams(self.k, self.alphabet, bound=bound(rate) if rate < 1 else ALL)


def number_members(targets: DataFrame) -> DataFrame:
    """``targets`` with ``unit`` (dense, in the order of ``unit_key``) and ``counts``: whether the member counts for its unit, as full-length members do, or all where there is none."""
    units = dense_ids(targets.select("unit_key").distinct(), ["unit_key"], "unit")
    whole = targets.groupBy("unit_key").agg(F.max("full_length").alias("_any"))
    numbered = targets.join(units.join(whole, "unit_key"), "unit_key")
    return numbered.withColumn("counts", F.col("full_length") | ~F.col("_any")).withColumn("length", F.octet_length("sequence")).drop("_any")


def masked_targets(targets: DataFrame, p: IndexParams) -> DataFrame:
    """Adapter peptides of protein targets as X."""
    return targets.withColumn("sequence", mask_adapters(F.col("sequence"))) if p.mask_adapters and p.molecule == "protein" else targets


def member_kmers(members: DataFrame, p: IndexParams, rate: float = 1.0) -> DataFrame:
    """Distinct ``unit, member_id, counts, hash`` at a rate."""
    return target_kmers(members, p.kmers(rate), ["unit", "member_id", "counts"]).distinct()


def unit_rates(p: IndexParams) -> Column:
    """The sampling rate of a unit from ``n_members`` and ``n_kmers``."""
    raised = F.least(F.lit(p.t_cap), F.lit(p.oversample * p.n_min) / F.col("n_kmers"))
    return F.least(F.when(F.col("n_members") > 1, F.greatest(F.lit(p.t_base), F.coalesce(raised, F.lit(p.t_cap)))).otherwise(F.lit(p.singleton_rate)), F.lit(1.0))


def unit_table(members: DataFrame, kmers: DataFrame, p: IndexParams) -> DataFrame:
    """One row per unit: ``unit, unit_key, n_members, n_full_length, n_counting, len_mean, n_kmers, t_g, bound_g`` (the last in the order of ``unsigned``)."""
    n_kmers = kmers.select("unit", "hash").distinct().groupBy("unit").agg(F.count(F.lit(1)).alias("n_kmers"))
    units = members.groupBy("unit").agg(
        F.min("unit_key").alias("unit_key"),
        F.count(F.lit(1)).alias("n_members"),
        F.count_if("full_length").alias("n_full_length"),
        F.count_if("counts").alias("n_counting"),
        F.avg(F.when(F.col("counts"), F.col("length"))).alias("len_mean"),
    )
    units = units.join(n_kmers, "unit", "left").withColumn("n_kmers", F.coalesce("n_kmers", F.lit(0)))
    return units.withColumn("t_g", unit_rates(p)).withColumn("bound_g", ordered_bound(F.col("t_g")))


def presence(kmers: DataFrame) -> DataFrame:
    """``hash, unit, c, n_groups``: counting members that hold a k-mer, and units that do."""
    held = kmers.groupBy("hash", "unit").agg(F.count_if("counts").alias("c"))
    groups = held.groupBy("hash").agg(F.count(F.lit(1)).alias("n_groups"))
    return held.join(groups, "hash")


def share_in_unit() -> Column:
    """Share of a unit's counting members with a k-mer; one seen only in others counts as half a member."""
    return F.greatest(F.col("c").cast("double"), F.lit(0.5)) / F.col("n_counting")


def scored_candidates(present: DataFrame, units: DataFrame) -> DataFrame:
    """Candidates under their unit's bound: ``hash, unit, p_in, pin_q, n_groups, score``."""
    rows = present.join(units.select("unit", "n_counting", "bound_g"), "unit").where(unsigned("hash") <= F.col("bound_g"))
    rows = rows.withColumn("p_in", share_in_unit())
    # Halves are rounded away from zero.
    level = F.floor(F.col("p_in") * (PIN_LEVELS - 1) + 0.5).cast("int")
    return rows.select("hash", "unit", "p_in", level.alias("pin_q"), "n_groups", F.log2(F.col("p_in") / F.col("n_groups")).alias("score"))


def select_postings(scored: DataFrame, units: DataFrame, p: IndexParams) -> DataFrame:
    """Candidates that are kept: those not promiscuous that are among the ``n_min`` best of a unit with a raised rate, or in the base stratum, or of another unit."""
    raised = units.select("unit", ((F.col("n_members") > 1) & (F.col("t_g") > p.t_base)).alias("raised"))
    rank = F.row_number().over(Window.partitionBy("unit").orderBy(F.desc("score"), unsigned("hash")))
    ranked = scored.where(F.col("n_groups") <= p.max_groups).join(raised, "unit").withColumn("_rank", rank)
    return ranked.where(~F.col("raised") | (F.col("_rank") <= p.n_min) | (unsigned("hash") <= ordered_bound(F.lit(p.t_base)))).drop("raised", "_rank")


def promiscuous_base(scored: DataFrame, p: IndexParams) -> DataFrame:
    """Distinct promiscuous hashes of the base stratum."""
    return scored.where((F.col("n_groups") > p.max_groups) & (unsigned("hash") <= ordered_bound(F.lit(p.base_rate)))).select("hash").distinct()


def pin_columns(postings: DataFrame) -> DataFrame:
    """``unit, m_g, pin_sum, pin_hist``: postings of a unit, the sum of their shares, and how many have each of 16 levels."""
    each = postings.groupBy("unit").agg(
        F.count(F.lit(1)).alias("m_g"),
        F.sum("p_in").alias("pin_sum"),
        *(F.count_if(F.col("pin_q") == i).alias(f"_h{i}") for i in range(PIN_LEVELS)),
    )
    return each.select("unit", "m_g", "pin_sum", F.array(*(F.col(f"_h{i}").cast("int") for i in range(PIN_LEVELS))).alias("pin_hist"))


def length_variation(kmers: DataFrame, postings: DataFrame, members: DataFrame) -> DataFrame:
    """``unit, len_cv``: over a unit's counting members, the population deviation over the mean of how many kept k-mers each holds; 0 if none holds any."""
    held = kmers.where("counts").join(postings.select("unit", "hash"), ["unit", "hash"], "left_semi").groupBy("unit", "member_id").agg(F.count(F.lit(1)).alias("kept"))
    n = members.where("counts").select("unit", "member_id").join(held, ["unit", "member_id"], "left").withColumn("kept", F.coalesce("kept", F.lit(0)))
    mean = F.avg("kept")
    return n.groupBy("unit").agg(F.when(mean > 0, F.stddev_pop("kept") / mean).otherwise(0.0).alias("len_cv"))


def dense_rows(present: DataFrame, units: DataFrame, p: IndexParams) -> DataFrame:
    """Every k-mer under the larger of a unit's bound and the dense rate that is not promiscuous: ``hash, unit, p_in, pin_q``."""
    bounds = units.select("unit", "n_counting", F.greatest(F.col("bound_g"), ordered_bound(F.lit(float(p.t_dense or 0)))).alias("bound_dense"))
    rows = present.where(F.col("n_groups") <= p.max_groups).join(bounds, "unit").where(unsigned("hash") <= F.col("bound_dense")).withColumn("p_in", share_in_unit())
    return rows.select("hash", "unit", "p_in", F.floor(F.col("p_in") * (PIN_LEVELS - 1) + 0.5).cast("int").alias("pin_q"))


@dataclass
class KmerIndex:
    """The tables of an index. ``postings``: ``hash, unit, p_in, pin_q, n_groups, score``."""

    params: IndexParams
    units: DataFrame
    postings: DataFrame
    promiscuous: DataFrame
    dense: DataFrame | None = None


def build_index(targets: DataFrame, p: IndexParams) -> KmerIndex:
    """The whole build. Units without a posting are dropped and the rest numbered anew."""
    members = cut(number_members(masked_targets(targets, p)))
    kmers = cut(member_kmers(members, p))
    units = cut(unit_table(members.drop("sequence"), kmers, p))
    present = cut(presence(kmers))
    scored = scored_candidates(present, units)
    postings = cut(select_postings(scored, units, p))
    numbers = dense_ids(postings.select("unit").distinct(), ["unit"], "_new")
    renumber = lambda df: df.join(numbers, "unit").withColumn("unit", F.col("_new")).drop("_new")
    whole = units.join(pin_columns(postings), "unit").join(length_variation(kmers, postings, members), "unit", "left")
    dense = cut(renumber(dense_rows(present, units, p))) if p.t_dense else None
    return KmerIndex(p, cut(renumber(whole)), cut(renumber(postings)), cut(promiscuous_base(scored, p)), dense)


def holder_sets(postings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The normalised form of the postings: ``hash, set_id`` and ``set_id, holders``, equal sets of (unit, level) once."""
    by_hash = postings.groupBy("hash").agg(F.sort_array(F.collect_list(F.struct("unit", "pin_q"))).alias("holders"))
    by_hash = cut(by_hash.withColumn("s1", F.xxhash64("holders")).withColumn("s2", F.xxhash64(F.lit(1), "holders")))
    sets = by_hash.groupBy("s1", "s2").agg(F.first("holders").alias("holders"))
    ids = dense_ids(sets.select("s1", "s2"), ["s1", "s2"], "set_id")
    return by_hash.join(ids, ["s1", "s2"]).select("hash", "set_id"), sets.join(ids, ["s1", "s2"]).select("set_id", "holders")


def predicted_cost(units: DataFrame, present: DataFrame, p: IndexParams) -> DataFrame:
    """One row: candidates and postings expected of these parameters, and the table's bytes at 12 a posting."""
    counts = units.agg(
        F.sum(F.col("t_g") * F.col("n_kmers")).alias("candidates"),
        F.sum(F.when((F.col("n_members") > 1) & (F.col("t_g") > p.t_base), F.least(F.lit(float(p.n_min)), F.col("t_g") * F.col("n_kmers")) + F.lit(p.t_base) * F.col("n_kmers")).otherwise(F.col("t_g") * F.col("n_kmers"))).alias("postings"),
    )
    return counts.withColumn("bytes", F.col("postings") * 12)


def groups_histogram(present: DataFrame) -> DataFrame:
    """``n_groups, kmers``."""
    return present.select("hash", "n_groups").distinct().groupBy("n_groups").agg(F.count(F.lit(1)).alias("kmers"))


def with_params(index: KmerIndex, **changes) -> KmerIndex:
    return replace(index, params=replace(index.params, **changes))
