"""Host masks: k-mers of a genome taken out of an index, and what units lose by it."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kmers import read_kmers
from ..sources.fastx import genome_windows
from .index_build import PIN_LEVELS, KmerIndex


def masked_hashes(genome: DataFrame, index: KmerIndex, window: int = 10_000) -> DataFrame:
    """Distinct posted hashes in all six frames of a genome (``name, seq``), cut into windows that overlap by a k-mer's span less one."""
    p = index.params.kmers()
    pieces = genome_windows(genome, window, index.params.span - 1)
    found = read_kmers(pieces, replace(p, frames="all"), ["name"]).select("hash").distinct()
    return found.join(index.postings.select("hash").distinct(), "hash", "left_semi")


def decrements(postings: DataFrame, mask: DataFrame) -> DataFrame:
    """``unit, masked, masked_pin_sum, masked_hist``: a unit's masked postings, the sum of their levels' shares and their count by level."""
    held = postings.join(mask, "hash", "left_semi")
    each = held.groupBy("unit").agg(F.count(F.lit(1)).alias("masked"), (F.sum("pin_q") / (PIN_LEVELS - 1)).alias("masked_pin_sum"), *(F.count_if(F.col("pin_q") == i).cast("int").alias(f"_h{i}") for i in range(PIN_LEVELS)))
    return each.select("unit", "masked", "masked_pin_sum", F.array(*(f"_h{i}" for i in range(PIN_LEVELS))).alias("masked_hist"))


def apply_mask(index: KmerIndex, mask: DataFrame, host_like: float = 0.5) -> KmerIndex:
    """The index without the masked k-mers: postings by an anti join, and units with ``m_g``, ``pin_sum`` and ``pin_hist`` less what they lost (not below 0), ``masked_fraction`` and ``host_like``."""
    lost = decrements(index.postings, mask)
    units = index.units.join(lost, "unit", "left")
    n = F.coalesce("masked", F.lit(0))
    share = F.when(F.col("m_g") > 0, n / F.col("m_g")).otherwise(0.0)
    units = units.withColumns(
        {
            "masked_fraction": share,
            "host_like": share > host_like,
            "pin_sum": F.greatest(F.col("pin_sum") - F.coalesce("masked_pin_sum", F.lit(0.0)), F.lit(0.0)),
            "pin_hist": F.when(F.col("masked_hist").isNull(), F.col("pin_hist")).otherwise(F.zip_with("pin_hist", "masked_hist", lambda a, b: F.greatest(a - b, F.lit(0)))),
            "m_g": F.greatest(F.col("m_g") - n, F.lit(0)),
        }
    ).drop("masked", "masked_pin_sum", "masked_hist")
    dense = index.dense.join(mask, "hash", "left_anti") if index.dense is not None else None
    return replace(index, units=units, postings=index.postings.join(mask, "hash", "left_anti"), dense=dense)
