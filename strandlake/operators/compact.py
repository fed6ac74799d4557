"""A compact index: k-mers by the rank of their letters, few keys per unit from its representative, and evidence in bits."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kmers import KmerParams, hashes_in_pieces, mix, text_slices, unmix, unsigned
from ..lineage import cut
from .layers import least_keys, unit_budgets


def codes(hashes: np.ndarray, p: KmerParams) -> np.ndarray:
    """The rank of each hashed k-mer among all k-mers of its alphabet: the hash undone, its letters read as digits. Dense, and no two k-mers share one."""
    packed, out = unmix(hashes), np.zeros(len(hashes), np.uint64)
    bits, base = p.letters.bits, len(p.letters.classes)
    mask = np.uint64((1 << bits) - 1)
    for place in reversed(range(p.k)):
        out = out * np.uint64(base) + (packed >> np.uint64(bits * place) & mask)
    return out


def hashes_of(ranks: np.ndarray, p: KmerParams) -> np.ndarray:
    """The hashes that ``codes`` makes ``ranks`` of."""
    left, packed = ranks.astype(np.uint64), np.zeros(len(ranks), np.uint64)
    base = np.uint64(len(p.letters.classes))
    for place in range(p.k):
        packed |= left % base << np.uint64(p.letters.bits * place)
        left = left // base
    return mix(packed)


def code_of(hash_: Column | str, p: KmerParams) -> Column:
    """``codes`` of a column of hashes, as a long; alphabets and lengths whose ranks pass 63 bits are refused."""
    if len(p.letters.classes) ** p.k > 1 << 63:
        raise ValueError(f"ranks of {p.k} letters of {p.name} do not fit a long")

    def rank(h: pd.Series) -> pd.Series:
        return pd.Series(codes(h.to_numpy(np.int64).view(np.uint64), p).view(np.int64))

    return F.pandas_udf(rank, "long")(hash_)


def unit_representatives(members: DataFrame) -> DataFrame:
    """``unit, rep, sequence, members``: the member that bears its unit's name, else the longest, ties to the least id (``members``: ``unit, id, sequence``). A null sequence is empty."""
    sequence = F.coalesce("sequence", F.lit(""))
    order = F.struct((~F.col("id").eqNullSafe(F.col("unit"))).alias("other"), (-F.octet_length(sequence)).alias("l"), F.col("id").alias("id"), sequence.alias("sequence"))
    best = members.groupBy("unit").agg(F.min(order).alias("b"), F.count(F.lit(1)).alias("members"))
    return best.select("unit", F.col("b.id").alias("rep"), F.col("b.sequence").alias("sequence"), "members")


def kmer_places(reps: DataFrame, p: KmerParams) -> DataFrame:
    """``unit, n, hash, places, first``: each distinct k-mer of a sequence with where it begins, and how many places the sequence has (``reps``: ``unit, sequence``). A sequence over ``TEXT`` bytes comes in pieces; ``first`` marks one row for each of its k-mers."""
    from pyspark.sql.types import StructType

    schema = StructType([reps.schema["unit"]] + StructType.fromDDL("n int, hash long, places array<int>, first boolean").fields)

    def find(batches):
        import pyarrow as pa

        for batch in (x for b in batches for x in text_slices(b)):
            seqs = [s or b"" for s in batch.column(1).cast(pa.binary()).to_pylist()]
            sizes = np.array([len(s) - p.k + 1 for s in seqs], np.int32)
            before = np.zeros(0, np.uint64)
            for which, pos, h in hashes_in_pieces(seqs, p):
                order = np.lexsort((pos, h, which))
                which, pos, h = which[order], pos[order], h[order]
                new = np.flatnonzero(np.r_[True, (which[1:] != which[:-1]) | (h[1:] != h[:-1])]) if len(h) else np.zeros(0, np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[new, len(h)].astype(np.int32)), pa.array(pos.astype(np.int32)))
                first = ~np.isin(h[new], before)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(which[new])), pa.array(sizes[which[new]]), pa.array(h[new].view(np.int64)), lists, pa.array(first)], schema.names)
                if len(seqs) == 1:  # only then are there more pieces
                    before = np.union1d(before, h)

    return reps.select("unit", "sequence").mapInArrow(find, schema)


def rarest_in_windows(reps: DataFrame, p: KmerParams, window: int) -> DataFrame:
    """Distinct ``unit, hash``: of every ``window`` consecutive k-mers of a representative the one that fewest representatives hold, ties to the least hash; shorter sequences are one window (``reps``: ``unit, sequence``, a row a unit).

    Windows are Spark's, over the places of one sequence. Places without a k-mer of valid letters begin windows too, but
    have no rows: what any window holds is what one holds that begins at a k-mer, begins right after one, ends at one, or
    is the first or last. A k-mer's places travel as one list, and are parted only where they have been dealt by unit.
    Holders are counted with partial sums, so that a k-mer of all representatives is no hot group.
    """
    found = cut(kmer_places(reps, p))
    holders = found.groupBy("hash").agg(F.count_if("first").alias("c"))
    dealt = found.join(holders, "hash").select("unit", "n", "c", "hash", "places").repartition("unit")
    rows = dealt.select("unit", "n", F.struct("c", unsigned("hash").alias("order"), "hash").alias("key"), F.explode("places").alias("pos"))
    along, all_of = Window.partitionBy("unit").orderBy("pos"), Window.partitionBy("unit")
    least = lambda low, high: F.min("key").over(along.rangeBetween(low, high))
    last = F.col("n") - window  # where the last window begins
    winners = F.array(
        F.when(F.col("pos") <= last, least(0, window - 1)),
        F.when(F.col("pos") < last, least(1, window)),
        F.when(F.col("pos") >= window - 1, least(1 - window, 0)),
        F.when(F.row_number().over(along) == 1, F.min(F.when(F.col("pos") < window, F.col("key"))).over(all_of)),
        F.when(F.row_number().over(along) == 1, F.min(F.when(F.col("pos") >= last, F.col("key"))).over(all_of)),
    )
    return rows.select("unit", winners.alias("winners")).select("unit", F.explode(F.array_distinct("winners")).alias("key")).where("key is not null").select("unit", F.col("key.hash").alias("hash")).distinct()


def residue_bits(sequences: DataFrame, p: KmerParams) -> list[float]:
    """Minus the binary logarithm of each class's share of all residues of ``sequence``; a class that never comes counts a billionth. One row of sums reaches the driver."""
    size = F.octet_length("sequence")
    sums = [F.sum(size - F.octet_length(F.translate("sequence", c + c.lower(), ""))) for c in p.letters.classes]
    *found, total = sequences.agg(*sums, F.sum(size)).first()
    return [float(-np.log2(((n or 0) + 1e-9) / ((total or 0) + 1e-9 * len(found)))) for n in found]


def code_bits(code: Column | str, residues: list[float], k: int) -> Column:
    """The bits of a k-mer that is made by drawing its residues: their sum over the digits of its rank, last letter first."""
    code, base = F.col(code) if isinstance(code, str) else code, len(residues)
    values = F.array(*(F.lit(x) for x in residues))
    total = F.lit(0.0)
    for place in range(k):
        digit = F.call_function("div", code, F.lit(base**place)) % base
        total = total + F.element_at(values, (digit + 1).cast("int"))
    return total


def compact_keys(members: DataFrame, p: KmerParams, window: int, rate: float, rounding: Column | None = None) -> DataFrame:
    """``unit, code, bits0``: the keys of each unit's representative, thinned to budgets by the square root of its members.

    On average a unit keeps its representative's k-mers over ``rate``; what small ones lack goes to the others. Kept are the
    least hashes (see ``layers.unit_budgets`` and ``layers.least_keys``).
    """
    reps = cut(unit_representatives(members))
    keys = cut(rarest_in_windows(reps, p, window))
    mean = reps.agg(F.avg(F.greatest(F.octet_length("sequence") - p.k + 1, F.lit(1)))).first()[0]
    if mean is None:
        return keys.select("unit", F.lit(0).cast("long").alias("code"), F.lit(0.0).alias("bits0"))
    kept = least_keys(keys, cut(unit_budgets(keys, reps.select("unit", "members"), "sqrt", mean / rate, rounding)))
    coded = kept.select("unit", code_of("hash", p).alias("code"))
    return coded.withColumn("bits0", code_bits("code", residue_bits(reps, p), p.k))


def merge_shards(parts: DataFrame, sizes: DataFrame, step: float | None = 0.25) -> DataFrame:
    """``code, unit, bits`` of shards whose units count from 0 each: units follow those of the shards before, keys are sorted by code in ranges (``parts``: ``shard, unit, code, bits0``; ``sizes``: ``shard, units``, one row a shard).

    A key's bits are those of its residues less the binary logarithm of the units that hold it, in multiples of ``step``
    from 0 to 255 (None: as they are). Shards without keys count too. The table of shards is the only one that is put
    in one order.
    """
    before = F.coalesce(F.sum("units").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    moved = parts.join(sizes.select("shard", before.alias("_base")), "shard").select("code", (F.col("unit") + F.col("_base")).cast("long").alias("unit"), "bits0")
    holders = moved.groupBy("code").agg(F.count(F.lit(1)).alias("_n"))
    bits = F.col("bits0") - F.log2(F.col("_n").cast("double"))
    if step is not None:
        bits = F.least(F.greatest(F.bround(bits / step), F.lit(0.0)), F.lit(255.0)) * step
    return moved.join(holders, "code").select("code", "unit", bits.alias("bits")).repartitionByRange("code", "unit").sortWithinPartitions("code", "unit")


def unit_evidence_bits(read_codes: DataFrame, postings: DataFrame) -> DataFrame:
    """``read, unit, hits, score``: the bits of a read's distinct keys on a unit, less the logarithm of windows per read for each beyond the first (``read_codes``: ``read, code``, a row a window; ``postings``: ``code, unit, bits``).

    Windows per read, at least 2, count every row and every read that has one. The join makes one row for each hit.
    """
    rows = cut(read_codes.select("read", "code"))
    windows, reads = rows.agg(F.count(F.lit(1)), F.count_distinct("read")).first()
    charge = float(np.log2(max(windows / max(reads, 1), 2)))
    found = rows.distinct().join(postings, "code").groupBy("read", "unit").agg(F.count(F.lit(1)).alias("hits"), F.sum("bits").alias("bits"))
    return found.select("read", "unit", "hits", (F.col("bits") - (F.col("hits") - 1) * charge).alias("score"))
