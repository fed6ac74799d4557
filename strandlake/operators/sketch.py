"""Sketches and clusters: blocked Bloom filters as tables, another tool's hashes, clustering by shared minimal k-mers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.alphabets import alphabet
from ..functions.kmers import KmerParams, target_kmers, unsigned
from ..lineage import cut
from .align import identities

C1, C2 = np.uint64(0x87C37B91114253D5), np.uint64(0x4CF5AD432745937F)


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _final(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def murmur64(words: np.ndarray, seed: int = 42) -> np.ndarray:
    """The low half of MurmurHash3 x64 128 of each row of a matrix of bytes."""
    n, length = words.shape
    h1 = h2 = np.full(n, seed, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, length // 16 * 16, 16):
            k1, k2 = (np.ascontiguousarray(words[:, at + o : at + o + 8]).view("<u8").ravel() for o in (0, 8))
            h1 = h1 ^ _rotl(k1 * C1, 31) * C2
            h1 = (_rotl(h1, 27) + h2) * np.uint64(5) + np.uint64(0x52DCE729)
            h2 = h2 ^ _rotl(k2 * C2, 33) * C1
            h2 = (_rotl(h2, 31) + h1) * np.uint64(5) + np.uint64(0x38495AB5)
        rest = words[:, length // 16 * 16 :]
        tail = np.zeros((n, 16), np.uint8)
        tail[:, : rest.shape[1]] = rest
        k1, k2 = tail[:, :8].copy().view("<u8").ravel(), tail[:, 8:].copy().view("<u8").ravel()
        if rest.shape[1] > 8:
            h2 = h2 ^ _rotl(k2 * C2, 33) * C1
        if rest.shape[1]:
            h1 = h1 ^ _rotl(k1 * C1, 31) * C2
        h1, h2 = h1 ^ np.uint64(length), h2 ^ np.uint64(length)
        h1 = h1 + h2
        h2 = h2 + h1
        h1, h2 = _final(h1), _final(h2)
        return h1 + h2


def signature_kmers(df: DataFrame, k: int, name: str, keep: list[str], scaled: int, sequence: str = "sequence", seed: int = 42) -> DataFrame:
    """``keep, hash`` of residue k-mers as JSON sketches hash them: the letters (of a reduced alphabet one letter for each class) under Murmur, kept up to 2^64 / ``scaled``."""
    from pyspark.sql.types import StructType

    a = alphabet(name)
    letters = np.frombuffer((a.letters() if name == "protein" else "".join(chr(97 + i) for i in range(len(a.classes)))).encode(), np.uint8)
    limit = np.uint64(min((1 << 64) - 1, (1 << 64) // scaled))
    schema = StructType([*(df.schema[c] for c in keep), *StructType.fromDDL("hash long").fields])

    def run(batches):
        for b in batches:
            which, out = [], []
            for i, s in enumerate(b[sequence]):
                cls = a.table[np.frombuffer((s or "").encode(), np.uint8)]
                if len(cls) < k:
                    continue
                windows = np.lib.stride_tricks.sliding_window_view(cls, k)
                windows = windows[(windows < 255).all(axis=1)]
                if len(windows):
                    h = np.unique(murmur64(letters[windows], seed))
                    h = h[h <= limit]
                    which += [i] * len(h)
                    out.append(h)
            rows = b[keep].iloc[which].reset_index(drop=True)
            rows["hash"] = np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64)
            yield rows

    return df.select(*dict.fromkeys([*keep, sequence])).mapInPandas(run, schema)


def _probes(hash_: Column, blocks: int, probes: int) -> tuple[Column, Column]:
    """A key's block and its bits among the block's 512."""
    block = F.pmod(F.xxhash64(F.lit(17), hash_), F.lit(blocks))
    return block, F.array_distinct(F.array(*(F.pmod(F.xxhash64(F.lit(100 + i), hash_), F.lit(512)) for i in range(probes))))


def bloom_table(keys: DataFrame, blocks: int, hash_: str = "hash", probes: int = 7) -> DataFrame:
    """A blocked Bloom filter of 64-byte blocks as a table: ``block, word, bits``. Bits are joined map-side, so a block has at most eight rows however many keys."""
    block, bits = _probes(F.col(hash_), blocks, probes)
    each = keys.select(block.alias("block"), F.explode(bits).alias("bit"))
    return each.groupBy("block", F.expr("bit div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("bits"))


def bloom_contains(rows: DataFrame, filter_: DataFrame, blocks: int, hash_: str = "hash", probes: int = 7) -> DataFrame:
    """The ``rows`` whose key may be in the filter, none that is missed: all of a key's bits must be set in its block."""
    block, bits = _probes(F.col(hash_), blocks, probes)
    whole = filter_.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("_words"))
    asked = rows.withColumn("_block", block).withColumn("_bits", bits).join(whole.withColumnRenamed("block", "_block"), "_block")
    test = F.forall("_bits", lambda b: (F.coalesce(F.getbit(F.element_at("_words", F.floor(b / 64)), (b % 64).cast("int")), F.lit(0)) == 1))
    return asked.where(test).drop("_block", "_bits", "_words")


def bloom_blocks(keys: int, bits_per_key: int = 10) -> int:
    return max(1, -(-keys * bits_per_key // 512))


def linear_clusters(targets: DataFrame, p: KmerParams, least_identity: float = 0.9, minimal: int = 20) -> DataFrame:
    """``target_id, group``: each sequence goes to the longest sequence that shares one of its ``minimal`` least k-mers and aligns with it at ``least_identity``; ties to the least id.

    Work is linear in the sequences: a k-mer's group is compared with its longest member only. A centre that itself goes to
    another passes its members on.
    """
    rows = cut(targets.select("target_id", "sequence", F.length("sequence").alias("len")))
    kept = target_kmers(rows, p, ["target_id", "len"]).distinct()
    least = kept.withColumn("_r", F.row_number().over(Window.partitionBy("target_id").orderBy(unsigned("hash")))).where(F.col("_r") <= minimal)
    centres = least.groupBy("hash").agg(F.max_by("target_id", F.struct("len", F.xxhash64("target_id"))).alias("centre"))
    pairs = least.join(centres, "hash").where("target_id <> centre").select("target_id", "centre").distinct()
    seqs = rows.select(F.col("target_id").alias("centre"), F.col("sequence").alias("b"), F.col("len").alias("blen"))
    found = identities(pairs.join(rows.withColumnRenamed("sequence", "a"), "target_id").join(seqs, "centre").where("blen >= len"), ["target_id", "centre", "blen"]).where(F.col("identity") >= least_identity)
    best = found.groupBy("target_id").agg(F.max_by("centre", F.struct("blen", "identity", F.xxhash64("centre"))).alias("centre"))
    now = cut(rows.select("target_id").join(best, "target_id", "left").select("target_id", F.coalesce("centre", "target_id").alias("group")))
    for _ in range(30):
        up = now.select(F.col("target_id").alias("group"), F.col("group").alias("next"))
        new = cut(now.join(up, "group").select("target_id", F.col("next").alias("group"), ((F.col("next") != F.col("group")) & (F.col("next") != F.col("target_id"))).alias("moved")))
        now = new.drop("moved")
        if new.where("moved").isEmpty():
            break
    return now


def mutated(df: DataFrame, identity: float, seed: int = 0, letters: str = "ACDEFGHIKLMNPQRSTVWY", key: str = "id", sequence: str = "sequence") -> DataFrame:
    """``df`` with residues replaced by others at a rate of 1 - ``identity``, drawn by a hash of seed, key and place."""
    from ..functions.numerics import hashed_uniform

    def run(batches):
        for b in batches:
            out = []
            for k, s in zip(b[key], b[sequence]):
                n = len(s)
                ids = np.full(n, int(k))
                hit = hashed_uniform(np.full(n, seed), ids, np.arange(n)) >= identity
                pick = (hashed_uniform(np.full(n, seed + 1), ids, np.arange(n)) * (len(letters) - 1)).astype(int)
                out.append("".join([x for x in letters if x != c][p] if h else c for c, h, p in zip(s, hit, pick)))
            yield b.assign(**{sequence: pd.Series(out, dtype=object, index=b.index)})

    return df.mapInPandas(run, df.schema)


def simulated_reads(genomes: DataFrame, length: int, seed: int = 0) -> DataFrame:
    """``name, read, start, reverse, seq`` of ``depth`` times a record's length over ``length`` reads (``name, seq, depth``), starts and strands by hash."""
    from ..functions.sequences import reverse_complement_column

    n = F.greatest(F.floor(F.col("depth") * F.length("seq") / length), F.lit(0)).cast("int")
    rows = genomes.where(F.length("seq") >= length).withColumn("read", F.explode(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))))
    start = F.pmod(F.xxhash64(F.lit(seed), "name", "read"), (F.length("seq") - length + 1).cast("long")).cast("int")
    back = F.pmod(F.xxhash64(F.lit(seed + 1), "name", "read"), F.lit(2)) == 1
    piece = F.substring(F.col("seq"), start + 1, F.lit(length))
    return rows.select("name", "read", start.alias("start"), back.alias("reverse"), F.when(back, reverse_complement_column(piece)).otherwise(piece).alias("seq"))


def unit_evidence(pairs: DataFrame, keys: DataFrame, log2_windows: float) -> DataFrame:
    """``read, unit, score`` of a compact table (``hash, unit, bits``): a unit's summed bits less ``log2_windows`` for every hit beyond the first."""
    met = pairs.select("read", "hash").distinct().join(keys, "hash")
    return met.groupBy("read", "unit").agg((F.sum("bits") - (F.count(F.lit(1)) - 1) * F.lit(log2_windows)).alias("score"))


def nearest_relatives(kmers: DataFrame, most: int = 500, top: int = 10) -> DataFrame:
    """``id, other, shared``: the ``top`` sequences that share most k-mers (``id, hash``), without k-mers of more than ``most`` sequences."""
    one = kmers.select("id", "hash").distinct()
    wide = one.groupBy("hash").count().where(F.col("count") > most)
    own = one.join(wide, "hash", "left_anti")
    met = own.join(own.select(F.col("id").alias("other"), "hash"), "hash").where("id <> other").groupBy("id", "other").agg(F.count(F.lit(1)).alias("shared"))
    return met.withColumn("_r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("shared"), "other"))).where(F.col("_r") <= top).drop("_r")


def handoff_records(sam: DataFrame, assigned: DataFrame) -> DataFrame:
    """One record for each mate of the pairs in ``assigned`` (``qname, rname, posterior``): its best on the assigned sequence, no longer marked as secondary or supplementary, with the posterior as its mapping quality."""
    on = sam.join(assigned, ["qname", "rname"])
    best = on.withColumn("_r", F.row_number().over(Window.partitionBy("qname", "mate").orderBy(F.desc("score"), "pos"))).where("_r = 1").drop("_r")
    quality = F.least(F.lit(60), F.round(-10 * F.log10(F.greatest(1 - F.col("posterior"), F.lit(1e-6))))).cast("int")
    return best.withColumns({"flag": F.col("flag").bitwiseAND(~0x900), "mapq": quality}).drop("posterior")
