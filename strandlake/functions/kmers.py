"""Sampled k-mers of sequences, as Arrow-batched table functions.

A k-mer is packed with its first residue in the highest bits and hashed by a bijection of 64-bit numbers; it is sampled
if its hash, unsigned, is at most a bound. Spark has no unsigned numbers: columns named ``hash`` hold the same bits as
signed longs, and ``unsigned(hash)`` flips the sign bit, which gives the unsigned order.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .alphabets import INVALID, Alphabet, alphabet
from .sequences import kept_segments, mask_quality, six_frames

TOP = 1 << 63
ALL = (1 << 64) - 1
#: Bytes of text whose k-mers a task makes at a time.
TEXT = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser over uint64."""
    z = x + np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def unmix(h: np.ndarray) -> np.ndarray:
    """The packed k-mer of a hash."""
    z = h ^ (h >> np.uint64(31)) ^ (h >> np.uint64(62))
    z = z * np.uint64(pow(0x94D049BB133111EB, -1, 1 << 64))
    z = z ^ (z >> np.uint64(27)) ^ (z >> np.uint64(54))
    z = z * np.uint64(pow(0xBF58476D1CE4E5B9, -1, 1 << 64))
    z = z ^ (z >> np.uint64(30)) ^ (z >> np.uint64(60))
    return z - np.uint64(0x9E3779B97F4A7C15)


def bound(fraction: float) -> int:
    """The largest hash that a sample of ``fraction`` keeps: all from 1 on, only hash 0 for nothing."""
    if not fraction < 1:
        return ALL if fraction >= 1 else 0
    return max(0, int(max(fraction, 0.0) * 2**64) - 1)


def signed(x: int) -> int:
    """An unsigned 64-bit number as the signed long of the same bits."""
    return x - (1 << 64) if x >= TOP else x


def unsigned(hash_: Column | str) -> Column:
    """A long that orders as the unsigned hash does."""
    return (F.col(hash_) if isinstance(hash_, str) else hash_).bitwiseXOR(F.lit(-TOP))


def ordered_bound(fraction: Column) -> Column:
    """``bound`` of a column of rates, in the order of ``unsigned``. The product with 2^64 is taken in two halves, each of which a double holds exactly."""
    f = F.greatest(fraction, F.lit(0.0)) * F.lit(2.0**32)
    high = F.floor(f)
    low = F.floor((f - high) * F.lit(2.0**32))
    value = (high - F.lit(1 << 31)) * F.lit(1 << 32) + (low - 1)
    return F.when(fraction >= 1, F.lit(TOP - 1)).when((high == 0) & (low == 0), F.lit(-TOP)).otherwise(value)


@dataclass(frozen=True)
class KmerParams:
    """What makes k-mers comparable: length, alphabet, genetic code, frame mode and sampling bound."""

    k: int
    name: str = "protein"
    code: int = 11
    frames: str = "stopfree"
    bound: int = ALL

    def __post_init__(self):
        if not 1 <= self.k <= self.letters.max_k:
            raise ValueError(f"k must be 1 to {self.letters.max_k} in alphabet {self.name}")

    @property
    def letters(self) -> Alphabet:
        return alphabet(self.name)


def kmer_hashes(seqs: list[bytes], p: KmerParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequence number, start and hash of every sampled k-mer of ``seqs``, in order; of nucleotides, of the lesser of each k-mer and its reverse complement."""
    joined = b"\0".join(seqs)
    classes = p.letters.table[np.frombuffer(joined, np.uint8)]
    n = len(classes) - p.k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    bits = np.uint64(p.letters.bits)
    bad = np.r_[0, np.cumsum(classes == INVALID)]
    at = np.flatnonzero(bad[p.k :] == bad[: n])
    word = np.zeros(len(at), np.uint64)
    for i in range(p.k):
        word = (word << bits) | classes[at + i]
    if p.letters.is_nucleotide:
        back = np.zeros(len(at), np.uint64)
        for i in range(p.k):
            back |= np.uint64(3) - classes[at + i].astype(np.uint64) << np.uint64(2 * i)
        word = np.minimum(word, back)
    h = mix(word)
    if p.bound < ALL:
        keep = h <= np.uint64(p.bound)
        at, h = at[keep], h[keep]
    starts = np.cumsum([0, *(len(s) + 1 for s in seqs)])[:-1]
    which = np.searchsorted(starts, at, "right") - 1
    return which, at - starts[which], h


def text_slices(batch, most: int = TEXT):
    """``batch`` in runs of rows of at most ``most`` bytes of text together, a longer row alone."""
    import pyarrow as pa
    import pyarrow.compute as pc

    size = np.ones(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
            size += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(size)
    lo = 0
    while lo < batch.num_rows:
        hi = max(int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, "right")), lo + 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def hashes_in_pieces(seqs: list[bytes], p: KmerParams, most: int = TEXT):
    """``kmer_hashes`` of a slice, of ``most`` starts of each sequence at a time: a longer one comes in pieces that overlap by k - 1, others at once."""
    for lo in range(0, max(map(len, seqs), default=0), most):
        which, start, h = kmer_hashes([s[lo : lo + most + p.k - 1] for s in seqs], p)
        yield which, start + lo, h


def _rows(df: DataFrame, keep: list[str], make, more: str) -> DataFrame:
    """Columns ``keep`` of ``df`` repeated by the indices that ``make`` gives, and its arrays as the columns ``more``, as often as it gives some. Made a slice of a batch at a time, so that a task holds the k-mers of ``TEXT`` bytes and not of a batch's ten thousand texts."""
    from pyspark.sql.types import StructType

    schema = StructType([df.schema[c] for c in keep] + StructType.fromDDL(more).fields)
    names = [f.name for f in schema]

    def run(batches):
        import pyarrow as pa

        for batch in (x for b in batches for x in text_slices(b)):
            for which, arrays in make(batch):
                index = pa.array(which, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(i).take(index) for i in range(len(keep))] + [pa.array(a) for a in arrays], names)

    return df.select(*keep, *(c for c in df.columns if c not in keep)).mapInArrow(run, schema)


def _texts(batch, name: str) -> list[bytes]:
    import pyarrow as pa

    return [x or b"" for x in batch.column(batch.schema.names.index(name)).cast(pa.binary()).to_pylist()]


def target_kmers(df: DataFrame, p: KmerParams, keep: list[str], sequence: str = "sequence", positions: bool = False) -> DataFrame:
    """The sampled k-mers of each target sequence: ``keep``, ``hash`` and, if asked for, ``pos``. A null sequence has none."""

    def make(batch):
        for which, pos, h in hashes_in_pieces(_texts(batch, sequence), p):
            yield which, [h.view(np.int64), *([pos.astype(np.int32)] if positions else [])]

    return _rows(df.select(*dict.fromkeys([*keep, sequence])), keep, make, "hash long" + ", pos int" * positions)


def read_kmers(df: DataFrame, p: KmerParams, keep: list[str], sequence: str = "seq", qual: str | None = None, least_quality: int = 0) -> DataFrame:
    """The sampled k-mers of reads with their ``frame``: of nucleotide indexes of the read itself (frame 0), else of what the frame mode keeps of its six translations (0 to 2 forward, 3 to 5 reverse)."""

    def make(batch):
        seqs = _texts(batch, sequence)
        if qual and least_quality:
            seqs = [mask_quality(s, q, least_quality) for s, q in zip(seqs, _texts(batch, qual))]
        if p.letters.is_nucleotide:
            for which, _, h in hashes_in_pieces(seqs, p):
                yield which, [np.zeros(len(h), np.int32), h.view(np.int64)]
            return
        parts, owner, frame = [], [], []
        for i, s in enumerate(seqs):
            for f, aa in enumerate(six_frames(s, p.code)):
                for segment in kept_segments(aa, p.frames):
                    parts.append(segment)
                    owner.append(i)
                    frame.append(f)
        which, _, h = kmer_hashes(parts, p)
        yield np.array(owner, np.int64)[which], [np.array(frame, np.int32)[which], h.view(np.int64)]

    return _rows(df.select(*dict.fromkeys([*keep, sequence, *([qual] if qual else [])])), keep, make, "frame int, hash long")


def base_counts(df: DataFrame, sequence: str = "seq", qual: str | None = None, least_quality: int = 0) -> DataFrame:
    """``bases, lost, errors``: all bases, those that are no base after masking, and the sum of error probabilities of the others."""

    def count(batches):
        import pyarrow as pa

        for batch in batches:
            bases = lost = 0
            errors = 0.0
            quals = _texts(batch, qual) if qual else None
            for i, s in enumerate(_texts(batch, sequence)):
                q = quals[i] if quals else b""
                if q:
                    s = mask_quality(s, q, least_quality)
                ok = np.isin(np.frombuffer(s, np.uint8), np.frombuffer(b"ACGTUacgtu", np.uint8))
                bases += len(s)
                lost += int((~ok).sum())
                if q:
                    errors += float((10.0 ** (-(np.frombuffer(q, np.uint8)[ok].astype(float) - 33) / 10)).sum())
            yield pa.RecordBatch.from_arrays([pa.array([bases], pa.int64()), pa.array([lost], pa.int64()), pa.array([errors])], ["bases", "lost", "errors"])

    parts = df.select(sequence, *([qual] if qual else [])).mapInArrow(count, "bases long, lost long, errors double")
    return parts.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("bases", "lost", "errors")))
