"""Toxicity: a factorization machine over hashed terms, whose weights and pairwise interactions are learned from labelled documents."""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import plus, with_text

#: Labelled rows of each class that training may gather, and terms of one such text: together at most 64 MB of numbers.
MOST_LABELLED, MOST_TERMS = 2000, 4000
#: What separates words: every ASCII character that is no letter. Bytes of other scripts count as letters.
_SPACED = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
#: Letters of a stem, and how often a stem must occur for each of its terms.
STEM, TIMES = 5, (1, 2, 4, 8)
#: Distinct words that a task remembers before it begins anew.
MOST_REMEMBERED = 300_000


def stem(word: bytes) -> bytes:
    """The first letters of a word."""
    return word[:STEM] if word.isascii() else word.decode()[:STEM].encode()


class Terms(dict):
    """Hashed terms of texts: words, stems that occur so many times, and the order of a text's length. Words are remembered, within bounds, as far as ``among`` (sorted buckets; None for all) has their buckets."""

    def __init__(self, bits: int, among: np.ndarray | None = None):
        super().__init__()
        self.mask, self.among = (1 << bits) - 1, None if among is None else frozenset(among.tolist())
        self.sizes = [self.bucket(b"size %d" % i) for i in range(64)]

    def bucket(self, term: bytes) -> int:
        return zlib.crc32(term) & self.mask

    def __missing__(self, word: bytes) -> tuple[int, tuple[int, ...]]:
        """The bucket of a word and those of its stem, -1 and none where ``among`` lacks them."""
        if len(self) >= MOST_REMEMBERED:
            self.clear()
        own, start = self.bucket(word), stem(word)
        stems = tuple(self.bucket(b"%s %d" % (start, n)) for n in TIMES) if len(word) >= STEM else ()
        if self.among is not None:
            own, stems = own if own in self.among else -1, stems if self.among.intersection(stems) else ()
        self[word] = found = own, stems
        return found

    def of(self, text: bytes) -> np.ndarray:
        """The sorted buckets that a text has."""
        counts = Counter(text.lower().translate(_SPACED).split())
        own, stems = set(), Counter()
        for word, n in counts.items():
            at, start = self[word]
            if at >= 0:
                own.add(at)
            if start:
                stems[start] += n
        for start, n in stems.items():
            own.update(x for x, least in zip(start, TIMES) if n >= least)
        if counts:
            own.add(self.sizes[counts.total().bit_length()])
        return np.array(sorted(own), np.int64)


@dataclass
class FactorizationMachine:
    """``bias + sum of weights + sum over pairs of the dot product of their factors``, over the buckets that a text has. A bucket without a row has neither weight nor factors."""

    bits: int
    buckets: np.ndarray  # sorted
    weights: np.ndarray
    factors: np.ndarray
    bias: float

    def score(self, buckets: np.ndarray) -> float:
        """Chance of the label 1."""
        at = np.searchsorted(self.buckets, buckets[np.isin(buckets, self.buckets)])
        v = self.factors[at]
        z = self.bias + self.weights[at].sum() + 0.5 * float((v.sum(0) ** 2 - (v**2).sum(0)).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def columns(rows: list[np.ndarray], toxic: np.ndarray, most: int) -> np.ndarray:
    """At most ``most`` buckets that two rows have, sorted: half for what they say of the label alone, the rest the most frequent, which may say something in pairs."""
    flat, label = np.concatenate(rows), np.repeat(toxic, [len(r) for r in rows])
    names, at, held = np.unique(flat, return_inverse=True, return_counts=True)
    bad = np.bincount(at, label)
    p = toxic.mean()
    says = np.where(held >= 2, np.abs(bad - held * p) / np.sqrt(held * p * (1 - p)), -1)
    first = np.lexsort((names, -says))[: most // 2]
    says[first], held[first] = -1, -1
    rest = np.lexsort((names, -held))[: most - len(first)]
    return np.sort(names[np.concatenate([first, rest[held[rest] >= 2]])])


def train(rows: list[np.ndarray], toxic: np.ndarray, bits: int = 20, rank: int = 4, share: float | None = None, most: int = 4096, steps: int = 200, rate: float = 0.1, sparsity: float = 3e-3, seed: int = 7) -> FactorizationMachine:
    """Maximum likelihood with both classes weighed alike, by proximal Adagrad over all rows at once.

    ``most`` buckets take part (see ``columns``). After each step weights, and whole rows of factors, are drawn towards
    nought by ``sparsity``, so that words that mark nothing end without any part in the score and long texts score as
    short ones. ``share`` is the share of label 1 to which the bias is then moved; without it the bias stays as it is for
    classes of equal size. Rows of one class only: the bias alone.
    """
    toxic = np.asarray(toxic, float)
    odds = float(np.log(share / (1 - share))) if share and share < 1 else 0.0
    none = FactorizationMachine(bits, np.zeros(0, np.int64), np.zeros(0), np.zeros((0, rank)), odds)
    if not len(rows) or toxic.all() or not toxic.any() or not sum(map(len, rows)):
        return none
    names = columns(rows, toxic, most)
    x = np.zeros((len(rows), len(names)), np.float32)
    for i, row in enumerate(rows):
        x[i, np.searchsorted(names, row[np.isin(row, names, assume_unique=True)])] = 1
    rng = np.random.default_rng(seed)
    w, v, bias = np.zeros((len(names), 1), np.float32), rng.normal(0, 0.02, (len(names), rank)).astype(np.float32), 0.0
    gw2, gv2, gb2 = np.full_like(w, 1e-6), np.full_like(v, 1e-6), 1e-6
    weight = np.where(toxic > 0, 0.5 / toxic.sum(), 0.5 / (1 - toxic).sum())
    for _ in range(steps):
        seen = x @ np.hstack([w, v, (v**2).sum(1, keepdims=True)])
        sums = seen[:, 1:-1]
        z = bias + seen[:, 0] + 0.5 * ((sums**2).sum(1) - seen[:, -1])
        error = (weight * (1 / (1 + np.exp(-np.clip(z, -60, 60))) - toxic)).astype(np.float32)[:, None]
        grads = x.T @ np.hstack([error, error * sums])
        gw, gv, gb = grads[:, :1], grads[:, 1:] - v * grads[:, :1], float(error.sum())
        gb2, gw2, gv2 = gb2 + gb**2, gw2 + gw**2, gv2 + gv**2
        bias -= rate * gb / gb2**0.5
        pace = rate / np.sqrt(gw2)
        w = w - pace * gw
        w = np.sign(w) * np.maximum(np.abs(w) - pace * sparsity, 0)
        pace = rate / np.sqrt(gv2.mean(1, keepdims=True))
        v = v - pace * gv
        v *= np.maximum(1 - pace * sparsity / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9), 0)
    used = (w[:, 0] != 0) | (v != 0).any(1)
    return FactorizationMachine(bits, names[used], w[used, 0].astype(float), v[used].astype(float), float(bias + odds))


def labelled(docs: DataFrame, labels: DataFrame, bits: int, most: int = MOST_LABELLED) -> tuple[list[np.ndarray], np.ndarray, float | None]:
    """Buckets of at most ``most`` labelled texts of each class, drawn by a hash of ``doc_id``, whether each is toxic, and the share of toxic ids among all labelled ones.

    An id with both labels counts as toxic; of rows that share an id one is taken, and texts of over ``MOST_TERMS``
    terms are left out of training (never of scoring).
    """
    one = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    drawn = [one.where(F.col("toxic") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for q in (0, 1)]
    share = one.agg(F.avg("toxic")).head()[0]

    def features(batches):
        import pyarrow as pa

        known = Terms(bits)
        for batch in batches:
            found = [known.of(t or b"") for t in batch.column(1).cast(pa.binary()).to_pylist()]
            found = [x.astype("<i4").tobytes() if len(x) <= MOST_TERMS else None for x in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.binary())], ["doc_id", "toxic", "x"])

    few = F.broadcast(drawn[0].unionByName(drawn[1]))  # at most 2 * most rows of two numbers
    kind = docs.schema["doc_id"].dataType.simpleString()
    each = docs.select("doc_id", "text").join(few, "doc_id").select("doc_id", "text", "toxic").mapInArrow(features, f"doc_id {kind}, toxic int, x binary")
    rows = each.where("x is not null").groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.min("x").alias("x")).collect()
    rows.sort(key=lambda r: (r["toxic"], bytes(r["x"])))
    return [np.frombuffer(r["x"], "<i4").astype(np.int64) for r in rows], np.array([r["toxic"] for r in rows], float), share


def train_machine(docs: DataFrame, labels: DataFrame, bits: int = 20, rank: int = 4, most: int = MOST_LABELLED) -> FactorizationMachine:
    """A machine trained on the rows of ``labels`` (``doc_id, toxic``); without both classes it gives every text the share of toxic labels."""
    rows, toxic, share = labelled(docs, labels, bits, most)
    return train(rows, toxic, bits, rank, share)


def score_toxicity(docs: DataFrame, machine: FactorizationMachine, threshold: float = 0.3) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on).

    Only the text counts. Null or empty text, or one without a known term: the score of the bias alone. Texts are read
    whole, where they lie; nothing is dealt out, and a very long text takes the memory of its distinct terms. Repeated
    rows score alike. Columns of the two names are replaced, others pass through. Empty table: empty result.
    """

    def look(batches):
        import pyarrow as pa

        known = Terms(machine.bits, machine.buckets)

        def make(texts):
            scores = [machine.score(known.of(t or b"")) for t in texts]
            return {"score": pa.array(scores, pa.float64()), "predicted": pa.array([int(s >= threshold) for s in scores], pa.int32())}

        yield from with_text(batches, make)

    return docs.mapInArrow(look, plus(docs, "score double, predicted int"))


def held_out(doc_id):
    """Column: whether an id's label is kept from training."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def op12_toxicity(spark, sf_dir: str) -> DataFrame:
    """Every document's score: ``doc_id, held_out, score, predicted``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").where(~held_out(F.col("doc_id")))
    scored = score_toxicity(docs, train_machine(docs, labels))
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")
