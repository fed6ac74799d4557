"""Sequence and numeric functions against plain loops."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandlake.functions import kmers as K
from strandlake.functions import numerics as N
from strandlake.functions import sequences as S
from strandlake.functions.alphabets import CLASSES, alphabet

M = (1 << 64) - 1


def mix(x):
    z = (x + 0x9E3779B97F4A7C15) & M
    z = ((z ^ z >> 30) * 0xBF58476D1CE4E5B9) & M
    z = ((z ^ z >> 27) * 0x94D049BB133111EB) & M
    return z ^ z >> 31


def brute(seq, k, name):
    a = alphabet(name)
    out = []
    for i in range(len(seq) - k + 1):
        c = [next((j for j, g in enumerate(a.classes) if x.upper() in g), None) for x in seq[i : i + k]]
        if None in c:
            continue
        word = 0
        for v in c:
            word = word << a.bits | v
        if a.is_nucleotide:
            back = 0
            for v in reversed(c):
                back = back << 2 | 3 - v
            word = min(word, back)
        out.append((i, mix(word)))
    return out


@given(st.lists(st.text(alphabet="ACDEFGacdefgXtTuU*", max_size=25), max_size=4), st.sampled_from(sorted(CLASSES)), st.integers(1, 6))
@settings(max_examples=200, deadline=None)
def test_kmers(seqs, name, k):
    which, at, h = K.kmer_hashes([s.encode() for s in seqs], K.KmerParams(k, name))
    got = [(int(w), int(a), int(x)) for w, a, x in zip(which, at, h)]
    assert got == [(i, a, x) for i, s in enumerate(seqs) for a, x in brute(s, k, name)]


def test_hash_is_a_bijection():
    x = np.random.default_rng(0).integers(0, 1 << 63, 5000).astype(np.uint64)
    assert (K.unmix(K.mix(x)) == x).all() and int(K.mix(np.array([7], np.uint64))[0]) == mix(7)


@pytest.mark.parametrize("f, want", [(1.0, M), (2.0, M), (0.5, (1 << 63) - 1), (0.0, 0), (-1.0, 0), (float("nan"), 0), (2.0**-64, 0)])
def test_bound(f, want):
    assert K.bound(f) == want


def test_ordered_bound(spark):
    from pyspark.sql import functions as F

    rates = [0.0, 1e-6, 0.01, 0.25, 0.5, 0.999, 1.0]
    got = spark.createDataFrame([(r,) for r in rates], "r double").select(K.ordered_bound(F.col("r"))).collect()
    assert [g[0] for g in got] == [K.bound(r) - (1 << 63) for r in rates]


def test_parameters_are_checked():
    with pytest.raises(ValueError):
        K.KmerParams(13, "protein")
    with pytest.raises(ValueError):
        alphabet("none")
    with pytest.raises(ValueError):
        S.edge_length("inner:3")


def test_translation(spark):
    from pyspark.sql import functions as F

    assert S.translate(b"ATGTAANNNUGA") == b"M*X*" and S.translate(b"TGA", 4) == b"W" and S.translate(b"AT") == b""
    assert S.six_frames(b"ATGAAA")[3] == S.translate(S.reverse_complement(b"ATGAAA"))
    assert S.reverse_complement(b"aCgTuNx") == b"NNAACGT"
    seqs = ["ATGTAANNNUGA", "at", "", "acgtacgtné"]
    rows = spark.createDataFrame([(s,) for s in seqs], "s string").select("s", S.translate_column(F.col("s")), S.reverse_complement_column(F.col("s"))).collect()
    for s, aa, back in rows[:3]:
        assert aa.encode() == S.translate(s.encode()) and back.encode() == S.reverse_complement(s.encode())


def test_frame_modes():
    f = b"MKLV*AA*PQRSTV"
    assert S.kept_segments(f) == [] and S.kept_segments(f, "all") == [f]
    assert S.kept_segments(f, "edges:5") == [b"PQRSTV"] and S.kept_segments(f, "edges:4") == [b"MKLV", b"PQRSTV"]
    assert S.kept_segments(b"MKLV", "edges:30") == [b"MKLV"]


@given(st.text(alphabet="AKQ", max_size=24))
@settings(max_examples=300, deadline=None)
def test_repeats(text):
    masked = S.mask_repeats(text.encode()).decode()
    assert len(masked) == len(text) and all(b in ("x", a) for a, b in zip(text, masked))
    for p in (1, 2, 3):  # nothing of four copies is left
        for i in range(len(masked) - 4 * p + 1):
            unit = masked[i : i + p]
            assert "x" in unit or masked[i : i + 4 * p] != unit * 4


def test_masks(spark):
    from pyspark.sql import functions as F

    assert S.mask_quality(b"ACGT", b"I!5I", 20) == b"ANGT"
    got = spark.createDataFrame([("ACGT", "I!5I")], "s string, q string").select(S.mask_quality_column(F.col("s"), F.col("q"), 20)).first()[0]
    assert got == "ANGT"
    peptide = S.adapter_peptides()[0]
    assert spark.createDataFrame([(f"MK{peptide}LV",)], "s string").select(S.mask_adapters(F.col("s"))).first()[0] == "MKXXXXXXLV"


def test_special_functions():
    assert N.gamma_p(2.5, 3.0) == pytest.approx(0.693781, abs=1e-6)
    assert N.beta_p(2, 3, 0.4) == pytest.approx(0.5248, abs=1e-6)
    assert N.chi2_quantile(0.95, 1) == pytest.approx(3.841459, abs=1e-5)
    low, high = N.clopper_pearson(3, 10)
    assert (low, high) == (pytest.approx(0.066740, abs=1e-5), pytest.approx(0.652453, abs=1e-5))
    assert N.clopper_pearson(0, 5)[0] == 0 and N.clopper_pearson(5, 5)[1] == 1
    x = N.ztp_rate(np.array([1.0, 2.5]))
    assert x[0] == 0 and x[1] / -math.expm1(-x[1]) == pytest.approx(2.5)
    w = N.hashed_poisson1(1, 2, np.arange(20_000))
    assert abs(w.mean() - 1) < 0.03 and (w == N.hashed_poisson1(1, 2, np.arange(20_000))).all()


@given(st.lists(st.floats(0, 10), min_size=1, max_size=8))
@settings(max_examples=100, deadline=None)
def test_isotonic(y):
    w = np.ones(len(y))
    got = N.isotonic(np.array(y), w)
    assert (np.diff(got) >= -1e-12).all()
    want = [max(min(np.mean(y[a : b + 1]) for b in range(i, len(y))) for a in range(i + 1)) for i in range(len(y))]
    assert np.allclose(got, want)


def test_small_estimators():
    assert N.average_rank(np.array([3, 1, 3, 2])).tolist() == [3.5, 1, 3.5, 2]
    assert N.emd(np.array([1, 0, 0]), np.array([0, 0, 1])) == 2
    mean, low, high = N.bootstrap_mean(np.array(random.Random(1).choices(range(10), k=200)))
    assert low < mean < high


def test_texts_are_taken_in_slices():
    """A batch is worked on by a bounded number of bytes at a time: every row once, in order, a longer one alone."""
    import pyarrow as pa

    from strandlake.functions.kmers import text_slices

    texts = ["é" * 3, None, "", "a" * 50, "bc", "d" * 9, "e"]
    batch = pa.RecordBatch.from_pydict({"id": list(range(7)), "text": texts})
    got = [x.to_pydict() for x in text_slices(batch, 12)]
    assert [i for x in got for i in x["id"]] == list(range(7)) and [t for x in got for t in x["text"]] == texts
    assert [x["id"] for x in got] == [[0, 1, 2], [3], [4], [5, 6]]
    assert list(text_slices(batch.slice(0, 0), 12)) == []


def test_kmers_of_a_large_batch_come_in_bounded_pieces(spark, monkeypatch):
    """A batch of 4 MB of texts is hashed a megabyte at a time, and no k-mer is lost."""
    import pyarrow as pa

    from strandlake.functions import kmers

    class Table:
        schema = spark.createDataFrame([], "id long, sequence string").schema
        columns = schema.names

        def select(self, *_):
            return self

        __getitem__ = select

        def mapInArrow(self, run, _):
            return run

    batch = pa.RecordBatch.from_pydict({"id": list(range(40)), "sequence": ["ACDEFGHIKL" * 10000] * 40})
    run = kmers.target_kmers(Table(), kmers.KmerParams(3), ["id"])
    sizes = [x.num_rows for x in run(iter([batch]))]
    assert sum(sizes) == 40 * 99_998 and max(sizes) <= kmers.TEXT


def test_kmers_of_a_long_text_come_in_bounded_pieces(spark):
    """One text over a megabyte is hashed a piece at a time: the k-mers that cross from one to the next are there once, at their places."""
    import pyarrow as pa

    from strandlake.functions import kmers

    class Table:
        schema = spark.createDataFrame([], "unit long, sequence string").schema
        columns = schema.names

        def select(self, *_):
            return self

        __getitem__ = select

        def mapInArrow(self, run, _):
            return run

    p = kmers.KmerParams(3)
    texts = ["AC", "".join(np.random.default_rng(1).choice(list("ACDEFGHIKLMNPQRSTVWYXé"), 2 * kmers.TEXT + 77)), "ACDE", None]
    batch = pa.RecordBatch.from_pydict({"unit": [0, 1, 2, 3], "sequence": texts})
    which, pos, h = kmers.kmer_hashes([(t or "").encode() for t in texts], p)
    got = list(kmers.target_kmers(Table(), p, ["unit"], positions=True)(iter([batch])))
    assert max(x.num_rows for x in got) <= kmers.TEXT
    found = pa.Table.from_batches(got)
    assert (found["unit"].to_numpy() == which).all() and (found["pos"].to_numpy() == pos).all() and (found["hash"].to_numpy().view(np.uint64) == h).all()


def test_places_of_a_long_text_come_in_bounded_pieces(spark):
    """The same for the places of each k-mer; each counts once for its text, in however many pieces it is."""
    import pyarrow as pa

    from strandlake.functions import kmers
    from strandlake.operators import compact

    class Table:
        schema = spark.createDataFrame([], "unit long, sequence string").schema
        columns = schema.names

        def select(self, *_):
            return self

        __getitem__ = select

        def mapInArrow(self, run, _):
            return run

    p = kmers.KmerParams(3)
    texts = ["AC", "".join(np.random.default_rng(1).choice(list("ACDEFGHIKLMNPQRSTVWYXé"), 2 * kmers.TEXT + 77)), "ACDE", None]
    batch = pa.RecordBatch.from_pydict({"unit": [0, 1, 2, 3], "sequence": texts})
    which, pos, h = kmers.kmer_hashes([(t or "").encode() for t in texts], p)
    got = list(compact.kmer_places(Table(), p)(iter([batch])))
    assert max(len(x["places"].flatten()) for x in got) <= kmers.TEXT
    found = pa.Table.from_batches(got)
    assert found["unit"].to_pylist().count(1) > len(np.unique(h[which == 1]))  # a row a piece
    once = found.filter(found["first"])
    assert sorted(zip(once["unit"].to_pylist(), once["hash"].to_numpy().view(np.uint64).tolist())) == sorted({*zip(which.tolist(), h.tolist())})
    lengths = [len(x) for x in found["places"].to_pylist()]
    rows = np.repeat(found["unit"].to_numpy(), lengths), np.repeat(found["hash"].to_numpy(), lengths).view(np.uint64), found["places"].combine_chunks().flatten().to_numpy()
    order = np.lexsort((rows[2], rows[0]))
    assert all((x[order] == y).all() for x, y in zip(rows, (which, h, pos)))
