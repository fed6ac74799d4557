"""The compact index against plain loops."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from strandlake.functions.kmers import KmerParams, kmer_hashes, mix, unmix
from strandlake.operators import compact

LETTERS = "ACDEFGHIKLMNPQRSTVWY"


@pytest.mark.parametrize("name", ["protein", "dayhoff", "diamond11"])
@pytest.mark.parametrize("k", [1, 2, 3, 4])
def test_codes_are_dense_and_turn_back(name, k):
    p = KmerParams(k, name)
    ranks = np.arange(len(p.letters.classes) ** k, dtype=np.uint64)
    hashes = compact.hashes_of(ranks, p)
    assert len(np.unique(hashes)) == len(ranks) and (compact.codes(hashes, p) == ranks).all() and (mix(unmix(hashes)) == hashes).all()


def test_codes_read_letters_as_digits():
    p = KmerParams(9)
    words = ["ACDEFGHIK", "YYYYYYYYY", "WVTSRQPNM"]
    _, _, h = kmer_hashes([w.encode() for w in words], p)
    assert compact.codes(h, p).tolist() == [sum(LETTERS.index(c) * 20 ** (8 - i) for i, c in enumerate(w)) for w in words]
    with pytest.raises(ValueError):
        compact.code_of("hash", KmerParams(32, "dna"))


def test_representatives(spark):
    rows = [(1, 1, "AC"), (1, 2, "ACDEF"), (2, 7, "AC"), (2, 5, "ACD"), (2, 4, "ACE"), (3, 9, None), (1, 3, None), (1, 2, "ACDEF")]
    got = compact.unit_representatives(spark.createDataFrame(rows, "unit long, id long, sequence string")).collect()
    assert {(r["unit"], r["rep"], r["sequence"], r["members"]) for r in got} == {(1, 1, "AC", 4), (2, 4, "ACE", 3), (3, 9, "", 1)}


def plain_windows(seqs, k, w):
    p = KmerParams(k)
    held = {u: {int(x): int(h) for _, x, h in zip(*kmer_hashes([s.encode()], p))} for u, s in seqs.items()}
    holders = Counter(h for places in held.values() for h in set(places.values()))
    out = set()
    for u, s in seqs.items():
        for start in range(max(len(s) - k - w + 2, 1)):
            inside = [(holders[h], h) for x, h in held[u].items() if start <= x < start + w]
            if inside:
                out.add((u, min(inside)[1]))
    return out


def test_rarest_keys_equal_a_plain_loop(spark):
    rng = np.random.default_rng(4)
    seqs = {u: "".join(rng.choice(list("ACDEXx"), rng.integers(0, 60))) for u in range(40)} | {90: "", 91: "AC", 92: "XXXXXXX", 93: "acdacdacd"}
    reps = spark.createDataFrame(list(seqs.items()), "unit long, sequence string")
    for k, w in ((3, 5), (2, 1), (4, 200)):
        got = compact.rarest_in_windows(reps, KmerParams(k), w).collect()
        assert len(got) == len(set(got))
        assert {(r["unit"], r["hash"] % 2**64) for r in got} == plain_windows(seqs, k, w)


def test_bits_merging_and_evidence(spark):
    p = KmerParams(3)
    seqs = [("AACDW",), ("aaaX",), (None,)]
    bits = compact.residue_bits(spark.createDataFrame(seqs, "sequence string"), p)
    assert abs(bits[0] - -math.log2(5 / 9)) < 1e-6 and abs(bits[LETTERS.index("W")] - -math.log2(1 / 9)) < 1e-6
    code = sum(LETTERS.index(c) * 20 ** (2 - i) for i, c in enumerate("DWA"))
    got = spark.createDataFrame([(code,)], "code long").select(compact.code_bits("code", bits, 3)).first()[0]
    assert abs(got - sum(bits[LETTERS.index(c)] for c in "DWA")) < 1e-9

    rng = np.random.default_rng(5)
    sizes = {0: 4, 1: 0, 2: 3, 5: 2}
    parts = sorted({(s, int(rng.integers(n)), int(rng.integers(6))) for s, n in sizes.items() for _ in range(8) if n})
    rows = [(s, u, c, 4.0 + c + 0.3 * u) for s, u, c in parts]
    base = {0: 0, 1: 4, 2: 4, 5: 7}
    held = Counter(c for _, _, c, _ in rows)
    want = {(c, base[s] + u): min(max(round((b - math.log2(held[c])) / 0.25), 0), 255) * 0.25 for s, u, c, b in rows}
    merged = compact.merge_shards(spark.createDataFrame(rows, "shard int, unit long, code long, bits0 double"), spark.createDataFrame(list(sizes.items()), "shard int, units long"))
    found = merged.collect()
    assert {(r["code"], r["unit"]): r["bits"] for r in found} == want and [(r["code"], r["unit"]) for r in found] == sorted(want)

    reads = [(r, int(c)) for r in range(9) for c in rng.integers(0, 9, 12)]
    charge, score, hits = math.log2(12), defaultdict(float), Counter()
    for r, c in set(reads):
        for (code, u), b in want.items():
            if code == c:
                score[r, u] += b
                hits[r, u] += 1
    got = compact.unit_evidence_bits(spark.createDataFrame(reads, "read long, code long"), merged).collect()
    assert {(r["read"], r["unit"]): r["hits"] for r in got} == hits
    assert all(abs(r["score"] - (score[r["read"], r["unit"]] - (r["hits"] - 1) * charge)) < 1e-9 for r in got)


def test_keys_of_nothing(spark):
    none = spark.createDataFrame([], "unit long, id long, sequence string")
    assert compact.compact_keys(none, KmerParams(3), 5, 4.0).count() == 0
    assert compact.compact_keys(spark.createDataFrame([(1, 1, None), (2, 2, "AC")], "unit long, id long, sequence string"), KmerParams(3), 5, 4.0).count() == 0
