"""Alignment kernels and sketches against plain recursions."""

import random
from functools import lru_cache

import numpy as np
import pytest

from strandlake.functions.kmers import KmerParams
from strandlake.operators import align, sketch
from strandlake.sources.alignments import btop_columns

M = align.class_matrix()


def brute_affine(a, b, open_=11, extend=1):
    @lru_cache(None)
    def f(i, j, state):
        if i == len(a) and j == len(b):
            return 0
        out = [-(10**9)]
        if i < len(a) and j < len(b):
            out.append(int(M[ord(a[i]), ord(b[j])]) + f(i + 1, j + 1, "M"))
        if i < len(a):
            out.append(-extend - (open_ if state != "I" else 0) + f(i + 1, j, "I"))
        if j < len(b):
            out.append(-extend - (open_ if state != "D" else 0) + f(i, j + 1, "D"))
        return max(out)

    return f(0, 0, "M")


@pytest.mark.parametrize("seed", range(40))
def test_affine(seed):
    rng = random.Random(seed)
    a, b = ("".join(rng.choices("ACDK", k=rng.randint(0, 9))) for _ in range(2))
    open_ = rng.choice([2, 11])
    score, ops = align.global_affine(a, b, M, open_, 1)
    assert score == brute_affine(a, b, open_, 1)
    assert ops.count("M") + ops.count("I") == len(a) and ops.count("M") + ops.count("D") == len(b)


def test_ungapped_and_overlap():
    rng = random.Random(1)
    for _ in range(50):
        a, b = ("".join(rng.choices("ACDK", k=rng.randint(0, 10))) for _ in range(2))
        want = max([0, *(sum(int(M[ord(x), ord(y)]) for x, y in zip(a[i : i + n], b[j : j + n])) for i in range(len(a)) for j in range(len(b)) for n in range(1, min(len(a) - i, len(b) - j) + 1))])
        assert align.ungapped(a, b, M)[0] == want
    assert align.overlap_identity("MKLVACDE", "MKLVACDE") == (1.0, 8)
    assert align.overlap_identity("MKLVAC", "LVACDE") == (1.0, 4)
    identity, columns = align.overlap_identity("MKLVACDEFG", "MKLVCDEFG")
    assert columns == 10 and identity == pytest.approx(0.9)
    assert align.overlap_identity("", "A") == (0.0, 0)


def test_seed_alignment():
    rng = random.Random(2)
    base = "".join(rng.choices("ACDEFGHIKLMNPQRSTVWY", k=60))
    query = base[5:25] + base[28:40] + "W" + base[41:55]
    score, q0, q1, s0, s1, btop = align.seed_align(query, base, M)
    cols, events = btop_columns(btop, s0 + 1, base)
    rebuilt = "".join(r for _, r in cols if r != "-")
    assert rebuilt == query[q0:q1] and not events and (cols[0][0], cols[-1][0] + 1) == (s0, s1)
    assert align.seed_align("ACDE", "WWWW", M) is None
    near, far = (align.pseudo_score(query, x, m) for m in ("band",) for x in (base, base[::-1]))
    assert near > far
    for m in ("chain", "pairs", "ungapped", "affine"):
        assert align.pseudo_score(query, base, m) > align.pseudo_score(query, base[::-1], m)


def test_murmur():
    word = lambda s: np.frombuffer(s, np.uint8)[None]
    assert int(sketch.murmur64(word(b"hello"), 0)[0]) == 0xCBD8A7B341BD9B02
    assert int(sketch.murmur64(word(b""), 0)[0]) == 0
    assert int(sketch.murmur64(word(b"The quick brown fox jumps over the lazy dog"), 0)[0]) == 0xE34BBC7BBC071B6C


def test_bloom(spark):
    keys = spark.range(2000).selectExpr("xxhash64(id) as hash")
    blocks = sketch.bloom_blocks(2000)
    table = sketch.bloom_table(keys, blocks)
    assert sketch.bloom_contains(keys, table, blocks).count() == 2000
    others = spark.range(10_000, 30_000).selectExpr("xxhash64(id) as hash")
    assert sketch.bloom_contains(others, table, blocks).count() < 600


def test_clusters(spark):
    rng = random.Random(3)
    rows = []
    for f in range(4):
        base = "".join(rng.choices("ACDEFGHIKLMNPQRSTVWY", k=120))
        for i in range(4):
            s = list(base[: 120 - 3 * i])
            s[rng.randrange(len(s))] = "W"
            rows.append((f"f{f}m{i}", "".join(s)))
    got = {r.target_id: r.group for r in sketch.linear_clusters(spark.createDataFrame(rows, "target_id string, sequence string"), KmerParams(5)).collect()}
    assert all(got[f"f{f}m{i}"] == f"f{f}m0" for f in range(4) for i in range(4))


def test_generators(spark):
    df = spark.createDataFrame([(i, "ACDEFGHIKL" * 50) for i in range(4)], "id long, sequence string")
    a, b = (sketch.mutated(df, 0.9, 7).orderBy("id").collect() for _ in range(2))
    assert a == b and len({r.sequence for r in a}) == 4
    share = sum(x == y for r in a for x, y in zip(r.sequence, "ACDEFGHIKL" * 50)) / 2000
    assert abs(share - 0.9) < 0.03
    g = spark.createDataFrame([("g", "ACGTTGCA" * 20, 2.0)], "name string, seq string, depth double")
    got = sketch.simulated_reads(g, 40).collect()
    assert len(got) == 8 and all(len(r.seq) == 40 for r in got)


def test_handoff(spark):
    sam = spark.createDataFrame([("r", "c", False, 1, 256, 0, 5.0), ("r", "c", False, 9, 0, 0, 7.0), ("r", "d", False, 1, 0, 0, 9.0)], "qname string, rname string, mate boolean, pos int, flag int, mapq int, score double")
    got = sketch.handoff_records(sam, spark.createDataFrame([("r", "c", 0.999)], "qname string, rname string, posterior double")).collect()
    assert [(r.pos, r.flag, r.mapq) for r in got] == [(9, 0, 30)]


def test_relatives(spark):
    rows = [(1, h) for h in range(10)] + [(2, h) for h in range(5)] + [(3, h) for h in range(8, 10)]
    got = sketch.nearest_relatives(spark.createDataFrame(rows, "id long, hash long"), top=1).orderBy("id").collect()
    assert [(r.id, r.other, r.shared) for r in got] == [(1, 2, 5), (2, 1, 5), (3, 1, 2)]
    e = sketch.unit_evidence(spark.createDataFrame([(1, 5), (1, 6)], "read long, hash long"), spark.createDataFrame([(5, 9, 3.0), (6, 9, 2.0)], "hash long, unit long, bits double"), 1.5)
    assert e.first().score == 3.5


def test_chains_are_longest_and_fast():
    """Against all pairs of seeds on small input; a hundred thousand seeds take well under a second of work each."""
    import random
    import time

    from strandlake.operators.align import chain

    rng = random.Random(6)
    for _ in range(300):
        seeds = [(rng.randrange(12), rng.randrange(12)) for _ in range(rng.randrange(0, 25))]
        got = chain(seeds, 3)
        if not seeds:
            assert got == []
            continue
        on = {}
        for i, j in set(seeds):
            on[j - i] = on.get(j - i, 0) + 1
        centre = min(on, key=lambda d: (-on[d], d))
        own = sorted({s for s in seeds if abs(s[1] - s[0] - centre) <= 3})
        longest = {}
        for i, j in own:
            longest[i, j] = 1 + max((n for (p, q), n in longest.items() if p < i and q < j), default=0)
        assert len(got) == max(longest.values()) and set(got) <= set(own)
        assert all(a[0] < b[0] and a[1] < b[1] for a, b in zip(got, got[1:]))
    many = [(i + rng.randrange(3), i + rng.randrange(3)) for i in range(100_000)]
    began = time.process_time()
    assert len(chain(many)) > 30_000
    assert time.process_time() - began < 3
