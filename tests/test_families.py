"""Families: small cases worked out by hand or by plain loops."""

import math
import random

import numpy as np
import pytest

from strandlake.functions.kmers import KmerParams
from strandlake.operators import families as fam
from strandlake.operators.identity import SurvivalModel


def test_frames_and_columns():
    assert fam.open_frames("MK*A**LV", 1) == [(0, "MK"), (3, "A"), (6, "LV")] and fam.open_frames("MK*A", 2) == [(0, "MK")]
    assert fam.profile_columns(3, 2, "2M1I1D1M", "xABCD") == [(2, "A"), (3, "B"), (4, "-"), (5, "D")]


def test_entropy(spark):
    rows = [(1, 0, x) for x in "AACC"] + [(1, 1, x) for x in "AAAA-"]
    got = {r.col: (r.n, r.entropy, r.rank) for r in fam.column_ranks(spark.createDataFrame(rows, "family long, col long, residue string")).collect()}
    assert got == {0: (4, 1.0, 1), 1: (4, 0.0, 2)}
    assert fam.greedy_columns(["AAC", "ACC", "CAC", "CCC"], 2, 1) == [(0, 1)]


def test_agreement(spark):
    hits = spark.createDataFrame([(1, 0, c, "ACDE"[c]) for c in range(4)], "read long, family long, col long, residue string")
    truth = spark.createDataFrame([(u, 0, c, x) for u, s in ((7, "ACDE"), (8, "ACDK"), (9, "A")) for c, x in enumerate(s)], "unit long, family long, col long, residue string")
    assert [(r.unit, r.identity) for r in fam.column_agreement(hits, truth).collect()] == [(7, 1.0)]


def test_weak_bar(spark):
    df = lambda x: spark.createDataFrame([(float(v),) for v in x], "score double")
    assert fam.weak_bar(df([1, 2, 3, 4, 5, 6]), df([1, 1, 2, 3]), 0.25) == 3.0
    assert fam.weak_bar(df([1]), df([5]), 0.1) == math.inf


def test_surprisal(spark):
    df = spark.createDataFrame([(1, "ACXAA")], "id long, sequence string")
    got = fam.surprisal(df, KmerParams(2), ["id"], {"A": 0.5, "C": 0.25}).collect()
    assert sorted(r.bits for r in got) == [2.0, 3.0]


def test_alphabets():
    q, sub = np.full(6, 1 / 6), np.full((6, 6), 0.01)
    for i in (0, 2, 4):
        sub[i, i + 1] = sub[i + 1, i] = 1.0
    c = fam.optimised_alphabet(3, q, sub)
    assert c[0] == c[1] and c[2] == c[3] and c[4] == c[5] and len(set(c)) == 3


def test_centroids(spark):
    k = [(0, 1, h) for h in range(10)] + [(0, 2, h) for h in range(5, 11)] + [(0, 3, h) for h in range(10, 20)]
    n = spark.createDataFrame([(1, 30), (2, 20), (3, 10)], "id long, length long")
    got = {r.id: r.centre for r in fam.centroids(spark.createDataFrame(k, "component long, id long, hash long"), n, 0.5).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_neighbourhoods_and_keys(spark):
    forest = spark.createDataFrame([(1, 2, 1.0), (2, 3, 5.0)], "a long, b long, weight double")
    nodes = spark.createDataFrame([(1,), (2,), (3,)], "node long")
    assert {r.node: r.component for r in fam.neighbourhoods(forest, nodes, 2.0).collect()} == {1: 1, 2: 1, 3: 3}
    held = spark.createDataFrame([(1, 5), (2, 5), (1, 6)], "id long, hash long")
    groups = spark.createDataFrame([(1, 0), (2, 0), (3, 0)], "id long, group long")
    assert [tuple(r) for r in fam.soft_keys(held, groups, 0.5).collect()] == [(0, 5)]


def test_held_out(spark):
    rng = random.Random(1)
    rows = [(i, rng.randrange(100), rng.random()) for i in range(100)]
    rows = [r for r in rows if r[0] != r[1]]
    got = fam.held_out(spark.createDataFrame(rows, "id long, relative long, identity double"), [0.3, 0.6], 10).collect()
    ids = {r.id for r in got}
    assert not ids & {r.relative for r in got} and all(sum(r.bin == b for r in got) <= 10 for b in (0.3, 0.6))
    assert all(dict((a, c) for a, _, c in rows)[r.id] >= r.bin for r in got) and len(got) > 10


def test_scores(spark):
    truth = spark.createDataFrame([(1, 0, 3.0), (2, 0, 1.0)], "unit long, component long, abundance double")
    found = spark.createDataFrame([(1, 0, 1.0), (3, 0, 1.0)], "unit long, component long, abundance double")
    assert fam.split_scores(truth, found).first().l1 == pytest.approx(1.0)
    groups = spark.createDataFrame([(1, 9), (3, 9), (4, 8)], "unit long, group long")
    assert tuple(fam.group_scores(truth, groups).first()) == (2, 1, 0.25)
    p = spark.createDataFrame([(1, 0.9), (3, 0.1)], "unit long, present_prob double")
    assert {r.true: r.mean_presence for r in fam.presence_scores(p, truth).collect()} == {True: 0.9, False: 0.1}


def test_pair_survival(spark):
    members = spark.createDataFrame([(1, "c", "ACDEFG"), (2, "c", "ACDEWW")], "id long, cluster string, sequence string")
    pairs = spark.createDataFrame([(1, "c", 0.7)], "id long, cluster string, identity double")
    r = fam.pair_survival(pairs, members, KmerParams(3), (1,)).first()
    assert (r.shared, r.n_kmers, r.window_survival) == (2, 4, 0.5) and r.both_1 == pytest.approx(1 / 3)


def test_pair_survival_stores_no_windows(spark, monkeypatch):
    """Own and other clusters, a member of two, texts without k-mers and unknown ids, against a plain loop; what is stored are texts and pairs."""
    rng = random.Random(8)
    members = [(i, c, "".join(rng.choice("ACDEX") for _ in range(rng.randrange(12)))) for i in range(12) for c in [rng.choice("abc")]]
    members += [(3, "z", members[3][2]), (20, "a", None), (21, "b", "AC")]
    pairs = [(i, c, 0.5) for i in (*range(12), 20, 21, 99) for c in "abcyz"]
    texts = {i: s or "" for i, _, s in members}
    words = lambda s: [s[k : k + 3] for k in range(len(s) - 2) if "X" not in s[k : k + 3]]
    want = {}
    for i, c, _ in pairs:
        if w := words(texts.get(i, "")):
            there = {x for j, d, s in members if d == c and j != i for x in words(s or "")}
            f = [x in there for x in w]
            both = [a and b for a, b in zip(f, f[2:])]
            want[i, c] = (len(set(w) & there), len(set(w)), round(sum(f) / len(f), 9), round(sum(both) / len(both), 9) if both else None)
    stored = []
    monkeypatch.setattr(fam, "cut", lambda df, real=fam.cut: stored.append(df.columns) or real(df))
    got = fam.pair_survival(spark.createDataFrame(pairs, "id long, cluster string, identity double"), spark.createDataFrame(members, "id long, cluster string, sequence string"), KmerParams(3), (2,)).collect()
    assert {(r.id, r.cluster): (r.shared, r.n_kmers, round(r.window_survival, 9), r.both_2 if r.both_2 is None else round(r.both_2, 9)) for r in got} == want and len(got) == len(want)
    assert any(0 < v[2] < 1 for v in want.values()) and not any("pos" in c or "hash" in c for c in stored)


def test_survival_fit():
    true = SurvivalModel(5, shape=0.8, region=4.0)
    points = [(a, float(true.survival(a)), 1.0) for a in (0.5, 0.6, 0.7, 0.8, 0.9)]
    got = fam.fit_survival(points, 5, steps=6)
    assert max(abs(float(got.survival(a)) - s) for a, s, _ in points) < 0.01
