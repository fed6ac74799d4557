"""Cuts, restrictions and covers of trees against recursive versions on random trees."""

import math
import random

from pyspark.sql import functions as F

from strandlake.operators import subtrees


def random_tree(rng, n):
    """Nodes (lo, hi, up_lo, up_hi) of a random binary tree over n leaves, and each leaf's path."""
    nodes, paths = [], {}
    todo = [(0, n, None, ())]
    while todo:
        lo, hi, up, path = todo.pop()
        nodes.append((lo, hi, *(up or (None, None))))
        path = (*path, (lo, hi))
        if hi - lo == 1:
            paths[lo] = path
            continue
        mid = rng.randrange(lo + 1, hi)
        todo += [(lo, mid, (lo, hi), path), (mid, hi, (lo, hi), path)]
    return nodes, paths


NODES = "lo long, hi long, up_lo long, up_hi long"


def test_cut_by_budget(spark):
    rng = random.Random(1)
    nodes, _ = random_tree(rng, 120)
    size = [rng.randrange(0, 30) for _ in range(120)]
    leaves = spark.createDataFrame(list(enumerate(size)), "pos long, size long")
    kids = {}
    for lo, hi, a, b in nodes:
        kids.setdefault((a, b), []).append((lo, hi))
    for budget in (0, 25, 100, 10**6):
        want, todo = set(), [(0, 120)]
        while todo:
            x = todo.pop()
            total = sum(size[x[0] : x[1]])
            if total <= budget or x[1] - x[0] == 1:
                want.add((*x, total))
            else:
                todo += kids[x]
        assert {tuple(r) for r in subtrees.budget_chunks(spark.createDataFrame(nodes, NODES), leaves, budget).collect()} == want


def test_restriction(spark):
    rng = random.Random(2)
    nodes, _ = random_tree(rng, 60)
    leaves = spark.createDataFrame([(i,) for i in range(60)], "pos long")
    for chosen in (sorted(rng.sample(range(60), 17)), [5], list(range(60))):
        ranges = {}
        for lo, hi, *_ in nodes:
            a, b = sum(c < lo for c in chosen), sum(c < hi for c in chosen)
            if b > a:
                ranges[a, b] = None
        for a, b in ranges:
            over = [r for r in ranges if r[0] <= a and b <= r[1] and r != (a, b)]
            ranges[a, b] = min(over, key=lambda r: r[1] - r[0]) if over else (None, None)
        got = subtrees.restricted_tree(spark.createDataFrame(nodes, NODES), leaves, spark.createDataFrame([(c,) for c in chosen], "pos long"))
        assert {(r["lo"], r["hi"]): (r["up_lo"], r["up_hi"]) for r in got.collect()} == ranges and got.count() == 2 * len(chosen) - 1


def plain_cover(held, nodes, least, z):
    """Counts anew for every pick, and the smallest node over the ties by looking at all nodes."""
    own, scale = {}, {}
    for p, h, w, n in held:
        own.setdefault(p, set()).add(h)
        scale[p] = max(w, 1) / max(n, 1)
    live, out = {h for x in own.values() for h in x}, []
    while True:
        left = {p: len(x & live) for p, x in own.items()}
        best = min(left, key=lambda p: (-left[p] * scale[p], p))
        if left[best] < least:
            return out
        bar = left[best] * scale[best] - z * math.sqrt(left[best]) * scale[best]
        tied = [p for p in own if own[p] & own[best] & live and left[p] * scale[p] >= bar]
        gone = set().union(*(own[p] & live for p in tied))
        lo, hi = min(((a, b) for a, b, *_ in nodes if a <= min(tied) and max(tied) < b), key=lambda r: r[1] - r[0])
        out.append((len(out), best, round(left[best] * scale[best], 9), len(gone), len(tied), lo, hi))
        live -= gone


def test_cover_with_ties_and_their_common_subtree(spark):
    rng = random.Random(3)
    want, rows, trees = {}, [], []
    for component in range(4):
        n = 25
        nodes, paths = random_tree(rng, n)
        base = component * 1000
        held = []
        for p in range(n):
            for h in rng.sample(range(60), rng.randrange(1, 15)):
                held.append((p, base + h))
            if p % 5 == 1:  # a planted tie: the leaf before has the same k-mers
                held = [x for x in held if x[0] not in (p,)] + [(p, h) for q, h in held if q == p - 1]
        size = {p: 10 if component % 2 else 8 + p % 3 for p in range(n)}
        held = sorted({(p, h, 40, size[p]) for p, h in held})
        want[component] = plain_cover(held, nodes, 2, 0.5)
        rows += [(component, *x) for x in held] + [(component, *x) for x in held[:5]]
        trees += [(component, p, [{"lo": a, "hi": b} for a, b in path]) for p, path in paths.items()]
    got = subtrees.tied_cover(
        spark.createDataFrame(rows, "component long, pos long, hash long, windows long, size long"), spark.createDataFrame(trees, "component long, pos long, path array<struct<lo: long, hi: long>>"), 2, 0.5
    ).orderBy("component", "rank")
    found = {}
    for r in got.collect():
        found.setdefault(r["component"], []).append((r["rank"], r["pos"], round(r["score"], 9), r["kmers"], r["tied"], r["lo"], r["hi"]))
    assert found == want and any(x[4] > 1 for x in found[1])


def test_nodes_of_paths(spark):
    nodes, paths = random_tree(random.Random(4), 9)
    leaves = spark.createDataFrame([([{"lo": a, "hi": b} for a, b in p],) for p in paths.values()], "path array<struct<lo: long, hi: long>>")
    assert {tuple(r) for r in subtrees.nodes_of(leaves).select("lo", "hi", "up_lo", "up_hi").collect()} == set(nodes)
    assert subtrees.nodes_of(leaves.where(F.lit(False))).count() == 0
