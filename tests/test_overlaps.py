"""Forests of sets that share hashes: equal to Kruskal's over all pairs, which are never rows."""

import random

import numpy as np
import pyarrow as pa
import pytest

from strandlake.operators import graph, overlaps
from strandlake.plans.registry import QUERIES


def kruskal(sets, weigh):
    """The forest of all pairs that share a hash, by a plain loop."""
    ids = sorted(sets)
    size = {s: len(sets[s]) for s in ids}
    shared = lambda a, b: len({h for h in sets[a] & sets[b] if h is not None})
    pairs = [(i, j, weigh(shared(a, b), size[a], size[b])) for i, a in enumerate(ids) for j, b in enumerate(ids) if a < b and shared(a, b)]
    return sorted((ids[a], ids[b], w) for a, b, w in graph.spanning_forest(pairs, len(ids)))


@pytest.mark.parametrize("most", [32_000_000, 300, 40])
def test_forest_of_overlaps_is_kruskals(spark, most):
    """In one block, in many, and with sets that are blocks of their own; null hashes count in sizes alone."""
    rng = random.Random(9)
    sets = {i * 7 - 50: {rng.randrange(60) for _ in range(rng.randint(1, 9))} for i in range(80)}
    sets |= {3000: set(range(60)), -4000: set(range(0, 60, 2)), 5000: {1000}, 5001: {1001, None}, 5002: {1001, None, 1002}, 5003: {None}}
    held = spark.createDataFrame([(s, h) for s, hs in sets.items() for h in hs] * 2 + [(None, 3), (None, None)], "set_id long, hash long")
    got = sorted(map(tuple, overlaps.overlap_forest(held, lambda n, x, y: x + y - 2 * n, most_pairs=most).collect()))
    assert got == kruskal(sets, lambda n, x, y: x + y - 2 * n)
    got = sorted(map(tuple, overlaps.overlap_forest(held, lambda n, x, y: -(n / np.minimum(x, y)), "double", most).collect()))
    assert got == kruskal(sets, lambda n, x, y: -(n / min(x, y)))


def test_sets_that_share_nothing_have_no_forest(spark):
    held = spark.createDataFrame([(1, 1), (2, 2), (3, None), (4, None)], "set_id long, hash long")
    assert overlaps.overlap_forest(held, lambda n, x, y: x + y).collect() == []
    assert overlaps.overlap_forest(held.limit(0), lambda n, x, y: x + y).collect() == []


@pytest.mark.parametrize("step", [3, 40, 10**6])
def test_blocks_in_steps_lose_no_pair(monkeypatch, step):
    """Lists go to the blocks of their sets, over wide gaps too; steps of any size count each pair once and keep its least forest."""
    monkeypatch.setattr(overlaps, "STEP", step)
    rng = random.Random(step)
    n, starts, alone = 200_000, np.array([3, 40_000, 120_000, 120_001]), np.array([False, False, True, False])
    pool = [3, 5, 9, 39_999, 40_000, 72_765, 72_766, 105_531, 105_532, 119_999, 120_000, 120_001, 150_000, 199_999, *rng.sample(range(4, n), 20)]
    lists = [sorted({*rng.sample(pool, rng.randint(2, 12)), *([120_000] if i % 2 else [])}) for i in range(60)]
    size = np.zeros(n, np.int64)
    for x in pool:
        size[x] = rng.randint(20, 24)
    shared = {}
    for x in lists:
        for i, a in enumerate(x):
            for b in x[i + 1 :]:
                shared[a, b] = shared.get((a, b), 0) + 1
    weigh = lambda k, x, y: x + y - 2 * k
    rows = list(overlaps._dealer(starts)([pa.record_batch([pa.array(lists[:25], pa.list_(pa.int32()))], ["nodes"]), pa.record_batch([pa.array(lists[25:], pa.list_(pa.int32()))], ["nodes"])]))
    sizes = [(c, size[c * overlaps.SIZES : (c + 1) * overlaps.SIZES].tolist()) for c in range(-(-n // overlaps.SIZES))]
    seen, found = {}, []
    for block in range(4):
        own = pa.table([pa.array([block] * len(sizes), pa.int32()), pa.array([c for c, _ in sizes], pa.int32()), pa.nulls(len(sizes), pa.list_(pa.int16())), pa.array([s for _, s in sizes], pa.list_(pa.int32()))], ["block", "chunk", "items", "sizes"])
        mine = [own.to_batches()[0], *(b.filter(pa.compute.equal(b.column("block"), block)) for b in rows)]

        def spied(k, x, y, weigh=weigh):
            seen["n"] = seen.get("n", 0) + len(k)
            return weigh(k, x, y)

        for out in overlaps._thinner(starts, alone, n, spied, "long")(b for b in mine if b.num_rows):
            found += zip(*(c.to_pylist() for c in out.columns))
    assert seen["n"] == len(shared)
    want = graph.spanning_forest([(*p, int(weigh(k, size[p[0]], size[p[1]]))) for p, k in shared.items()], n)
    assert sorted(graph.spanning_forest(found, n)) == sorted(want) and {(a, b) for a, b, _ in found} <= set(shared)


@pytest.fixture
def supplies(spark, tmp_path):
    """Suppliers any two of which sell some part in common."""
    rng = random.Random(2)
    rows = [(p, s) for s in range(60) for p in rng.sample(range(40), 22)]
    spark.createDataFrame(rows, "l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    return str(tmp_path), {s: {p for p, t in rows if t == s} for s in range(60)}


@pytest.fixture
def stored(monkeypatch):
    """Rows of each table that graphs store."""
    rows, real = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: rows.append((out := real(df)).count()) or out)
    return rows


def test_link_cuts_stores_no_row_for_each_pair(spark, supplies, stored):
    path, sets = supplies
    got = {r.strength: (r.components, r.largest) for r in QUERIES["link_cuts"](spark, path).collect()}
    assert got == {s: (1, 60) for s in (0.0, 0.05, 0.1, 0.3)} and max(stored) < 60 * 59 / 2 / 10


def test_minimum_spanning_forest_stores_no_row_for_each_pair(spark, supplies, stored):
    path, sets = supplies
    got = sorted(map(tuple, QUERIES["minimum_spanning_forest"](spark, path).collect()))
    assert got == kruskal(sets, lambda n, x, y: x + y - 2 * n) and max(stored) < 60 * 59 / 2 / 10
