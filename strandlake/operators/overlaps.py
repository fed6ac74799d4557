"""Spanning forests over the sets that share hashes, without a row for each pair of them.

Pairs are counted a block of sets at a time, where the lists of a block's hashes meet, and thinned to a forest there, so
that what is shuffled are lists of holders, and what is stored are a forest's edges for each block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import cut
from .blockwise import list_slices, running_sum
from .graph import _least_forest, boruvka, dense_ids

#: Pairs that a task counts and thins at a time.
STEP = 1_000_000
#: Sets whose sizes are in one row.
SIZES = 4096
#: In lists of gaps 0 ends a list, and this stands for one less with the gap not yet at its end.
MORE = 32_767


def overlap_forest(held: DataFrame, weigh: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], kind: str = "long", most_pairs: int = 32_000_000) -> DataFrame:
    """``a, b, weight`` of the minimum spanning forest that ``boruvka`` has of all pairs of sets (``set_id, hash``) that share a hash. ``weigh`` makes weights (of type ``kind``) of arrays: hashes shared, sizes of ``a``, sizes of ``b``.

    Sets are numbered in order and cut into blocks that lead up to ``most_pairs`` pairs with later sets, one for each hash
    that they share; a set that leads more is a block of its own. A block gets the holders of its hashes from its first
    on, as lists of gaps, and every set's size, so it sees all that its pairs share. Only where blocks begin reaches the
    driver. ``held`` is read twice and may have rows more than once.
    """
    sets = dense_ids(held.where("set_id is not null").select("set_id").distinct(), ["set_id"], "node")
    sets = cut(sets.select("set_id", F.col("node").cast("int").alias("node")))
    holders = held.join(sets, "set_id").groupBy("hash").agg(F.sort_array(F.collect_set("node")).alias("nodes"))
    every = cut(holders.select(F.col("hash").isNull().alias("none"), "nodes"))
    lists = every.where("not none and size(nodes) > 1").select("nodes")
    # A null is no hash that sets share, but counts in their sizes.
    after = F.when(F.col("none"), 0).otherwise(F.size("nodes") - 1 - F.col("i"))
    own = cut(every.select("none", "nodes", F.posexplode("nodes").alias("i", "node")).groupBy("node").agg(F.count(F.lit(1)).cast("int").alias("size"), F.sum(after).alias("pairs")))
    block = F.expr(f"before div {most_pairs}") * 2 + (F.col("pairs") > most_pairs).cast("int")
    found = running_sum(own.where("pairs > 0").drop("size"), ["node"], "pairs", "before").groupBy(block.alias("block")).agg(F.min("node").alias("first"), (F.max("pairs") > most_pairs).alias("alone")).orderBy("first").collect()
    starts, alone = np.array([r["first"] for r in found], np.int64), np.array([r["alone"] for r in found], bool)
    n = own.count()
    dealt = lists.mapInArrow(_dealer(starts), "block int, chunk int, items array<smallint>, sizes array<int>")
    chunks = own.groupBy(F.expr(f"node div {SIZES}").cast("int").alias("chunk")).agg(F.transform(F.sort_array(F.collect_list(F.struct("node", "size"))), lambda x: x["size"]).alias("sizes"))
    sizes = chunks.select(F.explode(F.sequence(F.lit(0), F.lit(len(found) - 1))).alias("block"), "chunk", F.lit(None).cast("array<smallint>").alias("items"), "sizes")
    edges = (dealt.unionByName(sizes) if found else dealt).groupBy("block").applyInArrow(_thinner(starts, alone, n, weigh, kind), f"a int, b int, weight {kind}")
    least = boruvka(edges)
    a, b = (sets.select(F.col("node").alias(x), F.col("set_id").alias(f"_{x}")) for x in "ab")
    return least.join(a, "a").join(b, "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"), "weight")


def _dealer(starts: np.ndarray):
    """Sorted lists of sets to the blocks of all their sets but the last: each block's lists from its first set on, as gaps from before its start."""

    def deal(batches):
        for batch in batches:
            for part in list_slices(batch, 0):
                lengths = part.column(0).value_lengths().to_numpy(zero_copy_only=False)
                nodes, ends = part.column(0).flatten().to_numpy().astype(np.int64), np.repeat(np.cumsum(lengths), lengths)
                block = np.searchsorted(starts, nodes, "right") - 1
                new = np.append(True, (block[1:] != block[:-1]) | (ends[1:] != ends[:-1])) & (np.arange(len(nodes)) + 1 < ends)
                at = np.flatnonzero(new)
                at = at[np.argsort(block[at], kind="stable")]
                far = np.cumsum(ends[at] - at)
                lo = 0
                while lo < len(at):
                    hi = max(int(np.searchsorted(far, (far[lo - 1] if lo else 0) + STEP, "right")), lo + 1)
                    yield _coded(nodes, at[lo:hi], ends[at[lo:hi]], block[at[lo:hi]], starts)
                    lo = hi

    return deal


def _coded(nodes: np.ndarray, at: np.ndarray, ends: np.ndarray, block: np.ndarray, starts: np.ndarray) -> pa.RecordBatch:
    """A row for each block of the lists ``nodes[at:ends]``, which are in the order of their blocks."""
    n = ends - at
    stop = np.cumsum(n)
    idx = np.repeat(at - stop + n, n) + np.arange(stop[-1])
    before = nodes[idx - 1]
    before[stop - n] = starts[block] - 1
    more, rest = np.divmod(nodes[idx] - before - 1, MORE - 1)
    size = more + 1
    size[stop - 1] += 1  # the 0 that ends a list
    to = np.cumsum(size)
    codes = np.full(to[-1], MORE, np.int16)
    own = to - 1
    codes[own[stop - 1]] = 0
    own[stop - 1] -= 1
    codes[own] = rest + 1
    last = np.flatnonzero(np.append(block[1:] != block[:-1], True))
    items = pa.ListArray.from_arrays(pa.array(np.append(0, to[stop[last] - 1]).astype(np.int32)), pa.array(codes))
    rows = len(last)
    return pa.record_batch([pa.array(block[last].astype(np.int32)), pa.nulls(rows, pa.int32()), items, pa.nulls(rows, pa.list_(pa.int32()))], ["block", "chunk", "items", "sizes"])


def _decoded(codes: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """Sets, and how many each list has."""
    end = codes == 0
    at = np.cumsum(np.where(codes == MORE, MORE - 1, codes), dtype=np.int64)
    own = ~end & (codes != MORE)
    n = np.diff(np.append(0, np.cumsum(own)[end]))
    base = np.append(0, at[end][:-1])
    return (at[own] - np.repeat(base, n) + start - 1).astype(np.int32), n


def _thinner(starts: np.ndarray, alone: np.ndarray, n: int, weigh, kind: str):
    """The least forest of the pairs that a block leads."""
    dtype = np.int64 if kind == "long" else np.float64

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, flat, lengths, at, total = np.zeros(n, np.int32), [], [], None, None
        for batch in (b for b in batches if b.num_rows):
            at = batch.column("block")[0].as_py()
            for i in np.flatnonzero(batch.column("chunk").is_valid().to_numpy(zero_copy_only=False)):
                own = batch.column("sizes")[i].values.to_numpy()
                lo = batch.column("chunk")[i].as_py() * SIZES
                size[lo : lo + len(own)] = own
            lists = batch.filter(batch.column("items").is_valid())
            for part in list_slices(lists, lists.schema.get_field_index("items")):
                nodes, count = _decoded(part.column("items").flatten().to_numpy(), int(starts[at]))
                if alone[at]:  # each list is the set itself and then who it meets
                    total = (0 if total is None else total) + np.bincount(nodes, minlength=n)
                else:
                    flat.append(nodes)
                    lengths.append(count)
        if alone[at]:
            total[starts[at]] = 0
            b = np.flatnonzero(total)
            pairs = iter([(np.full(len(b), starts[at]), b, total[b])])
        else:
            flat, lengths = np.concatenate(flat), np.concatenate(lengths)  # the parts go
            pairs = _counted(flat, lengths, starts[at + 1] if at + 1 < len(starts) else n, n)
        a, b, w, cycles, new = *np.zeros((2, 0), np.int64), np.zeros(0, dtype), None, []
        for x, y, shared in pairs:
            z = weigh(shared, size[x].astype(np.int64), size[y].astype(np.int64)).astype(dtype)
            if cycles is not None:
                own = ~cycles(x, y, z)
                x, y, z = x[own], y[own], z[own]
            new.append((x, y, z))
            if sum(len(x) for x, *_ in new) >= max(STEP // 10, len(a)):
                a, b, w = _least([(a, b, w), *new])
                cycles, new = _cycles(a, b, w, n), []
        a, b, w = _least([(a, b, w), *new])
        yield pa.record_batch([pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(w)], ["a", "b", "weight"])

    return thin


def _least(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    a, b, w = map(np.concatenate, zip(*parts))
    own = _least_forest(a, b, w)
    return a[own], b[own], w[own]


def _counted(flat: np.ndarray, lengths: np.ndarray, stop: int, n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of sets and how many lists have both, of all pairs whose first is below ``stop``: up to ``STEP`` (or one set's) before they are added up at a time."""
    ends = np.cumsum(lengths)
    lead = np.flatnonzero(flat < stop)
    lead = lead[np.argsort(flat[lead], kind="stable")]
    after = ends[np.searchsorted(ends, lead, "right")] - lead - 1
    sums = np.cumsum(after)
    last = np.flatnonzero(np.append(np.diff(flat[lead]) != 0, True))  # of each set
    shift, lo = int(n).bit_length(), 0
    first = 0
    while first < len(last):
        # A first step is small: what it leaves thins the next.
        done = sums[lo - 1] if lo else 0
        upto = max(int(np.searchsorted(sums[last], done + (STEP if lo else STEP // 10), "right")), first + 1)
        hi = last[upto - 1] + 1
        p, c = lead[lo:hi], after[lo:hi]
        other = np.repeat(p + 1 - (sums[lo:hi] - c - done), c) + np.arange(sums[hi - 1] - done)
        key = np.repeat(flat[p].astype(np.int64) << shift, c) | flat[other]
        key.sort()
        new = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
        yield key[new] >> shift, key[new] & ((1 << shift) - 1), np.diff(np.append(new, len(key)))
        lo, first = hi, upto


def _cycles(a: np.ndarray, b: np.ndarray, weight: np.ndarray, n: int, levels: int = 16):
    """Whether an edge surely closes a cycle with lighter ones of a forest (by rising weight): its ends are joined by edges below a level that it has reached. Some that do so between two levels are missed."""
    if not len(a):
        return lambda x, y, w: np.zeros(len(x), bool)
    bars = np.unique(weight[np.linspace(0, len(a) - 1, levels).astype(np.int64)])
    cuts = [*np.searchsorted(weight, bars, "left"), len(a)]  # what is lighter than each; all is lighter than what is heavier than the last
    label, labels, lo = np.arange(n, dtype=np.int32), [], 0
    for hi in cuts:
        label = _joined(label, a[lo:hi], b[lo:hi])
        labels.append(label)
        lo = hi
    labels = np.stack(labels)

    def closes(x, y, w):
        level = np.searchsorted(bars, w, "right") - 1 + (w > bars[-1])
        at = np.maximum(level, 0)
        return (level >= 0) & (labels[at, x] == labels[at, y])

    return closes


def _joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``label``, each the least of its component, after edges have joined components."""
    label = label.copy()
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        np.minimum.at(label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (up := label[label]).tobytes() != label.tobytes():
            label = up
