"""Spanning forests as binary trees of leaf ranges, and their cut into coherent pieces.

A tree is laid out by its Euler tour: every edge is an arc down and one up, each arc names the one that follows it, and
places come from how many arcs are left after each. That is found by doubling, so neither depth nor a hub costs a loop,
and no tree passes through one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import cut
from .blockwise import list_slices, running_sum


def list_ranks(links: DataFrame) -> DataFrame:
    """``id, end, after`` of chains ``id, next`` (null at an end): the last row of each row's chain, and how many rows come after it.

    By pointer doubling. Rows that still jump have all gone equally far, so no two of them land on one row, and what has
    reached its end joins no more: no key of the join is hot. Raises ValueError if rows form a ring.
    """
    done = F.col("next").isNull()
    state = cut(links.select("id", F.coalesce("next", "id").alias("to"), F.when(done, 0).otherwise(1).cast("long").alias("after"), done.alias("done")))
    # A jump is twice as far each round, so a chain of all rows ends by then.
    for _ in range(state.count().bit_length() + 1):
        if state.where("not done").isEmpty():
            return state.select("id", F.col("to").alias("end"), "after")
        there = state.select(F.col("id").alias("to"), F.col("to").alias("_to"), F.col("after").alias("_after"), F.col("done").alias("_done"))
        moved = state.where("not done").join(there, "to").select("id", F.col("_to").alias("to"), (F.col("after") + F.col("_after")).alias("after"), F.col("_done").alias("done"))
        state = cut(state.where("done").unionByName(moved))
    raise ValueError("a ring has no end")


def _followed(arcs: DataFrame, order: list[str]) -> DataFrame:
    """``arcs`` (from ``v``) numbered in the order of ``v`` and then ``order``: ``i``, and ``_next``, the node that the next arc from the same ``v`` leads to. By positions, not by a window over a node that may be a hub."""
    at = cut(running_sum(arcs.withColumn("_1", F.lit(1).cast("long")), ["v", *order], "_1", "i").drop("_1"))
    later = at.select((F.col("i") - 1).alias("i"), F.col("v").alias("_v"), F.col("u").alias("_next"))
    return cut(at.join(later, "i", "left").withColumn("_next", F.when(F.col("_v") == F.col("v"), F.col("_next"))).drop("_v"))


def rooted(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """``node, parent, weight`` (null at roots) ``, root, pos, hi``: the forest ``edges`` (``a, b, weight``) laid out depth first from ``roots`` (``node``: one of each tree, nodes without edges too), lightest edge first, then smaller node.

    ``pos`` numbers the nodes of all trees, these in the order of their roots, and [pos, hi) holds a node's subtree. Edges
    must form no cycle, and every tree needs a root: else ValueError, or nodes are left out.
    """
    pair = lambda a, b: F.struct(F.col(a).alias("u"), F.col(b).alias("v"))
    both = edges.select(F.col("a").alias("v"), F.col("b").alias("u"), "weight").unionByName(edges.select(F.col("b").alias("v"), F.col("a").alias("u"), "weight"))
    roots = cut(roots.select(F.col("node").cast("long")).distinct())

    # Any tour tells parents from children: the arc down comes first.
    near = _followed(both.select(F.col("v").cast("long"), F.col("u").cast("long"), "weight"), ["weight", "u"])
    first = near.groupBy("v").agg(F.min_by("u", "i").alias("_first")).join(roots.select(F.col("node").alias("v"), F.lit(True).alias("_root")), "v", "left")
    turns = near.where("_next is null").drop("_next").join(first.where("_root is null").select("v", F.col("_first").alias("_next")), "v", "left")
    tour = near.where("_next is not null").unionByName(turns)
    ranks = list_ranks(tour.select(pair("u", "v").alias("id"), F.when(F.col("_next").isNotNull(), pair("v", "_next")).alias("next")))
    flat = ranks.select("id.u", "id.v", "after")
    down = flat.join(flat.select(F.col("v").alias("u"), F.col("u").alias("v"), F.col("after").alias("_back")), ["u", "v"]).where("after > _back")
    parents = cut(down.select(F.col("v").alias("node"), F.col("u").alias("parent")).join(both.select(F.col("v").alias("node"), F.col("u").alias("parent"), "weight"), ["node", "parent"]))

    # The tour that takes children by weight.
    kids = _followed(parents.select(F.col("parent").alias("v"), F.col("node").alias("u"), "weight"), ["weight", "u"])
    eldest = kids.groupBy("v").agg(F.min_by("u", "i").alias("_first"))
    going = parents.select(F.col("parent").alias("u"), F.col("node").alias("v")).join(eldest, "v", "left").select("u", "v", F.coalesce("_first", "u").alias("_to"))
    back = kids.select("u", "v", "_next").join(parents.select(F.col("node").alias("v"), F.col("parent").alias("_up")), "v", "left").select("u", "v", F.coalesce("_next", "_up").alias("_to"))
    ranks = list_ranks(going.unionByName(back).select(pair("u", "v").alias("id"), F.when(F.col("_to").isNotNull(), pair("v", "_to")).alias("next")))
    flat = ranks.select("id.u", "id.v", F.col("end.v").alias("root"), "after")
    sized = parents.join(flat.withColumnsRenamed({"u": "parent", "v": "node"}), ["parent", "node"]).join(flat.select(F.col("u").alias("node"), F.col("v").alias("parent"), F.col("after").alias("_back")), ["parent", "node"])
    inner = sized.select("node", "parent", "weight", "root", (-F.col("after")).alias("_at"), ((F.col("after") - F.col("_back") + 1) / 2).cast("long").alias("_size"))
    whole = flat.groupBy(F.col("root").alias("node")).agg((F.count(F.lit(1)) / 2 + 1).cast("long").alias("_size"), (-F.max("after") - 1).alias("_at"))
    none = F.lit(None)
    tops = roots.join(whole, "node", "left").select("node", none.cast("long").alias("parent"), none.cast(parents.schema["weight"].dataType).alias("weight"), F.col("node").alias("root"), F.coalesce("_at", F.lit(0)).alias("_at"), F.coalesce("_size", F.lit(1)).alias("_size"))
    placed = running_sum(inner.unionByName(tops).withColumn("_1", F.lit(1).cast("long")), ["root", "_at"], "_1", "pos")
    return cut(placed.select("node", "parent", "weight", "root", "pos", (F.col("pos") + F.col("_size")).alias("hi")))


def spanning_ranges(placed: DataFrame) -> DataFrame:
    """``lo, hi, up_lo, up_hi, level``: the binary tree of a forest that ``rooted`` laid out. A node is a leaf, to which its children's subtrees are joined one at a time, lightest first; ``level`` is the weight of the edge that joins, null at leaves."""
    own = placed.select(F.col("node").alias("owner"), F.col("pos").alias("lo"), F.col("hi").alias("_hi"), F.col("parent").alias("_parent"))
    ups = own.select(F.col("owner").alias("_parent"), F.col("lo").alias("_up"))
    own = cut(own.join(ups, "_parent", "left"))
    joins = cut(placed.where("parent is not null").select(F.col("parent").alias("owner"), "hi", F.col("weight").alias("level")))
    leaves = placed.select(F.col("node").alias("owner"), (F.col("pos") + 1).alias("hi"), F.lit(None).cast(placed.schema["weight"].dataType).alias("level"))
    # What comes at ``hi`` is the owner's next child, or the owner is whole and hangs below its parent.
    later = placed.select(F.col("parent").alias("owner"), F.col("pos").alias("hi"), F.col("hi").alias("_next"))
    found = leaves.unionByName(joins).join(later, ["owner", "hi"], "left").join(own, "owner")
    up_lo = F.when(F.col("_next").isNotNull(), F.col("lo")).otherwise(F.col("_up"))
    up_hi = F.when(F.col("_next").isNotNull(), F.col("_next")).when(F.col("_up").isNotNull(), F.col("_hi"))
    return found.select("lo", "hi", up_lo.alias("up_lo"), up_hi.alias("up_hi"), "level")


def coherent_pieces(nodes: DataFrame, held: DataFrame, n_min: int, tau: float, base: float = 0.0, cap: float = 1.0, most_rows: int = 1_000_000) -> DataFrame:
    """``lo, hi, coherence, keys``: binary trees (``nodes``: ``lo, hi, up_lo, up_hi``) cut from the top until a node's leaves are coherent.

    ``held`` has ``pos, hash, u``: a leaf's k-mers, and the share of all hashes that are not above each. A node's k-mers are
    those of ``base`` < u <= t, where t keeps about ``n_min`` of them, between ``base`` and ``cap``. Its coherence is the
    mean share of its leaves that hold a k-mer, over the ``n_min`` most held (ties to the smaller hash); 1 without any. A
    node of at least ``tau``, and every leaf, is a piece; others are parted into their two halves.

    K-mers are stored with the places that hold them as one list each. Nodes over ``most_rows`` rows are all judged by two
    passes over these, which add up counts where they read; such nodes alone, as many as there are rows over ``most_rows``
    times how deep they lie below each other, reach the driver. A smaller node is finished with all that is below it by
    one task. Repeated rows count once. Empty tables: empty.
    """
    if n_min < 1 or not 0 <= base < cap:
        raise ValueError("n_min must be 1 or more, base not below 0 and below cap")
    halves = nodes.where("up_lo is not null").groupBy(F.col("up_lo").alias("lo"), F.col("up_hi").alias("hi")).agg(F.max("lo").alias("mid"))
    tree = cut(nodes.select("lo", "hi", "up_lo", "up_hi").join(halves, ["lo", "hi"], "left"))
    leaves = tree.where("mid is null").select(F.col("lo").alias("pos"))
    rows = held.where((F.col("u") > base) & (F.col("u") <= cap)).select("pos", "hash", "u").join(leaves, "pos")
    kmers = cut(rows.groupBy("hash", "u").agg(F.array_sort(F.collect_set("pos")).alias("at")))
    rows = kmers.select("hash", "u", F.explode("at").alias("pos"))

    # Leaves lie side by side, so a node's rows are those up to its last leaf less those before its first.
    counted = running_sum(leaves.join(rows.groupBy("pos").agg(F.count(F.lit(1)).alias("_n")), "pos", "left").fillna(0, ["_n"]), ["pos"], "_n", "_before")
    first, last = counted.select(F.col("pos").alias("lo"), "_before"), counted.select((F.col("pos") + 1).alias("hi"), (F.col("_before") + F.col("_n")).alias("_upto"))
    sized = cut(tree.join(first, "lo").join(last, "hi").withColumn("large", (F.col("_upto") - F.col("_before") > most_rows) & F.col("mid").isNotNull()).select("lo", "hi", "mid", "up_lo", "up_hi", "large"))
    large = [(r["lo"], r["hi"], r["mid"]) for r in sized.where("large").sort("lo", F.desc("hi")).collect()]
    found, parted = _judged(kmers, large, n_min, tau, base, cap)
    spark = nodes.sparkSession
    pieces = spark.createDataFrame(found, "lo long, hi long, coherence double, keys long")
    parted = spark.createDataFrame(parted, "up_lo long, up_hi long")
    small = sized.where("not large")
    ends = small.where("up_lo is null").select("lo", "hi").unionByName(small.join(parted, ["up_lo", "up_hi"], "left_semi").select("lo", "hi"))
    # Pieces and what is left to tasks lie side by side.
    owner = cut(running_top(leaves, ends.unionByName(pieces.select("lo", "hi")).withColumnsRenamed({"lo": "top_lo", "hi": "top_hi"})))
    owner = owner.join(pieces.select(F.col("lo").alias("top_lo"), F.col("hi").alias("top_hi")), ["top_lo", "top_hi"], "left_anti").select("pos", F.col("top_lo").alias("lo"), F.col("top_hi").alias("hi"))
    below = cut(tree.select(F.col("lo").alias("pos"), F.col("hi").alias("n_hi"), "mid").join(owner, "pos").where("n_hi <= hi").withColumnRenamed("pos", "n_lo"))
    return pieces.unionByName(_finished(below, rows.join(owner, "pos"), n_min, tau, base, cap))


def _judged(kmers: DataFrame, large: list[tuple[int, int, int]], n_min: int, tau: float, base: float, cap: float) -> tuple[list, list]:
    """The pieces among ``large`` nodes (``lo, hi, mid``, in the order of lo, wider ones first), and the ranges of those that are parted, by passes over ``kmers`` (``hash, u, at``)."""
    if not large:
        return [], []
    levels: list[list[int]] = []
    open_: list[int] = []
    for i, (lo, _, _) in enumerate(large):
        while open_ and large[open_[-1]][1] <= lo:
            open_.pop()
        levels += [[]] * (len(open_) == len(levels))
        levels[len(open_)] = [*levels[len(open_)], i]
        open_.append(i)
    lo, hi = (np.array([x[i] for x in large], np.int64) for i in (0, 1))
    levels = [np.array(x) for x in levels]

    def held(batch):
        """For each level, whose nodes lie beside each other: the k-mer's row, the node and how many of its places hold the k-mer."""
        at = batch.column(2)
        pos, size = at.flatten().to_numpy(zero_copy_only=False), at.value_lengths().to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(batch.num_rows), size)
        for level in levels:
            node = np.searchsorted(lo[level], pos, "right") - 1
            inside = (node >= 0) & (pos < hi[level][node])
            r, n = row[inside], level[node[inside]]
            new = np.flatnonzero(np.r_[True, (r[1:] != r[:-1]) | (n[1:] != n[:-1])]) if len(r) else np.zeros(0, np.int64)
            yield r[new], n[new], np.diff(np.r_[new, len(r)])

    def distinct(batches):
        import pyarrow as pa

        total = np.zeros(len(lo), np.int64)
        for batch in (x for b in batches for x in list_slices(b, 2)):
            for _, n, _ in held(batch):
                total += np.bincount(n, minlength=len(lo))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["node", "n"])

    total = np.zeros(len(lo), np.int64)
    for r in kmers.select("hash", "u", "at").mapInArrow(distinct, "node long, n long").groupBy("node").agg(F.sum("n").alias("n")).collect():
        total[r["node"]] = r["n"]
    t = np.maximum(base, np.minimum(cap, n_min / np.maximum(total / (cap - base), 1.0)))

    def counts(batches):
        import pyarrow as pa

        for batch in (x for b in batches for x in list_slices(b, 2)):
            hashes, u = (batch.column(i).to_numpy() for i in (0, 1))
            for r, n, c in held(batch):
                ok = u[r] <= t[n]
                yield pa.RecordBatch.from_arrays([pa.array(n[ok]), pa.array(hashes[r[ok]]), pa.array(c[ok])], ["node", "hash", "c"])

    few = kmers.where(F.col("u") <= float(t.max())).select("hash", "u", "at").mapInArrow(counts, "node long, hash long, c long")
    best = few.withColumn("_r", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("c"), "hash"))).where(F.col("_r") <= n_min)
    of_node = {r["node"]: (r["c"], r["keys"]) for r in best.groupBy("node").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("keys")).collect()}
    pieces, parted, end = [], [], -1
    for i, (a, b, _) in enumerate(large):
        if a < end:
            continue  # below a piece
        c, keys = of_node.get(i, (0, 0))
        coherence = c / keys / (b - a) if keys else 1.0
        if tau <= 0 or coherence >= tau:
            pieces.append((a, b, coherence, keys))
            end = b
        else:
            parted.append((a, b))
    return pieces, parted


def running_top(places: DataFrame, tops: DataFrame) -> DataFrame:
    """``pos, top_lo, top_hi``: the range of ``tops`` (side by side) around each place, by how many begin at or before it."""
    marked = places.join(tops.select(F.col("top_lo").alias("pos"), F.lit(1).cast("long").alias("_b")), "pos", "left").select("pos", F.coalesce("_b", F.lit(0)).alias("_b"))
    counted = running_sum(marked, ["pos"], "_b", "_k").select("pos", (F.col("_k") + F.col("_b")).alias("_k"))
    numbered = running_sum(tops.withColumn("_b", F.lit(1).cast("long")), ["top_lo"], "_b", "_k").select("top_lo", "top_hi", (F.col("_k") + 1).alias("_k"))
    return counted.join(numbered, "_k").select("pos", "top_lo", "top_hi")


def _finished(inside: DataFrame, rows: DataFrame, n_min: int, tau: float, base: float, cap: float) -> DataFrame:
    """The pieces of nodes that fit a task each."""

    def run(tree: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos", kind="stable")
        pos, hashes, u = rows["pos"].to_numpy(), rows["hash"].to_numpy(), rows["u"].to_numpy()
        mids = {(a, b): None if pd.isna(m) else int(m) for a, b, m in zip(tree["n_lo"].tolist(), tree["n_hi"].tolist(), tree["mid"].tolist())}
        todo, out = [(int(tree["lo"].iloc[0]), int(tree["hi"].iloc[0]))] if len(tree) else [], []
        while todo:
            lo, hi = todo.pop()
            a, b = np.searchsorted(pos, [lo, hi])
            own, first, counts = np.unique(hashes[a:b], return_index=True, return_counts=True)
            t = max(base, min(cap, n_min / max(len(own) / (cap - base), 1.0)))
            held = np.sort(counts[u[a:b][first] <= t])[::-1][:n_min]  # ties are equal counts: which of them is taken changes no mean
            coherence = float(held.sum() / len(held) / (hi - lo)) if len(held) else 1.0
            mid = mids[lo, hi]
            if mid is None or tau <= 0 or coherence >= tau:
                out.append((lo, hi, coherence, len(held)))
            else:
                todo += [(lo, mid), (mid, hi)]
        return pd.DataFrame(out, columns=["lo", "hi", "coherence", "keys"])

    return inside.groupBy("lo", "hi").cogroup(rows.groupBy("lo", "hi")).applyInPandas(run, "lo long, hi long, coherence double, keys long")
