"""Trees as nested leaf ranges: sums below nodes, cuts by budget, restriction to leaves, and covers that tell ties by their smallest common subtree.

A tree is a table of nodes ``lo, hi, up_lo, up_hi``: a node's half-open range of leaf places and its parent's, null at a
top. Leaves are ranges of one place.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import cut
from .blockwise import running_sum


def nodes_of(leaves: DataFrame) -> DataFrame:
    """The nodes of leaf paths (``path``: a leaf's ranges from the top down, as ``tree.leaf_positions`` gives them)."""
    at = F.posexplode("path").alias("i", "own")
    steps = leaves.select("path", at).select(F.col("own.lo"), F.col("own.hi"), F.when(F.col("i") > 0, F.get("path", F.col("i") - 1)).alias("up"))
    return steps.select("lo", "hi", F.col("up.lo").alias("up_lo"), F.col("up.hi").alias("up_hi")).distinct()


def range_sums(ranges: DataFrame, leaves: DataFrame, value: str, name: str, lo: str = "lo", hi: str = "hi") -> DataFrame:
    """``ranges`` with ``name``, the sum of ``value`` over the leaves (``pos``, all of 0, 1, ...) in [lo, hi): differences of one running sum, so that depth costs nothing."""
    before = cut(running_sum(leaves.select("pos", F.col(value).alias("_v")), ["pos"], "_v", "_before").select("pos", "_before", (F.col("_before") + F.col("_v")).alias("_upto")))
    first = before.select(F.col("pos").alias(lo), F.col("_before").alias("_first"))
    last = before.select((F.col("pos") + 1).alias(hi), "_upto")
    return ranges.join(first, lo).join(last, hi).withColumn(name, F.col("_upto") - F.col("_first")).drop("_upto", "_first")


def budget_chunks(nodes: DataFrame, leaves: DataFrame, budget: float, value: str = "size") -> DataFrame:
    """``lo, hi, size``: the tree cut from the top until what is below a node is at most ``budget``, or the node is a leaf.

    Sizes only fall on the way down, so a node ends the cut where its parent is over the budget and it is not: no walk
    is needed.
    """
    sized = cut(range_sums(nodes, leaves, value, "size"))
    ups = sized.select(F.col("lo").alias("up_lo"), F.col("hi").alias("up_hi"), F.col("size").alias("_up"))
    fits = (F.col("size") <= budget) | (F.col("hi") - F.col("lo") == 1)
    return sized.join(ups, ["up_lo", "up_hi"], "left").where(fits & (F.col("_up").isNull() | (F.col("_up") > budget))).select("lo", "hi", "size")


def restricted_tree(nodes: DataFrame, leaves: DataFrame, chosen: DataFrame) -> DataFrame:
    """The tree over the places ``chosen`` (``pos``) alone, these numbered anew from 0 in their order; a node left with one child, whose range repeats that child's, goes.

    A node's new range is a count of chosen places before its ends. Of the nodes that then have one range the topmost
    is the one whose parent's differs, and that is the new parent.
    """
    marked = leaves.select("pos").join(chosen.select("pos").distinct().withColumn("_in", F.lit(1)), "pos", "left").select("pos", F.coalesce("_in", F.lit(0)).alias("_v"))
    count = cut(running_sum(marked, ["pos"], "_v", "_before").select("pos", "_before", (F.col("_before") + F.col("_v")).alias("_upto")))
    lo = count.select(F.col("pos").alias("lo"), F.col("_before").alias("_lo"))
    hi = count.select((F.col("pos") + 1).alias("hi"), F.col("_upto").alias("_hi"))
    moved = cut(nodes.join(lo, "lo").join(hi, "hi").where("_hi > _lo"))
    ups = moved.select(F.col("lo").alias("up_lo"), F.col("hi").alias("up_hi"), F.col("_lo").alias("_up_lo"), F.col("_hi").alias("_up_hi")).distinct()
    linked = moved.join(ups, ["up_lo", "up_hi"], "left")
    topmost = F.col("_up_lo").isNull() | (F.col("_up_lo") != F.col("_lo")) | (F.col("_up_hi") != F.col("_hi"))
    return linked.where(topmost).select(F.col("_lo").alias("lo"), F.col("_hi").alias("hi"), F.col("_up_lo").alias("up_lo"), F.col("_up_hi").alias("up_hi"))


class CommonRanges:
    """Smallest common subtree of leaves that lie side by side: each leaf's with the leaf before it, and the widest of these over a stretch, by doubling."""

    def __init__(self, lo: np.ndarray, hi: np.ndarray):
        self.lo, self.hi = lo, hi
        width = hi - lo
        self.best = [np.arange(len(lo))]
        while 2 << (len(self.best) - 1) <= len(lo):
            step, last = 1 << (len(self.best) - 1), self.best[-1]
            a, b = last[:-step], last[step:]
            self.best.append(np.where(width[a] >= width[b], a, b))
        self.width = width

    def of(self, a: int, b: int) -> tuple[int, int]:
        """The range of the smallest subtree with the leaves a < b (indices), from what lies between: (a, b]."""
        level = (b - a).bit_length() - 1
        x, y = self.best[level][a + 1], self.best[level][b + 1 - (1 << level)]
        at = x if self.width[x] >= self.width[y] else y
        return int(self.lo[at]), int(self.hi[at])


def tied_cover(held: DataFrame, leaves: DataFrame, least: int, tie_z: float) -> DataFrame:
    """``component, rank, pos, score, kmers, tied, lo, hi``: a greedy cover of hit k-mers by leaves, in which leaves that can't be told apart are taken together and reported by their smallest common subtree.

    ``held`` has ``component, pos, hash, windows, size``: a leaf's hit k-mers, and its windows over stored k-mers as the
    scale of its score. Time and again the leaf of the highest score (its live k-mers times scale; ties to the first
    place) is taken with the leaves that share a live k-mer with it and score within ``tie_z`` standard deviations; all
    their k-mers go. Ends below ``least`` live k-mers. ``leaves`` as ``tree.leaf_positions`` gives them. Every k-mer dies
    once and lowers its holders' counts then, so the work is the rows, not rows times picks. A component's rows, which
    share no k-mer with others, are covered by one task.
    """
    above = F.filter("path", lambda x: x["lo"] < F.col("pos"))
    common = leaves.select("component", "pos", F.coalesce(F.try_element_at(above, F.lit(-1))["lo"], F.col("pos")).alias("lo"), F.coalesce(F.try_element_at(above, F.lit(-1))["hi"], F.col("pos") + 1).alias("hi"))

    def run(rows: pd.DataFrame, tree: pd.DataFrame) -> pd.DataFrame:
        tree = tree.sort_values("pos")
        place = tree["pos"].to_numpy()
        ranges = CommonRanges(tree["lo"].to_numpy(), tree["hi"].to_numpy())
        own: dict[int, list[int]] = {}
        holders: dict[int, list[int]] = {}
        scale: dict[int, float] = {}
        for p, h, w, n in sorted(set(zip(rows["pos"].tolist(), rows["hash"].tolist(), rows["windows"].tolist(), rows["size"].tolist()))):
            own.setdefault(p, []).append(h)
            holders.setdefault(h, []).append(p)
            scale[p] = max(float(w), 1.0) / max(float(n), 1.0)
        live, left = set(holders), {p: len(x) for p, x in own.items()}
        heap = [(-left[p] * scale[p], p) for p in own]
        heapq.heapify(heap)
        picks = []
        while heap:
            s, best = heapq.heappop(heap)
            if -s != left[best] * scale[best]:
                if left[best]:
                    heapq.heappush(heap, (-left[best] * scale[best], best))
                continue
            if left[best] < least:
                break
            bar = -s - tie_z * math.sqrt(left[best]) * scale[best]
            near = {p for h in own[best] if h in live for p in holders[h]}
            tied = sorted(p for p in near if left[p] * scale[p] >= bar)
            gone = {h for p in tied for h in own[p] if h in live}
            if len(tied) > 1:
                lo, hi = ranges.of(*np.searchsorted(place, [tied[0], tied[-1]]).tolist())
            else:
                lo, hi = best, best + 1
            picks.append((len(picks), best, -s, len(gone), len(tied), lo, hi))
            for h in gone:
                for p in holders[h]:
                    left[p] -= 1
            live -= gone
        out = pd.DataFrame(picks, columns=["rank", "pos", "score", "kmers", "tied", "lo", "hi"])
        out.insert(0, "component", rows["component"].iloc[0] if len(rows) else 0)
        return out

    schema = "component long, rank long, pos long, score double, kmers long, tied long, lo long, hi long"
    return held.groupBy("component").cogroup(common.groupBy("component")).applyInPandas(run, schema)
