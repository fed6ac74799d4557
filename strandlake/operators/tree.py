"""A similarity tree over k-mer sets, and postings as signed ranges of its leaf order.

A set's k-mers are written where they change on the tree: a gain covers a range of leaves, a loss takes a part of it back,
so that a leaf holds a k-mer iff gains less losses over it are 1. Queries then add signed ranges and sweep their ends.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.kmers import KmerParams, kmer_hashes, unsigned
from ..lineage import cut
from .graph import Forest, boruvka, chain_edges, connected, dense_ids, spanning_forest


def overlap_pairs(held: DataFrame, least: int = 1, most_holders: int | None = None, storage: bool = False) -> DataFrame:
    """``a, b, shared, weight`` of all sets (``set_id, hash``) that share ``least`` hashes: the weight is the size of their symmetric difference. With ``storage`` only edges that a tree below an empty root could use: not heavier than both sets. Hashes of more than ``most_holders`` sets are left out (None: exact).

    A self join on the hash makes the holders' pairs; each hash's are counted where they meet and added up map-side.
    """
    one = held.select("set_id", "hash").distinct()
    sizes = one.groupBy("set_id").agg(F.count(F.lit(1)).alias("size"))
    rows = one
    if most_holders is not None:
        rows = one.join(one.groupBy("hash").count().where(F.col("count") <= most_holders), "hash", "left_semi")
    pairs = rows.select("hash", F.col("set_id").alias("a")).join(rows.select("hash", F.col("set_id").alias("b")), "hash").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared")).where(F.col("shared") >= least)
    pairs = pairs.join(sizes.select(F.col("set_id").alias("a"), F.col("size").alias("sa")), "a").join(sizes.select(F.col("set_id").alias("b"), F.col("size").alias("sb")), "b")
    pairs = pairs.withColumn("weight", F.col("sa") + F.col("sb") - 2 * F.col("shared"))
    if storage:
        pairs = pairs.where((F.col("weight") <= F.greatest("sa", "sb")))
    return pairs.select("a", "b", "shared", "weight")


def overlap_components(held: DataFrame) -> DataFrame:
    """``node, component`` of the sets that share a hash, from consecutive holders and never from pairs."""
    return connected(held.select("set_id").distinct(), chain_edges(held, "set_id", "hash"))


def pair_weights(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """``a, b, shared, weight`` of given pairs."""
    one = held.select("set_id", "hash").distinct()
    sizes = one.groupBy("set_id").agg(F.count(F.lit(1)).alias("size"))
    both = pairs.select("a", "b").join(one.select(F.col("set_id").alias("a"), "hash"), "a").join(one.select(F.col("set_id").alias("b"), "hash"), ["b", "hash"]).groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))
    out = pairs.select("a", "b").join(both, ["a", "b"], "left").join(sizes.select(F.col("set_id").alias("a"), F.col("size").alias("sa")), "a").join(sizes.select(F.col("set_id").alias("b"), F.col("size").alias("sb")), "b")
    shared = F.coalesce("shared", F.lit(0))
    return out.select("a", "b", shared.alias("shared"), (F.col("sa") + F.col("sb") - 2 * shared).alias("weight"))


def set_digests(held: DataFrame) -> DataFrame:
    """``set_id, size, d1, d2``: digests of sets that don't depend on order: sums of two hashes of the members, which add up map-side."""
    one = held.select("set_id", "hash").distinct()
    part = lambda salt: F.expr(f"bit_xor(xxhash64({salt}, hash))")
    return one.groupBy("set_id").agg(F.count(F.lit(1)).alias("size"), part(3).alias("d1"), part(5).alias("d2"))


def collapse_equal(held: DataFrame) -> DataFrame:
    """``set_id, rep``: the least set with the same members."""
    d = set_digests(held)
    return d.withColumn("rep", F.min("set_id").over(Window.partitionBy("size", "d1", "d2"))).select("set_id", "rep")


def collapse_contained(held: DataFrame, pairs: DataFrame) -> DataFrame:
    """``set_id, rep``: a set that lies in another (``pairs`` of ``overlap_pairs``) hangs below the largest such (ties to the least id), and pointers are followed to the end. Of equal sets the least stays."""
    sizes = held.select("set_id", "hash").distinct().groupBy("set_id").agg(F.count(F.lit(1)).alias("size"))
    both = pairs.select("a", "b", "shared").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "shared"))
    up = both.join(sizes.select(F.col("set_id").alias("a"), F.col("size").alias("sa")), "a").join(sizes.select(F.col("set_id").alias("b"), F.col("size").alias("sb")), "b")
    up = up.where((F.col("shared") == F.col("sa")) & ((F.col("sb") > F.col("sa")) | (F.col("b") < F.col("a")))).groupBy("a").agg(F.max_by("b", F.struct("sb", -F.col("b"))).alias("b"))
    now = cut(sizes.select("set_id").join(up, F.col("set_id") == F.col("a"), "left").select("set_id", F.coalesce("b", "set_id").alias("rep")))
    while True:
        new = cut(now.join(now.select(F.col("set_id").alias("rep"), F.col("rep").alias("next")), "rep").select("set_id", F.col("next").alias("rep"), (F.col("next") != F.col("rep")).alias("moved")))
        now = new.drop("moved")
        if new.where("moved").isEmpty():
            return now


def minimum_forest(pairs: DataFrame) -> DataFrame:
    """``a, b, weight`` of a minimum spanning forest of any size, by rounds of least edges per component."""
    return boruvka(pairs)


def merge_trees(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Leaf order per component: ``component, set_id, pos, path``.

    Forest edges (``a, b, weight``) are merged from light to heavy; each merge is an inner node whose halves lie side by
    side. ``pos`` runs from 0 in each component and ``path`` is the list of its leaf's ancestor ranges ``[lo, hi)``, from
    the top down. Components are ordered in a task each; ``leaf_positions`` shifts them to one order.
    """

    def order(g: pd.DataFrame) -> pd.DataFrame:
        nodes = np.sort(g["set_id"].unique())
        at = {int(x): i for i, x in enumerate(nodes)}
        e = g.dropna(subset=["b"])
        links = spanning_forest([(at[int(a)], at[int(b)], float(w)) for a, b, w in zip(e["set_id"], e["b"], e["weight"])], len(nodes))
        forest = Forest(len(nodes))
        tree: dict[int, object] = {i: i for i in range(len(nodes))}
        for a, b, _ in links:
            x, y = forest.root(a), forest.root(b)
            forest.join(x, y)
            tree[forest.root(a)] = (tree[min(x, y)], tree[max(x, y)])
        leaves, paths = [], []
        stack = [(tree[r], ()) for r in sorted({forest.root(i) for i in range(len(nodes))}, reverse=True)]
        size: dict[int, int] = {}

        def weigh(t):
            todo = [(t, False)]
            while todo:
                x, done = todo.pop()
                if isinstance(x, int):
                    continue
                if done:
                    size[id(x)] = sum(1 if isinstance(y, int) else size[id(y)] for y in x)
                else:
                    todo += [(x, True), (x[0], False), (x[1], False)]

        for t, _ in stack:
            weigh(t)
        while stack:
            t, path = stack.pop()
            lo = len(leaves)
            if isinstance(t, int):
                leaves.append(t)
                paths.append([*path, (lo, lo + 1)])
            else:
                here = (*path, (lo, lo + size[id(t)]))
                stack += [(t[1], here), (t[0], here)]
        return pd.DataFrame({"component": g["component"].iloc[0], "set_id": nodes[leaves], "pos": np.arange(len(leaves)), "path": [[{"lo": a, "hi": b} for a, b in p] for p in paths]})

    rows = labels.select(F.col("node").alias("set_id"), "component").join(edges.select(F.col("a").alias("set_id"), "b", "weight"), "set_id", "left")
    return rows.groupBy("component").applyInPandas(order, "component long, set_id long, pos long, path array<struct<lo: long, hi: long>>")


def leaf_positions(trees: DataFrame) -> DataFrame:
    """The leaf orders of all components one after another."""
    sizes = trees.groupBy("component").count()
    shift = F.coalesce(F.sum("count").over(Window.orderBy("component").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    moved = trees.join(sizes.select("component", shift.alias("_s")), "component")
    return moved.select("component", "set_id", (F.col("pos") + F.col("_s")).alias("pos"), F.transform("path", lambda x: F.struct((x["lo"] + F.col("_s")).alias("lo"), (x["hi"] + F.col("_s")).alias("hi"))).alias("path"))


def parsimony(nodes: dict[tuple[int, int], list[tuple[int, int]]], top: tuple[int, int], present: set[int], missing: frozenset[int] = frozenset()) -> list[tuple[int, int, int]]:
    """Fitch's parsimony of one k-mer on one tree: (lo, hi, sign) where its state changes, below an absent root.

    ``nodes`` maps an inner node's range to its halves. Bottom-up a node's states are what its halves have in common, else
    all that they have; missing leaves have none and pass the other half's on. Top-down a node keeps its parent's state if
    it may.
    """
    states: dict[tuple[int, int], int] = {}
    todo = [(top, False)]
    while todo:
        x, done = todo.pop()
        if x not in nodes:
            states[x] = 0 if x[0] in missing else 2 if x[0] in present else 1
        elif done:
            a, b = (states[y] for y in nodes[x])
            states[x] = a | b if not a or not b else (a & b or a | b)
        else:
            todo += [(x, True), *((y, False) for y in nodes[x])]
    out, walk = [], [(top, 1)]
    while walk:
        x, above = walk.pop()
        s = states[x]
        own = above if s == 0 or s & above else s
        if own != above:
            out.append((*x, 1 if own == 2 else -1))
        if x in nodes:
            walk += [(y, own) for y in nodes[x]]
    return sorted(out)


def range_postings(held: DataFrame, leaves: DataFrame) -> DataFrame:
    """``hash, lo, hi, sign`` of every k-mer by parsimony, one component's tree per task (``held``: ``set_id, hash``; ``leaves``: of ``leaf_positions``)."""

    def change(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        kids: dict[tuple[int, int], set[tuple[int, int]]] = {}
        for path in right["path"]:
            p = [(int(x["lo"]), int(x["hi"])) for x in path]
            for a, b in zip(p, p[1:]):
                kids.setdefault(a, set()).add(b)
        nodes = {k: sorted(v) for k, v in kids.items()}
        tops = sorted({(int(p[0]["lo"]), int(p[0]["hi"])) for p in right["path"]})
        pos = dict(zip(right["set_id"], right["pos"]))
        rows = []
        for h, g in left.groupby("hash"):
            own = {int(pos[s]) for s in g["set_id"]}
            for t in tops:
                if any(t[0] <= x < t[1] for x in own):
                    rows += [(h, *x) for x in parsimony(nodes, t, own)]
        return pd.DataFrame(rows, columns=["hash", "lo", "hi", "sign"]).astype({"hash": "int64", "lo": "int64", "hi": "int64", "sign": "int32"})

    keyed = held.select("set_id", "hash").distinct().join(leaves.select("set_id", F.col("component").alias("tree")), "set_id")
    return keyed.groupBy("tree").cogroup(leaves.groupBy("component")).applyInPandas(lambda a, b: change(a, b), "hash long, lo long, hi long, sign int")


def scheme_counts(held: DataFrame, leaves: DataFrame) -> DataFrame:
    """One row: postings by ranges, and by one for each leaf."""
    ranges = range_postings(held, leaves).agg(F.count(F.lit(1)).alias("range_postings"))
    return ranges.crossJoin(held.select("set_id", "hash").distinct().agg(F.count(F.lit(1)).alias("leaf_postings")))  # a row each


def covers(postings: DataFrame, leaves: DataFrame) -> DataFrame:
    """``hash, set_id`` of the leaves that the ranges hold: the inverse of ``range_postings``; an error if a cover is not 0 or 1."""
    spread = postings.withColumn("pos", F.explode(F.expr("sequence(lo, hi - 1)"))).groupBy("hash", "pos").agg(F.sum("sign").alias("cover"))
    if bad := spread.where("cover not in (0, 1)").limit(1).collect():
        raise ValueError(f"a range cover is {bad[0]['cover']}")
    return spread.where("cover = 1").join(leaves.select("pos", "set_id"), "pos").select("hash", "set_id")


def sweep(ranges: DataFrame, by: list[str], values: list[str], buckets: int = 0) -> DataFrame:
    """Running sums over interval ends: ``by``, ``lo``, ``hi`` and the sum of each of ``values`` over all ranges that cover the stretch, for stretches where the first is not 0.

    Ends are added up per place before they are put in order, so a window holds a place once, however many ranges end there.
    """
    ends = ranges.select(*by, F.col("lo").alias("x"), *values).unionByName(ranges.select(*by, F.col("hi").alias("x"), *(-F.col(v) for v in values)).toDF(*by, "x", *values))
    places = ends.groupBy(*by, "x").agg(*(F.sum(v).alias(v) for v in values))
    order = Window.partitionBy(*by).orderBy("x") if by else Window.orderBy("x")
    run = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = places.select(*by, F.col("x").alias("lo"), F.lead("x").over(order).alias("hi"), *(F.sum(v).over(run).alias(v) for v in values))
    return out.where(F.col("hi").isNotNull() & (F.abs(F.col(values[0])) > 1e-9))


def leaf_hits(sample: DataFrame, postings: DataFrame) -> DataFrame:
    """``pos, hit_kmers, hits`` of a sample (``hash, n``) at the leaves that its k-mers reach."""
    rows = sample.join(postings, "hash").select("lo", "hi", F.col("sign").cast("long").alias("hit_kmers"), (F.col("sign") * F.col("n")).alias("hits"))
    return sweep(rows, [], ["hit_kmers", "hits"]).withColumn("pos", F.explode(F.expr("sequence(lo, hi - 1)"))).select("pos", "hit_kmers", "hits")


def contained_sums(queries: DataFrame, ranges: DataFrame, width: int = 64) -> DataFrame:
    """``query, total``: for each query range (``query, qlo, qhi``) the summed ``weight`` of the ranges (``lo, hi, weight``) that contain it.

    A range that contains a query covers the query's start, so both meet by slices of ``width`` places: ranges are put in
    every slice they touch, queries in the one of their start; equal ranges are added up first.
    """
    one = ranges.groupBy("lo", "hi").agg(F.sum("weight").alias("weight")).withColumn("slice", F.explode(F.expr(f"sequence(lo div {width}, (hi - 1) div {width})")))
    asked = queries.withColumn("slice", F.expr(f"qlo div {width}"))
    met = asked.join(one, "slice", "left").groupBy("query").agg(F.sum(F.when((F.col("lo") <= F.col("qlo")) & (F.col("hi") >= F.col("qhi")), F.col("weight")).otherwise(0)).alias("total"))
    return met


def window_minimizers(df: DataFrame, p: KmerParams, w: int, keep: list[str], sequence: str = "sequence") -> DataFrame:
    """Distinct ``keep, hash``: the least hash of every ``w`` consecutive k-mers, of all in a shorter sequence. k-mers of invalid letters never win."""
    schema = StructType([df.schema[c] for c in keep] + StructType.fromDDL("hash long").fields)

    def pick(batches):
        for b in batches:
            which, out = [], []
            for i, s in enumerate(b[sequence]):
                s = (s or "").encode()
                n = len(s) - p.k + 1
                if n <= 0:
                    continue
                _, pos, h = kmer_hashes([s], p)
                full = np.full(n, np.iinfo(np.uint64).max, np.uint64)
                full[pos] = h
                v = full if n <= w else np.lib.stride_tricks.sliding_window_view(full, w)
                least = np.unique(v.min(axis=-1) if n > w else full.min())
                least = least[np.isin(least, h)]
                which += [i] * len(least)
                out.append(least)
            rows = b[keep].iloc[which].reset_index(drop=True)
            rows["hash"] = np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64)
            yield rows

    return df.select(*dict.fromkeys([*keep, sequence])).mapInPandas(pick, schema)


def key_bits(held: DataFrame, leaves: int) -> DataFrame:
    """``hash, bits``: evidence of a key: minus the log of the share of leaves that hold it."""
    return held.groupBy("hash").agg((-F.log2(F.count_distinct("set_id") / F.lit(float(leaves)))).alias("bits"))


def evidence(pairs: DataFrame, postings: DataFrame, log2_windows: float, floor: float = 0.0, read_rows: int = 200_000, width: int = 4096) -> DataFrame:
    """``read, lo, hi, score``: stretches of leaves by the bits of a read's hit keys on them, less ``log2_windows`` for each hit beyond the first, from ``floor`` on (``pairs``: ``read, hash``; ``postings`` with ``bits``). Stretches also end at places that ``width`` divides.

    Whole reads are dealt into groups of about ``read_rows`` pairs, and each meets the ranges on each ``width`` leaves in a
    task, which sweeps their ends: what is shuffled are pairs and postings, not hits. Bits count in steps of 2^-40, so that
    sums don't depend on their order.
    """
    asked = cut(pairs.select("read", "hash").where("hash is not null"))
    held = cut(postings.where("hash is not null and lo < hi").select("hash", "lo", "hi", F.col("sign").cast("double").alias("sign"), (F.round(F.col("bits") * F.lit(2.0**40)) / F.lit(2.0**40)).alias("bits")).withColumn("_b", F.explode(F.expr(f"sequence(lo div {width}, (hi - 1) div {width})"))))
    blocks = cut(held.select("_b").distinct())
    parts = -(-asked.count() // read_rows) or 1
    left = asked.withColumn("_p", F.pmod(F.xxhash64("read"), F.lit(parts)).cast("int")).crossJoin(blocks)
    right = held.withColumn("_p", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    schema = StructType([asked.schema["read"], *StructType.fromDDL("lo long, hi long, score double").fields])
    return left.groupBy("_p", "_b").cogroup(right.groupBy("_p", "_b")).applyInArrow(lambda a, b: _swept(a, b, log2_windows, floor, width), schema)


def _swept(a, b, log2_windows: float, floor: float, width: int, most: int = 1_000_000):
    """``evidence`` of a group of reads on the leaves of one block, some reads at a time."""
    import pyarrow as pa

    none = pa.table({"read": a.column("read").slice(0, 0), "lo": pa.array([], pa.int64()), "hi": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
    if not a.num_rows or not b.num_rows:
        return none
    order = np.argsort(b.column("hash").to_numpy(), kind="stable")
    key, sign, bits = (b.column(c).to_numpy()[order] for c in ("hash", "sign", "bits"))
    base = int(b.column("_b")[0].as_py()) * width
    ends = [np.clip(b.column(c).to_numpy()[order] - base, 0, width) for c in ("lo", "hi")]
    span = int(ends[1].max()) + 1
    coded = a.column("read").combine_chunks().dictionary_encode()
    read = coded.indices.to_numpy()
    pair = np.stack([read, a.column("hash").to_numpy()])
    pair = pair[:, np.lexsort((pair[1], pair[0]))]
    pair = pair[:, np.r_[True, (pair[:, 1:] != pair[:, :-1]).any(axis=0)]]
    first = np.searchsorted(key, pair[1], "left")
    size = np.searchsorted(key, pair[1], "right") - first
    # Reads together have up to ``most`` places and hits, but for a read of more.
    of_read = np.bincount(pair[0], size, len(coded.dictionary)) + span
    chunk = (np.cumsum(of_read) // most).astype(np.int64)
    edges = np.flatnonzero(np.r_[True, chunk[1:] != chunk[:-1], True])
    out = []
    for r0, r1 in zip(edges[:-1], edges[1:]):
        p0, p1 = np.searchsorted(pair[0], [r0, r1])
        n = size[p0:p1]
        hit = np.repeat(first[p0:p1] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        row = np.repeat(pair[0][p0:p1] - r0, n) * span
        at = np.concatenate([row + ends[0][hit], row + ends[1][hit]])
        grid = lambda v: np.bincount(at, np.r_[v[hit], -v[hit]], (r1 - r0) * span).reshape(-1, span).cumsum(axis=1).ravel()  # noqa: B023, E731
        place = np.flatnonzero(np.bincount(at, minlength=(r1 - r0) * span))
        place, after = place[:-1], place[1:]
        many, sums = grid(sign)[place], grid(sign * bits)[place]
        score = sums - np.maximum(many - 1, 0) * log2_windows
        keep = (place // span == after // span) & (np.abs(many) > 1e-9) & (score >= floor)
        out.append((place[keep] // span + r0, place[keep] % span + base, after[keep] % span + base, score[keep]))
    which, lo, hi, score = (np.concatenate(x) for x in zip(*out))
    return pa.table({"read": coded.dictionary.take(pa.array(which)), "lo": lo.astype(np.int64), "hi": hi.astype(np.int64), "score": score})


def best_evidence(runs: DataFrame) -> DataFrame:
    """``pos, score``: each leaf's best."""
    return runs.withColumn("pos", F.explode(F.expr("sequence(lo, hi - 1)"))).groupBy("pos").agg(F.max("score").alias("score"))


def decoy_bar(seeds: DataFrame, decoys: DataFrame, share: float, step: float = 0.25, high: float = 160.0, scale: float = 1.0) -> float | None:
    """The least score at which decoy seeds, ``scale`` times, are at most ``share`` of the sample's; None if there is none. Both are counted in steps, which is all that reaches the driver."""
    at = F.least(F.floor(F.greatest("score", F.lit(0.0)) / step), F.lit(int(high / step))).cast("int")
    table = seeds.where("score >= 0").groupBy(at.alias("s")).agg(F.count(F.lit(1)).alias("n"), F.lit(0).cast("long").alias("d")).unionByName(decoys.where("score >= 0").groupBy(at.alias("s")).agg(F.lit(0).cast("long").alias("n"), F.count(F.lit(1)).alias("d")))
    n, d = np.zeros(int(high / step) + 1), np.zeros(int(high / step) + 1)
    for r in table.collect():
        n[r["s"]] += r["n"]
        d[r["s"]] += r["d"]
    n, d = n[::-1].cumsum()[::-1], scale * d[::-1].cumsum()[::-1]
    ok = np.flatnonzero(d[:-1] <= share * np.maximum(n[:-1], 1))
    return float(ok[0] * step) if len(ok) else None


def gather_reads(scores: DataFrame, floor: float) -> DataFrame:
    """``pos, score, rank`` of a greedy cover of reads by leaves (``component, pos, read, score``): time and again the leaf whose reads that are not taken score most in sum takes them, down to ``floor``. Leaves of different components share no read."""
    import heapq

    def run(g: pd.DataFrame) -> pd.DataFrame:
        own = {int(p): dict(zip(x["read"], x["score"])) for p, x in g.groupby("pos")}
        heap = [(-math.fsum(v.values()), p) for p, v in own.items()]
        heapq.heapify(heap)
        taken: set = set()
        picks = []
        while heap:
            _, p = heapq.heappop(heap)
            gain = math.fsum(s for r, s in own[p].items() if r not in taken)
            if gain < floor or not gain:
                continue
            if heap and (-gain, p) > heap[0]:
                heapq.heappush(heap, (-gain, p))
                continue
            picks.append((p, gain))
            taken.update(own[p])
        return pd.DataFrame(picks, columns=["pos", "score"]).astype({"pos": "int64", "score": "float64"})

    out = scores.groupBy("component").applyInPandas(run, "pos long, score double")
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "pos")))


def tied_em(ties: DataFrame, rounds: int = 20) -> DataFrame:
    """``read, leaf, share``: a fixed number of EM rounds over reads tied between leaves (``read, leaf``), from equal shares; a leaf's weight is the sum of its shares."""
    rows = cut(ties.select("read", "leaf").distinct().withColumn("share", 1 / F.count(F.lit(1)).over(Window.partitionBy("read"))))
    for i in range(rounds):
        theta = rows.groupBy("leaf").agg(F.sum("share").alias("theta"))
        rows = rows.select("read", "leaf").join(theta, "leaf").withColumn("share", F.col("theta") / F.sum("theta").over(Window.partitionBy("read"))).select("read", "leaf", "share")
        if i % 5 == 4:
            rows = cut(rows)
    return rows


def _band_votes(reads, leaves, band: int, top: int, most: int = 1 << 19):
    """``read, leaf, votes`` of one group of whole reads on one group of whole leaves, as Arrow tables (``read, pos, hash`` and ``leaf, pos, hash``). Hits are laid out for at most ``most`` pairs of places at a time, and only counts of a read that goes on are kept in between."""
    import pyarrow as pa

    schema = pa.schema([reads.schema.field("read"), leaves.schema.field("leaf"), pa.field("votes", pa.int64())])
    if not reads.num_rows or not leaves.num_rows:
        return schema.empty_table()
    coded = lambda c: pa.concat_arrays(c.chunks).dictionary_encode("encode")
    rcode, lcode = coded(reads["read"]), coded(leaves["leaf"])
    ids = lambda c: c.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    of = lambda t, c: t[c].to_numpy().astype(np.int64)
    order = np.argsort(of(leaves, "hash"), kind="stable")
    leaf, lpos, lhash = ids(lcode)[order], of(leaves, "pos")[order], of(leaves, "hash")[order]
    read, rpos, rhash = ids(rcode), of(reads, "pos"), of(reads, "hash")
    order = np.lexsort((rpos, read))
    read, rpos, rhash = read[order], rpos[order], rhash[order]
    first = np.searchsorted(lhash, rhash, "left")
    n = np.searchsorted(lhash, rhash, "right") - first
    read, rpos, first, n = (x[n > 0] for x in (read, rpos, first, n))
    # A chunk ends where a place of a read ends: rows of the same place are counted together.
    ends = np.flatnonzero(np.r_[(read[1:] != read[:-1]) | (rpos[1:] != rpos[:-1]), True]) + 1 if len(read) else np.zeros(0, np.int64)
    total = np.cumsum(n)
    found, held = [], np.zeros((4, 0), np.int64)

    def settle(v):
        """The best leaves of the reads whose counts ``v`` (read, leaf, band, n) are whole."""
        r, f, b, c = v
        two = np.concatenate([np.stack([r, f, b, c]), np.stack([r, f, b - 1, c])], axis=1)
        r, f, _, c = _summed(two)
        if not len(r):
            return
        o = np.lexsort((-c, f, r))
        r, f, c = r[o], f[o], c[o]
        keep = np.r_[True, (r[1:] != r[:-1]) | (f[1:] != f[:-1])]
        r, f, c = r[keep], f[keep], c[keep]
        o = np.lexsort((-c, r))
        r, f, c = r[o], f[o], c[o]
        start = np.r_[0, np.flatnonzero(r[1:] != r[:-1]) + 1]
        size = np.diff(np.r_[start, len(r)])
        bar = np.repeat(c[start + np.minimum(top, size) - 1], size)
        found.append(np.stack([r, f, c])[:, c >= bar])

    lo = 0
    while lo < len(read):
        reach = int(np.searchsorted(total, (total[lo - 1] if lo else 0) + most, "right"))
        at = int(np.searchsorted(ends, reach, "right"))
        hi = int(ends[at - 1]) if at and ends[at - 1] > lo else int(ends[np.searchsorted(ends, lo, "right")])
        k = n[lo:hi]
        row = np.repeat(np.arange(lo, hi), k)
        hit = np.repeat(first[lo:hi] - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))
        votes = np.stack([read[row], rpos[row], leaf[hit], (lpos[hit] - rpos[row]) // band])
        votes = _summed(np.concatenate([votes, np.ones((1, votes.shape[1]), np.int64)]))[:4]
        now = _summed(np.stack([*votes[[0, 2, 3]], np.ones(votes.shape[1], np.int64)]))
        now = _summed(np.concatenate([held, now], axis=1))
        done = now[0] < read[hi] if hi < len(read) else np.ones(now.shape[1], bool)
        settle(now[:, done])
        held, lo = now[:, ~done], hi
    r, f, c = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
    return pa.Table.from_arrays([rcode.dictionary.take(pa.array(r)), lcode.dictionary.take(pa.array(f)), pa.array(c)], schema=schema)


def _summed(rows: np.ndarray) -> np.ndarray:
    """Columns of ``rows`` that differ in more than the last row, which is summed; in order of the rows."""
    if not rows.shape[1]:
        return rows
    low = rows[:-1].min(axis=1)
    spans = [int(x) for x in rows[:-1].max(axis=1) - low + 1]
    if math.prod(spans) < 1 << 62:  # one number a column sorts faster than several
        key = np.zeros(rows.shape[1], np.int64)
        for row, least, span in zip(rows, low, spans):
            key = key * span + (row - least)
        order = np.argsort(key)
    else:
        order = np.lexsort(rows[-2::-1])
    rows = rows[:, order]
    start = np.flatnonzero(np.r_[True, (rows[:-1, 1:] != rows[:-1, :-1]).any(axis=0)])
    return np.concatenate([rows[:-1, start], np.add.reduceat(rows[-1], start)[None]])


def route_votes(reads: DataFrame, leaf_kmers: DataFrame, band: int = 16, top: int = 10, most: int | None = None, read_rows: int = 200_000, leaf_rows: int = 1_000_000) -> DataFrame:
    """``read, leaf, votes``: seeds on the best two adjacent diagonal bands, each read position once per leaf and band; the ``top`` leaves, ties kept (``reads``: ``read, pos, hash``; ``leaf_kmers``: ``leaf, pos, hash``). Hashes of more than ``most`` leaves are left out.

    Whole reads are dealt into groups of about ``read_rows`` k-mers and whole leaves into groups of about ``leaf_rows``, and
    each group of reads meets each of leaves in a task, so that hits are counted where they are made: what is shuffled are
    k-mers, not hits. A group passes on each read's ``top`` leaves, ties kept, among which the ``top`` of all are.
    """
    held = leaf_kmers
    if most is not None:
        held = held.join(held.groupBy("hash").agg(F.count_distinct("leaf").alias("n")).where(F.col("n") <= most), "hash", "left_semi")
    there = "hash is not null and pos is not null"
    asked, held = cut(reads.select("read", "pos", "hash").where(there)), cut(held.select("leaf", "pos", "hash").where(there))
    parts, blocks = (-(-df.count() // rows) or 1 for df, rows in ((asked, read_rows), (held, leaf_rows)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.withColumn("_p", F.pmod(F.xxhash64("read"), F.lit(parts)).cast("int")).withColumn("_b", every(blocks))
    right = held.withColumn("_b", F.pmod(F.xxhash64("leaf"), F.lit(blocks)).cast("int")).withColumn("_p", every(parts))
    schema = StructType([asked.schema["read"], held.schema["leaf"], StructField("votes", LongType(), False)])
    best = left.groupBy("_p", "_b").cogroup(right.groupBy("_p", "_b")).applyInArrow(lambda a, b: _band_votes(a, b, band, top), schema)
    return best.withColumn("_r", F.rank().over(Window.partitionBy("read").orderBy(F.desc("votes")))).where(F.col("_r") <= top).drop("_r")


def pair_features(positions: DataFrame, gap: int) -> DataFrame:
    """``id, feature``: hashed pairs of k-mers of one sequence that start up to ``gap`` apart (``id, pos, hash``), with their distance."""
    a, b = positions.select("id", "pos", "hash"), positions.select("id", F.col("pos").alias("pos2"), F.col("hash").alias("hash2"))
    near = a.withColumn("slot", F.expr(f"pos div {gap}")).join(b.withColumn("slot", F.explode(F.expr(f"array(pos2 div {gap}, pos2 div {gap} - 1)"))), ["id", "slot"])
    near = near.where((F.col("pos2") > F.col("pos")) & (F.col("pos2") - F.col("pos") <= gap))
    return near.select("id", F.xxhash64("hash", "hash2", F.col("pos2") - F.col("pos")).alias("feature")).distinct()


def shared_features(queries: DataFrame, reps: DataFrame, top: int = 10, weighted: bool = False) -> DataFrame:
    """``id, rep, score``: shared features, plain or each by the log of reps over its holders, of the ``top`` reps, ties kept."""
    weight = F.lit(1.0)
    held = reps.select(F.col("id").alias("rep"), "feature")
    if weighted:
        total = reps.select("id").distinct().count()
        weight = F.log2(F.lit(float(total)) / F.col("_n"))
        held = held.join(reps.groupBy("feature").agg(F.count_distinct("id").alias("_n")), "feature")
    score = queries.join(held, "feature").groupBy("id", "rep").agg(F.sum(weight).alias("score"))
    return score.withColumn("_r", F.rank().over(Window.partitionBy("id").orderBy(F.desc("score")))).where(F.col("_r") <= top).drop("_r")


def thinned(held: DataFrame, budget, floor: int = 1) -> DataFrame:
    """Keys of each unit down to its budget (a column of the unit's number of members, ``members``), least hashes first."""
    rank = F.row_number().over(Window.partitionBy("unit").orderBy(unsigned("hash")))
    return held.withColumn("_r", rank).where(F.col("_r") <= F.greatest(F.lit(floor), budget)).drop("_r")


def signature_groups(held: DataFrame, parts: int) -> DataFrame:
    """``set_id, part, signature``: a digest of each of ``parts`` slices of a set; sets that differ in fewer k-mers than there are parts have one in common."""
    one = held.select("set_id", "hash").distinct().withColumn("part", F.pmod("hash", F.lit(parts)).cast("int"))
    return one.groupBy("set_id", "part").agg(F.expr("bit_xor(xxhash64(7, hash))").alias("signature"))


def group_pairs(groups: DataFrame, small: int = 64) -> DataFrame:
    """Pairs ``a, b`` within groups (``set_id, group``): all in groups up to ``small``, neighbours in order and a star to the first in larger ones."""
    sized = groups.join(groups.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.min("set_id").alias("first")), "group")
    few = sized.where(F.col("n").between(2, small))
    all_ = few.select("group", F.col("set_id").alias("a")).join(few.select("group", F.col("set_id").alias("b")), "group").where("a < b").select("a", "b")
    many = sized.where(F.col("n") > small)
    chain = many.select(F.lag("set_id").over(Window.partitionBy("group").orderBy("set_id")).alias("a"), F.col("set_id").alias("b")).where("a is not null")
    star = many.where("set_id <> first").select(F.col("first").alias("a"), F.col("set_id").alias("b"))
    return all_.unionByName(chain).unionByName(star).distinct()


def prefix_join(held: DataFrame, least: float) -> DataFrame:
    """``a, b, shared, jaccard`` of sets of at least that Jaccard similarity, by prefix filtering: hashes in rising frequency, of which similar sets share one among the first few; exact.

    What a pair shares outside both prefixes lies in the rest of the set whose prefix ends first. Only pairs for which that
    could make up what their prefixes lack meet their whole sets.
    """
    one = cut(held.select("set_id", "hash").distinct())
    freq = one.groupBy("hash").agg(F.count(F.lit(1)).alias("f")).where("f > 1")
    sizes = one.groupBy("set_id").agg(F.count(F.lit(1)).alias("size"))
    ranked = one.join(freq, "hash", "left").join(sizes, "set_id").withColumn("_r", F.row_number().over(Window.partitionBy("set_id").orderBy(F.coalesce("f", F.lit(1)), "hash")))
    prefix = cut(ranked.where((F.col("_r") <= F.col("size") - F.ceil(F.col("size") * least) + 1) & F.col("f").isNotNull()).select("set_id", "hash", "size"))
    a, b = prefix.toDF("a", "hash", "sa"), prefix.toDF("b", "hash", "sb")
    near = a.join(b, "hash").where((F.col("a") < F.col("b")) & (F.least("sa", "sb") >= least * F.greatest("sa", "sb")))
    met = near.groupBy("a", "b").agg(F.count(F.lit(1)).alias("_met"), F.first("sa").alias("sa"), F.first("sb").alias("sb"))
    rest = F.greatest(F.ceil(F.greatest("sa", "sb") * least) - 1, F.lit(0))
    found = met.where(F.col("_met") + rest >= (F.col("sa") + F.col("sb")) * (least / (1 + least)) - 1e-6).select("a", "b")
    weighed = pair_weights(found, one)
    jac = F.col("shared") / (F.col("shared") + F.col("weight"))
    return weighed.withColumn("jaccard", jac).where(F.col("jaccard") >= least).select("a", "b", "shared", "jaccard")


def packed_chunks(leaves: DataFrame, budget: int) -> DataFrame:
    """``pos, chunk``: leaves in order by next fit (``pos, size``): a chunk starts when the one before would pass ``budget``. Sequential by its nature; a leaf is two numbers."""

    def walk(batches):
        room, chunk = budget, -1
        for b in batches:
            out = []
            for n in b["size"]:
                if chunk < 0 or n > room:
                    chunk, room = chunk + 1, budget
                room -= n
                out.append(chunk)
            yield pd.DataFrame({"pos": b["pos"], "chunk": np.array(out, np.int64)})

    return leaves.select("pos", "size").coalesce(1).sortWithinPartitions("pos").mapInPandas(walk, "pos long, chunk long")


def set_ids(df: DataFrame, keys: list[str]) -> DataFrame:
    """Dense set ids in the order of ``keys``."""
    return dense_ids(df.select(*keys).distinct(), keys, "set_id")
