"""Families of sequences: columns, composition, centroids, alphabets, survival of k-mers, held-out samples."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.alphabets import alphabet
from ..functions.kmers import KmerParams, kmer_hashes, text_slices
from ..lineage import cut
from ..sources.alignments import CIGAR
from .evaluate import hash_order
from .graph import connected
from .identity import SurvivalModel


# Columns of a profile.


def open_frames(aa: str, least: int = 1) -> list[tuple[int, str]]:
    """Start and residues of the stretches between stops that have ``least`` residues."""
    out, at = [], 0
    for part in aa.split("*"):
        if len(part) >= least:
            out.append((at, part))
        at += len(part) + 1
    return out


def profile_columns(hmm_from: int, ali_from: int, cigar: str, sequence: str) -> list[tuple[int, str]]:
    """(profile column, residue) of a domain from its CIGAR, columns from 0; insertions have none, deletions are '-'."""
    col, at, out = hmm_from - 1, ali_from - 1, []
    for n, op in ((int(m[1]), m[2]) for m in CIGAR.finditer(cigar)):
        if op in "M=X":
            out += [(col + i, sequence[at + i]) for i in range(n)]
            col, at = col + n, at + n
        elif op == "I":
            at += n
        elif op == "D":
            out += [(col + i, "-") for i in range(n)]
            col += n
    return out


def column_entropy(columns: DataFrame, by: list[str], residue: str = "residue") -> DataFrame:
    """``by, n, entropy`` in bits of the residues of each column, gaps left out."""
    counts = columns.where(F.col(residue) != "-").groupBy(*by, residue).agg(F.count(F.lit(1)).alias("c"))
    total = F.sum("c").over(Window.partitionBy(*by))
    share = F.col("c") / total
    return counts.withColumn("_h", -share * F.log2(share)).groupBy(*by).agg(F.sum("c").alias("n"), F.sum("_h").alias("entropy"))


def column_ranks(columns: DataFrame, family: str = "family", col: str = "col") -> DataFrame:
    """Columns of each family by falling entropy, ties to the first: ``rank`` from 1."""
    e = column_entropy(columns, [family, col])
    return e.withColumn("rank", F.row_number().over(Window.partitionBy(family).orderBy(F.desc("entropy"), col)))


def greedy_columns(rows: list[str], width: int, picks: int) -> list[tuple[int, ...]]:
    """Sets of ``width`` columns of an alignment, each grown greedily by the column that adds most entropy of the joint residues; columns are used once."""
    grid = np.array([list(r) for r in rows])
    free, out = set(range(grid.shape[1])), []

    def entropy(cols):
        _, n = np.unique(grid[:, cols], axis=0, return_counts=True)
        p = n / n.sum()
        return float(-(p * np.log2(p)).sum())

    while len(out) < picks and len(free) >= width:
        own: list[int] = []
        for _ in range(width):
            own.append(max(sorted(free - set(own)), key=lambda c: entropy([*own, c])))
        free -= set(own)
        out.append(tuple(sorted(own)))
    return out


def column_agreement(hits: DataFrame, truth: DataFrame, least_share: float = 0.5, eps: float = 1e-9) -> DataFrame:
    """``read, unit, identity`` of the units that agree best with a read over shared columns (``hits``: ``read, family, col, residue``; ``truth``: ``unit, family, col, residue``), where these are ``least_share`` of the read's; ties within ``eps`` stay."""
    met = hits.join(truth.withColumnRenamed("residue", "_t"), ["family", "col"]).groupBy("read", "family", "unit").agg(F.count(F.lit(1)).alias("shared"), F.count_if(F.col("residue") == F.col("_t")).alias("same"))
    met = met.join(hits.groupBy("read", "family").agg(F.count(F.lit(1)).alias("columns")), ["read", "family"]).where(F.col("shared") >= least_share * F.col("columns"))
    best = met.groupBy("read", "unit").agg(F.max(F.col("same") / F.col("shared")).alias("identity"))
    return best.withColumn("_b", F.max("identity").over(Window.partitionBy("read"))).where(F.col("identity") >= F.col("_b") - eps).drop("_b")


def weak_bar(real: DataFrame, null: DataFrame, fdr: float = 0.05) -> float:
    """The least score, to a tenth, at which null scores are at most ``fdr`` of the real ones; infinite if there is none. Tenths with their counts are all that reaches the driver."""
    at = F.round("score", 1).alias("s")
    n = {r["s"]: r["count"] for r in real.groupBy(at).count().collect()}
    d = {r["s"]: r["count"] for r in null.groupBy(at).count().collect()}
    for s in sorted(n):
        if sum(c for x, c in d.items() if x >= s) <= fdr * sum(c for x, c in n.items() if x >= s):
            return float(s)
    return math.inf


# Composition and alphabets.


def surprisal(df: DataFrame, p: KmerParams, keep: list[str], frequency: dict[str, float], sequence: str = "sequence") -> DataFrame:
    """``keep, hash, bits`` of the k-mers of each sequence: minus the log of the chance of their letters under ``frequency`` (summed over a class)."""
    from pyspark.sql.types import StructType

    logs = np.zeros(256)
    for group in alphabet(p.name).classes:
        value = math.log2(max(sum(frequency.get(c, 0.0) for c in group), 1e-9))
        for c in group:
            logs[[ord(c), ord(c.lower())]] = value
    schema = StructType([*(df.schema[c] for c in keep), *StructType.fromDDL("hash long, bits double").fields])

    def run(batches):
        for b in batches:
            seqs = [(s or "").encode() for s in b[sequence]]
            which, at, h = kmer_hashes(seqs, p)
            sums = [np.r_[0, np.cumsum(logs[np.frombuffer(s, np.uint8)])] for s in seqs]
            rows = b[keep].iloc[which].reset_index(drop=True)
            rows["hash"], rows["bits"] = h.view(np.int64), np.array([sums[i][a] - sums[i][a + p.k] for i, a in zip(which, at)], float)
            yield rows

    return df.select(*dict.fromkeys([*keep, sequence])).mapInPandas(run, schema)


def alphabet_objective(classes: list[int], frequency: np.ndarray, substitutions: np.ndarray, identity: float = 0.7) -> float:
    """The log of a letter's survival at ``identity`` for each bit of chance match: higher is better."""
    c = np.array(classes)
    share = np.bincount(c, frequency, c.max() + 1)
    bits = -math.log2(float((share**2).sum()))
    moved = substitutions * (1 - np.eye(len(c)))
    within = float((moved * (c[:, None] == c)).sum() / moved.sum())
    return math.log(identity + (1 - identity) * within) / max(bits, 1e-12)


def optimised_alphabet(n: int, frequency: np.ndarray, substitutions: np.ndarray, identity: float = 0.7) -> list[int]:
    """Classes of residues: from one class each the best merge is taken down to ``n``, then single residues move while that helps."""
    value = lambda c: alphabet_objective(c, frequency, substitutions, identity)
    c = list(range(len(frequency)))
    while len(set(c)) > n:
        c = max(([a if x == b else x for x in c] for a, b in combinations(sorted(set(c)), 2)), key=value)
    while True:
        moves = [[t if i == r else x for i, x in enumerate(c)] for r in range(len(c)) for t in sorted(set(c)) if t != c[r]]
        best = max((m for m in moves if len(set(m)) == n), key=value, default=c)
        if value(best) <= value(c) + 1e-12:
            return c
        c = best


# Groups.


def centroids(kmers: DataFrame, lengths: DataFrame, least_share: float = 0.3) -> DataFrame:
    """``component, id, centre``: greedy clustering, longest first (ties to the least id): a sequence joins the first centre that holds ``least_share`` of its k-mers, else it is one (``kmers``: ``component, id, hash``; ``lengths``: ``id, length``). Components share no k-mers and are clustered in a task each."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        sets = {i: set(x) for i, x in g.groupby("id")["hash"]}
        length = g.groupby("id")["length"].first()
        holders: dict[int, list[int]] = {}
        out, centre_rank = [], {}
        for i in sorted(sets, key=lambda i: (-length[i], i)):
            votes: dict[int, int] = {}
            for h in sets[i]:
                for c in holders.get(h, ()):
                    votes[c] = votes.get(c, 0) + 1
            ok = [c for c, n in votes.items() if n >= least_share * len(sets[i])]
            centre = min(ok, key=centre_rank.get) if ok else i
            if centre == i:
                centre_rank[i] = len(centre_rank)
                for h in sets[i]:
                    holders.setdefault(h, []).append(i)
            out.append((g["component"].iloc[0], i, centre))
        return pd.DataFrame(out, columns=["component", "id", "centre"])

    return kmers.join(lengths, "id").groupBy("component").applyInPandas(run, "component long, id long, centre long")


def neighbourhoods(forest: DataFrame, nodes: DataFrame, distance: float) -> DataFrame:
    """``node, component`` of what is joined by forest edges (``a, b, weight``) of at most ``distance``: in a minimum forest the groups of minimax distance."""
    return connected(nodes, forest.where(F.col("weight") <= distance))


def expected_difference(identity: Column, length: Column, k: int) -> Column:
    """Expected size of the symmetric difference of two sequences' k-mer sets at an identity."""
    return 2 * F.greatest(length - k + 1, F.lit(1)) * (1 - F.pow(identity, F.lit(float(k))))


def soft_keys(held: DataFrame, groups: DataFrame, share: float = 0.5) -> DataFrame:
    """``group, hash`` held by at least ``share`` of a group's members (``held``: ``id, hash``; ``groups``: ``id, group``)."""
    sizes = groups.groupBy("group").agg(F.count_distinct("id").alias("_n"))
    own = held.select("id", "hash").distinct().join(groups, "id").groupBy("group", "hash").agg(F.count(F.lit(1)).alias("c"))
    return own.join(sizes, "group").where(F.col("c") >= share * F.col("_n")).select("group", "hash")


# Held-out samples and scores.


def held_out(near: DataFrame, bins: list[float], per_bin: int, seed: int = 0) -> DataFrame:
    """``id, relative, bin``: up to ``per_bin`` sequences per bin of the identity to their nearest relative (``id, relative, identity``), none of which is another's relative.

    A row conflicts with an earlier one of the shuffle if one's relative is the other; rows without an earlier conflict are
    taken, which is the same for any order of work. Bins run from their value up; the sample is the operator.
    """
    label = F.lit(None).cast("double")
    for b in sorted(bins):
        label = F.when(F.col("identity") >= b, F.lit(float(b))).otherwise(label)
    rows = cut(near.withColumn("bin", label).where("bin is not null").withColumn("_o", F.struct(hash_order(seed, "id").alias("h"), F.col("id").alias("i"))))
    a, b = rows.select("id", "relative", "_o"), rows.select(F.col("id").alias("id2"), F.col("relative").alias("rel2"), F.col("_o").alias("_o2"))
    clash = a.join(b, a["relative"] == b["id2"]).where("_o2 < _o").select("id").unionByName(a.join(b, a["id"] == b["rel2"]).where("_o2 < _o").select("id")).distinct()
    free = rows.join(clash, "id", "left_anti")
    rank = F.row_number().over(Window.partitionBy("bin").orderBy("_o"))
    return free.withColumn("_r", rank).where(F.col("_r") <= per_bin).select("id", "relative", "bin")


def group_scores(truth: DataFrame, detected: DataFrame) -> DataFrame:
    """One row, ``groups, hit, purity``: ambiguity groups (``unit, group``) that hold a true unit, and the mean share of true units in a group."""
    t = truth.select("unit").distinct().withColumn("true", F.lit(1.0))
    per = detected.join(t, "unit", "left").groupBy("group").agg(F.avg(F.coalesce("true", F.lit(0.0))).alias("p"))
    return per.agg(F.count(F.lit(1)).alias("groups"), F.count_if(F.col("p") > 0).alias("hit"), F.avg("p").alias("purity"))


def split_scores(truth: DataFrame, detected: DataFrame) -> DataFrame:
    """``component, l1``: the difference of shares within a component (``unit, component, abundance``) between truth and what is detected."""
    share = lambda df, n: df.select("component", "unit", (F.col("abundance") / F.sum("abundance").over(Window.partitionBy("component"))).alias(n))
    both = share(truth, "_t").join(share(detected, "_d"), ["component", "unit"], "full")
    return both.groupBy("component").agg(F.sum(F.abs(F.coalesce("_t", F.lit(0.0)) - F.coalesce("_d", F.lit(0.0)))).alias("l1"))


def presence_scores(detected: DataFrame, truth: DataFrame) -> DataFrame:
    """``true, units, mean_presence``."""
    t = truth.select("unit").distinct().withColumn("_t", F.lit(True))
    return detected.join(t, "unit", "left").groupBy(F.coalesce("_t", F.lit(False)).alias("true")).agg(F.count(F.lit(1)).alias("units"), F.avg("present_prob").alias("mean_presence"))


# Survival of k-mers.


def pair_survival(pairs: DataFrame, members: DataFrame, p: KmerParams, lags: tuple[int, ...] = (1, 2, 5)) -> DataFrame:
    """``id, cluster, identity, shared, n_kmers, survival`` and, over a sequence's windows in order, ``window_survival`` and ``both_j``: shares of windows, and of window pairs j apart, that are in a cluster's k-mers (``pairs``: ``id, cluster, identity``; ``members``: ``id, cluster, sequence``). A member is left out of its own cluster.

    Windows are walked where a sequence lies, with the list of its k-mers that tell: of a pair of a member and its own
    cluster those that no other member has, else those that the cluster has. So what is shuffled are sequences, counts by
    cluster and k-mer, and these lists, but no row of a window.
    """
    texts = cut(members.select("id", "sequence").where("id is not null").dropDuplicates(["id"]))
    member = cut(members.select("id", "cluster").where("id is not null and cluster is not null").distinct())
    asked = cut(pairs.select("id", "cluster", "identity").distinct().join(member.withColumn("own", F.lit(True)), ["id", "cluster"], "left").withColumn("own", F.coalesce("own", F.lit(False))))
    held = _distinct_kmers(member.join(texts, "id"), p).groupBy("cluster", "hash").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id"))
    alone = held.where("n = 1").select("id", "cluster", "hash")
    other = asked.where("not own").select("id", "cluster").distinct()
    met = _distinct_kmers(other.join(texts, "id"), p).join(held.select("cluster", "hash"), ["cluster", "hash"]).select("id", "cluster", "hash")
    told = alone.unionByName(met).groupBy("id", "cluster").agg(F.collect_list("hash").alias("told"))
    rows = asked.join(told, ["id", "cluster"], "left").join(texts, "id").select("id", "cluster", "identity", "own", "told", "sequence")
    values = ["shared", "n_kmers", "window_survival", *(f"both_{j}" for j in lags)]
    types = [T.LongType(), T.LongType(), *[T.DoubleType()] * (1 + len(lags))]
    schema = T.StructType([*(rows.schema[c] for c in ("id", "cluster", "identity")), *(T.StructField(c, t) for c, t in zip(values, types))])

    def run(batches):
        import pyarrow as pa

        for batch in (x for b in batches for x in text_slices(b)):
            which, out = [], []
            for i, (own, told, s) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("own", "told", "sequence")))):
                _, _, h = kmer_hashes([(s or "").encode()], p)
                if not len(h):
                    continue
                h = h.view(np.int64)
                found = np.isin(h, np.array(told or [], np.int64), invert=own)
                both = [float((found[j:] & found[:-j]).mean()) if len(h) > j else None for j in lags]
                which.append(i)
                out.append((len(np.unique(h[found])), len(np.unique(h)), float(found.mean()), *both))
            columns = zip(*out) if out else [[]] * len(values)
            arrays = [pa.array(list(x), pa.int64() if n < 2 else pa.float64()) for n, x in enumerate(columns)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(which, pa.int64())) for c in ("id", "cluster", "identity")), *arrays], schema.names)

    return rows.mapInArrow(run, schema).withColumn("survival", F.col("shared") / F.col("n_kmers"))


def _distinct_kmers(rows: DataFrame, p: KmerParams) -> DataFrame:
    """``id, cluster, hash``: the distinct k-mers of each row's ``sequence``, made where it lies."""
    schema = T.StructType([rows.schema["id"], rows.schema["cluster"], T.StructField("hash", T.LongType())])

    def run(batches):
        import pyarrow as pa

        for batch in (x for b in batches for x in text_slices(b)):
            which, _, h = kmer_hashes([(s or "").encode() for s in batch.column("sequence").to_pylist()], p)
            order = np.lexsort((h, which))
            which, h = which[order], h[order]
            new = np.flatnonzero(np.r_[True, (which[1:] != which[:-1]) | (h[1:] != h[:-1])]) if len(h) else np.zeros(0, np.int64)
            at = pa.array(which[new], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id").take(at), batch.column("cluster").take(at), pa.array(h[new].view(np.int64))], ["id", "cluster", "hash"])

    return rows.select("id", "cluster", "sequence").mapInArrow(run, schema)


def fit_survival(points: list[tuple[float, float, float]], k: int, shapes=(0.3, 0.5, 1.0, 2.0, 4.0), regions=(1.0, 3.0, 10.0, 30.0), steps: int = 12) -> SurvivalModel:
    """The gamma model nearest to (identity, survival, weight) points in weighted squares: a coarse grid, then halved steps on the logarithms of shape and region. Points are bins, a list as long as there are bins."""
    a, s, w = (np.array(x, float) for x in zip(*points))

    def loss(shape, region):
        return float((w * (SurvivalModel(k, shape=shape, region=max(region, 1.0)).survival(a) - s) ** 2).sum())

    best = min(((x, y) for x in shapes for y in regions), key=lambda v: loss(*v))
    step, least = math.log(2), loss(*best)
    for _ in range(steps):
        near = [(best[0] * math.exp(i * step), max(1.0, best[1] * math.exp(j * step))) for i, j in ((1, 0), (-1, 0), (0, 1), (0, -1))]
        value, cand = min((loss(*v), v) for v in near)
        if value < least - 1e-15:
            best, least = cand, value
        else:
            step /= 2
    return SurvivalModel(k, shape=best[0], region=best[1])
