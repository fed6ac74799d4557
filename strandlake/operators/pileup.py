"""Weighted pileups of reads on reference sequences, their refinement and haplotypes.

Alignments come as ``read, mate, seq, unit, role, score`` with a ``hit`` id; their columns as ``hit, col, qpos, residue, ref,
term``, where ``term`` is the column's share of the score in bits. All but the mixtures are windows and joins on these keys.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import cut
from .graph import dense_ids


MATE = ("read", "mate")


def filter_hits(hits: DataFrame, top: float | None = None, below_best: float | None = None, below_unit_best: float | None = None, least_identity: float | None = None) -> DataFrame:
    """``hits`` with ``dropped_by``: null, or the first rule that a hit breaks: more than ``top`` percent or ``below_best`` bits under its mate's best, ``below_unit_best`` bits under the best of its unit, or an identity of the mate's best hit under ``least_identity``."""
    mate, unit = Window.partitionBy(*MATE), Window.partitionBy(*MATE, "unit")
    best = F.max("score").over(mate)
    rules = []
    if top is not None:
        rules.append((F.col("score") < best * (1 - top / 100), "top"))
    if below_best is not None:
        rules.append((F.col("score") < best - below_best, "below_best"))
    if below_unit_best is not None:
        rules.append((F.col("score") < F.max("score").over(unit) - below_unit_best, "below_unit_best"))
    if least_identity is not None:
        rules.append((F.max_by("identity", "score").over(mate) < least_identity, "identity"))
    out = F.lit(None).cast("string")
    for test, name in reversed(rules):
        out = F.when(test, name).otherwise(out)
    return hits.withColumn("dropped_by", out)


def posteriors(hits: DataFrame) -> DataFrame:
    """``hits`` with ``e`` (2 to the score less the mate's best), ``total``, ``posterior`` and ``kept``: whether the mate's best hit is to a target (ties in favour of the role that sorts last)."""
    mate = Window.partitionBy(*MATE)
    e = F.pow(F.lit(2.0), F.col("score") - F.max("score").over(mate))
    rows = hits.withColumn("e", e).withColumn("total", F.sum("e").over(mate)).withColumn("posterior", F.col("e") / F.col("total"))
    return rows.withColumn("kept", F.max_by("role", F.struct("score", "role")).over(mate) == "target")


def column_weights(columns: DataFrame, hits: DataFrame) -> DataFrame:
    """Columns with their hit's fields, ``weight`` and ``sibling``.

    The weight is the posterior of the alignment with this column left out of all alignments of the mate, so that a
    residue does not vote for the sequence that already has it. ``sibling``: the residue differs from its reference, but
    another unit has it there.
    """
    rows = columns.join(hits.select("hit", *MATE, "seq", "role", "unit", "e", "total", "kept", "posterior"), "hit")
    # In the order of ``ref``, so that both windows share one sort as they share one shuffle.
    at = Window.partitionBy(*MATE, "qpos").orderBy("ref").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    same_ref = Window.partitionBy(*MATE, "qpos", "ref")
    out = F.pow(F.lit(2.0), -F.col("term"))
    # What lies elsewhere keeps its share, what lies here is taken without this column; both sums are of positive terms.
    rows = rows.withColumn("_here", F.sum(F.col("e") * out).over(at)).withColumn("_else", F.greatest(F.col("total") - F.sum("e").over(at), F.lit(0.0)))
    rows = rows.withColumn("weight", F.when(F.col("qpos") >= 0, F.col("e") * out / (F.col("_else") + F.col("_here"))).otherwise(F.col("posterior"))).drop("_here", "_else")
    # Of each reference residue here, the first and the last unit that has it: no more of them than there are letters.
    rows = rows.withColumn("_least", F.min("unit").over(same_ref)).withColumn("_most", F.max("unit").over(same_ref))
    rows = rows.withColumn("_refs", F.collect_set(F.struct("ref", "_least", "_most")).over(at))
    another = F.exists("_refs", lambda r: (r["ref"] == F.col("residue")) & ((r["_least"] != r["_most"]) | (r["_least"] != F.col("unit"))))
    sibling = F.col("read").isNotNull() & F.col("mate").isNotNull() & (F.col("qpos") >= 0) & (F.col("residue") != F.col("ref")) & another
    return rows.withColumn("sibling", F.coalesce(sibling, F.lit(False))).drop("_least", "_most", "_refs")


def pile(weighted: DataFrame) -> DataFrame:
    """``seq, col, residue, weight, sibling_weight`` of the alignments to targets that are kept."""
    on = weighted.where("kept and role = 'target'")
    return on.groupBy("seq", "col", "residue").agg(F.sum("weight").alias("weight"), F.sum(F.when(F.col("sibling"), F.col("weight")).otherwise(0.0)).alias("sibling_weight"))


def consensus(piled: DataFrame) -> DataFrame:
    """``seq, col, depth, consensus, consensus_weight, alt, alt_freq, sibling_share``: the residue of most weight, ties to the first, and the next."""
    rank = F.row_number().over(Window.partitionBy("seq", "col").orderBy(F.desc("weight"), "residue"))
    ranked = piled.withColumn("_r", rank)
    one = lambda r, c: F.max(F.when(F.col("_r") == r, F.col(c)))
    cols = ranked.groupBy("seq", "col").agg(F.sum("weight").alias("depth"), one(1, "residue").alias("consensus"), one(1, "weight").alias("consensus_weight"), one(2, "residue").alias("alt"), one(2, "weight").alias("_alt"), F.sum("sibling_weight").alias("_sib"))
    return cols.select("seq", "col", "depth", "consensus", "consensus_weight", "alt", (F.coalesce("_alt", F.lit(0.0)) / F.col("depth")).alias("alt_freq"), (F.col("_sib") / F.col("depth")).alias("sibling_share"))


def variants(columns: DataFrame, refs: DataFrame, least_depth: float = 5.0, least_freq: float = 0.1) -> DataFrame:
    """Columns whose consensus differs from the reference residue (``refs``: ``seq, col, ref``) or whose other residue is frequent."""
    both = columns.join(refs, ["seq", "col"])
    return both.where((F.col("depth") >= least_depth) & ((F.col("consensus") != F.col("ref")) | (F.col("alt_freq") >= least_freq)))


def unit_results(weighted: DataFrame, columns: DataFrame, refs: DataFrame, hits: DataFrame) -> DataFrame:
    """``unit, reads, identity, consensus_identity``: posterior-weighted reads and their identity, and that of the consensus with the unit's references."""
    on = weighted.where("kept and role = 'target'")
    each = on.groupBy("hit", "unit").agg(F.avg((F.col("residue") == F.col("ref")).cast("double")).alias("identity"), F.first("posterior").alias("posterior"))
    reads = each.groupBy("unit").agg(F.sum("posterior").alias("reads"), (F.sum(F.col("posterior") * F.col("identity")) / F.sum("posterior")).alias("identity"))
    seqs = hits.select("seq", "unit").distinct()
    same = columns.join(refs, ["seq", "col"]).join(seqs, "seq").groupBy("unit").agg(F.avg((F.col("consensus") == F.col("ref")).cast("double")).alias("consensus_identity"))
    return reads.join(same, "unit", "left")


def source_em(candidates: DataFrame, prior: bool = True, novel: float | None = None, rounds: int = 500, tol: float = 1e-7, most_rows: int = 1_000_000) -> DataFrame:
    """``pair, source, weight`` by EM over the sources that pairs may come from (``component, pair, source, length, mismatches``).

    Each source has an abundance and a divergence; a pair's likelihood is binomial in its differing residues. With ``novel``
    every component also has a class of that divergence, for reads of what is not in the reference (source -1). With
    ``prior`` abundances count in the shares. Components of over ``most_rows`` rows are fitted by the same rounds as
    DataFrame steps, all others by one task each.
    """

    def fit(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["pair", "source"], kind="stable")
        if novel is not None:
            other = g.groupby("pair", as_index=False).agg(length=("length", "max"), mismatches=("mismatches", "max"))
            g = pd.concat([g[["pair", "source", "length", "mismatches"]], other.assign(source=-1)]).sort_values(["pair", "source"], kind="stable")
        pairs, p = np.unique(g["pair"].to_numpy(), return_inverse=True)
        sources, s = np.unique(g["source"].to_numpy(), return_inverse=True)
        n, x = g["length"].to_numpy(float), g["mismatches"].to_numpy(float)
        d, a = np.full(len(sources), 0.05), np.full(len(sources), 1 / len(sources))
        fixed = sources == -1
        d[fixed] = novel or 0.0
        w = np.zeros(len(g))
        for _ in range(rounds):
            logs = x * np.log(d[s]) + (n - x) * np.log1p(-d[s]) + (np.log(np.maximum(a[s], 1e-300)) if prior else 0)
            top = np.full(len(pairs), -np.inf)
            np.maximum.at(top, p, logs)
            e = np.exp(logs - top[p])
            new = e / np.bincount(p, e, len(pairs))[p]
            a = np.bincount(s, new, len(sources)) / len(pairs)
            moved = (np.bincount(s, new * x, len(sources)) + 0.5) / (np.bincount(s, new * n, len(sources)) + 10)
            d = np.where(fixed, d, np.clip(moved, 1e-4, 0.5))
            done = np.abs(new - w).max(initial=0) <= tol
            w = new
            if done:
                break
        return pd.DataFrame({"pair": g["pair"].to_numpy(), "source": g["source"].to_numpy(), "weight": w})

    rows = cut(candidates.select("component", "pair", "source", "length", "mismatches"))
    large = cut(rows.groupBy("component").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most_rows).select("component"))
    if large.isEmpty():
        return rows.groupBy("component").applyInPandas(fit, "pair long, source long, weight double")
    alone = rows.join(large, "component", "left_anti").groupBy("component").applyInPandas(fit, "pair long, source long, weight double")
    return alone.unionByName(_source_em_in_rounds(rows.join(large, "component", "left_semi"), prior, novel, rounds, tol))


def _source_em_in_rounds(rows: DataFrame, prior: bool, novel: float | None, rounds: int, tol: float) -> DataFrame:
    """``source_em`` of components that no task should hold. Pairs are stored with their candidates as one list each; a round is a pass over them with the model, in which tasks sum shares by source, and those sums are added up by a shuffle. Only the model is on the driver: two numbers a source. Components that have settled keep theirs."""
    pair, source = ["component", "pair"], ["component", "source"]
    rows = rows.select(*pair, "source", F.col("length").cast("double").alias("n"), F.col("mismatches").cast("double").alias("x"))
    if novel is not None:
        rows = cut(rows.unionByName(rows.groupBy(*pair).agg(F.lit(-1).cast("long").alias("source"), F.max("n").alias("n"), F.max("x").alias("x"))))
    coded = cut(dense_ids(rows.select(*source).distinct(), source, "code"))
    packed = cut(rows.join(coded, source).groupBy(*pair).agg(F.array_sort(F.collect_list(F.struct("code", "n", "x"))).alias("at")).select("pair", "at", "component"))
    n_pairs = {r["component"]: r["n"] for r in packed.groupBy("component").agg(F.count(F.lit(1)).alias("n")).collect()}  # as many as large components
    model = coded.orderBy("code").toArrow()
    names = model["source"].to_numpy()
    components, part = np.unique(model["component"].to_numpy(), return_inverse=True)
    pairs = np.array([n_pairs[c] for c in components], float)[part]
    fixed = names == -1
    a, d = 1 / np.bincount(part)[part], np.where(fixed, novel or 0.0, 0.05)
    before = None

    def weights(batch, state):
        """The list lengths, codes, lengths, mismatches and shares of a batch of pairs."""
        at = batch.column(1)
        size = at.value_lengths().to_numpy(zero_copy_only=False)
        code, n, x = (c.to_numpy(zero_copy_only=False) for c in at.flatten().flatten())
        a, d = state
        logs = x * np.log(d)[code] + (n - x) * np.log1p(-d)[code] + (np.log(np.maximum(a, 1e-300))[code] if prior else 0)
        starts = np.cumsum(size) - size
        e = np.exp(logs - np.repeat(np.maximum.reduceat(logs, starts), size))
        return size, code, n, x, e / np.repeat(np.add.reduceat(e, starts), size)

    def summed(now, last):
        def run(batches):
            import pyarrow as pa

            sums, moved = np.zeros((3, len(now[0]))), np.full(len(now[0]), -1.0)
            for batch in batches:
                if batch.num_rows:
                    _, code, n, x, w = weights(batch, now)
                    for total, value in zip(sums, (w, w * x, w * n)):
                        total += np.bincount(code, value, len(total))
                    np.maximum.at(moved, code, np.abs(w - weights(batch, last)[-1]) if last else w)
            seen = np.flatnonzero(moved >= 0)
            yield pa.RecordBatch.from_arrays([pa.array(seen), *(pa.array(v[seen]) for v in (*sums, moved))], ["code", "w", "x", "n", "moved"])

        parts = packed.mapInArrow(run, "code long, w double, x double, n double, moved double")
        return parts.groupBy("code").agg(*(F.sum(c).alias(c) for c in ("w", "x", "n")), F.max("moved").alias("moved")).toArrow()

    for i in range(rounds):
        got = summed((a, d), before)
        w, x, n, moved = (got[c].to_numpy()[np.argsort(got["code"].to_numpy())] for c in ("w", "x", "n", "moved"))
        change = np.zeros(len(components))
        np.maximum.at(change, part, moved)
        done = (change <= tol)[part]
        if done.all() or i + 1 == rounds:
            break
        before = a, d
        settled = np.clip((x + 0.5) / (n + 10), 1e-4, 0.5)
        a, d = np.where(done, a, w / pairs), np.where(done | fixed, d, settled)

    def shared(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                size, code, _, _, w = weights(batch, (a, d))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), size)), pa.array(names[code]), pa.array(w)], ["pair", "source", "weight"])

    return packed.mapInArrow(shared, "pair long, source long, weight double")


def best_source(fitted: DataFrame) -> DataFrame:
    """``pair, source, weight``: each pair's source of most weight, ties to the least."""
    rank = F.row_number().over(Window.partitionBy("pair").orderBy(F.desc("weight"), "source"))
    return fitted.withColumn("_r", rank).where("_r = 1").drop("_r")


def refined(columns: DataFrame, hits: DataFrame, rounds: int = 5, least_depth: float = 3.0, least_freq: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """Consensus and sources refined in turn: ``pair, source, weight`` and ``seq, col, residue`` of the last consensus.

    ``columns``: ``hit, seq, col, residue, ref``; ``hits``: ``hit, component, pair, source, length``. A column takes a new
    majority if it has the depth, more than half the weight, and the reference residue has lost its support. At most
    ``rounds`` rounds, fewer if nothing changes.
    """
    current = cut(columns.groupBy("seq", "col").agg(F.first("ref").alias("now")))
    for i in range(rounds + 1):
        rows = columns.join(current, ["seq", "col"])
        mism = rows.groupBy("hit").agg(F.sum((F.col("residue") != F.col("now")).cast("long")).alias("mismatches"))
        best = hits.join(mism, "hit").groupBy("component", "pair", "source").agg(F.max("length").alias("length"), F.min("mismatches").alias("mismatches"))
        fitted = cut(source_em(best, prior=i == rounds))
        if i == rounds:
            break
        weights = hits.join(fitted, ["pair", "source"]).select("hit", "weight")
        piled = columns.where("residue <> '-'").join(weights, "hit").groupBy("seq", "col", "residue").agg(F.sum("weight").alias("weight"), F.first("ref").alias("ref"))
        rank = F.row_number().over(Window.partitionBy("seq", "col").orderBy(F.desc("weight"), "residue"))
        at = Window.partitionBy("seq", "col")
        top = piled.withColumns({"_r": rank, "depth": F.sum("weight").over(at), "_own": F.sum(F.when(F.col("residue") == F.col("ref"), F.col("weight")).otherwise(0.0)).over(at)}).where("_r = 1")
        top = top.where((F.col("depth") >= least_depth) & (F.col("weight") > 0.5 * F.col("depth")) & (F.col("_own") < F.greatest(F.lit(2.0), F.lit(least_freq) * F.col("depth"))))
        new = cut(current.join(top.select("seq", "col", "residue"), ["seq", "col"], "left").select("seq", "col", F.coalesce("residue", "now").alias("now"), (F.coalesce("residue", "now") != F.col("now")).alias("changed")))
        if new.where("changed").isEmpty():
            break
        current = new.drop("changed")
    return fitted, current.withColumnRenamed("now", "residue")


def haplotypes(sites: DataFrame, most: int = 3, error: float = 0.01, rounds: int = 200) -> DataFrame:
    """``seq, haplotype, share, residues`` by a mixture over a sequence's variable columns (``seq, pair, col, residue, base``).

    Haplotype 0 has the consensus ``base`` everywhere; each further one starts as the read that the present ones explain
    worst. The number, up to ``most``, is chosen by the Bayesian criterion.
    """

    def fit(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["pair", "col"], kind="stable")
        pairs, p = np.unique(g["pair"].to_numpy(), return_inverse=True)
        cols, c = np.unique(g["col"].to_numpy(), return_inverse=True)
        letters, r = np.unique(g["residue"].to_numpy().astype(str), return_inverse=True)
        grid = np.full((len(pairs), len(cols)), -1)
        grid[p, c] = r
        index = {x: i for i, x in enumerate(letters)}
        base = np.full(len(cols), -2)
        base[c] = [index.get(x, -2) for x in g["base"].astype(str)]
        hit, miss = math.log(1 - error), math.log(error)

        def score(hap):
            return np.where(grid < 0, 0.0, np.where(grid == hap, hit, miss)).sum(axis=1)

        haps, best = [base], None
        for k in range(1, most + 1):
            if k > 1:
                worst = int(np.argmin(np.max([score(h) for h in haps], axis=0)))
                haps = [*haps, np.where(grid[worst] >= 0, grid[worst], base)]
            share = np.full(k, 1 / k)
            for _ in range(rounds):
                logs = np.stack([score(h) for h in haps], 1) + np.log(np.maximum(share, 1e-12))
                top = logs.max(1, keepdims=True)
                e = np.exp(logs - top)
                w = e / e.sum(1, keepdims=True)
                share = w.mean(0)
                new = [base]
                for j in range(1, k):
                    votes = np.zeros((len(cols), len(letters)))
                    for x in range(len(letters)):
                        votes[:, x] = (w[:, j, None] * (grid == x)).sum(0)
                    new.append(np.where(votes.sum(1) > 0, votes.argmax(1), base))
                same = all((a == b).all() for a, b in zip(new, haps))
                haps = new
                if same:
                    break
            ll = float((top[:, 0] + np.log(e.sum(1))).sum())
            bic = -2 * ll + ((k - 1) * (1 + len(cols))) * math.log(max(len(pairs), 2))
            if best is None or bic < best[0]:
                best = (bic, haps, share)
        _, haps, share = best
        text = ["".join(letters[x] if x >= 0 else "?" for x in h) for h in haps]
        return pd.DataFrame({"seq": g["seq"].iloc[0], "haplotype": np.arange(len(haps), dtype=np.int32), "share": share, "residues": text})

    kind = sites.schema["seq"].dataType.simpleString()
    return sites.groupBy("seq").applyInPandas(fit, f"seq {kind}, haplotype int, share double, residues string")


def codon_pileup(columns: DataFrame, reads: DataFrame) -> DataFrame:
    """``seq, base, letter, weight``: residue columns back in nucleotides, three bases to a column, from the read's codon (``columns``: ``hit, seq, col, codon_start, reverse, weight``; ``reads``: ``hit, seq_read``); bases of reverse reads are complemented."""
    rows = columns.join(reads, "hit").withColumn("_k", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    at = F.when(F.col("reverse"), F.col("codon_start") + 2 - F.col("_k")).otherwise(F.col("codon_start") + F.col("_k"))
    letter = F.upper(F.substring(F.col("seq_read"), at + 1, F.lit(1)))
    letter = F.when(F.col("reverse"), F.translate(letter, "ACGTU", "TGCAA")).otherwise(letter)
    return rows.select("seq", (F.col("col") * 3 + F.col("_k")).alias("base"), letter.alias("letter"), "weight").groupBy("seq", "base", "letter").agg(F.sum("weight").alias("weight"))


def assigned_units(posterior_: DataFrame) -> DataFrame:
    """``read, unit, weight``: each pair's target unit of most posterior over both mates, ties to the least."""
    sums = posterior_.where("role = 'target'").groupBy("read", "unit").agg(F.sum("posterior").alias("weight"))
    return sums.withColumn("_r", F.row_number().over(Window.partitionBy("read").orderBy(F.desc("weight"), "unit"))).where("_r = 1").drop("_r")


def mapping_quality(posterior_: DataFrame) -> DataFrame:
    """The posterior as a Phred-scaled quality, 0 to 60."""
    return posterior_.withColumn("mapq", F.least(F.lit(60), F.greatest(F.lit(0), F.round(-10 * F.log10(F.greatest(1 - F.col("posterior"), F.lit(1e-6)))))).cast("int"))


def gaps_to_ranges(positions: DataFrame, by: str, at: str) -> DataFrame:
    """Runs of consecutive positions: ``by, start, end, n``."""
    island = F.col(at) - F.row_number().over(Window.partitionBy(by).orderBy(at))
    return positions.select(by, at).distinct().withColumn("_g", island).groupBy(by, "_g").agg(F.min(at).alias("start"), F.max(at).alias("end"), F.count(F.lit(1)).alias("n")).drop("_g")


