"""Routing by anchored columns against plain loops, and the recall of its first stages on planted reads."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from strandlake.operators import anchored

LETTERS = anchored.RESIDUES
MEMBERS = "family long, unit long, row long, residues string"
HITS = "read long, family long, hit long, residues string, strength string"


def family_rows(rng, families=3, units=12, columns=30):
    """Families with units of one to three rows, some of them alike."""
    rows, n = [], 0
    for f in range(families):
        root = rng.choice(list(LETTERS), columns)
        for u in range(units):
            unit = np.where(rng.random(columns) < 0.3, rng.choice(list(LETTERS + "-X"), columns), root)
            for _ in range(rng.integers(1, 4)):
                rows.append((f, 100 * f + u, n, "".join(np.where(rng.random(columns) < 0.05, rng.choice(list(LETTERS), columns), unit))))
                n += 1
    return rows + [(0, 50, n, rows[0][3]), (0, 50, n + 1, rows[1][3])]


def read_hits(rng, members, reads, mutated):
    hits, truth = [], {}
    for r in range(reads):
        f, u, _, text = members[rng.integers(len(members))]
        truth[r] = u
        for h, (lo, hi) in enumerate([(0, 14), (12, 30)][: rng.integers(1, 3)]):
            cells = [c if lo <= i < hi else "-" for i, c in enumerate(text)]
            cells = [LETTERS[rng.integers(20)] if c != "-" and rng.random() < mutated else c for c in cells]
            hits.append((r, f, h, "".join(cells), ["ga", "weak", "set", None, "one"][rng.integers(5)]))
    return hits, truth


def plain_entropy(members):
    first = {}
    for f, u, row, text in members:
        if (f, u) not in first or row < first[f, u][0]:
            first[f, u] = (row, text)
    out = {}
    for fam in {f for f, _ in first}:
        texts = [t for (f, _), (_, t) in first.items() if f == fam]
        for c in range(len(texts[0])):
            p = np.array([sum(t[c] == x for t in texts) + 0.1 for x in LETTERS])
            p /= p.sum()
            out[fam, c] = float(-(p * np.log2(p)).sum())
    return out


def plain_calls(hits, members, n, keep, least_share=0.6, near=0.02):
    entropy, by_unit = plain_entropy(members), defaultdict(list)
    for f, u, row, text in members:
        by_unit[f, u].append((row, text))
    groups = defaultdict(list)
    for r, f, _, text, strength in hits:
        groups[r, f].append((text, strength))
    best = {}
    for (r, f), own in sorted(groups.items()):
        if not any(g == f for g, _ in by_unit):
            continue
        merged = [max(cells) for cells in zip(*(t for t, _ in own))]
        at = sorted((c for c, x in enumerate(merged) if x != "-"), key=lambda c: (-round(entropy[f, c], 6), c))[:n]
        units = {u: rows for (g, u), rows in by_unit.items() if g == f}
        count = {u: max(sum(t[c] == merged[c] for c in at) for _, t in rows) for u, rows in units.items()}
        bar = sorted(count.values(), reverse=True)[max(1, math.ceil(keep * len(units))) - 1]
        cand = [u for u in units if count[u] >= bar]
        columns = sum(sum(x != "-" for x in t) for t, _ in own)
        found = {}
        for u in cand:
            m_all = s_all = 0
            per_row = Counter()
            for t, _ in own:
                cells = [(x, i) for i, x in enumerate(t) if x != "-"]
                pairs = []
                for row, text in units[u]:
                    s = sum(text[i] != "-" for _, i in cells)
                    m = sum(text[i] == x != "X" for x, i in cells)
                    if s >= least_share * len(cells):
                        pairs.append((m, s))
                        per_row[row] += m
                if pairs:
                    m, s = max(pairs)
                    m_all, s_all = m_all + m, s_all + s
            if s_all > 0 and s_all >= least_share * columns:
                found[u] = (m_all, m_all / columns, min(per_row, key=lambda x: (-per_row[x], x)))
        if found:
            top = max(i for _, i, _ in found.values())
            if r not in best or top > best[r][0]:
                order = anchored.STRENGTHS
                strength = min((s for _, s in own if s), key=order.index, default=None)
                best[r] = (top, {(r, f, u, i == top, row, m, columns, round(i, 9), len(cand), strength) for u, (m, i, row) in found.items() if i >= top - near})
    return set().union(*(x for _, x in best.values())) if best else set()


@pytest.mark.parametrize("n, keep", [(6, 0.2), (1, 0.01), (40, 1.0)])
def test_calls_equal_a_plain_loop(spark, n, keep):
    rng = np.random.default_rng(n)
    members = family_rows(rng)
    hits, _ = read_hits(rng, members, 40, 0.2)
    # Reads that nothing agrees with, in two families, repeated, and with no column at all.
    hits += [(90, 0, 0, "W" * 30, "ga"), (91, 0, 0, hits[0][3], "one"), (91, 1, 1, hits[0][3], "ga"), hits[0], (92, 1, 0, "-" * 30, "ga"), (93, 7, 0, "A" * 30, "ga")]
    got = anchored.route_calls(spark.createDataFrame(hits + [(94, 0, 0, None, None)], HITS), spark.createDataFrame(members, MEMBERS), n, keep).collect()
    found = {(r["read"], r["family"], r["unit"], r["called"], r["row"], r["matches"], r["columns"], round(r["identity"], 9), r["candidates"], r["strength"]) for r in got}
    assert len(got) == len(found) and found == plain_calls(hits, members, n, keep)


def test_entropy_equals_a_plain_loop(spark):
    members = family_rows(np.random.default_rng(3))
    got = {(r["family"], r["col"]): r["entropy"] for r in anchored.informative_columns(spark.createDataFrame(members, MEMBERS)).collect()}
    want = plain_entropy(members)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_planted_reads_keep_their_units(spark):
    """Of the reads whose unit is among the best of all units, at least 0.95 keep it through both first stages."""
    rng = np.random.default_rng(8)
    members = family_rows(rng, 5, 60, 30)
    hits, truth = read_hits(rng, members, 300, 0.08)
    frame = spark.createDataFrame(members, MEMBERS)
    families = anchored.seeded_families(spark.createDataFrame([(r, t) for r, _, _, t, _ in hits], "read long, residues string"), frame, 4)
    picked = {(r["read"], r["family"]) for r in families.collect()}
    assert sum((r, truth[r] // 100 if truth[r] != 50 else 0) in picked for r in truth) >= 0.95 * len(truth)
    whole = {(x[0], x[2]) for x in plain_calls(hits, members, 99, 1.0) if x[3]}
    mine = {r for r in truth if (r, truth[r]) in whole}
    got = anchored.route_calls(spark.createDataFrame(hits, HITS), frame, 12, 0.1).where("called").collect()
    kept = {r["read"] for r in got if truth[r["read"]] == r["unit"]}
    assert len(mine) > 200 and len(kept & mine) >= 0.95 * len(mine)


def test_seeds_equal_a_plain_loop(spark):
    rng = np.random.default_rng(11)
    members = family_rows(rng)
    reads = [(i, t) for i, (_, _, _, t, _) in enumerate(read_hits(rng, members, 20, 0.3)[0])] + [(90, ""), (91, None), (92, "-" * 30), (93, "AC")]
    for width, every in ((3, 1), (4, 3)):
        def seeds(t):
            return {(c, t[c : c + width]) for c in range(0, len(t or "") - width + 1, every) if "-" not in t[c : c + width]}

        units = defaultdict(set)
        for f, u, _, t in members:
            units[f, u] |= seeds(t)
        want = set()
        for r, t in reads:
            best = Counter()
            for (f, _), s in units.items():
                best[f] = max(best[f], len(s & seeds(t)))
            top = max(best.values())
            want |= {(r, f, top) for f, c in best.items() if c == top > 0}
        got = anchored.seeded_families(spark.createDataFrame(reads, "read long, residues string"), spark.createDataFrame(members, MEMBERS), width, every)
        assert {tuple(r) for r in got.select("read", "family", "seeds").collect()} == want


def test_nothing(spark):
    none, members = spark.createDataFrame([], HITS), spark.createDataFrame([], MEMBERS)
    assert anchored.route_calls(none, members, 3, 0.1).count() == 0
    assert anchored.route_calls(spark.createDataFrame([(1, 1, 0, "ACD", None)], HITS), members, 3, 0.1).count() == 0


def test_pairs_and_candidates_are_never_rows(spark, monkeypatch):
    """What is stored grows with reads and members, not with reads times units; blocks of any size give the same."""
    import random

    rng = random.Random(11)
    letters = "ACDEFGHIKL"
    word = lambda: "".join(rng.choices(letters, k=40))
    rows = [(f, u, 10 * u + r, word()) for f in ("a", "b") for u in range(60) for r in range(2)]
    reads = [(i, f, t[:25] + "-" * 15) for i in range(50) for f, _, _, t in rng.sample(rows, 2)]
    members = spark.createDataFrame(rows, "family string, unit long, row long, residues string")
    hits = spark.createDataFrame(reads, "read long, family string, residues string")
    stored = []
    real = anchored.cut
    monkeypatch.setattr(anchored, "cut", lambda df: stored.append(real(df)) or stored[-1])
    want = sorted(map(tuple, anchored.route_calls(hits, members, 8, 0.3).collect()), key=repr)
    assert max(t.count() for t in stored) <= len(rows)
    met = anchored._met
    monkeypatch.setattr(anchored, "_met", lambda *args: met(*args, reads=7, rows=13))
    assert len(want) >= 50 and sorted(map(tuple, anchored.route_calls(hits, members, 8, 0.3).collect()), key=repr) == want


def test_hits_of_seeds_are_never_rows(spark, monkeypatch):
    """Groups of any size give the same families, and nothing that is stored has a row for each hit."""
    rng = np.random.default_rng(2)
    word = lambda: "".join(rng.choice(list("AC"), 12))
    members = spark.createDataFrame([(f, u, 10 * u, word()) for f in ("a", "b", "c") for u in range(40)], "family string, unit long, row long, residues string")
    reads = spark.createDataFrame([(i, word()) for i in range(50)], "read long, residues string")
    stored = []
    real = anchored.cut
    monkeypatch.setattr(anchored, "cut", lambda df: stored.append(real(df)) or stored[-1])
    want = sorted(map(tuple, anchored.seeded_families(reads, members, 3).collect()))
    assert len(want) >= 50 and [x.count() for x in stored] == [50 * 10, 120 * 10]
    assert sorted(map(tuple, anchored.seeded_families(reads, members, 3, 1, 60, 90).collect())) == want
