"""Weights of columns and siblings against plain loops, with odd rows."""

import math

from strandlake.operators import pileup

HITS = "hit long, read long, mate int, seq long, role string, unit long, score double"
COLUMNS = "hit long, col int, qpos long, residue string, ref string, term double"


def odd():
    """Reads with null ids, hits that come twice, null units, letters and places, columns that lie nowhere and columns without a hit."""
    hits = [(1, 7, 0, 1, "target", 10, 3.0), (2, 7, 0, 2, "neighbour", 20, 3.0), (3, 7, 0, 3, "target", 10, 1.0), (4, 7, 1, 1, "target", 30, 2.0)]
    hits += [(5, None, 0, 1, "target", 10, 2.0), (6, None, 0, 2, "target", 20, 2.0), (7, 8, None, 1, "target", 10, 2.0), (8, 8, None, 2, "target", 20, 1.0)]
    hits += [(9, 9, 0, 1, "target", None, 2.0), (10, 9, 0, 2, "target", 20, 2.0), (10, 9, 0, 2, "target", 20, 2.0), (11, 9, 0, 3, None, 30, None), (12, 5, 0, 4, "target", 40, 1.0), (None, 5, 0, 5, "target", 50, 1.0)]
    places = {7: [0, 1, -1, None], None: [0], 8: [0], 9: [0, 1], 5: [2]}
    letters = ["A", "C", "G", None]
    columns = []
    for i, (hit, read, *_) in enumerate(hits):
        for q in places[read]:
            k = i + (q or 0)
            columns.append((hit, 3 + (q or 0), q, letters[k % 4], letters[(k // 2) % 4], 1.5 if k % 4 == k // 2 % 4 else -0.5))
    columns += [(4, 9, 1, "A", "C", 0.5), (99, 1, 0, "A", "A", 1.0), (1, 4, 0, "C", "A", -0.5), (1, 4, 0, "C", "A", -0.5), (2, 4, 0, "A", "C", -0.5), (9, 6, 3, "C", "A", 0.5), (10, 6, 3, "A", "C", 0.5), (3, 8, 9, "A", "C", 0.5), (1, 8, 9, "C", "A", 0.5)]
    return hits, columns


def plain(hits, columns):
    """Each column's weight and whether it is a sibling's, by its fields."""
    rows = [(c, h) for c in columns for h in hits if c[0] is not None and c[0] == h[0]]
    out = []
    for c, h in rows:
        here = [(x, y) for x, y in rows if (y[1], y[2], x[2]) == (h[1], h[2], c[2])]
        units = {y[5] for x, y in here if x[4] is not None and x[4] == c[3]}
        others = {u for u in units if u is not None}
        known = h[1] is not None and h[2] is not None and c[2] is not None and c[2] >= 0 and None not in (c[3], c[4]) and c[3] != c[4]
        sibling = known and (len(others) > 1 or h[5] is not None and bool(others - {h[5]}))
        mates = [y for y in hits if (y[1], y[2]) == (h[1], h[2])]
        best = max((y[6] for y in mates if y[6] is not None), default=None)
        e = lambda y, best=best: None if y[6] is None else 2.0 ** (y[6] - best)
        total = sum(e(y) for y in mates if e(y) is not None)
        weight = None
        if e(h) is not None and (c[2] is None or c[2] < 0):
            weight = e(h) / total
        elif e(h) is not None:
            now = sum(e(y) * 2.0 ** -x[5] for x, y in here if e(y) is not None)
            weight = e(h) * 2.0 ** -c[5] / (max(total - sum(e(y) for _, y in here if e(y) is not None), 0.0) + now)
        out.append((*c[:5], h[3], h[5], weight, sibling))
    return out


def test_weights_and_siblings_of_odd_rows(spark):
    hits, columns = odd()
    found = pileup.column_weights(spark.createDataFrame(columns, COLUMNS), pileup.posteriors(spark.createDataFrame(hits, HITS)))
    assert sorted(found.columns) == sorted("hit col qpos residue ref term read mate seq role unit e total kept posterior weight sibling".split())
    got = [tuple(r) for r in found.select("hit", "col", "qpos", "residue", "ref", "seq", "unit", "weight", "sibling").collect()]
    want = plain(hits, columns)
    key = lambda r: repr((*r[:7], r[8], None if r[7] is None else round(r[7], 9)))
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert [(*g[:7], g[8]) for g in got] == [(*w[:7], w[8]) for w in want]
    assert all((g[7] is None) == (w[7] is None) and (g[7] is None or math.isclose(g[7], w[7], rel_tol=1e-9)) for g, w in zip(got, want, strict=True))
    assert {r[8] for r in got} == {True, False}


def test_columns_meet_their_hits_once(spark):
    """Columns and hits are read, joined and dealt out by their place once, for the weights and for what other units have there."""
    hits, columns = odd()
    found = pileup.column_weights(spark.createDataFrame(columns, COLUMNS), spark.createDataFrame([(*h, 1.0, 1.0, 1.0, True) for h in hits], f"{HITS}, e double, total double, posterior double, kept boolean"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") == 2 and plan.count("Join ") == 1 and plan.count("Exchange hashpartitioning(") == 3 and plan.count("Sort [read#") == 1


def test_hits_are_not_stored_for_one_reader(spark, monkeypatch):
    """Only the weighted columns are stored, whole; the hits go straight to their columns, and are stored where a second step reads them."""
    from strandlake.plans import analytics

    made, cut = [], analytics.cut
    monkeypatch.setattr(analytics, "cut", lambda df: made.append(set(df.columns)) or cut(df))
    analytics.leave_one_column_out(spark, "/root/testdata/sf0.001")
    assert len(made) == 1 and {"weight", "sibling", "posterior", "kept"} <= made[0]
    made.clear()
    analytics.unit_results(spark, "/root/testdata/sf0.001")
    assert len(made) == 2 and "weight" not in made[0]
