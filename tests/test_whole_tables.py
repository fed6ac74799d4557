"""Queries without SQL work on whole texts and tables: against plain loops on small fixtures."""

import math
import random

import pytest

from strandlake.operators import align, tree
from strandlake.plans.registry import QUERIES


@pytest.fixture
def passages(spark, tmp_path):
    rng = random.Random(5)
    text = lambda n: "".join(rng.choices("ACDEFGHIKLMNPQRSTVWY é", k=n))
    shared = text(60)
    texts = {1: text(150) + shared, 2: text(140) + shared + text(20), 3: text(30), 5: "é" + text(200)}
    spark.createDataFrame(list(texts.items()), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), {i: t.upper() for i, t in texts.items()}


def brute_ungapped(a, b, m):
    """The best sum of scores along a diagonal, by a plain loop."""
    x, y = (t.encode("ascii", "replace") for t in (a, b))
    best = 0
    for d in range(-len(x), len(y)):
        run = 0
        for i in range(max(0, -d), min(len(x), len(y) - d)):
            run = max(run + int(m[x[i], y[i + d]]), 0)
            best = max(best, run)
    return best


def test_ungapped_scores_of_whole_texts(spark, passages):
    path, texts = passages
    m = align.class_matrix()
    got = {(r.item_id, r.other): r.score for r in QUERIES["ungapped_scores"](spark, path).collect()}
    assert got == {(i, j): brute_ungapped(texts[i], texts[j], m) for i in texts for j in (i, i + 1) if j in texts}


def test_seed_alignments_of_whole_texts(spark, passages):
    path, texts = passages
    got = {(r.item_id, r.other): r for r in QUERIES["seed_alignments"](spark, path).collect()}
    for i, t in texts.items():
        assert (got[i, i].qstart, got[i, i].qend, got[i, i].btop) == (0, len(t), str(len(t)))
    assert got[1, 2].qstart <= 150 and got[1, 2].qend == 210 and got[1, 2].sstart <= 140 and got[1, 2].send >= 200


@pytest.fixture
def sales(spark, tmp_path):
    """Make a lineitem table whose sales all have one quantity."""
    rng = random.Random(6)
    rows = [(o, rng.randint(1, 12), rng.randint(1, 6), n, rng.choice("ANR")) for o in range(1, 30) for n in range(1, 8)]

    def make(quantity):
        path = f"{tmp_path}/{quantity}"
        df = spark.createDataFrame([(*r, float(quantity)) for r in rows], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_returnflag string, l_quantity double")
        df.write.parquet(f"{path}/lineitem.parquet")
        return path

    return rows, make


def brute_forest_weight(rows):
    """Total weight of a minimum spanning forest over suppliers that share parts, by Kruskal's algorithm."""
    held = {}
    for _, part, supplier, *_ in rows:
        held.setdefault(supplier, set()).add(part)
    group = {s: s for s in held}
    total = 0
    for w, a, b in sorted((len(held[a] ^ held[b]), a, b) for a in held for b in held if a < b and held[a] & held[b]):
        if group[a] != group[b]:
            total += w
            group = {s: group[a] if g == group[b] else g for s, g in group.items()}
    return total


def test_supplies_are_of_all_sales(spark, sales):
    rows, make = sales
    small, large = make(3), make(50)
    assert sum(r.weight for r in QUERIES["minimum_spanning_forest"](spark, small).collect()) == brute_forest_weight(rows)
    for name in ("minimum_spanning_forest", "signature_groups", "link_cuts"):
        got, want = (sorted(map(repr, QUERIES[name](spark, p).collect())) for p in (small, large))
        assert got == want and (got or name == "signature_groups")


def test_haplotypes_have_all_lines(spark, sales):
    _, make = sales
    got = QUERIES["haplotypes"](spark, make(3)).collect()
    assert {len(r.residues) for r in got} == {7}


def test_source_em_runs_to_its_fixed_point(spark, tmp_path):
    import math
    from collections import defaultdict

    rng = random.Random(7)
    rows = [(o, s, rng.randint(0, 3) / 100) for o in range(60) for s in rng.sample(range(1, 5), rng.randint(1, 3))]
    spark.createDataFrame(rows, "l_orderkey long, l_suppkey long, l_discount double").write.parquet(f"{tmp_path}/lineitem.parquet")
    hits = {(o, s): round(d * 100) for o, s, d in rows}
    hits |= {(o, -1): max(x for (p, _), x in hits.items() if p == o) for o in range(60)}
    a = {s: 1 / 5 for s in (-1, 1, 2, 3, 4)}
    div, w = {s: 0.05 for s in a} | {-1: 0.2}, {}
    for _ in range(500):
        logs = {(o, s): x * math.log(div[s]) + (100 - x) * math.log1p(-div[s]) + math.log(max(a[s], 1e-300)) for (o, s), x in hits.items()}
        sums = defaultdict(float)
        for (o, _), v in logs.items():
            sums[o] += math.exp(v)
        new = {k: math.exp(v) / sums[k[0]] for k, v in logs.items()}
        a = {s: sum(v for (_, t), v in new.items() if t == s) / 60 for s in a}
        div |= {s: min(max((sum(v * hits[k] for k, v in new.items() if k[1] == s) + 0.5) / (sum(v * 100 for k, v in new.items() if k[1] == s) + 10), 1e-4), 0.5) for s in a if s != -1}
        done = max(abs(new[k] - w.get(k, 0)) for k in new) <= 1e-7
        w = new
        if done:
            break
    got = {r.pair: r.weight for r in QUERIES["source_em"](spark, str(tmp_path)).collect()}
    assert got == {o: pytest.approx(max(v for (p, _), v in w.items() if p == o), abs=1e-9) for o in range(60)}


@pytest.mark.parametrize(("novel", "prior"), [(0.2, True), (None, False)])
def test_source_em_in_rounds_is_the_fit_of_one_task(spark, novel, prior):
    """Components over ``most_rows`` never meet in one task, each stops by itself, and a small one beside them is as before."""
    from strandlake.operators import pileup

    rng = random.Random(11)
    rows = [(c, 1000 * c + p, s, 100, rng.randint(0, 9)) for c, pairs in ((0, 60), (1, 25), (2, 3)) for p in range(pairs) for s in rng.sample(range(1, 7), rng.randint(1, 4))]
    df = spark.createDataFrame(rows, "component long, pair long, source long, length long, mismatches long")
    want = {(r.pair, r.source): r.weight for r in pileup.source_em(df, prior=prior, novel=novel).collect()}
    got = {(r.pair, r.source): r.weight for r in pileup.source_em(df, prior=prior, novel=novel, most_rows=20).collect()}
    assert got.keys() == want.keys() and got == {k: pytest.approx(v, abs=1e-9) for k, v in want.items()}


def test_prefix_join_weighs_only_pairs_that_can_be_similar(spark, monkeypatch):
    """Sets that share one of twenty hashes don't meet as whole sets; what is similar is found as by a plain loop."""
    from strandlake.operators import tree

    rng = random.Random(3)
    sets = {i: set(rng.sample(range(300), 20)) for i in range(60)}
    sets |= {100 + i: set(list(sets[i])[: 20 - i]) | {1000 + i} for i in range(12)}
    held = spark.createDataFrame([(i, h) for i, s in sets.items() for h in s], "set_id long, hash long")
    for least in (0.05, 0.3, 0.6, 1.0):
        seen, weigh = [], tree.pair_weights
        monkeypatch.setattr(tree, "pair_weights", lambda pairs, one, seen=seen, weigh=weigh: seen.append(pairs.count()) or weigh(pairs, one))
        got = {(r.a, r.b): r.shared for r in tree.prefix_join(held, least).collect()}
        monkeypatch.setattr(tree, "pair_weights", weigh)
        shared = {(a, b): len(sets[a] & sets[b]) for a in sets for b in sets if a < b}
        assert got == {(a, b): n for (a, b), n in shared.items() if n and n / len(sets[a] | sets[b]) >= least}
        if least == 0.3:
            assert seen[0] < sum(n > 0 for n in shared.values()) / 4


def test_keys_of_all_picks_are_counted_once(spark, monkeypatch):
    from strandlake.operators import layers

    rng = random.Random(5)
    groups = spark.createDataFrame([(i, f"g{i % 3}") for i in range(24)], "id long, group string")
    held = spark.createDataFrame([(i, h) for i in range(24) for h in rng.sample(range(30), rng.randint(3, 15))], "id long, hash long")
    want = {(r.group, p, r.rep, r.hash) for p in ("medoid", "central", "longest") for r in layers.keys_on_representatives(held, groups, p).collect()}
    want |= {(r.group, "composite", r.rep, r.hash) for r in layers.keys_on_representatives(held, groups, "medoid", 0.5).collect()}
    counts, count = [], layers._counted
    monkeypatch.setattr(layers, "_counted", lambda *a: counts.append(1) or count(*a))
    got = [tuple(r) for r in layers.keys_by_picks(held, groups, ["medoid", "central", "longest"], 0.5).select("group", "pick", "rep", "hash").collect()]
    assert set(got) == want and len(got) == len(want) and len(counts) == 1


def test_fits_take_the_defaults_of_their_operators(spark, monkeypatch):
    """Rounds, draws and sweeps are not cut below what the operators do by themselves."""
    from strandlake.operators import estimators

    for query, name in (("posterior_intervals", "posterior"), ("em_poisson_distributed", "poisson_em_distributed")):
        seen = {}

        def spy(*args, seen=seen, **kwargs):
            seen.update(kwargs)
            raise InterruptedError

        with monkeypatch.context() as m:
            m.setattr(estimators, name, spy)
            with pytest.raises(InterruptedError):
                QUERIES[query](spark, "/root/testdata/sf0.001")
        assert seen == {}


def test_distributed_fit_tells_that_it_has_not_settled(spark):
    from strandlake.operators import estimators

    k = spark.createDataFrame([(u, h, float(h**3), 10.0) for u in (1, 2, 3) for h in range(u, u + 6)], "unit long, hash long, hits double, m_g double")
    with pytest.warns(RuntimeWarning, match="still moved"):
        estimators.poisson_em_distributed(k, rounds=5, tol=1e-12)


@pytest.mark.parametrize("name", ["overlap_identities", "base_statistics"])
def test_passages_that_only_look_plain(spark, tmp_path, name):
    """Letters that upper case makes plain, a line's end of another kind, and an empty passage: as the SQL has them."""
    import duckdb

    from strandlake.plans.registry import SQL

    texts = ["plain\n", "straße", "ſo", "ends\r", "ends ", "", "abc" * 50 + "ß"]
    spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{tmp_path}/benchmark.parquet/*.parquet'")
    got, want = QUERIES[name](spark, str(tmp_path)).toPandas(), con.execute(SQL[name]).df()
    assert sorted(map(tuple, got.to_numpy().tolist())) == sorted(map(tuple, want[got.columns].to_numpy().tolist()))


@pytest.mark.parametrize(("read_rows", "width"), [(200_000, 4096), (30, 8)])
def test_evidence_is_swept_where_reads_meet_ranges(spark, monkeypatch, read_rows, width):
    """Each read's score on each leaf against a plain loop, in one block and in many; hits are neither stored nor shuffled."""
    rng = random.Random(3)
    postings, tops = [], {}
    for h in range(40):
        lo, hi = sorted(rng.sample(range(30), 2))
        postings.append((h, lo, hi, 1, bits := -math.log2((h % 9 + 1) / 40)))
        tops[h] = set(range(lo, hi))
        if hi - lo > 2:
            postings.append((h, lo + 1, hi - 1, -1, bits))
            tops[h] -= set(range(lo + 1, hi - 1))
    pairs = [(r, h) for r in range(25) for h in rng.sample(range(60), rng.randrange(12))] * 2
    want = {}
    for r in range(25):
        own = {h for q, h in pairs if q == r and h < 40}
        for x in range(30):
            on = [-math.log2((h % 9 + 1) / 40) for h in own if x in tops[h]]
            if on and (score := sum(on) - (len(on) - 1) * 2.5) >= 0.5:
                want[r, x] = round(score, 9)
    stored = []
    real = tree.cut
    monkeypatch.setattr(tree, "cut", lambda df: stored.append(real(df)) or stored[-1])
    got = tree.evidence(spark.createDataFrame(pairs, "read long, hash long"), spark.createDataFrame(postings, "hash long, lo long, hi long, sign int, bits double"), 2.5, 0.5, read_rows, width).collect()
    assert {(g.read, x): round(g.score, 9) for g in got for x in range(g.lo, g.hi)} == want and len(want) > 50
    assert sum(g.hi - g.lo for g in got) == len(want) and len(stored) == 3 and stored[0].count() == len(pairs)
    none = spark.createDataFrame([], "read long, hash long")
    assert tree.evidence(none, spark.createDataFrame(postings, "hash long, lo long, hi long, sign int, bits double"), 2.5).count() == 0
