"""Operators against plain algorithms on small inputs."""

import random

import numpy as np
import pandas as pd
import pytest

from strandlake.operators import assign, estimators, evaluate, graph, identity, mask, pileup, reference_set, tree
from strandlake.operators.index_build import IndexParams, build_index


def test_dense_ids(spark):
    rows = [(f"k{i:03d}",) for i in random.Random(1).sample(range(200), 150)]
    got = sorted((r.k, r.n) for r in graph.dense_ids(spark.createDataFrame(rows, "k string").repartition(7), ["k"], "n").collect())
    assert got == [(k, i) for i, (k,) in enumerate(sorted(rows))]


def test_spanning_forests_agree(spark):
    rng = random.Random(2)
    edges = list({(min(a, b), max(a, b)): (min(a, b), max(a, b), rng.randint(1, 9)) for a, b in ((rng.randrange(40), rng.randrange(40)) for _ in range(150)) if a != b}.values())
    want = graph.spanning_forest(edges, 40)
    got = graph.boruvka(spark.createDataFrame(edges, "a long, b long, weight long")).collect()
    assert sum(r.weight for r in got) == sum(w for *_, w in want) and len(got) == len(want)
    assert {(r.a, r.b) for r in got} == {(a, b) for a, b, _ in want}


def test_cuthill_mckee():
    order = graph.cuthill_mckee(6, np.array([[0, 3], [3, 5], [1, 2]]))
    place = np.argsort(order)
    assert sorted(order) == list(range(6)) and abs(place[0] - place[3]) == 1 and abs(place[1] - place[2]) == 1


def kmers_frame(rng, units=6, hashes=40):
    rows = [(u, h) for u in range(units) for h in rng.sample(range(hashes), 15)]
    hits = {h: rng.randint(1, 9) for h in range(hashes)}
    holders = {h: sum(x == h for _, x in rows) for h in range(hashes)}
    return pd.DataFrame([(0, u, h, hits[h], holders[h], 20, 0.1 + 0.1 * (u % 3)) for u, h in rows], columns=["component", "unit", "hash", "hits", "holders", "m_g", "t_g"])


def test_cover_is_greedy():
    g = kmers_frame(random.Random(3))
    left = {u: set(x["hash"]) for u, x in g.groupby("unit")}
    rate = g.groupby("unit")["t_g"].first()
    want, taken = [], set()
    while any(left[u] - taken for u in left):
        u = min(left, key=lambda u: (-len(left[u] - taken) / rate[u], u))
        want.append((u, len(left[u] - taken)))
        taken |= left[u]
    got = assign.cover(g)
    units = got[got["owned"]].groupby("unit").agg(n=("unique_kmers", "first"), s=("score", "first")).reset_index().sort_values(["s", "unit"], ascending=[False, True])
    assert sorted(zip(units["unit"], units["n"])) == sorted(want)


def test_poisson_fits_agree(spark):
    g = kmers_frame(random.Random(4))
    h = estimators.Hits(g)
    lam, _ = estimators.fit_poisson(h)
    x = h.unit_sum(h.hits[h.r]) / h.m
    for _ in range(20_000):
        x = x * h.unit_sum((h.hits / h.kmer_sum(x[h.c]))[h.r]) / h.m
    assert np.allclose(lam, x, rtol=1e-3, atol=1e-4)
    got = estimators.poisson_em_distributed(spark.createDataFrame(g), rounds=40).toPandas().sort_values("unit")["coverage"].to_numpy()
    y = h.unit_sum(h.hits[h.r]) / h.m
    for _ in range(40):
        y = y * h.unit_sum((h.hits / h.kmer_sum(y[h.c]))[h.r]) / h.m
    assert np.allclose(got, y, rtol=1e-6)


def test_zero_inflated_fit_finds_what_was_put_in():
    rng = np.random.default_rng(5)
    rows = []
    for u, (rate, share) in enumerate([(4.0, 0.5), (2.0, 0.9)]):
        there = rng.random(2000) < share
        n = rng.poisson(rate, 2000) * there
        rows += [(u, u * 10_000 + i, c, 2000) for i, c in enumerate(n) if c]
    h = estimators.Hits(pd.DataFrame(rows, columns=["unit", "hash", "hits", "m_g"]))
    lam, p, _ = estimators.fit_zero_inflated(h)
    assert np.allclose(lam, [4, 2], rtol=0.08) and np.allclose(p, [0.5, 0.9], rtol=0.08)


def test_intervals_hold_the_rate():
    low, high = estimators.coverage_bounds(np.array([3.0, 0.2]), np.array([100.0, 50.0]), np.array([1.0, 1.0]))
    assert low[0] < 3 < high[0] and low[1] < 0.2 < high[1]


def test_presence(spark):
    own = [(u, 1) for u in range(30) for _ in range(10 + u % 3)] + [(100 + u, 50) for u in range(3)]
    units = spark.createDataFrame([(u, 0.1) for u in [*range(30), 100, 101, 102]], "unit long, t_g double")
    got = {r.unit: r.present_prob for r in estimators.presence(spark.createDataFrame(own, "unit long, holders long"), units, 1000, 10_000).collect()}
    assert all(got[u] > 0.9 for u in range(30)) and all(got[100 + u] == 0 for u in range(3))


def test_survival_model():
    m = identity.SurvivalModel(5)
    a = np.array([0.6, 0.9, 1.0])
    assert np.allclose(m.survival(a), a**5, atol=2e-3) and np.allclose(m.identity(a**5), a, atol=2e-3)
    g = identity.SurvivalModel(5, shape=0.8, region=10.0)
    assert (g.survival(a[:2]) > a[:2] ** 5).all()
    b = identity.SurvivalModel(3, concentration=4.0, region=5.0)
    assert 0.7**3 < b.survival(0.7) < 0.7
    with pytest.raises(ValueError):
        identity.SurvivalModel(5, shape=-1.0)
    h = np.array([60.0])
    point, low, high = identity.identity_quantiles(h, np.array([100.0]), np.array([1.0]), np.array([1.0]), np.array([100.0]), m)
    assert low[0] < point[0] < high[0] and abs(point[0] - 0.6**0.2) < 0.02


def test_count_cdf():
    assert identity.count_cdf(3, 2.0, 2.0) == pytest.approx(0.857123, abs=1e-5)
    assert identity.count_cdf(3, 2.0, 1.6) == pytest.approx(sum([0.8**10, 10 * 0.2 * 0.8**9, 45 * 0.04 * 0.8**8, 120 * 0.008 * 0.8**7]), abs=1e-6)


def test_parsimony_inverts():
    rng = random.Random(6)
    for _ in range(100):
        n = rng.randint(1, 9)
        nodes = {}

        def split(lo, hi):
            if hi - lo > 1:
                m = rng.randint(lo + 1, hi - 1)
                nodes[lo, hi] = [(lo, m), (m, hi)]
                split(lo, m)
                split(m, hi)

        split(0, n)
        present = {i for i in range(n) if rng.random() < 0.5}
        rows = tree.parsimony(nodes, (0, n), present)
        assert {i for i in range(n) if sum(s for a, b, s in rows if a <= i < b)} == present
        assert len(rows) <= max(len(present), 1)


def test_minimizers_cover_every_window(spark):
    from strandlake.functions.kmers import KmerParams, kmer_hashes

    rng = random.Random(7)
    seqs = ["".join(rng.choices("ACDEFGHIKL", k=n)) for n in (3, 8, 40, 90)]
    df = spark.createDataFrame(list(enumerate(seqs)), "id long, sequence string")
    got = {}
    for r in tree.window_minimizers(df, KmerParams(4), 6, ["id"]).collect():
        got.setdefault(r.id, set()).add(r.hash)
    for i, s in enumerate(seqs):
        h = kmer_hashes([s.encode()], KmerParams(4))[2].view(np.int64).tolist()
        for a in range(max(1, len(h) - 5)) if h else ():
            assert set(h[a : a + 6]) & got[i]


def test_chunks_and_votes(spark):
    sizes = spark.createDataFrame([(0, 5), (1, 6), (2, 20), (3, 1)], "pos long, size long")
    assert [r.chunk for r in tree.packed_chunks(sizes, 10).orderBy("pos").collect()] == [0, 1, 2, 3]
    reads = spark.createDataFrame([(1, i, h) for i, h in enumerate([5, 6, 7])], "read long, pos int, hash long")
    leaves = spark.createDataFrame([(9, 10 + i, h) for i, h in enumerate([5, 6, 7])] + [(8, 3, 5)], "leaf long, pos int, hash long")
    assert [(r.leaf, r.votes) for r in tree.route_votes(reads, leaves, top=1).collect()] == [(9, 3)]


def test_votes_equal_a_plain_loop_and_shuffle_no_hits(spark):
    """Any number of groups, and chunks that part a read, give the same; the plan deals k-mers and never joins them."""
    from collections import Counter, defaultdict

    import pyarrow as pa

    rng = random.Random(3)
    reads = sorted({(r, i, rng.randrange(6)) for r in range(12) for i in range(rng.randrange(60))} | {(1, 5, 0), (1, 5, 1)})
    leaves = [(f"l{u}", i, rng.randrange(8)) for u in range(9) for i in range(40)]
    votes = defaultdict(Counter)
    for r, leaf, b, _ in {(r, leaf, (q - p) // 16, p) for r, p, h in reads for leaf, q, g in leaves if g == h}:
        votes[r, leaf][b] += 1
    best = {k: max(v[b] + v[b + 1] for x in v for b in (x, x - 1)) for k, v in votes.items()}
    want = {(r, leaf, n) for (r, leaf), n in best.items() if sum(m > n for (q, _), m in best.items() if q == r) < 3}
    a, b = spark.createDataFrame(reads, "read long, pos int, hash long"), spark.createDataFrame(leaves, "leaf string, pos int, hash long")
    for sizes in ((200_000, 1_000_000), (50, 90)):
        out = tree.route_votes(a, b, top=3, read_rows=sizes[0], leaf_rows=sizes[1])
        assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
        assert sorted(map(tuple, out.collect())) == sorted(want)
    small = tree._band_votes(pa.Table.from_pylist([dict(zip(("read", "pos", "hash"), x)) for x in reads]), pa.Table.from_pylist([dict(zip(("leaf", "pos", "hash"), x)) for x in leaves]), 16, 3, most=100)
    assert {tuple(x.values()) for x in small.to_pylist()} == want
    for far in (5, 1 << 50):  # keys that fit one number, and that don't
        rows = np.array([[far, 0, far, 0], [1 << 40, 7, 1 << 40, 6], [1, 2, 3, 4]])
        assert tree._summed(rows).tolist() == [[0, 0, far], [6, 7, 1 << 40], [4, 2, 4]]


def test_decoy_bar(spark):
    seeds = spark.createDataFrame([(float(s),) for s in [1, 2, 5, 6, 7]], "score double")
    decoys = spark.createDataFrame([(float(s),) for s in [1, 2, 2.5]], "score double")
    assert tree.decoy_bar(seeds, decoys, 0.1) == 2.75


def test_gather_reads(spark):
    rows = [(0, 1, r, 2.0) for r in (1, 2, 3)] + [(0, 2, r, 2.5) for r in (3, 4)] + [(0, 3, 3, 9.0)]
    got = tree.gather_reads(spark.createDataFrame(rows, "component long, pos long, read long, score double"), 1.0).orderBy("rank").collect()
    assert [(r.pos, r.score) for r in got] == [(3, 9.0), (1, 4.0), (2, 2.5)]


def test_haplotypes(spark):
    rng = random.Random(8)
    rows = [("s", p, c, ("A" if p % 3 else "T") if rng.random() > 0.01 else "G", "A") for p in range(60) for c in range(12)]
    got = pileup.haplotypes(spark.createDataFrame(rows, "seq string, pair long, col int, residue string, base string")).orderBy("haplotype").collect()
    assert [r.residues for r in got] == ["A" * 12, "T" * 12] and got[1].share == pytest.approx(1 / 3, abs=0.05)


def test_refinement_follows_the_majority(spark):
    cols = [(h, "s", c, "T" if c == 3 else "A", "A") for h in range(8) for c in range(10)]
    hits = [(h, 0, h, 1, 10) for h in range(8)]
    fitted, now = pileup.refined(spark.createDataFrame(cols, "hit long, seq string, col int, residue string, ref string"), spark.createDataFrame(hits, "hit long, component long, pair long, source long, length long"), rounds=2)
    assert {r["col"]: r.residue for r in now.collect()}[3] == "T" and fitted.count() == 8


def test_codons(spark):
    cols = spark.createDataFrame([(1, "s", 0, 0, False, 1.0), (2, "s", 0, 3, True, 2.0)], "hit long, seq string, col int, codon_start int, reverse boolean, weight double")
    reads = spark.createDataFrame([(1, "ACGTTT"), (2, "ACGTTT")], "hit long, seq_read string")
    got = {(r.base, r.letter): r.weight for r in pileup.codon_pileup(cols, reads).collect()}
    assert got == {(0, "A"): 3.0, (1, "C"): 1.0, (1, "A"): 2.0, (2, "G"): 1.0, (2, "A"): 2.0}


def test_mask_takes_host_kmers_out(spark):
    from strandlake.functions.sequences import CODES

    letters = "TCAG"
    codon = {}
    for i, aa in enumerate(CODES[11]):
        codon.setdefault(aa, letters[i // 16] + letters[i // 4 % 4] + letters[i % 4])
    host, other = "MKLVACDEFGHIKLMN", "PQRSTVWYPQRSAVWY"
    t = spark.createDataFrame([("h", 1, True, host), ("o", 2, True, other)], "unit_key string, member_id long, full_length boolean, sequence string")
    i = build_index(t, IndexParams(k=4, t_base=1.0, mask_adapters=False))
    genome = spark.createDataFrame([("g", "".join(codon[a] for a in host))], "name string, seq string")
    m = mask.apply_mask(i, mask.masked_hashes(genome, i))
    got = {r.unit_key: r for r in m.units.collect()}
    assert got["h"].host_like and got["h"].m_g == 0 and got["h"].pin_sum == pytest.approx(0)
    assert got["o"].masked_fraction == 0 and m.postings.count() == got["o"].m_g


def test_routing(spark):
    from strandlake.functions.kmers import KmerParams

    reads = spark.createDataFrame([(1, "ATGAAACTGGTTGCGTGCGATGAATTT")], "read long, seq string")
    refs = spark.createDataFrame([(0, "MKLVACDEF"), (1, "WWWWWWWW")], "block long, sequence string")
    found, total = reference_set.route_reads(reads, refs, KmerParams(4), 3)
    assert [(r.read, r.block, r.shared) for r in found.collect()] == [(1, 0, 6)]
    assert reference_set.totals_histogram(total).count() == 1


def test_evaluation(spark):
    df = spark.createDataFrame([(float(i), float(i) / 2 + 0.1 * (i % 2), 1.0) for i in range(100)], "e double, t double, w double")
    knots = evaluate.calibration_knots(df, "e", "t", 10.0, 5)
    assert len(knots) == 10 and knots == sorted(knots) and abs(knots[5][1] - knots[5][0] / 2) < 0.2
    subsets = evaluate.nested_subsets(df, "e", [3, 10]).groupBy("subset").count().orderBy("subset").collect()
    assert [tuple(r) for r in subsets] == [(3, 3), (10, 7)]
    assert evaluate.parameter_product({"a": [1, 2], "b": ["x", "y", "z"]}, spark).count() == 6


def test_runs_and_correlations_are_those_of_the_chain():
    """Against the chain stepped site by site with its classes."""
    m = identity.SurvivalModel(4, shape=0.7, region=6.0, categories=5)
    row = 600
    e, stay = m.unchanged[row], m.stay
    step = stay * np.eye(5) + (1 - stay) / 5

    def chance(sites):
        """That the sites at which ``sites`` is 1 are unchanged."""
        x = np.full(5, 0.2)
        for i, s in enumerate(sites):
            x = (x @ step if i else x) * (e if s else 1)
        return x.sum()

    s = chance([1] * 4)
    assert m.survivals[row] == pytest.approx(s, rel=1e-12)
    for lag in (1, 3, 4, 5, 9, 40):
        sites = [int(i < 4 or lag <= i < lag + 4) for i in range(lag + 4)]
        assert m._correlations[row, lag - 1] == pytest.approx((chance(sites) - s * s) / (s * (1 - s)), rel=1e-9)
    n = 7
    want = 1 + 2 * 0.3 * sum((1 - j / n) * m._correlations[row, j - 1] for j in range(1, n))
    assert m.inflation(row, 0.3, n) == pytest.approx(want, rel=1e-12)


def test_truncated_counts():
    for v in (0.0, 0.2):
        d = estimators.Truncated(v, 400)
        h = np.arange(1, 400)
        # The term in h alone that ``logpmf`` leaves out.
        logs = d.logpmf(h, np.array(2.5)) - np.cumsum(np.log(h))
        assert np.exp(logs).sum() == pytest.approx(1, abs=1e-9)
        assert d.rate((np.exp(logs) * h).sum()) == pytest.approx(2.5, rel=1e-6)


def test_mixture_and_dispersion_find_what_was_put_in(spark):
    rng = np.random.default_rng(7)
    hits = {1: rng.poisson(4, 3000), 2: np.r_[rng.poisson(3, 3000), rng.poisson(20, 1500)], 3: rng.negative_binomial(4, 0.5, 3000)}
    rows = [(u, u * 100_000 + i, float(c)) for u, h in hits.items() for i, c in enumerate(h) if c] + [(u, 9, 5.0) for u in hits]
    k = spark.createDataFrame(rows, "unit long, hash long, hits double")
    cov = spark.createDataFrame([(1, 4.0), (2, 8.0), (3, 4.0), (4, 1.0)], "unit long, coverage double")
    got = {r.unit: r for r in estimators.rate_mixture(k, cov).collect()}
    assert got[1].mix_rates == 1 and got[1].coverage_mix == pytest.approx(4, rel=0.02) and got[4].mix_rates == 1
    assert got[2].mix_rates >= 2 and got[2].coverage_mix / 8 == pytest.approx(20 / np.r_[hits[2][hits[2] > 0]].mean(), rel=0.15)
    d = {r.unit: r.dispersion for r in estimators.dispersion(k, cov).collect()}
    assert d[1] == pytest.approx(1, abs=0.1) and d[3] > 1.5 and d[4] == 1


def test_posterior_holds_what_was_put_in(spark):
    rng = np.random.default_rng(8)
    rate, share, m = {1: 5.0, 2: 2.0}, {1: 0.8, 2: 0.6}, 400
    kmers, reads, n = [], [], 0
    for u in rate:
        for i in range(m):
            h = 1000 * u + i
            if rng.random() < share[u] and (c := rng.poisson(rate[u])):
                kmers.append((0, u, h, float(m), float(m), 1.0))
                for _ in range(c):
                    reads.append((0, h, n, 1))
                    n += 1
    # A third unit with nothing of its own shares the k-mers of the first.
    kmers += [(0, 3, h, 400.0, 400.0, 1.0) for _, u, h, *_ in list(kmers) if u == 1 and h % 2]
    k = spark.createDataFrame(kmers, "component long, unit long, hash long, m_g double, pin_sum double, present_prob double")
    r = spark.createDataFrame(reads, "component long, hash long, read long, n long")
    got = {x.unit: x for x in estimators.posterior(k, r, draws=30, sweeps=6).collect()}
    # Resampled reads scatter more than a Poisson, which the fit takes for fewer k-mers at a higher coverage; their product holds.
    assert 1.8 < got[2].coverage_lo < got[2].coverage_hi < 3.3
    assert got[2].abundance_lo < 2.0 * 0.6 < got[2].abundance_hi
    assert got[2].own_evidence == 1 and got[3].own_evidence == 0 and got[1].ambiguity_group == got[3].ambiguity_group == 1
    again = {x.unit: x for x in estimators.posterior(k.repartition(3), r.repartition(2), draws=30, sweeps=6).collect()}
    assert got == again
