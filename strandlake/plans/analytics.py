"""Components, covers, estimators, identity, pileups, cross references, trees and evaluation on the driver tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kmers import KmerParams, target_kmers
from ..lineage import cut
from ..operators import align, assign, estimators, evaluate, families, graph, identity, overlaps, pileup, reference_set, sketch, tree, xref
from .sequences import hits, named
from .tables import Registry, table

R = Registry()


# Graphs.

_ENDS = "SELECT doc_id, substr(text, 1, 30) AS head, right(text, 30) AS tail FROM documents"


@R.add(f"""WITH RECURSIVE d AS ({_ENDS}), e AS (SELECT a.doc_id AS a, b.doc_id AS b FROM d a JOIN d b ON a.doc_id <> b.doc_id AND (a.head = b.head OR a.tail = b.tail)),
r AS (SELECT doc_id AS node, doc_id AS other FROM d UNION SELECT r.node, e.b FROM r JOIN e ON r.other = e.a)
SELECT node, min(other) AS component FROM r GROUP BY node""")
def components(spark, d):
    """Documents joined by the same first or last 30 characters."""
    t = table(spark, d, "documents").select("doc_id", F.substring("text", 1, 30).alias("head"), F.expr("right(text, 30)").alias("tail"))
    edges = graph.chain_edges(t.select("doc_id", "head"), "doc_id", "head").unionByName(graph.chain_edges(t.select("doc_id", "tail"), "doc_id", "tail"))
    return graph.connected(t.select("doc_id"), edges)


def _sold(spark, d) -> DataFrame:
    """Each sale's supplier and part."""
    return table(spark, d, "lineitem").select(F.col("l_partkey").alias("hash"), F.col("l_suppkey").alias("set_id"))


def _supply(spark, d) -> DataFrame:
    """Suppliers as the sets of the parts that they sold."""
    return _sold(spark, d).distinct()


def _supply_much(spark, d) -> DataFrame:
    """``_supply`` by large sales only, as the queries' SQL states it."""
    return table(spark, d, "lineitem").where("l_quantity >= 45").select(F.col("l_partkey").alias("hash"), F.col("l_suppkey").alias("set_id")).distinct()


_SUPPLY = "WITH held AS (SELECT DISTINCT l_partkey AS hash, l_suppkey AS set_id FROM lineitem WHERE l_quantity >= 45), size AS (SELECT set_id, count(*) AS n FROM held GROUP BY 1), pair AS (SELECT a.set_id AS a, b.set_id AS b, count(*)::BIGINT AS shared FROM held a JOIN held b ON a.hash = b.hash AND a.set_id < b.set_id GROUP BY 1, 2) "


@R.add(_SUPPLY + "SELECT a, b, shared, (x.n + y.n - 2 * shared)::BIGINT AS weight FROM pair JOIN size x ON x.set_id = a JOIN size y ON y.set_id = b")
def overlap_pairs(spark, d):
    return tree.overlap_pairs(_supply_much(spark, d))


@R.add(_SUPPLY + "SELECT a, b, shared, (x.n + y.n - 2 * shared)::BIGINT AS weight FROM pair JOIN size x ON x.set_id = a JOIN size y ON y.set_id = b WHERE shared >= 2 AND x.n + y.n - 2 * shared <= greatest(x.n, y.n)")
def overlap_pairs_storage(spark, d):
    return tree.overlap_pairs(_supply_much(spark, d), least=2, storage=True)


@R.add(_SUPPLY + "SELECT a, b, coalesce(shared, 0)::BIGINT AS shared, (x.n + y.n - 2 * coalesce(shared, 0))::BIGINT AS weight FROM (SELECT s_suppkey AS a, s_suppkey + 1 AS b FROM supplier) q LEFT JOIN pair USING (a, b) JOIN size x ON x.set_id = a JOIN size y ON y.set_id = b")
def pair_weights(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("a"), (F.col("s_suppkey") + 1).alias("b"))
    return tree.pair_weights(s, _supply_much(spark, d))


@R.add()
def minimum_spanning_forest(spark, d):
    """By distributed rounds; the tests hold it against Kruskal's algorithm."""
    return overlaps.overlap_forest(_sold(spark, d), lambda shared, x, y: x + y - 2 * shared)


@R.add("SELECT c_custkey AS set_id, min(c_custkey) OVER (PARTITION BY s) AS rep FROM (SELECT o_custkey AS c_custkey, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS s FROM orders GROUP BY 1)")
def equal_set_collapse(spark, d):
    """Customers with the same set of order priorities."""
    held = table(spark, d, "orders").select(F.col("o_custkey").alias("set_id"), F.xxhash64("o_orderpriority").alias("hash"))
    return tree.collapse_equal(held)


@R.add(_SUPPLY + "SELECT a, b, shared, round(shared / (x.n + y.n - shared)::DOUBLE, 8) AS jaccard FROM pair JOIN size x ON x.set_id = a JOIN size y ON y.set_id = b WHERE shared >= 0.05 * (x.n + y.n - shared)")
def prefix_filter_join(spark, d):
    return tree.prefix_join(_supply_much(spark, d), 0.05).select("a", "b", "shared", F.round("jaccard", 8).alias("jaccard"))


def _words(spark, d, n: int = 3) -> DataFrame:
    """Benchmark passages as sets of k-mers."""
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("set_id"), F.col("text").alias("sequence"))
    return target_kmers(b, KmerParams(n), ["set_id"]).distinct()


def _tree(spark, d):
    held = cut(_words(spark, d))
    edges = cut(tree.minimum_forest(tree.overlap_pairs(held)))
    labels = tree.overlap_components(held)
    return held, cut(tree.leaf_positions(tree.merge_trees(edges, labels)))


@R.add()
def leaf_layout(spark, d):
    return _tree(spark, d)[1].select("component", "set_id", "pos", F.size("path").alias("depth"))


@R.add()
def range_postings(spark, d):
    held, leaves = _tree(spark, d)
    return tree.range_postings(held, leaves)


@R.add("SELECT count(*)::BIGINT AS held, true AS same FROM (SELECT DISTINCT item_id, w FROM (SELECT item_id, upper(substr(text, i + 1, 3)) AS w FROM (SELECT *, unnest(range(0, greatest(length(text) - 2, 0))) AS i FROM benchmark)) WHERE regexp_full_match(w, '[ACDEFGHIKLMNPQRSTVWY]{3}'))")
def range_postings_inverse(spark, d):
    """The ranges give the sets back: as many memberships, all the same."""
    held, leaves = _tree(spark, d)
    back = tree.covers(tree.range_postings(held, leaves), leaves)
    both = held.select("set_id", "hash", F.lit(1).alias("a")).join(back.select("set_id", "hash", F.lit(1).alias("b")), ["set_id", "hash"], "full")
    return both.agg(F.count("a").alias("held"), F.min(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("same"))


@R.add("SELECT lo, hi, n, round(w, 4) AS w FROM (SELECT x AS lo, lead(x) OVER (ORDER BY x) AS hi, sum(dn) OVER (ORDER BY x)::BIGINT AS n, sum(dw) OVER (ORDER BY x) AS w FROM (SELECT x, sum(dn) AS dn, sum(dw) AS dw FROM (SELECT l_partkey AS x, 1 AS dn, l_tax AS dw FROM lineitem UNION ALL SELECT l_partkey + l_quantity::BIGINT, -1, -l_tax FROM lineitem) GROUP BY x)) WHERE hi IS NOT NULL AND n <> 0")
def interval_sweep(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_partkey").alias("lo"), (F.col("l_partkey") + F.col("l_quantity").cast("long")).alias("hi"), F.lit(1).cast("long").alias("n"), F.col("l_tax").alias("w"))
    return tree.sweep(li, [], ["n", "w"]).select("lo", "hi", "n", F.round("w", 4).alias("w"))


@R.add("WITH r AS (SELECT l_partkey AS lo, l_partkey + 3 * l_quantity::BIGINT AS hi FROM lineitem), q AS (SELECT p_partkey AS query, p_partkey AS qlo, p_partkey + p_size AS qhi FROM part) SELECT query, count(lo)::BIGINT AS total FROM q LEFT JOIN r ON lo <= qlo AND hi >= qhi GROUP BY query")
def contained_sums(spark, d):
    r = table(spark, d, "lineitem").select(F.col("l_partkey").alias("lo"), (F.col("l_partkey") + 3 * F.col("l_quantity").cast("long")).alias("hi"), F.lit(1).cast("long").alias("weight"))
    q = table(spark, d, "part").select(F.col("p_partkey").alias("query"), F.col("p_partkey").alias("qlo"), (F.col("p_partkey") + F.col("p_size")).alias("qhi"))
    return tree.contained_sums(q, r).select("query", F.col("total").cast("long").alias("total"))


@R.add()
def window_minimizers(spark, d):
    b = table(spark, d, "benchmark").select("item_id", F.col("text").alias("sequence"))
    return tree.window_minimizers(b, KmerParams(3), 8, ["item_id"])


@R.add("WITH w AS (SELECT DISTINCT item_id, upper(substr(text, i + 1, 3)) AS w FROM (SELECT *, unnest(range(0, greatest(length(text) - 2, 0))) AS i FROM benchmark)), k AS (SELECT w, count(*) AS n FROM w WHERE regexp_full_match(w, '[ACDEFGHIKLMNPQRSTVWY]{3}') GROUP BY w) SELECT n::BIGINT AS holders, round(-log2(n / 40.0), 6) AS bits, count(*)::BIGINT AS keys FROM k GROUP BY 1, 2")
def evidence_bits(spark, d):
    held = _words(spark, d)
    bits = tree.key_bits(held, 40).join(held.groupBy("hash").agg(F.count(F.lit(1)).alias("holders")), "hash")
    return bits.groupBy("holders", F.round("bits", 6).alias("bits")).agg(F.count(F.lit(1)).alias("keys"))


@R.add()
def tree_evidence(spark, d):
    """Each leaf's best evidence from the conversations' turns, and the bar that reversed turns set."""
    held, leaves = _tree(spark, d)
    postings = cut(tree.range_postings(held, leaves).join(tree.key_bits(held, 40), "hash"))
    turns = table(spark, d, "conversations").select(F.xxhash64("conv_id", "turn").alias("read"), F.col("text").alias("sequence"))
    runs = [tree.evidence(target_kmers(t, KmerParams(3), ["read"]), postings, 8.0) for t in (turns, turns.withColumn("sequence", F.reverse("sequence")))]
    seeds, decoys = (cut(tree.best_evidence(r)) for r in runs)
    bar = tree.decoy_bar(seeds, decoys, 0.5)
    return seeds.withColumn("bar", F.lit(bar).cast("double")).withColumn("seeded", F.coalesce(F.col("score") >= F.col("bar"), F.lit(False)))


@R.add("WITH t AS (SELECT l_orderkey AS read, l_suppkey AS leaf FROM lineitem GROUP BY 1, 2), r0 AS (SELECT read, leaf, 1.0::DOUBLE / count(*) OVER (PARTITION BY read) AS share FROM t), th AS (SELECT leaf, sum(share) AS theta FROM r0 GROUP BY leaf) SELECT read, leaf, round(theta / sum(theta) OVER (PARTITION BY read), 8) AS share FROM r0 JOIN th USING (leaf)")
def tied_reads_em(spark, d):
    """One round, which SQL can follow; the fixed number of rounds is a parameter."""
    ties = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("read"), F.col("l_suppkey").alias("leaf"))
    return tree.tied_em(ties, 1).select("read", "leaf", F.round("share", 8).alias("share"))


@R.add()
def route_votes(spark, d):
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("leaf"), F.col("text").alias("sequence"))
    docs = table(spark, d, "conversations").select(F.xxhash64("conv_id", "turn").alias("read"), F.col("text").alias("sequence"))
    p = KmerParams(4)
    return tree.route_votes(target_kmers(docs, p, ["read"], positions=True), target_kmers(b, p, ["leaf"], positions=True), top=3)


@R.add()
def pair_features(spark, d):
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("sequence"))
    f = cut(tree.pair_features(target_kmers(b, KmerParams(4), ["id"], positions=True), 12))
    return tree.shared_features(f, f, top=3, weighted=True)


@R.add()
def signature_groups(spark, d):
    g = tree.signature_groups(_supply(spark, d), 8)
    return tree.group_pairs(g.select("set_id", F.xxhash64("part", "signature").alias("group")))


@R.add("SELECT s AS a, t AS b FROM (SELECT c_nationkey, c_custkey AS s, lead(c_custkey) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS t, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer) WHERE t IS NOT NULL AND n > 10 UNION SELECT f, c_custkey FROM (SELECT c_custkey, min(c_custkey) OVER (PARTITION BY c_nationkey) AS f, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer) WHERE c_custkey <> f AND n > 10 UNION SELECT x.c_custkey, y.c_custkey FROM (SELECT *, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer) x JOIN customer y ON x.c_nationkey = y.c_nationkey AND x.c_custkey < y.c_custkey WHERE n <= 10")
def group_pairs(spark, d):
    g = table(spark, d, "customer").select(F.col("c_custkey").alias("set_id"), F.col("c_nationkey").alias("group"))
    return tree.group_pairs(g, 10)


@R.add()
def packed_chunks(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("pos"), F.col("p_size").cast("long").alias("size"))
    return tree.packed_chunks(p, 500)


# Covers and estimators, over the hits of the benchmark passages.


def _components(spark, d):
    i, found, each = hits(spark, d)
    units = i.units.select("unit", "t_g", "m_g", "pin_sum", "pin_hist", "len_cv")
    return i, found, cut(assign.with_components(each).join(units, "unit"))


@R.add()
def gather_greedy(spark, d):
    i, _, k = _components(spark, d)
    return named(assign.gather(k.select("component", "unit", "hash", "t_g"))[1], i).select("unit_key", "unique_kmers", "rank")


@R.add()
def em_poisson(spark, d):
    i, _, k = _components(spark, d)
    return named(estimators.em(k), i).select("unit_key", "coverage")


@R.add()
def em_poisson_distributed(spark, d):
    i, _, k = _components(spark, d)
    return named(estimators.poisson_em_distributed(k), i).select("unit_key", "coverage")


@R.add("""WITH truth AS (SELECT l_suppkey AS unit, round(avg(l_quantity)) AS coverage FROM lineitem GROUP BY 1)
SELECT unit::BIGINT AS unit, coverage::DOUBLE AS coverage FROM truth""")
def em_in_blocks(spark, d):
    """One component of all suppliers, which share parts: every k-mer is hit as often as its holders' coverages sum up to, so these are the fixed point that the blocks must find."""
    lines = table(spark, d, "lineitem").select(F.col("l_suppkey").cast("long").alias("unit"), "l_partkey", "l_quantity")
    truth = lines.groupBy("unit").agg(F.round(F.avg("l_quantity")).alias("true"))
    parts = lines.select("unit", F.col("l_partkey").cast("long").alias("hash")).distinct()
    own = lines.select("unit", (-100 * F.col("unit") - F.col("l_quantity").cast("long")).alias("hash")).distinct()
    held = cut(parts.unionByName(own).join(truth, "unit"))
    hits_ = held.groupBy("hash").agg(F.sum("true").alias("hits"))
    sizes = held.groupBy("unit").agg(F.count(F.lit(1)).alias("m_g"))
    rows = held.join(hits_, "hash").join(sizes, "unit").select(F.lit(0).cast("long").alias("component"), "unit", "hash", "hits", "m_g")
    return estimators.em(rows, most_rows=5_000, tol=1e-6).select("unit", F.round("coverage", 1).alias("coverage"))


@R.add()
def em_zero_inflated(spark, d):
    i, _, k = _components(spark, d)
    return named(estimators.em(k, zero_inflated=True), i).select("unit_key", "coverage", "present")


@R.add()
def em_beta_prior(spark, d):
    i, _, k = _components(spark, d)
    prior = estimators.present_prior(estimators.em(k, zero_inflated=True), 0.5, 3) or (2.0, 2.0)
    return named(estimators.em(k, zero_inflated=True, prior=prior), i).select("unit_key", "coverage", "present")


@R.add()
def em_levels(spark, d):
    i, _, k = _components(spark, d)
    return named(estimators.em_levels(k), i).select("unit_key", "coverage", "present")


def _owned(spark, d):
    i, found, k = _components(spark, d)
    rows, taken = assign.gather(k)
    return i, found, k, cut(rows), cut(taken)


@R.add()
def greedy_coverage(spark, d):
    i, _, _, rows, _ = _owned(spark, d)
    return named(assign.greedy_coverage(rows.where("owned")), i).select("unit_key", "coverage")


@R.add()
def presence_probability(spark, d):
    i, found, _, rows, _ = _owned(spark, d)
    n = found.select("read").distinct().count()
    p = estimators.presence(rows.where("owned").select("unit", "holders"), i.units, n, i.units.count(), background=1e-3)
    return named(assign.q_values(p), i).select("unit_key", "present_prob", "present_q")


@R.add("WITH p AS (SELECT s_suppkey AS unit, s_acctbal / 20000.0 + 0.5 AS p FROM supplier), f AS (SELECT *, avg(1 - p) OVER (ORDER BY p DESC, unit ROWS UNBOUNDED PRECEDING) AS fdr FROM p) SELECT unit, round(min(fdr) OVER (ORDER BY p DESC, unit ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 5) AS present_q FROM f")
def fdr_q(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("unit"), (F.col("s_acctbal") / 20000.0 + 0.5).alias("present_prob"))
    return assign.q_values(s).select("unit", F.round("present_q", 5).alias("present_q"))


@R.add()
def kmer_dispersion(spark, d):
    i, _, k = _components(spark, d)
    return named(estimators.dispersion(k, estimators.em(k), 3), i).select("unit_key", "dispersion")


@R.add()
def rate_mixture(spark, d):
    i, _, k = _components(spark, d)
    return named(estimators.rate_mixture(k, estimators.em(k), 3, depth=1.0), i).select("unit_key", "coverage_mix", "mix_rates")


@R.add()
def coverage_intervals(spark, d):
    i, _, k = _components(spark, d)
    fit = estimators.em(k, zero_inflated=True).join(i.units.select("unit", "m_g"), "unit")
    fit = fit.withColumn("hit_kmers", F.col("present") * F.col("m_g") * -F.expm1(-F.col("coverage"))).withColumn("inflation", F.lit(1.0)).where("coverage > 0")
    return named(estimators.coverage_intervals(fit), i).select("unit_key", "coverage_lo", "coverage_hi")


@R.add()
def posterior_intervals(spark, d):
    i, found, k = _components(spark, d)
    per = found.select("read", "hash").groupBy("hash", "read").agg(F.count(F.lit(1)).alias("n")).join(k.select("component", "hash").distinct(), "hash")
    out = estimators.posterior(k.select("component", "unit", "hash", "m_g", "pin_sum", F.lit(1.0).alias("present_prob")), per.select("component", "hash", "read", "n"))
    return named(out, i).drop("unit")


@R.add()
def identity_fit(spark, d):
    i, _, k = _components(spark, d)
    fit = estimators.em(k, zero_inflated=True).join(i.units, "unit").withColumn("windows", identity.unit_windows(i.params.k)).withColumn("clumping", F.lit(1.0))
    return named(identity.identity_fit(fit, identity.SurvivalModel(i.params.k, shape=1.0, region=5.0), least_kmers=1, least_coverage=0.0), i).select("unit_key", "aai", "aai_lo", "aai_hi", "aai_kmers")


@R.add("SELECT p_partkey, round(power(p_size / 50.0, 1.0 / 11), 8) AS naive, round(CASE WHEN p_size / 50.0 <= 0.1 THEN 0.2 WHEN p_size / 50.0 <= 0.5 THEN 0.2 + (p_size / 50.0 - 0.1) * 0.75 WHEN p_size / 50.0 <= 0.9 THEN 0.5 + (p_size / 50.0 - 0.5) * 1.0 ELSE 0.9 END, 8) AS calibrated FROM part")
def identity_naive_and_calibrated(spark, d):
    x = F.col("p_size") / 50.0
    return table(spark, d, "part").select("p_partkey", F.round(identity.identity_naive(x, 11), 8).alias("naive"), F.round(identity.calibrated(x, [(0.1, 0.2), (0.5, 0.5), (0.9, 0.9)]), 8).alias("calibrated"))


@R.add()
def link_cuts(spark, d):
    forest = overlaps.overlap_forest(_sold(spark, d), lambda shared, x, y: -(shared / np.minimum(x, y)), "double")
    nodes = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("node")).distinct()
    return graph.forest_cuts(forest, nodes, [0.0, 0.05, 0.1, 0.3])


@R.add()
def flagship_profile(spark, d):
    """The whole query: hits, components, greedy cover, presence, both fits and identity, a row per unit that is kept."""
    i, found, k, rows, taken = _owned(spark, d)
    from ..operators.lookup import unit_sums

    sums = unit_sums(k.select("unit", "hash", "hits", "holders"), found, i)
    prob = estimators.presence(rows.where("owned").select("unit", "holders"), i.units, found.select("read").distinct().count(), i.units.count(), background=1e-3)
    fit = cut(estimators.em(k, zero_inflated=True).withColumnRenamed("coverage", "coverage_zi"))
    whole = fit.withColumnRenamed("coverage_zi", "coverage").join(i.units, "unit").withColumn("windows", identity.unit_windows(i.params.k)).withColumn("clumping", F.lit(1.0))
    aai = identity.identity_fit(whole, identity.SurvivalModel(i.params.k), least_kmers=1, least_coverage=0.0)
    out = sums.join(taken, "unit").join(estimators.em(k).select("unit", "coverage"), "unit").join(fit, "unit").join(prob, "unit").join(aai, "unit", "left")
    return assign.q_values(out).drop("t_g").orderBy("rank")


# Reference sets.


@R.add("""WITH m AS (SELECT source || '/' || lang AS unit_key, doc_id, text, row_number() OVER (PARTITION BY source || '/' || lang ORDER BY length(text) DESC, doc_id) AS f FROM documents),
o AS (SELECT *, row_number() OVER (PARTITION BY unit_key, text ORDER BY f) AS c FROM m), r AS (SELECT unit_key, doc_id, f, row_number() OVER (PARTITION BY unit_key ORDER BY length(text) DESC, doc_id) - 1 AS i, count(*) OVER (PARTITION BY unit_key) AS n FROM o WHERE c = 1 AND f > 1)
SELECT unit_key, doc_id AS member_id, true AS rep FROM m WHERE f = 1 UNION ALL SELECT unit_key, doc_id, false FROM r WHERE n <= 2 OR ((i + 1) * 2) // n > (i * 2) // n""")
def fetch_spread_members(spark, d):
    from .sequences import steps

    members = steps(spark, d)[0]
    out = reference_set.spread_members(members, members.select("unit").distinct(), 3)
    return out.select("unit_key", "member_id", "rep")


@R.add("WITH p AS (SELECT s_suppkey AS unit, s_nationkey::BIGINT AS component, s_acctbal AS hits, s_suppkey % 100 / 100.0 AS q FROM supplier), t AS (SELECT * FROM p WHERE q <= 0.2 ORDER BY hits DESC, unit LIMIT 15), room AS (SELECT component, count(*) * 2 AS room FROM t GROUP BY 1), o AS (SELECT p.*, row_number() OVER (PARTITION BY p.component ORDER BY hits DESC, unit) AS r FROM p WHERE unit NOT IN (SELECT unit FROM t)) SELECT unit, component, 'target' AS role FROM t UNION ALL SELECT unit, o.component, 'neighbour' FROM o JOIN room USING (component) WHERE r <= room")
def reference_roles(spark, d):
    p = table(spark, d, "supplier").select(F.col("s_suppkey").alias("unit"), F.col("s_nationkey").cast("long").alias("component"), F.col("s_acctbal").alias("hits"), (F.pmod("s_suppkey", F.lit(100)) / 100.0).alias("present_q"))
    return reference_set.reference_roles(p, 0.2, 15, 2)


@R.add("SELECT p_partkey AS seq_id, floor((sum(p_size) OVER (ORDER BY p_partkey) - p_size) * 8 / (sum(p_size) OVER ())::DOUBLE)::INTEGER AS part FROM part")
def equal_parts(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("seq_id"), F.col("p_size").cast("long").alias("length"))
    return reference_set.equal_parts(p, 8).select("seq_id", "part")


@R.add("SELECT component, floor(coalesce(sum(n) OVER (ORDER BY component ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 5000.0)::BIGINT AS block FROM (SELECT p_partkey % 50 AS component, sum(p_size) AS n FROM part GROUP BY 1)")
def packed_blocks(spark, d):
    p = table(spark, d, "part").select(F.pmod("p_partkey", F.lit(50)).alias("component"), F.col("p_size").cast("long").alias("length"))
    return reference_set.packed_blocks(p, 5000)


# Pileups: lineitems as residues (return flag) of orders at parts.


def _hits(spark, d) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.select(F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax").alias("hit"), F.col("l_orderkey").alias("read"), F.lit(0).alias("mate"), F.col("l_partkey").alias("seq"), F.col("l_suppkey").alias("unit"), F.when(F.col("l_suppkey") % 3 == 0, "neighbour").otherwise("target").alias("role"), (F.col("l_quantity") / 10).alias("score"), (F.lit(1.0) - F.col("l_discount")).alias("identity"))


@R.add("""WITH h AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_quantity / 10 AS score, 1.0 - l_discount AS identity FROM lineitem), b AS (SELECT *, max(score) OVER (PARTITION BY l_orderkey) AS best, max(score) OVER (PARTITION BY l_orderkey, l_suppkey) AS ubest FROM h)
SELECT coalesce(CASE WHEN score < best * 0.5 THEN 'top' WHEN score < best - 2 THEN 'below_best' WHEN score < ubest - 1 THEN 'below_unit_best' END, 'kept') AS dropped_by, count(*)::BIGINT AS n FROM b GROUP BY 1""")
def hit_filter(spark, d):
    out = pileup.filter_hits(_hits(spark, d), top=50, below_best=2, below_unit_best=1)
    return out.groupBy(F.coalesce("dropped_by", F.lit("kept")).alias("dropped_by")).agg(F.count(F.lit(1)).alias("n"))


_POST = """WITH h AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, CASE WHEN l_suppkey % 3 = 0 THEN 'neighbour' ELSE 'target' END AS role, l_quantity / 10 AS score FROM lineitem), m AS (SELECT *, power(2.0, score - max(score) OVER (PARTITION BY l_orderkey)) AS e FROM h),
p AS (SELECT *, e / sum(e) OVER (PARTITION BY l_orderkey) AS posterior, first_value(role) OVER (PARTITION BY l_orderkey ORDER BY score DESC, role DESC) = 'target' AS kept FROM m)
"""


@R.add(_POST + "SELECT l_orderkey AS read, l_partkey AS seq, round(posterior, 8) AS posterior, kept FROM p")
def read_posterior(spark, d):
    return pileup.posteriors(_hits(spark, d)).select("read", "seq", F.round("posterior", 8).alias("posterior"), "kept")


def _pile(spark, d, hits_read_again: bool = False):
    h = pileup.posteriors(_hits(spark, d))
    if hits_read_again:
        h = cut(h)
    li = table(spark, d, "lineitem")
    cols = li.select(F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax").alias("hit"), F.col("l_linenumber").alias("col"), F.lit(0).cast("long").alias("qpos"), F.col("l_returnflag").alias("residue"), F.lit("N").alias("ref"), F.when(F.col("l_returnflag") == "N", 1.0).otherwise(-1.0).alias("term"))
    return h, cut(pileup.column_weights(cols, h))


@R.add("""WITH h AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag AS r, CASE WHEN l_suppkey % 3 = 0 THEN 'neighbour' ELSE 'target' END AS role, l_quantity / 10 AS score, CASE WHEN l_returnflag = 'N' THEN 1.0 ELSE -1.0 END AS t FROM lineitem), m AS (SELECT *, power(2.0, score - max(score) OVER (PARTITION BY l_orderkey)) AS e FROM h),
w AS (SELECT *, e * power(2.0, -t) / sum(e * power(2.0, -t)) OVER o AS w, first_value(role) OVER (PARTITION BY l_orderkey ORDER BY score DESC, role DESC) = 'target' AS kept FROM m WINDOW o AS (PARTITION BY l_orderkey))
SELECT l_partkey AS seq, l_linenumber AS col, r AS residue, round(sum(w), 6) AS weight FROM w WHERE kept AND role = 'target' GROUP BY 1, 2, 3""")
def leave_one_column_out(spark, d):
    return pileup.pile(_pile(spark, d)[1]).select("seq", "col", "residue", F.round("weight", 6).alias("weight"))


@R.add("WITH p AS (SELECT l_partkey AS seq, l_linenumber AS col, l_returnflag AS residue, sum(l_quantity) AS w FROM lineitem GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY seq, col ORDER BY w DESC, residue) AS i FROM p) SELECT seq, col, round(sum(w), 4) AS depth, max(residue) FILTER (WHERE i = 1) AS consensus, coalesce(max(residue) FILTER (WHERE i = 2), '') AS alt, round(coalesce(max(w) FILTER (WHERE i = 2), 0) / sum(w), 8) AS alt_freq FROM r GROUP BY 1, 2")
def consensus_and_alt(spark, d):
    piled = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("seq"), F.col("l_linenumber").alias("col"), F.col("l_returnflag").alias("residue")).agg(F.sum("l_quantity").alias("weight"), F.lit(0.0).alias("sibling_weight"))
    c = pileup.consensus(piled)
    return c.select("seq", "col", F.round("depth", 4).alias("depth"), "consensus", F.coalesce("alt", F.lit("")).alias("alt"), F.round("alt_freq", 8).alias("alt_freq"))


@R.add()
def unit_results(spark, d):
    h, w = _pile(spark, d, hits_read_again=True)
    cols = pileup.consensus(pileup.pile(w))
    return pileup.unit_results(w, cols, cols.select("seq", "col", F.lit("N").alias("ref")), h)


@R.add()
def source_em(spark, d):
    c = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("pair"), F.col("l_suppkey").alias("source"), F.lit(100).cast("long").alias("length"), (F.col("l_discount") * 100).cast("long").alias("mismatches")).withColumn("component", F.lit(0).cast("long"))
    one = c.groupBy("component", "pair", "source").agg(F.max("length").alias("length"), F.min("mismatches").alias("mismatches"))
    return pileup.best_source(pileup.source_em(one, novel=0.2))


@R.add()
def haplotypes(spark, d):
    li = table(spark, d, "lineitem")
    sites = li.select(F.col("l_suppkey").alias("seq"), F.col("l_orderkey").alias("pair"), F.col("l_linenumber").alias("col"), F.col("l_returnflag").alias("residue"), F.lit("N").alias("base"))
    return pileup.haplotypes(sites.dropDuplicates(["seq", "pair", "col"]))


@R.add(_POST + "SELECT read, unit, round(weight, 5) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY read ORDER BY weight DESC, unit) AS r FROM (SELECT l_orderkey AS read, l_suppkey AS unit, round(sum(posterior), 10) AS weight FROM p WHERE role = 'target' GROUP BY 1, 2)) WHERE r = 1")
def assigned_units(spark, d):
    p = pileup.posteriors(_hits(spark, d))
    sums = p.where("role = 'target'").groupBy("read", "unit").agg(F.round(F.sum("posterior"), 10).alias("posterior")).withColumn("role", F.lit("target"))
    return pileup.assigned_units(sums).select("read", "unit", F.round("weight", 5).alias("weight"))


# Cross references: orders as pairs, suppliers as functions, nations as genomes, regions above them.


@R.add("""WITH fw AS (SELECT l_orderkey AS pair, l_suppkey AS unit, sum(l_quantity) AS w FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1, 2), f AS (SELECT pair, unit, w / sum(w) OVER (PARTITION BY pair) AS w FROM fw),
g AS (SELECT o_orderkey AS pair, n_name AS genome, r_name AS region FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o_orderstatus <> 'P'),
j AS (SELECT unit, w, coalesce(genome, 'unclassified') AS genome, coalesce(region, 'unclassified') AS region FROM f LEFT JOIN g USING (pair)),
t AS (SELECT unit, 'genome' AS rank, genome AS taxon, sum(w) AS reads FROM j GROUP BY 1, 3 UNION ALL SELECT unit, 'region', region, sum(w) FROM j GROUP BY 1, 3)
SELECT unit, rank, taxon, round(reads, 6) AS reads, round(reads / sum(reads) OVER (PARTITION BY unit, rank), 6) AS share FROM t""")
def function_by_taxon(spark, d):
    li = table(spark, d, "lineitem").where("l_returnflag <> 'R'")
    fw = xref.function_weights(li.groupBy(F.col("l_orderkey").alias("pair"), F.col("l_suppkey").alias("unit")).agg(F.sum("l_quantity").alias("posterior")).withColumns({"mate": F.lit(0), "role": F.lit("target")}))
    o, c, n, r = (table(spark, d, t) for t in ("orders", "customer", "nation", "region"))
    gw = o.where("o_orderstatus <> 'P'").join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).select(F.col("o_orderkey").alias("pair"), F.col("n_name").alias("genome"), F.lit(1.0).alias("w"), F.lit(100.0).alias("bases"))
    contigs = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_name").alias("contig"), F.col("n_name").alias("genome"), F.lit(1000).alias("length"), "r_name")
    lengths = table(spark, d, "supplier").select(F.col("s_suppkey").alias("unit"), F.lit(300).alias("unit_length"))
    out, _ = xref.cross_reference(fw, gw, contigs, lengths, {"region": F.col("r_name")})
    return out.select("unit", "rank", "taxon", F.round("reads", 6).alias("reads"), F.round("share", 6).alias("share"))


@R.add("""WITH h AS (SELECT l_orderkey AS pair, l_linenumber % 2 AS mate, l_suppkey % 10 AS genome, l_quantity AS score, l_partkey AS aligned FROM lineitem WHERE l_discount <= 0.05 AND l_partkey > 0), b AS (SELECT pair, mate, genome, max({'s': score, 'a': aligned}) AS b FROM h GROUP BY 1, 2, 3), s AS (SELECT pair, genome, count(*) AS mates, sum(b.s) AS score, sum(b.a) AS aligned FROM b GROUP BY 1, 2), t AS (SELECT *, rank() OVER (PARTITION BY pair ORDER BY mates DESC, score DESC) AS r FROM s)
SELECT pair, genome::VARCHAR AS genome, round(1.0 / count(*) OVER (PARTITION BY pair), 8) AS w, aligned::DOUBLE AS bases FROM t WHERE r = 1""")
def genome_weights_ties(spark, d):
    li = table(spark, d, "lineitem")
    h = li.select(F.col("l_orderkey").alias("pair"), F.when(F.col("l_linenumber") % 2 == 1, 128).otherwise(0).alias("flag"), (F.col("l_suppkey") % 10).cast("string").alias("contig"), F.lit(60).alias("mapq"), F.col("l_quantity").alias("score"), F.when((F.col("l_discount") <= 0.05), 0).otherwise(F.col("l_partkey")).alias("mismatches"), F.col("l_partkey").alias("aligned"))
    contigs = spark.range(10).select(F.col("id").cast("string").alias("contig"), F.col("id").cast("string").alias("genome"))
    out = xref.genome_weights(h, contigs)
    return out.select("pair", "genome", F.round("w", 8).alias("w"), "bases")


# Evaluation.


@R.add("WITH r AS (SELECT o_orderpriority AS k, rank() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_orderpriority, o_totalprice) - 1) / 2.0 AS x, rank() OVER (PARTITION BY o_orderpriority ORDER BY o_custkey) + (count(*) OVER (PARTITION BY o_orderpriority, o_custkey) - 1) / 2.0 AS y FROM orders) SELECT k AS priority, round(corr(x, y), 8) AS spearman, count(*)::BIGINT AS n FROM r GROUP BY 1")
def spearman(spark, d):
    out = evaluate.spearman(table(spark, d, "orders"), "o_totalprice", "o_custkey", ["o_orderpriority"])
    return out.select(F.col("o_orderpriority").alias("priority"), F.round("spearman", 8).alias("spearman"), "n")


@R.add("WITH a AS (SELECT s_nationkey AS k, sum(s_acctbal) / sum(sum(s_acctbal)) OVER () AS x FROM supplier GROUP BY 1), b AS (SELECT c_nationkey AS k, sum(c_acctbal) / sum(sum(c_acctbal)) OVER () AS y FROM customer GROUP BY 1) SELECT round(sum(abs(coalesce(x, 0) - coalesce(y, 0))), 6) AS l1 FROM a FULL JOIN b USING (k)")
def share_l1(spark, d):
    a = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.sum("s_acctbal").alias("t"))
    b = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.sum("c_acctbal").alias("e"))
    return evaluate.share_l1(a, b, "k", "t", "e").select(F.round("l1", 6).alias("l1"))


@R.add("SELECT t.threshold, count(*) FILTER (WHERE p_retailprice >= t.threshold)::BIGINT AS detected, count(*) FILTER (WHERE p_retailprice >= t.threshold AND p_size > 25)::BIGINT AS true_positives, round(count(*) FILTER (WHERE p_retailprice >= t.threshold AND p_size > 25) / count(*) FILTER (WHERE p_retailprice >= t.threshold)::DOUBLE, 8) AS purity, round(count(*) FILTER (WHERE p_retailprice >= t.threshold AND p_size > 25) / count(*) FILTER (WHERE p_size > 25)::DOUBLE, 8) AS completeness FROM part, (SELECT unnest([950.0, 1000.0, 1040.0])::DOUBLE AS threshold) t GROUP BY 1")
def purity_completeness(spark, d):
    p = table(spark, d, "part").select(F.col("p_retailprice").alias("score"), (F.col("p_size") > 25).alias("truth"))
    out = evaluate.detection_scores(p, [950.0, 1000.0, 1040.0])
    return out.select("threshold", "detected", "true_positives", F.round("purity", 8).alias("purity"), F.round("completeness", 8).alias("completeness"))


@R.add("WITH s AS (SELECT round(c_acctbal, -2) + 0.0 AS score, count(*) AS c, count(*) FILTER (WHERE c_mktsegment = 'BUILDING') AS t FROM customer GROUP BY 1) SELECT score, sum(c) OVER w::BIGINT AS n, round(sum(t) OVER w / (SELECT sum(t) FROM s)::DOUBLE, 8) AS recall, round(sum(t) OVER w / sum(c) OVER w::DOUBLE, 8) AS precision FROM s WINDOW w AS (ORDER BY score DESC)")
def recall_precision_curve(spark, d):
    c = table(spark, d, "customer").select((F.round("c_acctbal", -2) + 0.0).alias("score"), (F.col("c_mktsegment") == "BUILDING").alias("truth"), "c_custkey")
    out = evaluate.recall_curve(c, "score", "truth", "c_custkey")
    return out.select("score", "n", F.round("recall", 8).alias("recall"), F.round("precision", 8).alias("precision"))


@R.add("SELECT p_brand, p_type, count(*)::BIGINT AS n, count(l.k)::BIGINT AS marked FROM part LEFT JOIN (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_quantity > 48) l ON p_partkey = k GROUP BY ROLLUP (p_brand, p_type)")
def coverage_rollup(spark, d):
    p = table(spark, d, "part")
    m = table(spark, d, "lineitem").where("l_quantity > 48").select(F.col("l_partkey").alias("p_partkey"))
    return evaluate.coverage_rollup(p, m, "p_partkey", ["p_brand", "p_type"])


@R.add("SELECT coalesce(a.bin, b.bin) AS bin, coalesce(a.n, 0)::BIGINT AS left, coalesce(b.n, 0)::BIGINT AS right FROM (SELECT floor(c_acctbal / 500)::BIGINT AS bin, count(*) AS n FROM customer GROUP BY 1) a FULL JOIN (SELECT floor(s_acctbal / 500)::BIGINT AS bin, count(*) AS n FROM supplier GROUP BY 1) b ON a.bin = b.bin")
def score_histogram_full_join(spark, d):
    a = table(spark, d, "customer").select(F.col("c_acctbal").alias("v"))
    return evaluate.histogram_compare(a, table(spark, d, "supplier").select(F.col("s_acctbal").alias("v")), "v", 500)


@R.add("SELECT o_orderpriority, round(count(*) FILTER (WHERE o_orderstatus = 'F') / count(*)::DOUBLE, 8) AS f, round(count(*) FILTER (WHERE o_orderstatus = 'O') / count(*)::DOUBLE, 8) AS o, round(count(*) FILTER (WHERE o_orderstatus = 'P') / count(*)::DOUBLE, 8) AS p FROM orders GROUP BY 1")
def stage_pivot(spark, d):
    out = evaluate.stage_pivot(table(spark, d, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"])
    return out.select("o_orderpriority", *(F.round(x, 8).alias(x.lower()) for x in "FOP"))


@R.add("WITH c AS (SELECT p_brand, count(*) FILTER (WHERE p_size > 25) AS k, count(*) AS n FROM part GROUP BY 1), z AS (SELECT *, k / n::DOUBLE AS s, 1.959963984540054 AS z FROM c) SELECT p_brand, round((s + z * z / (2 * n) - z * sqrt(s * (1 - s) / n + z * z / (4.0 * n * n))) / (1 + z * z / n), 8) AS low, round((s + z * z / (2 * n) + z * sqrt(s * (1 - s) / n + z * z / (4.0 * n * n))) / (1 + z * z / n), 8) AS high FROM z")
def wilson_interval(spark, d):
    c = table(spark, d, "part").groupBy("p_brand").agg(F.count_if(F.col("p_size") > 25).alias("k"), F.count(F.lit(1)).alias("n"))
    return evaluate.with_wilson(c, "k", "n").select("p_brand", F.round("low", 8).alias("low"), F.round("high", 8).alias("high"))


@R.add("SELECT floor(p_size / 5.0)::BIGINT AS bin, count(*)::BIGINT AS n, round(sum(p_retailprice * p_size) / sum(p_retailprice), 6) AS x, round(sum(p_retailprice * p_retailprice) / sum(p_retailprice), 6) AS y FROM part GROUP BY 1")
def weighted_bins(spark, d):
    out = evaluate.weighted_bins(table(spark, d, "part"), "p_size", "p_retailprice", "p_retailprice", 5.0)
    return out.select("bin", "n", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@R.add()
def isotonic_fit(spark, d):
    return evaluate.isotonic_fit(evaluate.weighted_bins(table(spark, d, "part"), "p_size", "p_retailprice", "p_retailprice", 5.0))


@R.add()
def ladder_subsets(spark, d):
    """Nested samples of each source's documents by one shuffle: the sampling operator."""
    docs = table(spark, d, "documents").select("doc_id", "source")
    return evaluate.nested_subsets(docs, "doc_id", [1, 5, 20], by=["source"]).select("doc_id", "source", "subset")


@R.add("SELECT l_suppkey, round(power(1 - product(1 - least(power(1 - l_discount, 11), 1 - 1e-12)), 1.0 / 11), 8) AS identity FROM lineitem WHERE l_discount >= 0.09 GROUP BY 1")
def union_identity(spark, d):
    li = table(spark, d, "lineitem").where("l_discount >= 0.09").withColumn("a", 1 - F.col("l_discount"))
    return evaluate.union_identity(li, ["l_suppkey"], "a", 11).select("l_suppkey", F.round("identity", 8).alias("identity"))


@R.add("SELECT round(avg(CASE WHEN l_extendedprice BETWEEN l_quantity * 900 AND l_quantity * 1100 THEN 1.0 ELSE 0.0 END), 8) AS cover, round(median(l_quantity * 200), 6) AS width FROM lineitem")
def interval_cover(spark, d):
    li = table(spark, d, "lineitem").select("l_extendedprice", (F.col("l_quantity") * 900).alias("lo"), (F.col("l_quantity") * 1100).alias("hi"))
    return evaluate.interval_cover(li, "lo", "hi", "l_extendedprice").select(F.round("cover", 8).alias("cover"), F.round("width", 6).alias("width"))


@R.add("SELECT user_id, round(max(value) - min(value), 6) AS spread FROM events GROUP BY 1")
def seed_agreement(spark, d):
    return evaluate.seed_agreement(table(spark, d, "events"), "user_id", "value").select("user_id", F.round("spread", 6).alias("spread"))


@R.add()
def merge_bins(spark, d):
    b = table(spark, d, "part").groupBy(F.col("p_size").cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return evaluate.merge_small_bins(b, 100)




# Kernels and sketches.


def _pairs(spark, d) -> DataFrame:
    """Each benchmark passage with the next one and with itself."""
    b = table(spark, d, "benchmark").select("item_id", F.upper("text").alias("text"))
    other = b.select(F.col("item_id").alias("other"), F.col("text").alias("b"))
    return b.withColumn("other", F.explode(F.array(F.col("item_id"), F.col("item_id") + 1))).withColumnRenamed("text", "a").join(other, "other")


@R.add("SELECT item_id, item_id AS other, 1.0::DOUBLE AS identity, length(substr(text, 1, 120))::BIGINT AS columns FROM benchmark WHERE regexp_full_match(substr(text, 1, 120), '[ -~\\n]*')")
def overlap_identities(spark, d):
    """As its SQL states it: the first 120 characters of passages of plain letters with themselves. Whole texts and the other pairs of ``_pairs`` are for ``seed_alignments`` and ``ungapped_scores``."""
    b = table(spark, d, "benchmark").select("item_id", F.col("item_id").alias("other"), F.substring("text", 1, 120).alias("a"))
    # Letters are judged before they are put in upper case, which makes plain ones of some others; \z, since $ passes over a line's end.
    same = b.where(F.col("a").rlike(r"\A[ -~\n]*\z")).withColumn("a", F.upper("a")).withColumn("b", F.col("a"))
    found = align.identities(same, ["item_id", "other"])
    return found.withColumn("identity", F.when(F.col("columns") == 0, 1.0).otherwise(F.col("identity")))  # an empty passage equals itself


@R.add()
def seed_alignments(spark, d):
    return align.seed_alignments(_pairs(spark, d), ["item_id", "other"])


@R.add()
def ungapped_scores(spark, d):
    return align.ungapped_scores(_pairs(spark, d), ["item_id", "other"])


@R.add("SELECT count(DISTINCT l_partkey)::BIGINT AS kept FROM lineitem")
def bloom_membership(spark, d):
    """No key that was put in is missed."""
    keys = table(spark, d, "lineitem").select(F.xxhash64("l_partkey").alias("hash")).distinct()
    blocks = sketch.bloom_blocks(keys.count())
    return sketch.bloom_contains(keys, sketch.bloom_table(keys, blocks), blocks).agg(F.count(F.lit(1)).alias("kept"))


@R.add(_SUPPLY + "SELECT id, other, shared FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY shared DESC, other) AS r FROM (SELECT a AS id, b AS other, shared FROM pair UNION ALL SELECT b, a, shared FROM pair)) WHERE r <= 10")
def nearest_relatives(spark, d):
    return sketch.nearest_relatives(_supply_much(spark, d).withColumnRenamed("set_id", "id"))


@R.add()
def linear_clusters(spark, d):
    docs = table(spark, d, "benchmark").select(F.col("item_id").alias("target_id"), F.upper("text").alias("sequence"))
    return sketch.linear_clusters(docs, KmerParams(4), 0.8)


@R.add()
def signature_kmers(spark, d):
    b = table(spark, d, "benchmark").select("item_id", F.col("text").alias("sequence"))
    return sketch.signature_kmers(b, 7, "protein", ["item_id"], 2)


@R.add(_SUPPLY + "SELECT 1::BIGINT AS read, set_id AS unit, round(sum(b) - (count(*) - 1) * 1.5, 6) AS score FROM held JOIN (SELECT hash, -log2(count(*) / 100.0) AS b FROM held GROUP BY 1) USING (hash) GROUP BY 2")
def unit_evidence(spark, d):
    held = _supply_much(spark, d)
    bits = tree.key_bits(held, 100)
    keys = held.select("hash", F.col("set_id").alias("unit")).join(bits, "hash")
    asked = held.select(F.lit(1).cast("long").alias("read"), "hash").distinct()
    return sketch.unit_evidence(asked, keys, 1.5).select("read", "unit", F.round("score", 6).alias("score"))


# Families.


@R.add("WITH c AS (SELECT l_suppkey AS family, l_linenumber AS col, l_returnflag AS r, count(*) AS c FROM lineitem GROUP BY 1, 2, 3), s AS (SELECT *, c / sum(c) OVER (PARTITION BY family, col)::DOUBLE AS p FROM c) SELECT family, col, sum(c)::BIGINT AS n, round(sum(-p * log2(p)), 8) AS entropy FROM s GROUP BY 1, 2")
def column_entropy(spark, d):
    c = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("family"), F.col("l_linenumber").alias("col"), F.col("l_returnflag").alias("residue"))
    return families.column_entropy(c, ["family", "col"]).select("family", "col", "n", F.round("entropy", 8).alias("entropy"))


@R.add("WITH o AS (SELECT DISTINCT o_custkey AS id, o_orderpriority AS p FROM orders), n AS (SELECT c_nationkey AS g, count(*) AS n FROM customer GROUP BY 1) SELECT c_nationkey AS nation, p AS priority FROM o JOIN customer ON id = c_custkey JOIN n ON g = c_nationkey GROUP BY 1, 2, n HAVING count(*) >= 0.85 * n")
def soft_keys(spark, d):
    held = table(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("hash"))
    groups = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("group"))
    return families.soft_keys(held, groups, 0.85).select(F.col("group").alias("nation"), F.col("hash").alias("priority"))


@R.add("SELECT p_partkey, round(2 * greatest(p_size * 10 - 5 + 1, 1) * (1 - power(0.5 + p_size / 100.0, 5)), 6) AS difference FROM part")
def expected_difference(spark, d):
    x = families.expected_difference(0.5 + F.col("p_size") / 100.0, F.col("p_size") * 10, 5)
    return table(spark, d, "part").select("p_partkey", F.round(x, 6).alias("difference"))


@R.add("WITH t AS (SELECT p_brand AS c, p_type AS u, sum(p_size) AS a FROM part GROUP BY 1, 2), e AS (SELECT p_brand AS c, p_type AS u, sum(p_retailprice) AS a FROM part WHERE p_size > 10 GROUP BY 1, 2), x AS (SELECT c, u, a / sum(a) OVER (PARTITION BY c)::DOUBLE AS s FROM t), y AS (SELECT c, u, a / sum(a) OVER (PARTITION BY c) AS s FROM e) SELECT c AS brand, round(sum(abs(coalesce(x.s, 0) - coalesce(y.s, 0))), 6) AS l1 FROM x FULL JOIN y USING (c, u) GROUP BY c")
def split_scores(spark, d):
    p = table(spark, d, "part").withColumnsRenamed({"p_brand": "component", "p_type": "unit"})
    t = p.groupBy("component", "unit").agg(F.sum("p_size").alias("abundance"))
    e = p.where("p_size > 10").groupBy("component", "unit").agg(F.sum("p_retailprice").alias("abundance"))
    return families.split_scores(t, e).select(F.col("component").alias("brand"), F.round("l1", 6).alias("l1"))


@R.add("SELECT count(*)::BIGINT AS groups, count(*) FILTER (WHERE p > 0)::BIGINT AS hit, round(avg(p), 8) AS purity FROM (SELECT c_nationkey, avg(CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 350000) THEN 1.0 ELSE 0.0 END) AS p FROM customer GROUP BY 1)")
def group_scores(spark, d):
    found = table(spark, d, "customer").select(F.col("c_custkey").alias("unit"), F.col("c_nationkey").alias("group"))
    t = table(spark, d, "orders").where("o_totalprice > 350000").select(F.col("o_custkey").alias("unit"))
    return families.group_scores(t, found).select("groups", "hit", F.round("purity", 8).alias("purity"))


@R.add("SELECT l.s_suppkey IS NOT NULL AS is_true, count(*)::BIGINT AS units, round(avg(s.s_acctbal / 10000), 8) AS mean_presence FROM supplier s LEFT JOIN (SELECT DISTINCT l_suppkey AS s_suppkey FROM lineitem WHERE l_quantity = 50 AND l_discount >= 0.1) l USING (s_suppkey) GROUP BY 1")
def presence_scores(spark, d):
    found = table(spark, d, "supplier").select(F.col("s_suppkey").alias("unit"), (F.col("s_acctbal") / 10000).alias("present_prob"))
    t = table(spark, d, "lineitem").where("l_quantity = 50 and l_discount >= 0.1").select(F.col("l_suppkey").alias("unit"))
    out = families.presence_scores(found, t)
    return out.select(F.col("true").alias("is_true"), "units", F.round("mean_presence", 8).alias("mean_presence"))


@R.add()
def centroids(spark, d):
    held = cut(_words(spark, d, 4))
    labels = tree.overlap_components(held)
    sizes = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.length("text").cast("long").alias("length"))
    rows = held.join(labels, held["set_id"] == labels["node"]).select("component", F.col("set_id").alias("id"), "hash")
    return families.centroids(rows, sizes, 0.2)


@R.add()
def kmer_surprisal(spark, d):
    b = table(spark, d, "benchmark").select("item_id", F.col("text").alias("sequence"))
    return families.surprisal(b, KmerParams(4), ["item_id"], dict.fromkeys("ACDEFGHIKLMNPQRSTVWY", 0.05)).groupBy("item_id").agg(F.count(F.lit(1)).alias("n"), F.min("bits").alias("least"))


@R.add()
def pair_survival(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.concat_ws("/", "source", "lang").alias("cluster"), F.col("text").alias("sequence"))
    pairs = docs.select("id", "cluster", F.lit(1.0).alias("identity"))
    return families.pair_survival(pairs, docs, KmerParams(5))
