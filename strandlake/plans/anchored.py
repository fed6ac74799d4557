"""Queries of routing by columns; vectors stand for sequences of a family, their label, and components in five grades for residues."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..lineage import cut
from ..operators import anchored
from .tables import Registry, table

R = Registry()
WIDTH, ANCHORS, KEEP, SHARE, NEAR = 5, 10, 0.2, 0.6, 0.02

#: Members are whole vectors, three in a row a unit; a read is two stretches of a vector, in which every ninth component or so moves by a grade.
_ROWS = f"""WITH cell AS (SELECT vec_id, label, col, CASE WHEN x IS NULL THEN '-' WHEN x < -0.12::DOUBLE THEN 'A' WHEN x < -0.04::DOUBLE THEN 'C' WHEN x < 0.04::DOUBLE THEN 'D' WHEN x < 0.12::DOUBLE THEN 'E' ELSE 'F' END AS letter
  FROM (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS col FROM embeddings)),
member AS (SELECT label AS family, vec_id // 3 AS unit, vec_id AS row_, string_agg(letter, '' ORDER BY col) AS s FROM cell GROUP BY vec_id, label),
moved AS (SELECT vec_id, col, (vec_id * 7) % 28 AS low, CASE WHEN (vec_id * 31 + col * 17) % 9 = 0 THEN translate(letter, 'ACDEF', 'CDEFA') ELSE letter END AS letter FROM cell),
part AS (SELECT vec_id AS read, 0 AS h, col, CASE WHEN col >= low AND col < low + 20 THEN letter ELSE '-' END AS letter FROM moved UNION ALL SELECT vec_id, 1, col, CASE WHEN col >= low + 15 AND col < low + 36 THEN letter ELSE '-' END FROM moved),
spelt AS (SELECT read, h, string_agg(letter, '' ORDER BY col) AS s FROM part GROUP BY read, h),
own AS (SELECT DISTINCT family, unit, c, substr(s, c + 1, {WIDTH}) AS w FROM (SELECT *, unnest(range(0, length(s) - {WIDTH - 1})) AS c FROM member) WHERE NOT contains(substr(s, c + 1, {WIDTH}), '-')),
asked AS (SELECT DISTINCT read, c, substr(s, c + 1, {WIDTH}) AS w FROM (SELECT *, unnest(range(0, length(s) - {WIDTH - 1})) AS c FROM spelt) WHERE NOT contains(substr(s, c + 1, {WIDTH}), '-')),
shared AS (SELECT read, family, max(n) AS seeds FROM (SELECT read, family, unit, count(*)::BIGINT AS n FROM asked JOIN own USING (c, w) WHERE family IS NOT NULL GROUP BY ALL) GROUP BY ALL),
seeded AS (SELECT * FROM shared QUALIFY seeds = max(seeds) OVER (PARTITION BY read))
"""


def _members_and_reads(spark, d):
    vectors = table(spark, d, "embeddings").where("embedding is not null")
    grade = lambda x: F.when(x.isNull(), "-").when(x < -0.12, "A").when(x < -0.04, "C").when(x < 0.04, "D").when(x < 0.12, "E").otherwise("F")
    rows = vectors.select("vec_id", "label", F.transform("embedding", lambda x: grade(x.cast("double"))).alias("s"))
    members = rows.select(F.col("label").alias("family"), F.call_function("div", F.col("vec_id"), F.lit(3)).alias("unit"), F.col("vec_id").alias("row"), F.array_join("s", "").alias("residues"))
    at = F.col("vec_id") * 7 % 28

    def stretch(first, n):
        cell = lambda x, i: F.when((i < at + first) | (i >= at + first + n), "-").when((F.col("vec_id") * 31 + i * 17) % 9 == 0, F.translate(x, "ACDEF", "CDEFA")).otherwise(x)
        return F.array_join(F.transform("s", cell), "")

    return cut(members), cut(rows.select(F.col("vec_id").alias("read"), F.explode(F.array(stretch(0, 20), stretch(15, 21))).alias("residues")))


@R.add(_ROWS + "SELECT read, family, seeds FROM seeded")
def seeded_families(spark, d):
    """The families that share most seeds of five columns with each read."""
    members, reads = _members_and_reads(spark, d)
    return anchored.seeded_families(reads.where("read is not null"), members.where("family is not null"), WIDTH)


@R.add(_ROWS + f""", hit AS (SELECT read, family, h, s, length(replace(s, '-', '')) AS n FROM spelt JOIN seeded USING (read)),
place AS (SELECT family, unit, row_, unnest(range(length(s))) AS col, unnest(string_split(s, '')) AS letter FROM member),
first_ AS (SELECT family, unit, min(row_) AS row_ FROM member GROUP BY ALL),
seen AS (SELECT family, col, letter, count(*) AS c FROM place JOIN first_ USING (family, unit, row_) WHERE letter <> '-' GROUP BY ALL),
entropy AS (SELECT family, col, round(log2(sum(c) + 2) - (sum((c + 0.1::DOUBLE) * log2(c + 0.1::DOUBLE)) + (20 - count(*)) * 0.1::DOUBLE * log2(0.1::DOUBLE)) / (sum(c) + 2), 6) AS e FROM seen GROUP BY ALL),
held AS (SELECT read, family, h, unnest(range(length(s))) AS col, unnest(string_split(s, '')) AS letter FROM hit),
anchor AS (SELECT read, family, col, letter FROM (SELECT read, family, col, max(letter) AS letter FROM held WHERE letter <> '-' GROUP BY ALL) JOIN entropy USING (family, col) QUALIFY row_number() OVER (PARTITION BY read, family ORDER BY e DESC, col) <= {ANCHORS}),
agreed AS (SELECT read, family, unit, max(c) AS c FROM (SELECT read, family, unit, row_, count(*) AS c FROM anchor JOIN place USING (family, col, letter) GROUP BY ALL) GROUP BY ALL),
every_ AS (SELECT read, family, unit, coalesce(c, 0) AS c FROM (SELECT DISTINCT read, family FROM anchor) JOIN first_ USING (family) LEFT JOIN agreed USING (read, family, unit)),
placed AS (SELECT *, row_number() OVER (PARTITION BY read, family ORDER BY c DESC) AS r, greatest(ceil({KEEP}::DOUBLE * count(*) OVER (PARTITION BY read, family)), 1) AS k FROM every_),
candidate AS (SELECT read, family, unit, count(*) OVER (PARTITION BY read, family) AS candidates FROM placed p JOIN (SELECT read, family, c AS bar FROM placed WHERE r = k) USING (read, family) WHERE c >= bar),
met AS (SELECT c.read, c.family, c.unit, t.h, p.row_, count(*) FILTER (WHERE p.letter <> '-') AS s, count(*) FILTER (WHERE p.letter = t.letter) AS m FROM candidate c JOIN held t ON t.read = c.read AND t.family = c.family AND t.letter <> '-' JOIN place p ON p.family = c.family AND p.unit = c.unit AND p.col = t.col GROUP BY ALL),
ok AS (SELECT met.* FROM met JOIN hit USING (read, family, h) WHERE met.s >= {SHARE}::DOUBLE * n),
best AS (SELECT read, family, unit, sum(b.m)::BIGINT AS matches, sum(b.s)::BIGINT AS shared FROM (SELECT read, family, unit, h, max({{'m': m, 's': s}}) AS b FROM ok GROUP BY ALL) GROUP BY ALL),
won AS (SELECT read, family, unit, arg_min(row_, (-m, row_)) AS row_ FROM (SELECT read, family, unit, row_, sum(m) AS m FROM ok GROUP BY ALL) GROUP BY ALL),
rated AS (SELECT *, matches / columns_ AS identity FROM best JOIN won USING (read, family, unit) JOIN (SELECT read, family, sum(n)::BIGINT AS columns_ FROM hit GROUP BY ALL) USING (read, family) WHERE shared > 0 AND shared >= {SHARE}::DOUBLE * columns_),
top AS (SELECT read, arg_min(family, (-i, family)) AS family, max(i) AS i FROM (SELECT read, family, max(identity) AS i FROM rated GROUP BY ALL) GROUP BY read)
SELECT read, family, unit, identity = i AS called, row_ AS "row", matches, columns_ AS columns, round(identity, 8) AS identity, candidates::BIGINT AS candidates
FROM rated JOIN top USING (read, family) JOIN (SELECT DISTINCT read, family, candidates FROM candidate) USING (read, family) WHERE identity >= i - {NEAR}::DOUBLE""")
def anchored_calls(spark, d):
    """Every read's units: families by seeds, candidates by ten informative columns, calls by identity."""
    members, reads = _members_and_reads(spark, d)
    members = members.where("family is not null")
    families = anchored.seeded_families(reads.where("read is not null"), members, WIDTH)
    calls = anchored.route_calls(reads.join(families.select("read", "family"), "read"), members, ANCHORS, KEEP, SHARE, NEAR)
    return calls.drop("strength").withColumn("identity", F.round("identity", 8))
