"""Queries over a spanning forest of documents, each below the one of a third of its number."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import cut
from ..operators import spanning
from .tables import Registry, table

R = Registry()

_FOREST = """WITH RECURSIVE doc AS (SELECT doc_id AS id, max(coalesce(length(text), 0)) % 97 AS weight FROM documents WHERE doc_id IS NOT NULL GROUP BY 1),
edge AS (SELECT a.id, a.weight, b.id AS parent FROM doc a LEFT JOIN doc b ON b.id = a.id // 3 AND a.id > 0),
walk AS (SELECT id, parent, [0::BIGINT, id] AS path FROM edge WHERE parent IS NULL UNION ALL SELECT e.id, e.parent, list_concat(w.path, [e.weight, e.id]) FROM walk w JOIN edge e ON e.parent = w.id),
ranked AS (SELECT *, row_number() OVER (ORDER BY path) - 1 AS pos FROM walk),
above AS (SELECT id, id AS up FROM edge UNION ALL SELECT a.id, e.parent FROM above a JOIN edge e ON e.id = a.up WHERE e.parent IS NOT NULL),
laid AS (SELECT r.id, r.parent, e.weight, r.pos, r.pos + s.n AS hi FROM ranked r JOIN edge e USING (id) JOIN (SELECT up AS id, count(*) AS n FROM above GROUP BY 1) s USING (id)),
node AS (SELECT pos AS lo, pos + 1 AS hi, -1 AS level FROM laid UNION ALL SELECT p.pos, c.hi, c.weight FROM laid c JOIN laid p ON p.id = c.parent)"""


def _forest(spark, d) -> DataFrame:
    docs = cut(table(spark, d, "documents").where("doc_id is not null").groupBy(F.col("doc_id").alias("b")).agg((F.max(F.coalesce(F.length("text"), F.lit(0))) % 97).cast("long").alias("weight")))
    edges = cut(docs.where("b > 0").withColumn("a", F.expr("b div 3")).join(docs.select(F.col("b").alias("a")), "a"))
    return spanning.rooted(edges, docs.select(F.col("b").alias("node")).join(edges.select(F.col("b").alias("node")), "node", "left_anti"))


@R.add(_FOREST + "SELECT id AS node, coalesce(parent, -1)::BIGINT AS parent, pos::BIGINT AS pos, hi::BIGINT AS hi FROM laid")
def rooted_forest(spark, d):
    """Every document's place and subtree; -1 above a root."""
    return _forest(spark, d).select("node", F.coalesce("parent", F.lit(-1)).alias("parent"), "pos", "hi")


@R.add(_FOREST + """SELECT n.lo::BIGINT AS lo, n.hi::BIGINT AS hi, coalesce(arg_min(u.lo, u.hi - u.lo), -1)::BIGINT AS up_lo, coalesce(arg_min(u.hi, u.hi - u.lo), -1)::BIGINT AS up_hi, any_value(n.level)::BIGINT AS level
FROM node n LEFT JOIN node u ON u.lo <= n.lo AND n.hi <= u.hi AND u.hi - u.lo > n.hi - n.lo GROUP BY n.lo, n.hi""")
def spanning_tree_ranges(spark, d):
    """The forest as binary trees; -1 above a top and at the level of leaves."""
    return spanning.spanning_ranges(_forest(spark, d)).fillna(-1, ["up_lo", "up_hi", "level"])


_HASH = "('0x' || substr(md5(w), 1, 12))::BIGINT"


@R.add(_FOREST + f""", held AS (SELECT DISTINCT pos, {_HASH} AS hash FROM laid JOIN (SELECT doc_id AS id, unnest(regexp_extract_all(text, '[A-Za-z]{{4,}} [A-Za-z]{{4,}}')) AS w FROM documents) USING (id)),
kmer AS (SELECT pos, hash, hash / 281474976710656.0::DOUBLE AS u FROM held WHERE hash / 281474976710656.0::DOUBLE > 0),
counted AS (SELECT lo, hi, hash, u, count(*) AS c FROM node JOIN kmer ON pos >= lo AND pos < hi GROUP BY ALL),
bound AS (SELECT lo, hi, least(1::DOUBLE, 20::DOUBLE / greatest(count(*), 1)) AS t FROM counted GROUP BY ALL),
best AS (SELECT lo, hi, c, row_number() OVER (PARTITION BY lo, hi ORDER BY c DESC, hash) AS r FROM counted JOIN bound USING (lo, hi) WHERE u <= t),
judged AS (SELECT n.lo, n.hi, coalesce(sum(b.c)::DOUBLE / count(b.c) / (n.hi - n.lo), 1) AS coherence, count(b.c) AS keys FROM node n LEFT JOIN best b ON b.lo = n.lo AND b.hi = n.hi AND r <= 20 GROUP BY n.lo, n.hi)
SELECT j.lo::BIGINT AS lo, j.hi::BIGINT AS hi, round(coherence, 9) AS coherence, keys::BIGINT AS keys FROM judged j WHERE (coherence >= 0.1 OR j.hi - j.lo = 1)
AND NOT EXISTS (SELECT 1 FROM judged a WHERE a.lo <= j.lo AND j.hi <= a.hi AND a.hi - a.lo > j.hi - j.lo AND NOT (a.coherence < 0.1 AND a.hi - a.lo > 1))""")
def coherent_pieces(spark, d):
    """The forest cut into subtrees whose documents share pairs of words: a tenth of them have, on average, each of the twenty that most have, of a sample by hash."""
    placed = _forest(spark, d)
    words = table(spark, d, "documents").select(F.col("doc_id").alias("node"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z]{4,} [A-Za-z]{4,}"), F.lit(0)))).alias("w"))
    hashed = words.select("node", F.conv(F.substring(F.md5("w"), 1, 12), 16, 10).cast("long").alias("hash"))
    held = hashed.join(placed.select("node", "pos"), "node").select("pos", "hash", (F.col("hash") / F.lit(float(1 << 48))).alias("u"))
    return spanning.coherent_pieces(spanning.spanning_ranges(placed), held, 20, 0.1).withColumn("coherence", F.round("coherence", 9))
