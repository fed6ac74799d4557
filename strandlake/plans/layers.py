"""Queries over the upper layers of a tree index; documents stand for sequences and their words of six letters and more for k-mers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import cut
from ..operators import layers
from .tables import Registry, table

R = Registry()

_HELD = """WITH word AS (SELECT DISTINCT doc_id AS id, source || '/' || lang AS g, unnest(regexp_extract_all(text, '[A-Za-z]{6,}')) AS w FROM documents),
held AS (SELECT id, g, ('0x' || substr(md5(w), 1, 15))::BIGINT AS hash FROM word)
"""


def _held(spark, d) -> DataFrame:
    """``id, group, hash``, with 60 bits of a hash that SQL has as well."""
    words = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.concat_ws("/", "source", "lang").alias("group"), F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{6,}"), F.lit(0))).alias("w"))
    return cut(words.distinct().select("id", "group", F.conv(F.substring(F.md5("w"), 1, 15), 16, 10).cast("long").alias("hash")))


@R.add("""WITH RECURSIVE word AS (SELECT DISTINCT doc_id AS id, unnest(regexp_extract_all(text, '[A-Za-z]{6,}')) AS w FROM documents),
few AS (SELECT w FROM word GROUP BY w HAVING count(*) <= 64), held AS (SELECT id, w FROM word JOIN few USING (w)), size AS (SELECT id, count(*) AS n FROM held GROUP BY id),
pair AS (SELECT a.id AS a, b.id AS b, count(*) AS shared FROM held a JOIN held b ON a.w = b.w AND a.id < b.id GROUP BY ALL),
link AS (SELECT a, b FROM pair JOIN size x ON x.id = a JOIN size y ON y.id = b WHERE shared >= 0.3 * least(x.n, y.n)),
node AS (SELECT doc_id AS id, length(text) AS l, row_number() OVER (ORDER BY length(text) DESC, doc_id) AS r FROM documents),
near AS (SELECT id, list(other) AS others FROM (SELECT a AS id, b AS other FROM link UNION ALL SELECT b, a FROM link) GROUP BY id),
walk AS (SELECT 0::BIGINT AS r, []::BIGINT[] AS centres UNION ALL
  SELECT n.r, CASE WHEN e.others IS NOT NULL AND list_has_any(w.centres, e.others) THEN w.centres ELSE list_append(w.centres, n.id) END FROM walk w JOIN node n ON n.r = w.r + 1 LEFT JOIN near e ON e.id = n.id),
centre AS (SELECT unnest(centres) AS id FROM (SELECT centres FROM walk ORDER BY r DESC LIMIT 1))
SELECT n.id::BIGINT AS id, CASE WHEN n.id IN (SELECT id FROM centre) THEN n.id ELSE f.centre END::BIGINT AS centre FROM node n
LEFT JOIN (SELECT x.id, arg_min(o.id, o.r) AS centre FROM (SELECT id, unnest(others) AS other FROM near) x JOIN centre c ON c.id = x.other JOIN node o ON o.id = x.other GROUP BY x.id) f ON f.id = n.id""")
def greedy_centres(spark, d):
    """Every document's centre at three tenths of the lesser one's words."""
    lengths = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.length("text").alias("length"))
    return layers.greedy_centres(layers.share_links(_held(spark, d), 0.3), lengths)


@R.add(_HELD + """, counted AS (SELECT *, count(*) OVER (PARTITION BY g, hash) AS c FROM held),
score AS (SELECT g, id, sum(c)::DOUBLE AS medoid, avg(c) AS central, count(*)::DOUBLE AS longest FROM counted GROUP BY ALL),
rep AS (SELECT g, 'medoid' AS pick, arg_min(id, (-medoid, id)) AS rep FROM score GROUP BY g UNION ALL SELECT g, 'central', arg_min(id, (-central, id)) FROM score GROUP BY g UNION ALL SELECT g, 'longest', arg_min(id, (-longest, id)) FROM score GROUP BY g),
own AS (SELECT r.g, r.pick, r.rep, h.hash FROM rep r JOIN held h ON h.id = r.rep AND h.g = r.g),
size AS (SELECT source || '/' || lang AS g, count(*) AS m FROM documents GROUP BY 1),
half AS (SELECT DISTINCT c.g, 'composite' AS pick, r.rep, c.hash FROM counted c JOIN size s ON s.g = c.g JOIN rep r ON r.g = c.g AND r.pick = 'medoid' WHERE c.c >= 0.5 * s.m)
SELECT g AS "group", pick, rep::BIGINT AS rep, count(*)::BIGINT AS n, min(hash) AS least, max(hash) AS most FROM (SELECT * FROM own UNION ALL SELECT * FROM half) GROUP BY ALL""")
def representative_keys(spark, d):
    """Keys on the representatives of sources and languages, by each way to pick one, and those that half of the members hold."""
    held = _held(spark, d)
    groups = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.concat_ws("/", "source", "lang").alias("group"))
    found = layers.keys_by_picks(held, groups, ["medoid", "central", "longest"], 0.5)
    return found.groupBy("group", "pick", "rep").agg(F.count(F.lit(1)).alias("n"), F.min("hash").alias("least"), F.max("hash").alias("most"))


@R.add(_HELD + """, keys AS (SELECT DISTINCT g, hash FROM held), size AS (SELECT source || '/' || lang AS g, count(*)::DOUBLE AS m FROM documents GROUP BY 1),
unit AS (SELECT g, count(*)::BIGINT AS n FROM keys GROUP BY g),
ruled AS (SELECT u.g, n, rule, CASE rule WHEN 'uniform' THEN n::DOUBLE WHEN 'fixed' THEN 1 WHEN 'log' THEN 1 + ln(m) ELSE sqrt(m) END AS w FROM unit u JOIN size USING (g), (SELECT unnest(['uniform', 'fixed', 'log', 'sqrt']) AS rule)),
ordered AS (SELECT *, n / w AS r, 1500.0 * count(*) OVER all_of AS budget, coalesce(sum(n) OVER before, 0) AS sn, sum(w) OVER all_of - coalesce(sum(w) OVER before, 0) AS sw
  FROM ruled WINDOW all_of AS (PARTITION BY rule), before AS (PARTITION BY rule ORDER BY n / w, g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT rule, arg_min((budget - sn) / sw, r) AS level FROM ordered WHERE (budget - sn) / sw < r GROUP BY rule),
bound AS (SELECT o.rule, o.g, o.n, least(o.n, floor(o.w * coalesce(l.level, 1e15) + 0.5))::BIGINT AS k FROM ordered o LEFT JOIN level l USING (rule)),
kept AS (SELECT b.rule, b.g, b.n, b.k, hash, row_number() OVER (PARTITION BY b.rule, b.g ORDER BY hash) AS r FROM bound b JOIN keys USING (g))
SELECT rule, g AS unit, n, k, max(hash) AS most FROM kept WHERE r <= k GROUP BY ALL""")
def key_budgets(spark, d):
    """Keys of sources and languages thinned to 1500 on average, by each rule."""
    keys = cut(_held(spark, d).select(F.col("group").alias("unit"), "hash").distinct())
    members = table(spark, d, "documents").groupBy(F.concat_ws("/", "source", "lang").alias("unit")).agg(F.count(F.lit(1)).alias("members"))
    made = []
    for rule in ("uniform", "fixed", "log", "sqrt"):
        budgets = cut(layers.unit_budgets(keys, members, rule, 1500, F.lit(0.5)))
        kept = layers.least_keys(keys, budgets).groupBy("unit").agg(F.max("hash").alias("most"))
        made.append(budgets.join(kept, "unit").select(F.lit(rule).alias("rule"), "unit", "n", "k", "most"))
    return reduce(DataFrame.unionByName, made)
