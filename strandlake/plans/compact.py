"""Queries over a compact index; documents stand for members, five in a row for a unit, and benchmark passages for reads.

Texts are read as residues; characters beyond printable ASCII break a word, as other letters do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kmers import KmerParams, target_kmers
from ..lineage import cut
from ..operators import compact
from .sequences import LETTERS, code_sql, hash_sql, valid_sql
from .tables import Registry, table

R = Registry()
P, WINDOW, RATE, SHARDS = KmerParams(4), 16, 8.0, 4
K = P.k


def _residues(text: str = "text"):
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[^ -~]", "X")


def _rank_sql(word: str) -> str:
    return " + ".join(f"(strpos('{LETTERS}', substr({word}, {i + 1}, 1)) - 1) * {20 ** (K - 1 - i)}" for i in range(K))


def _words_sql(source: str, key: str, text: str) -> str:
    return f"""SELECT {key}, i, upper(w) AS w FROM (SELECT {key}, i, substr({text}, i + 1, {K}) AS w FROM (SELECT *, unnest(range(0, greatest(length({text}) - {K - 1}, 0))) AS i FROM {source})) WHERE {valid_sql(LETTERS, 'w', K)}"""


#: Even units bear the name of their first member, odd ones no member's.
_UNIT = "CASE WHEN doc_id // 5 % 2 = 0 THEN doc_id // 5 * 5 ELSE -(doc_id // 5) END"
_KEYS = f"""WITH member AS (SELECT {_UNIT} AS unit, doc_id AS id, regexp_replace(coalesce(text, ''), '[^ -~]', 'X', 'g') AS s FROM documents),
rep AS (SELECT unit, arg_min(s, ((id <> unit)::INT, -length(s), id)) AS s, count(*)::BIGINT AS members FROM member GROUP BY unit),
place AS ({_words_sql('rep', 'unit', 's')}), word AS (SELECT DISTINCT w FROM place), coded AS (SELECT w, {hash_sql(code_sql(K))} AS h, ({_rank_sql('w')})::BIGINT AS code FROM word),
holders AS (SELECT w, count(DISTINCT unit) AS c FROM place GROUP BY w),
ranked AS (SELECT w, h, code, row_number() OVER (ORDER BY c, h) AS r FROM holders JOIN coded USING (w)),
start AS (SELECT unit, unnest(range(0, greatest(length(s) - {K + WINDOW - 2}, 1))) AS i FROM rep WHERE length(s) >= {K}),
least_ AS (SELECT unit, first, min(r) OVER (PARTITION BY unit ORDER BY i RANGE BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING) AS r
  FROM (SELECT unit, i, r, false AS first FROM place JOIN ranked USING (w) UNION ALL SELECT unit, i, NULL, true FROM start)),
keys AS (SELECT DISTINCT unit, r FROM least_ WHERE first AND r IS NOT NULL),
sized AS (SELECT unit, count(*)::BIGINT AS n, sqrt(any_value(members)) AS w FROM keys JOIN rep USING (unit) GROUP BY unit),
mean AS (SELECT avg(greatest(length(s) - {K - 1}, 1)) / {RATE} AS mean FROM rep),
ordered AS (SELECT *, n / w AS f, mean * count(*) OVER () AS budget, coalesce(sum(n) OVER before, 0) AS sn, sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS sw
  FROM sized, mean WINDOW before AS (ORDER BY n / w, unit ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT arg_min((budget - sn) / sw, f) AS level FROM ordered WHERE (budget - sn) / sw < f),
bound AS (SELECT unit, least(n, floor(w * coalesce(level, 1e15) + 0.5))::BIGINT AS k FROM sized, level),
kept AS (SELECT unit, code, w FROM (SELECT unit, code, w, k, row_number() OVER (PARTITION BY unit ORDER BY h) AS p FROM keys JOIN ranked USING (r) JOIN bound USING (unit)) WHERE p <= k),
letter AS (SELECT l, -log2((sum(length(s) - length(replace(replace(s, l, ''), lower(l), ''))) + 1e-9) / (sum(length(s)) + 20 * 1e-9)) AS b FROM rep, (SELECT unnest(string_split('{LETTERS}', '')) AS l) GROUP BY l),
bits AS (SELECT w, sum(b) AS bits0 FROM (SELECT DISTINCT w, i, substr(w, i, 1) AS l FROM kept, (SELECT unnest(range(1, {K + 1})) AS i)) JOIN letter USING (l) GROUP BY w)
"""
_MERGED = _KEYS + f""", grouped AS (SELECT CASE WHEN unit >= 0 THEN unit // 5 ELSE -unit END AS g, code, w FROM kept),
size AS (SELECT g % {SHARDS} AS shard, count(*) AS n FROM (SELECT DISTINCT doc_id // 5 AS g FROM documents) GROUP BY 1),
base AS (SELECT shard, coalesce(sum(n) OVER (ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM size),
posting AS (SELECT code, (g // {SHARDS} + base)::BIGINT AS unit, least(greatest(round_even((bits0 - log2(count(*) OVER (PARTITION BY code))) / 0.25, 0), 0), 255) * 0.25 AS bits FROM grouped JOIN bits USING (w) JOIN base ON shard = g % {SHARDS})
"""


@R.add(f"""WITH text AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[^ -~]', 'X', 'g') AS s FROM documents)
SELECT doc_id, count(*)::BIGINT AS n, sum(code)::BIGINT AS total, max(code)::BIGINT AS most FROM (SELECT doc_id, {_rank_sql('w')} AS code FROM ({_words_sql('text', 'doc_id', 's')})) GROUP BY doc_id""")
def compact_codes(spark, d):
    """Hashed k-mers of every document turned back into the ranks of their letters."""
    kmers = target_kmers(table(spark, d, "documents").select("doc_id", _residues().alias("sequence")), P, ["doc_id"])
    coded = kmers.select("doc_id", compact.code_of("hash", P).alias("code"))
    return coded.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("code").alias("total"), F.max("code").alias("most"))


def _merged(spark, d) -> DataFrame:
    group = F.call_function("div", F.col("doc_id"), F.lit(5))
    docs = table(spark, d, "documents")
    members = docs.select(F.when(group % 2 == 0, group * 5).otherwise(-group).alias("unit"), F.col("doc_id").alias("id"), _residues().alias("sequence"))
    keys = compact.compact_keys(members, P, WINDOW, RATE, F.lit(0.5))
    own = F.when(F.col("unit") >= 0, F.call_function("div", F.col("unit"), F.lit(5))).otherwise(-F.col("unit"))
    parts = keys.select((own % SHARDS).alias("shard"), F.call_function("div", own, F.lit(SHARDS)).alias("unit"), "code", "bits0")
    sizes = docs.select(group.alias("g")).distinct().groupBy((F.col("g") % SHARDS).alias("shard")).agg(F.count(F.lit(1)).alias("units"))
    return compact.merge_shards(cut(parts), sizes)


@R.add(_MERGED + "SELECT unit, count(*)::BIGINT AS n, sum(code)::BIGINT AS codes, sum(bits) AS bits FROM posting GROUP BY unit")
def compact_postings(spark, d):
    """The keys of each unit's representative, the rarest of each window, thinned by the root of members, merged over shards."""
    return _merged(spark, d).groupBy("unit").agg(F.count(F.lit(1)).alias("n"), F.sum("code").alias("codes"), F.sum("bits").alias("bits"))


@R.add(_MERGED + f""", passage AS (SELECT item_id AS read, regexp_replace(coalesce(text, ''), '[^ -~]', 'X', 'g') AS s FROM benchmark),
hit AS (SELECT read, {_rank_sql('w')} AS code FROM ({_words_sql('passage', 'read', 's')})), charge AS (SELECT log2(greatest(count(*) / count(DISTINCT read), 2)) AS charge FROM hit)
SELECT read, unit, count(*)::BIGINT AS hits, round(sum(bits) - (count(*) - 1) * any_value(charge), 6) AS score FROM (SELECT DISTINCT read, code FROM hit) JOIN posting USING (code), charge GROUP BY read, unit""")
def compact_evidence(spark, d):
    """Bits of every passage on every unit that its k-mers hit."""
    reads = target_kmers(table(spark, d, "benchmark").select(F.col("item_id").alias("read"), _residues().alias("sequence")), P, ["read"])
    found = compact.unit_evidence_bits(reads.select("read", compact.code_of("hash", P).alias("code")), _merged(spark, d))
    return found.select("read", "unit", "hits", F.round("score", 6).alias("score"))
