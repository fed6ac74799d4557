"""K-mers, the index build and lookups, with documents as targets and benchmark passages as reads.

Texts are read as residues: letters of the alphabet in either case count, everything else breaks a word. A unit is a
source and language, a member a document.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.alphabets import alphabet
from ..functions.kmers import KmerParams, base_counts, bound, read_kmers, target_kmers
from ..functions.sequences import mask_adapters, mask_quality_column, reverse_complement_column, translate_column
from ..lineage import checkpoint_folder, cut
from ..operators import assign, index_build, lookup
from ..operators.index_build import IndexParams, KmerIndex
from .tables import Registry, table

R = Registry()
P = IndexParams(k=6, t_base=0.05, n_min=20, t_cap=0.4, max_groups=12, mask_adapters=False, t_dense=0.1)
LETTERS = "".join(alphabet("protein").classes)


def valid_sql(letters: str, word: str, k: int) -> str:
    return f"regexp_full_match({word}, '[{letters}{letters.lower()}]{{{k}}}')"


def words_sql(source: str, keys: str, text: str, k: int, letters: str = LETTERS) -> str:
    """All windows of ``k`` letters of the alphabet, in upper case: ``keys, w``."""
    return f"""SELECT {keys}, upper(w) AS w FROM (SELECT {keys}, substr({text}, i + 1, {k}) AS w FROM (SELECT *, unnest(range(0, greatest(length({text}) - {k - 1}, 0))) AS i FROM {source})) WHERE {valid_sql(letters, 'w', k)}"""


def code_sql(k: int, name: str = "protein", word: str = "w") -> str:
    a = alphabet(name)
    classes = "".join(chr(65 + i) * len(c) for i, c in enumerate(a.classes))
    letters = "".join(chr(65 + i) for i in range(len(a.classes)))
    spoken = f"translate({word}, '{a.letters()}', '{classes}')"
    return " + ".join(f"(strpos('{letters}', substr({spoken}, {i + 1}, 1)) - 1)::UHUGEINT * {1 << (a.bits * (k - 1 - i))}" for i in range(k))


def hash_sql(code: str) -> str:
    """The unsigned hash of a packed word."""
    m = "18446744073709551616::UHUGEINT"
    z1 = f"(({code} + 11400714819323198485::UHUGEINT) % {m})"
    z2 = f"list_transform([{z1}], lambda z: (xor(z, z >> 30) * 13787848793156543929::UHUGEINT) % {m})"
    z3 = f"list_transform({z2}, lambda z: (xor(z, z >> 27) * 10723151780598845931::UHUGEINT) % {m})"
    return f"list_transform({z3}, lambda z: xor(z, z >> 31))[1]"


def signed_sql(h: str) -> str:
    return f"(CASE WHEN {h} >= 9223372036854775808::UHUGEINT THEN ({h}::HUGEINT - 18446744073709551616::HUGEINT) ELSE {h}::HUGEINT END)::BIGINT"


def targets(spark, d) -> DataFrame:
    return table(spark, d, "documents").select(F.concat_ws("/", "source", "lang").alias("unit_key"), F.col("doc_id").alias("member_id"), (F.col("n_chars") >= 1000).alias("full_length"), F.col("text").alias("sequence"))


def reads(spark, d) -> DataFrame:
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("read"), F.col("text").alias("sequence"))
    return target_kmers(b, P.kmers(), ["read"])


@R.add(f"WITH w AS ({words_sql('documents', 'doc_id', 'text', 3)}) SELECT doc_id, count(*)::BIGINT AS n, count(DISTINCT w)::BIGINT AS n_distinct FROM w GROUP BY doc_id")
def kmer_windows_k3(spark, d):
    rows = target_kmers(table(spark, d, "documents"), KmerParams(3), ["doc_id"], "text")
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("hash").alias("n_distinct"))


def _reduced(name: str, k: int):
    sql = f"WITH w AS ({words_sql('benchmark', 'item_id', 'text', k, alphabet(name).letters())}), c AS (SELECT item_id, {code_sql(k, name)} AS c FROM w) SELECT item_id, count(*)::BIGINT AS n, count(DISTINCT c)::BIGINT AS n_distinct, min({signed_sql('h')}) AS least FROM (SELECT item_id, c, {hash_sql('c')} AS h FROM c) GROUP BY item_id"

    @R.add(sql, f"kmer_{name}")
    def query(spark, d):
        rows = target_kmers(table(spark, d, "benchmark"), KmerParams(k, name), ["item_id"], "text")
        return rows.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("hash").alias("n_distinct"), F.min("hash").alias("least"))

    return query


for _name, _k in (("protein", 7), ("murphy10", 5), ("dayhoff", 6), ("murphy8", 5), ("murphy12", 5), ("murphy15", 5), ("diamond11", 5), ("seb6", 6), ("seb8", 6), ("seb10", 5), ("seb14", 5), ("sev10", 5), ("lia10", 5), ("lib10", 5), ("opt4", 8), ("opt6", 6), ("opt8", 6), ("opt10", 5), ("opt12", 5), ("opt14", 5)):
    _reduced(_name, _k)


@R.add(f"WITH w AS ({words_sql('documents', 'doc_id', 'text', 6)}), c AS (SELECT w, {code_sql(6)} AS c FROM (SELECT DISTINCT w FROM w)), s AS (SELECT w, {hash_sql('c')} AS h FROM c), k AS (SELECT w, {signed_sql('h')} AS hash FROM s WHERE h <= {bound(0.1)}::UHUGEINT) SELECT doc_id, count(*)::BIGINT AS n, count(DISTINCT hash)::BIGINT AS n_distinct, min(hash) AS least FROM w JOIN k USING (w) GROUP BY doc_id")
def kmer_hash_sample(spark, d):
    rows = target_kmers(table(spark, d, "documents"), P.kmers(0.1), ["doc_id"], "text")
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("hash").alias("n_distinct"), F.min("hash").alias("least"))


_DNA_LETTERS = "ACGTU"
_BACK = "reverse(translate(replace(w, 'U', 'T'), 'ACGT', 'TGCA'))"


@R.add(f"WITH w AS ({words_sql('pages', 'page_id', 'html', 3, _DNA_LETTERS)}) SELECT page_id, count(*)::BIGINT AS n, count(DISTINCT least(replace(w, 'U', 'T'), {_BACK}))::BIGINT AS n_canonical FROM w GROUP BY page_id")
def kmer_canonical_dna(spark, d):
    rows = target_kmers(table(spark, d, "pages"), KmerParams(3, "dna"), ["page_id"], "html")
    return rows.groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("hash").alias("n_canonical"))


#: Nucleotides made of a text: one codon per letter, so that translating gives the letters back.
_CODON = "translate(lower(substr(text, 1, 300)), 'abcdefghijklmnopqrstuvwxyz ', 'acgtacgtacgtacgtacgtacgtacg')"


def _as_dna(text):
    return F.translate(F.lower(text), "abcdefghijklmnopqrstuvwxyz ", "acgtacgtacgtacgtacgtacgtacg")


@R.add("SELECT item_id, reverse(regexp_replace(translate(upper(t), 'ACGTU', 'TGCAA'), '[^ACGT]', 'N', 'g')) AS back FROM (SELECT item_id, translate(lower(text), 'abcdefghijklmnopqrstuvwxyz ', 'acgtacgtacgtacgtacgtacgtacg') AS t FROM benchmark)")
def reverse_complement(spark, d):
    return table(spark, d, "benchmark").select("item_id", reverse_complement_column(_as_dna(F.col("text"))).alias("back"))


_CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"


@R.add(f"""WITH t AS (SELECT item_id, upper(translate(lower(text), 'abcdefghijklmnopqrstuvwxyz ', 'acgtacgtacgtacgtacgtacgtacg')) AS s FROM benchmark),
c AS (SELECT item_id, i, substr(s, i * 3 + 1, 3) AS c FROM (SELECT *, unnest(range(0, length(s) // 3)) AS i FROM t))
SELECT item_id, string_agg(CASE WHEN regexp_full_match(c, '[TCAG]{{3}}') THEN substr('{_CODE}', (strpos('TCAG', substr(c, 1, 1)) - 1) * 16 + (strpos('TCAG', substr(c, 2, 1)) - 1) * 4 + strpos('TCAG', substr(c, 3, 1)), 1) ELSE 'X' END, '' ORDER BY i) AS aa FROM c GROUP BY item_id""")
def translate_codons(spark, d):
    return table(spark, d, "benchmark").select("item_id", translate_column(_as_dna(F.col("text"))).alias("aa"))


@R.add()
def six_frame_kmers(spark, d):
    """Sampled k-mers of all six frames, with the frame modes side by side; checked against a plain loop in the tests."""
    b = table(spark, d, "benchmark").select("item_id", _as_dna(F.col("text")).alias("seq"))
    out = None
    for mode in ("stopfree", "all", "edges:10"):
        rows = read_kmers(b, KmerParams(5, frames=mode), ["item_id"]).groupBy("item_id", "frame").agg(F.count(F.lit(1)).alias("n")).withColumn("mode", F.lit(mode))
        out = rows if out is None else out.unionByName(rows)
    return out


@R.add("""SELECT item_id, string_agg(CASE WHEN ascii(substr(q, i::INTEGER, 1)) < 53 THEN 'N' ELSE substr(t, i::INTEGER, 1) END, '' ORDER BY i) AS masked FROM (SELECT *, unnest(range(1, length(t) + 1)) AS i FROM (SELECT item_id, substr(translate(lower(text), 'abcdefghijklmnopqrstuvwxyz ', 'acgtacgtacgtacgtacgtacgtacg'), 1, 100) AS t, repeat('!5I', 40) AS q FROM benchmark)) GROUP BY item_id""")
def quality_mask(spark, d):
    """Bases of a Phred quality under 20 as N; reads are the first 100 bases, the length of the quality strings."""
    t = F.substring(_as_dna(F.col("text")), 1, 100)
    return table(spark, d, "benchmark").select("item_id", F.substring(mask_quality_column(t, F.substring(F.repeat(F.lit("!5I"), 40), F.lit(1), F.length(t)), 20), 1, 100).alias("masked"))


@R.add("SELECT sum(length(text))::BIGINT AS bases, sum(length(regexp_replace(text, '[ACGTUacgtu]', '', 'g')))::BIGINT AS lost FROM (SELECT translate(lower(text), 'abcdefghijklmnopqrstuvwxyz ', 'acgtacgtacgtacgtacgtacgtacg') AS text FROM benchmark WHERE regexp_full_match(text, '[ -~\\n]*'))")
def base_statistics(spark, d):
    b = table(spark, d, "benchmark").where(F.col("text").rlike(r"\A[ -~\n]*\z")).select(_as_dna(F.col("text")).alias("seq"))
    return base_counts(b).select("bases", "lost")


@R.add()
def adapter_mask(spark, d):
    """How many residues the adapter mask takes from each document; adapters planted in tests."""
    t = table(spark, d, "documents")
    return t.select("doc_id", (F.length(mask_adapters(F.col("text"))) - F.length(F.regexp_replace(mask_adapters(F.col("text")), "X", ""))).cast("long").alias("masked"))


# The build, step by step, as SQL.
_BUILD = f"""WITH member AS (SELECT source || '/' || lang AS unit_key, doc_id, text, n_chars >= 1000 AS full_length, length(text) AS chars, strlen(text) AS len,
    CASE WHEN max(n_chars >= 1000) OVER (PARTITION BY source || '/' || lang) THEN n_chars >= 1000 ELSE true END AS counts FROM documents),
word AS ({words_sql('member', 'unit_key, doc_id, counts', 'text', 6)}), dw AS (SELECT DISTINCT * FROM word),
hashed AS (SELECT w, {hash_sql('c')} AS h FROM (SELECT w, {code_sql(6)} AS c FROM (SELECT DISTINCT w FROM dw))),
kmer AS (SELECT unit_key, doc_id, counts, h FROM dw JOIN hashed USING (w)),
unit AS (SELECT unit_key, count(*)::BIGINT AS n_members, count(*) FILTER (WHERE full_length)::BIGINT AS n_full_length, count(*) FILTER (WHERE counts)::BIGINT AS n_counting, avg(len) FILTER (WHERE counts) AS len_mean FROM member GROUP BY 1),
nk AS (SELECT unit_key, count(DISTINCT h)::BIGINT AS n_kmers FROM kmer GROUP BY 1),
rated AS (SELECT unit.*, n_kmers, least(1.0, CASE WHEN n_members > 1 THEN greatest({P.t_base}::DOUBLE, least({P.t_cap}::DOUBLE, {P.oversample * P.n_min}::DOUBLE / n_kmers)) ELSE {P.singleton_rate}::DOUBLE END) AS t_g FROM unit JOIN nk USING (unit_key)),
units AS (SELECT *, CASE WHEN t_g >= 1 THEN 18446744073709551615::UHUGEINT ELSE (trunc(t_g * 18446744073709551616.0)::UHUGEINT - 1) END AS b FROM rated),
present AS (SELECT h, unit_key, count(*) FILTER (WHERE counts)::BIGINT AS c FROM kmer GROUP BY 1, 2),
grouped AS (SELECT *, count(*) OVER (PARTITION BY h)::BIGINT AS n_groups FROM present),
scored AS (SELECT g.h, g.unit_key, greatest(c::DOUBLE, 0.5) / n_counting AS p_in, floor(greatest(c::DOUBLE, 0.5) / n_counting * 15 + 0.5)::INTEGER AS pin_q, n_groups, log2(greatest(c::DOUBLE, 0.5) / n_counting / n_groups) AS score, n_members > 1 AND t_g > {P.t_base} AS raised FROM grouped g JOIN units u ON g.unit_key = u.unit_key AND g.h <= u.b),
ranked AS (SELECT *, row_number() OVER (PARTITION BY unit_key ORDER BY score DESC, h) AS r FROM scored WHERE n_groups <= {P.max_groups}),
posting AS (SELECT * FROM ranked WHERE NOT raised OR r <= {P.n_min} OR h <= {bound(P.t_base)}::UHUGEINT)
"""

_INDEXES: dict[str, KmerIndex] = {}


def index(spark, d) -> KmerIndex:
    """The index of a folder's documents, built once per session and folder."""
    key = f"{spark.sparkContext.applicationId}/{d}"
    if key not in _INDEXES:
        _INDEXES.clear()
        _INDEXES[key] = index_build.build_index(targets(spark, d), P)
    return _INDEXES[key]


_STEPS: dict[str, tuple] = {}


def steps(spark, d):
    """Members, k-mers, units and presence of the build, stored once per session and folder."""
    key = f"{spark.sparkContext.applicationId}/{d}"
    if key not in _STEPS:
        members = cut(index_build.number_members(targets(spark, d)))
        kmers = cut(index_build.member_kmers(members, P))
        units = cut(index_build.unit_table(members.drop("sequence"), kmers, P))
        _STEPS.clear()
        _STEPS[key] = (members, kmers, units, cut(index_build.presence(kmers)))
    return _STEPS[key]


@R.add("SELECT unit_key, doc_id AS member_id, CASE WHEN max(full_length) OVER (PARTITION BY unit_key) THEN full_length ELSE true END AS counts, dense_rank() OVER (ORDER BY unit_key) - 1 AS unit FROM (SELECT source || '/' || lang AS unit_key, doc_id, n_chars >= 1000 AS full_length FROM documents)")
def members_numbered(spark, d):
    return index_build.number_members(targets(spark, d)).select("unit_key", "member_id", "counts", "unit")


@R.add(_BUILD + "SELECT unit_key, n_members, n_full_length, n_counting, round(len_mean, 4) AS len_mean, n_kmers, round(t_g, 10) AS t_g FROM units")
def units_table(spark, d):
    units = steps(spark, d)[2]
    return units.select("unit_key", "n_members", "n_full_length", "n_counting", F.round("len_mean", 4).alias("len_mean"), "n_kmers", F.round("t_g", 10).alias("t_g"))


@R.add(_BUILD + "SELECT n_groups, count(DISTINCT h)::BIGINT AS kmers FROM grouped GROUP BY 1")
def presence_groups_histogram(spark, d):
    return index_build.groups_histogram(steps(spark, d)[3])


@R.add(_BUILD + f"SELECT unit_key, {signed_sql('h')} AS hash, round(p_in, 8) AS p_in, pin_q, n_groups, round(score, 6) AS score FROM scored")
def scored_candidates(spark, d):
    _, _, units, present = steps(spark, d)
    rows = index_build.scored_candidates(present, units).join(units.select("unit", "unit_key"), "unit")
    return rows.select("unit_key", "hash", F.round("p_in", 8).alias("p_in"), "pin_q", "n_groups", F.round("score", 6).alias("score"))


@R.add(_BUILD + f"SELECT unit_key, {signed_sql('h')} AS hash, pin_q FROM posting")
def postings_top_n(spark, d):
    i = index(spark, d)
    return i.postings.join(i.units.select("unit", "unit_key"), "unit").select("unit_key", "hash", "pin_q")


@R.add(_BUILD + f"SELECT DISTINCT {signed_sql('h')} AS hash FROM scored WHERE n_groups > {P.max_groups} AND h <= {bound(P.base_rate)}::UHUGEINT")
def promiscuous_kmers(spark, d):
    return index(spark, d).promiscuous.select("hash")


@R.add(_BUILD + f"SELECT unit_key, count(*)::BIGINT AS m_g, round(sum(p_in), 6) AS pin_sum, {', '.join(f'count(*) FILTER (WHERE pin_q = {i})::BIGINT AS h{i}' for i in range(16))} FROM posting GROUP BY 1")
def pin_histograms(spark, d):
    return index(spark, d).units.select("unit_key", "m_g", F.round("pin_sum", 6).alias("pin_sum"), *(F.col("pin_hist")[i].cast("long").alias(f"h{i}") for i in range(16)))


@R.add(_BUILD + ", held AS (SELECT m.unit_key, m.doc_id, count(p.h) AS kept FROM member m LEFT JOIN kmer k ON k.doc_id = m.doc_id LEFT JOIN posting p ON p.unit_key = k.unit_key AND p.h = k.h WHERE m.counts GROUP BY 1, 2) SELECT unit_key, round(CASE WHEN avg(kept) > 0 THEN stddev_pop(kept) / avg(kept) ELSE 0 END, 6) AS len_cv FROM held WHERE unit_key IN (SELECT unit_key FROM posting) GROUP BY 1")
def length_variation(spark, d):
    return index(spark, d).units.select("unit_key", F.round("len_cv", 6).alias("len_cv"))


@R.add(_BUILD + f"SELECT g.unit_key, count(*)::BIGINT AS m_dense FROM grouped g JOIN units u ON g.unit_key = u.unit_key AND g.h <= greatest(u.b, {bound(P.t_dense)}::UHUGEINT) WHERE n_groups <= {P.max_groups} AND g.unit_key IN (SELECT unit_key FROM posting) GROUP BY 1")
def dense_tier(spark, d):
    i = index(spark, d)
    return i.dense.join(i.units.select("unit", "unit_key"), "unit").groupBy("unit_key").agg(F.count(F.lit(1)).alias("m_dense"))


@R.add(_BUILD + ", sets AS (SELECT h, string_agg(unit_key || ':' || pin_q, ',' ORDER BY unit_key, pin_q) AS s FROM posting GROUP BY h) SELECT count(*)::BIGINT AS keys, count(DISTINCT s)::BIGINT AS sets FROM sets")
def holder_sets(spark, d):
    keys, sets = index_build.holder_sets(index(spark, d).postings)
    return keys.agg(F.count(F.lit(1)).alias("keys")).crossJoin(sets.agg(F.count(F.lit(1)).alias("sets")))


@R.add(_BUILD + f"SELECT round(sum(t_g * n_kmers), 4) AS candidates, round(sum(CASE WHEN n_members > 1 AND t_g > {P.t_base} THEN least({P.n_min}::DOUBLE, t_g * n_kmers) + {P.t_base} * n_kmers ELSE t_g * n_kmers END), 4) AS postings FROM units")
def cost_prediction(spark, d):
    _, _, units, present = steps(spark, d)
    return index_build.predicted_cost(units, present, P).select(F.round("candidates", 4).alias("candidates"), F.round("postings", 4).alias("postings"))


_HITS = _BUILD + f""", rword AS ({words_sql('benchmark', 'item_id', 'text', 6)}), rk AS (SELECT item_id, h FROM rword JOIN (SELECT w, {hash_sql('c')} AS h FROM (SELECT w, {code_sql(6)} AS c FROM (SELECT DISTINCT w FROM rword))) USING (w)),
hit AS (SELECT rk.item_id AS read, rk.h, p.unit_key, p.pin_q FROM rk JOIN posting p ON rk.h = p.h JOIN units u ON u.unit_key = p.unit_key AND rk.h <= u.b),
kh AS (SELECT h, unit_key, any_value(pin_q) AS pin_q, count(*)::BIGINT AS hits, count(*) OVER (PARTITION BY h)::BIGINT AS holders FROM hit GROUP BY h, unit_key),
mg AS (SELECT unit_key, count(*)::BIGINT AS m_g FROM posting GROUP BY 1)
"""


def hits(spark, d) -> tuple[KmerIndex, DataFrame, DataFrame]:
    i = index(spark, d)
    found = lookup.unit_hits(reads(spark, d), i)
    return i, found, lookup.kmer_hits(found)


def named(df: DataFrame, i: KmerIndex) -> DataFrame:
    return df.join(i.units.select("unit", "unit_key"), "unit")


@R.add(_HITS + f"SELECT read, {signed_sql('h')} AS hash, unit_key, pin_q FROM hit")
def unit_hits(spark, d):
    i, found, _ = hits(spark, d)
    return named(found, i).select("read", "hash", "unit_key", "pin_q")


@R.add(_HITS + f"SELECT {signed_sql('h')} AS hash, unit_key, hits, holders FROM kh")
def kmer_hits(spark, d):
    i, _, each = hits(spark, d)
    return named(each, i).select("hash", "unit_key", "hits", "holders")


@R.add(_HITS + "SELECT kh.unit_key, count(*)::BIGINT AS kmers_hit, sum(hits)::BIGINT AS hits, count(*) FILTER (WHERE holders = 1)::BIGINT AS own_kmers, any_value(r.reads) AS reads, round(count(*) / any_value(m_g)::DOUBLE, 8) AS containment FROM kh JOIN mg USING (unit_key) JOIN (SELECT unit_key, count(DISTINCT read)::BIGINT AS reads FROM hit GROUP BY 1) r USING (unit_key) GROUP BY 1")
def containment(spark, d):
    i, found, each = hits(spark, d)
    sums = lookup.unit_sums(each, found, i)
    return sums.select("unit_key", "kmers_hit", "hits", "own_kmers", "reads", F.round("containment", 8).alias("containment"))


@R.add(_HITS + f""", found AS (SELECT unit_key, count(DISTINCT h)::BIGINT AS kmers FROM hit GROUP BY 1 HAVING count(DISTINCT h) >= 2),
dense AS (SELECT g.h, g.unit_key FROM grouped g JOIN units u ON g.unit_key = u.unit_key AND g.h <= greatest(u.b, {bound(P.t_dense)}::UHUGEINT) WHERE n_groups <= {P.max_groups})
SELECT d.unit_key, count(DISTINCT d.h)::BIGINT AS kmers, count(*)::BIGINT AS hits, count(DISTINCT rk.item_id)::BIGINT AS reads FROM dense d JOIN found f ON f.unit_key = d.unit_key JOIN rk ON rk.h = d.h GROUP BY 1""")
def two_tier_hits(spark, d):
    """Hits in the dense tier of units of which the standard tier hits two k-mers."""
    i = index(spark, d)
    dense = lookup.parted_tier(i.dense, i.units, f"{checkpoint_folder(spark)}/tier/{uuid.uuid4().hex}")
    found = lookup.tiered_hits(reads(spark, d), i, dense, 2)
    sums = found.groupBy("unit").agg(F.count_distinct("hash").alias("kmers"), F.count(F.lit(1)).alias("hits"), F.count_distinct("read").alias("reads"))
    return named(sums, i).select("unit_key", "kmers", "hits", "reads")


@R.add(_HITS + "SELECT n_hits, count(*)::BIGINT AS reads FROM (SELECT read, count(*)::BIGINT AS n_hits FROM hit GROUP BY 1) GROUP BY 1")
def hits_per_read_histogram(spark, d):
    return lookup.reads_histogram(hits(spark, d)[1])


@R.add(_HITS + f"SELECT count(DISTINCT h)::BIGINT AS sampled, count(DISTINCT h)::BIGINT * 16 AS estimate FROM rk WHERE h <= {bound(1 / 16)}::UHUGEINT")
def distinct_estimate(spark, d):
    return lookup.distinct_estimate(reads(spark, d), 16).select("sampled", "estimate")


@R.add(_HITS + f", k AS (SELECT h FROM posting UNION SELECT h FROM scored WHERE n_groups > {P.max_groups} AND h <= {bound(P.base_rate)}::UHUGEINT) SELECT count(*)::BIGINT AS kmers, count(k.h)::BIGINT AS known FROM rk LEFT JOIN k ON rk.h = k.h WHERE rk.h <= {bound(P.base_rate)}::UHUGEINT")
def census(spark, d):
    i = index(spark, d)
    rows = reads(spark, d).withColumns({"mate": F.lit(0), "frame": F.lit(0)})
    return lookup.census(rows, i)


@R.add(_HITS + f"SELECT {signed_sql('h')} AS hash, unit_key FROM (SELECT kh.h, unit_key, row_number() OVER (PARTITION BY kh.h ORDER BY n / m_g::DOUBLE DESC, unit_key) AS r FROM kh JOIN (SELECT unit_key, count(*) AS n FROM kh GROUP BY 1) USING (unit_key) JOIN mg USING (unit_key)) WHERE r = 1")
def assign_winner(spark, d):
    i, _, each = hits(spark, d)
    return named(assign.winner_takes_all(each.join(i.units.select("unit", "m_g"), "unit")), i).select("hash", "unit_key")


@R.add(_HITS + f"SELECT {signed_sql('h')} AS hash, unit_key FROM (SELECT kh.h, unit_key, row_number() OVER (PARTITION BY kh.h ORDER BY round(s / t_g, 9) DESC, unit_key) AS r FROM kh JOIN (SELECT unit_key, sum(1.0 / holders) AS s FROM kh GROUP BY 1) USING (unit_key) JOIN units USING (unit_key)) WHERE r = 1")
def assign_unique_first(spark, d):
    from pyspark.sql import Window

    i, _, each = hits(spark, d)
    score = F.round(F.sum(1 / F.col("holders")).over(Window.partitionBy("unit")) / F.col("t_g"), 9)
    return named(assign.best_holder(each.join(i.units.select("unit", "t_g"), "unit"), score), i).select("hash", "unit_key")


@R.add(_HITS + f", m AS (SELECT DISTINCT h FROM rword JOIN (SELECT w, {hash_sql('c')} AS h FROM (SELECT w, {code_sql(6)} AS c FROM (SELECT DISTINCT w FROM rword))) USING (w)) SELECT p.unit_key, count(*)::BIGINT AS m_g, count(m.h)::BIGINT AS masked, round(count(m.h) / count(*)::DOUBLE, 8) AS masked_fraction FROM posting p LEFT JOIN m ON p.h = m.h GROUP BY 1")
def mask_decrements(spark, d):
    from ..operators.mask import apply_mask

    i = index(spark, d)
    masked = apply_mask(i, reads(spark, d).select("hash").distinct())
    return masked.units.join(i.units.select("unit", F.col("m_g").alias("before")), "unit").select("unit_key", F.col("before").alias("m_g"), (F.col("before") - F.col("m_g")).alias("masked"), F.round("masked_fraction", 8).alias("masked_fraction"))


@R.add(_HITS + f"SELECT {signed_sql('h')} AS hash, count(*)::BIGINT * 2 AS holders FROM (SELECT DISTINCT h, unit_key FROM hit) GROUP BY h")
def joint_two_indexes(spark, d):
    """The index joined with itself as a second one: every k-mer has twice the holders."""
    _, _, each = hits(spark, d)
    return lookup.joint_hits(each, each, 1 << 20).select("hash", "holders").distinct()


@R.add(_HITS + ", s AS (SELECT read, unit_key, count(DISTINCT h)::BIGINT AS shared FROM hit GROUP BY 1, 2) SELECT read, unit_key AS block, shared FROM s WHERE shared >= 3")
def route_pairs(spark, d):
    i = index(spark, d)
    blocks = named(i.postings, i).select("hash", F.col("unit_key").alias("block"))
    return lookup.routes(reads(spark, d), blocks, 3)[0].select("read", "block", "shared")


