"""Captures judged by the lists that were in force when they were fetched, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
#: Characters of the longest name that a host can have, and so 127 labels at most.
LONGEST = 253
#: What an entry may do, the strongest last: of entries of one key and day the strongest holds.
ACTIONS = ("remove", "allow", "block")


def host_of(url: Column) -> Column:
    """A URL's host in lower case, without a last dot; null if it has none, or one longer than the 253 characters that a host's name can have."""
    host = F.lower(F.regexp_replace(F.regexp_extract(url, HOST, 1), r"\.$", ""))
    return F.when(F.length(host).between(1, LONGEST), host)


def suffixes(host: str) -> Column:
    """A host and its parent domains down to two labels, each with its number of labels; an address in figures has no parents."""
    return F.expr(
        rf"""if({host} rlike '^[0-9.]+$' or size(split({host}, '[.]')) < 3,
            array(struct(size(split({host}, '[.]')) as labels, {host} as key)),
            transform(sequence(0, size(split({host}, '[.]')) - 2),
                      i -> struct(size(split({host}, '[.]')) - i as labels, array_join(slice(split({host}, '[.]'), i + 1, {LONGEST}), '.') as key)))"""
    )


def intervals(entries: DataFrame) -> DataFrame:
    """Validity intervals of dated entries (``key, listed, action``): ``key, since, until, action``.

    An entry holds from its day until its key's next entry (null: still). Entries with a null or unknown field are left
    out; of one key's entries of one day the strongest stays. The days of a key bound the rows that its window sorts,
    because entries are put together by key and day before, map-side first.
    """
    rank = F.array_position(F.array(*map(F.lit, ACTIONS)), F.col("action"))
    one = entries.where(F.col("key").isNotNull() & F.col("listed").isNotNull()).select(F.lower("key").alias("key"), F.col("listed").alias("since"), rank.alias("rank")).where("rank > 0")
    one = one.groupBy("key", "since").agg(F.max("rank").alias("rank"))
    until = F.lead("since").over(Window.partitionBy("key").orderBy("since"))
    return one.select("key", "since", until.alias("until"), F.element_at(F.array(*map(F.lit, ACTIONS)), F.col("rank").cast("int")).alias("action"))


def judge_captures(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """``captures`` (``url, fetched``, a date, and any others) with ``host, matched_key, listed_from, blocked``.

    A capture's host and each of its parent domains is looked up as of the day of the fetch: the key's last interval that
    began by then. Entries to remove end a listing; of the keys in force the one with most labels decides, and the
    capture is blocked if that entry says so.

    Only distinct pairs of host and day are looked up. The as-of join puts pairs of key and day and the intervals into
    one window per key, ordered by day, and carries the last interval forward: a key has no more rows there than there
    are days, even if a third of all captures have its host. Captures meet the verdicts by host and day, in a join that
    Spark may split. Null or unreadable url (without a host, or with one over 253 characters, which
    no name can have), or null ``fetched``: nothing matches, not blocked. Very long paths are not looked at. Repeated rows are judged
    each. Empty table or list: empty result or nothing blocked. The four columns are replaced if they exist.
    """
    rest = captures.select(*(c for c in captures.columns if c not in ("host", "matched_key", "listed_from", "blocked"))).withColumn("host", host_of(F.col("url")))
    pairs = rest.where("host is not null and fetched is not null").select("host", F.col("fetched").alias("day")).distinct()
    asked = pairs.withColumn("s", F.explode(suffixes("host"))).select("host", "day", "s.key", "s.labels")
    events = intervals(entries).select("key", F.col("since").alias("day"), F.struct("since", "until", "action").alias("entry"), F.lit(0).alias("asks"))
    probes = asked.select("key", "day").distinct().select("key", "day", F.lit(None).cast(events.schema["entry"].dataType).alias("entry"), F.lit(1).alias("asks"))
    as_of = Window.partitionBy("key").orderBy("day", "asks").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    states = events.unionByName(probes).withColumn("entry", F.last("entry", ignorenulls=True).over(as_of)).where("asks = 1 and entry.action <> 'remove' and (entry.until is null or day < entry.until)")
    states = states.select("key", "day", F.col("entry.since").alias("since"), F.col("entry.action").alias("action"))
    verdicts = asked.join(states, ["key", "day"]).groupBy("host", "day").agg(F.max_by(F.struct("key", "since", "action"), "labels").alias("__sl_v"))
    verdicts = verdicts.select(F.col("host").alias("__sl_host"), F.col("day").alias("__sl_day"), "__sl_v")
    judged = rest.join(verdicts, (rest["host"] == F.col("__sl_host")) & (rest["fetched"] == F.col("__sl_day")), "left")
    return judged.select(*(rest[c] for c in rest.columns), F.col("__sl_v.key").alias("matched_key"), F.col("__sl_v.since").alias("listed_from"), F.coalesce(F.col("__sl_v.action") == "block", F.lit(False)).alias("blocked"))


def op10_url_filters(spark, sf_dir: str) -> DataFrame:
    """All pages, as captures, judged against a dated list.

    The tables have no list and no fetch times, so both are derived from every page by rule: page p was fetched 131 p mod
    730 days after 2023-01-01, and it puts its host (each fourth page: its last two labels) on the list 37 p + 11 mod 730
    days after that day, to block, remove or allow by p mod 3.
    """
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    day = "date_add(date'2023-01-01', cast(pmod({}, 730) as int))"
    captures = pages.select("page_id", "url", F.expr(day.format("page_id * 131")).alias("fetched"))
    host = host_of(F.col("url"))
    domain = F.array_join(F.slice(F.split(host, r"\."), -2, 2), ".")
    entries = pages.where(host.isNotNull()).select(
        F.when((F.expr("pmod(page_id, 4)") == 3) & (F.size(F.split(host, r"\.")) >= 2), domain).otherwise(host).alias("key"),
        F.expr(day.format("page_id * 37 + 11")).alias("listed"),
        F.element_at(F.array(F.lit("block"), F.lit("remove"), F.lit("allow")), F.expr("cast(pmod(page_id, 3) + 1 as int)")).alias("action"),
    )
    said = judge_captures(captures, entries)
    return said.select("page_id", "host", F.col("fetched").cast("string").alias("fetched"), "matched_key", F.col("listed_from").cast("string").alias("listed_from"), "blocked")


OP10_SQL = r"""
WITH named AS (
  SELECT page_id, lower(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1), '\.$', '')) AS name FROM pages
), page AS (
  SELECT page_id, CASE WHEN length(name) BETWEEN 1 AND 253 THEN name END AS host,
         DATE '2023-01-01' + CAST((page_id * 131) % 730 AS INTEGER) AS fetched,
         DATE '2023-01-01' + CAST((page_id * 37 + 11) % 730 AS INTEGER) AS listed
  FROM named
), entry AS (
  SELECT CASE WHEN page_id % 4 = 3 AND len(string_split(host, '.')) >= 2 THEN array_to_string(string_split(host, '.')[-2:], '.') ELSE host END AS key, listed,
         max(CASE page_id % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END) AS rank
  FROM page WHERE host IS NOT NULL GROUP BY ALL
), span AS (
  SELECT *, lead(listed) OVER (PARTITION BY key ORDER BY listed) AS until FROM entry
), best AS (
  SELECT p.page_id, arg_max(s.key, length(s.key)) AS matched_key, arg_max(s.listed, length(s.key)) AS listed_from, arg_max(s.rank, length(s.key)) AS rank
  FROM page p JOIN span s ON (p.host = s.key OR p.host LIKE '%.' || s.key AND contains(s.key, '.') AND NOT regexp_full_match(p.host, '[0-9.]+'))
    AND p.fetched >= s.listed AND (s.until IS NULL OR p.fetched < s.until) AND s.rank > 1
  GROUP BY p.page_id
)
SELECT page.page_id, host, CAST(fetched AS VARCHAR) AS fetched, matched_key, CAST(listed_from AS VARCHAR) AS listed_from, coalesce(rank = 3, false) AS blocked FROM page LEFT JOIN best USING (page_id)
"""
