"""Streams over the driver tables, run until their source is exhausted."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.kmers import target_kmers
from ..streaming import streams
from .sequences import _HITS, P, index, named
from .tables import Registry

R = Registry()


@R.add(_HITS + "SELECT unit_key, count(*)::BIGINT AS hits FROM hit GROUP BY 1")
def stream_unit_hits(spark, d):
    i = index(spark, d)
    reads = streams.table_stream(spark, f"{d}/benchmark.parquet").select(F.col("item_id").alias("read"), F.col("text").alias("sequence"))
    out = streams.latest(streams.drained(streams.stream_unit_hits(reads, i), "update"), ["unit"])
    return named(out, i).select("unit_key", "hits")


@R.add(_HITS + "SELECT count(DISTINCT h)::BIGINT AS kmers FROM rk")
def stream_distinct_kmers(spark, d):
    reads = streams.table_stream(spark, f"{d}/benchmark.parquet").select(F.col("item_id").alias("read"), F.col("text").alias("sequence"))
    return streams.drained(streams.stream_distinct_kmers(reads, P.kmers()), "append").agg(F.count(F.lit(1)).alias("kmers"))


@R.add(_HITS + """, own AS (SELECT DISTINCT h::UBIGINT AS h FROM rk), placed AS (SELECT (h >> 60)::BIGINT AS range, h::HUGEINT AS h, row_number() OVER (PARTITION BY h >> 60 ORDER BY h) AS r FROM own),
least AS (SELECT range, count(*)::BIGINT AS kept, (max(h) - range::HUGEINT * 1152921504606846976 + 1)::DOUBLE / 1152921504606846976::DOUBLE AS last FROM placed WHERE r <= 256 GROUP BY range)
SELECT range, kept, round(last, 9) AS last, round(CASE WHEN kept < 256 THEN kept ELSE 255 / last END, 4) AS "distinct" FROM least""")
def stream_least_hashes(spark, d):
    """Distinct k-mers of arriving texts by sixteen bounded sketches of 256 hashes each."""
    reads = streams.table_stream(spark, f"{d}/benchmark.parquet").select(F.col("item_id").alias("read"), F.col("text").alias("sequence"))
    found = streams.drained(streams.stream_least_hashes(target_kmers(reads, P.kmers(), ["read"]), keep=256), "update")
    return streams.latest(found, ["range"]).select("range", "kept", F.round("last", 9).alias("last"), F.round("distinct", 4).alias("distinct"))


@R.add("SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_tumbling(spark, d):
    events = streams.table_stream(spark, f"{d}/events.parquet")
    out = streams.latest(streams.drained(streams.tumbling_counts(events), "update"), ["start", "event_type"])
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@R.add("WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM e) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*)::BIGINT AS n FROM s GROUP BY user_id, g")
def session_windows(spark, d):
    """The same session windows over the table at rest."""
    out = streams.session_counts(spark.read.parquet(f"{d}/events.parquet"))
    return out.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")
