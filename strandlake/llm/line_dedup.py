"""Lines that many documents share, dropped from all but one of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TMP, plus, store, with_text


def line_keys(text: bytes, min_chars: int) -> list[bytes]:
    """A 16-byte hash for every \\n-split line, b"" for a line whose key has fewer than ``min_chars`` code points.

    The key is the line without blanks at either end and with A-Z in lower case; bytes do both at C speed and leave
    every other letter as it is.
    """
    import xxhash

    keys = (line.strip() for line in text.lower().split(b"\n"))
    return [
        xxhash.xxh3_128_digest(key) if len(key) >= 4 * min_chars or len(key) >= min_chars and len(key.decode()) >= min_chars else b""
        for key in keys
    ]


def shared_lines(docs: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """``doc_id`` and ``lines``, the hashes of its keys that go from it."""

    def keys(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            ids, found = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                own = set(line_keys(text or b"", min_chars)) - {b""}
                ids += [doc_id] * len(own)
                found += sorted(own)
            halves = np.frombuffer(b"".join(found), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.types[0]), pa.array(halves[:, 0]), pa.array(halves[:, 1])], ["doc_id", "hi", "lo"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    each = docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(keys, f"doc_id {kind}, hi long, lo long")
    each = store(each)
    # The distinct count is dealt by line and document before it is dealt by line, with a partial sum in between, so a
    # line of every document is no hot key. Both sides of the join are stored tables, so that Spark may split its hot keys.
    frequent = store(each.groupBy("hi", "lo").agg(F.count_distinct("doc_id").alias("n"), F.max("doc_id").alias("keeper")).where(F.col("n") >= min_docs).drop("n"))
    gone = each.join(frequent, ["hi", "lo"]).where("doc_id <> keeper")
    return gone.groupBy("doc_id").agg(F.collect_set(F.struct("hi", "lo")).alias("lines"))


def dedupe_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """``docs`` with ``text`` less the lines that at least ``min_docs`` documents share, and ``n_lines``, ``n_dropped``.

    Lines with keys (see ``line_keys``) of at least ``min_chars`` code points are counted by distinct ``doc_id``; all of
    a frequent key's lines go, but those in the largest ``doc_id`` that has it. Other lines stay in their order, joined
    by \\n. Only hashes, never lines, are dealt out to be counted; texts are dealt out once, by ``doc_id``, to meet the
    hashes they lose.

    Null or empty text: one empty line, and the text is then empty. Null ``doc_id``: counts for no line and keeps all of
    its own. Rows that share a ``doc_id`` count as one document and lose the same keys. Empty table: empty result.
    Columns of other names pass through; ``n_lines`` and ``n_dropped`` are replaced.
    """
    gone = shared_lines(docs, min_chars, min_docs).withColumnRenamed("lines", f"{TMP}lines")

    def drop(batches):
        import pyarrow as pa

        for batch in batches:
            lost = batch.column(batch.schema.names.index(f"{TMP}lines"))
            rest = batch.drop_columns([f"{TMP}lines"])
            lines = lost.to_pylist()

            def make(texts, lines=lines):
                kept, n_lines, n_dropped = [], [], []
                for text, own in zip(texts, lines):
                    text = text or b""
                    n, dropped = text.count(b"\n") + 1, 0
                    if own:
                        bad = {x["hi"].to_bytes(8, "little", signed=True) + x["lo"].to_bytes(8, "little", signed=True) for x in own}
                        stay = [line for line, key in zip(text.split(b"\n"), line_keys(text, min_chars)) if key not in bad]
                        text, dropped = b"\n".join(stay), n - len(stay)
                    kept.append(text)
                    n_lines.append(n)
                    n_dropped.append(dropped)
                return {"text": pa.array(kept, pa.binary()).cast(pa.string()), "n_lines": pa.array(n_lines, pa.int64()), "n_dropped": pa.array(n_dropped, pa.int64())}

            yield from with_text([rest], make)

    return docs.join(gone, "doc_id", "left").select(*docs.columns, f"{TMP}lines").mapInArrow(drop, plus(docs, "text string, n_lines long, n_dropped long"))


def op5_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document's lines after line deduplication: ``doc_id, n_lines, n_dropped, kept_sha256``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedupe_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH line AS (
  SELECT rid, doc_id, pos, s.line AS line,
         translate(trim(s.line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents) d,
       LATERAL (SELECT unnest(d.ls) AS line, generate_subscripts(d.ls, 1) AS pos) s
), frequent AS (
  SELECT k, max(doc_id) AS keeper FROM line WHERE doc_id IS NOT NULL AND length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), judged AS (
  SELECT line.*, f.k IS NOT NULL AND line.doc_id <> f.keeper AS gone FROM line LEFT JOIN frequent f ON line.k = f.k
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE coalesce(gone, false))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT coalesce(gone, false)), '')) AS kept_sha256
FROM judged GROUP BY rid, doc_id
"""
