"""Alignment tables: tabular lines with traceback strings, SAM, domain tables, signatures."""

from __future__ import annotations

import json
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TABULAR = "qseqid string, sseqid string, bitscore double, qstart int, qend int, sstart int, send int, qframe int, btop string"
CIGAR = re.compile(r"(\d+)([MIDNSHP=X])")


def read_tabular(spark: SparkSession, path: str) -> DataFrame:
    """Nine tab-separated fields with a BTOP traceback; an empty file is an empty table."""
    return spark.read.schema(TABULAR).option("sep", "\t").option("quote", "").option("escape", "").csv(path)


def read_genome_hits(spark: SparkSession, path: str) -> DataFrame:
    """Headerless hits of reads on contigs."""
    return spark.read.schema("read_name string, flag int, contig string, mapq int, score double, mismatches int, aligned int").option("sep", "\t").csv(path)


def btop_steps(btop: str):
    """('=', n) for runs of equal residues, then pairs of letters: query and subject, '-' for a gap; '/' and '\\' are frame shifts."""
    for m in re.finditer(r"(\d+)|([A-Za-z*/\\-])([A-Za-z*/\\-])", btop):
        yield ("=", int(m[1])) if m[1] else (m[2], m[3])


def btop_columns(btop: str, sstart: int, sequence: str | None = None) -> tuple[list[tuple[int, str]], list[tuple[int, str]]]:
    """Columns (subject position from 0, query residue, '-' for a deletion) and events (position after which it lies; 'I' and the residue, or a frame shift). Equal residues are read from the subject's ``sequence``, '=' without."""
    at, columns, events = sstart - 1, [], []
    for a, b in btop_steps(btop):
        if a == "=":
            columns += [(at + i, sequence[at + i] if sequence else "=") for i in range(b)]
            at += b
        elif a in "/\\":
            events.append((at, a))
        elif b in "/\\":
            events.append((at, b))
        elif b == "-":
            events.append((at, "I" + a))
        else:
            columns.append((at, a))
            at += 1
    return columns, events


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Records with their flags, CIGAR and alignment score; secondary records with no sequence take their mate's primary one, turned where the strands differ."""
    from ..functions.sequences import reverse_complement_column

    f = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.col("value").startswith("@")).select(
        f[0].alias("qname"), f[1].cast("int").alias("flag"), f[2].alias("rname"), f[3].cast("int").alias("pos"), f[4].cast("int").alias("mapq"), f[5].alias("cigar"), f[9].alias("seq"), f[10].alias("qual"), F.regexp_extract("value", "\tAS:i:(-?[0-9]+)", 1).alias("_as")
    )
    rows = rows.withColumns({"score": F.when(F.col("_as") != "", F.col("_as").cast("double")), "mate": F.col("flag").bitwiseAND(128) > 0, "reverse": F.col("flag").bitwiseAND(16) > 0}).drop("_as")
    own = Window.partitionBy("qname", "mate")
    primary = F.first(F.when((F.col("flag").bitwiseAND(0x900) == 0) & (F.col("seq") != "*"), F.struct("seq", "reverse")), ignorenulls=True).over(own)
    rows = rows.withColumn("_p", primary)
    turned = F.when(F.col("_p.reverse") == F.col("reverse"), F.col("_p.seq")).otherwise(reverse_complement_column(F.col("_p.seq")))
    return rows.withColumn("seq", F.when(F.col("seq") != "*", F.col("seq")).otherwise(F.coalesce(turned, F.lit("*")))).drop("_p")


def cigar_columns(cigar: str, pos: int, seq: str) -> tuple[list[tuple[int, str]], list[tuple[int, str]]]:
    """The same as ``btop_columns`` for a CIGAR."""
    at, q, columns, events = pos - 1, 0, [], []
    for n, op in ((int(m[1]), m[2]) for m in CIGAR.finditer(cigar)):
        if op in "M=X":
            columns += [(at + i, seq[q + i]) for i in range(n)]
            at, q = at + n, q + n
        elif op == "I":
            events.append((at, "I" + seq[q : q + n]))
            q += n
        elif op in "DN":
            columns += [(at + i, "-") for i in range(n)] if op == "D" else []
            at += n
        elif op == "S":
            q += n
    return columns, events


def expand_columns(hits: DataFrame, keep: list[str], subject: str | None = None) -> DataFrame:
    """``keep`` with ``column, residue`` for every column of each hit's traceback (``btop, sstart`` and, if named, the subject's sequence)."""
    from pyspark.sql.types import StructType

    schema = StructType([hits.schema[c] for c in keep] + StructType.fromDDL("column int, residue string").fields)

    def walk(batches):
        for b in batches:
            found = [btop_columns(t, s, q)[0] for t, s, q in zip(b["btop"], b["sstart"], b[subject] if subject else [None] * len(b))]
            which = [i for i, c in enumerate(found) for _ in c]
            out = b[keep].iloc[which].reset_index(drop=True)
            out["column"] = np.array([x for c in found for x, _ in c], np.int32)
            out["residue"] = np.array([r for c in found for _, r in c], object)
            yield out

    return hits.select(*dict.fromkeys([*keep, "btop", "sstart", *([subject] if subject else [])])).mapInPandas(walk, schema)


def expand_events(hits: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` with ``column, event`` for insertions and frame shifts."""
    from pyspark.sql.types import StructType

    schema = StructType([hits.schema[c] for c in keep] + StructType.fromDDL("column int, event string").fields)

    def walk(batches):
        for b in batches:
            found = [btop_columns(t, s)[1] for t, s in zip(b["btop"], b["sstart"])]
            out = b[keep].iloc[[i for i, c in enumerate(found) for _ in c]].reset_index(drop=True)
            out["column"] = np.array([x for c in found for x, _ in c], np.int32)
            out["event"] = np.array([r for c in found for _, r in c], object)
            yield out

    return hits.select(*dict.fromkeys([*keep, "btop", "sstart"])).mapInPandas(walk, schema)


def read_domains(spark: SparkSession, path: str) -> DataFrame:
    """A domain table of profile search: blank-separated lines, comments left out."""
    f = F.split(F.trim("value"), r"\s+")
    at = {"target": (0, "string"), "query": (3, "string"), "evalue": (6, "double"), "score": (7, "double"), "i_evalue": (12, "double"), "dom_score": (13, "double"), "hmm_from": (15, "int"), "hmm_to": (16, "int"), "ali_from": (17, "int"), "ali_to": (18, "int"), "env_from": (19, "int"), "env_to": (20, "int")}
    return spark.read.text(path).where(~F.col("value").startswith("#") & (F.trim("value") != "")).select(*(f[i].cast(t).alias(n) for n, (i, t) in at.items()))


def read_signatures(spark: SparkSession, path: str) -> DataFrame:
    """``name, ksize, hash`` of JSON sketch signatures; hashes are kept whole as the longs of their bits."""

    def parse(batches):
        for b in batches:
            rows = []
            for text in b["value"]:
                for top in json.loads(text):
                    for s in top["signatures"]:
                        rows += [(top.get("name") or top.get("filename") or "", s["ksize"], h - (1 << 64) if h >= 1 << 63 else h) for h in s["mins"]]
            yield pd.DataFrame(rows, columns=["name", "ksize", "hash"]).astype({"ksize": "int32", "hash": "int64"})

    return spark.read.text(path, wholetext=True).mapInPandas(parse, "name string, ksize int, hash long")
