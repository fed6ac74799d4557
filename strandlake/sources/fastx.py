"""FASTA and FASTQ as tables, plain or gzipped, and as sinks."""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..lineage import cut

SCHEMA = "file string, part int, idx long, name string, seq string, qual string"


class Range(InputPartition):
    def __init__(self, path: str, part: int, start: int, end: int | None):
        self.path, self.part, self.start, self.end = path, part, start, end


def opened(path: str):
    """A file of any store that Arrow reaches."""
    from pyarrow import fs

    store, inside = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("/") else (fs.LocalFileSystem(), path)
    return store, inside


def records(lines: Iterator[bytes], end: int | None = None, at: int = 0) -> Iterator[tuple[bytes, bytes, bytes | None]]:
    """(header without its mark, sequence, quality) of the records that begin before byte ``end``; the format is told by the first mark. Sequences may be wrapped in FASTA; a FASTQ record has four lines."""
    header, parts = None, []
    pos = at
    for line in lines:
        start, pos = pos, pos + len(line)
        text = line.rstrip(b"\r\n")
        if text.startswith(b">") or header is not None and header[:1] == b">":
            if text.startswith(b">"):
                if header is not None:
                    yield header[1:], b"".join(parts), None
                if end is not None and start >= end:
                    return
                header, parts = text, []
            else:
                parts.append(text.strip())
        elif text.startswith(b"@"):
            if end is not None and start >= end:
                return
            rest = [next(lines, None) for _ in range(3)]
            if rest[2] is None or not rest[1].startswith(b"+"):
                raise ValueError(f"broken FASTQ record {text[:60]!r}")
            pos += sum(len(x) for x in rest)
            seq, qual = rest[0].rstrip(b"\r\n"), rest[2].rstrip(b"\r\n")
            if len(seq) != len(qual):
                raise ValueError(f"sequence and quality of {text[:60]!r} differ in length")
            yield text[1:], seq, qual
        elif text:
            raise ValueError(f"no record begins with {text[:60]!r}")
    if header is not None:
        yield header[1:], b"".join(parts), None


def sync(f, start: int) -> int:
    """The first record at or after byte ``start``: a line with a FASTA mark, or one with a FASTQ mark whose second next line begins with +."""
    f.seek(start - 1)
    at = start - 1 + len(f.readline())
    f.seek(at)
    window: list[tuple[int, bytes]] = []
    while True:
        line = f.readline()
        if not line:
            return at
        window.append((at, line))
        at += len(line)
        if line.startswith(b">") and not any(x.startswith(b"@") for _, x in window[:-1]):
            return window[-1][0]
        if len(window) >= 3 and window[-3][1].startswith(b"@") and window[-1][1].startswith(b"+"):
            return window[-3][0]
        if len(window) > 8:
            window.pop(0)


class FastxReader(DataSourceReader):
    def __init__(self, options):
        self.paths = [p for p in options["path"].split(",") if p] if "path" in options else []
        self.split = int(options.get("splitbytes", 64 << 20))

    def partitions(self):
        from pyarrow import fs

        out = []
        for p in self.paths:
            store, inside = opened(p)
            info = store.get_file_info(inside)
            files = [info] if info.type != fs.FileType.Directory else sorted((x for x in store.get_file_info(fs.FileSelector(inside)) if x.is_file and not x.base_name.startswith(("_", "."))), key=lambda x: x.path)
            if info.type == fs.FileType.NotFound:
                raise FileNotFoundError(p)
            for x in files:
                whole = x.path.endswith(".gz") or x.size <= self.split
                cuts = [0] if whole else list(range(0, x.size, self.split))
                out += [Range(p if info.is_file else x.path, i, a, None if whole else min(a + self.split, x.size)) for i, a in enumerate(cuts)]
        return out

    def read(self, partition):
        store, inside = opened(partition.path)
        with store.open_input_file(inside) if partition.end is not None else store.open_input_stream(inside, compression=None) as raw:
            f = io.BufferedReader(raw)
            if partition.end is None and f.peek(2)[:2] == b"\x1f\x8b":
                f = gzip.open(f)
            at = sync(f, partition.start) if partition.start else 0
            if partition.end is not None:
                if at >= partition.end:
                    return
                f.seek(at)
            for i, (head, seq, qual) in enumerate(records(iter(f), partition.end, at)):
                yield partition.path, partition.part, i, head.split(None, 1)[0].decode() if head.split() else "", seq.decode("latin-1"), qual.decode("latin-1") if qual is not None else None


class FastxSource(DataSource):
    """``spark.read.format("fastx").load(path)``: records of FASTA or FASTQ files in order of ``file, part, idx``. Plain files are cut by bytes and each part finds its first record; gzipped ones are one part."""

    @classmethod
    def name(cls):
        return "fastx"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return FastxReader(self.options)


def read_fastx(spark: SparkSession, *paths: str, split_bytes: int = 64 << 20) -> DataFrame:
    spark.dataSource.register(FastxSource)
    return spark.read.format("fastx").option("splitBytes", split_bytes).load(",".join(paths))


def numbered(records_: DataFrame, name: str = "read") -> DataFrame:
    """Records with their ordinal number over all files: within a part as read, shifted by the parts before."""
    stored = cut(records_)
    counts = stored.groupBy("file", "part").count()
    shift = F.coalesce(F.sum("count").over(Window.orderBy("file", "part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return stored.join(F.broadcast(counts.select("file", "part", shift.alias("_s"))), ["file", "part"]).withColumn(name, F.col("idx") + F.col("_s")).drop("_s")


def read_pairs(spark: SparkSession, first: str, second: str | None = None) -> DataFrame:
    """``read, mate, name, seq, qual``, mates paired by position; files of different lengths are an error."""
    one = numbered(read_fastx(spark, first)).withColumn("mate", F.lit(0))
    if second is None:
        return one.select("read", "mate", "name", "seq", "qual")
    two = numbered(read_fastx(spark, second)).withColumn("mate", F.lit(1))
    a, b = one.count(), two.count()
    if a != b:
        raise ValueError(f"{first} has {a} reads, {second} {b}")
    return one.unionByName(two).select("read", "mate", "name", "seq", "qual")


def members_from_fasta(spark: SparkSession, path: str, groups: DataFrame | None = None) -> DataFrame:
    """Targets (``unit_key, member_id, full_length, sequence``) of a FASTA file; ``groups`` (``target_id, group``) puts them in units, those without are their own. Empty or repeated ids and unknown ids in ``groups`` are errors."""
    records_ = cut(read_fastx(spark, path).select(F.col("name").alias("member_id"), F.col("seq").alias("sequence")))
    if not records_.where("member_id = ''").isEmpty():
        raise ValueError("a target has no id")
    if row := records_.groupBy("member_id").count().where("count > 1").limit(1).collect():
        raise ValueError(f"target id {row[0]['member_id']} is repeated")
    if groups is None:
        return records_.select(F.col("member_id").alias("unit_key"), "member_id", F.lit(True).alias("full_length"), "sequence")
    if row := groups.join(records_, groups["target_id"] == records_["member_id"], "left_anti").limit(1).collect():
        raise ValueError(f"group table names an unknown target {row[0]['target_id']}")
    joined = records_.join(groups, records_["member_id"] == groups["target_id"], "left")
    return joined.select(F.coalesce("group", "member_id").alias("unit_key"), "member_id", F.lit(True).alias("full_length"), "sequence")


def write_fasta(df: DataFrame, path: str, name: str = "name", seq: str = "seq", compression: str = "none") -> None:
    df.select(F.concat(F.lit(">"), F.col(name), F.lit("\n"), F.col(seq)).alias("value")).write.option("compression", compression).text(path)


def write_fastq(df: DataFrame, path: str, compression: str = "gzip") -> None:
    df.select(F.concat(F.lit("@"), F.col("name"), F.lit("\n"), F.col("seq"), F.lit("\n+\n"), F.col("qual")).alias("value")).write.option("compression", compression).text(path)


def genome_windows(records_: DataFrame, size: int, overlap: int, seq: str = "seq") -> DataFrame:
    """Each record in windows of ``size`` that overlap by ``overlap``: ``name, start, seq``; every stretch of ``overlap + 1`` lies whole in one."""
    step = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.length(seq) - F.lit(overlap) - 1), F.lit(step))
    return records_.where(F.length(seq) > overlap).withColumn("start", F.explode(starts)).select("name", "start", F.substring(F.col(seq), F.col("start") + 1, F.lit(size)).alias("seq"))


def recruit(reads: DataFrame, names: DataFrame) -> DataFrame:
    """Both mates of every pair whose name is in ``names``."""
    bare: Column = F.regexp_replace("name", "/[12]$", "")
    return reads.withColumn("_n", bare).join(names.select(F.regexp_replace("name", "/[12]$", "").alias("_n")).distinct(), "_n", "left_semi").drop("_n")
