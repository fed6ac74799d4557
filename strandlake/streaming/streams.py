"""Structured Streaming: hits of arriving reads, and windows over events."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.kmers import KmerParams, target_kmers, unsigned
from ..lineage import checkpoint_folder
from ..operators.index_build import KmerIndex


def table_stream(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """A Parquet table, file or folder, as a stream of its files; ``files_per_batch`` bounds a micro-batch."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{path}*" if path.endswith(".parquet") else path)


def drained(stream: DataFrame, mode: str, each: Callable[[DataFrame, int], None] | None = None, place: str | None = None) -> DataFrame:
    """Run a stream until its source is exhausted and return what it wrote: through ``foreachBatch`` to Parquet, with a checkpoint in the shared folder, so that a restart neither loses nor repeats a batch. Rows carry their batch, ``_batch``; a batch that is written again replaces itself. The same ``place`` (a shared folder; by default a new one) goes on where the last run of it ended or broke off."""
    spark = stream.sparkSession
    place = place or f"{checkpoint_folder(spark)}/stream/{uuid.uuid4().hex}"

    def write(df: DataFrame, n: int) -> None:
        df.withColumn("_batch", F.lit(n)).write.mode("overwrite").parquet(f"{place}/out/batch={n}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{place}/state").trigger(availableNow=True).foreachBatch(each or write).start()
    query.awaitTermination()
    from pyspark.sql.types import IntegerType, StructField, StructType

    schema = StructType([*stream.schema.fields, StructField("_batch", IntegerType())])
    return spark.read.schema(schema).parquet(f"{place}/out/batch=*")


def latest(written: DataFrame, keys: list[str]) -> DataFrame:
    """The last state of each key of a stream in update mode."""
    values = [c for c in written.columns if c not in (*keys, "_batch")]
    return written.groupBy(*keys).agg(F.max_by(F.struct(*values), "_batch").alias("s")).select(*keys, "s.*")


def stream_unit_hits(reads: DataFrame, index: KmerIndex) -> DataFrame:
    """``unit, hits`` of a stream of reads (``read, sequence``), running: k-mers meet the stored postings batch by batch."""
    held = index.postings.join(index.units.select("unit", "bound_g"), "unit").where(unsigned("hash") <= F.col("bound_g")).select("hash", "unit")
    return target_kmers(reads, index.params.kmers(), ["read"]).join(held, "hash").groupBy("unit").agg(F.count(F.lit(1)).alias("hits"))


def stream_distinct_kmers(reads: DataFrame, p: KmerParams) -> DataFrame:
    """Distinct hashes of a stream, each once: the state holds what has been seen."""
    return target_kmers(reads, p, ["read"]).select("hash").dropDuplicates(["hash"])


def stream_least_hashes(hashes: DataFrame, column: str = "hash", ranges: int = 16, keep: int = 4096) -> DataFrame:
    """``range, kept, last, distinct`` of a stream of hashes, running (update mode): a sketch of the distinct ones in state that never grows beyond ``ranges`` times ``keep`` numbers.

    Unsigned hashes are parted by their leading bits into ``ranges`` (a power of two up to 256). Of each range the state
    holds the ``keep`` least distinct hashes; ``last`` is the largest of these as a share of the range. While there are
    fewer than ``keep``, ``distinct`` is exact; then it is (keep - 1) / last, with a relative error of about 1 /
    sqrt(keep - 2), and over all ranges together (their sum) smaller by the root of ``ranges``. Null hashes take no
    part; repeated ones, within a batch or over batches, count once. Tasks send on only the least of what they read.
    """
    if ranges & (ranges - 1) or not 1 <= ranges <= 256 or keep < 3:
        raise ValueError("ranges must be a power of two up to 256, keep 3 or more")
    width = 64 - (ranges.bit_length() - 1)

    def least(x: np.ndarray) -> np.ndarray:
        return np.unique(x)[:keep]

    def thinned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own: dict[int, np.ndarray] = {}
        for batch in batches:
            x = np.unique(batch["hash"].to_numpy(np.int64).view(np.uint64))
            at = (x >> np.uint64(width)).astype(np.int64) if width < 64 else np.zeros(len(x), np.int64)
            for r in np.unique(at).tolist():
                own[r] = least(np.concatenate([own.get(r, x[:0]), x[at == r]]))
        for r, x in own.items():
            yield pd.DataFrame({"range": r, "hash": x.view(np.int64)})

    def merged(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        x = np.frombuffer(state.get[0], np.uint64) if state.exists else np.empty(0, np.uint64)
        for batch in batches:
            x = least(np.concatenate([x, batch["hash"].to_numpy(np.int64).view(np.uint64)]))
        state.update((x.tobytes(),))
        last = float(int(x[-1]) - (int(key[0]) << width) + 1) / 2.0**width if len(x) else 0.0
        yield pd.DataFrame({"range": [int(key[0])], "kept": [len(x)], "last": [last], "distinct": [float(len(x)) if len(x) < keep else (keep - 1) / last]})

    few = hashes.select(F.col(column).cast("long").alias("hash")).where("hash is not null").mapInPandas(thinned, "range long, hash long")
    return few.groupBy("range").applyInPandasWithState(merged, "range long, kept long, last double, distinct double", "least binary", "update", GroupStateTimeout.NoTimeout)


def tumbling_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """``start, event_type, n, total`` of event-time windows, closed by a watermark."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def session_counts(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """``user_id, start, end, n`` of sessions that a pause ends."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy("user_id", F.session_window("at", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
