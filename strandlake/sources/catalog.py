"""Indexes on disk: Parquet tables beside a JSON file of parameters."""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.index_build import IndexParams, KmerIndex

FORMAT = 1


def save_index(index: KmerIndex, path: str, buckets: int = 64) -> None:
    """Write an index. Postings are parted by a slice of the hash and sorted in it, so that a lookup of few hashes reads few row groups. Each table is committed by Spark; the parameters come last and mark the index whole."""
    spark = index.units.sparkSession
    part = F.pmod(F.col("hash"), F.lit(buckets)).cast("int")
    for name in ("postings", "dense"):
        if (table := getattr(index, name)) is not None:
            table.withColumn("slice", part).repartition(buckets, "slice").sortWithinPartitions("slice", "hash").write.mode("overwrite").partitionBy("slice").parquet(f"{path}/{name}")
    index.units.write.mode("overwrite").parquet(f"{path}/units")
    index.promiscuous.write.mode("overwrite").parquet(f"{path}/promiscuous")
    meta = {"format": FORMAT, "params": asdict(index.params), "molecule": index.params.molecule, "dense": index.dense is not None, "base_stratum_complete": True, "hash": "splitmix64"}
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def read_meta(spark: SparkSession, path: str) -> dict:
    meta = json.loads("".join(r["value"] for r in spark.read.text(f"{path}/meta").collect()))
    if meta.get("format") != FORMAT:
        raise ValueError(f"index format {meta.get('format')} is not known")
    return meta


def load_index(spark: SparkSession, path: str) -> KmerIndex:
    meta = read_meta(spark, path)
    table = lambda name: spark.read.parquet(f"{path}/{name}")
    return KmerIndex(IndexParams(**meta["params"]), table("units"), table("postings").drop("slice"), table("promiscuous"), table("dense").drop("slice") if meta["dense"] else None)


def index_from_signatures(signatures: DataFrame, params: IndexParams) -> KmerIndex:
    """An index with a unit per signature (``name, hash``), every share 1 and no cut."""
    from ..functions.kmers import TOP
    from ..operators.graph import dense_ids
    from ..operators.index_build import pin_columns

    units = dense_ids(signatures.select(F.col("name").alias("unit_key")).distinct(), ["unit_key"], "unit")
    rows = signatures.join(units, signatures["name"] == units["unit_key"]).select("hash", "unit").distinct()
    groups = rows.groupBy("hash").agg(F.count(F.lit(1)).alias("n_groups"))
    postings = rows.join(groups, "hash").select("hash", "unit", F.lit(1.0).alias("p_in"), F.lit(15).alias("pin_q"), "n_groups", (-F.log2("n_groups")).alias("score"))
    table = units.join(pin_columns(postings), "unit").withColumns({"t_g": F.lit(1.0), "bound_g": F.lit(TOP - 1), "n_members": F.lit(1), "n_kmers": F.col("m_g")})
    return KmerIndex(params, table, postings, postings.where("false").select("hash"))
