"""A corpus from raw documents to packed sequences: five stages, each of which works on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm.common import store
from strandlake.llm.jaccard import one_of_each
from strandlake.llm.line_dedup import dedupe_lines
from strandlake.llm.mixing import mix_documents
from strandlake.llm.packing import pack_documents
from strandlake.llm.quality import judge, train_field

#: Why there is no SQL: a trained labelling, a randomised join and a numeric fit are not expressible; tests compare with plain loops.
ORACLE_SQL = None


def with_length(docs: DataFrame, text: DataFrame) -> DataFrame:
    """``text`` with the columns of ``docs`` and ``n_chars`` counted anew."""
    return text.select(*(F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; the line field is trained on the labelled documents among ``docs``."""
    field = train_field(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judge(docs, field).where("kept").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three documents share stay in one of them."""
    return with_length(docs, dedupe_lines(docs))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often, and as much of them, as the mix of sources takes."""
    return mix_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their place in a sequence."""
    return pack_documents(docs)


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("ngram_jaccard_join", jaccard_join), ("mixing_sources", mixing), ("best_fit_packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = store(docs)
    return docs
