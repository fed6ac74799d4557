"""Cutting long lineages with tables in the shared checkpoint folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: The folders written since the innermost ``scratch`` began.
_WRITTEN: ContextVar[list[str] | None] = ContextVar("written", default=None)


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder (``spark.checkpoint.dir``). A session on one machine that names none gets a temporary one; on a cluster that is an error, since executors would not see it."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        import tempfile

        sc.setCheckpointDir(tempfile.mkdtemp(prefix="strandlake-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet under the session's checkpoint folder and read back: what follows survives lost executors and keeps column pruning."""
    path = f"{checkpoint_folder(df.sparkSession)}/cut/{uuid.uuid4().hex}"
    if (written := _WRITTEN.get()) is not None:
        written.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Delete the tables that ``cut`` writes inside, at the end and on errors, but for those that ``kept`` passes on to what is around."""
    outer, own = _WRITTEN.get(), []
    token = _WRITTEN.set(own)
    try:
        yield own
    finally:
        _WRITTEN.reset(token)
        jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for path in own:
            if path.startswith("kept:"):
                if outer is not None:
                    outer.append(path[5:])
            else:
                folder = jvm.org.apache.hadoop.fs.Path(path)
                folder.getFileSystem(conf).delete(folder, True)


def kept(df: DataFrame) -> DataFrame:
    """``cut``, but outside the innermost ``scratch``: the table outlives it."""
    written = _WRITTEN.get()
    found = cut(df)
    if written is not None:
        written[-1] = f"kept:{written[-1]}"
    return found
