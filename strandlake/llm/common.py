"""What the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import cut as store

__all__ = ["FILE", "ROW", "TMP", "WORD", "identified", "plus", "store", "with_text"]

#: A word, as a regular expression that Java, Python and RE2 read alike.
WORD = r"[^\x20\x09-\x0D]+"
#: Prefix of the columns that operators add on the way, so that a table may have any other name.
TMP = "__sl_"


def with_text(batches, make: Callable):
    """Arrow batches with what ``make`` returns for the column ``text`` (UTF-8 bytes, null as None): names and arrays that replace or follow the columns."""
    import pyarrow as pa

    for batch in batches:
        at = batch.schema.get_field_index("text")
        new = make(batch.column(at).cast(pa.binary()).to_pylist())
        columns = {n: batch.column(i) for i, n in enumerate(batch.schema.names)} | new
        yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def plus(df: DataFrame, more: str):
    """The schema of ``df`` with the columns of the DDL string ``more``, which replace those of the same name in place."""
    from pyspark.sql.types import StructType

    new = {f.name: f for f in StructType.fromDDL(more).fields}
    kept = [new.pop(f.name, f) for f in df.schema.fields]
    return StructType(kept + list(new.values()))


FILE, ROW = f"{TMP}file", f"{TMP}row"


def identified(docs: DataFrame) -> DataFrame:
    """``docs`` with two columns, ``FILE`` and ``ROW``, that tell its rows apart however often it is read: the Parquet file and the place in it. A table that is no plain scan of files is stored first."""
    from pyspark.errors import AnalysisException

    def named(df):
        return df.select("*", F.xxhash64("_metadata.file_path").alias(FILE), F.col("_metadata.row_index").alias(ROW))

    try:
        return named(docs)
    except AnalysisException:
        return named(store(docs))
