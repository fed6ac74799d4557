import pytest


@pytest.fixture(scope="session")
def rows(spark):
    """Make a documents table of (doc_id, text[, source]) with columns whose names operators use themselves."""

    def make(items, extra=True):
        full = [(i, t, "en", (s[0] if s else "a"), len(t or "")) for i, t, *s in items]
        df = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")
        if extra:
            from pyspark.sql import functions as F

            for name in ("n_lines", "hi", "lines", "sid", "block", "times", "words", "kept", "secrets", "entities", "path", "node", "class_id", "rank", "salt", "length", "piece", "host", "key", "first", "taken"):
                df = df.withColumn(name, F.lit("clash"))
        return df

    return make


@pytest.fixture(scope="session")
def folder(tmp_path_factory, spark):
    """Write tables to a folder that queries read."""

    def make(**tables):
        path = tmp_path_factory.mktemp("sf")
        for name, df in tables.items():
            df.write.parquet(f"{path}/{name}.parquet")
        return str(path)

    return make
