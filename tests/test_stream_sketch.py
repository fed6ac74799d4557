"""Distinct counts of a stream in bounded state: against a plain loop, in error, in size, and after a stop between batches."""

import os

import numpy as np
import pytest

from strandlake.streaming import streams


def folder_of(spark, tmp_path, parts):
    for i, x in enumerate(parts):
        spark.createDataFrame([(int(v),) for v in x], "hash long").coalesce(1).write.parquet(str(tmp_path / "in" / f"part={i}"))
    return str(tmp_path / "in" / "part=*")


def plain(x, ranges, keep):
    out = {}
    for h in sorted({int(v) % 2**64 for v in x}):
        out.setdefault(h * ranges >> 64, []).append(h)
    rows = {}
    for r, hs in out.items():
        last = (hs[:keep][-1] - (r * 2**64 // ranges) + 1) / (2**64 / ranges)
        rows[r] = (min(len(hs), keep), round(last, 12), float(len(hs)) if len(hs) < keep else round((keep - 1) / last, 6))
    return rows


def rows_of(written):
    return {r["range"]: (r["kept"], round(r["last"], 12), round(r["distinct"], 6) if r["distinct"] % 1 else r["distinct"]) for r in streams.latest(written, ["range"]).collect()}


@pytest.fixture
def parts():
    x = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 40_000, dtype=np.int64)
    return [x[:15_000], x[10_000:25_000], x[:0], x[25_000:], [-1, 0, 2**63 - 1, -(2**63), 0]]


def test_running_sketch_survives_a_stop(spark, tmp_path, parts):
    path, flag = folder_of(spark, tmp_path, parts), str(tmp_path / "stop")
    place = str(tmp_path / "state")
    schema = spark.read.parquet(path).schema

    def stream():
        read = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)

        def watched(batches):
            for b in batches:
                if os.path.exists(flag) and (b["hash"] == -1).any():
                    raise RuntimeError("stopped")
                yield b

        return streams.stream_least_hashes(read.mapInPandas(watched, "hash long"), ranges=4, keep=1024)

    open(flag, "w").close()
    with pytest.raises(Exception):
        streams.drained(stream(), "update", place=place)
    os.rename(flag, flag + "ped")
    written = streams.drained(stream(), "update", place=place)
    want = plain(np.concatenate([np.array(p, np.int64) for p in parts]), 4, 1024)
    got = rows_of(written)
    assert got == want
    assert written.agg({"kept": "max"}).first()[0] == 1024  # the state's bound, at every batch
    assert abs(sum(v[2] for v in got.values()) / 40_004 - 1) < 4 / np.sqrt(4 * 1022)


def test_few_are_counted_exactly(spark, tmp_path):
    path = folder_of(spark, tmp_path, [[5, 5, -7], [5, 2**40]])
    read = spark.readStream.schema("hash long").option("maxFilesPerTrigger", 1).parquet(path)
    assert rows_of(streams.drained(streams.stream_least_hashes(read, ranges=1, keep=3), "update"))[0][0] == 3
    read = spark.readStream.schema("hash long").option("maxFilesPerTrigger", 1).parquet(path)
    assert sum(v[2] for v in rows_of(streams.drained(streams.stream_least_hashes(read), "update")).values()) == 3
    with pytest.raises(ValueError):
        streams.stream_least_hashes(read, ranges=3)
