"""Fits of components that are too large for one task: k-mers are stored with their units, and a step is a pass over them.

A step of expectation maximisation needs, of each unit, sums over its k-mers of what they give it of their hits. Tasks add
these up over the k-mers that they read, so that what is shuffled in a step is a few numbers a unit and task, and no row of
a k-mer. The steps themselves, and what extrapolates them, are those of the fits within one task. ``unit_blocks`` parts a
component's units instead.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import cut
from .graph import dense_ids

#: Fixed value: about as many rows (unit, k-mer) are a task of a pass, and at most as many are computed on at once, but for a k-mer of more.
TASK_ROWS = 1_000_000


def running_sum(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """``df`` with ``name``, the sum of ``value`` over the rows before in the order of ``keys`` (unique together): summed within range partitions and shifted by the partitions before."""
    placed = cut(df.repartitionByRange(*keys).withColumn("_p", F.spark_partition_id()))
    totals = placed.groupBy("_p").agg(F.sum(value).alias("_t"))  # a row per partition
    before = lambda window: F.coalesce(F.sum(window[0]).over(window[1].rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = totals.select("_p", before(("_t", Window.orderBy("_p"))).alias("_s"))
    own = placed.withColumn(name, before((value, Window.partitionBy("_p").orderBy(*keys))))
    return own.join(F.broadcast(shift), "_p").withColumn(name, F.col(name) + F.col("_s")).drop("_p", "_s")


def unit_positions(rows: DataFrame, rounds: int = 16) -> DataFrame:
    """``component, unit, n_rows, x``: places on a line at which units that share k-mers lie near each other.

    Places begin at random (by a hash); each moves half way to the mean, over the unit's shared k-mers, of where their
    other holders are. Centred and scaled within a component between rounds they turn towards the second eigenvector of
    that walk, whose order has small bandwidth. A round is two sums that are made map-side; no k-mer's holders meet in
    pairs.
    """
    n_rows = rows.groupBy("component", "unit").agg(F.count(F.lit(1)).alias("n_rows"))
    x = cut(n_rows.withColumn("x", F.pmod(F.xxhash64("unit"), F.lit(1_000_003)) / 1_000_003.0))
    several = rows.groupBy("hash").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    links = cut(rows.select("unit", "hash").join(several, "hash"))
    for i in range(rounds):
        of_kmer = links.join(x.select("unit", "x"), "unit").groupBy("hash").agg(F.sum("x").alias("_sum"))
        others = links.join(of_kmer, "hash").join(x.select("unit", "x"), "unit").groupBy("unit").agg(F.avg((F.col("_sum") - F.col("x")) / (F.col("_n") - 1)).alias("_x"))
        moved = x.join(others, "unit", "left").withColumn("x", (F.col("x") + F.coalesce("_x", "x")) / 2).drop("_x")
        scale = moved.groupBy("component").agg(F.avg("x").alias("_m"), F.stddev_pop("x").alias("_s"))
        x = moved.join(scale, "component").withColumn("x", F.round(F.when(F.col("_s") > 0, (F.col("x") - F.col("_m")) / F.col("_s")).otherwise(0.0), 9)).drop("_m", "_s")
        x = cut(x)
    return x


def unit_blocks(rows: DataFrame, most_rows: int, rounds: int = 16) -> DataFrame:
    """``component, unit, block``: consecutive units in the order of ``unit_positions`` with about ``most_rows`` rows together, over by one unit's at most; no block spans two components."""
    placed = running_sum(unit_positions(rows, rounds), ["component", "x", "unit"], "n_rows", "_before")
    first = placed.groupBy("component").agg(F.min("_before").alias("_first"))
    cell = placed.join(first, "component").select("component", "unit", F.floor((F.col("_before") - F.col("_first")) / most_rows).alias("_cell"))
    return cut(cell.select("component", "unit", F.xxhash64("component", "_cell").alias("block")))


def list_slices(batch, column: int, most: int = TASK_ROWS):
    """``batch`` in runs of rows whose lists have at most ``most`` items together, a longer list alone."""
    ends = np.cumsum(batch.column(column).value_lengths().to_numpy(zero_copy_only=False))
    lo = 0
    while lo < batch.num_rows:
        hi = max(int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, "right")), lo + 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


class StoredHits:
    """What fits ask of ``estimators.Hits``, of components that no task should hold (``rows``: ``component, unit, hash, hits`` and, with ``levels``, ``pin_q``; ``of_unit``: an aggregate of each unit's rows, as ``m_g`` or ``pin_hist``).

    A k-mer is stored as one row with its hits and the list of its units, dealt out by the k-mer. The model, the sums over
    it and ``of_unit`` are a few numbers a unit, and they alone reach the driver.
    """

    def __init__(self, rows: DataFrame, of_unit, levels: int = 0):
        key, self.levels = ["component", "unit"], levels
        own = rows.groupBy(*key).agg(of_unit.alias("own"), F.sum("hits").cast("double").alias("total"), F.count(F.lit(1)).alias("n"))
        coded = cut(dense_ids(own, key, "code"))
        model = coded.orderBy("code").toArrow()
        self.units, self.of_unit = model["unit"].to_numpy(), np.array(model["own"].to_pylist(), float).reshape(len(model), -1)
        self.m, self._total, self.n = self.of_unit[:, 0], model["total"].to_numpy(), len(model)
        self.part = np.unique(model["component"].to_numpy(), return_inverse=True)[1]
        at = F.struct(F.col("code").cast("int").alias("code"), (F.col("pin_q") if levels else F.lit(0)).cast("int").alias("level"))
        dealt = rows.join(coded.select(*key, "code"), key).groupBy("component", "hash").agg(F.max("hits").cast("double").alias("hits"), F.array_sort(F.collect_list(at)).alias("at"))
        tasks = -(-int(model["n"].to_numpy().sum()) // TASK_ROWS) if self.n else 1
        self._kmers = cut(dealt.select("hits", "at").coalesce(tasks))

    def total(self) -> np.ndarray:
        """Each unit's hits, those of others included."""
        return self._total

    def shared(self, w: np.ndarray, share: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """``Hits.shared`` by one pass."""
        n, width, names = self.n, max(self.levels, 1), [f"s{i}" for i in range(max(self.levels, 1) + 1)]

        def run(batches):
            import pyarrow as pa

            sums = np.zeros((n, width + 1))
            for batch in (x for b in batches for x in list_slices(b, 1)):
                size = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
                code, level = (c.to_numpy(zero_copy_only=False) for c in batch.column(1).flatten().flatten())
                own = w[code] if share is None else w[code] * share[level]
                mu = np.repeat(np.add.reduceat(own, np.cumsum(size) - size), size)
                part = np.divide(own, mu, out=np.zeros(len(own)), where=mu > 0)
                hits = np.repeat(batch.column(0).to_numpy(), size)
                sums[:, 0] += np.bincount(code, part * hits, n)
                sums[:, 1:] += np.bincount(code * width + level, part, n * width).reshape(n, width)
            seen = np.flatnonzero(sums.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(seen), *(pa.array(sums[seen, i]) for i in range(width + 1))], ["code", *names])

        parts = self._kmers.mapInArrow(run, "code long, " + ", ".join(f"{c} double" for c in names))
        got = parts.groupBy("code").agg(*(F.sum(c).alias(c) for c in names)).toArrow()
        out = np.zeros((n, width + 1))
        out[got["code"].to_numpy()] = np.stack([got[c].to_numpy() for c in names], axis=1)
        return out[:, 0], out[:, 1:] if self.levels else out[:, 1]
