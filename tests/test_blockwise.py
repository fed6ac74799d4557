"""Fits in blocks against fits of the whole component."""

import random

import numpy as np
import pandas as pd
import pytest

from strandlake.operators import blockwise, estimators


def chained(seed=3, units=14, own=6, shared=4):
    """Units in a line: each has k-mers of its own, some with its neighbours, a few with any unit."""
    rng = random.Random(seed)
    held = [(u, 1000 * u + i) for u in range(units) for i in range(own)]
    for u in range(units - 1):
        held += [(x, 100_000 + 10 * u + i) for x in (u, u + 1) for i in range(shared)]
    held += [(u, 900_000 + i) for i in range(3) for u in rng.sample(range(units), min(units, 4))]
    true = {u: rng.uniform(0.3, 6) for u in range(units)}
    holders: dict[int, list[int]] = {}
    for u, h in held:
        holders.setdefault(h, []).append(u)
    gen = np.random.default_rng(seed)
    hits = {h: int(gen.poisson(sum(true[u] for u in us))) for h, us in sorted(holders.items())}
    m = {u: sum(x == u for x, _ in held) + 2 for u in range(units)}
    rows = [(0, u, h, hits[h], m[u], (u + h) % 15 + 1) for u, h in held if hits[h]]
    out = pd.DataFrame(rows, columns=["component", "unit", "hash", "hits", "m_g", "pin_q"])
    hist = {u: np.bincount(g["pin_q"], minlength=16).tolist() for u, g in out.groupby("unit")}
    out["pin_hist"] = [[float(x) for x in hist[u]] for u in out["unit"]]
    return out


SCHEMA = "component long, unit long, hash long, hits long, m_g long, pin_q int, pin_hist array<double>"


@pytest.fixture(scope="module")
def kmers(spark):
    return spark.createDataFrame(chained(), SCHEMA).repartition(5)


def test_blocks_are_small_and_near(spark, kmers):
    found = blockwise.unit_blocks(kmers, 50).toPandas()
    rows = kmers.toPandas().merge(found[["unit", "block"]], on="unit")
    assert found["block"].nunique() >= 4 and sorted(found["unit"]) == list(range(14))
    assert rows.groupby("block").size().max() <= 50 + rows.groupby("unit").size().max()
    # Neighbours on the line lie nearer each other than the (n + 1) / 3 = 5 places of a random order.
    places = blockwise.unit_positions(kmers).orderBy("x", "unit").toPandas()["unit"].tolist()
    assert np.mean([abs(places.index(u) - places.index(u + 1)) for u in range(13)]) <= 3


def test_running_sum(spark):
    rows = [(k, random.Random(k).randrange(9)) for k in range(200)]
    got = {r["k"]: r["s"] for r in blockwise.running_sum(spark.createDataFrame(rows, "k long, v long").repartition(6), ["k"], "v", "s").collect()}
    assert got == {k: sum(v for j, v in rows if j < k) for k, _ in rows}


def held_against(whole, parts):
    a, b = whole.toPandas().set_index("unit").sort_index(), parts.toPandas().set_index("unit").sort_index()
    assert list(a.index) == list(b.index)
    for c in ("coverage", "present"):
        assert np.abs(a[c] - b[c]).max() <= 1e-6 * max(1.0, a[c].max()), (c, np.abs(a[c] - b[c]).max())


@pytest.mark.parametrize("kind", ["zero", "prior", "levels"])
def test_blocks_reach_the_fit_of_the_whole(spark, kmers, kind):
    run = {
        "zero": lambda n: estimators.em(kmers, zero_inflated=True, most_rows=n),
        "prior": lambda n: estimators.em(kmers, zero_inflated=True, prior=(3.0, 2.0), most_rows=n),
        "levels": lambda n: estimators.em_levels(kmers, most_rows=n),
    }[kind]
    held_against(run(None), run(50))


def test_small_components_stay_whole(spark, kmers):
    from pyspark.sql import functions as F

    two = kmers.unionByName(spark.createDataFrame(chained(4, 3), SCHEMA).selectExpr("1L as component", "unit + 100 as unit", "-hash as hash", "hits", "m_g", "pin_q", "pin_hist"))
    held_against(estimators.em(two), estimators.em(two, most_rows=60))
    assert estimators.em(two.where(F.lit(False)), most_rows=5).count() == 0


def test_steps_shuffle_sums_and_not_kmers(spark, monkeypatch):
    """Large components are fitted by passes, whose rows are k-mers with their units and are dealt out once; each leaps by itself."""
    from pyspark.sql import functions as F

    rows = spark.createDataFrame(chained(), SCHEMA)
    two = rows.unionByName(spark.createDataFrame(chained(5, 20), SCHEMA).selectExpr("1L as component", "unit + 100 as unit", "-hash - 1 as hash", "hits", "m_g", "pin_q", "pin_hist"))
    made, passes = [], []
    real = blockwise.StoredHits.shared
    monkeypatch.setattr(blockwise, "cut", lambda df, real=blockwise.cut: made.append(df.columns) or real(df))
    monkeypatch.setattr(blockwise.StoredHits, "shared", lambda self, *a: passes.append(self.n) or real(self, *a))
    held_against(estimators.em(two), estimators.em(two, most_rows=50))
    assert passes and set(passes) == {34} and made.count(["hits", "at"]) == 1 and len(made) == 2
    assert two.where(F.col("component") == 0).count() > 50
