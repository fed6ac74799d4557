"""Union and scatter fits against planted parameters, and their cells against a plain loop."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandlake.operators import unions
from strandlake.operators.identity import SurvivalModel

MODEL = SurvivalModel(11, concentration=4.0, region=5.0, ends=0.97)


def cells_of(df):
    return unions.union_cells(df, *(F.col(c) for c in ("identity", "survival", "members", "windows")))


def planted(n, union, slope, spread, power, seed):
    rng = np.random.default_rng(seed)
    a = rng.uniform(0.5, 0.99, n)
    m = np.floor(np.exp(rng.uniform(math.log(2), math.log(300), n)))
    windows = np.full(n, 4000.0)
    s = 1 - (1 - MODEL.survival(a)) ** (m ** np.maximum(union + slope * (a - 0.8), 0))
    y = s + rng.normal(size=n) * spread * s * (1 - s) ** power * (1 - 1 / m)
    return pd.DataFrame({"identity": a, "survival": y, "members": m, "windows": windows})


def test_cells_equal_a_plain_loop(spark):
    rows = planted(500, 0.3, 0.5, 0.05, 0.5, 1).values.tolist() + [[0.9, float("nan"), 3.0, 5.0], [0.9, None, 3.0, 5.0], [None, 0.5, 3.0, 5.0], [1.5, 0.5, 3.0, 5.0], [0.9, 0.5, 1e30, 0.0], [1.0, 3.0, 0.0, 9.0]]
    want = {}
    for a, y, m, w in rows:
        if None in (a, y) or y != y or not 0 <= a <= 1:
            continue
        y, m, w = min(y, 1.0), max(m, 1.0), max(w, 1.0)
        key = (math.floor(a * 400 + 1e-9), int(m) if m < 128 else 128 + min(math.floor(math.log2(m) * 8), 192))
        cell = want.setdefault(key, np.zeros(6))
        cell += (1, a, math.log(m), y, y * y, 1 / w)
    got = cells_of(spark.createDataFrame(rows, "identity double, survival double, members double, windows double")).collect()
    assert {(r["cell"], r["size"]) for r in got} == set(want)
    for r in got:
        assert np.allclose([r[c] for c in ("n", "a", "log_m", "y", "yy", "per_window")], want[r["cell"], r["size"]])


@pytest.mark.parametrize("union, slope", [(0.3, 0.5), (0.15, 0.2)])
def test_planted_union_is_found(spark, union, slope):
    cells = cells_of(spark.createDataFrame(planted(60_000, union, slope, 0.02, 0.5, 2)))
    found, left = unions.fit_union(cells, MODEL)
    assert abs(found.union / union - 1) < 0.05 and abs(found.union_slope / slope - 1) < 0.05
    assert left["rmse"] < 0.003 < left["rmse_independent"] and left["groups"] > 100


def test_planted_scatter_is_found(spark):
    from dataclasses import replace

    df = planted(60_000, 0.3, 0.5, 0.2, 0.9, 3)
    df["windows"] = 1e9  # windows alone scatter nothing, so all of it is the union's
    df["survival"] = df["survival"].clip(upper=1)
    cells = cells_of(spark.createDataFrame(df))
    found, left = unions.fit_scatter(cells, replace(MODEL, union=0.3, union_slope=0.5))
    assert abs(found.spread / 0.2 - 1) < 0.05 and abs(found.spread_power / 0.9 - 1) < 0.05
    assert left["rmse_log"] < 0.2 < left["rmse_log_without"]


def test_nothing_to_fit(spark):
    cells = cells_of(spark.createDataFrame([], "identity double, survival double, members double, windows double"))
    assert cells.count() == 0
    for fit in (unions.fit_union, unions.fit_scatter):
        with pytest.raises(ValueError):
            fit(cells, MODEL)
