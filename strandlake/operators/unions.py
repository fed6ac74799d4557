"""Fits of what several members of a unit add to the survival of k-mers: the union term and its scatter.

A DataFrame makes the sums of narrow cells of identity and number of members; their number has a bound that does not grow
with the pairs, and the fits are least squares over cells on the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .identity import PIVOT, SurvivalModel

# Fixed values, which fits rest on: where bands of members begin, and the widths of the identity bins that pairs are
# averaged over, for the union and for its scatter.
BANDS = (1, 2, 4, 11, 101)
UNION_BIN = 0.01
SCATTER_BIN = 0.05

#: Cells are this many to an identity of 1, and to a doubling of members from 128 on (fewer members have a cell each); members beyond 2 to this power share a cell.
PER_IDENTITY = 400
PER_DOUBLING = 8
MOST_DOUBLINGS = 24


def union_cells(pairs: DataFrame, identity: Column, survival: Column, members: Column, windows: Column) -> DataFrame:
    """``cell, size, n, a, log_m, y, yy, per_window``: sums over the pairs of a cell.

    ``cell`` numbers identities, ``size`` the (logarithmic) members. Pairs without a number in one of the columns, or with
    a NaN, take no part; survivals over 1 count as 1, members below 1 as 1. At most PER_IDENTITY + 1 times 129 + PER_DOUBLING *
    MOST_DOUBLINGS rows; sums are made map-side. Empty table: empty.
    """
    # ``least`` passes over a NaN, so the column itself is asked.
    some = pairs.select(*[c.cast("double").alias(n) for c, n in ((identity, "a"), (survival, "y"), (members, "m"), (windows, "w"))]).where(" and ".join(f"{c} is not null and not isnan({c})" for c in "aymw"))
    named = some.select("a", F.least("y", F.lit(1.0)).alias("y"), F.greatest("m", F.lit(1.0)).alias("m"), F.greatest("w", F.lit(1.0)).alias("w")).where("a between 0 and 1")
    # Bands begin at whole numbers of members, which must not share a cell with what is below: small numbers have their own.
    size = F.when(F.col("m") < 128, F.floor("m")).otherwise(F.least(F.floor(F.log2("m") * PER_DOUBLING), F.lit(PER_DOUBLING * MOST_DOUBLINGS)) + 128)
    return named.groupBy(F.floor(F.col("a") * PER_IDENTITY + 1e-9).cast("long").alias("cell"), size.cast("long").alias("size")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("a").alias("a"), F.sum(F.log("m")).alias("log_m"), F.sum("y").alias("y"), F.sum(F.col("y") * F.col("y")).alias("yy"), F.sum(1 / F.col("w")).alias("per_window")
    )


def least_squares(residuals: Callable[[np.ndarray], np.ndarray], start: list[float], steps: int = 200) -> tuple[np.ndarray, float]:
    """Where the sum of squares is least, from ``start``, and that sum: damped Gauss-Newton steps with numeric slopes."""
    x, damp = np.array(start, float), 1e-3
    r = residuals(x)
    for _ in range(steps):
        slopes = np.stack([(residuals(x + h) - residuals(x - h)) / 2e-5 for h in np.eye(len(x)) * 1e-5], axis=1)
        square = slopes.T @ slopes
        while damp < 1e12:
            move = np.linalg.lstsq(square + damp * np.diag(np.diag(square) + 1e-12), -slopes.T @ r, rcond=None)[0]
            tried = residuals(x + np.clip(move, -2, 2))
            if tried @ tried < r @ r:
                break
            damp *= 4
        else:
            break
        gain, x, r, damp = r @ r - tried @ tried, x + np.clip(move, -2, 2), tried, damp / 8
        if gain <= 1e-14 * max(float(r @ r), 1e-30):
            break
    return x, float(r @ r)


class _Cells:
    """Cells as arrays of means, and the groups (identity bin, band of members) of at least ``least`` pairs that they make up."""

    def __init__(self, cells: pd.DataFrame, width: float, least: int):
        n = cells["n"].to_numpy(float)
        a, m = cells["a"].to_numpy() / n, np.exp(cells["log_m"].to_numpy() / n)
        band = np.searchsorted(BANDS, m * (1 + 1e-9), side="right")
        step = round(width * PER_IDENTITY)
        _, group = np.unique(np.stack([cells["cell"].to_numpy() // step, band], axis=1), axis=0, return_inverse=True)
        ok = np.bincount(group.ravel(), n)[group.ravel()] >= least
        _, self.group = np.unique(group.ravel()[ok], return_inverse=True)
        self.n, self.a, self.m = n[ok], a[ok], m[ok]
        self.y, self.yy, self.windows = cells["y"].to_numpy()[ok], cells["yy"].to_numpy()[ok], n[ok] / cells["per_window"].to_numpy()[ok]
        self.count = np.bincount(self.group, self.n)
        self.weight = self.count / self.count.sum() if len(self.count) else self.count

    def mean(self, sums: np.ndarray) -> np.ndarray:
        return np.bincount(self.group, sums) / self.count


def _together(model: SurvivalModel, a: np.ndarray, m: np.ndarray, union: float, slope: float) -> np.ndarray:
    """The chance that any of a unit's members has a k-mer, by identity and members."""
    power = np.maximum(union + slope * (a - PIVOT), 0.0)
    return -np.expm1(m**power * np.log1p(-np.minimum(model.survival(a), 1 - 1e-15)))


def fit_union(cells: DataFrame, model: SurvivalModel, least_pairs: int = 20) -> tuple[SurvivalModel, dict[str, float]]:
    """``model`` (fitted to single members) with the union term of the pairs of several members in ``cells``, and what the fit leaves.

    Mean survivals of groups of at least ``least_pairs`` pairs, weighted by pairs, are matched in least squares over the
    logarithms of both terms, which so stay above 0. Raises ValueError if there is no such group.
    """
    c = _Cells(cells.where("size > 1").toPandas(), UNION_BIN, least_pairs)  # bounded, see union_cells
    if not len(c.count):
        raise ValueError(f"no group of {least_pairs} pairs of several members")
    seen, root = c.mean(c.y), np.sqrt(c.weight)

    def residuals(x):
        return root * (seen - c.mean(c.n * _together(model, c.a, c.m, *np.exp(np.clip(x, -30, 5)))))

    x, loss = min((least_squares(residuals, [math.log(u), math.log(s)]) for u in (0.05, 0.2, 0.6) for s in (0.02, 0.4, 2.0)), key=lambda r: r[1])
    union, slope = np.exp(np.clip(x, -30, 5)).tolist()
    independent = root * (seen - c.mean(c.n * c.a**model.k))
    return replace(model, union=union, union_slope=slope), {"groups": len(c.count), "rmse": math.sqrt(loss), "rmse_independent": math.sqrt(independent @ independent)}


def fit_scatter(cells: DataFrame, model: SurvivalModel, least_pairs: int = 50) -> tuple[SurvivalModel, dict[str, float]]:
    """``model`` (with its union term) with the scatter of such unions, and what the fit leaves on the logarithmic scale with and without.

    Of a group of pairs the mean square about the model is matched by what windows alone scatter plus the square of spread
    * S (1 - S)^power (1 - 1 / members). Raises ValueError if no group has ``least_pairs`` pairs.
    """
    c = _Cells(cells.where("size > 1").toPandas(), SCATTER_BIN, least_pairs)  # bounded, see union_cells
    if not len(c.count):
        raise ValueError(f"no group of {least_pairs} pairs of several members")
    s = np.minimum(_together(model, c.a, c.m, model.union, model.union_slope), 1 - 1e-9)
    rows = np.interp(-s, -model.survivals, np.arange(len(model.survivals)))
    low = np.minimum(rows.astype(int), len(model.survivals) - 2)
    near = np.array([[model.inflation(r, 1.0, w), model.inflation(r + 1, 1.0, w)] for r, w in zip(low.tolist(), c.windows.tolist())])
    inflation = near[:, 0] + (rows - low) * (near[:, 1] - near[:, 0])
    alone = c.mean(c.n * s * (1 - s) * inflation / c.windows)
    seen = np.maximum(c.mean(c.yy - 2 * s * c.y + c.n * s * s), 1e-300)
    root = np.sqrt(c.weight)

    def residuals(x):
        spread, power = np.exp(np.clip(x, -30, 5))
        return root * (np.log(seen) - np.log(alone + c.mean(c.n * (spread * s * (1 - s) ** power * (1 - 1 / c.m)) ** 2)))

    x, loss = min((least_squares(residuals, [math.log(u), math.log(p)]) for u in (0.1, 0.3) for p in (0.3, 1.0)), key=lambda r: r[1])
    spread, power = np.exp(np.clip(x, -30, 5)).tolist()
    without = root * (np.log(seen) - np.log(alone))
    return replace(model, spread=spread, spread_power=power), {"groups": len(c.count), "rmse_log": math.sqrt(loss), "rmse_log_without": math.sqrt(without @ without)}
