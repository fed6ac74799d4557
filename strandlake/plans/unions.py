"""Queries over pairs of identity and survival; sales stand for pairs: their discount for divergence, their number in the order for members."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import cut
from ..operators import unions
from ..operators.identity import SurvivalModel
from .tables import Registry, table

R = Registry()

#: The model of single members.
MODEL = SurvivalModel(5, concentration=4.0, region=5.0)


def _cells(spark, d) -> DataFrame:
    """Survivals are k-th powers of identities, several members together, give or take a hundredth by the sale's tax."""
    sales = table(spark, d, "lineitem").select((1 - F.col("l_discount").cast("double") * 4 - F.col("l_quantity").cast("double") / 1000).alias("a"), (F.col("l_linenumber") + 1).alias("m"), ((F.col("l_tax").cast("double") - 0.04) / 4).alias("e"), F.col("l_quantity").cast("double").alias("w"))
    return unions.union_cells(sales, F.col("a"), 1 - F.pow(1 - F.pow("a", F.lit(5.0)), F.pow("m", F.lit(0.4))) + F.col("e"), F.col("m"), F.col("w") * 100)


@R.add("""WITH sale AS (SELECT 1 - l_discount::DOUBLE * 4 - l_quantity::DOUBLE / 1000 AS a, l_linenumber + 1 AS m, (l_tax::DOUBLE - 0.04::DOUBLE) / 4 AS e, l_quantity::DOUBLE * 100 AS w FROM lineitem),
pair AS (SELECT a, m, w, least(1 - pow(1 - pow(a, 5), pow(m, 0.4::DOUBLE)) + e, 1) AS y FROM sale WHERE a BETWEEN 0 AND 1)
SELECT floor(a * 400 + 1e-9::DOUBLE)::BIGINT AS cell, m::BIGINT AS size, count(*)::BIGINT AS n, round(sum(a), 4) AS a, round(sum(ln(m)), 4) AS log_m, round(sum(y), 4) AS y, round(sum(y * y), 4) AS yy, round(sum(1 / greatest(w, 1)), 4) AS per_window FROM pair GROUP BY ALL""")
def union_cells(spark, d):
    """The sums that fits of the union term rest on."""
    return _cells(spark, d).select("cell", "size", "n", *(F.round(c, 4).alias(c) for c in ("a", "log_m", "y", "yy", "per_window")))


@R.add()
def union_scatter_fit(spark, d):
    """Union and scatter terms of all sales."""
    cells = cut(_cells(spark, d))
    model, union = unions.fit_union(cells, MODEL)
    model, scatter = unions.fit_scatter(cells, model)
    values = {"union": model.union, "union_slope": model.union_slope, "spread": model.spread, "spread_power": model.spread_power, "rmse": union["rmse"], "rmse_log": scatter["rmse_log"]}
    return spark.createDataFrame([(k, float(v) if math.isfinite(v) else None) for k, v in values.items()], "term string, value double")
