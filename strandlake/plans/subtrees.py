"""Queries over nested leaf ranges: parts in the order of their keys are the leaves of a tree that halves at powers of two."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import subtrees
from .tables import Registry, table

R = Registry()


def _leaves(spark, d) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").cast("long").alias("pos"), F.col("p_size").cast("long").alias("size"))


def _nodes(leaves: DataFrame) -> DataFrame:
    """Ranges [i * 2^j, (i + 1) * 2^j) cut at the number of leaves, each once, with the next wider one."""
    top = leaves.agg(F.max("pos").alias("_top"))  # one row
    levels = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.col("_top") + 1, F.lit(2)))).cast("int"))
    starts = leaves.crossJoin(F.broadcast(top)).select("pos", "_top", F.explode(levels).alias("j")).where(F.expr("pos & (shiftleft(1L, j) - 1) = 0"))

    def ranged(j):
        lo = F.expr(f"shiftleft(shiftright(pos, {j}), {j})")
        return lo, F.least(lo + F.expr(f"shiftleft(1L, {j})"), F.col("_top") + 1)

    (lo, hi), (up_lo, up_hi) = ranged("j"), ranged("(j + 1)")
    rows = starts.select(lo.alias("lo"), hi.alias("hi"), up_lo.alias("up_lo"), up_hi.alias("up_hi"), "_top")
    whole = (F.col("lo") == 0) & (F.col("hi") == F.col("_top") + 1)
    inner = rows.where(~whole & ((F.col("up_lo") != F.col("lo")) | (F.col("up_hi") != F.col("hi")))).drop("_top")
    none = F.lit(None).cast("long")
    return inner.unionByName(top.select(F.lit(0).cast("long").alias("lo"), (F.col("_top") + 1).alias("hi"), none.alias("up_lo"), none.alias("up_hi"))).distinct()


_LEAVES = "leaf AS (SELECT p_partkey AS pos, p_size::BIGINT AS size, p_size % 7 = 0 AS chosen FROM part), n AS (SELECT max(pos) + 1 AS n FROM leaf)"


@R.add(f"""WITH RECURSIVE {_LEAVES}, total AS (SELECT pos, sum(size) OVER (ORDER BY pos)::BIGINT AS upto FROM leaf),
walk AS (SELECT 0::BIGINT AS lo, n AS hi, ceil(log2(greatest(n, 2)))::INTEGER AS j, upto AS size FROM n JOIN total ON pos = n - 1 UNION ALL
  SELECT c.lo, c.hi, c.j, (b.upto - coalesce(a.upto, 0)) FROM (
    SELECT lo, least(lo + (1::BIGINT << greatest(j - 1, 0)), hi) AS hi, j - 1 AS j FROM walk WHERE size > 200 AND hi - lo > 1
    UNION ALL SELECT lo + (1::BIGINT << greatest(j - 1, 0)), hi, j - 1 FROM walk WHERE size > 200 AND hi - lo > 1 AND lo + (1::BIGINT << greatest(j - 1, 0)) < hi) c
  JOIN total b ON b.pos = c.hi - 1 LEFT JOIN total a ON a.pos = c.lo - 1)
SELECT lo, hi, size FROM walk WHERE size <= 200 OR hi - lo = 1""")
def budget_chunks(spark, d):
    leaves = _leaves(spark, d)
    return subtrees.budget_chunks(_nodes(leaves), leaves, 200)


@R.add(f"""WITH RECURSIVE {_LEAVES}, rank AS (SELECT pos, count(*) FILTER (WHERE chosen) OVER (ORDER BY pos) - CASE WHEN chosen THEN 1 ELSE 0 END AS before, count(*) FILTER (WHERE chosen) OVER (ORDER BY pos) AS upto FROM leaf),
walk AS (SELECT 0::BIGINT AS lo, n AS hi, ceil(log2(greatest(n, 2)))::INTEGER AS j FROM n UNION ALL
  SELECT * FROM (SELECT lo, least(lo + (1::BIGINT << greatest(j - 1, 0)), hi) AS hi, j - 1 AS j FROM walk WHERE hi - lo > 1 AND j > 0
    UNION ALL SELECT lo + (1::BIGINT << greatest(j - 1, 0)), hi, j - 1 FROM walk WHERE hi - lo > 1 AND j > 0 AND lo + (1::BIGINT << greatest(j - 1, 0)) < hi)),
moved AS (SELECT DISTINCT a.before AS lo, b.upto AS hi FROM walk JOIN rank a ON a.pos = walk.lo JOIN rank b ON b.pos = walk.hi - 1 WHERE b.upto > a.before)
SELECT m.lo::BIGINT AS lo, m.hi::BIGINT AS hi, coalesce(arg_min(u.lo, u.hi - u.lo), -1)::BIGINT AS up_lo, coalesce(arg_min(u.hi, u.hi - u.lo), -1)::BIGINT AS up_hi
FROM moved m LEFT JOIN moved u ON u.lo <= m.lo AND m.hi <= u.hi AND u.hi - u.lo > m.hi - m.lo GROUP BY m.lo, m.hi""")
def restricted_tree(spark, d):
    """The tree over the parts whose size is a multiple of seven; -1 above the top."""
    leaves = _leaves(spark, d)
    found = subtrees.restricted_tree(_nodes(leaves), leaves, leaves.where(F.col("size") % 7 == 0))
    return found.fillna(-1, ["up_lo", "up_hi"])
