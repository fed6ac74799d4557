"""Relational primitives: joins, aggregates, windows, sets and scalars on the star schema."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .tables import Registry, table

R = Registry()


@R.add("SELECT o_orderkey, c_name, round(o_totalprice, 2) AS price FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1995-03-15'")
def join_inner(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    return o.where("o_orderdate < timestamp_ntz'1995-03-15'").join(c.where("c_mktsegment = 'BUILDING'"), o.o_custkey == c.c_custkey).select("o_orderkey", "c_name", F.round("o_totalprice", 2).alias("price"))


@R.add("SELECT c_custkey, count(o_orderkey)::BIGINT AS n_orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def join_left(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    return c.join(o, c.c_custkey == o.o_custkey, "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n_orders"))


@R.add("SELECT n_name, count(s_suppkey)::BIGINT AS n FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name")
def join_right(spark, d):
    s, n = table(spark, d, "supplier"), table(spark, d, "nation")
    return s.join(n, s.s_nationkey == n.n_nationkey, "right").groupBy("n_name").agg(F.count("s_suppkey").alias("n"))


@R.add("""WITH c AS (SELECT c_nationkey AS k, count(*)::BIGINT AS customers FROM customer GROUP BY 1), s AS (SELECT s_nationkey AS k, count(*)::BIGINT AS suppliers FROM supplier WHERE s_acctbal > 5000 GROUP BY 1)
SELECT coalesce(c.k, s.k) AS nationkey, coalesce(customers, 0)::BIGINT AS customers, coalesce(suppliers, 0)::BIGINT AS suppliers FROM c FULL JOIN s ON c.k = s.k""")
def join_full(spark, d):
    c = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("nationkey")).agg(F.count(F.lit(1)).alias("customers"))
    s = table(spark, d, "supplier").where("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("nationkey")).agg(F.count(F.lit(1)).alias("suppliers"))
    return c.join(s, "nationkey", "full").select("nationkey", F.coalesce("customers", F.lit(0)).alias("customers"), F.coalesce("suppliers", F.lit(0)).alias("suppliers"))


@R.add("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def join_semi(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders").where("o_totalprice > 200000")
    return c.join(o, c.c_custkey == o.o_custkey, "left_semi").select("c_custkey", "c_name")


@R.add("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def join_anti(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").select("c_custkey")


@R.add("SELECT r_name, m.mate::INTEGER AS mate FROM region CROSS JOIN (SELECT unnest([0, 1]) AS mate) m")
def join_cross(spark, d):
    return table(spark, d, "region").crossJoin(spark.createDataFrame([(0,), (1,)], "mate int")).select("r_name", "mate")


@R.add("SELECT a.l_partkey AS a, b.l_partkey AS b, count(*)::BIGINT AS together FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey GROUP BY 1, 2 HAVING count(*) > 1")
def join_self_unequal(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    a, b = li.toDF("k", "a"), li.toDF("k", "b")
    return a.join(b, "k").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("together")).where("together > 1")


@R.add("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*)::BIGINT AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")
def aggregate_sums(spark, d):
    li = table(spark, d, "lineitem").where("l_shipdate <= timestamp_ntz'1998-09-02'")
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n"))


@R.add("SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F')::BIGINT AS closed, round(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'O'), 2) AS open_value FROM orders GROUP BY 1")
def aggregate_filtered(spark, d):
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count_if(F.col("o_orderstatus") == "F").alias("closed"), F.round(F.sum(F.when(F.col("o_orderstatus") == "O", F.col("o_totalprice"))), 2).alias("open_value"))


@R.add("SELECT event_type, count(DISTINCT user_id)::BIGINT AS users FROM events GROUP BY 1")
def aggregate_distinct(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count_distinct("user_id").alias("users"))


@R.add("SELECT p_brand, round(median(p_retailprice), 6) AS med, round(quantile_cont(p_retailprice, 0.9), 6) AS p90, round(stddev_samp(p_retailprice), 6) AS sd, round(var_pop(p_retailprice), 4) AS var FROM part GROUP BY 1")
def aggregate_quantiles(spark, d):
    return table(spark, d, "part").groupBy("p_brand").agg(F.round(F.median("p_retailprice"), 6).alias("med"), F.round(F.percentile("p_retailprice", 0.9), 6).alias("p90"), F.round(F.stddev_samp("p_retailprice"), 6).alias("sd"), F.round(F.var_pop("p_retailprice"), 4).alias("var"))


@R.add("SELECT r_name, n_name, count(*)::BIGINT AS n, round(sum(s_acctbal), 2) AS bal FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)")
def aggregate_rollup(spark, d):
    s, n, r = (table(spark, d, t) for t in ("supplier", "nation", "region"))
    return s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).rollup("r_name", "n_name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("s_acctbal"), 2).alias("bal"))


@R.add("SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F')::BIGINT AS f, count(*) FILTER (WHERE o_orderstatus = 'O')::BIGINT AS o, count(*) FILTER (WHERE o_orderstatus = 'P')::BIGINT AS p FROM orders GROUP BY 1")
def aggregate_pivot(spark, d):
    wide = table(spark, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count()
    return wide.select("o_orderpriority", *(F.coalesce(F.col(x), F.lit(0)).alias(x.lower()) for x in "FOP"))


@R.add("SELECT o_custkey, arg_max(o_orderkey, o_totalprice) AS dearest, min(o_orderkey) AS first_key FROM orders GROUP BY 1")
def aggregate_argmax(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", "o_totalprice").alias("dearest"), F.min("o_orderkey").alias("first_key"))


@R.add("SELECT l_returnflag, round(sum(l_extendedprice * l_discount) / sum(l_extendedprice), 8) AS wmean, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem GROUP BY 1")
def aggregate_weighted(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.sum(F.col("l_extendedprice") * F.col("l_discount")) / F.sum("l_extendedprice"), 8).alias("wmean"), F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("r"))


@R.add("SELECT l_orderkey, array_to_string(list_sort(list(DISTINCT l_returnflag)), ',') AS flags FROM lineitem GROUP BY 1")
def aggregate_lists(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.sort_array(F.collect_set("l_returnflag")), ",").alias("flags"))


@R.add("SELECT o_orderkey, dense_rank() OVER (ORDER BY o_orderpriority)::INTEGER AS dense, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)::INTEGER AS rn, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority)::INTEGER AS rk FROM orders")
def window_ranks(spark, d):
    o = table(spark, d, "orders")
    # The few priorities are ranked on their own, so no window holds all orders.
    dense = o.select("o_orderpriority").distinct().withColumn("dense", F.row_number().over(Window.orderBy("o_orderpriority")))
    own = Window.partitionBy("o_custkey")
    return o.join(dense, "o_orderpriority").select("o_orderkey", "dense", F.row_number().over(own.orderBy("o_orderdate", "o_orderkey")).alias("rn"), F.rank().over(own.orderBy("o_orderpriority")).alias("rk"))


@R.add("SELECT o_orderkey, coalesce(lag(o_orderkey) OVER w, -1) AS before, coalesce(lead(o_orderkey, 2) OVER w, -1) AS after, round(sum(o_totalprice) OVER w, 2) AS running FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def window_shift_running(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", F.coalesce(F.lag("o_orderkey").over(w), F.lit(-1)).alias("before"), F.coalesce(F.lead("o_orderkey", 2).over(w), F.lit(-1)).alias("after"), F.round(F.sum("o_totalprice").over(w.rowsBetween(Window.unboundedPreceding, 0)), 2).alias("running"))


@R.add("SELECT event_id, min(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS least, min(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM events")
def window_sliding_min(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select("event_id", F.min("value").over(w.rowsBetween(0, 4)).alias("least"), F.min("value").over(w.rowsBetween(0, Window.unboundedFollowing)).alias("rest"))


@R.add("SELECT l_orderkey, l_linenumber, round(l_extendedprice / sum(l_extendedprice) OVER (PARTITION BY l_orderkey), 6) AS share FROM lineitem")
def window_share(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") / F.sum("l_extendedprice").over(Window.partitionBy("l_orderkey")), 6).alias("share"))


@R.add("SELECT c_custkey, ntile(3) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey)::INTEGER AS tile FROM customer")
def window_ntile(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.ntile(3).over(Window.partitionBy("c_nationkey").orderBy("c_acctbal", "c_custkey")).alias("tile"))


@R.add("SELECT p_type, p_partkey, p_retailprice FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) AS r FROM part) WHERE r <= 3")
def top_per_group(spark, d):
    from ..operators.evaluate import top_per_group as top

    return top(table(spark, d, "part"), ["p_type"], [F.desc("p_retailprice"), "p_partkey"], 3).select("p_type", "p_partkey", "p_retailprice")


@R.add("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def top_overall(spark, d):
    return table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20).select("o_orderkey", "o_totalprice")


@R.add("SELECT c_nationkey AS nationkey, c_name AS name, NULL::DOUBLE AS bal FROM customer UNION ALL SELECT s_nationkey, s_name, s_acctbal FROM supplier")
def union_diagonal(spark, d):
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("nationkey"), F.col("c_name").alias("name"))
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("nationkey"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("bal"))
    return c.unionByName(s, allowMissingColumns=True)


@R.add("SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem")
def distinct_rows(spark, d):
    return table(spark, d, "lineitem").select("l_suppkey", "l_returnflag").distinct()


@R.add("SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000")
def set_except(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).subtract(table(spark, d, "supplier").where("s_acctbal > 9000").select("s_nationkey"))


@R.add("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def set_intersect(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).intersect(table(spark, d, "supplier").select("s_nationkey"))


@R.add(r"""SELECT doc_id, regexp_replace(source, '[0-9]+', '#') AS masked, regexp_extract(source, '([0-9]+)', 1) AS num, substr(lang, 1, 1) AS initial, strlen(text)::INTEGER AS bytes, starts_with(source, 'src1') AS s1, contains(text, 'the') AS the, concat(lang, '/', source) AS label FROM documents""")
def scalar_strings(spark, d):
    return table(spark, d, "documents").select("doc_id", F.regexp_replace("source", "[0-9]+", "#").alias("masked"), F.regexp_extract("source", "([0-9]+)", 1).alias("num"), F.substring("lang", 1, 1).alias("initial"), F.octet_length("text").alias("bytes"), F.col("source").startswith("src1").alias("s1"), F.col("text").contains("the").alias("the"), F.format_string("%s/%s", "lang", "source").alias("label"))


@R.add("SELECT p_partkey, round(log2(p_retailprice), 6) AS l2, round(ln(1 + p_size), 6) AS l1p, round(exp(-p_size / 10.0), 6) AS e, round(power(p_size, 0.5), 6) AS root, greatest(p_size, 10) AS hi, least(p_size, 40) AS lo, floor(p_retailprice)::BIGINT AS fl FROM part")
def scalar_math(spark, d):
    return table(spark, d, "part").select("p_partkey", F.round(F.log2("p_retailprice"), 6).alias("l2"), F.round(F.log1p("p_size"), 6).alias("l1p"), F.round(F.exp(-F.col("p_size") / 10.0), 6).alias("e"), F.round(F.pow("p_size", F.lit(0.5)), 6).alias("root"), F.greatest("p_size", F.lit(10)).alias("hi"), F.least("p_size", F.lit(40)).alias("lo"), F.floor("p_retailprice").alias("fl"))


@R.add("SELECT event_id, coalesce(nullif(event_type, 'click'), 'none') AS kind, CASE WHEN value < 10 THEN 'low' WHEN value < 50 THEN 'mid' ELSE 'high' END AS level, (event_id & 7)::BIGINT AS low_bits, (event_id >> 3)::BIGINT AS shifted, xor(event_id, 5)::BIGINT AS flipped FROM events")
def scalar_case_bits(spark, d):
    v = F.col("value")
    return table(spark, d, "events").select("event_id", F.coalesce(F.nullif("event_type", F.lit("click")), F.lit("none")).alias("kind"), F.when(v < 10, "low").when(v < 50, "mid").otherwise("high").alias("level"), F.col("event_id").bitwiseAND(7).alias("low_bits"), F.shiftright("event_id", 3).alias("shifted"), F.col("event_id").bitwiseXOR(F.lit(5)).alias("flipped"))


@R.add("SELECT l_orderkey, l_linenumber, unnest(range(1, l_linenumber + 1))::INTEGER AS i FROM lineitem WHERE l_quantity BETWEEN 10 AND 12")
def explode_ranges(spark, d):
    return table(spark, d, "lineitem").where("l_quantity between 10 and 12").select("l_orderkey", "l_linenumber", F.explode(F.expr("sequence(1, l_linenumber)")).alias("i"))


@R.add("""WITH a AS (SELECT l_orderkey AS id, l_suppkey AS k, epoch(l_shipdate)::BIGINT // 86400 AS s, epoch(l_shipdate)::BIGINT // 86400 + l_quantity::BIGINT AS e FROM lineitem WHERE l_linenumber = 1),
b AS (SELECT l_orderkey AS id2, l_suppkey AS k, epoch(l_shipdate)::BIGINT // 86400 AS s2, epoch(l_shipdate)::BIGINT // 86400 + l_quantity::BIGINT AS e2 FROM lineitem WHERE l_linenumber = 2)
SELECT id, id2, least(e, e2) - greatest(s, s2) AS overlap FROM a JOIN b ON a.k = b.k AND s < e2 AND s2 < e""")
def interval_overlap(spark, d):
    from ..operators.evaluate import interval_overlaps

    li = table(spark, d, "lineitem")
    day = F.expr("cast(datediff(l_shipdate, date'1970-01-01') as bigint)")
    side = lambda n, *names: li.where(F.col("l_linenumber") == n).select(F.col("l_orderkey"), F.col("l_suppkey").alias("k"), day, day + F.col("l_quantity").cast("long")).toDF(*names)
    return interval_overlaps(side(1, "id", "k", "start", "end"), side(2, "id2", "k", "start2", "end2"), "k", 64).select("id", "id2", "overlap")


@R.add("SELECT c_nationkey, count(*)::BIGINT AS n FROM customer WHERE c_custkey % 7 = 3 AND c_mktsegment IN ('BUILDING', 'MACHINERY') GROUP BY 1")
def modulo_and_list_filter(spark, d):
    """A subset by modulo is the operator here, as in building a release's subset."""
    return table(spark, d, "customer").where((F.pmod("c_custkey", F.lit(7)) == 3) & F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))


@R.add("""SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY n_name""")
def star_join(spark, d):
    c, o, li, s, n, r = (table(spark, d, t) for t in ("customer", "orders", "lineitem", "supplier", "nation", "region"))
    joined = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(s, (li.l_suppkey == s.s_suppkey) & (c.c_nationkey == s.s_nationkey)).join(n, s.s_nationkey == n.n_nationkey).join(r.where("r_name = 'ASIA'"), n.n_regionkey == r.r_regionkey)
    return joined.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@R.add("SELECT l_suppkey AS unit, min(l_partkey) AS start_part, max(l_partkey) AS end_part, count(*)::BIGINT AS n FROM (SELECT l_suppkey, l_partkey, l_partkey - row_number() OVER (PARTITION BY l_suppkey ORDER BY l_partkey) AS g FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)) GROUP BY l_suppkey, g")
def gaps_and_islands(spark, d):
    from ..operators.pileup import gaps_to_ranges

    out = gaps_to_ranges(table(spark, d, "lineitem"), "l_suppkey", "l_partkey")
    return out.select(F.col("l_suppkey").alias("unit"), F.col("start").alias("start_part"), F.col("end").alias("end_part"), "n")
