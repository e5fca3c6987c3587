"""Ordinary relational operators on the star schema, as the planner's built-ins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import tables as T
from .registry import query


@query("r_pricing_summary", "SELECT l_returnflag, l_linestatus, CAST(sum(l_quantity) AS BIGINT) AS qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def pricing(spark, sf):
    l = T.table(spark, sf, "lineitem").where(F.col("l_shipdate") <= F.to_timestamp_ntz(F.lit("1998-09-02 00:00:00")))  # noqa: E741
    return l.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").cast("long").alias("qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("disc"), F.count(F.lit(1)).alias("n")
    )


@query("r_revenue_by_nation", "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(DISTINCT o_orderkey) AS orders FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def by_nation(spark, sf):
    """Lines shrink to one row per order before they meet the orders; only the two dimensions are broadcast, by the planner's own size check."""
    l = T.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("rev"))  # noqa: E741
    o, c, n = (T.table(spark, sf, t) for t in ("orders", "customer", "nation"))
    j = l.join(o, l.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    return j.groupBy("n_name").agg(F.round(F.sum("rev"), 2).alias("revenue"), F.count("o_orderkey").alias("orders"))


@query("r_left_join", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def left(spark, sf):
    o = T.table(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    c = T.table(spark, sf, "customer")
    return c.join(o, c.c_custkey == o.o_custkey, "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"))


@query("r_full_join", "SELECT coalesce(a.k, b.k) AS k, a.n AS parts, b.n AS suppliers FROM (SELECT p_size AS k, count(*) AS n FROM part GROUP BY 1) a FULL JOIN (SELECT s_nationkey + 30 AS k, count(*) AS n FROM supplier GROUP BY 1) b ON a.k = b.k")
def full(spark, sf):
    a = T.table(spark, sf, "part").groupBy(F.col("p_size").alias("k")).agg(F.count(F.lit(1)).alias("parts"))
    b = T.table(spark, sf, "supplier").groupBy((F.col("s_nationkey") + 30).alias("k")).agg(F.count(F.lit(1)).alias("suppliers"))
    return a.join(b, "k", "full")


@query("r_right_join", "SELECT n_nationkey, n_name, s_suppkey FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey AND s_acctbal > 5000")
def right(spark, sf):
    s = T.table(spark, sf, "supplier").where("s_acctbal > 5000")
    n = T.table(spark, sf, "nation")
    return s.join(n, s.s_nationkey == n.n_nationkey, "right").select("n_nationkey", "n_name", "s_suppkey")


@query("r_semi_anti", "SELECT o_orderpriority, CAST(sum(CASE WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') THEN 1 ELSE 0 END) AS BIGINT) AS returned, CAST(sum(CASE WHEN NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') THEN 1 ELSE 0 END) AS BIGINT) AS kept FROM orders GROUP BY 1")
def semi_anti(spark, sf):
    o, r = T.table(spark, sf, "orders"), T.table(spark, sf, "lineitem").where("l_returnflag = 'R'").select("l_orderkey")
    key = o.o_orderkey == r.l_orderkey
    yes = o.join(r, key, "left_semi").select("o_orderpriority", F.lit(1).alias("y"), F.lit(0).alias("n"))
    no = o.join(r, key, "left_anti").select("o_orderpriority", F.lit(0).alias("y"), F.lit(1).alias("n"))
    return yes.unionAll(no).groupBy("o_orderpriority").agg(F.sum("y").alias("returned"), F.sum("n").alias("kept"))


@query("r_range_join", "SELECT r.lo, count(*) AS n, round(sum(value), 4) AS total FROM events JOIN (SELECT unnest(range(0, 500, 50)) AS lo) r ON value >= r.lo AND value < r.lo + 50 GROUP BY r.lo")
def range_join(spark, sf):
    """Equal-width ranges become an equi-key; values outside all ten ranges join with none."""
    e = T.table(spark, sf, "events").where("value >= 0 and value < 500")
    near = F.floor(F.col("value") / 50) * 50
    lo = F.when(F.col("value") < near, near - 50).otherwise(near).alias("lo")  # the division may round up to the next range
    return e.groupBy(lo).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("r_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS qty FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube(spark, sf):
    return T.table(spark, sf, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").cast("long").alias("qty"))


@query("r_rollup", "SELECT p_brand, p_size % 5 AS s, count(*) AS n FROM part GROUP BY ROLLUP (p_brand, p_size % 5)")
def rollup(spark, sf):
    return T.table(spark, sf, "part").withColumn("s", F.col("p_size") % 5).rollup("p_brand", "s").agg(F.count(F.lit(1)).alias("n"))


@query("r_grouping_sets", "SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY GROUPING SETS ((c_mktsegment), (c_nationkey), ())")
def grouping_sets(spark, sf):
    c = T.table(spark, sf, "customer")
    return c.groupingSets([[c.c_mktsegment], [c.c_nationkey], []], c.c_mktsegment, c.c_nationkey).agg(F.count(F.lit(1)).alias("n"))


@query("r_distinct_aggregates", "SELECT event_type, count(DISTINCT user_id) AS users, count(DISTINCT CAST(floor(value) AS BIGINT)) AS amounts FROM events GROUP BY event_type")
def distinct_aggs(spark, sf):
    return T.table(spark, sf, "events").groupBy("event_type").agg(F.countDistinct("user_id").alias("users"), F.countDistinct(F.floor("value")).alias("amounts"))


@query("r_filtered_aggregates", "SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS clicks, round(max(value) FILTER (WHERE event_type <> 'click'), 4) AS top, bool_or(value > 480) AS large FROM events GROUP BY user_id")
def filtered(spark, sf):
    click = F.col("event_type") == "click"
    return T.table(spark, sf, "events").groupBy("user_id").agg(F.count_if(click).alias("clicks"), F.round(F.max(F.when(~click, F.col("value"))), 4).alias("top"), F.bool_or(F.col("value") > 480).alias("large"))


@query("r_approx_sketches")
def sketches(spark, sf):
    """Approximate distinct counts and quantiles (rows only: the sketches are the engine's own)."""
    return T.table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey").alias("parts"), F.percentile_approx("l_extendedprice", 0.5).alias("median"))


@query("r_ranking", "SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER w AS rk, dense_rank() OVER w AS dr, ntile(4) OVER w AS nt FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)")
def ranking(spark, sf):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return T.table(spark, sf, "orders").select("o_orderkey", *[f.over(w).cast("long").alias(n) for f, n in ((F.row_number(), "rn"), (F.rank(), "rk"), (F.dense_rank(), "dr"), (F.ntile(4), "nt"))])


@query("r_frame_specs", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 1 FOLLOWING), 4) AS around, round(value - first_value(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 4) AS since_first, round(lead(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 4) AS following FROM events")
def frame_specs(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return T.table(spark, sf, "events").select("event_id", F.round(F.sum("value").over(w.rowsBetween(-3, 1)), 4).alias("around"), F.round(F.col("value") - F.first("value").over(w), 4).alias("since_first"), F.round(F.lead("value").over(w), 4).alias("following"))


@query("r_range_frame", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) AS day FROM events")
def range_frame(spark, sf):
    w = Window.partitionBy("user_id").orderBy("t").rangeBetween(-86_400_000_000, 0)
    return T.table(spark, sf, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp"))).select("event_id", F.count(F.lit(1)).over(w).alias("day"))


@query("r_top_k_per_group", "SELECT c_mktsegment, c_custkey, c_acctbal FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS k FROM customer) WHERE k <= 3")
def top_k(spark, sf):
    """Top three of each group: the planner keeps a bounded heap before the shuffle (window group limit)."""
    w = Window.partitionBy("c_mktsegment").orderBy(F.desc("c_acctbal"), "c_custkey")
    return T.table(spark, sf, "customer").withColumn("k", F.row_number().over(w)).where("k <= 3").select("c_mktsegment", "c_custkey", "c_acctbal")


@query("r_pivot", "SELECT l_returnflag, count(*) FILTER (WHERE l_linestatus = 'O') AS O, count(*) FILTER (WHERE l_linestatus = 'F') AS F FROM lineitem GROUP BY 1")
def pivot(spark, sf):
    return T.table(spark, sf, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["O", "F"]).agg(F.count(F.lit(1))).select("l_returnflag", F.coalesce("O", F.lit(0)).alias("O"), F.coalesce("F", F.lit(0)).alias("F"))


@query("r_unpivot", "SELECT p_partkey, 'size' AS field, CAST(p_size AS DOUBLE) AS v FROM part UNION ALL SELECT p_partkey, 'price', p_retailprice FROM part")
def unpivot(spark, sf):
    p = T.table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    return p.unpivot("p_partkey", ["size", "price"], "field", "v")


@query("r_set_operations", "(SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 8000) UNION SELECT r_regionkey + 100 FROM region")
def set_ops(spark, sf):
    c, s, r = T.table(spark, sf, "customer"), T.table(spark, sf, "supplier"), T.table(spark, sf, "region")
    return c.select(F.col("c_nationkey").alias("k")).subtract(s.where("s_acctbal > 8000").select("s_nationkey")).union(r.select((F.col("r_regionkey") + 100).alias("k"))).distinct()


@query("r_lateral_lookup", "SELECT n_nationkey, s_suppkey, s_acctbal FROM (SELECT n_nationkey, s_suppkey, s_acctbal, row_number() OVER (PARTITION BY n_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS k FROM nation JOIN supplier ON s_nationkey = n_nationkey) WHERE k = 1")
def lateral(spark, sf):
    """The best match for each row of a dimension: a max aggregate, then a lookup."""
    n, s = T.table(spark, sf, "nation"), T.table(spark, sf, "supplier")
    best = s.groupBy("s_nationkey").agg(F.max(F.struct("s_acctbal", (-F.col("s_suppkey")).alias("k"))).alias("m"))
    return n.join(best, n.n_nationkey == best.s_nationkey).select("n_nationkey", (-F.col("m.k")).alias("s_suppkey"), F.col("m.s_acctbal").alias("s_acctbal"))


@query("r_dates", "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, CAST(date_trunc('month', o_orderdate) AS DATE) AS first_day, CAST(o_orderdate AS DATE) + 30 AS due, dayofyear(o_orderdate) AS doy FROM orders")
def dates(spark, sf):
    d = F.col("o_orderdate")
    return T.table(spark, sf, "orders").select("o_orderkey", F.year(d).alias("y"), F.month(d).alias("m"), F.trunc(d.cast("date"), "month").alias("first_day"), F.date_add(d.cast("date"), 30).alias("due"), F.dayofyear(d).alias("doy"))


@query("r_regression", "SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept, round(corr(l_extendedprice, l_quantity), 6) AS corr FROM lineitem GROUP BY 1")
def regression(spark, sf):
    y, x = F.col("l_extendedprice"), F.col("l_quantity")
    return T.table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.round(F.regr_slope(y, x), 4).alias("slope"), F.round(F.regr_intercept(y, x), 2).alias("intercept"), F.round(F.corr(y, x), 6).alias("corr"))
