"""Ordinary relational queries on the supplied tables; they have no counterpart in the reference."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.select import first_rank
from .views import table


def b_pricing(spark, d):
    li = table(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(price), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_discount"), F.count("*").alias("n")
    )


def b_star_join(spark, d):
    c, o, n, r = (table(spark, d, t) for t in ("customer", "orders", "nation", "region"))
    rows = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return rows.groupBy("r_name", "n_name").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def b_top_orders(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return first_rank(o, ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey")])


def b_rollup(spark, d):
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.rollup("n_name", "c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


def b_set_ops(spark, d):
    """Users and days with a purchase and a click but no error, and those with a signup but no view."""
    e = table(spark, d, "events").select("user_id", F.date_trunc("day", "ts").alias("day"), "event_type")
    of = lambda kind: e.where(F.col("event_type") == kind).select("user_id", "day")
    both = of("purchase").intersect(of("click")).subtract(of("error"))
    out = both.union(of("signup").distinct().exceptAll(of("view").distinct()))
    return out.groupBy("user_id", "day").agg(F.count("*").alias("n"))


def b_sessions(spark, d):
    e = table(spark, d, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    new = F.when(F.timestamp_diff("MICROSECOND", F.lag("ts").over(w), F.col("ts")) <= 12 * 3600 * 1_000_000, 0).otherwise(1)
    s = e.withColumn("new", new).withColumn("session", F.sum("new").over(w).cast("long"))
    return s.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value"))


def b_semi_anti(spark, d):
    p, li = table(spark, d, "part"), table(spark, d, "lineitem")
    big = li.where("l_quantity >= 45").select(F.col("l_partkey").alias("k"))
    some = p.join(big, F.col("p_partkey") == F.col("k"), "left_semi").withColumn("kind", F.lit("semi"))
    none = p.join(big, F.col("p_partkey") == F.col("k"), "left_anti").withColumn("kind", F.lit("anti"))
    return some.union(none).groupBy("p_brand", "kind").agg(F.count("*").alias("n"))


QUERIES = {
    "b_pricing": (
        b_pricing,
        """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_discount, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""",
    ),
    "b_star_join": (
        b_star_join,
        """SELECT r_name, n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""",
    ),
    "b_top_orders": (b_top_orders, "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1"),
    "b_rollup": (b_rollup, "SELECT n_name, c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_name, c_mktsegment)"),
    "b_set_ops": (
        b_set_ops,
        """WITH e AS (SELECT user_id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, event_type FROM events)
SELECT user_id, day, count(*) AS n FROM (((SELECT user_id, day FROM e WHERE event_type = 'purchase' INTERSECT SELECT user_id, day FROM e WHERE event_type = 'click') EXCEPT SELECT user_id, day FROM e WHERE event_type = 'error')
UNION ALL (SELECT user_id, day FROM e WHERE event_type = 'signup' EXCEPT SELECT user_id, day FROM e WHERE event_type = 'view')) GROUP BY user_id, day""",
    ),
    "b_sessions": (
        b_sessions,
        """WITH n AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) <= 43200000000 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS session FROM n) SELECT user_id, session, count(*) AS n, round(sum(value), 4) AS value FROM s GROUP BY user_id, session""",
    ),
    "b_semi_anti": (
        b_semi_anti,
        """SELECT p_brand, CASE WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity >= 45) THEN 'semi' ELSE 'anti' END AS kind, count(*) AS n FROM part GROUP BY ALL""",
    ),
}
