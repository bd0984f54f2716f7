"""Relational breadth on the star schema: joins, aggregates, windows, set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from veldspar.plans.text_queries import table


def money(c) -> F.Column:
    """Sums of cents as whole numbers, so that the order of addition doesn't matter."""
    return F.sum(F.round(c * 100).cast("long"))


def pricing_summary(spark, d):
    li = table(spark, d, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum(F.col("l_quantity").cast("long")).alias("sum_qty"), money(F.col("l_extendedprice")).alias("sum_cents"), money(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("sum_disc_cents"), F.count(F.lit(1)).alias("n")
    )


def revenue_by_nation(spark, d):
    li, o, c = table(spark, d, "lineitem"), table(spark, d, "orders"), table(spark, d, "customer")
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("r_name", "n_name").agg(money(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("cents"), F.count(F.lit(1)).alias("n"))


def order_cube(spark, d):
    o = table(spark, d, "orders")
    return o.cube("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))


def order_rollup(spark, d):
    o = table(spark, d, "orders").withColumn("y", F.year("o_orderdate"))
    return o.rollup("y", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"), money(F.col("o_totalprice")).alias("cents"), F.grouping_id().alias("g"))


def semi_anti(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    big = o.filter("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    have = c.join(big, "c_custkey", "left_semi").withColumn("kind", F.lit("has"))
    lack = c.join(big, "c_custkey", "left_anti").withColumn("kind", F.lit("none"))
    return have.unionByName(lack).groupBy("kind", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


def outer_join(spark, d):
    s, c = table(spark, d, "supplier"), table(spark, d, "customer")
    a = s.groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("suppliers"))
    b = c.filter("c_acctbal > 5000").groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("customers"))
    return a.join(b, "k", "full_outer")


def window_frames(spark, d):
    o = table(spark, d, "orders")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return o.select(
        "o_orderkey", F.row_number().over(w).alias("rn"), F.lag("o_orderkey").over(w).alias("prev"), F.lead("o_orderkey").over(w).alias("next"),
        F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).over(w.rowsBetween(-2, 0)).alias("last3"), F.ntile(4).over(w).alias("quarter"),
    )


def set_operations(spark, d):
    a = table(spark, d, "customer").select(F.col("c_nationkey").alias("k"))
    b = table(spark, d, "supplier").filter("s_acctbal > 0").select(F.col("s_nationkey").alias("k"))
    tag = lambda df, t: df.select("k", F.lit(t).alias("op"))
    return tag(a.union(b).distinct(), "union").union(tag(a.intersect(b), "intersect")).union(tag(a.subtract(b), "except"))


def as_of(spark, d):
    """The last click of each user before each purchase."""
    e = table(spark, d, "events")
    before = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    clicked = F.last(F.when(F.col("event_type") == "click", F.col("event_id")), ignorenulls=True).over(before)
    return e.withColumn("click_id", clicked).filter("event_type = 'purchase'").select("event_id", "click_id")


def range_join(spark, d):
    """Pairs of purchases of one user less than a day apart."""
    e = table(spark, d, "events").filter("event_type = 'purchase'").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    f = e.select(F.col("user_id").alias("u"), F.col("event_id").alias("later"), F.col("t").alias("t2"))
    day = 86_400_000_000
    return e.join(f, (F.col("user_id") == F.col("u")) & (F.col("t2") > F.col("t")) & (F.col("t2") - F.col("t") < day)).select("event_id", "later")


def json_paths(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", F.size(F.json_object_keys("props")).alias("keys"))


def pivot_types(spark, d):
    e = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    return e.groupBy("day").pivot("event_type", ["click", "purchase", "view"]).agg(F.count(F.lit(1)))


def distinct_counts(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_suppkey", "l_partkey").alias("pairs"))


_DISC = "cast(round(l_extendedprice * (1 - l_discount) * 100) as bigint)"
_FLOOR = lambda x: f"cast(round({x}) as bigint)"
QUERIES = {
    "pricing_summary": (pricing_summary, f"select l_returnflag, l_linestatus, sum(cast(l_quantity as bigint)) as sum_qty, sum(cast(round(l_extendedprice * 100) as bigint)) as sum_cents, sum({_DISC}) as sum_disc_cents, count(*) as n from lineitem where l_shipdate <= timestamp '1998-09-02' group by all"),
    "revenue_by_nation": (revenue_by_nation, f"select r_name, n_name, sum({_DISC}) as cents, count(*) as n from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by all"),
    "order_cube": (order_cube, "select o_orderstatus, o_orderpriority, count(*) as n, grouping_id(o_orderstatus, o_orderpriority) as g from orders group by cube (o_orderstatus, o_orderpriority)"),
    "order_rollup": (order_rollup, "with o as (select *, year(o_orderdate) as y from orders) select y, o_orderstatus, count(*) as n, sum(cast(round(o_totalprice * 100) as bigint)) as cents, grouping_id(y, o_orderstatus) as g from o group by rollup (y, o_orderstatus)"),
    "semi_anti": (semi_anti, "select case when c_custkey in (select o_custkey from orders where o_totalprice > 200000) then 'has' else 'none' end as kind, c_mktsegment, count(*) as n from customer group by all"),
    "outer_join": (outer_join, "select k, suppliers, customers from (select s_nationkey as k, count(*) as suppliers from supplier group by 1) full join (select c_nationkey as k, count(*) as customers from customer where c_acctbal > 5000 group by 1) using (k)"),
    "window_frames": (
        window_frames,
        "select o_orderkey, row_number() over w as rn, lag(o_orderkey) over w as prev, lead(o_orderkey) over w as next, sum(cast(round(o_totalprice * 100) as bigint)) over (partition by o_custkey order by o_orderdate, o_orderkey rows between 2 preceding and current row) as last3, ntile(4) over w as quarter from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)",
    ),
    "set_operations": (
        set_operations,
        "select k, 'union' as op from (select c_nationkey as k from customer union select s_nationkey from supplier where s_acctbal > 0) union all select k, 'intersect' from (select c_nationkey as k from customer intersect select s_nationkey from supplier where s_acctbal > 0)"
        " union all select k, 'except' from (select c_nationkey as k from customer except select s_nationkey from supplier where s_acctbal > 0)",
    ),
    "as_of": (as_of, "with w as (select event_id, event_type, last_value(case when event_type = 'click' then event_id end ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding) as click_id from events) select event_id, click_id from w where event_type = 'purchase'"),
    "range_join": (range_join, "with e as (select * from events where event_type = 'purchase') select a.event_id, b.event_id as later from e a join e b on a.user_id = b.user_id and b.ts > a.ts and b.ts - a.ts < interval 1 day"),
    "json_paths": (json_paths, "select event_id, len(json_keys(props)) as keys from events"),
    "pivot_types": (pivot_types, "select cast(ts as date) as day, nullif(count(*) filter (event_type = 'click'), 0) as click, nullif(count(*) filter (event_type = 'purchase'), 0) as purchase, nullif(count(*) filter (event_type = 'view'), 0) as view from events group by 1"),
    "distinct_counts": (distinct_counts, "select l_returnflag, count(distinct l_partkey) as parts, count(distinct (l_suppkey, l_partkey)) as pairs from lineitem group by 1"),
}
