"""Join patterns over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import joins as J
from ..sources.tables import table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query("""
WITH e AS (SELECT event_id, user_id, event_type, ts::DATE AS day FROM events),
l AS (SELECT user_id, event_type, day + 1 AS day, min(event_id) AS from_id FROM e GROUP BY 1, 2, 3 HAVING count(*) = 1),
r AS (SELECT user_id, event_type, day, min(event_id) AS to_id FROM e GROUP BY 1, 2, 3 HAVING count(*) = 1)
SELECT user_id, event_type, day, from_id, to_id FROM l JOIN r USING (user_id, event_type, day)""")
def mutual_unique_adjacent(spark, sf):
    """An event and the one of the next day, each the other's only match."""
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type", F.to_date("ts").alias("day"))
    left = e.select("user_id", "event_type", F.date_add("day", 1).alias("day"), F.col("event_id").alias("from_id"))
    return J.mutual_unique(left, e.withColumnRenamed("event_id", "to_id"), ["user_id", "event_type", "day"], "from_id", "to_id")


@query("""
WITH e AS (SELECT event_id, user_id, event_type, ts::DATE AS day, value FROM events),
a AS (SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY value, event_id) AS k, count(*) OVER (PARTITION BY user_id, day) AS n FROM e WHERE event_type = 'click'),
b AS (SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY value, event_id) AS k, count(*) OVER (PARTITION BY user_id, day) AS n FROM e WHERE event_type = 'view')
SELECT a.event_id AS left_id, b.event_id AS right_id FROM a JOIN b USING (user_id, day, k) WHERE a.n = b.n AND a.n > 1""")
def ordinal_zip(spark, sf):
    """Leftovers paired by rank where both sides have equally many."""
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type", F.to_date("ts").alias("day"), "value")

    def side(kind, name):
        return e.where(F.col("event_type") == kind).select("user_id", "day", F.col("event_id").alias(name), F.col("value").alias(f"v_{name}"))

    out = J.ordinal_zip(side("click", "left_id"), side("view", "right_id"), ["user_id", "day"], ["v_left_id", "left_id"], ["v_right_id", "right_id"])
    return out.select("left_id", "right_id")


@query("""
WITH n AS (SELECT l_orderkey, l_linenumber, l_quantity, lead(l_linenumber) OVER w AS nl, lead(l_quantity) OVER w AS nq FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_partkey))
SELECT l_orderkey, l_linenumber, CASE WHEN nl IS NULL THEN 'no_next' WHEN nl <> l_linenumber + 1 THEN 'gap' WHEN nq = l_quantity THEN 'equal' WHEN nq > l_quantity THEN 'rising' ELSE 'falling' END AS reason FROM n""")
def exact_continuity(spark, sf):
    """Continuity of consecutive rows with ordered reason codes."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_quantity", "l_partkey")
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_partkey")
    li = li.withColumn("nl", F.lead("l_linenumber").over(w)).withColumn("nq", F.lead("l_quantity").over(w))
    reason = (
        F.when(F.col("nl").isNull(), "no_next")
        .when(F.col("nl") != F.col("l_linenumber") + 1, "gap")
        .when(F.col("nq") == F.col("l_quantity"), "equal")
        .when(F.col("nq") > F.col("l_quantity"), "rising")
        .otherwise("falling")
    )
    return li.select("l_orderkey", "l_linenumber", reason.alias("reason"))


@query("""
WITH e AS (SELECT event_id, user_id, event_type, ts, ts::DATE AS day FROM events),
f AS (SELECT user_id, day, CASE WHEN count(DISTINCT event_type) = 1 THEN min(event_id) END AS next_id FROM e GROUP BY 1, 2)
SELECT e.event_id, f.next_id FROM e JOIN f ON f.user_id = e.user_id AND f.day = e.day + 1 WHERE f.next_id IS NOT NULL""")
def next_unique_event(spark, sf):
    """The next day's event where the day has one kind only."""
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type", F.to_date("ts").alias("day"))
    first = e.groupBy("user_id", "day").agg(F.when(F.countDistinct("event_type") == 1, F.min("event_id")).alias("next_id"))
    first = first.where("next_id is not null").withColumn("day", F.date_sub("day", 1))
    return e.join(first, ["user_id", "day"]).select("event_id", "next_id")


@query("""
WITH p AS (SELECT s_suppkey, s.s_acctbal, c_custkey, abs(c_acctbal - s_acctbal) AS d FROM supplier s JOIN customer c ON c_nationkey = s_nationkey),
r AS (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY d, c_custkey) AS k FROM p)
SELECT s_suppkey, c_custkey, round(d, 2) AS distance FROM r WHERE k = 1""")
def nearest_numeric(spark, sf):
    """The nearest row within an equi-key, ties to the smaller id."""
    s = table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"), "s_acctbal")
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"), "c_acctbal")
    out = J.nearest_value(s, c, ["nation"], "s_suppkey", "s_acctbal", "c_custkey", "c_acctbal")
    return out.select("s_suppkey", "c_custkey", F.round(F.abs(F.col("c_acctbal") - F.col("s_acctbal")), 2).alias("distance"))


_ORDER_SPANS = """
WITH o AS (SELECT o_orderkey, o_custkey, epoch(o_orderdate)::BIGINT // 86400 AS a, epoch(o_orderdate)::BIGINT // 86400 + 20 + o_orderkey % 40 AS b FROM orders)
"""


def order_spans(spark, sf):
    day = F.floor(F.unix_timestamp("o_orderdate") / 86400).cast("long")
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return o.select("o_orderkey", "o_custkey", day.alias("a"), (day + 20 + F.col("o_orderkey") % 40).alias("b"))


@query(_ORDER_SPANS + "SELECT x.o_orderkey AS one, y.o_orderkey AS two FROM o x JOIN o y ON x.o_custkey = y.o_custkey AND x.o_orderkey < y.o_orderkey AND x.a < y.b AND y.a < x.b")
def interval_overlap(spark, sf):
    """Overlapping intervals of one key, by bucketed join."""
    o = order_spans(spark, sf)
    x = o.select("o_custkey", F.col("o_orderkey").alias("one"), F.col("a").alias("xa"), F.col("b").alias("xb"))
    y = o.select("o_custkey", F.col("o_orderkey").alias("two"), F.col("a").alias("ya"), F.col("b").alias("yb"))
    return J.interval_overlap(x, y, ["o_custkey"], "xa", "xb", "ya", "yb", 64).where("one < two").select("one", "two")


@query(_ORDER_SPANS + "SELECT o_orderkey FROM o x WHERE NOT EXISTS (SELECT 1 FROM o y WHERE x.o_custkey = y.o_custkey AND x.o_orderkey <> y.o_orderkey AND x.a < y.b AND y.a < x.b)")
def overlap_exclusion(spark, sf):
    """Rows that no other row of the key overlaps, by one window each way instead of a self-join."""
    w = Window.partitionBy("o_custkey").orderBy("a", "o_orderkey")
    o = order_spans(spark, sf)
    o = o.withColumn("before", F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("after", F.lead("a").over(w))
    free = (F.col("before").isNull() | (F.col("before") <= F.col("a"))) & (F.col("after").isNull() | (F.col("after") >= F.col("b")))
    return o.where(free).select("o_orderkey")


@query("""
WITH s AS (SELECT n_nationkey, n_nationkey * 400.0 - 1000 AS a, n_nationkey * 400.0 - 600 AS b FROM nation)
SELECT c_custkey, coalesce(s.n_nationkey, 0) AS owner FROM customer LEFT JOIN s ON c_acctbal >= s.a AND c_acctbal < s.b""")
def point_in_interval_fallback(spark, sf):
    """The interval that holds a point, else the first."""
    s = table(spark, sf, "nation").select(F.lit(1).alias("page"), "n_nationkey", (F.col("n_nationkey") * 400.0 - 1000).alias("a"), (F.col("n_nationkey") * 400.0 - 600).alias("b"))
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal", F.lit(1).alias("page"))
    out = J.point_in_interval(c, s, ["page"], "c_acctbal", "a", "b", 400.0)
    return out.select("c_custkey", F.coalesce("n_nationkey", F.lit(0)).alias("owner"))


@query("SELECT p_partkey FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity >= p_size)")
def containment_semi(spark, sf):
    """Rows that some row of the key contains.  The theta test becomes an aggregate, so the join stays one to one."""
    p = table(spark, sf, "part").select("p_partkey", "p_size")
    li = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.max("l_quantity").alias("most"))
    return p.join(li, "p_partkey").where("most >= p_size").select("p_partkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def containment_anti(spark, sf):
    """Rows without a partner."""
    c = table(spark, sf, "customer").select("c_custkey")
    return c.join(table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("""
WITH a AS (SELECT l_suppkey AS k, l_linenumber AS v FROM lineitem WHERE l_returnflag = 'A'), b AS (SELECT l_suppkey AS k, l_linenumber AS v FROM lineitem WHERE l_returnflag = 'R'),
x AS (SELECT k, list_sort(list(v)) AS v FROM a GROUP BY k), y AS (SELECT k, list_sort(list(v)) AS v FROM b GROUP BY k)
SELECT coalesce(x.k, y.k) AS k, coalesce(len(x.v), 0) AS n_left, coalesce(len(y.v), 0) AS n_right FROM x FULL JOIN y ON x.k = y.k WHERE x.v IS DISTINCT FROM y.v""")
def full_outer_diff(spark, sf):
    """Keys whose value lists differ."""
    li = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_linenumber").alias("v"), "l_returnflag")
    out = J.outer_diff(li.where("l_returnflag = 'A'").drop("l_returnflag"), li.where("l_returnflag = 'R'").drop("l_returnflag"), ["k"], "v")
    return out.select("k", *[F.coalesce(F.size(c), F.lit(0)).cast("long").alias(n) for c, n in (("left_values", "n_left"), ("right_values", "n_right"))])


@query("""
SELECT o_custkey, CASE WHEN count(DISTINCT o_orderpriority) = 1 THEN min(o_orderpriority) END AS owner, CASE WHEN count(DISTINCT o_orderpriority) > 1 THEN count(DISTINCT o_orderpriority) END AS n_choices FROM orders GROUP BY 1""")
def sole_owner(spark, sf):
    """The only candidate, else a list of choices."""
    out = J.sole_owner(table(spark, sf, "orders").select("o_custkey", "o_orderpriority"), ["o_custkey"], "o_orderpriority")
    return out.select("o_custkey", "owner", F.when(F.col("choices").isNotNull(), F.size("choices").cast("long")).alias("n_choices"))


@query("""
WITH r AS (SELECT l_suppkey AS k, l_linenumber AS line, l_partkey, l_returnflag AS f, row_number() OVER (PARTITION BY l_suppkey, l_linenumber, l_returnflag ORDER BY l_orderkey, l_partkey) AS place,
  count(*) OVER (PARTITION BY l_suppkey, l_linenumber, l_returnflag) AS n FROM lineitem)
SELECT k, line, x.place, x.l_partkey AS one, y.l_partkey AS two FROM r x JOIN r y USING (k, line) WHERE x.f = 'A' AND y.f = 'R' AND x.place = y.place AND x.n = y.n""")
def positional_join(spark, sf):
    """Two lists of a key joined by place, only where they are equally long."""
    li = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_linenumber").alias("line"), "l_partkey", "l_orderkey", "l_returnflag")

    def side(flag, name):
        w = Window.partitionBy("k", "line")
        rows = li.where(F.col("l_returnflag") == flag)
        rows = rows.withColumn("place", F.row_number().over(w.orderBy("l_orderkey", "l_partkey")).cast("long")).withColumn("n", F.count(F.lit(1)).over(w))
        return rows.select("k", "line", "place", "n", F.col("l_partkey").alias(name))

    return side("A", "one").join(side("R", "two"), ["k", "line", "place", "n"]).drop("n")


@query("""
SELECT n_nationkey, coalesce(c.v, s.v, n_name) AS source_name, CASE WHEN c.v IS NOT NULL THEN 'customer' WHEN s.v IS NOT NULL THEN 'supplier' ELSE 'nation' END AS source
FROM nation LEFT JOIN (SELECT c_nationkey AS k, min(c_name) AS v FROM customer GROUP BY 1) c ON c.k = n_nationkey
LEFT JOIN (SELECT s_nationkey AS k, min(s_name) AS v FROM supplier GROUP BY 1) s ON s.k = n_nationkey""")
def coalesce_priority(spark, sf):
    """Candidates by source priority."""
    c = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.min("c_name").alias("c"))
    s = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.min("s_name").alias("s"))
    n = table(spark, sf, "nation").select("n_nationkey", "n_name").join(c, "n_nationkey", "left").join(s, "n_nationkey", "left")
    source = F.when(F.col("c").isNotNull(), "customer").when(F.col("s").isNotNull(), "supplier").otherwise("nation")
    return n.select("n_nationkey", F.coalesce("c", "s", "n_name").alias("source_name"), source.alias("source"))
