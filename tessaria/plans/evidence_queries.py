"""Validation, evidence accounting, chains and selection over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.joins import nearest_value
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
SELECT o_orderkey, array_to_string(list_filter([CASE WHEN o_totalprice < 20000 THEN 'small_total' END, CASE WHEN o_orderpriority LIKE '1%' AND o_orderstatus = 'O' THEN 'urgent_open' END,
  CASE WHEN month(o_orderdate) = 12 THEN 'december' END], lambda x: x IS NOT NULL), ',') AS errors FROM orders""")
def validation_codes(spark, sf):
    """All codes of a row, in order."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority", "o_orderstatus", "o_orderdate")
    codes = F.array(
        F.when(F.col("o_totalprice") < 20000, "small_total"),
        F.when(F.col("o_orderpriority").startswith("1") & (F.col("o_orderstatus") == "O"), "urgent_open"),
        F.when(F.month("o_orderdate") == 12, "december"),
    )
    return o.select("o_orderkey", F.array_join(F.array_distinct(F.filter(codes, lambda c: c.isNotNull())), ",").alias("errors"))


@query("""
WITH p AS (SELECT event_id, user_id, lag(event_id) OVER w AS before FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)),
l AS (SELECT e.event_id, CASE WHEN epoch(e.ts)::BIGINT - epoch(b.ts)::BIGINT <= 43200 THEN p.before END AS before FROM p JOIN events e USING (event_id) LEFT JOIN events b ON b.event_id = p.before),
n AS (SELECT event_id, sum(CASE WHEN before IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS path, user_id, event_type FROM l JOIN events USING (event_id))
SELECT user_id, event_type, path::BIGINT AS path, count(*) AS length, min(event_id) AS first_id FROM n GROUP BY 1, 2, 3""")
def chain_paths(spark, sf):
    """Successor links within 12 hours, each path with its length.  Links join neighbours, so a path is a run."""
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type", "ts")
    e = e.withColumn("sec", F.rint(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).cast("long"))  # to the nearest second
    linked = F.col("sec") - F.lag("sec").over(w) <= 43200
    e = e.withColumn("path", F.sum(F.when(F.coalesce(linked, F.lit(False)), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return e.groupBy("user_id", "event_type", "path").agg(F.count(F.lit(1)).alias("length"), F.min("event_id").alias("first_id"))


@query("""
WITH c AS (SELECT user_id, event_type, count(*) AS n, count(*) FILTER (WHERE value > 100) AS expected, count(*) FILTER (WHERE value > 100 AND event_id % 3 > 0) AS preserved,
  count(*) FILTER (WHERE value <= 100 AND event_id % 3 = 1) AS invented FROM events GROUP BY 1, 2)
SELECT event_type, sum(n)::BIGINT AS n, sum(expected)::BIGINT AS expected, sum(preserved)::BIGINT AS preserved, sum(invented)::BIGINT AS invented, sum(expected - preserved)::BIGINT AS missing FROM c GROUP BY 1""")
def unknown_accounting(spark, sf):
    """Expected, preserved, invented and missing unknowns."""
    e = table(spark, sf, "events").select("event_id", "event_type", "value")
    expected, told = F.col("value") > 100, F.when(F.col("value") > 100, F.col("event_id") % 3 > 0).otherwise(F.col("event_id") % 3 == 1)
    return e.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(expected).alias("expected"),
        F.count_if(expected & told).alias("preserved"),
        F.count_if(~expected & told).alias("invented"),
        F.count_if(expected & ~told).alias("missing"),
    )


@query("""
WITH d AS (SELECT d.lang, d.n_chars, l.quality FROM documents d JOIN labels l USING (doc_id)), g AS (SELECT lang, n_chars, count(*) AS n, sum(quality)::BIGINT AS h FROM d GROUP BY 1, 2),
r AS (SELECT lang, n_chars, sum(n) OVER w AS n, sum(h) OVER w AS h FROM g WINDOW w AS (PARTITION BY lang ORDER BY n_chars DESC ROWS UNBOUNDED PRECEDING))
SELECT lang, max(n)::BIGINT AS accepted, min(n_chars) AS threshold FROM r WHERE h >= 0.8 * n GROUP BY lang""")
def threshold_selection(spark, sf):
    """The largest confidence prefix of precision 0.8 or more, on whole ties."""
    from ..operators.ordered import running_precision

    d = table(spark, sf, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id")
    ok = running_precision(d, ["lang"], "n_chars", F.col("quality") == 1).where(F.col("hits") * 10 >= F.col("n") * 8)
    return ok.groupBy("lang").agg(F.max("n").alias("accepted"), F.min("n_chars").alias("threshold"))


@query("""
WITH v AS (SELECT p_brand, p_size % 4 AS view, max(p_retailprice) AS best FROM part GROUP BY 1, 2)
SELECT p_brand, round(avg(best), 6) AS mean_best, round(max(best), 6) AS top_best, count(*) AS views FROM v GROUP BY 1""")
def multi_view_agreement(spark, sf):
    """Best per view, then mean and maximum over views."""
    p = table(spark, sf, "part").select("p_brand", (F.col("p_size") % 4).alias("view"), "p_retailprice")
    v = p.groupBy("p_brand", "view").agg(F.max("p_retailprice").alias("best"))
    return v.groupBy("p_brand").agg(F.round(F.avg("best"), 6).alias("mean_best"), F.round(F.max("best"), 6).alias("top_best"), F.count(F.lit(1)).alias("views"))


@query("""
SELECT ts::DATE AS day, arg_min(event_type, (ts, event_id)) AS first_value, count(DISTINCT event_type) > 1 AS warned, bit_or(user_id) AS users_or, max(value) > 100 AS any_large
FROM events GROUP BY 1""")
def master_timeline(spark, sf):
    """One row a step; several values warn and the first wins; bits united."""
    e = table(spark, sf, "events").select("ts", "event_id", F.to_date("ts").alias("day"), "event_type", "user_id", "value")
    return e.groupBy("day").agg(
        F.min_by("event_type", F.struct("ts", "event_id")).alias("first_value"),
        (F.countDistinct("event_type") > 1).alias("warned"),
        F.bit_or("user_id").alias("users_or"),
        F.bool_or(F.col("value") > 100).alias("any_large"),
    )


@query("""
WITH n AS (SELECT user_id, ts::DATE AS day, event_type, lag(event_type) OVER w AS p, lag(ts::DATE) OVER w AS pd FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, count(*) FILTER (WHERE event_type = p AND pd >= day - 1) AS repeats, count(*) FILTER (WHERE p IS NULL OR event_type <> p) AS changes FROM n GROUP BY 1""")
def previous_event_lookup(spark, sf):
    """The immediately previous event of a lane."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf, "events").select("user_id", "event_id", "ts", "event_type", F.to_date("ts").alias("day"))
    e = e.withColumn("p", F.lag("event_type").over(w)).withColumn("pd", F.lag("day").over(w))
    return e.groupBy("user_id").agg(
        F.count_if((F.col("event_type") == F.col("p")) & (F.col("pd") >= F.date_sub("day", 1))).alias("repeats"),
        F.count_if(F.col("p").isNull() | (F.col("event_type") != F.col("p"))).alias("changes"),
    )


@query("""
SELECT o_custkey, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) AS best_order, count(*) AS n FROM orders GROUP BY 1""")
def best_by_rank(spark, sf):
    """The row of the largest rank, ties to the lowest index."""
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return o.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_totalprice", -F.col("o_orderkey"))).alias("best_order"), F.count(F.lit(1)).alias("n"))


@query("SELECT kind, count(*) AS n, sum(k)::BIGINT AS total FROM (SELECT 'customer' AS kind, c_custkey AS k FROM customer UNION ALL SELECT 'supplier', s_suppkey FROM supplier UNION ALL SELECT 'part', p_partkey FROM part) GROUP BY 1")
def union_sources(spark, sf):
    """Union of sources with their kinds."""
    parts = [table(spark, sf, t).select(F.lit(t).alias("kind"), F.col(k).alias("k")) for t, k in (("customer", "c_custkey"), ("supplier", "s_suppkey"), ("part", "p_partkey"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("total"))


@query("""
SELECT s_suppkey, c_custkey FROM (SELECT s_suppkey, c_custkey, row_number() OVER (PARTITION BY s_suppkey ORDER BY abs(c_acctbal - s_acctbal), c_custkey) AS a,
  row_number() OVER (PARTITION BY c_custkey ORDER BY abs(c_acctbal - s_acctbal), s_suppkey) AS b FROM supplier JOIN customer ON s_nationkey = c_nationkey) WHERE a = 1 AND b = 1""")
def mutual_best(spark, sf):
    """Pairs that are each other's best, from one sorted pass each way."""
    s = table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"), "s_acctbal")
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"), "c_acctbal")
    left = nearest_value(s, c, ["nation"], "s_suppkey", "s_acctbal", "c_custkey", "c_acctbal").select("s_suppkey", "c_custkey")
    right = nearest_value(c, s, ["nation"], "c_custkey", "c_acctbal", "s_suppkey", "s_acctbal").select("s_suppkey", "c_custkey")
    return left.join(right, ["s_suppkey", "c_custkey"])


@query("""
SELECT event_id, coalesce(json_extract_string(props, '$.page'), CASE WHEN event_type = 'error' THEN 'unknown' END, 'absent') AS page,
  CASE WHEN json_extract_string(props, '$.page') IS NOT NULL THEN 'observed' WHEN event_type = 'error' THEN 'unknown' ELSE 'absent' END AS status FROM events""")
def known_value_projection(spark, sf):
    """The value where its status is trusted, else what is known of it."""
    e = table(spark, sf, "events").select("event_id", "event_type", F.get_json_object("props", "$.page").alias("p"))
    status = F.when(F.col("p").isNotNull(), "observed").when(F.col("event_type") == "error", "unknown").otherwise("absent")
    return e.select("event_id", F.coalesce("p", status).alias("page"), status.alias("status"))


@query("""
WITH b AS (SELECT c_nationkey AS page, c_custkey AS id, floor(c_acctbal / 500) AS cell FROM customer), k AS (SELECT page, cell, count(*) AS n FROM b GROUP BY 1, 2)
SELECT page, cell::BIGINT AS cell, dense_rank() OVER (PARTITION BY page ORDER BY cell) - 1 AS row, n FROM k""")
def reading_order(spark, sf):
    """Rows of a page in reading order."""
    b = table(spark, sf, "customer").select(F.col("c_nationkey").alias("page"), F.floor(F.col("c_acctbal") / 500).alias("cell"))
    k = b.groupBy("page", "cell").agg(F.count(F.lit(1)).alias("n"))
    return k.select("page", "cell", (F.dense_rank().over(Window.partitionBy("page").orderBy("cell")) - 1).cast("long").alias("row"), "n")


@query("""
SELECT lang, count(*) AS n, count(*) FILTER (WHERE length(text) = n_chars) AS exact, max(n_chars) AS longest, sum(strlen(text))::BIGINT AS bytes FROM documents GROUP BY 1""")
def corpus_summary(spark, sf):
    """Corpus counters."""
    d = table(spark, sf, "documents").select("lang", "text", "n_chars")
    return d.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.char_length("text") == F.col("n_chars")).alias("exact"),
        F.max("n_chars").alias("longest"),
        F.sum(F.octet_length("text")).alias("bytes"),
    )


@query("""
SELECT c_custkey, CASE WHEN o.k IS NULL THEN 'none' WHEN o.n = 1 THEN 'one' ELSE 'many' END AS found, o.k AS order_id FROM customer
LEFT JOIN (SELECT o_custkey, count(*) AS n, CASE WHEN count(*) = 1 THEN min(o_orderkey) ELSE NULL END AS u, min(o_orderkey) AS k FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) o ON o_custkey = c_custkey""")
def unique_candidate(spark, sf):
    """One candidate is adopted, several are told."""
    o = table(spark, sf, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("order_id"))
    c = table(spark, sf, "customer").select("c_custkey").join(o, "c_custkey", "left")
    found = F.when(F.col("order_id").isNull(), "none").when(F.col("n") == 1, "one").otherwise("many")
    return c.select("c_custkey", found.alias("found"), "order_id")


@query("""
WITH t AS (SELECT conv_id, turn, role, lag(role) OVER w AS before, row_number() OVER w AS k FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role))
SELECT conv_id, count(*) AS turns, bool_or(role = before) AS repeats_role, min(turn)::BIGINT AS first_turn FROM t GROUP BY 1""")
def sequence_contract(spark, sf):
    """Order checks within a sequence."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role")
    c = table(spark, sf, "conversations").select("conv_id", "turn", "role").withColumn("before", F.lag("role").over(w))
    return c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.bool_or(F.col("role") == F.col("before")).alias("repeats_role"), F.min("turn").cast("long").alias("first_turn"))


@query("SELECT DISTINCT l_suppkey, l_shipdate::DATE AS day FROM lineitem a WHERE EXISTS (SELECT 1 FROM lineitem b WHERE b.l_suppkey = a.l_suppkey AND b.l_shipdate::DATE = a.l_shipdate::DATE + 1)")
def margin_semi_join(spark, sf):
    """Rows with a neighbour within a margin, by keyed equality on the shifted step."""
    d = table(spark, sf, "lineitem").select("l_suppkey", F.to_date("l_shipdate").alias("day")).distinct()
    return d.join(d.select("l_suppkey", F.date_sub("day", 1).alias("day")), ["l_suppkey", "day"], "left_semi")
