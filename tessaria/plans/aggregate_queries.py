"""Aggregations, set algebra, sampling and integrity over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import datasets as D
from ..operators import folds
from ..sources.tables import table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query("SELECT l_orderkey, l_partkey, count(*) AS n, min(l_linenumber) AS first_line FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_identity(spark, sf):
    """Keys held by several rows."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    return li.groupBy("l_orderkey", "l_partkey").agg(F.count(F.lit(1)).alias("n"), F.min("l_linenumber").alias("first_line")).where("n > 1")


@query("""
WITH p AS (SELECT l_suppkey, l_returnflag, sum(l_quantity)::BIGINT AS w FROM lineitem GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY w DESC, l_returnflag) AS k, sum(w) OVER (PARTITION BY l_suppkey) AS t FROM p)
SELECT l_suppkey, l_returnflag, round(w / t::DOUBLE, 9) AS share FROM r WHERE k = 1""")
def weighted_mode_vote(spark, sf):
    """Vote weighted by a non-negative score."""
    li = table(spark, sf, "lineitem").select("l_suppkey", "l_returnflag", "l_quantity")
    out = A.weighted_vote(li, ["l_suppkey"], "l_returnflag", F.col("l_quantity").cast("long"))
    return out.select("l_suppkey", "l_returnflag", F.round("share", 9).alias("share"))


@query("""
WITH p AS (SELECT user_id, event_type, count(*) AS votes, min(event_id) AS o FROM events GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY votes DESC, o) AS k FROM p)
SELECT user_id, event_type, votes FROM r WHERE k = 1""")
def majority_first_seen(spark, sf):
    """Majority, ties to the label seen first."""
    return A.majority_first_seen(table(spark, sf, "events").select("user_id", "event_type", "event_id"), ["user_id"], "event_type", F.col("event_id"))


_BAGS = """
WITH e AS (SELECT l_suppkey AS k, l_linenumber AS v, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1, 2),
p AS (SELECT l_suppkey AS k, l_linenumber AS v, count(*) AS n FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1, 2),
j AS (SELECT coalesce(e.k, p.k) AS k, coalesce(e.n, 0) AS e, coalesce(p.n, 0) AS p FROM e FULL JOIN p ON e.k = p.k AND e.v = p.v),
s AS (SELECT k, sum(e)::BIGINT AS expected, sum(p)::BIGINT AS predicted, sum(least(e, p))::BIGINT AS correct FROM j GROUP BY k)
"""


@query(
    _BAGS
    + """SELECT k, expected, predicted, correct, round(correct / nullif(predicted, 0)::DOUBLE, 9) AS precision, round(correct / nullif(expected, 0)::DOUBLE, 9) AS recall,
  round(2 * correct / nullif(predicted + expected, 0)::DOUBLE, 9) AS f1 FROM s"""
)
def multiset_f1(spark, sf):
    """Precision, recall and F1 of multisets."""
    li = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_linenumber").alias("v"), "l_returnflag")
    out = A.multiset_overlap(li.where("l_returnflag = 'A'"), li.where("l_returnflag = 'N'"), ["k"], ["v"])
    return out.select("k", "expected", "predicted", "correct", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query(_BAGS + "SELECT k, bool_and(e = p) AS exact FROM j GROUP BY k")
def multiset_equality(spark, sf):
    """U8: whether two multisets are equal."""
    li = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_linenumber").alias("v"), "l_returnflag").where("l_returnflag in ('A', 'N')")
    per = li.groupBy("k", "v").agg(F.sum(F.when(F.col("l_returnflag") == "A", 1).otherwise(-1)).alias("d"))
    return per.groupBy("k").agg((F.sum(F.abs("d")) == 0).alias("exact"))


@query("""
WITH d AS (SELECT d.lang, d.source, l.quality, l.toxic FROM documents d JOIN labels l USING (doc_id)),
x AS (SELECT unnest(['overall', 'lang=' || lang, 'source=' || source]) AS label, quality, toxic FROM d)
SELECT label, count(*) AS n, sum(quality)::BIGINT AS good, sum(toxic)::BIGINT AS toxic FROM x GROUP BY label""")
def group_fanout_accuracy(spark, sf):
    """Every row counted under all its labels."""
    d = table(spark, sf, "documents").select("doc_id", "lang", "source").join(table(spark, sf, "labels").select("doc_id", "quality", "toxic"), "doc_id")
    return A.fan_out(d, {"": F.lit("overall"), "lang": F.col("lang"), "source": F.col("source")}, {"good": F.col("quality") == 1, "toxic": F.col("toxic") == 1})


@query("SELECT coalesce(event_type, 'all') AS kind, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY ROLLUP (event_type)")
def kind_rollup(spark, sf):
    """Counts by kind and in all."""
    e = table(spark, sf, "events").select("event_type", "user_id")
    out = e.rollup("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"))
    return out.select(F.coalesce("event_type", F.lit("all")).alias("kind"), "n", "users")


@query("SELECT quality || ' -> ' || toxic AS pair, count(*) AS n FROM labels GROUP BY 1")
def confusion(spark, sf):
    """Confusion counts."""
    return table(spark, sf, "labels").groupBy(F.concat_ws(" -> ", "quality", "toxic").alias("pair")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_type, count(*) AS n, round(median(value), 6) AS median_value, sum(round(value * 100)::BIGINT)::BIGINT AS cents FROM events GROUP BY 1")
def latency_median(spark, sf):
    """Totals and exact medians, by counting values instead of holding them."""
    e = table(spark, sf, "events").select("event_type", "value")
    totals = e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))
    return totals.join(A.medians(e, "event_type", "value", "median_value"), "event_type").select("event_type", "n", F.round("median_value", 6).alias("median_value"), "cents")


@query("""
SELECT user_id, CASE WHEN count(DISTINCT event_type) = 1 THEN min(event_type) END AS value, CASE WHEN count(DISTINCT event_type) > 1 THEN array_to_string(list_sort(list(DISTINCT event_type)), ',') END AS conflict
FROM events GROUP BY 1""")
def conflict_to_null(spark, sf):
    """One distinct value is the value, several are NULL and a conflict."""
    out = A.conflict(table(spark, sf, "events").select("user_id", "event_type"), ["user_id"], "event_type")
    return out.select("user_id", "value", F.when(F.col("conflict").isNotNull(), F.array_join("conflict", ",")).alias("conflict"))


@query("""
WITH f AS (SELECT source, min(doc_id) AS o FROM documents GROUP BY 1), n AS (SELECT source, dense_rank() OVER (ORDER BY o) - 1 AS number FROM f)
SELECT number, d.source, count(*) AS n FROM documents d JOIN n USING (source) GROUP BY 1, 2""")
def canonical_renumber(spark, sf):
    """Numbers by first appearance."""
    out = A.renumber(table(spark, sf, "documents").select("doc_id", "source"), "source", "doc_id", "number")
    return out.groupBy(F.col("number").cast("long").alias("number"), "source").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT l_suppkey, min(l_quantity) AS x0, min(l_discount) AS y0, max(l_quantity) AS x1, max(l_discount) AS y1 FROM lineitem GROUP BY 1""")
def envelope(spark, sf):
    """Bounding boxes by key."""
    li = table(spark, sf, "lineitem").select("l_suppkey", F.col("l_quantity").alias("x0"), F.col("l_discount").alias("y0"), F.col("l_quantity").alias("x1"), F.col("l_discount").alias("y1"))
    return A.envelope(li, ["l_suppkey"], "x0", "y0", "x1", "y1")


@query("""
SELECT lang, count(*) FILTER (WHERE quality = 1) AS good, count(*) FILTER (WHERE quality = 0) AS bad, count(*) FILTER (WHERE quality IS NULL) AS unlabelled
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""")
def pivot_coverage(spark, sf):
    """Coverage by group and label."""
    d = table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    q = F.col("quality")
    return d.groupBy("lang").agg(F.count_if(q == 1).alias("good"), F.count_if(q == 0).alias("bad"), F.count_if(q.isNull()).alias("unlabelled"))


@query("""
SELECT source, arg_min(lang, doc_id) AS first_lang, array_to_string(list_sort(list(DISTINCT lang)), ',') AS langs, count(*) AS n FROM documents GROUP BY 1""")
def family_collapse(spark, sf):
    """First label wins, tags united."""
    d = table(spark, sf, "documents").select("source", "lang", "doc_id")
    return d.groupBy("source").agg(F.min_by("lang", "doc_id").alias("first_lang"), F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("langs"), F.count(F.lit(1)).alias("n"))


@query("SELECT p_brand, sum(levenshtein(p_name, p_type))::BIGINT AS edits, sum(length(p_name))::BIGINT AS chars FROM part GROUP BY 1")
def character_error_rate(spark, sf):
    """Edit distance over length, of whole texts."""
    return A.error_rate(table(spark, sf, "part").select("p_brand", "p_name", "p_type"), "p_name", "p_type", ["p_brand"])


# --- dataset engineering -------------------------------------------------------


@query("SELECT min(doc_id) AS doc_id, sha256(text) AS digest, count(*) AS copies FROM documents GROUP BY 2")
def dedupe_content(spark, sf):
    """One row per content."""
    return D.dedupe_content(table(spark, sf, "documents").select("doc_id", "text"), "text", "doc_id")


@query("SELECT source, doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents) WHERE k = 1")
def first_by_key(spark, sf):
    """The first row of a key."""
    return D.first_by_key(table(spark, sf, "documents").select("source", "doc_id", "lang"), ["source"], "doc_id")


_SPLIT = "CASE WHEN b < 8 THEN 'train' WHEN b < 9 THEN 'dev' ELSE 'test' END"
_BUCKET = "('0x' || substr(sha256(c_name), 1, 8))::BIGINT % 10"


@query(f"WITH s AS (SELECT *, {_BUCKET} AS b FROM customer) SELECT {_SPLIT} AS split, c_mktsegment, count(*) AS n FROM s GROUP BY 1, 2")
def hash_split(spark, sf):
    """split by content hash."""
    c = D.hash_split(table(spark, sf, "customer").select("c_name", "c_mktsegment"), "c_name")
    return c.groupBy("split", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH s AS (SELECT c_nationkey, {_SPLIT} AS split FROM (SELECT *, {_BUCKET} AS b FROM customer)) SELECT c_nationkey, array_to_string(list_sort(list(DISTINCT split)), ',') AS splits FROM s GROUP BY 1 HAVING count(DISTINCT split) > 1")
def family_leak_check(spark, sf):
    """Families in several splits."""
    c = D.hash_split(table(spark, sf, "customer").select("c_name", "c_nationkey"), "c_name")
    return D.leaks(c, "c_nationkey", "split").select("c_nationkey", F.array_join("splits", ",").alias("splits"))


@query("SELECT lang, doc_id, rank FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY sha256(doc_id::VARCHAR)) AS rank FROM documents) WHERE rank <= 10")
def bottom_k_hash(spark, sf):
    """The k smallest keyed hashes of each group (the operator's own k)."""
    d = table(spark, sf, "documents").select("lang", "doc_id")
    return D.bottom_k(d, ["lang"], F.sha2(F.col("doc_id").cast("string"), 256), 10).select("lang", "doc_id", F.col("rank").cast("long").alias("rank"))


@query("SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS turn FROM documents")
def round_robin(spark, sf):
    """Interleave over groups."""
    return D.round_robin(table(spark, sf, "documents").select("lang", "doc_id"), "lang", ["doc_id"]).withColumn("turn", F.col("turn").cast("long"))


@query("""
WITH d AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY source) AS turn FROM d),
t AS (SELECT *, coalesce(sum(n) OVER (ORDER BY turn, lang ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS total FROM r)
SELECT lang, source, n, turn, total FROM t WHERE total < 400""")
def document_limit(spark, sf):
    """T5: whole documents up to a limit, alternating over modes (the operator's own limit)."""
    d = table(spark, sf, "documents").select("lang", "source", F.lit(1).alias("one"))
    return D.document_limit(d, "lang", "source", "one", 400).withColumn("turn", F.col("turn").cast("long"))


@query("""
WITH r AS (SELECT c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256(c_name)) AS k, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer)
SELECT c_mktsegment, c_custkey FROM r WHERE k <= floor(n * 0.25 + 0.5)""")
def fraction_sample(spark, sf):
    """A fraction of each group by smallest hash."""
    return D.fraction_sample(table(spark, sf, "customer").select("c_mktsegment", "c_custkey", "c_name"), "c_mktsegment", F.sha2("c_name", 256), "c_custkey", 0.25).drop("c_name")


@query("SELECT l_orderkey, count(*) AS n, min(l_linenumber)::BIGINT - 1 AS least, max(l_linenumber)::BIGINT - 1 AS most, count(DISTINCT l_linenumber) AS distinct FROM lineitem GROUP BY 1 HAVING min(l_linenumber) <> 1 OR max(l_linenumber) <> count(*) OR count(DISTINCT l_linenumber) <> count(*)")
def completeness_gate(spark, sf):
    """Keys whose indices are not 0..n-1."""
    li = table(spark, sf, "lineitem").select("l_orderkey", (F.col("l_linenumber").cast("long") - 1).alias("i"))
    return D.incomplete(li, ["l_orderkey"], "i")


@query("""
SELECT k, 'missing' AS side FROM (SELECT o_orderkey AS k FROM orders EXCEPT SELECT l_orderkey FROM lineitem)
UNION ALL SELECT k, 'extra' FROM (SELECT l_orderkey AS k FROM lineitem EXCEPT SELECT o_orderkey FROM orders)""")
def set_algebra(spark, sf):
    """Keys of one side only."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"))
    return D.symmetric_difference(o, table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k")), ["k"])


@query("SELECT l_suppkey, l_linenumber, count(*) AS n FROM (SELECT l_suppkey, l_linenumber FROM lineitem WHERE l_returnflag = 'A' INTERSECT ALL SELECT l_suppkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R') GROUP BY 1, 2")
def multiset_intersect(spark, sf):
    """Intersection with multiplicities."""
    li = table(spark, sf, "lineitem").select("l_suppkey", "l_linenumber", "l_returnflag")
    a, b = (li.where(F.col("l_returnflag") == x).drop("l_returnflag") for x in "AR")
    return a.intersectAll(b).groupBy("l_suppkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT event_id, json_exists(props, '$.page') AS has_page, json_extract_string(props, '$.page') AS page FROM events""")
def json_presence(spark, sf):
    """Missing, null and given fields kept apart."""
    e = table(spark, sf, "events").select("event_id", F.from_json("props", "map<string,string>").alias("m"))
    return e.select("event_id", F.coalesce(F.map_contains_key("m", "page"), F.lit(False)).alias("has_page"), F.try_element_at("m", F.lit("page")).alias("page"))


# --- folds within bounded groups ----------------------------------------------


@query("""
WITH RECURSIVE o AS (SELECT user_id, event_id, epoch(date_trunc('second', ts)) AS a, epoch(date_trunc('second', ts)) + 7200 + value * 60 AS b, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS k FROM events),
f AS (SELECT user_id, event_id, k, true AS taken, [{'a': a, 'b': b}] AS kept FROM o WHERE k = 1 UNION ALL
  SELECT o.user_id, o.event_id, o.k, t.ok, CASE WHEN t.ok THEN list_append(f.kept, {'a': o.a, 'b': o.b}) ELSE f.kept END FROM f JOIN o ON o.user_id = f.user_id AND o.k = f.k + 1,
  LATERAL (SELECT len(list_filter(f.kept, lambda q: greatest(least(q.b, o.b) - greatest(q.a, o.a), 0) / least(q.b - q.a, o.b - o.a) >= 0.5)) = 0 AS ok) t)
SELECT user_id, event_id FROM f WHERE taken""")
def nms_1d(spark, sf):
    """Non-maximum suppression of each user's spans."""
    e = table(spark, sf, "events").select("user_id", "event_id", "value", F.unix_timestamp("ts").cast("double").alias("x0"))
    e = e.withColumn("x1", F.col("x0") + 7200 + F.col("value") * 60).withColumn("y0", F.lit(0.0)).withColumn("y1", F.lit(1.0))
    return folds.nms(e, ["user_id"], ["x0", "y0", "x1", "y1"], "value", "event_id", 0.5)


@query("""
WITH RECURSIVE s AS (SELECT l_orderkey, l_linenumber, l_partkey, epoch(l_shipdate)::BIGINT // 86400 AS a, epoch(l_shipdate)::BIGINT // 86400 + l_quantity AS b, l_quantity AS w FROM lineitem),
o AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY b, a, l_linenumber, l_partkey) AS k FROM s),
f AS (SELECT l_orderkey, 0::BIGINT AS k, []::DOUBLE[] AS ends, [{'t': 0::DOUBLE, 'n': 0::BIGINT}] AS best FROM (SELECT DISTINCT l_orderkey FROM o) UNION ALL
  SELECT o.l_orderkey, o.k, list_append(f.ends, o.b::DOUBLE), list_append(f.best, CASE WHEN t.j.t + o.w > f.best[-1].t THEN {'t': t.j.t + o.w, 'n': t.j.n + 1} ELSE f.best[-1] END) FROM f JOIN o ON o.l_orderkey = f.l_orderkey AND o.k = f.k + 1,
  LATERAL (SELECT f.best[len(list_filter(f.ends, lambda e: e <= o.a)) + 1] AS j) t)
SELECT l_orderkey, best[-1].t AS weight, best[-1].n AS chosen FROM f QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY k DESC) = 1""")
def weighted_interval(spark, sf):
    """Heaviest set of disjoint intervals of each order: its weight and size."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", F.col("l_quantity").alias("w"))
    li = li.withColumn("a", F.floor(F.unix_timestamp("l_shipdate") / 86400)).withColumn("b", F.col("a") + F.col("w")).withColumn("id", F.col("l_linenumber") * 10000000000 + F.col("l_partkey"))
    return folds.heaviest(li, ["l_orderkey"], "a", "b", "w", "id")


@query("""
WITH RECURSIVE e AS (SELECT user_id, event_id, event_type, epoch(date_trunc('second', ts)) AS a, epoch(date_trunc('second', ts)) + 43200 AS b FROM events),
p AS (SELECT x.user_id, x.event_id AS gold, y.event_id AS found, greatest(least(x.b, y.b) - greatest(x.a, y.a), 0) / (x.b - x.a + y.b - y.a - greatest(least(x.b, y.b) - greatest(x.a, y.a), 0)) AS iou
  FROM e x JOIN e y ON x.user_id = y.user_id AND x.event_type = 'click' AND y.event_type = 'view'),
o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY iou DESC, gold, found) AS k FROM p WHERE iou >= 0.5),
f AS (SELECT user_id, gold, found, iou, k, true AS taken, [gold] AS xs, [found] AS ys FROM o WHERE k = 1 UNION ALL
  SELECT o.user_id, o.gold, o.found, o.iou, o.k, t.ok, CASE WHEN t.ok THEN list_append(f.xs, o.gold) ELSE f.xs END, CASE WHEN t.ok THEN list_append(f.ys, o.found) ELSE f.ys END FROM f JOIN o ON o.user_id = f.user_id AND o.k = f.k + 1,
  LATERAL (SELECT NOT list_contains(f.xs, o.gold) AND NOT list_contains(f.ys, o.found) AS ok) t)
SELECT user_id, gold, found, round(iou, 9) AS iou FROM f WHERE taken""")
def iou_match_1d(spark, sf):
    """Greedy one-to-one matches between the spans of two kinds of event."""
    e = table(spark, sf, "events").select("user_id", "event_id", "event_type", "value", F.unix_timestamp("ts").cast("double").alias("x0"))
    e = e.withColumn("x1", F.col("x0") + 43200).withColumn("y0", F.lit(0.0)).withColumn("y1", F.lit(1.0))
    out = folds.match_boxes(e.where("event_type = 'click'"), e.where("event_type = 'view'"), ["user_id"], ["x0", "y0", "x1", "y1"], "event_id", 0.5)
    return out.withColumn("iou", F.round("iou", 9))


@query("""
WITH RECURSIVE n AS (SELECT l_orderkey AS g, l_returnflag AS f, l_quantity::BIGINT AS q, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey, l_quantity) AS i FROM lineitem WHERE l_returnflag IN ('A', 'R')),
a AS (SELECT * FROM n WHERE f = 'A'), r AS (SELECT * FROM n WHERE f = 'R'), h AS (SELECT g, max(i) AS rows FROM a GROUP BY 1),
f AS (SELECT g, 0::BIGINT AS i, []::BIGINT[] AS used, 0::BIGINT AS w FROM h UNION ALL
  SELECT f.g, f.i + 1, CASE WHEN r.i IS NULL THEN f.used ELSE list_append(f.used, r.i) END, f.w + coalesce(60 - abs(a.q - r.q), 0) FROM f JOIN a ON a.g = f.g AND a.i = f.i + 1 LEFT JOIN (SELECT g, i, q FROM r UNION ALL SELECT g, NULL, NULL FROM h) r ON r.g = f.g
  WHERE r.i IS NULL OR NOT list_contains(f.used, r.i))
SELECT f.g, max(f.w) AS weight FROM f JOIN h ON h.g = f.g AND h.rows = f.i GROUP BY 1 HAVING max(f.w) > 0""")
def optimal_assignment(spark, sf):
    """Maximum-weight one-to-one assignment between two short lists of a key: its weight."""
    w = Window.partitionBy("g", "l_returnflag").orderBy("l_linenumber", "l_partkey", "l_quantity")
    n = table(spark, sf, "lineitem").where("l_returnflag in ('A', 'R')").withColumn("g", F.col("l_orderkey")).withColumn("i", F.row_number().over(w)).select("g", "l_returnflag", "i", F.col("l_quantity").cast("long").alias("q"))
    a, r = (n.where(F.col("l_returnflag") == f).select("g", F.col("i").alias(i), F.col("q").alias(q)) for f, i, q in (("A", "x", "qa"), ("R", "y", "qr")))
    edges = a.join(r, "g").withColumn("w", (60 - F.abs(F.col("qa") - F.col("qr"))).cast("double"))
    return folds.assignment(edges, ["g"], "x", "y", "w").groupBy("g").agg(F.sum("w").cast("long").alias("weight"))
