"""Layout, identity, splits and reports over the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import exchange
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


# --- splits and selections --------------------------------------------------------

_SOURCES = """s AS (SELECT o_custkey AS id, list_sort(list(DISTINCT tag)) AS tags FROM (SELECT o_custkey, unnest([left(o_orderpriority, 1), o_orderstatus, 'y' || year(o_orderdate)]) AS tag FROM orders) GROUP BY 1),
t AS (SELECT id, unnest(tags) AS tag FROM s), f AS (SELECT tag FROM t GROUP BY 1 HAVING count(*) >= 3), n AS (SELECT count(*) AS n FROM s)"""


@query(f"""
WITH {_SOURCES}, v AS (SELECT DISTINCT id FROM (SELECT id, row_number() OVER (PARTITION BY tag ORDER BY sha256('validation:' || id), id) AS k FROM t JOIN f USING (tag)) WHERE k = 1),
w AS (SELECT DISTINCT id FROM (SELECT id, row_number() OVER (PARTITION BY tag ORDER BY sha256('test:' || id), id) AS k FROM t JOIN f USING (tag) WHERE id NOT IN (SELECT id FROM v)) WHERE k = 1),
r AS (SELECT id, row_number() OVER (ORDER BY sha256('rest:' || id), id) AS k FROM s WHERE id NOT IN (SELECT id FROM v) AND id NOT IN (SELECT id FROM w)),
c AS (SELECT greatest(round(n / 10.0)::BIGINT - (SELECT count(*) FROM v), 0) AS mv, greatest(round(n / 10.0)::BIGINT - (SELECT count(*) FROM w), 0) AS mw FROM n)
SELECT id, 'validation' AS split FROM v UNION ALL SELECT id, 'test' FROM w UNION ALL SELECT id, CASE WHEN k <= mv THEN 'validation' WHEN k <= mv + mw THEN 'test' ELSE 'train' END FROM r, c""")
def stratified_split(spark, sf):
    """Source-disjoint 80/10/10 splits in which every tag of three or more sources has one in either held-out split."""
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("id"), "o_orderpriority", "o_orderstatus", "o_orderdate")
    tags = F.array(F.substring("o_orderpriority", 1, 1), F.col("o_orderstatus"), F.concat(F.lit("y"), F.year("o_orderdate")))
    return D.stratified(o.select("id", F.explode(tags).alias("tag")).distinct(), "id", "tag")


@query("""
WITH d AS (SELECT doc_id, lang, source, n_chars, quality FROM documents LEFT JOIN labels USING (doc_id)), x AS (SELECT *, CASE WHEN quality IS NULL THEN 'no_label' WHEN quality = 0 THEN 'low_quality' WHEN n_chars < 300 THEN 'short' END AS reason FROM d)
SELECT lang, coalesce(reason, 'accepted') AS outcome, count(*) AS n, min(doc_id) AS first_id FROM x GROUP BY 1, 2""")
def accepted_and_excluded(spark, sf):
    """Rows that are accepted, and the first reason against each other one."""
    d = table(spark, sf, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    reason = F.when(F.col("quality").isNull(), "no_label").when(F.col("quality") == 0, "low_quality").when(F.col("n_chars") < 300, "short").otherwise("accepted")
    return d.groupBy("lang", reason.alias("outcome")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"))


@query("SELECT p_partkey * 10 + v AS id, p_partkey AS origin, p_size + v AS size, 'scaled:' || v AS change FROM part, (VALUES (1), (2)) AS t(v)")
def derived_rows(spark, sf):
    """Rows derived from each row, with what they come from and how."""
    p = table(spark, sf, "part").select("p_partkey", "p_size", F.explode(F.array(F.lit(1), F.lit(2))).alias("v"))
    return p.select((F.col("p_partkey") * 10 + F.col("v")).alias("id"), F.col("p_partkey").alias("origin"), (F.col("p_size") + F.col("v")).cast("long").alias("size"), F.concat(F.lit("scaled:"), F.col("v").cast("string")).alias("change"))


@query("""
WITH m AS (SELECT l_suppkey, list_sort(list(DISTINCT tag)) AS tags FROM (SELECT l_suppkey, unnest([l_returnflag, l_linestatus, CASE WHEN l_quantity > 45 THEN 'large' END, CASE WHEN l_discount = 0 THEN 'plain' END]) AS tag FROM lineitem) WHERE tag IS NOT NULL GROUP BY 1)
SELECT l_suppkey, array_to_string(tags, ',') AS tags FROM m""")
def semantic_tags(spark, sf):
    """Distinct tags of a source, sorted."""
    li = table(spark, sf, "lineitem")
    tags = F.array("l_returnflag", "l_linestatus", F.when(F.col("l_quantity") > 45, "large"), F.when(F.col("l_discount") == 0, "plain"))
    found = li.select("l_suppkey", F.explode(tags).alias("tag")).where("tag is not null")
    return found.groupBy("l_suppkey").agg(F.array_join(F.array_sort(F.collect_set("tag")), ",").alias("tags"))


@query("""
SELECT o_custkey, arg_max(o_orderkey, (CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'O' THEN 1 ELSE 0 END, n, o_totalprice, -o_orderkey)) AS track FROM (SELECT o.*, coalesce(n, 0) AS n FROM orders o LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey) GROUP BY 1""")
def track_rank(spark, sf):
    """The track of the largest rank tuple: kind, number of measures, weight, lowest index."""
    n = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice").join(n, "o_orderkey", "left")
    kind = F.when(F.col("o_orderstatus") == "F", 2).when(F.col("o_orderstatus") == "O", 1).otherwise(0)
    return o.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct(kind, F.coalesce("n", F.lit(0)), "o_totalprice", -F.col("o_orderkey"))).alias("track"))


# --- layout -------------------------------------------------------------------------

_SPANS = "b AS (SELECT l_orderkey AS page, l_linenumber * 1000000 + l_partkey AS id, epoch(l_shipdate)::BIGINT // 86400 % 200 AS x0, epoch(l_shipdate)::BIGINT // 86400 % 200 + 5 + l_quantity::BIGINT AS x1 FROM lineitem)"


def spans(spark, sf):
    day = F.floor(F.unix_timestamp("l_shipdate") / 86400) % 200
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_quantity")
    return li.select(F.col("l_orderkey").alias("page"), (F.col("l_linenumber").cast("long") * 1000000 + F.col("l_partkey")).alias("id"), day.alias("x0"), (day + 5 + F.col("l_quantity").cast("long")).alias("x1"))


@query(f"""
WITH {_SPANS}, n AS (SELECT *, lead(x0) OVER w AS next, lag(x1) OVER w AS before FROM b WINDOW w AS (PARTITION BY page ORDER BY x0, x1, id))
SELECT page, id, greatest(x0, CASE WHEN before > x0 THEN (before + x0) / 2.0 ELSE x0 END) AS x0, CASE WHEN next < x1 THEN (x1 + next) / 2.0 ELSE x1 END AS x1, coalesce(before > x0, false) OR coalesce(next < x1, false) AS review FROM n""")
def repaired_edges(spark, sf):
    """Where neighbours overlap the edge is moved to the middle, and both are for review."""
    w = Window.partitionBy("page").orderBy("x0", "x1", "id")
    b = spans(spark, sf).withColumn("next", F.lead("x0").over(w)).withColumn("before", F.lag("x1").over(w))
    left, right = F.coalesce(F.col("before") > F.col("x0"), F.lit(False)), F.coalesce(F.col("next") < F.col("x1"), F.lit(False))
    x0 = F.greatest("x0", F.when(left, (F.col("before") + F.col("x0")) / 2.0).otherwise(F.col("x0")))
    return b.select("page", "id", x0.cast("double").alias("x0"), F.when(right, (F.col("x1") + F.col("next")) / 2.0).otherwise(F.col("x1")).cast("double").alias("x1"), (left | right).alias("review"))


@query(f"""
WITH {_SPANS}, k AS (SELECT *, x0 - lag(x0) OVER (PARTITION BY page ORDER BY x0, id) > 12 AS gap FROM b), r AS (SELECT *, sum(CASE WHEN gap THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY x0, id ROWS UNBOUNDED PRECEDING) AS row FROM k)
SELECT page, row::BIGINT AS row, count(*) AS n, median(x0) AS centre, count(DISTINCT x1 - x0) > 1 AS ambiguous FROM r GROUP BY 1, 2""")
def manual_rows(spark, sf):
    """Boxes clustered where the gap to the one before is small, in reading order; whether a cluster is of one kind."""
    w = Window.partitionBy("page").orderBy("x0", "id")
    gap = F.col("x0") - F.lag("x0").over(w) > 12
    b = spans(spark, sf).withColumn("gap", gap)
    b = b.withColumn("row", F.sum(F.when(F.col("gap"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return b.groupBy("page", "row").agg(F.count(F.lit(1)).alias("n"), F.median("x0").alias("centre"), (F.countDistinct(F.col("x1") - F.col("x0")) > 1).alias("ambiguous"))


@query(f"""
WITH {_SPANS}, p AS (SELECT a.page, a.id AS owner, c.id AS id, count(*) OVER (PARTITION BY a.page, a.id) AS n FROM b a JOIN b c ON a.page = c.page AND a.id <> c.id AND c.x0 BETWEEN a.x1 - 2 AND a.x1 + 2)
SELECT page, owner, CASE WHEN n = 1 THEN min(id) END AS id, n FROM p GROUP BY page, owner, n""")
def endpoint_candidates(spark, sf):
    """The boxes that begin within a band about an end, adopted where there is one.  The band is joined on steps of its width."""
    b = spans(spark, sf)
    ends = b.select("page", F.col("id").alias("owner"), F.col("x1").alias("end"), F.explode(F.sequence(F.floor((F.col("x1") - 2) / 5), F.floor((F.col("x1") + 2) / 5))).alias("cell"))
    starts = b.select("page", "id", "x0", F.floor(F.col("x0") / 5).alias("cell"))
    p = ends.join(starts, ["page", "cell"]).where((F.col("owner") != F.col("id")) & F.col("x0").between(F.col("end") - 2, F.col("end") + 2))
    return p.groupBy("page", "owner").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("m")).select("page", "owner", F.when(F.col("n") == 1, F.col("m")).alias("id"), "n")


@query("""
WITH RECURSIVE o AS (SELECT user_id, event_id, CASE WHEN event_type IN ('click', 'view') THEN 'text' ELSE event_type END AS label, epoch(date_trunc('second', ts)) AS a, epoch(date_trunc('second', ts)) + 90000 AS b, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS k FROM events),
f AS (SELECT user_id, event_id, k, true AS taken, [{'a': a, 'b': b, 'l': label}] AS kept FROM o WHERE k = 1 UNION ALL
  SELECT o.user_id, o.event_id, o.k, t.ok, CASE WHEN t.ok THEN list_append(f.kept, {'a': o.a, 'b': o.b, 'l': o.label}) ELSE f.kept END FROM f JOIN o ON o.user_id = f.user_id AND o.k = f.k + 1,
  LATERAL (SELECT len(list_filter(f.kept, lambda q: q.l = o.label AND greatest(least(q.b, o.b) - greatest(q.a, o.a), 0) / (180000 - greatest(least(q.b, o.b) - greatest(q.a, o.a), 0)) > 0.4)) = 0 AS ok) t)
SELECT user_id, event_id FROM f WHERE taken""")
def label_dedupe(spark, sf):
    """Boxes that overlap a better one of their class are dropped; some classes count as one."""
    e = table(spark, sf, "events").select("user_id", "event_id", "event_type", "value", F.unix_timestamp("ts").cast("double").alias("x0"))
    e = e.withColumn("x1", F.col("x0") + 90000).withColumn("y0", F.lit(0.0)).withColumn("y1", F.lit(1.0))
    return folds.distinct_boxes(e, ["user_id"], ["x0", "y0", "x1", "y1"], "event_type", "value", "event_id", 0.4, ("click", "view"))


@query("""
WITH RECURSIVE n AS (SELECT l_orderkey AS g, l_returnflag AS f, l_quantity::BIGINT AS q, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey, l_quantity) AS i FROM lineitem WHERE l_returnflag IN ('A', 'R')),
a AS (SELECT * FROM n WHERE f = 'A'), r AS (SELECT * FROM n WHERE f = 'R'), h AS (SELECT g, max(i) AS rows FROM a GROUP BY 1),
f AS (SELECT g, 0::BIGINT AS i, 0::BIGINT AS used, 0::BIGINT AS w FROM h UNION ALL SELECT f.g, f.i + 1, r.i, f.w + 60 - abs(a.q - r.q) FROM f JOIN a ON a.g = f.g AND a.i = f.i + 1 JOIN r ON r.g = f.g AND r.i > f.used)
SELECT f.g, max(f.w) AS weight, any_value(h.rows) AS placed FROM f JOIN h ON h.g = f.g AND h.rows = f.i GROUP BY 1""")
def ordered_placement(spark, sf):
    """Every element of a short row is placed on the reference in order, nearest in all."""
    w = Window.partitionBy("g", "l_returnflag").orderBy("l_linenumber", "l_partkey", "l_quantity")
    n = table(spark, sf, "lineitem").where("l_returnflag in ('A', 'R')").withColumn("g", F.col("l_orderkey")).withColumn("i", F.row_number().over(w)).select("g", "l_returnflag", "i", F.col("l_quantity").cast("long").alias("q"))
    out = folds.ordered_match(n.where("l_returnflag = 'A'"), n.where("l_returnflag = 'R'"), ["g"], "i", "q", 60.0)
    return out.groupBy("g").agg(F.sum("score").cast("long").alias("weight"), F.count(F.lit(1)).alias("placed"))


# --- identity and reports ---------------------------------------------------------------

_PARTS = """p AS (SELECT c_custkey AS id, c_nationkey AS page, left(c_mktsegment, 4) AS name, CASE WHEN c_acctbal > 0 THEN c_custkey % 3 END AS strings FROM customer)"""


@query(f"""
WITH {_PARTS}, a AS (SELECT page + 1 AS page, name, count(*) AS n, min(id) AS prev, min(strings) AS strings FROM p GROUP BY 1, 2), c AS (SELECT page, name, count(*) AS n, min(id) AS id, min(strings) AS strings FROM p GROUP BY 1, 2)
SELECT c.page, c.name, c.id, a.prev, CASE WHEN c.n > 1 OR a.n > 1 THEN 'ambiguous' WHEN a.strings <> c.strings THEN 'vetoed' ELSE 'same' END AS status FROM c JOIN a USING (page, name)""")
def part_identity(spark, sf):
    """Parts of neighbouring pages by printed name, where unique, unless what is known of both disagrees."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("page"), F.substring("c_mktsegment", 1, 4).alias("name"), F.when(F.col("c_acctbal") > 0, F.col("c_custkey") % 3).alias("strings"))
    per = c.groupBy("page", "name").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id"), F.min("strings").alias("strings"))
    prev = per.select((F.col("page") + 1).alias("page"), "name", F.col("n").alias("m"), F.col("id").alias("prev"), F.col("strings").alias("s"))
    status = F.when((F.col("n") > 1) | (F.col("m") > 1), "ambiguous").when(F.col("strings") != F.col("s"), "vetoed").otherwise("same")
    return per.join(prev, ["page", "name"]).select("page", "name", "id", "prev", status.alias("status"))


@query("""
WITH e AS (SELECT event_id, user_id, ts::DATE AS day, event_type, round(value)::BIGINT AS v FROM events), p AS (SELECT user_id, day, min(v) AS printed, count(*) AS n FROM e WHERE event_type = 'signup' GROUP BY 1, 2)
SELECT event_id, coalesce(CASE WHEN p.n = 1 THEN printed END, v) AS text, coalesce(p.n = 1, false) AS replaced FROM e LEFT JOIN p USING (user_id, day) WHERE event_type <> 'signup'""")
def printed_lookup(spark, sf):
    """A row's text replaced by the printed one of its place, where there is one."""
    e = table(spark, sf, "events").select("event_id", "user_id", F.to_date("ts").alias("day"), "event_type", F.round("value").cast("long").alias("v"))
    p = e.where("event_type = 'signup'").groupBy("user_id", "day").agg(F.min("v").alias("printed"), F.count(F.lit(1)).alias("n"))
    out = e.where("event_type <> 'signup'").join(p, ["user_id", "day"], "left")
    only = F.coalesce(F.col("n") == 1, F.lit(False))
    return out.select("event_id", F.when(only, F.col("printed")).otherwise(F.col("v")).alias("text"), only.alias("replaced"))


@query("""
WITH l AS (SELECT l_orderkey, count(*) AS events, sum(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) AS omitted, bool_or(l_tax > 0.07) AS strained FROM lineitem GROUP BY 1)
SELECT o_custkey, count(*) AS bars, sum(events)::BIGINT AS events, sum(omitted)::BIGINT AS omitted, count(*) FILTER (WHERE strained) AS warned, CASE WHEN bool_or(o_orderstatus = 'P') THEN 'failed' WHEN sum(omitted) > 0 THEN 'partial' ELSE 'complete' END AS status FROM orders JOIN l ON l_orderkey = o_orderkey GROUP BY 1""")
def export_summary(spark, sf):
    """Counters of an export, bars with warnings, and its status."""
    li = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("e"), F.count_if(F.col("l_returnflag") == "N").alias("x"), F.bool_or(F.col("l_tax") > 0.07).alias("strained"))
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus").join(li, "o_orderkey")
    out = o.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("bars"), F.sum("e").alias("events"), F.sum("x").alias("omitted"), F.count_if("strained").alias("warned"), F.bool_or(F.col("o_orderstatus") == "P").alias("f"))
    status = F.when(F.col("f"), "failed").when(F.col("omitted") > 0, "partial").otherwise("complete")
    return out.select("o_custkey", "bars", "events", "omitted", "warned", status.alias("status"))


@query("""
WITH s AS (SELECT conv_id, count(DISTINCT role) AS roles, count(*) AS turns, bool_or(length(text) = 0) AS blank FROM conversations GROUP BY 1)
SELECT conv_id, roles = 1 AS anonymous, CASE WHEN roles = 1 THEN turns ELSE 1 END AS batches, NOT blank AND roles > 1 AND turns >= 2 AS pending FROM s""")
def identity_batches(spark, sf):
    """One batch for named parts and one a system for anonymous ones; what is pending review."""
    s = table(spark, sf, "conversations").groupBy("conv_id").agg(F.size(F.collect_set("role")).alias("roles"), F.count(F.lit(1)).alias("turns"), F.bool_or(F.char_length("text") == 0).alias("blank"))
    alone = F.col("roles") == 1
    return s.select("conv_id", alone.alias("anonymous"), F.when(alone, F.col("turns")).otherwise(1).alias("batches"), (~F.col("blank") & ~alone & (F.col("turns") >= 2)).alias("pending"))


@query("""
WITH n AS (SELECT event_id, 21 + event_id % 88 AS pitch, event_id % 15 - 7 AS fifths FROM events), s(i, step, base) AS (VALUES (0, 'C', 0), (1, 'D', 2), (2, 'E', 4), (3, 'F', 5), (4, 'G', 7), (5, 'A', 9), (6, 'B', 11)),
o(step, up, down) AS (VALUES ('F', 1, 7), ('C', 2, 6), ('G', 3, 5), ('D', 4, 4), ('A', 5, 3), ('E', 6, 2), ('B', 7, 1)),
c AS (SELECT event_id, pitch, step, base, a, CASE WHEN fifths >= up THEN 1 WHEN -fifths >= down THEN -1 ELSE 0 END AS own, CASE WHEN fifths >= 0 THEN 1 ELSE -1 END AS lean FROM n, s JOIN o USING (step), (VALUES (-1), (0), (1)) AS t(a) WHERE (base + a - pitch) % 12 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY a <> own, a <> 0, a <> lean, step) AS k FROM c)
SELECT event_id, step || CASE a WHEN 1 THEN '#' WHEN -1 THEN 'b' ELSE '' END || ((pitch - a - base) // 12 - 1) AS name FROM r WHERE k = 1""")
def spelled_pitches(spark, sf):
    """Names of pitches in a key.  The names of 128 pitches in 15 keys are a literal table."""
    names = [[exchange.spelled(p, f) for p in range(128)] for f in range(-7, 8)]
    rows = F.from_json(F.lit(str(names).replace("'", '"')), "array<array<string>>")
    e = table(spark, sf, "events").select("event_id")
    return e.select("event_id", F.get(F.get(rows, (F.col("event_id") % 15).cast("int")), (21 + F.col("event_id") % 88).cast("int")).alias("name"))


@query("""
WITH d AS (SELECT doc_id, source, lang, n_chars FROM documents), t AS (SELECT source, array_to_string(list(doc_id ORDER BY n_chars DESC, doc_id)[1:5], ',') AS longest, count(*) AS n FROM d GROUP BY 1)
SELECT source, n, longest, CASE WHEN n > 1 THEN 'shared' ELSE 'single' END AS kind FROM t""")
def review_lists(spark, sf):
    """Of each source the rows to look at first (the report's own five), and what is told of it."""
    d = table(spark, sf, "documents").select("doc_id", "source", "n_chars")
    w = Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    top = d.withColumn("k", F.row_number().over(w)).where("k <= 5").groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "doc_id"))), lambda x: x["doc_id"].cast("string")), ",").alias("longest"))
    n = d.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return n.join(top, "source").select("source", "n", "longest", F.when(F.col("n") > 1, "shared").otherwise("single").alias("kind"))
