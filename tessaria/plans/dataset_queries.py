"""Evaluation, geometry, splits and incremental forms over the driver's tables, each with its SQL."""

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


# --- evaluation ------------------------------------------------------------------


@query("""
WITH c AS (SELECT l_suppkey AS g, l_partkey % 10 AS onset, l_linenumber AS pitch, l_quantity::BIGINT % 3 AS len, l_returnflag AS f FROM lineitem WHERE l_returnflag IN ('A', 'R')),
d AS (SELECT g, onset, pitch, len, count(*) FILTER (WHERE f = 'A') AS e, count(*) FILTER (WHERE f = 'R') AS p FROM c GROUP BY 1, 2, 3, 4),
x AS (SELECT g, sum(least(e, p)) AS exact FROM d GROUP BY 1), n AS (SELECT g, onset, pitch, sum(e) AS e, sum(p) AS p FROM d GROUP BY 1, 2, 3),
y AS (SELECT g, sum(e) AS expected, sum(p) AS predicted, sum(least(e, p)) AS content FROM n GROUP BY 1)
SELECT g, expected::BIGINT AS expected, predicted::BIGINT AS predicted, exact::BIGINT AS exact, (content - exact)::BIGINT AS wrong_duration, (expected - content)::BIGINT AS missing, (predicted - content)::BIGINT AS extra
FROM x JOIN y USING (g)""")
def content_taxonomy(spark, sf):
    """Content with and without duration, and what the rest is: wrong duration, missing, extra."""
    c = table(spark, sf, "lineitem").where("l_returnflag in ('A', 'R')")
    expected = F.col("l_returnflag") == "A"
    keys = [F.col("l_suppkey").alias("g"), (F.col("l_partkey") % 10).alias("onset"), F.col("l_linenumber").alias("pitch"), (F.col("l_quantity").cast("long") % 3).alias("len")]
    d = c.groupBy(*keys).agg(F.count_if(expected).alias("e"), F.count_if(~expected).alias("p")).withColumn("x", F.least("e", "p"))
    n = d.groupBy("g", "onset", "pitch").agg(F.sum("e").alias("e"), F.sum("p").alias("p"), F.sum("x").alias("x"))
    t = n.groupBy("g").agg(F.sum("e").alias("expected"), F.sum("p").alias("predicted"), F.sum("x").alias("exact"), F.sum(F.least("e", "p")).alias("content"))
    rest = [("wrong_duration", "content", "exact"), ("missing", "expected", "content"), ("extra", "predicted", "content")]
    return t.select("g", "expected", "predicted", "exact", *[(F.col(a) - F.col(b)).alias(n) for n, a, b in rest])


@query("""
WITH t AS (SELECT user_id, ts::DATE AS day, event_type || ':' || (event_id % 3) AS effect, event_id % 2 AS side FROM events),
s AS (SELECT DISTINCT user_id, day, effect, side FROM t WHERE effect LIKE 'view%' UNION ALL SELECT * FROM t WHERE effect NOT LIKE 'view%'),
n AS (SELECT split_part(effect, ':', 1) AS kind, effect, user_id, day, count(*) FILTER (WHERE side = 0) AS e, count(*) FILTER (WHERE side = 1) AS p FROM s GROUP BY ALL)
SELECT kind, sum(e)::BIGINT AS expected, sum(p)::BIGINT AS predicted, sum(least(e, p))::BIGINT AS correct, round(2 * sum(least(e, p)) / nullif(sum(e) + sum(p), 0)::DOUBLE, 9) AS f1 FROM n GROUP BY 1""")
def technique_classes(spark, sf):
    """Effects by class; marks that span a beat count once in it."""
    effect = F.concat_ws(":", "event_type", (F.col("event_id") % 3).cast("string"))
    t = table(spark, sf, "events").select("user_id", F.to_date("ts").alias("day"), effect.alias("effect"), (F.col("event_id") % 2).alias("side"))
    n = t.groupBy("user_id", "day", "effect").agg(F.count_if(F.col("side") == 0).alias("e"), F.count_if(F.col("side") == 1).alias("p"))
    span = F.col("effect").startswith("view")
    n = n.withColumns({c: F.when(span, F.least(F.col(c), F.lit(1))).otherwise(F.col(c)) for c in ("e", "p")})
    out = n.groupBy(F.split_part("effect", F.lit(":"), F.lit(1)).alias("kind")).agg(F.sum("e").alias("expected"), F.sum("p").alias("predicted"), F.sum(F.least("e", "p")).alias("correct"))
    return out.withColumn("f1", F.round(A.ratio(2 * F.col("correct"), F.col("expected") + F.col("predicted")), 9))


@query("""
WITH r AS (SELECT user_id, event_type AS kind, CASE WHEN value > 50 THEN round(value)::BIGINT % 4 END AS value, event_id % 2 AS side, CASE WHEN event_id % 7 > 0 THEN event_id % 5 END AS place FROM events),
m AS (SELECT user_id, kind, value, coalesce(place::VARCHAR, 'unmatched') AS place, count(*) FILTER (WHERE side = 0) AS e, count(*) FILTER (WHERE side = 1) AS p FROM r GROUP BY ALL)
SELECT kind, sum(e)::BIGINT AS expected, sum(p)::BIGINT AS predicted, sum(CASE WHEN place = 'unmatched' THEN 0 ELSE least(e, p) END)::BIGINT AS correct FROM m GROUP BY ROLLUP (kind)""")
def relation_multisets(spark, sf):
    """Relations by kind, value and mapped endpoint; one whose endpoint has no partner is never right."""
    r = table(spark, sf, "events").select(
        "user_id", F.col("event_type").alias("kind"), F.when(F.col("value") > 50, F.round("value").cast("long") % 4).alias("value"), (F.col("event_id") % 2).alias("side"),
        F.coalesce(F.when(F.col("event_id") % 7 > 0, (F.col("event_id") % 5).cast("string")), F.lit("unmatched")).alias("place"),
    )
    m = r.groupBy("user_id", "kind", "value", "place").agg(F.count_if(F.col("side") == 0).alias("e"), F.count_if(F.col("side") == 1).alias("p"))
    right = F.when(F.col("place") != "unmatched", F.least("e", "p")).otherwise(0)
    return m.rollup("kind").agg(F.sum("e").alias("expected"), F.sum("p").alias("predicted"), F.sum(right).alias("correct"))


@query("""
WITH d AS (SELECT doc_id, source, quality, toxic, n_chars FROM documents JOIN labels USING (doc_id))
SELECT source, count(*) AS n, count(*) FILTER (WHERE quality = 1) AS accepted, count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS right_accepted,
  round(count(*) FILTER (WHERE quality = 1 AND toxic = 0) / nullif(count(*) FILTER (WHERE quality = 1), 0)::DOUBLE, 9) AS precision, count(*) FILTER (WHERE quality = 1 AND toxic = 0 AND n_chars > 500) AS gated FROM d GROUP BY 1""")
def gated_precision(spark, sf):
    """Accepted and right among accepted, behind one more gate."""
    d = table(spark, sf, "documents").select("doc_id", "source", "n_chars").join(table(spark, sf, "labels"), "doc_id")
    ok, right = F.col("quality") == 1, (F.col("quality") == 1) & (F.col("toxic") == 0)
    out = d.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("accepted"), F.count_if(right).alias("right_accepted"), F.count_if(right & (F.col("n_chars") > 500)).alias("gated"))
    return out.withColumn("precision", F.round(A.ratio(F.col("right_accepted"), F.col("accepted")), 9))


@query("""
WITH p AS (SELECT l_orderkey AS page, count(*) FILTER (WHERE l_returnflag <> 'N') AS truth, count(*) FILTER (WHERE l_linestatus = 'F') AS found, count(*) FILTER (WHERE l_returnflag <> 'N' AND l_linestatus = 'F') AS hits FROM lineitem GROUP BY 1)
SELECT count(*) AS pages, count(*) FILTER (WHERE hits = truth AND hits = found) AS perfect, sum(truth)::BIGINT AS truth, sum(found)::BIGINT AS found, sum(hits)::BIGINT AS hits,
  round(100 * (sum(truth) - sum(hits)) / nullif(sum(truth), 0)::DOUBLE, 6) AS missed_per_100, round(100 * (sum(found) - sum(hits)) / nullif(sum(truth), 0)::DOUBLE, 6) AS extra_per_100 FROM p""")
def page_detection(spark, sf):
    """Recall, precision and perfect pages; missed and extra for each hundred."""
    truth, found = F.col("l_returnflag") != "N", F.col("l_linestatus") == "F"
    p = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count_if(truth).alias("t"), F.count_if(found).alias("f"), F.count_if(truth & found).alias("h"))
    out = p.agg(F.count(F.lit(1)).alias("pages"), F.count_if((F.col("h") == F.col("t")) & (F.col("h") == F.col("f"))).alias("perfect"), F.sum("t").alias("truth"), F.sum("f").alias("found"), F.sum("h").alias("hits"))
    per = lambda c: F.round(A.ratio(100 * (F.col(c) - F.col("hits")), F.col("truth")), 6)
    return out.withColumns({"missed_per_100": per("truth"), "extra_per_100": per("found")})


@query("""
WITH g AS (SELECT p_partkey, p_brand, p_size, p_retailprice FROM part), o AS (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1)
SELECT p_partkey, bool_and((p_size > 25 AND n > 20) OR p_size <= 25) AS equal FROM g LEFT JOIN o ON l_partkey = p_partkey GROUP BY 1""")
def visible_equality(spark, sf):
    """Rows agree where they agree on the fields that the first side knows."""
    o = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count(F.lit(1)).alias("n"))
    p = table(spark, sf, "part").select("p_partkey", "p_size").join(o, "p_partkey", "left")
    known = F.when(F.col("p_size") > 25, F.col("n") > 20).otherwise(True)
    return p.select("p_partkey", known.alias("equal"))


# --- grouping and evidence ---------------------------------------------------------


@query("""
WITH f AS (SELECT c_nationkey AS family, count(DISTINCT c_mktsegment) AS tracks, min(n) AS systems FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2) JOIN customer USING (c_nationkey, c_mktsegment) GROUP BY 1)
SELECT family, tracks, systems, tracks * systems AS kept FROM f WHERE tracks BETWEEN 2 AND 5""")
def gallery_groups(spark, sf):
    """Families of a few tracks, cut to as many systems as the shortest has."""
    per = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("family"), "c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    out = per.groupBy("family").agg(F.count(F.lit(1)).alias("tracks"), F.min("n").alias("systems")).where("tracks between 2 and 5")
    return out.withColumn("kept", F.col("tracks") * F.col("systems"))


@query("""
WITH u AS (SELECT user_id, sum(length(props)) AS bytes, count(*) AS jobs, sum(greatest(value - 20, 0)) AS spent FROM events GROUP BY 1)
SELECT user_id, bytes::BIGINT AS bytes, jobs, round(spent, 4) AS spent, CASE WHEN bytes > 300 THEN 'bytes' WHEN jobs > 8 THEN 'jobs' END AS over FROM u""")
def usage_quota(spark, sf):
    """What an account uses, and the first quota that it is over."""
    u = table(spark, sf, "events").groupBy("user_id").agg(F.sum(F.char_length("props")).alias("bytes"), F.count(F.lit(1)).alias("jobs"), F.round(F.sum(F.greatest(F.col("value") - 20, F.lit(0.0))), 4).alias("spent"))
    return u.withColumn("over", F.when(F.col("bytes") > 300, "bytes").when(F.col("jobs") > 8, "jobs"))


@query("""
WITH d AS (SELECT lang, source, n_chars, quality FROM documents JOIN labels USING (doc_id)), g AS (SELECT lang, n_chars, count(*) AS n, sum(quality) AS h FROM d GROUP BY 1, 2),
r AS (SELECT lang, n_chars, sum(n) OVER w AS n, sum(h) OVER w AS h FROM g WINDOW w AS (PARTITION BY lang ORDER BY n_chars DESC ROWS UNBOUNDED PRECEDING)),
t AS (SELECT lang, min(n_chars) AS outer_limit FROM r WHERE h >= 0.7 * n GROUP BY 1), i AS (SELECT d.lang, d.source, d.n_chars, d.quality FROM d JOIN t ON t.lang = d.lang AND d.n_chars >= outer_limit),
g2 AS (SELECT lang, source, n_chars, count(*) AS n, sum(quality) AS h FROM i GROUP BY 1, 2, 3), r2 AS (SELECT lang, source, n_chars, sum(n) OVER w AS n, sum(h) OVER w AS h FROM g2 WINDOW w AS (PARTITION BY lang, source ORDER BY n_chars DESC ROWS UNBOUNDED PRECEDING))
SELECT lang, source, min(n_chars) AS inner_limit, max(n)::BIGINT AS accepted FROM r2 WHERE h >= 0.9 * n GROUP BY 1, 2""")
def hierarchical_thresholds(spark, sf):
    """A threshold for the whole, then one for each field among what the first lets through."""
    from ..operators.ordered import running_precision

    d = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id")
    good = F.col("quality") == 1
    first = running_precision(d, ["lang"], "n_chars", good).where(F.col("hits") * 10 >= F.col("n") * 7).groupBy("lang").agg(F.min("n_chars").alias("outer"))
    inner = d.join(first, "lang").where(F.col("n_chars") >= F.col("outer"))
    second = running_precision(inner, ["lang", "source"], "n_chars", good).where(F.col("hits") * 10 >= F.col("n") * 9)
    return second.groupBy("lang", "source").agg(F.min("n_chars").alias("inner_limit"), F.max("n").alias("accepted"))


@query("""
SELECT o_custkey, CASE WHEN count(DISTINCT o_orderstatus) = 1 THEN min(o_orderstatus) END AS category, count(DISTINCT o_orderstatus) AS found, bool_or(o_totalprice > 200000) AND NOT bool_and(o_totalprice > 200000) AS mixed FROM orders GROUP BY 1""")
def unique_category(spark, sf):
    """A category only where all evidence agrees; whether a mark is on some but not all."""
    o = table(spark, sf, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderstatus").alias("s"), F.bool_or(F.col("o_totalprice") > 200000).alias("some"), F.bool_and(F.col("o_totalprice") > 200000).alias("every"))
    return o.select("o_custkey", F.when(F.size("s") == 1, F.get("s", F.lit(0))).alias("category"), F.size("s").cast("long").alias("found"), (F.col("some") & ~F.col("every")).alias("mixed"))


@query("""
WITH m AS (SELECT o_custkey AS part, o_orderstatus AS staff, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate, o_orderkey) AS bar, o_orderpriority AS target FROM orders),
s AS (SELECT part, staff, min(id) AS first_id, count(*) AS bars, array_to_string(list(left(target, 1) ORDER BY bar), '') AS text FROM m GROUP BY 1, 2)
SELECT part, row_number() OVER (PARTITION BY part ORDER BY first_id) - 1 AS staff_number, staff, bars, text FROM s""")
def score_document(spark, sf):
    """Records grouped to parts, staves by first appearance, and measures in order."""
    w = Window.partitionBy("part", "staff").orderBy("o_orderdate", "id")
    m = table(spark, sf, "orders").select(F.col("o_custkey").alias("part"), F.col("o_orderstatus").alias("staff"), F.col("o_orderkey").alias("id"), "o_orderdate", F.substring("o_orderpriority", 1, 1).alias("t"))
    m = m.withColumn("bar", F.row_number().over(w))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bar", "t"))), lambda x: x["t"]), "")
    s = m.groupBy("part", "staff").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("bars"), text.alias("text"))
    number = F.row_number().over(Window.partitionBy("part").orderBy("first")) - 1
    return s.select("part", number.cast("long").alias("staff_number"), "staff", "bars", "text")


@query("""
WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate, lag(l_shipdate) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_shipdate) AS prev FROM lineitem),
v AS (SELECT l_orderkey, l_linenumber, prev IS NOT NULL AND l_shipdate < prev AS back, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) > 1 AS twice FROM r)
SELECT l_orderkey, CASE WHEN bool_or(twice) THEN 'duplicate_index' WHEN max(l_linenumber) <> count(*) THEN 'not_contiguous' WHEN bool_or(back) THEN 'out_of_order' END AS problem, count(*) FILTER (WHERE back) AS steps_back FROM v GROUP BY 1""")
def projection_problems(spark, sf):
    """The first problem of a document's timeline: doubled index, hole, step back."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_shipdate")
    r = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")
    r = r.withColumn("back", F.coalesce(F.col("l_shipdate") < F.lag("l_shipdate").over(w), F.lit(False)))
    per = r.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.size(F.collect_set("l_linenumber")).alias("d"), F.max("l_linenumber").alias("most"), F.count_if("back").alias("steps_back"))
    problem = F.when(F.col("d") < F.col("n"), "duplicate_index").when(F.col("most") != F.col("n"), "not_contiguous").when(F.col("steps_back") > 0, "out_of_order")
    return per.select("l_orderkey", problem.alias("problem"), "steps_back")


@query("""
WITH a AS (SELECT l_orderkey, l_linenumber, l_returnflag AS effect FROM lineitem), v AS (SELECT l_orderkey, l_linenumber, array_to_string(list_sort(list(DISTINCT effect)), ',') AS effects FROM a GROUP BY 1, 2),
o AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')
SELECT l_orderkey, l_linenumber, effects, CASE WHEN o_orderkey IS NULL THEN 'no_anchor' WHEN contains(effects, 'N') THEN 'effect_not_allowed' END AS problem FROM v LEFT JOIN o ON o_orderkey = l_orderkey""")
def overlay_effects(spark, sf):
    """Marks united by anchor, and whether the anchor exists and its effects are allowed."""
    v = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.array_sort(F.collect_set("l_returnflag")).alias("e"))
    o = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(True).alias("here"))
    v = v.join(o, "l_orderkey", "left")
    problem = F.when(F.col("here").isNull(), "no_anchor").when(F.size(F.array_except("e", F.array(F.lit("A"), F.lit("R")))) > 0, "effect_not_allowed")
    return v.select("l_orderkey", "l_linenumber", F.array_join("e", ",").alias("effects"), problem.alias("problem"))


# --- geometry -----------------------------------------------------------------------

_BOXES = """b AS (SELECT p_partkey AS id, p_brand AS page, (p_partkey * 37) % 1000 AS x, (p_partkey * 91) % 1400 AS y, 20 + p_size AS w, 30 AS h FROM part)"""


def boxes(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_brand", "p_size")
    return p.select(
        F.col("p_partkey").alias("id"), F.col("p_brand").alias("page"), (F.col("p_partkey") * 37 % 1000).alias("x"), (F.col("p_partkey") * 91 % 1400).alias("y"),
        (20 + F.col("p_size")).cast("long").alias("w"), F.lit(30).cast("long").alias("h"),
    )


@query(f"""
WITH {_BOXES}, c AS (SELECT id, page, greatest(x, 100) AS x0, greatest(y, 200) AS y0, least(x + w, 800) AS x1, least(y + h, 1100) AS y1 FROM b)
SELECT id, page, x0, y0, x1 - x0 AS w, y1 - y0 AS h, row_number() OVER (PARTITION BY page ORDER BY y0, x0, id) - 1 AS place FROM c WHERE x1 - x0 >= 2 AND y1 - y0 >= 2""")
def clipped_boxes(spark, sf):
    """Boxes clipped to the page, slivers dropped, in reading order."""
    c = boxes(spark, sf).select("id", "page", F.greatest("x", F.lit(100)).alias("x0"), F.greatest("y", F.lit(200)).alias("y0"), F.least(F.col("x") + F.col("w"), F.lit(800)).alias("x1"), F.least(F.col("y") + F.col("h"), F.lit(1100)).alias("y1"))
    c = c.select("id", "page", "x0", "y0", (F.col("x1") - F.col("x0")).alias("w"), (F.col("y1") - F.col("y0")).alias("h")).where("w >= 2 and h >= 2")
    return c.withColumn("place", (F.row_number().over(Window.partitionBy("page").orderBy("y0", "x0", "id")) - 1).cast("long"))


@query(f"""
WITH {_BOXES}, t AS (SELECT b.*, tx, ty FROM b, generate_series(0, 3) AS a(tx), generate_series(0, 4) AS c(ty) WHERE x + w > tx * 300 AND x < tx * 300 + 360 AND y + h > ty * 300 AND y < ty * 300 + 360)
SELECT id, count(*) AS tiles, count(*) FILTER (WHERE x >= tx * 300 AND x + w <= tx * 300 + 360 AND y >= ty * 300 AND y + h <= ty * 300 + 360) AS whole FROM t GROUP BY 1""")
def tile_coverage(spark, sf):
    """Overlapping tiles that show a box, and those that show it whole; found by arithmetic, not by a cross join."""

    def tiles(at, size, last):
        # tile t spans [300 t, 300 t + 360)
        first = F.greatest(F.floor((F.col(at) - 360) / 300) + 1, F.lit(0))
        final = F.least(F.ceil((F.col(at) + F.col(size)) / 300) - 1, F.lit(last))
        whole = F.filter(F.sequence(first, final), lambda t: (F.col(at) >= t * 300) & (F.col(at) + F.col(size) <= t * 300 + 360))
        return final - first + 1, F.size(whole).cast("long")

    b = boxes(spark, sf)
    (nx, wx), (ny, wy) = tiles("x", "w", 3), tiles("y", "h", 4)
    return b.select("id", (nx * ny).alias("tiles"), (wx * wy).alias("whole")).where("tiles > 0")


@query(f"""
WITH {_BOXES}, r AS (SELECT page, y // 100 AS row, min(y) AS top, max(y + h) AS bottom, count(*) AS n FROM b GROUP BY 1, 2), m AS (SELECT page, row, top, max(bottom) OVER (PARTITION BY page ORDER BY row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS above FROM r)
SELECT r.page, r.row, (r.top + r.bottom) / 2.0 AS centre, least(coalesce(m.above, 0), r.top) AS bound, r.n FROM r JOIN m USING (page, row)""")
def row_bounds(spark, sf):
    """Centres of rows and the nearest bound above them."""
    r = boxes(spark, sf).groupBy("page", F.floor(F.col("y") / 100).alias("row")).agg(F.min("y").alias("top"), F.max(F.col("y") + F.col("h")).alias("bottom"), F.count(F.lit(1)).alias("n"))
    above = F.max("bottom").over(Window.partitionBy("page").orderBy("row").rowsBetween(Window.unboundedPreceding, -1))
    r = r.withColumn("above", above)
    return r.select("page", "row", ((F.col("top") + F.col("bottom")) / 2.0).alias("centre"), F.least(F.coalesce("above", F.lit(0)), "top").alias("bound"), "n")


@query(f"""
WITH RECURSIVE {_BOXES}, e AS (SELECT a.id AS a, c.id AS c FROM b a JOIN b c ON a.page = c.page AND a.x < c.x + c.w + 10 AND c.x < a.x + a.w + 10 AND a.y < c.y + c.h + 10 AND c.y < a.y + a.h + 10),
k AS (SELECT id AS v, id AS r FROM b UNION SELECT e.c, k.r FROM k JOIN e ON e.a = k.v), m AS (SELECT v, min(r) AS comp FROM k GROUP BY 1)
SELECT comp, min(x) AS x0, min(y) AS y0, max(x + w) AS x1, max(y + h) AS y1, count(*) AS n FROM m JOIN b ON id = v GROUP BY 1""")
def touching_groups(spark, sf):
    """Boxes that touch within a margin, as groups with their envelopes.  A page is a bounded group."""
    return folds.touching(boxes(spark, sf), ["page"], ["x", "y", "w", "h"], "id", 10).select("comp", "x0", "y0", "x1", "y1", "n")


@query(f"""
WITH RECURSIVE {_BOXES}, o AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY y, id) AS k FROM b),
f AS (SELECT page, k, [{{'x': x, 'y': y, 'w': w, 'id': id}}] AS kept, true AS taken, id FROM o WHERE k = 1 UNION ALL
  SELECT o.page, o.k, CASE WHEN t.ok THEN list_append(f.kept, {{'x': o.x, 'y': o.y, 'w': o.w, 'id': o.id}}) ELSE f.kept END, t.ok, o.id FROM f JOIN o ON o.page = f.page AND o.k = f.k + 1,
  LATERAL (SELECT len(list_filter(f.kept, lambda q: greatest(least(q.x + q.w, o.x + o.w) - greatest(q.x, o.x), 0) * greatest(least(q.y, o.y) + 30 - greatest(q.y, o.y), 0) > 0.3 * o.w * 30)) = 0 AS ok) t)
SELECT page, id FROM f WHERE taken""")
def uncovered_regions(spark, sf):
    """Proposals in order, less those that an earlier one covers by more than a share."""
    return folds.uncovered(boxes(spark, sf), ["page"], ["x", "y", "w", "h"], "id", "y", 0.3)


# --- dataset engineering ---------------------------------------------------------------


@query("SELECT p_partkey FROM part WHERE p_size BETWEEN 8 AND 40 AND p_retailprice >= 1000 AND p_partkey % 9 BETWEEN 4 AND 8")
def eligible_sources(spark, sf):
    """Sources within the limits."""
    p = table(spark, sf, "part").where(F.col("p_size").between(8, 40) & (F.col("p_retailprice") >= 1000) & (F.col("p_partkey") % 9).between(4, 8))
    return p.select("p_partkey")


@query("""
WITH v AS (SELECT l_orderkey, list_sort(list(DISTINCT l_linenumber)) AS frets, count(*) AS n FROM lineitem GROUP BY 1),
r AS (SELECT l_orderkey, CASE WHEN n < 2 THEN 'too_few' WHEN list_max(frets) - list_min(frets) > 4 THEN 'span' WHEN NOT list_has_all(frets, [1]) THEN 'no_root' END AS reason FROM v)
SELECT coalesce(reason, 'accepted') AS reason, count(*) AS n FROM r GROUP BY 1""")
def rejection_counts(spark, sf):
    """The first reason against each voicing, counted."""
    v = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_linenumber").alias("f"), F.count(F.lit(1)).alias("n"))
    reason = F.when(F.col("n") < 2, "too_few").when(F.array_max("f") - F.array_min("f") > 4, "span").when(~F.array_contains("f", 1), "no_root").otherwise("accepted")
    return v.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH n AS (SELECT doc_id, lang, quality, row_number() OVER (PARTITION BY lang, quality ORDER BY sha256(doc_id::VARCHAR)) AS k FROM documents JOIN labels USING (doc_id))
SELECT lang, quality, count(*) AS n FROM n WHERE quality = 1 OR k <= 10 GROUP BY 1, 2""")
def capped_negatives(spark, sf):
    """All positives, and as many negatives of a group as its quota (the operator's own limit)."""
    d = table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id")
    few = D.bottom_k(d.where("quality <> 1"), ["lang", "quality"], F.sha2(F.col("doc_id").cast("string"), 256), 10).drop("rank")
    return d.where("quality = 1").unionByName(few).groupBy("lang", "quality").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH w AS (SELECT conv_id, turn, role, lower(regexp_replace(trim(text), '\\s+', ' ', 'g')) AS t FROM conversations), a AS (SELECT conv_id, turn, t FROM w WHERE role = 'assistant'), u AS (SELECT conv_id, string_agg(t, ' ' ORDER BY turn) AS said FROM w WHERE role = 'user' GROUP BY 1)
SELECT a.conv_id, bool_and(contains(coalesce(u.said, ''), split_part(a.t, ' ', 1))) AS accepted, count(*) AS fields FROM a LEFT JOIN u USING (conv_id) GROUP BY 1""")
def header_acceptance(spark, sf):
    """Accepted where every value is found in the printed text."""
    t = F.lower(F.regexp_replace(F.trim("text"), r"\s+", " "))
    w = table(spark, sf, "conversations").select("conv_id", "turn", "role", t.alias("t"))
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "t"))), lambda x: x["t"]), " ")
    u = w.where("role = 'user'").groupBy("conv_id").agg(said.alias("said"))
    a = w.where("role = 'assistant'").join(u, "conv_id", "left")
    found = F.contains(F.coalesce("said", F.lit("")), F.split_part("t", F.lit(" "), F.lit(1)))
    return a.groupBy("conv_id").agg(F.bool_and(found).alias("accepted"), F.count(F.lit(1)).alias("fields"))


@query("""
WITH e AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'purchase') AS shown, count(*) FILTER (WHERE event_type = 'purchase' AND value > 60) AS control, count(*) FILTER (WHERE event_type = 'click') AS marks FROM events GROUP BY 1)
SELECT user_id, CASE WHEN control > 0 AND shown > control THEN 'visible' WHEN control > 0 THEN 'absent' ELSE 'unknown' END AS evidence, CASE WHEN control > 0 AND shown = control THEN 0 ELSE marks END AS marks FROM e""")
def visibility_evidence(spark, sf):
    """Absence needs a positive control; marks go only on evidence of absence."""
    e = table(spark, sf, "events")
    bought = F.col("event_type") == "purchase"
    e = e.groupBy("user_id").agg(F.count_if(bought).alias("shown"), F.count_if(bought & (F.col("value") > 60)).alias("control"), F.count_if(F.col("event_type") == "click").alias("m"))
    absent = (F.col("control") > 0) & (F.col("shown") == F.col("control"))
    kind = F.when((F.col("control") > 0) & ~absent, "visible").when(absent, "absent").otherwise("unknown")
    return e.select("user_id", kind.alias("evidence"), F.when(absent, 0).otherwise(F.col("m")).alias("marks"))


@query("""
WITH t AS (SELECT doc_id, lang, ceil(n_chars / 128.0)::BIGINT * 128 AS size, n_chars FROM documents), o AS (SELECT lang, size, doc_id, row_number() OVER (PARTITION BY lang, size ORDER BY doc_id) - 1 AS k FROM t)
SELECT lang, size, k // greatest(16384 // greatest(size, 128), 1) AS batch, count(*) AS n, min(doc_id) AS first_id FROM o GROUP BY 1, 2, 3""")
def token_batches(spark, sf):
    """Batches of one length class within a budget of tokens."""
    t = table(spark, sf, "documents").select("lang", "doc_id", (F.ceil(F.col("n_chars") / 128.0) * 128).cast("long").alias("size"))
    k = F.row_number().over(Window.partitionBy("lang", "size").orderBy("doc_id")) - 1
    room = F.greatest(F.floor(F.lit(16384) / F.greatest("size", F.lit(128))), F.lit(1))
    return t.withColumn("batch", F.floor(k / room)).groupBy("lang", "size", "batch").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"))


@query("""
WITH r AS (SELECT user_id, event_id, event_type, value, CASE WHEN event_type = 'signup' THEN 0 WHEN event_type IN ('click', 'view') THEN 1 ELSE 2 END AS class FROM events)
SELECT user_id, array_to_string(list(event_id ORDER BY class, event_type, event_id), ',') AS relations, array_to_string(list(event_id ORDER BY value DESC, event_id) FILTER (WHERE value > 120), ',') AS review FROM r GROUP BY 1""")
def relation_order(spark, sf):
    """Relations in canonical order, entering, local, exiting; and the list for review."""
    kind = F.when(F.col("event_type") == "signup", 0).when(F.col("event_type").isin("click", "view"), 1).otherwise(2)
    r = table(spark, sf, "events").groupBy("user_id").agg(
        F.array_sort(F.collect_list(F.struct(kind.alias("c"), "event_type", "event_id"))).alias("a"),
        F.array_sort(F.collect_list(F.when(F.col("value") > 120, F.struct((-F.col("value")).alias("v"), "event_id")))).alias("b"),
    )
    text = lambda c: F.array_join(F.transform(c, lambda x: x["event_id"].cast("string")), ",")
    return r.select("user_id", text("a").alias("relations"), F.nullif(text("b"), F.lit("")).alias("review"))


# --- incremental forms --------------------------------------------------------------------


@query("""
WITH old AS (SELECT o_orderkey AS k, o_totalprice AS v FROM orders), new AS (SELECT l_orderkey AS k, sum(l_extendedprice) AS v FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT old.k, round(coalesce(new.v, old.v), 2) AS v, CASE WHEN new.k IS NULL THEN 'kept' ELSE 'redone' END AS origin FROM old LEFT JOIN new USING (k)""")
def partial_retry(spark, sf):
    """Selected keys come from a new run, in any order, all others from the one before."""
    old = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    new = table(spark, sf, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("k")).agg(F.sum("l_extendedprice").alias("n"))
    both = old.join(new, "k", "left")
    return both.select("k", F.round(F.coalesce("n", "v"), 2).alias("v"), F.when(F.col("n").isNull(), "kept").otherwise("redone").alias("origin"))


@query("""
WITH a AS (SELECT c_nationkey AS g, array_to_string(list_sort(list(DISTINCT c_custkey)), ',') AS m, max(c_acctbal) AS edit FROM customer WHERE c_custkey % 50 > 0 GROUP BY 1),
b AS (SELECT c_nationkey AS g, array_to_string(list_sort(list(DISTINCT c_custkey)), ',') AS m, min(c_acctbal) AS model FROM customer GROUP BY 1)
SELECT b.g, round(CASE WHEN a.m = b.m THEN edit ELSE model END, 2) AS value, coalesce(a.m = b.m, false) AS kept_edit FROM b LEFT JOIN a USING (g)""")
def preserved_edits(spark, sf):
    """An edit survives where the group's members are the same as before.  Members are compared by count and two order-free digests, not collected."""
    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("g"), "c_custkey", "c_acctbal")

    def members(df, value, name):
        h = F.xxhash64("c_custkey")
        return df.groupBy("g").agg(F.struct(F.count(F.lit(1)), F.bit_xor(h), F.sum(F.col("c_custkey"))).alias(f"m_{name}"), value.alias(name))

    both = members(c, F.min("c_acctbal"), "model").join(members(c.where("c_custkey % 50 > 0"), F.max("c_acctbal"), "edit"), "g", "left")
    same = F.coalesce(F.col("m_model") == F.col("m_edit"), F.lit(False))
    return both.select("g", F.round(F.when(same, F.col("edit")).otherwise(F.col("model")), 2).alias("value"), same.alias("kept_edit"))


@query("""
WITH r AS (SELECT user_id, event_type, event_id, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events),
o AS (SELECT user_id, max(CASE WHEN event_type = 'view' THEN value END) AS original, max(CASE WHEN event_type = 'click' THEN value END) AS edited, bool_or(event_type = 'error') AS reset FROM r WHERE k = 1 GROUP BY 1)
SELECT user_id, CASE WHEN reset OR edited IS NULL THEN original ELSE edited END AS value, original, NOT reset AND edited IS NOT NULL AS reviewed FROM o""")
def reviewed_values(spark, sf):
    """The last edit over the original, which is kept; a reset brings it back."""
    e = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.max_by("value", F.struct("ts", "event_id")).alias("v"))
    of = lambda kind: F.max(F.when(F.col("event_type") == kind, F.col("v")))
    o = e.groupBy("user_id").agg(of("view").alias("original"), of("click").alias("edited"), F.bool_or(F.col("event_type") == "error").alias("reset"))
    edited = ~F.col("reset") & F.col("edited").isNotNull()
    return o.select("user_id", F.when(edited, F.col("edited")).otherwise(F.col("original")).alias("value"), "original", edited.alias("reviewed"))


@query("""
WITH t AS (SELECT l_orderkey AS ev, count(*) FILTER (WHERE l_returnflag = 'A') AS tab, count(*) FILTER (WHERE l_returnflag = 'R') AS staff FROM lineitem GROUP BY 1),
n AS (SELECT l_orderkey AS ev, l_returnflag AS f, l_linenumber, l_partkey, l_quantity, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey, l_quantity) - 1 AS i FROM lineitem WHERE l_returnflag IN ('A', 'R'))
SELECT ev, f, i, i + CASE WHEN f = 'R' THEN tab ELSE 0 END AS flat FROM n JOIN t USING (ev)""")
def flattened_notes(spark, sf):
    """Two lists of notes as one, with the second's places moved behind the first's."""
    n = table(spark, sf, "lineitem").where("l_returnflag in ('A', 'R')").select(F.col("l_orderkey").alias("ev"), F.col("l_returnflag").alias("f"), "l_linenumber", "l_partkey", "l_quantity")
    i = F.row_number().over(Window.partitionBy("ev", "f").orderBy("l_linenumber", "l_partkey", "l_quantity")) - 1
    tab = F.count_if(F.col("f") == "A").over(Window.partitionBy("ev"))
    n = n.withColumn("i", i.cast("long")).withColumn("tab", tab)
    return n.select("ev", "f", "i", (F.col("i") + F.when(F.col("f") == "R", F.col("tab")).otherwise(0)).alias("flat"))


@query("""
WITH v AS (SELECT p_partkey, p_size, unnest(['guitar', 'bass', 'ukulele']) AS instrument, unnest([6, 4, 4]) AS strings, unnest([0, -12, 5]) AS shift FROM part)
SELECT p_partkey, instrument, strings::BIGINT AS strings, (p_size + shift)::BIGINT AS pitch FROM v WHERE p_size + shift >= 0""")
def instrument_variants(spark, sf):
    """One row for each instrument that can play it."""
    kinds = F.array(*[F.struct(F.lit(n).alias("instrument"), F.lit(s).cast("long").alias("strings"), F.lit(d).alias("shift")) for n, s, d in (("guitar", 6, 0), ("bass", 4, -12), ("ukulele", 4, 5))])
    p = table(spark, sf, "part").select("p_partkey", "p_size", F.explode(kinds).alias("v")).select("p_partkey", "v.instrument", "v.strings", (F.col("p_size") + F.col("v.shift")).cast("long").alias("pitch"))
    return p.where("pitch >= 0")
