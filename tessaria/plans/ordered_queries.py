"""Ordered operators over the driver's tables, each with the SQL that DuckDB runs as oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ordered as O
from ..sources.tables import table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def evidence(spark, sf):
    """Events as evidence: signup and purchase are observed values, error is unknown, all else absent."""
    e = table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value")
    status = F.when(F.col("event_type").isin("signup", "purchase"), "observed").when(F.col("event_type") == "error", "unknown").otherwise("absent")
    return e.withColumn("status", status).withColumn("cents", F.round(F.col("value") * 100).cast("long")).withColumn("sec", F.unix_timestamp("ts"))


_EVIDENCE = """
WITH e AS (SELECT event_id, ts, user_id, event_type, value, epoch(date_trunc('second', ts))::BIGINT AS sec,
  CASE WHEN event_type IN ('signup','purchase') THEN 'observed' WHEN event_type = 'error' THEN 'unknown' ELSE 'absent' END AS status,
  round(value * 100)::BIGINT AS cents FROM events)
"""


def runs(spark, sf):
    e = evidence(spark, sf)
    from pyspark.sql import Window

    before = F.lag("sec").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return O.islands(e, ["user_id"], ["ts", "event_id"], F.col("sec") - before > 86400)


_RUNS = (
    _EVIDENCE
    + """, g AS (SELECT *, sec - lag(sec) OVER (PARTITION BY user_id ORDER BY ts, event_id) > 86400 AS gap FROM e),
r AS (SELECT *, sum(CASE WHEN gap THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS island FROM g)
"""
)


@query(
    _RUNS
    + """, c AS (SELECT *, last_value(CASE WHEN status <> 'absent' THEN {'k': status, 'v': CASE WHEN status = 'observed' THEN cents END} END IGNORE NULLS)
  OVER (PARTITION BY user_id, island ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS l FROM r)
SELECT event_id, user_id, island, status, CASE WHEN status <> 'absent' THEN status WHEN l.k = 'observed' THEN 'inherited' ELSE 'absent' END AS carried_status,
  l.v AS carried_value FROM c"""
)
def carry_forward_state(spark, sf):
    """Interrupted carry-forward along runs."""
    out = O.carry_forward(runs(spark, sf), ["user_id", "island"], ["ts", "event_id"], "status", "cents")
    return out.select("event_id", "user_id", "island", "status", "carried_status", "carried_value")


@query(
    _RUNS
    + "SELECT user_id, island, count(*) AS n, min(event_id) AS first_event, max(sec) - min(sec) AS seconds FROM r GROUP BY user_id, island"
)
def session_runs(spark, sf):
    """Runs and their extent."""
    return (
        runs(spark, sf)
        .groupBy("user_id", "island")
        .agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"), (F.max("sec") - F.min("sec")).alias("seconds"))
    )


@query("""
WITH p AS (SELECT ts::DATE AS day, list_sort(list(DISTINCT event_type)) AS v FROM events WHERE event_type IN ('signup','error') GROUP BY 1),
s AS (SELECT unnest(generate_series((SELECT min(ts) FROM events)::DATE::TIMESTAMP, (SELECT max(ts) FROM events)::DATE::TIMESTAMP, INTERVAL 1 DAY))::DATE AS day),
j AS (SELECT s.day, v FROM s LEFT JOIN p USING (day)),
c AS (SELECT day, last_value(CASE WHEN len(v) > 0 THEN {'v': CASE WHEN len(v) = 1 THEN v[1] END} END IGNORE NULLS) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING) AS l,
  CASE WHEN len(v) > 1 THEN array_to_string(v, ',') END AS conflict FROM j)
SELECT day, l.v AS value, conflict FROM c""")
def timeline_conflict_carry(spark, sf):
    """Dense timeline, a conflict carries NULL on."""
    e = table(spark, sf, "events").select(F.to_date("ts").alias("day"), "event_type")
    spine = e.agg(F.min("day").alias("a"), F.max("day").alias("b")).select(F.explode(F.sequence("a", "b")).alias("day"))
    marks = e.where(F.col("event_type").isin("signup", "error"))
    return O.timeline(marks, "day", "event_type", "day", spine)


@query(
    _EVIDENCE
    + """, m AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM e)
SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN cents END IGNORE NULLS)
  OVER (PARTITION BY user_id, run ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS remembered FROM m"""
)
def accidental_memory(spark, sf):
    """The last value since a reset, before this row."""
    e = evidence(spark, sf)
    value = F.when(F.col("event_type") == "purchase", F.col("cents"))
    return O.memory(e, ["user_id"], ["ts", "event_id"], value, F.col("event_type") == "error", "remembered").select("event_id", "remembered")


@query("""
SELECT event_id, row_number() OVER w = 1 OR event_type IS DISTINCT FROM lag(event_type) OVER w AS shown FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def changed_signature(spark, sf):
    """Show a value only where it changes."""
    e = table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type")
    return O.changed(e, ["user_id"], ["ts", "event_id"], "event_type").select("event_id", "shown")


_SPANS = """
WITH s AS (SELECT l_orderkey, l_linenumber, epoch(l_shipdate)::BIGINT // 86400 AS a, epoch(l_shipdate)::BIGINT // 86400 + l_quantity::BIGINT AS b FROM lineitem)
"""


def spans(spark, sf):
    """Line items as spans: from the shipping day, as many days as the quantity."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_quantity")
    day = F.floor(F.unix_timestamp("l_shipdate") / 86400).cast("long")
    return li.select("l_orderkey", "l_linenumber", day.alias("a"), (day + F.col("l_quantity").cast("long")).alias("b"))


@query(
    _SPANS
    + """SELECT l_orderkey, l_linenumber, coalesce(a < max(b) OVER (PARTITION BY l_orderkey ORDER BY a, l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS overlap FROM s"""
)
def overlapping_spans(spark, sf):
    """A span that starts before an earlier one has ended."""
    return O.overlaps(spans(spark, sf), ["l_orderkey"], ["a", "l_linenumber"], "a", "b").select("l_orderkey", "l_linenumber", "overlap")


@query(
    _SPANS
    + """, u AS (SELECT l_orderkey, max(b) OVER w AS until, lead(a) OVER x AS nxt FROM s
  WINDOW w AS (PARTITION BY l_orderkey ORDER BY a, l_linenumber ROWS UNBOUNDED PRECEDING), x AS (PARTITION BY l_orderkey ORDER BY a, l_linenumber)),
g AS (SELECT l_orderkey, until AS gap_start, nxt - until AS gap FROM u WHERE nxt > until)
SELECT l_orderkey, gap_start, gap, gap // 32 AS n32, (gap % 32) // 16 AS n16, (gap % 16) // 8 AS n8, (gap % 8) // 4 AS n4, (gap % 4) // 2 AS n2, gap % 2 AS n1 FROM g"""
)
def gap_fill(spark, sf):
    """Gaps between spans, decomposed greedily into powers of two."""
    g = O.gaps(spans(spark, sf), ["l_orderkey"], ["a", "l_linenumber"], "a", "b")
    g = g.withColumn("gap", F.col("gap_end") - F.col("gap_start"))
    return g.select("l_orderkey", "gap_start", "gap", *O.piece_counts(F.col("gap"), [32, 16, 8, 4, 2, 1], "n"))


@query(
    _SPANS
    + """, n AS (SELECT *, max(b) OVER (PARTITION BY l_orderkey ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s),
i AS (SELECT *, sum(CASE WHEN before IS NULL OR a > before THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS i FROM n)
SELECT l_orderkey, min(a) AS a, max(b) AS b, count(*) AS merged FROM i GROUP BY l_orderkey, i"""
)
def interval_closure(spark, sf):
    """Merge intervals that touch."""
    return O.merged_intervals(spans(spark, sf), ["l_orderkey"], "a", "b")


@query("""
WITH p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'),
s AS (SELECT user_id, ts, max(event_id) AS sign_id FROM events WHERE event_type = 'signup' GROUP BY user_id, ts)
SELECT p.event_id, s.sign_id FROM p ASOF LEFT JOIN s ON p.user_id = s.user_id AND p.ts >= s.ts""")
def asof_position(spark, sf):
    """The last signup at or before each purchase."""
    e = table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type")
    signs = e.where("event_type = 'signup'").groupBy("user_id", "ts").agg(F.max("event_id").alias("sign_id"))
    bought = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return O.as_of(bought, signs, ["user_id"], "ts", "ts", ["sign_id"]).select("event_id", "sign_id")


@query("""
WITH d AS (SELECT l.quality, d.lang, d.n_chars FROM documents d JOIN labels l USING (doc_id)),
g AS (SELECT lang, n_chars, count(*) AS n, sum(quality)::BIGINT AS h FROM d GROUP BY 1, 2)
SELECT lang, n_chars, sum(n) OVER w::BIGINT AS n, sum(h) OVER w::BIGINT AS hits FROM g WINDOW w AS (PARTITION BY lang ORDER BY n_chars DESC ROWS UNBOUNDED PRECEDING)""")
def precision_prefix_threshold(spark, sf):
    """Precision of every prefix by falling confidence, ties together."""
    d = table(spark, sf, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id")
    return O.running_precision(d, ["lang"], "n_chars", F.col("quality") == 1)


@query(
    _EVIDENCE
    + "SELECT event_id, sum(CASE WHEN status = 'unknown' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS system FROM e"
)
def running_system_ids(spark, sf):
    """Cumulative ids from break flags."""
    return O.islands(evidence(spark, sf), ["user_id"], ["ts", "event_id"], F.col("status") == "unknown", "system").select("event_id", "system")


@query("""
SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, sum(round(value * 100)::BIGINT)::BIGINT AS cents FROM events GROUP BY 1, 2""")
def window_tumbling(spark, sf):
    """Batch form of the streaming tumbling window."""
    e = table(spark, sf, "events").select("ts", "event_type", "value")
    rows = e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))
    return rows.select(F.col("w.start").alias("hour"), "event_type", "n", "cents")


@query("""
WITH o AS (SELECT l_orderkey, o_orderdate::DATE AS a, min(l_shipdate)::DATE AS b FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2),
x AS (SELECT l_orderkey, unnest(generate_series(a::TIMESTAMP, b::TIMESTAMP, INTERVAL 1 DAY))::DATE AS day FROM o WHERE b >= a)
SELECT day, count(*) AS covering FROM x GROUP BY day""")
def range_cover(spark, sf):
    """Every day of each order's range, order date to first ship date, counted by a sweep over the ranges' ends."""
    o = table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("a"))
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_shipdate").groupBy("l_orderkey").agg(F.to_date(F.min("l_shipdate")).alias("b"))
    return O.covering(o.join(li, o.o_orderkey == li.l_orderkey), "a", "b", "day", "covering")
