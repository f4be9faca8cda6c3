"""Notation functions, relations and score evidence over the driver's tables, each with its SQL."""

from __future__ import annotations

import json

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import notation as N
from ..functions import scalars as S
from ..sources.tables import table
from . import assembly

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# --- scalar functions -----------------------------------------------------------


@query("""
WITH k AS (SELECT c_custkey, c_custkey % 17 - 8 AS fifths, c_custkey % 3 = 0 AS minor, c_nationkey - 12 AS shift FROM customer),
f AS (SELECT c_custkey, x.f, row_number() OVER (PARTITION BY c_custkey ORDER BY abs(x.f), abs(x.f - fifths), x.f) AS r FROM k, generate_series(-7, 7) AS x(f)
  WHERE ((7 * x.f) % 12 + 12) % 12 = ((7 * fifths + shift) % 12 + 12) % 12)
SELECT k.c_custkey, fifths::BIGINT AS fifths, minor, CASE WHEN shift % 12 <> 0 THEN f.f WHEN fifths < -7 THEN fifths + 12 WHEN fifths > 7 THEN fifths - 12 ELSE fifths END::BIGINT AS moved
FROM k JOIN f USING (c_custkey) WHERE r = 1""")
def key_transposition(spark, sf):
    """a key's name read back to fifths, and moved by semitones."""
    c = table(spark, sf, "customer").select("c_custkey", (F.col("c_custkey") % 17 - 8).cast("int").alias("f"), (F.col("c_custkey") % 3 == 0).alias("m"), (F.col("c_nationkey") - 12).alias("shift"))
    c = c.withColumn("p", N.key_parts(N.key_name(F.col("f"), F.col("m"))))
    moved = N.transpose_fifths(F.col("p.fifths"), F.col("shift")).cast("long")
    return c.select("c_custkey", F.col("p.fifths").cast("long").alias("fifths"), F.col("p.minor").alias("minor"), moved.alias("moved"))


@query("""
WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, 2 ** (l_partkey % 8) AS v, l_linenumber % 3 AS dots, 1 + l_suppkey % 3 AS e, 1 + l_partkey % 2 AS t FROM lineitem),
n AS (SELECT *, CASE v WHEN 1 THEN 'w' WHEN 2 THEN 'h' WHEN 4 THEN 'q' WHEN 8 THEN 'e' WHEN 16 THEN 's' WHEN 32 THEN 't' WHEN 64 THEN 'f' END AS a FROM t)
SELECT l_orderkey, l_linenumber, l_partkey, a || repeat('.', dots::INT) || CASE WHEN e = 1 AND t = 1 THEN '' ELSE '[' || e || ':' || t || ']' END AS token,
  CASE WHEN a IS NOT NULL THEN round(3840 / v * (2 - 1 / 2 ** dots) * t / e, 6) END AS ticks FROM n""")
def duration_tokens(spark, sf):
    """Tokens of note values and their ticks."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    token = N.duration_token(F.pow(F.lit(2), F.col("l_partkey") % 8).cast("int"), F.col("l_linenumber") % 3, (1 + F.col("l_suppkey") % 3).cast("int"), (1 + F.col("l_partkey") % 2).cast("int"))
    li = li.withColumn("token", token).withColumn("t", S.duration_ticks(F.col("token")))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "token", F.round(F.col("t.num") / F.col("t.den"), 6).alias("ticks"))


_DRUMS = "normal 0 35, normal 1 36, normal 5 38, diamond 5 38, x 5 37, normal 2 43, normal 3 45, normal 4 47, normal 6 48, normal 7 50, x 9 42, x -1 44, x 8 51, x 10 55, diamond 8 53".split(", ")


@query(f"""
WITH d(head, position, midi) AS (VALUES {", ".join("('%s', %s, %s)" % tuple(x.split()) for x in _DRUMS)}),
e AS (SELECT event_id, event_id % 12 - 1 AS position, CASE event_type WHEN 'click' THEN 'normal' WHEN 'view' THEN 'x' WHEN 'purchase' THEN 'diamond' END AS head FROM events)
SELECT event_id, midi::BIGINT AS midi FROM e LEFT JOIN d USING (head, position)""")
def drum_notes(spark, sf):
    """MIDI note of a head at a position of a drum staff."""
    e = table(spark, sf, "events").select("event_id", "event_type")
    head = F.when(F.col("event_type") == "click", "normal").when(F.col("event_type") == "view", "x").when(F.col("event_type") == "purchase", "diamond")
    return e.select("event_id", N.drum_pitch(F.col("event_id") % 12 - 1, head).cast("long").alias("midi"))


@query("""
WITH b AS (SELECT p_partkey, p_size * 7.25 AS x, p_retailprice / 10 AS y, p_size * 3.5 AS w, 40.0 AS h FROM part),
e AS (SELECT p_partkey, round_even(greatest(least(x - 10, 1e9), -1e9), 0) AS x0, round_even(x + w + 10, 0) AS x1, round_even(y - 20, 0) AS y0, round_even(y + h + 20, 0) AS y1 FROM b),
c AS (SELECT p_partkey, least(greatest(x0, 0), 400)::BIGINT AS x0, least(greatest(x1, 0), 400)::BIGINT AS x1, least(greatest(y0, 0), 180)::BIGINT AS y0, least(greatest(y1, 0), 180)::BIGINT AS y1 FROM e)
SELECT * FROM c WHERE x1 > x0 AND y1 > y0""")
def crop_boxes(spark, sf):
    """Boxes with margins, halves to even, clipped to the page; none outside it."""
    p = table(spark, sf, "part").select("p_partkey", (F.col("p_size") * 7.25).alias("x"), (F.col("p_retailprice") / 10).alias("y"), (F.col("p_size") * 3.5).alias("w"))
    p = p.withColumn("c", N.crop_bounds(F.lit(400), F.lit(180), F.col("x"), F.col("y"), F.col("w"), F.lit(40.0), 25.4, 10.0, 20.0))
    return p.where("c is not null").select("p_partkey", *[F.col(f"c.{k}").cast("long").alias(k) for k in ("x0", "x1", "y0", "y1")])


@query("""
WITH l AS (SELECT vec_id, [x::DOUBLE * 8 for x in embedding[1:5]] AS z FROM embeddings), e AS (SELECT vec_id, z, [exp(x - list_max(z)) for x in z] AS e FROM l),
p AS (SELECT vec_id, list_position(z, list_max(z)) - 1 AS best, list_max(e) / list_sum(e) AS top FROM e)
SELECT vec_id, best::BIGINT AS best, round(top, 6) AS confidence, CASE WHEN round(top, 6) >= 0.5 THEN 'observed' ELSE 'unknown' END AS status FROM p""")
def calibrated_classes(spark, sf):
    """Class probabilities by temperature, the first of the best, unknown below a threshold."""
    e = table(spark, sf, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 5), lambda x: x.cast("double")).alias("z"))
    p = N.softmax(F.col("z"), 0.125)
    e = e.select("vec_id", N.first_argmax(F.col("z")).cast("long").alias("best"), F.round(F.array_max(p), 6).alias("confidence"))
    return e.withColumn("status", F.when(F.col("confidence") >= 0.5, "observed").otherwise("unknown"))


@query("""
WITH s AS (SELECT c_custkey, c_custkey % 30 AS n, CASE c_custkey % 6 WHEN 0 THEN 'Capo ' || (c_custkey % 30) WHEN 1 THEN '8va ' WHEN 2 THEN '15 mb.' WHEN 3 THEN 'Transpose -' || (c_custkey % 30) || ' semitones'
  WHEN 4 THEN 'Horn in F' ELSE '2nd Violin' END AS text FROM customer)
SELECT c_custkey, CASE WHEN c_custkey % 6 = 0 AND n <= 24 THEN n END::BIGINT AS capo, CASE c_custkey % 6 WHEN 1 THEN 12 WHEN 2 THEN -24 END::BIGINT AS octave,
  CASE c_custkey % 6 WHEN 3 THEN -n WHEN 4 THEN -7 END::BIGINT AS shift, CASE c_custkey % 6 WHEN 5 THEN 40 WHEN 4 THEN 60 END::BIGINT AS program FROM s""")
def printed_marks(spark, sf):
    """Capo, octave, transposition and instrument of printed texts."""
    k = F.col("c_custkey")
    n = (k % 30).cast("string")
    text = (
        F.when(k % 6 == 0, F.concat(F.lit("Capo "), n)).when(k % 6 == 1, "8va ").when(k % 6 == 2, "15 mb.")
        .when(k % 6 == 3, F.concat(F.lit("Transpose -"), n, F.lit(" semitones"))).when(k % 6 == 4, "Horn in F").otherwise("2nd Violin")
    )
    c = table(spark, sf, "customer").select("c_custkey", text.alias("t"))
    t = F.col("t")
    of = (("capo", N.capo_fret), ("octave", N.octave_mark), ("shift", N.stated_transposition), ("program", N.program_of))
    return c.select("c_custkey", *[f(t).cast("long").alias(name) for name, f in of])


@query("""
WITH t AS (SELECT p_partkey, p_size % 4 AS k, CASE WHEN p_partkey % 2 = 0 THEN 'guitar' ELSE 'bass' END AS i FROM part),
b AS (SELECT *, CASE i WHEN 'guitar' THEN [64, 59, 55, 50, 45, 40] ELSE [43, 38, 33, 28] END AS base, CASE k WHEN 0 THEN 0 WHEN 1 THEN -1 WHEN 2 THEN -2 END AS shift FROM t)
SELECT p_partkey, CASE WHEN k < 3 THEN array_to_string([x + shift for x in base], ',') ELSE CASE i WHEN 'guitar' THEN '64,59,55,50,45,38' ELSE '43,38,33,26' END END AS tuning FROM b""")
def named_tunings(spark, sf):
    """Open strings of named tunings."""
    p = table(spark, sf, "part").select("p_partkey", (F.col("p_size") % 4).alias("k"))
    name = F.when(F.col("k") == 0, "Standard").when(F.col("k") == 1, "Half-step down").when(F.col("k") == 2, "D Standard").otherwise("Drop D tuning")
    tuning = N.tuning_of(name, F.when(F.col("p_partkey") % 2 == 0, "guitar").otherwise("bass"), F.lit(None).cast("int"))
    return p.select("p_partkey", F.array_join(tuning.cast("array<string>"), ",").alias("tuning"))


@query("""
WITH f AS (SELECT l_orderkey, list(l_quantity::BIGINT ORDER BY l_linenumber, l_partkey, l_quantity) AS v FROM lineitem GROUP BY 1)
SELECT array_to_string([x - list_min(v) for x in v], ',') AS shape, count(*) AS n FROM f GROUP BY 1""")
def shape_family(spark, sf):
    """A key that moving all values alike does not change."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("long").alias("q"))
    v = li.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "q"))), lambda x: x["q"]).alias("v"))
    shape = F.array_join(F.transform("v", lambda x: (x - F.array_min("v")).cast("string")), ",")
    return v.groupBy(shape.alias("shape")).agg(F.count(F.lit(1)).alias("n"))


# --- relations and voices ---------------------------------------------------------

_HITS = "e AS (SELECT event_id, user_id, event_type, ts::DATE AS day FROM events)"


@query(f"""
WITH {_HITS}, o AS (SELECT DISTINCT user_id, day + 1 AS day, event_type AS a FROM e), i AS (SELECT DISTINCT user_id, day, event_type AS b FROM e),
p AS (SELECT user_id, day, a, b, count(*) OVER (PARTITION BY user_id, day, a) AS na, count(*) OVER (PARTITION BY user_id, day, b) AS nb FROM o JOIN i USING (user_id, day))
SELECT user_id, day, a, b FROM p WHERE na = 1 AND nb = 1""")
def voice_links(spark, sf):
    """Voices of neighbouring bars that are each other's only partner.

    Uniqueness on both sides of an equi-join means one voice on either side, so it is two aggregates and a join one to one.
    """
    e = table(spark, sf, "events").select("user_id", "event_type", F.to_date("ts").alias("day"))

    def sole(name):
        return e.groupBy("user_id", "day").agg(F.min("event_type").alias(name), F.max("event_type").alias("__x")).where(F.col(name) == F.col("__x")).drop("__x")

    return sole("a").withColumn("day", F.date_add("day", 1)).join(sole("b"), ["user_id", "day"])


@query("""
WITH t AS (SELECT l_orderkey AS ev, l_linenumber AS n, l_suppkey % 5 AS pitch FROM lineitem WHERE l_returnflag = 'A'), s AS (SELECT l_orderkey AS ev, l_linenumber AS n, l_suppkey % 5 AS pitch FROM lineitem WHERE l_returnflag = 'R'),
ts AS (SELECT ev, pitch, count(*) AS c, min(n) AS n FROM t GROUP BY 1, 2), ss AS (SELECT ev, pitch, count(*) AS c, min(n) AS n FROM s GROUP BY 1, 2),
eq AS (SELECT ts.ev, ts.n AS tab, ss.n AS staff, ts.pitch FROM ts JOIN ss USING (ev, pitch) WHERE ts.c = 1 AND ss.c = 1),
tr AS (SELECT ev, count(*) AS c, min(n) AS n FROM t WHERE NOT EXISTS (SELECT 1 FROM eq WHERE eq.ev = t.ev AND eq.pitch = t.pitch) GROUP BY 1),
sr AS (SELECT ev, count(*) AS c, min(n) AS n FROM s WHERE NOT EXISTS (SELECT 1 FROM eq WHERE eq.ev = s.ev AND eq.pitch = s.pitch) GROUP BY 1)
SELECT ev, tab, staff, 'pitch' AS how FROM eq UNION ALL SELECT tr.ev, tr.n, sr.n, 'rest' FROM tr JOIN sr USING (ev) WHERE tr.c = 1 AND sr.c = 1""")
def dual_note_pairs(spark, sf):
    """Notes of two representations paired by pitch, then the only ones left."""
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("ev"), F.col("l_linenumber").alias("n"), (F.col("l_suppkey") % 5).alias("pitch"), "l_returnflag")
    both = li.where("l_returnflag in ('A', 'R')").withColumn("tab", F.col("l_returnflag") == "A")
    by = both.groupBy("ev", "pitch").agg(
        F.count_if("tab").alias("ct"), F.count_if(~F.col("tab")).alias("cs"), F.min(F.when(F.col("tab"), F.col("n"))).alias("t"), F.min(F.when(~F.col("tab"), F.col("n"))).alias("s")
    )
    one = (F.col("ct") == 1) & (F.col("cs") == 1)
    rest = by.where(~one).groupBy("ev").agg(F.sum("ct").alias("ct"), F.sum("cs").alias("cs"), F.min("t").alias("t"), F.min("s").alias("s"))
    pairs = [by.where(one).withColumn("how", F.lit("pitch")), rest.where(one).withColumn("how", F.lit("rest"))]
    return pairs[0].select("ev", "t", "s", "how").unionByName(pairs[1].select("ev", "t", "s", "how")).withColumnsRenamed({"t": "tab", "s": "staff"})


@query("""
WITH k AS (SELECT event_id, json_extract_string(props, '$.page') AS page, value, event_type FROM events),
m AS (SELECT event_type, page, count(DISTINCT round(value)) AS n, min(round(value)) AS q FROM k WHERE value > 150 GROUP BY 1, 2)
SELECT k.event_id, CASE WHEN m.n = 1 THEN m.q::BIGINT END AS tempo, m.n > 1 AS several FROM k LEFT JOIN m ON m.event_type = k.event_type AND m.page IS NOT DISTINCT FROM k.page""")
def confirmed_tempos(spark, sf):
    """A regional value is kept only where it is the only one."""
    e = table(spark, sf, "events").select("event_id", "event_type", "value", F.get_json_object("props", "$.page").alias("page"))
    m = e.where("value > 150").groupBy("event_type", "page").agg(F.countDistinct(F.round("value")).alias("n"), F.min(F.round("value")).cast("long").alias("q"))
    m = m.withColumnsRenamed({"event_type": "k", "page": "p"})
    out = e.join(m, (F.col("k") == F.col("event_type")) & F.col("p").eqNullSafe(F.col("page")), "left")
    return out.select("event_id", F.when(F.col("n") == 1, F.col("q")).alias("tempo"), (F.col("n") > 1).alias("several"))


@query("""
WITH l AS (SELECT event_id, user_id, event_type, round(value * 10)::BIGINT AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS bar FROM events),
s AS (SELECT *, sum(CASE WHEN event_type <> 'view' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY bar ROWS UNBOUNDED PRECEDING) AS run FROM l),
f AS (SELECT *, first_value(CASE WHEN event_type NOT IN ('view', 'error') THEN v END) OVER (PARTITION BY user_id, run ORDER BY bar) AS fret FROM s)
SELECT event_id, CASE WHEN run > 0 THEN fret END AS fret FROM f""")
def assembled_ties(spark, sf):
    """Hidden values that ties give along a lane; a lane is a user, a bar an event, a view a tied hidden note, an error an unreadable one."""
    got = assembly.assemble(tied_lanes(spark, sf))
    fret = F.get(F.from_json("resolved", "array<struct<events:array<struct<notes:array<struct<fret:long>>>>>>"), F.lit(0))["events"][0]["notes"][0]["fret"]
    return got.select(F.col("ord").alias("event_id"), fret.alias("fret"))


@query("""
WITH l AS (SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS bar FROM events),
s AS (SELECT *, sum(CASE WHEN event_type <> 'view' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY bar ROWS UNBOUNDED PRECEDING) AS run FROM l),
f AS (SELECT *, run > 0 AND first_value(event_type) OVER (PARTITION BY user_id, run ORDER BY bar) <> 'error' AS known, lag(event_id) OVER (PARTITION BY user_id ORDER BY bar) AS prev FROM s)
SELECT prev AS from_id, event_id AS to_id, CASE WHEN known THEN 'resolved' ELSE 'unresolved' END AS status, CASE WHEN NOT known THEN 'tie_value_unresolved' END AS reason
FROM f WHERE event_type = 'view' AND prev IS NOT NULL""")
def assembled_relations(spark, sf):
    """The chains of the same lanes with their status and what keeps them unresolved."""
    got = assembly.relations(tied_lanes(spark, sf))
    ends = [F.from_json(c, "array<long>")[0].alias(n) for c, n in (("start", "from_id"), ("end", "to_id"))]
    return got.select(*ends, "status", "reason")


def tied_lanes(spark, sf):
    """Records for the assembly: one bar an event, its value as the fret; a view has no value but a tie from the bar before."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type", F.round(F.col("value") * 10).cast("long").alias("v"))
    e = e.withColumn("bar", F.row_number().over(w)).withColumn("next", F.lead("event_type").over(w))
    fret = F.when(F.col("event_type").isin("view", "error"), F.lit("null")).otherwise(F.col("v").cast("string"))
    tie = F.lit(json.dumps({"kind": "tie", "start": "left", "end": [0, 0, 0]})), F.lit(json.dumps({"kind": "tie", "start": [0, 0, 0], "end": "right"}))
    ties = F.concat_ws(",", F.when((F.col("event_type") == "view") & (F.col("bar") > 1), tie[0]), F.when(F.col("next") == "view", tie[1]))
    text = F.concat(
        F.lit('{"state":{},"voices":[{"voice":0,"events":[{"start":0,"duration":"w","status":"normal","notes":[{"string":1,"fret":'), fret, F.lit('}]}]}],"relations":['), ties, F.lit("]}")
    )
    return e.select(
        F.lit("s").alias("source_id"), F.lit("p").alias("part_id"), F.col("user_id").cast("string").alias("staff_id"), F.lit("tab").alias("mode"), F.col("bar").alias("bar_index"),
        F.lit(1).alias("page"), F.lit(0).alias("system_index"), text.alias("observation"), F.col("event_id").alias("ord"),
    )


# --- contexts and partial measures --------------------------------------------------


@query("""
WITH s AS (SELECT user_id, event_id, ts, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1 AS opening FROM events),
k AS (SELECT *, CASE WHEN event_type = 'signup' THEN round(value)::BIGINT WHEN opening AND event_type <> 'error' THEN 0 END AS key, event_type = 'error' AS unknown FROM s)
SELECT event_id, last_value(CASE WHEN unknown THEN {'k': NULL::BIGINT} WHEN key IS NOT NULL THEN {'k': key} END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING).k AS key FROM k""")
def opening_seed(spark, sf):
    """The first bar of a staff without a key is seeded with key 0, then keys are carried; an unreadable one blocks."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf, "events").select("user_id", "event_id", "ts", "event_type", "value").withColumn("opening", F.row_number().over(w) == 1)
    key = F.when(F.col("event_type") == "signup", F.round("value").cast("long")).when(F.col("opening") & (F.col("event_type") != "error"), F.lit(0).cast("long"))
    seen = F.when(F.col("event_type") == "error", F.struct(F.lit(None).cast("long").alias("k"))).when(key.isNotNull(), F.struct(key.alias("k")))
    return e.select("event_id", F.last(seen, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))["k"].alias("key"))


@query("""
WITH s AS (SELECT user_id, event_id, ts, event_type, round(value)::BIGINT AS v FROM events), w AS (SELECT event_id,
  last_value(CASE WHEN event_type = 'signup' THEN v END IGNORE NULLS) OVER w AS clef, last_value(CASE WHEN event_type = 'purchase' THEN v END IGNORE NULLS) OVER w AS transpose,
  last_value(CASE WHEN event_type = 'error' THEN v END IGNORE NULLS) OVER w AS capo, bool_or(event_type = 'purchase') OVER w AS explicit
  FROM s WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
SELECT event_id, clef, transpose, capo, explicit, CASE WHEN NOT explicit AND transpose IS NOT DISTINCT FROM clef THEN 0 ELSE transpose END + clef - capo AS shift FROM w""")
def pitch_context(spark, sf):
    """Clef, transposition and capo along the reading order, and the shift that they make once all are known."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    e = table(spark, sf, "events").select("user_id", "event_id", "ts", "event_type", F.round("value").cast("long").alias("v"))
    last = lambda kind: F.last(F.when(F.col("event_type") == kind, F.col("v")), ignorenulls=True).over(w)
    e = e.select("event_id", last("signup").alias("clef"), last("purchase").alias("transpose"), last("error").alias("capo"), F.bool_or(F.col("event_type") == "purchase").over(w).alias("explicit"))
    shift = N.dual_shift(F.col("transpose"), F.col("explicit"), F.col("clef"), F.col("capo"), F.array().cast("array<string>"))
    return e.withColumn("shift", shift)


@query("""
WITH o AS (SELECT l_orderkey, l_linenumber, l_partkey, epoch(l_shipdate)::BIGINT // 86400 % 40 AS start, CASE WHEN l_returnflag <> 'N' THEN 1 + l_quantity::BIGINT % 8 END AS len FROM lineitem),
n AS (SELECT *, lead(start) OVER (PARTITION BY l_orderkey ORDER BY start, l_linenumber, l_partkey) AS nxt FROM o),
x AS (SELECT *, CASE WHEN len IS NULL THEN least(coalesce(nxt, 40), 40) ELSE least(start + len, coalesce(nxt, 40), 40) END AS stop FROM n)
SELECT l_orderkey, sum(CASE WHEN stop > start THEN 1 ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN stop <= start THEN 1 ELSE 0 END)::BIGINT AS omitted,
  sum(CASE WHEN len IS NULL AND stop > start THEN 1 ELSE 0 END)::BIGINT AS estimated, (40 - sum(CASE WHEN stop > start THEN stop - start ELSE 0 END))::BIGINT AS rests FROM x GROUP BY 1""")
def partial_measures(spark, sf):
    """Unknown lengths end at the next onset or the bar; events without room are omitted and counted, the rest is rests."""
    w = Window.partitionBy("l_orderkey").orderBy("start", "l_linenumber", "l_partkey")
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_quantity", "l_returnflag")
    li = li.withColumn("start", F.floor(F.unix_timestamp("l_shipdate") / 86400) % 40).withColumn("len", F.when(F.col("l_returnflag") != "N", 1 + F.col("l_quantity").cast("long") % 8))
    li = li.withColumn("room", F.coalesce(F.lead("start").over(w), F.lit(40))).withColumn("stop", F.least(F.coalesce(F.col("start") + F.col("len"), F.lit(40)), "room", F.lit(40)))
    fits = F.col("stop") > F.col("start")
    return li.groupBy("l_orderkey").agg(
        F.count_if(fits).alias("kept"), F.count_if(~fits).alias("omitted"), F.count_if(fits & F.col("len").isNull()).alias("estimated"),
        (40 - F.sum(F.when(fits, F.col("stop") - F.col("start")).otherwise(0))).alias("rests"),
    )


@query("""
WITH n AS (SELECT l_suppkey AS lane, l_partkey AS note, l_orderkey, l_linenumber, epoch(l_shipdate)::BIGINT // 86400 AS a, epoch(l_shipdate)::BIGINT // 86400 + l_quantity::BIGINT AS b FROM lineitem),
c AS (SELECT *, greatest(a, 9000) AS x, least(b, 9400) AS y FROM n)
SELECT lane, count(*) AS n, sum(y - x)::BIGINT AS sounding, sum(CASE WHEN a < 9000 THEN 1 ELSE 0 END)::BIGINT AS held_over FROM c WHERE y > x GROUP BY 1""")
def sliced_notes(spark, sf):
    """Notes clipped to a window, those that sound across its start told."""
    li = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("lane"), F.floor(F.unix_timestamp("l_shipdate") / 86400).alias("a"), F.col("l_quantity").cast("long").alias("q"))
    li = li.withColumn("x", F.greatest("a", F.lit(9000))).withColumn("y", F.least(F.col("a") + F.col("q"), F.lit(9400))).where("y > x")
    return li.groupBy("lane").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("y") - F.col("x")).alias("sounding"), F.count_if(F.col("a") < 9000).alias("held_over"))


@query("""
WITH n AS (SELECT l_orderkey AS bar, l_linenumber AS onset, l_suppkey % 7 AS step, l_partkey % 3 - 1 AS alter FROM lineitem),
g AS (SELECT bar, onset, step, min(alter) AS lo, max(alter) AS hi FROM n GROUP BY 1, 2, 3),
p AS (SELECT *, lag(CASE WHEN lo = hi THEN lo ELSE 99 END) OVER (PARTITION BY bar, step ORDER BY onset) AS before FROM g)
SELECT bar, onset, step, lo <> hi AS conflict, lo <> hi OR lo <> coalesce(before, 0) AS shown FROM p""")
def accidental_display(spark, sf):
    """An accidental is shown where it differs from the bar's memory; two spellings at once are both shown and forget it."""
    n = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("bar"), F.col("l_linenumber").alias("onset"), (F.col("l_suppkey") % 7).alias("step"), (F.col("l_partkey") % 3 - 1).alias("alter"))
    g = n.groupBy("bar", "onset", "step").agg(F.min("alter").alias("lo"), F.max("alter").alias("hi"))
    same = F.col("lo") == F.col("hi")
    before = F.lag(F.when(same, F.col("lo")).otherwise(99)).over(Window.partitionBy("bar", "step").orderBy("onset"))
    return g.withColumn("b", F.coalesce(before, F.lit(0))).select("bar", "onset", "step", (~same).alias("conflict"), (~same | (F.col("lo") != F.col("b"))).alias("shown"))


@query("""
WITH n AS (SELECT user_id, event_id, ts, round(value)::BIGINT % 12 AS v, event_type FROM events), r AS (SELECT *, sum(CASE WHEN event_type <> 'view' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM n)
SELECT event_id, CASE WHEN run = 0 THEN NULL WHEN event_type = 'view' AND first_value(event_type) OVER w = 'error' THEN NULL ELSE first_value(v) OVER w END AS pitch FROM r WINDOW w AS (PARTITION BY user_id, run ORDER BY ts, event_id)""")
def pitch_after_tie(spark, sf):
    """Notes after a tie take its pitch until the next accidental; after an unreadable one they stay unknown."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf, "events").select("user_id", "event_id", "ts", "event_type", (F.round("value").cast("long") % 12).alias("v"))
    seen = F.when(F.col("event_type") != "view", F.struct("v", (F.col("event_type") == "error").alias("lost")))
    e = e.withColumn("l", F.last(seen, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return e.select("event_id", F.when(~(F.col("l.lost") & (F.col("event_type") == "view")), F.col("l.v")).alias("pitch"))
