"""Ordered operators: islands, interrupted carry-forward, memories, gap filling, as-of.

Every operator takes explicit keys and an order; everything partitions on the
keys alone, so a sequence is one shuffle however many windows run over it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _w(keys, order):
    return Window.partitionBy(*keys).orderBy(*order)


def islands(df: DataFrame, keys: list[str], order: list[str], breaks: Column, name: str = "island") -> DataFrame:
    """Number the runs of a sequence; a row where ``breaks`` holds (null: no) begins the next run."""
    return df.withColumn(name, F.sum(F.when(breaks, 1).otherwise(0)).over(_w(keys, order).rowsBetween(Window.unboundedPreceding, 0)))


def carry_forward(df: DataFrame, keys: list[str], order: list[str], status: str, value: str) -> DataFrame:
    """Inherit the last observed value along a run; ``unknown`` stops inheritance until the next observation.

    Adds ``carried_status`` (observed, unknown, inherited or absent) and
    ``carried_value``.  ``status`` is observed, unknown or absent (null: absent).
    """
    s = F.coalesce(F.col(status), F.lit("absent"))
    seen = F.when(s != "absent", F.struct(s.alias("k"), F.when(s == "observed", F.col(value)).alias("v")))
    last = F.last(seen, ignorenulls=True).over(_w(keys, order).rowsBetween(Window.unboundedPreceding, 0))
    df = df.withColumn("__last", last)
    status_out = F.when(s != "absent", s).when(F.col("__last.k") == "observed", "inherited").otherwise("absent")
    return df.withColumn("carried_status", status_out).withColumn("carried_value", F.col("__last.v")).drop("__last")


def timeline(df: DataFrame, key: str, value: str, order: str, spine: DataFrame) -> DataFrame:
    """Dense timeline: one distinct value per step is carried on, several carry NULL on and are told as conflicts."""
    per = df.groupBy(key).agg(F.array_sort(F.collect_set(value)).alias("values"))
    rows = spine.join(per, key, "left")
    size = F.coalesce(F.size("values"), F.lit(0))
    seen = F.when(size > 0, F.struct(F.when(size == 1, F.get("values", F.lit(0))).alias("v")))
    carried = F.last(seen, ignorenulls=True).over(Window.partitionBy(F.lit(0)).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.select(key, carried["v"].alias("value"), F.when(size > 1, F.concat_ws(",", "values")).alias("conflict"))


def memory(df: DataFrame, keys: list[str], order: list[str], value: Column, reset: Column, name: str) -> DataFrame:
    """Last non-null ``value`` before a row and since the last ``reset`` row (a reset row forgets first)."""
    run = F.sum(F.when(reset, 1).otherwise(0)).over(_w(keys, order).rowsBetween(Window.unboundedPreceding, 0))
    df = df.withColumn("__run", run)
    back = _w([*keys, "__run"], order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(back)).drop("__run")


def changed(df: DataFrame, keys: list[str], order: list[str], value: str, name: str = "shown") -> DataFrame:
    """True where a value differs from the row before it (the first row always is shown)."""
    w = _w(keys, order)
    return df.withColumn(name, (F.row_number().over(w) == 1) | ~F.col(value).eqNullSafe(F.lag(value).over(w)))


def overlaps(df: DataFrame, keys: list[str], order: list[str], start: str, end: str, name: str = "overlap") -> DataFrame:
    """True where a span starts before the latest end among the spans before it."""
    before = F.max(end).over(_w(keys, order).rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn(name, F.coalesce(F.col(start) < before, F.lit(False)))


def gaps(df: DataFrame, keys: list[str], order: list[str], start: str, end: str) -> DataFrame:
    """The uncovered spans between consecutive spans of a sequence: keys, gap_start, gap_end."""
    w = _w(keys, order)
    df = df.withColumn("__until", F.max(end).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__next", F.lead(start).over(w))
    return df.where(F.col("__next") > F.col("__until")).select(*keys, F.col("__until").alias("gap_start"), F.col("__next").alias("gap_end"))


def decompose(span: Column, pieces: list[int]) -> Column:
    """Greedy exact decomposition of a length into ``pieces`` (descending); NULL if a remainder is left."""
    start = F.struct(span.cast("long").alias("left"), F.array().cast("array<long>").alias("out"))

    def take(state, piece):
        n = F.floor(state["left"] / piece).cast("int")
        return F.struct((state["left"] - n * piece).alias("left"), F.concat(state["out"], F.array_repeat(piece, n)).alias("out"))

    sizes = F.array(*[F.lit(p).cast("long") for p in pieces])
    return F.aggregate(sizes, start, take, lambda s: F.when(s["left"] == 0, s["out"]))


def piece_counts(span: Column, pieces: list[int], prefix: str) -> list[Column]:
    """How often each of ``pieces`` (descending) is in the greedy decomposition of a length: divisions and remainders only."""
    out, left = [], span.cast("long")
    for p in pieces:
        out.append(F.floor(left / p).alias(f"{prefix}{p}"))
        left = left % p
    return out


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, since: str, values: list[str]) -> DataFrame:
    """For each left row the values of the last right row with ``since <= at``, by union and one window.

    No range join: both sides are sorted together once per key, right rows
    first at equal positions.
    """
    fields = [f for f in left.columns]
    a = left.select(*fields, F.col(at).alias("__t"), F.lit(1).alias("__side"), *[F.lit(None).cast(right.schema[v].dataType).alias(f"__v_{v}") for v in values])
    b = right.select(
        *[F.col(k) if k in keys else F.lit(None).cast(left.schema[k].dataType).alias(k) for k in fields],
        F.col(since).alias("__t"),
        F.lit(0).alias("__side"),
        *[F.col(v).alias(f"__v_{v}") for v in values],
    )
    w = Window.partitionBy(*keys).orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    seen = F.last(F.when(F.col("__side") == 0, F.struct(*[F.col(f"__v_{v}").alias(v) for v in values])), ignorenulls=True).over(w)
    return a.unionByName(b).withColumn("__s", seen).where("__side = 1").select(*fields, *[F.col("__s")[v].alias(v) for v in values])


def running_precision(df: DataFrame, groups: list[str], confidence: str, correct: Column) -> DataFrame:
    """Precision of every prefix by falling confidence, whole ties at a time: groups, confidence, n, hits."""
    per = df.groupBy(*groups, confidence).agg(F.count(F.lit(1)).alias("__n"), F.sum(correct.cast("long")).alias("__h"))
    w = Window.partitionBy(*groups).orderBy(F.desc(confidence)).rowsBetween(Window.unboundedPreceding, 0)
    return per.select(*groups, confidence, F.sum("__n").over(w).alias("n"), F.sum("__h").over(w).alias("hits"))


def merged_intervals(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Closure of touching or overlapping intervals: keys, start, end and the number merged."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    df = df.withColumn("__new", F.when(before.isNull() | (F.col(start) > before), 1).otherwise(0))
    df = df.withColumn("__i", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return df.groupBy(*keys, "__i").agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("merged")).drop("__i")


def covering(df: DataFrame, start: str, end: str, day: str, name: str) -> DataFrame:
    """Number of date ranges (both ends included) that cover each day: +1 at the start, -1 after the end, and a running sum.

    Ranges that end before they start, or lack an end, cover nothing.  The window holds one row a distinct end of a range.
    """
    step = F.struct(F.col(start).alias("at"), F.lit(1).alias("d")), F.struct(F.date_add(end, 1).alias("at"), F.lit(-1).alias("d"))
    steps = df.where(F.col(end) >= F.col(start)).select(F.explode(F.array(*step)).alias("s")).groupBy("s.at").agg(F.sum("s.d").alias("d"))
    w = Window.partitionBy(F.lit(0)).orderBy("at")
    runs = steps.select("at", F.lead("at").over(w).alias("next"), F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias(name))
    return runs.where(F.col(name) > 0).select(F.explode(F.sequence("at", F.date_sub("next", 1))).alias(day), name)
