"""Join patterns: mutual uniqueness, ordinal zips, nearest, intervals, containment.

Theta conditions always sit behind an equi-key (a page, a lane, a bucket), so
Catalyst plans hash or sort-merge joins; range joins are bucketed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mutual_unique(left: DataFrame, right: DataFrame, on: list[str], left_id: str, right_id: str) -> DataFrame:
    """Pairs that match on ``on`` and are each other's only match; ambiguity leaves both sides unmatched.

    An equi-join is unique on both sides just where both sides have one row of
    the key, so counts are taken before the join and no pair is ever dropped.
    """
    a = left.groupBy(*on).agg(F.count(F.lit(1)).alias("__l"), F.min(left_id).alias(left_id)).where("__l = 1").drop("__l")
    b = right.groupBy(*on).agg(F.count(F.lit(1)).alias("__r"), F.min(right_id).alias(right_id)).where("__r = 1").drop("__r")
    return a.join(b, on)


def ordinal_zip(left: DataFrame, right: DataFrame, keys: list[str], left_order: list[str], right_order: list[str], least: int = 2) -> DataFrame:
    """Pair the rows of a key by rank where both sides have equally many, at least ``least``."""

    def ranked(df, order, tag):
        w = Window.partitionBy(*keys)
        return df.withColumn("__rank", F.row_number().over(w.orderBy(*order))).withColumn(f"__{tag}", F.count(F.lit(1)).over(w))

    a, b = ranked(left, left_order, "n"), ranked(right, right_order, "m")
    return a.join(b, [*keys, "__rank"]).where((F.col("__n") == F.col("__m")) & (F.col("__n") >= least)).drop("__n", "__m")


def nearest(left: DataFrame, right: DataFrame, on: list[str], left_id: str, distance: list[Column]) -> DataFrame:
    """The right row at the lexicographically least ``distance`` within the key, by one aggregate and no sort."""
    pairs = left.join(right, on)
    others = [c for c in right.columns if c not in on]
    best = F.min(F.struct(*[d.alias(f"__d{i}") for i, d in enumerate(distance)], *others)).alias("__best")
    kept = [c for c in left.columns if c != left_id]
    out = pairs.groupBy(left_id).agg(*[F.first(c).alias(c) for c in kept], best)
    return out.select(left_id, *kept, *[F.col("__best")[c].alias(c) for c in others])


def nearest_value(left: DataFrame, right: DataFrame, on: list[str], left_id: str, left_value: str, right_id: str, right_value: str) -> DataFrame:
    """For each left row the right row of the key with the nearest number, ties to the smaller id: left_id, left_value, right_id, right_value.

    Both sides are sorted together once a key; the nearest is the last at or
    below or the first at or above, so no pairs are made.
    """
    none = F.lit(None)
    a = left.select(*on, F.col(left_value).alias("__v"), F.lit(1).alias("__side"), F.col(left_id).alias("__l"), none.cast(right.schema[right_id].dataType).alias("__r"))
    per = right.groupBy(*on, F.col(right_value).alias("__v")).agg(F.min(right_id).alias("__r"))  # one row a value
    b = per.select(*on, "__v", F.lit(0).alias("__side"), none.cast(left.schema[left_id].dataType).alias("__l"), "__r")
    seen = F.when(F.col("__side") == 0, F.struct(F.col("__v").alias("v"), F.col("__r").alias("r")))
    w = Window.partitionBy(*on)
    below = F.last(seen, ignorenulls=True).over(w.orderBy("__v", "__side").rowsBetween(Window.unboundedPreceding, 0))
    above = F.last(seen, ignorenulls=True).over(w.orderBy(F.desc("__v"), "__side").rowsBetween(Window.unboundedPreceding, 0))
    rows = a.unionByName(b).withColumn("__a", below).withColumn("__b", above).where("__side = 1")
    choice = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col(f"{c}.v") - F.col("__v")).alias("d"), F.col(f"{c}.r").alias("r"), F.col(f"{c}.v").alias("v")))
    best = rows.withColumn("__n", F.least(choice("__a"), choice("__b"))).where("__n is not null")
    return best.select(*on, F.col("__l").alias(left_id), F.col("__v").alias(left_value), F.col("__n.r").alias(right_id), F.col("__n.v").alias(right_value))


def interval_overlap(left: DataFrame, right: DataFrame, on: list[str], l0: str, l1: str, r0: str, r1: str, bucket: float, margin: float = 0) -> DataFrame:
    """Pairs with overlapping half-open intervals, joined on buckets of doubling width.

    An interval's own level is the first whose buckets are as wide as it, so it
    lies in two of them at most; it also stands in its buckets of the levels
    above.  Two intervals meet at the higher of their levels, in their first
    common bucket: a long interval costs a row or two a level, not one a bucket.
    """

    def level(lo, hi):
        return F.greatest(F.ceil(F.log2(F.greatest(hi - lo, F.lit(1e-300)) / bucket)), F.lit(0)).cast("int")

    def sides(df, a, b, m):
        return F.col(a) - m, F.col(b) + m

    spans = [(left, *sides(left, l0, l1, margin), "l"), (right, *sides(right, r0, r1, 0), "r")]
    top = max((df.agg(F.max(level(lo, hi))).first()[0] or 0) for df, lo, hi, _ in spans)

    def buckets(df, lo, hi, tag):
        at = lambda x, k: F.floor(x / (F.pow(F.lit(2.0), k) * bucket)).cast("long")
        each = F.transform(F.sequence(level(lo, hi), F.lit(top)), lambda k: F.struct(k.alias("k"), at(lo, k).alias("first"), at(hi, k).alias("last")))
        rows = df.withColumn(f"__own_{tag}", level(lo, hi)).withColumn("__x", F.explode(each))
        rows = rows.withColumn("__level", F.col("__x.k")).withColumn(f"__first_{tag}", F.col("__x.first"))
        return rows.withColumn("__b", F.explode(F.sequence(F.col("__x.first"), F.col("__x.last")))).drop("__x")

    a, b = (buckets(*x) for x in spans)
    once = (F.col("__level") == F.greatest("__own_l", "__own_r")) & (F.col("__b") == F.greatest("__first_l", "__first_r"))
    meet = (F.col(l0) - margin < F.col(r1)) & (F.col(r0) < F.col(l1) + margin)
    return a.join(b, [*on, "__level", "__b"]).where(once & meet).drop("__level", "__b", "__own_l", "__own_r", "__first_l", "__first_r")


def point_in_interval(points: DataFrame, spans: DataFrame, on: list[str], at: str, start: str, end: str, bucket: float) -> DataFrame:
    """Every point with the spans ``start <= at < end`` that hold it (none: nulls), joined on buckets."""
    a = points.withColumn("__b", F.floor(F.col(at) / bucket))
    b = spans.withColumn("__b", F.explode(F.sequence(F.floor(F.col(start) / bucket), F.floor(F.col(end) / bucket))))
    cond = [a[k] == b[k] for k in [*on, "__b"]] + [a[at] >= b[start], a[at] < b[end]]
    drop = [b[k] for k in [*on, "__b"]]
    out = a.join(b, cond, "left")
    for c in drop:
        out = out.drop(c)
    return out.drop("__b")


def outer_diff(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys whose sorted value lists differ, with both lists (null: the key is missing there)."""

    def lists(df, name):
        return df.groupBy(*keys).agg(F.array_sort(F.collect_list(value)).alias(name))

    both = lists(left, "left_values").join(lists(right, "right_values"), keys, "full_outer")
    return both.where(~F.col("left_values").eqNullSafe(F.col("right_values")))


def sole_owner(df: DataFrame, keys: list[str], owner: str) -> DataFrame:
    """The owner of a key where it is the only one, else NULL and the list of choices."""
    per = df.groupBy(*keys).agg(F.array_sort(F.collect_set(owner)).alias("choices"))
    return per.select(
        *keys,
        F.when(F.size("choices") == 1, F.get("choices", F.lit(0))).alias("owner"),
        F.when(F.size("choices") > 1, F.col("choices")).alias("choices"),
    )
