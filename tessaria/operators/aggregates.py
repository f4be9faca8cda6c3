"""Aggregations: multiset overlap, votes, conflicts, fan-out metrics.  All of them aggregate map-side first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(a: Column, b: Column, empty=None) -> Column:
    """a / b, or ``empty`` where b is 0 (both conventions exist: NULL and 0)."""
    return F.when(b == 0, F.lit(empty)).otherwise(a / b)


def multiset_overlap(expected: DataFrame, predicted: DataFrame, groups: list[str], item: list[str]) -> DataFrame:
    """groups, expected, predicted, correct (sum of least counts), precision, recall, f1 (NULL where undefined)."""
    e = expected.select(*groups, *item, F.lit(1).alias("__e"), F.lit(0).alias("__p"))
    p = predicted.select(*groups, *item, F.lit(0).alias("__e"), F.lit(1).alias("__p"))
    per = e.unionAll(p).groupBy(*groups, *item).agg(F.sum("__e").alias("e"), F.sum("__p").alias("p"))
    out = per.groupBy(*groups).agg(F.sum("e").alias("expected"), F.sum("p").alias("predicted"), F.sum(F.least("e", "p")).alias("correct"))
    c = F.col("correct")
    return out.select(
        *groups,
        "expected",
        "predicted",
        "correct",
        ratio(c, F.col("predicted")).alias("precision"),
        ratio(c, F.col("expected")).alias("recall"),
        ratio(2 * c, F.col("predicted") + F.col("expected")).alias("f1"),
    )


def weighted_vote(df: DataFrame, keys: list[str], label: str, weight: Column) -> DataFrame:
    """The label of the largest non-negative weight (ties: the smaller label) and its share."""
    per = df.groupBy(*keys, label).agg(F.sum(F.greatest(weight, F.lit(0))).alias("__w"))
    # Labels of equal weight are one row, so that the smaller one wins.
    ranked = per.groupBy(*keys, "__w").agg(F.min(label).alias(label), F.sum("__w").alias("__s"))
    return (
        ranked.groupBy(*keys)
        .agg(F.max_by(label, "__w").alias(label), F.max("__w").alias("__top"), F.sum("__s").alias("__all"))
        .select(*keys, label, ratio(F.col("__top"), F.col("__all"), 0.0).alias("share"))
    )


def majority_first_seen(df: DataFrame, keys: list[str], label: str, order: Column) -> DataFrame:
    """The most frequent label; of equal ones that which was seen first."""
    per = df.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("__n"), F.min(order).alias("__o"))
    best = F.min(F.struct((-F.col("__n")).alias("n"), F.col("__o"), F.col(label))).alias("b")
    return per.groupBy(*keys).agg(best).select(*keys, F.col("b")[label].alias(label), (-F.col("b.n")).alias("votes"))


def conflict(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One distinct non-null value is the value; several are NULL and a sorted conflict list."""
    per = df.groupBy(*keys).agg(F.array_sort(F.collect_set(value)).alias("__v"))
    return per.select(
        *keys,
        F.when(F.size("__v") == 1, F.get("__v", F.lit(0))).alias("value"),
        F.when(F.size("__v") > 1, F.col("__v")).alias("conflict"),
    )


def fan_out(df: DataFrame, labels: dict[str, Column], measures: dict[str, Column]) -> DataFrame:
    """Count each row under every label it carries: (label, n, one correct count a measure).  Null labels are none."""
    all_labels = F.array(*[F.when(c.isNotNull(), F.concat(F.lit(f"{k}=" if k else ""), c.cast("string"))) for k, c in labels.items()])
    rows = df.withColumn("label", F.explode(F.filter(all_labels, lambda x: x.isNotNull())))
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c.cast("long")).alias(k) for k, c in measures.items()])


def renumber(df: DataFrame, key: str, order: str, name: str) -> DataFrame:
    """Dense numbers of a key by first appearance, from its distinct values only; each is numbered by a range of first appearances."""
    first = df.groupBy(key).agg(F.min(order).alias("__o"))
    firsts = first.select("__o").distinct()
    return df.join(first.join(ranked(firsts, "__o", name), "__o").drop("__o"), key)


def in_ranges(df: DataFrame, order: list[str], name: str, parts: int = 64) -> DataFrame:
    """Rows with the number of their range of ``order``, a function of the row alone.

    A range partitioning samples again in every plan that reads it, so only the first keys of its parts are taken, once
    (``parts`` rows); numbers are found from those bounds, whatever they are.
    """
    key = F.struct(*order)
    firsts = df.select(*order).repartitionByRange(parts, *order).groupBy(F.spark_partition_id().alias("__p")).agg(F.min(key).alias("__k")).select("__k")
    bounds = df.sparkSession.createDataFrame(firsts.collect(), firsts.schema).agg(F.sort_array(F.collect_list("__k")).alias("__bounds"))
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(parts.bit_length()))])  # binary search: how many bounds are not above the key
    at = F.aggregate(steps, F.lit(0), lambda n, step: F.when(F.get("__bounds", n + step - 1) <= key, n + step).otherwise(n))
    return df.crossJoin(F.broadcast(bounds)).withColumn(name, at).drop("__bounds")


def ranked(df: DataFrame, order: str, name: str) -> DataFrame:
    """Rows numbered from 0 by a column without repeats: places within ranges, behind the counts of the ranges before."""
    ranges = in_ranges(df, [order], "__p")
    counts = ranges.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a range
    place = F.row_number().over(Window.partitionBy("__p").orderBy(order)) - 1
    return ranges.join(F.broadcast(counts.select("__p", before.alias("__b"))), "__p").withColumn(name, (place + F.col("__b")).cast("int")).drop("__p", "__b")


def medians(df: DataFrame, group: str, value: str, name: str, bins: int = 4096) -> DataFrame:
    """The exact median of each group (null without values; NaN is not handled apart).

    Values are counted in ``bins`` equal ranges of the group's extent, with
    map-side aggregation; only the bins in which the middle falls are read
    again, as distinct values with their counts.
    """
    rows = df.where(F.col(value).isNotNull()).select(group, F.col(value).alias("__v"))
    extent = rows.groupBy(group).agg(F.min("__v").alias("__lo"), F.max("__v").alias("__hi"), F.count(F.lit(1)).alias("__all"))
    at = F.least(F.floor((F.col("__v") - F.col("__lo")) / F.greatest(F.col("__hi") - F.col("__lo"), F.lit(1e-300)) * bins), F.lit(bins - 1)).cast("int")
    binned = rows.join(extent, group).withColumn("__bin", at)
    w = Window.partitionBy(group).orderBy("__bin").rowsBetween(Window.unboundedPreceding, 0)
    counts = binned.groupBy(group, "__bin").agg(F.count(F.lit(1)).alias("__n"), F.first("__all").alias("__all")).withColumn("__upto", F.sum("__n").over(w))
    low, high = F.floor((F.col("__all") + 1) / 2), F.floor(F.col("__all") / 2) + 1  # the middle places, from 1
    middle = counts.where((F.col("__upto") >= low) & (F.col("__upto") - F.col("__n") < high)).select(group, "__bin", (F.col("__upto") - F.col("__n")).alias("__before"))
    inside = binned.join(middle, [group, "__bin"]).groupBy(group, "__v").agg(F.count(F.lit(1)).alias("__n"), F.min("__before").alias("__before"), F.first("__all").alias("__all"))
    first = F.min("__before").over(Window.partitionBy(group))
    v = Window.partitionBy(group).orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("__upto", first + F.sum("__n").over(v))
    reach = lambda place: F.min(F.when(F.col("__upto") >= place, F.col("__v")))
    return inside.groupBy(group).agg(((reach(low) + reach(high)) / 2).alias(name))


def envelope(df: DataFrame, keys: list[str], x0: str, y0: str, x1: str, y1: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.min(x0).alias(x0), F.min(y0).alias(y0), F.max(x1).alias(x1), F.max(y1).alias(y1))


def error_rate(df: DataFrame, expected: str, predicted: str, groups: list[str]) -> DataFrame:
    """Character error rate: summed edit distance over summed expected length."""
    d = F.levenshtein(F.coalesce(expected, F.lit("")), F.coalesce(predicted, F.lit("")))
    return df.groupBy(*groups).agg(F.sum(d).alias("edits"), F.sum(F.char_length(expected)).alias("chars"))
