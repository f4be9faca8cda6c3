"""Dataset engineering: splits, sampling, de-duplication, integrity checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .aggregates import in_ranges, ranked


def hash_bucket(col: Column, buckets: int = 10) -> Column:
    """The first 32 bits of a SHA-256, modulo ``buckets``."""
    return F.pmod(F.conv(F.substring(F.sha2(col.cast("string"), 256), 1, 8), 16, 10).cast("long"), F.lit(buckets)).cast("int")


def hash_split(df: DataFrame, key: str, name: str = "split", train: int = 8, dev: int = 1, buckets: int = 10) -> DataFrame:
    b = hash_bucket(F.col(key), buckets)
    return df.withColumn(name, F.when(b < train, "train").when(b < train + dev, "dev").otherwise("test"))


def content_id(col: Column, size: int = 16) -> Column:
    return F.substring(F.sha2(col, 256), 1, size)


def first_by_key(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key: an aggregate on the ordered struct, combined map-side, instead of a window."""
    others = [c for c in df.columns if c not in keys and c != order]
    return df.groupBy(*keys).agg(F.min(F.struct(order, *others)).alias("__f")).select(*keys, *[F.col("__f")[c].alias(c) for c in (order, *others)])


def dedupe_content(df: DataFrame, text: str, order: str) -> DataFrame:
    """One row per distinct text, the smallest ``order``; only digests are shuffled."""
    return df.groupBy(F.sha2(F.coalesce(text, F.lit("")), 256).alias("digest")).agg(F.min(order).alias(order), F.count(F.lit(1)).alias("copies"))


def bottom_k(df: DataFrame, groups: list[str], key: Column, k: int) -> DataFrame:
    """The k rows of each group with the smallest key (Spark limits each group map-side first)."""
    w = Window.partitionBy(*groups).orderBy("__k")
    return df.withColumn("__k", key).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("__k")


def _place(df: DataFrame, group: str, order: list, name: str, parts: int = 64) -> DataFrame:
    """Places from 1 within a group by ``order``, which has no ties: by ranges of (group, order), so that a large group is in many tasks.

    A range's places stand behind the group's rows in the ranges before it.
    """
    ranges = in_ranges(df, [group, *order], "__p", parts)
    counts = ranges.groupBy(group, "__p").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(group).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy("__p", group).orderBy(*order))
    counts = counts.select(F.col(group).alias("__g"), F.col("__p").alias("__q"), before.alias("__b"))
    joined = ranges.withColumn("__own", own).join(counts, F.col(group).eqNullSafe(F.col("__g")) & (F.col("__p") == F.col("__q")))
    return joined.withColumn(name, F.col("__own") + F.col("__b")).drop("__own", "__b", "__p", "__q", "__g")


def round_robin(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Rows interleaved over groups: ``turn`` is the place within the group; sort by (turn, group) to deal."""
    return _place(df, group, order, "turn")


def document_limit(df: DataFrame, mode: str, doc: str, size: str, limit: int) -> DataFrame:
    """Whole documents, alternating over modes, while the total before them is under ``limit``.

    Sizes are counts, 1 at least, so that a mode's first ``limit`` documents are all that can be within it: the rest goes before any total is made.
    """
    docs = df.groupBy(mode, doc).agg(F.sum(size).alias("n"))
    few = F.row_number().over(Window.partitionBy(mode).orderBy(doc))  # a group limit is applied map-side
    docs = docs.withColumn("turn", few).where(F.col("turn") <= limit)
    # Rows of one turn are few; their totals carry over at most ``limit`` turns.
    turns = docs.groupBy("turn").agg(F.sum("n").alias("t"))
    before = turns.withColumn("before", F.sum("t").over(Window.orderBy("turn").rowsBetween(Window.unboundedPreceding, -1))).drop("t")
    docs = docs.join(before, "turn")
    inner = F.sum("n").over(Window.partitionBy("turn").orderBy(mode).rowsBetween(Window.unboundedPreceding, -1))
    total = F.coalesce("before", F.lit(0)) + F.coalesce(inner, F.lit(0))
    return docs.withColumn("total", total).where(F.col("total") < limit).select(mode, doc, "n", "turn", "total")


def fraction_sample(df: DataFrame, group: str, key: Column, ident: str, fraction: float) -> DataFrame:
    """round(n * fraction) rows of each group by smallest key, then ident (ties at .5 go up)."""
    counts = df.groupBy(F.col(group).alias("__c")).agg(F.count(F.lit(1)).alias("__n"))
    ranked = _place(df.withColumn("__k", key), group, ["__k", ident], "__r").join(F.broadcast(counts), F.col(group).eqNullSafe(F.col("__c")))
    return ranked.where(F.col("__r") <= F.floor(F.col("__n") * fraction + 0.5)).drop("__r", "__n", "__k", "__c")


def stratified(tagged: DataFrame, source: str, tag: str, least: int = 3) -> DataFrame:
    """(source, split): about 80/10/10, and every tag of ``least`` sources or more has one in validation and, if others are left, one in test.

    Of each such tag the source with the smallest hash is held out, first for
    validation, then for test; the rest fills both to a tenth by hash.  Sources
    are given once a tag (source, tag).
    """

    def smallest(rows, kind):
        return rows.groupBy(tag).agg(F.min(F.struct(keyed(kind).alias("h"), source)).alias("m")).select(f"m.{source}").distinct()

    def keyed(kind):
        return F.sha2(F.concat(F.lit(f"{kind}:"), F.col(source).cast("string")), 256)

    sources = tagged.select(source).distinct()
    often = tagged.groupBy(tag).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= least).select(tag)
    rows = tagged.join(often, tag)
    validation = smallest(rows, "validation")
    test = smallest(rows.join(validation, source, "left_anti"), "test")
    rest = sources.join(validation.union(test), source, "left_anti")
    n, v, t = (x.count() for x in (sources, validation, test))
    tenth = int(n / 10 + 0.5)
    more_v, more_t = max(tenth - v, 0), max(tenth - t, 0)
    placed = ranked(rest.withColumn("__h", F.struct(keyed("rest"), source)), "__h", "__k")
    split = F.when(F.col("__k") < more_v, "validation").when(F.col("__k") < more_v + more_t, "test").otherwise("train")
    held = [x.withColumn("split", F.lit(k)) for x, k in ((validation, "validation"), (test, "test"))]
    return held[0].union(held[1]).union(placed.select(source, split.alias("split")))


def leaks(df: DataFrame, family: str, split: str) -> DataFrame:
    """Families in more than one split; empty when the split is sound."""
    per = df.groupBy(family).agg(F.array_sort(F.collect_set(split)).alias("splits"))
    return per.where(F.size("splits") > 1)


def incomplete(df: DataFrame, keys: list[str], index: str) -> DataFrame:
    """Keys whose indices are not exactly 0..n-1."""
    per = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(index).alias("least"), F.max(index).alias("most"), F.size(F.collect_set(index)).cast("long").alias("distinct"))
    return per.where((F.col("least") != 0) | (F.col("most") != F.col("n") - 1) | (F.col("distinct") != F.col("n")))


def symmetric_difference(expected: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of one side only, with the side."""
    a, b = expected.select(*keys).distinct(), found.select(*keys).distinct()
    return a.join(b, keys, "left_anti").withColumn("side", F.lit("missing")).unionByName(b.join(a, keys, "left_anti").withColumn("side", F.lit("extra")))
