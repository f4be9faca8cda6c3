"""Distributed difference-cover order of all suffixes of a table of texts.

Sampled triples (places 1 and 2 of every three) are sorted by range and named
by Spark, the names are recursed on as shorter sequences, and the remaining
suffixes are merged in by the ranks of the sample.  Recursion ends when names
are unique or cover ``reach`` bytes, as longer prefixes need no order.

Each level moves a row of some 50 bytes for two of three places and again for
all of them at the merge, so the whole costs over a hundred times the text in
shuffles (measured figures in the README).  ``suffix_dedup`` therefore deals
suffixes out by content anchors and uses the same algorithm within tasks; this
is the form that was tried first, kept with its test.

Defined cases: null and empty texts have no suffix; equal suffixes, and those
equal over ``reach`` bytes or more, may share a rank; ids are integers, distinct.
"""

from __future__ import annotations

import functools

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LONG, materialize, schema

TRIPLE = ["c1", "c2", "c3"]


def suffix_order(docs: DataFrame, reach: int = 100) -> DataFrame:
    """(doc, i, rank): the rank of the suffix at byte i of each document among all, by its first ``reach`` bytes or more."""
    codes = F.transform(F.sequence(F.lit(1), F.octet_length("t")), lambda k: F.conv(F.hex(F.substr("t", k, F.lit(1))), 16, 10).cast("long") + 1)
    rows = docs.where("text is not null and text <> ''").select(F.col("doc_id").alias("doc"), F.col("text").cast("binary").alias("t"))
    return _order(materialize(rows.select("doc", codes.alias("s")), "dc-codes"), 1, reach)


def _numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Distinct rows of ``order`` numbered from 1 in their order: places within ranges behind the counts of the ranges before."""
    ranges = materialize(rows.select(*order).distinct().repartitionByRange(*order).sortWithinPartitions(*order).withColumn("p", F.spark_partition_id()), "dc-ranges")
    counts = ranges.groupBy("p").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a partition
    own = F.row_number().over(Window.partitionBy("p").orderBy(*order))
    return ranges.withColumn("o", own).join(F.broadcast(counts.select("p", before.alias("b"))), "p").select(*order, (F.col("o") + F.col("b")).alias(name))


def _order(seqs: DataFrame, span: int, reach: int) -> DataFrame:
    """Ranks of all places of the sequences ``(doc, s)``, whose symbols stand for ``span`` bytes each."""
    at = lambda i: F.coalesce(F.get("s", i), F.lit(0).cast("long"))
    place = F.explode(F.transform(F.sequence(F.lit(0), F.size("s") - 1), lambda i: F.struct(i.alias("i"), at(i).alias("c1"), at(i + 1).alias("c2"), at(i + 2).alias("c3"))))
    every = materialize(seqs.where(F.size("s") > 0).select("doc", F.size("s").alias("size"), place.alias("x")).select("doc", "size", "x.*"), "dc-places")
    sample = every.where("i % 3 > 0")
    names = materialize(sample.join(_numbered(sample, TRIPLE, "name"), TRIPLE).select("doc", "i", "size", "name"), "dc-names")
    n, distinct = names.agg(F.count(F.lit(1)), F.countDistinct("name")).first()
    if n == distinct or 3 * span >= reach:
        ranks = names.select("doc", "i", F.col("name").alias("r"))
    else:
        half = F.ceil((F.col("size") - 1) / 3).cast("int")  # places 1, 4, 7, ... come first, then a 0, then 2, 5, 8, ...
        where = F.when(F.col("i") % 3 == 1, F.floor(F.col("i") / 3)).otherwise(half + 1 + F.floor(F.col("i") / 3)).cast("int")
        placed = materialize(names.withColumn("j", where).withColumn("half", half), "dc-placed")
        ends = placed.select("doc", F.col("half").alias("j"), F.lit(0).cast("long").alias("name")).distinct()
        rows = placed.select("doc", "j", "name").unionByName(ends)
        shorter = rows.groupBy("doc").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "name"))), lambda x: x["name"]).alias("s"))
        deeper = _order(materialize(shorter, "dc-shorter"), 3 * span, reach).withColumnsRenamed({"i": "j", "rank": "r"})
        ranks = placed.join(deeper, ["doc", "j"]).select("doc", "i", "r")
    return _merged(every, materialize(ranks, "dc-ranks"))


def _merged(every: DataFrame, ranks: DataFrame) -> DataFrame:
    """All places in order: by range of their triple, then by the ranks of the sample."""
    rows = every.select("doc", "i", *TRIPLE)
    for k in range(3):
        rows = rows.join(ranks.select("doc", (F.col("i") - k).alias("i"), F.col("r").alias(f"r{k}")), ["doc", "i"], "left")
    names = ["doc", "i", *TRIPLE, "r0", "r1", "r2"]
    rows = rows.select(*names).repartitionByRange(*TRIPLE).sortWithinPartitions(*TRIPLE)

    def compare(x, y):
        """Two places of one triple: by the first distance at which both are in the sample; past a text's end is least."""
        a, b = x[1] % 3, y[1] % 3
        k = 3 + (1 if {a, b} == {0, 1} or a == b == 0 else 2 if 0 in (a, b) else 0)
        p, q = (-1 if v is None else v for v in (x[k], y[k]))
        return (p > q) - (p < q)

    def local(batches):
        triple, held, number, last = None, [], 0, None

        def close(out):
            nonlocal number, last
            for x in sorted(held, key=functools.cmp_to_key(lambda x, y: compare(x[1:], y[1:]))):
                if last is None or x[0] != last[0] or compare(x[1:], last[1:]):
                    number += 1
                out.append((x[1], x[2], number))
                last = x

        for b in batches:
            out = []
            cols = [c.to_pylist() for c in b.columns]
            for doc, i, c1, c2, c3, r0, r1, r2 in zip(*cols):
                if (c1, c2, c3) != triple:
                    close(out)
                    triple, held = (c1, c2, c3), []
                held.append((triple, doc, i, None, r0, r1, r2))
            yield _batch(out)
        out = []
        close(out)
        yield _batch(out)

    def _batch(out):
        cols = list(zip(*out)) or [[], [], []]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc", "i", "o"])

    local_ranks = rows.mapInArrow(local, schema(doc=LONG, i=LONG, o=LONG)).withColumn("p", F.spark_partition_id())
    local_ranks = materialize(local_ranks, "dc-merged")
    most = local_ranks.groupBy("p").agg(F.max("o").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = local_ranks.join(F.broadcast(most.select("p", before.alias("b"))), "p")
    return out.select("doc", F.col("i").cast(T.IntegerType()).alias("i"), (F.col("o") + F.col("b")).alias("rank"))
