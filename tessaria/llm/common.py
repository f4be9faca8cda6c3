"""Shared plumbing of the training-data operators.

Nothing here holds corpus data on the driver.  ``materialize`` cuts lineage
with a Parquet table in the folder that the cluster names in
``spark.checkpoint.dir``, so a lost executor never costs a recomputation of
the stages before it and a table that is read twice is computed once.
"""

from __future__ import annotations

import ctypes
import functools
import gc
import re
import tempfile
import uuid

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a one-id table (8 bytes a row) up to which it is broadcast.
BROADCAST_IDS = 1_000_000
#: Spark's own limit of a plan's text, which is none, and ours.
NO_LIMIT, PLAN_TEXT = (1 << 31) - 16, 1 << 17
#: Masters whose tasks all run in the driver's process.
LOCAL = re.compile(r"local(\[|$)")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a temporary one only where that is unset and all tasks run in this process (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not path:
        if not LOCAL.match(spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir is not set: a folder is needed that the driver and all executors share")
        path = getattr(scratch_dir, "own", None) or tempfile.mkdtemp(prefix="tessaria-")
        scratch_dir.own = path
    return path.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append(path)
    heap = spark.sparkContext._jvm.Runtime.getRuntime()
    if 2 * heap.totalMemory() > heap.maxMemory():
        release_driver(spark)
    else:
        trim_driver(spark)
    return spark.read.schema(df.schema).parquet(path)


_written: list[str] = []


def clear(spark: SparkSession) -> None:
    """Delete the tables that this process wrote to the scratch folder; results that still read them must be done."""
    while _written:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let the JVMs of the driver and of the executors give back what finished queries have left: heap, buffers, generated classes and shuffle files.

    An executor's heap only grows while it is not idle, so after a few stages it is at its limit, whatever the next
    one needs, and the stage's Python workers come on top.  A task on each of the executors' cores asks for the
    collection; where all tasks run in the driver's process (local masters) its own is enough.

    It also limits the text of plans that the driver keeps for its UI, unless it is limited: long plans and literals
    would be held again with every stage that ends.
    """
    name = "spark.sql.maxPlanStringLength"
    if int("".join(c for c in spark.conf.get(name, str(NO_LIMIT)) if c.isdigit())) >= NO_LIMIT:
        spark.conf.set(name, str(PLAN_TEXT))
    release_driver(spark)
    if not LOCAL.match(spark.sparkContext.master):
        n = spark.sparkContext.defaultParallelism
        spark.range(0, n, 1, n).select(F.reflect(F.lit("java.lang.System"), F.lit("gc"))).collect()


def release_driver(spark: SparkSession) -> None:
    """The driver's part of ``release``: its heap, and what its JVM has freed outside of it."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    trim_driver(spark)


def trim_driver(spark: SparkSession) -> None:
    """Let the driver's JVM give freed native memory back to the system.

    Compiling plans and their generated classes frees hundreds of MB in the C heaps of the JVM's threads, which glibc
    keeps.  HotSpot has a command for it (since 17.0.9); elsewhere nothing happens.
    """
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    kind = jvm.Class.forName

    def array(of, *values):
        out = gateway.new_array(of, len(values))
        for i, x in enumerate(values):
            out[i] = x
        return out

    try:  # by reflection: the server's own class is not public
        types = array(jvm.Class, *map(kind, ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")))
        bean = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        kind("javax.management.MBeanServer").getMethod("invoke", types).invoke(server, array(jvm.Object, bean, "systemTrimNativeHeap", None, None))
    except Py4JError:
        pass


def lean(function):
    """A function for mapInArrow whose worker gives freed memory back to the system, before its batches and after them.

    Workers live on between stages, and glibc keeps what numpy frees on the heap (blocks of up to 32 MB, once it has seen
    such ones); large blocks are made mappings of their own instead, and the heap is trimmed.  Elsewhere nothing happens.
    """

    @functools.wraps(function)
    def run(batches):
        trim()
        yield from function(batches)
        trim()

    return run


def trim() -> None:
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD
        libc.malloc_trim(0)
    pa.default_memory_pool().release_unused()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_or_plain(df: DataFrame, rows: int, bound: int = BROADCAST_IDS) -> DataFrame:
    """Broadcast hint only for a counted side under ``bound`` rows; beyond it Spark shuffles."""
    return F.broadcast(df) if rows <= bound else df


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)``: one row per vertex ``(v, component)``, the smallest id reachable.

    Every vertex points to its smallest neighbour, pointers are followed to
    their roots, and the edges between different roots are a smaller graph for
    the next level: each level at least halves the vertices.  All steps are
    shuffles on vertex ids and their tables are written out, so nothing is
    collected.  An empty edge table gives an empty result; self-loops are allowed.
    """
    pairs = materialize(_pairs(edges.where("a is not null and b is not null")), "cc-edges")
    out = None
    while True:
        both = pairs.union(pairs.select("b", "a"))
        parent = materialize(both.groupBy(F.col("a").alias("v")).agg(F.least(F.col("v"), F.min("b")).alias("p")), "cc-parent")
        moved = True
        while moved:
            up = parent.select(F.col("v").alias("p"), F.col("p").alias("q"))
            step = materialize(parent.join(up, "p").select("v", F.col("q").alias("p"), (F.col("q") != F.col("p")).alias("moved")), "cc-parent")
            moved = step.where("moved").limit(1).count() > 0
            parent = step.select("v", "p")
        if out is None:
            out = parent.withColumnRenamed("p", "component")
        else:
            root = parent.select(F.col("v").alias("component"), "p")
            out = out.join(root, "component", "left").select("v", F.coalesce("p", "component").alias("component"))
        ends = [parent.select(F.col("v").alias(c), F.col("p").alias(f"p{c}")) for c in ("a", "b")]
        rest = pairs.where("a <> b").join(ends[0], "a").join(ends[1], "b").select(F.col("pa").alias("a"), F.col("pb").alias("b")).where("a <> b")
        pairs = materialize(_pairs(rest), "cc-edges")
        if pairs.limit(1).count() == 0:
            return materialize(out, "cc-labels")


def _pairs(edges: DataFrame) -> DataFrame:
    return edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def top_threshold(counts: DataFrame, column: str, most: int) -> int:
    """The smallest count t so that at most ``most`` rows have ``column >= t``.

    Decided from the histogram of counts in whole powers and steps, whose size
    is bounded (at most 2,048 bins), so the set it selects has a proven bound.
    """
    c = F.col(column)
    bins = (
        counts.groupBy(F.when(c < 1024, c).otherwise(1024 + F.floor(F.log2(c.cast("double")) * 16)).cast("long").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"), F.min(c).alias("least"))
        .orderBy(F.desc("bin"))
        .collect()
    )
    total, t = 0, None
    for b in bins:
        if total + b["n"] > most:
            return t if t is not None else b["least"] + 10**15
        total += b["n"]
        t = b["least"]
    return t if t is not None else 1


def sha_hex(col: Column) -> Column:
    return F.sha2(col, 256)


LONG, STR, BIN, INT, DBL, BOOL = T.LongType(), T.StringType(), T.BinaryType(), T.IntegerType(), T.DoubleType(), T.BooleanType()


def schema(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])
