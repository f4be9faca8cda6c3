"""Line dedup: overlapping three-line windows found again anywhere in the corpus.

Lines are hashed, each run of three consecutive lines of a document is a
window, and a window whose content occurs more than once keeps only its first
occurrence (smallest ``doc_id``, then position).  The lines of the later
occurrences go; overlapping ones are merged.  Built from DataFrame functions
only: windows are counted with map-side partial aggregation, so a passage held
by a third of the corpus reaches the shuffle as one row a task, and AQE splits
the join back.  The text is shuffled once, by ``doc_id``.

Defined cases: null text stays null (0 lines); texts of under three lines have
no window; windows without a non-space character are ignored; windows are
judged on the input; rows that share a ``doc_id`` are the same document and
get the same decisions; rows with null ``doc_id`` are left as they are; other
columns pass through.  Identity of a window is a 128-bit hash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read_table

WINDOW = 3


def windows(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """One row per window with content: __id, __pos, and its two hashes."""
    lines = docs.select(F.col("doc_id").alias("__id"), F.split("text", "\n", -1).alias("__l")).where("__id is not null and text is not null")
    last = F.size("__l") - size

    def window(i):
        part = [F.get("__l", i + j) for j in range(size)]
        return F.struct(
            i.alias("pos"),
            F.xxhash64(*part).alias("w1"),
            F.xxhash64(F.lit(size), *part).alias("w2"),
            F.concat(*part).rlike(r"\S").alias("some"),
        )

    return (
        lines.where(last >= 0)
        .select("__id", F.explode(F.transform(F.sequence(F.lit(0), last), window)).alias("w"))
        .where("w.some")
        .select("__id", F.col("w.pos").alias("__pos"), F.col("w.w1").alias("__w1"), F.col("w.w2").alias("__w2"))
    )


def covered(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """__id and the sorted starts of its windows that occur earlier."""
    win = windows(docs, size)
    repeated = (
        win.groupBy("__w1", "__w2")
        .agg(F.count(F.lit(1)).alias("__n"), F.min(F.struct("__id", "__pos")).alias("__first"))
        .where("__n > 1")
        .drop("__n")
    )
    return (
        win.join(repeated, ["__w1", "__w2"])
        .where(F.struct("__id", "__pos") > F.col("__first"))
        .groupBy("__id")
        .agg(F.sort_array(F.collect_set("__pos")).alias("__starts"))
    )


def line_dedup(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """``docs`` with ``text`` deduplicated, and ``n_lines`` and ``n_removed_lines`` added under those names (prefixed ``__``)."""
    found = covered(docs, size)
    whole = docs.withColumnRenamed("text", "__text")
    joined = whole.join(found, whole["doc_id"] == found["__id"], "left")
    lines, starts = F.split("__text", "\n", -1), F.col("__starts")
    n = F.size(lines)
    # The runs between covered windows: from the end of one to the start of the next.
    gaps = F.zip_with(
        F.concat(F.array(F.lit(0)), F.transform(starts, lambda s: s + size)),
        F.concat(starts, F.array(n)),
        lambda s, e: F.struct(s.alias("s"), F.greatest(F.lit(0), e - s).alias("n")),
    )
    kept = F.flatten(F.transform(gaps, lambda g: F.slice(lines, g["s"] + 1, g["n"])))
    removed = n - F.size(kept)
    text = F.when(starts.isNull(), F.col("__text")).otherwise(F.array_join(kept, "\n"))
    others = [whole[c] for c in docs.columns if c != "text"]
    return joined.select(
        *others,
        text.alias("text"),
        F.when(F.col("__text").isNull(), F.lit(0)).otherwise(n).cast("long").alias("__n_lines"),
        F.when(starts.isNull(), F.lit(0)).otherwise(removed).cast("long").alias("__n_removed"),
    )


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup(docs).select(
        "doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_removed").alias("n_removed_lines"), "text"
    )


SQL_OP1 = r"""
WITH d AS (SELECT doc_id, text, CASE WHEN text IS NULL THEN NULL ELSE string_split(text, chr(10)) END AS l FROM documents),
p AS (SELECT doc_id, l, unnest(range(0, len(l) - 2)) AS pos FROM d WHERE len(l) >= 3),
w AS (SELECT doc_id, pos, l[pos + 1] || chr(10) || l[pos + 2] || chr(10) || l[pos + 3] AS win FROM p),
k AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY win ORDER BY doc_id, pos) AS occ FROM w WHERE regexp_matches(win, '[^ \t\n\x0B\f\r]')),
c AS (SELECT DISTINCT doc_id, pos + j AS line FROM k, (SELECT unnest(range(0, 3)) AS j) WHERE occ > 1),
x AS (SELECT doc_id, unnest(l) AS txt, generate_subscripts(l, 1) - 1 AS line FROM d WHERE l IS NOT NULL),
t AS (SELECT x.doc_id, count(*) AS n_lines, count(c.line) AS n_removed_lines,
      coalesce(string_agg(CASE WHEN c.line IS NULL THEN x.txt END, chr(10) ORDER BY x.line), '') AS text
      FROM x LEFT JOIN c ON c.doc_id = x.doc_id AND c.line = x.line GROUP BY x.doc_id)
SELECT d.doc_id, coalesce(t.n_lines, 0) AS n_lines, coalesce(t.n_removed_lines, 0) AS n_removed_lines, t.text
FROM d LEFT JOIN t USING (doc_id)
"""
