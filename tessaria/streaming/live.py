"""Streaming forms: journal ingestion, windows, sessions and incremental carry-forward.

State is bounded by watermarks (windows, dedupe) or by one row a key
(carry-forward keeps the last evidence of each lane).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

CARRIED = "key string, ord long, status string, value long, carried_status string, carried_value long"


def deduplicated(events: DataFrame, key: str, at: str, late: str = "10 minutes") -> DataFrame:
    """Each key once within the watermark."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def tumbling(events: DataFrame, at: str, every: str, keys: list[str], late: str = "10 minutes") -> DataFrame:
    rows = events.withWatermark(at, late).groupBy(F.window(at, every).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return rows.select(F.col("w.start").alias("start"), *keys, "n")


def sessions(events: DataFrame, at: str, gap: str, keys: list[str], late: str = "10 minutes") -> DataFrame:
    rows = events.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return rows.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def _carry(key, tables: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    kind, value, last = state.get if state.exists else (None, None, None)
    whole = list(tables)  # a key's rows of one micro-batch
    for t in [pd.concat(whole, ignore_index=True)] if whole else []:
        out = []
        for r in t.sort_values("ord").itertuples():
            own = r.value if r.status == "observed" and not pd.isna(r.value) else None
            if last is not None and r.ord != last + 1:
                kind, value = None, None  # a gap ends the run
            last = r.ord
            if r.status in ("observed", "unknown"):
                kind, value = r.status, own
                told = r.status
            else:
                told = "inherited" if kind == "observed" else "absent"
            out.append((key[0], r.ord, r.status, own, told, value))
        frame = pd.DataFrame(out, columns=["key", "ord", "status", "value", "carried_status", "carried_value"])
        yield frame.astype({"value": "Int64", "carried_value": "Int64"})
    state.update((kind, value, last))


def carry_forward(rows: DataFrame) -> DataFrame:
    """Interrupted carry-forward over a stream of (key, ord, status, value).

    Rows of a key must arrive in order across micro-batches; within one they
    are sorted.  A missing ``ord`` ends a run, as in the batch operator.
    """
    return rows.groupBy("key").applyInPandasWithState(_carry, CARRIED, "kind string, value long, last long", "append", GroupStateTimeout.NoTimeout)


def last_wins(journal: DataFrame, key: str, order: str, into: str, checkpoint: str):
    """Keep in ``into`` (Parquet) the last row of each key of every micro-batch; :func:`newest` reads the last of all.

    A batch writes only its own rows, to a folder of its number, so a batch that
    is run again replaces what it wrote, and none costs more than its rows.
    """

    def write(batch: DataFrame, number: int) -> None:
        others = [c for c in batch.columns if c != key]
        rows = batch.groupBy(key).agg(F.max(F.struct(order, *[c for c in others if c != order])).alias("r"))
        rows.select(key, *[F.col("r")[c].alias(c) for c in others]).write.mode("overwrite").parquet(f"{into}/batch={number}")

    return journal.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()


def newest(spark: SparkSession, into: str, key: str, order: str) -> DataFrame:
    """The last row of each key by ``order``, then by batch."""
    rows = spark.read.parquet(into)
    others = [c for c in rows.columns if c not in (key, "batch")]
    last = rows.groupBy(key).agg(F.max_by(F.struct(*others), F.struct(order, "batch")).alias("r"))
    return last.select(key, "r.*")


def compact(spark: SparkSession, into: str, out: str, key: str, order: str) -> None:
    """Write the last row of each key as the first batch of a new folder; readers move when it is done."""
    newest(spark, into, key, order).write.mode("overwrite").parquet(f"{out}/batch=-1")


def relanes(records: DataFrame, changed: DataFrame, lane: list[str]) -> DataFrame:
    """The records of the lanes that hold a changed record: all that one change can alter, to be assembled again."""
    return records.join(changed.select(*lane).distinct(), lane, "left_semi")
