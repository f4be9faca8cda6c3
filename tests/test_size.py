"""Queries whose results once changed with the size of a table or at a limit, against their SQL on made tables."""

import pytest
from pyspark.sql import functions as F

from tessaria.operators import folds
from tessaria.plans import catalog

duckdb = pytest.importorskip("duckdb")


def same(spark, folder, name: str, **tables) -> None:
    """The query on the tables equals its SQL."""
    c = duckdb.connect()
    for t, df in tables.items():
        df.write.parquet(f"{folder}/{t}.parquet")
        c.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet/*.parquet')")
    df = catalog.QUERIES[name](spark, str(folder))
    r = c.execute(catalog.ORACLE[name])
    at = [df.columns.index(d[0]) for d in r.description]
    assert sorted(tuple(x[i] for i in at) for x in df.collect()) == sorted(r.fetchall())


def test_fraction_sample_of_more_rows_than_are_sampled_for_ranges(spark, tmp_path):
    n = F.col("id")
    rows = spark.range(0, 60_000, numPartitions=1).select(n.alias("c_custkey"), F.format_string("Customer#%09d", n).alias("c_name"), F.concat(F.lit("S"), n % 3).alias("c_mktsegment"))
    same(spark, tmp_path, "fraction_sample", customer=rows)


def test_stratified_split_of_more_sources_than_are_sampled_for_ranges(spark, tmp_path):
    n = F.col("id")
    o = spark.range(0, 60_000, numPartitions=1)
    rows = o.select(
        n.alias("o_orderkey"), n.alias("o_custkey"), F.lit("O").alias("o_orderstatus"), F.concat(n % 5 + 1, F.lit("-X")).alias("o_orderpriority"), F.lit("1995-01-01").cast("timestamp_ntz").alias("o_orderdate")
    )
    same(spark, tmp_path, "stratified_split", orders=rows)


def test_chain_paths_round_seconds_as_the_sql_does(spark, tmp_path):
    """43,200.8 seconds apart by the clock, 43,201 or 43,200 by whole seconds."""
    at = lambda s: F.timestamp_seconds(F.lit(1_700_000_000) + s).cast("timestamp_ntz")
    rows = spark.createDataFrame([(1, 1, 0.1), (2, 1, 43200.9), (3, 2, 0.9), (4, 2, 43201.1), (5, 3, 0.5), (6, 3, 43201.5)], "event_id long, user_id long, s double")
    same(spark, tmp_path, "chain_paths", events=rows.select("event_id", "user_id", F.lit("view").alias("event_type"), at(F.col("s")).alias("ts")))


def test_uncovered_regions_at_the_very_share(spark):
    """A cover of exactly 0.3 of the area keeps both, though 0.3 * w * h is less than that in doubles for some of these sizes."""
    rows = [(w * 10 + k, str(w), x, y, w, 30) for w in range(20, 71, 2) for k, x, y in ((0, 0, 0), (1, w // 2, 12))]
    assert any(0.3 * w * 30 < w // 2 * 18 for w in range(20, 71, 2))
    df = spark.createDataFrame(rows, "id long, page string, x long, y long, w long, h long")
    assert folds.uncovered(df, ["page"], ["x", "y", "w", "h"], "id", "y", 0.3).count() == len(rows)
