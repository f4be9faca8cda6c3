"""Queries that once read less than the whole job, against SQL over all of it."""

from pathlib import Path

import pytest

from tessaria.plans import catalog

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables here")


def by_sql(sql: str) -> list[tuple]:
    c = duckdb.connect()
    for t in ("orders", "lineitem", "events"):
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return sorted(c.execute(sql).fetchall(), key=str)


def by_spark(spark, name: str, *cols: str) -> list[tuple]:
    return sorted((tuple(r) for r in catalog.QUERIES[name](spark, SF).select(*cols).collect()), key=str)


def test_range_cover_counts_every_day(spark):
    want = by_sql("""
WITH o AS (SELECT l_orderkey, o_orderdate::DATE AS a, min(l_shipdate)::DATE AS b FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2),
x AS (SELECT l_orderkey, unnest(generate_series(a::TIMESTAMP, b::TIMESTAMP, INTERVAL 1 DAY))::DATE AS day FROM o WHERE b >= a)
SELECT day, count(*) AS covering FROM x GROUP BY day""")
    assert by_spark(spark, "range_cover", "day", "covering") == want


def test_timeline_reads_every_mark(spark):
    want = by_sql("""
WITH p AS (SELECT ts::DATE AS day, list_sort(list(DISTINCT event_type)) AS v FROM events WHERE event_type IN ('signup','error') GROUP BY 1),
s AS (SELECT unnest(generate_series((SELECT min(ts) FROM events)::DATE::TIMESTAMP, (SELECT max(ts) FROM events)::DATE::TIMESTAMP, INTERVAL 1 DAY))::DATE AS day),
j AS (SELECT s.day, v FROM s LEFT JOIN p USING (day)),
c AS (SELECT day, last_value(CASE WHEN len(v) > 0 THEN {'v': CASE WHEN len(v) = 1 THEN v[1] END} END IGNORE NULLS) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING) AS l,
  CASE WHEN len(v) > 1 THEN array_to_string(v, ',') END AS conflict FROM j)
SELECT day, l.v AS value, conflict FROM c""")
    assert by_spark(spark, "timeline_conflict_carry", "day", "value", "conflict") == want


def test_conflict_reads_every_event(spark):
    want = by_sql("""
SELECT user_id, CASE WHEN count(DISTINCT event_type) = 1 THEN min(event_type) END AS value,
  CASE WHEN count(DISTINCT event_type) > 1 THEN array_to_string(list_sort(list(DISTINCT event_type)), ',') END AS conflict FROM events GROUP BY 1""")
    assert by_spark(spark, "conflict_to_null", "user_id", "value", "conflict") == want
