import json

from pyspark.sql import functions as F

from tessaria.operators import ordered
from tessaria.sources import records
from tessaria.streaming import live


def test_journal_keeps_the_last_whole_line(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"k":1,"v":"a"}\n\n{"k":2,"v":"b"}\n{"k":1,"v":"c"}\n{"k":3,"v":')
    got = {r.k: r.v for r in records.read_journal(spark, str(tmp_path / "a.jsonl"), "k", "k int, v string").collect()}
    assert got == {1: "c", 2: "b"}


def test_jsonl_and_samples(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"k":1}\n\nbroken\n')
    rows = records.read_jsonl(spark, str(tmp_path / "a.jsonl"), "k int").cache().collect()
    assert [(r.k, r._corrupt_record) for r in rows] == [(1, None), (None, "broken")]
    (tmp_path / "b.json").write_text('[{"k":2},{"k":3}]')
    both = records.read_samples(spark, [str(tmp_path / "b.json")], "k int")
    assert sorted(r.k for r in both.collect()) == [2, 3]
    records.write_jsonl(both.withColumn("s", F.lit("dev")), str(tmp_path / "out"), "s")
    assert records.read_jsonl(spark, str(tmp_path / "out" / "s=dev"), "k int").count() == 2


def test_observation_schema(spark, tmp_path):
    row = {"source_id": "a", "bar_index": 0, "observation": {"state": {"time": {"status": "observed", "value": "4/4"}}, "voices": [{"voice": 0, "events": [{"start": 0, "duration": "q", "notes": [{"string": 1, "fret": "x", "accidental": None}]}]}]}}
    (tmp_path / "r.jsonl").write_text(json.dumps(row))
    r = records.read_jsonl(spark, str(tmp_path / "r.jsonl"), records.RECORD).first()
    note = r.observation.voices[0].events[0].notes[0]
    assert note == {"string": "1", "fret": "x", "accidental": None} and r.observation.state["time"].value == "4/4"


def test_coco_round_trip(spark, tmp_path):
    doc = {"images": [{"id": 7, "file_name": "p.png"}], "categories": [{"id": 1, "name": "measure_tab"}, {"id": 2, "name": "chord"}],
           "annotations": [{"id": 1, "image_id": 7, "category_id": 1, "bbox": [1, 2, 3, 4]}, {"id": 2, "image_id": 7, "category_id": 2, "bbox": [0, 0, 1, 1]}, {"id": 3, "image_id": 9, "category_id": 1, "bbox": [0, 0, 1, 1]}]}
    path = tmp_path / "c.json"
    path.write_text(json.dumps(doc))
    rows = records.read_coco(spark, str(path), "measure_").collect()
    assert [(r.label, r.x0, r.y1) for r in rows] == [("measure_tab", 1.0, 6.0)]
    assert [r.id for r in records.coco_orphans(spark, str(path)).collect()] == [3]
    records.write_coco(records.read_coco(spark, str(path)).withColumn("split", F.lit("train")), str(tmp_path / "out"))
    out = spark.read.json(str(tmp_path / "out")).first()
    assert [a.bbox for a in out.annotations] == [[0.0, 0.0, 1.0, 1.0], [1.0, 2.0, 3.0, 4.0]]


def test_streamed_carry_forward_equals_batch(spark, tmp_path):
    rows = [("a", 0, "observed", 5), ("a", 1, "absent", None), ("a", 2, "unknown", None), ("a", 3, "absent", None), ("a", 5, "observed", 7), ("a", 6, "absent", None), ("b", 0, "absent", None), ("b", 1, "observed", 1), ("b", 3, "absent", None)]
    df = spark.createDataFrame(rows, "key string, ord long, status string, value long")
    for i in range(2):
        df.where((F.col("ord") < 3) == (i == 0)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = live.carry_forward(stream).writeStream.format("memory").queryName("carried").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    from pyspark.sql import Window

    gap = F.col("ord") - F.lag("ord").over(Window.partitionBy("key").orderBy("ord")) > 1
    batch = ordered.carry_forward(ordered.islands(df, ["key"], ["ord"], gap), ["key", "island"], ["ord"], "status", "value")
    want = {(r.key, r.ord): (r.carried_status, r.carried_value) for r in batch.collect()}
    assert {(r.key, r.ord): (r.carried_status, r.carried_value) for r in spark.table("carried").collect()} == want


def test_streamed_windows(spark, tmp_path):
    df = spark.sql("select timestamp_seconds(id * 60) ts, id % 2 k from range(30)")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = live.tumbling(stream, "ts", "10 minutes", ["k"]).writeStream.format("memory").queryName("tumbled").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.k, r.n) for r in spark.table("tumbled").collect()) == [(0, 5)] * 3 + [(1, 5)] * 3


def test_last_wins(spark, tmp_path):
    schema = "k int, ord long, v string"
    for i, rows in enumerate([[(1, 1, "a"), (2, 1, "b")], [(1, 2, "c")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = live.last_wins(stream, "k", "ord", str(tmp_path / "out"), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert {r.k: r.v for r in live.newest(spark, str(tmp_path / "out"), "k", "ord").collect()} == {1: "c", 2: "b"}
    assert spark.read.parquet(str(tmp_path / "out" / "batch=1")).count() == 1  # only its own rows
    live.compact(spark, str(tmp_path / "out"), str(tmp_path / "new"), "k", "ord")
    assert live.newest(spark, str(tmp_path / "new"), "k", "ord").count() == 2


def test_streamed_sessions_and_distinct_events(spark, tmp_path):
    df = spark.sql("select timestamp_seconds(60 * (id + 100 * floor(id / 5))) ts, 'u' u, id % 7 k from range(10)")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    for name, rows, mode in (("sessioned", live.sessions(stream, "ts", "10 minutes", ["u"]), "complete"), ("once", live.deduplicated(stream, "k", "ts", "10 days"), "append")):
        q = rows.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    assert [r.n for r in spark.table("sessioned").collect()] == [5, 5]
    assert sorted(r.k for r in spark.table("once").collect()) == list(range(7))


def test_labels_songs_and_sides(spark, tmp_path):
    (tmp_path / "labels").mkdir()
    for n in "ba":
        (tmp_path / "labels" / f"{n}.json").write_text(json.dumps({"source_id": n, "family": "f"}))
    got = records.read_labels(spark, str(tmp_path / "labels"), "source_id string, family string").collect()
    assert sorted((r.source_id, r.source_path) for r in got) == [("a", "a.json"), ("b", "b.json")]
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "x.json").write_text("")
    import pytest

    with pytest.raises(ValueError):
        records.read_labels(spark, str(tmp_path / "none"), "source_id string")
    (tmp_path / "songs").mkdir()
    for n, (text, code) in {"1": ("é日", "utf-8"), "2": ("日本", "gbk"), "3": ("caf\xe9 ", "cp1252")}.items():
        (tmp_path / "songs" / n).write_bytes(text.encode(code))
    got = {r.path[-1]: (r.text, r.encoding) for r in records.read_song_texts(spark, str(tmp_path / "songs")).collect()}
    assert got["1"] == ("é日", "utf-8") and got["2"] == ("日本", "gbk") and len(got) == 3
    rows = spark.createDataFrame([(1,), (2,)], "id int")
    side = spark.createDataFrame([(1, None, True)], "id int, t string, b boolean")
    assert {tuple(r) for r in records.with_auxiliary(rows, side, "id", {"t": "{}", "b": False}).collect()} == {(1, "{}", True), (2, "{}", False)}
    ready = spark.createDataFrame([(1, "a", 5), (2, "b", 9)], "id int, title string, updated int")
    jobs = spark.createDataFrame([(2, "b", 1), (3, "c", 7)], "id int, title string, updated int")
    assert [(r.id, r.status) for r in records.sessions(ready, jobs).collect()] == [(2, "ready"), (3, "importing"), (1, "ready")]


def test_packed_samples_and_merged_coco(spark, tmp_path):
    rows = [("b.png", "train", 1), ("a.png", "train", 2), ("a.png", "train", 3), ("c.png", "dev", 4), ("d.png", "dev", 5), ("d.png", "train", 6)]
    leaks = records.pack(spark.createDataFrame(rows, "image string, split string, v int"), str(tmp_path / "out"))
    assert [tuple(r) for r in leaks.collect()] == [("d.png", ["dev", "train"])]
    got = spark.read.json(str(tmp_path / "out"))
    assert sorted((r.image, r.id, r.split) for r in got.collect()) == [("a.png", 0, "train"), ("b.png", 1, "train"), ("c.png", 2, "dev")]
    one = spark.createDataFrame([(1, 0.5)], "category_id int, x double"), spark.createDataFrame([(1, "bar"), (2, "clef")], "category_id int, name string")
    two = spark.createDataFrame([(1, 1.5), (2, 2.5)], "category_id int, x double"), spark.createDataFrame([(1, "staff"), (2, "bar")], "category_id int, name string")
    assert sorted((r.x, r.label, r.category_id) for r in records.merge_coco([one, two]).collect()) == [(0.5, "bar", 1), (1.5, "staff", 2), (2.5, "bar", 1)]
