"""Sources and sinks for nested records: JSON, JSONL, journals, COCO boxes, manifests.

Schemas are given, never inferred; bad lines become rows with an error, not
exceptions.  Everything reads and writes through Spark, so any store works.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import datasets
from ..operators.aggregates import ranked

#: A state fact, an event and a note of an observation.
FACT = "struct<status:string,value:string,source:string,reason:string,calibrated:boolean>"
NOTE = "map<string,string>"
EVENT = f"struct<start:bigint,duration:string,status:string,notes:array<{NOTE}>,notation_notes:array<{NOTE}>,effects:array<string>>"
OBSERVATION = f"struct<state:map<string,{FACT}>,voices:array<struct<voice:int,events:array<{EVENT}>>>,relations:array<map<string,string>>>"
RECORD = f"source_id string, part_id string, staff_id string, mode string, bar_index int, instrument string, page int, system_index int, observation {OBSERVATION}"


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines of JSON; blank lines are skipped, broken ones keep their text in ``_corrupt_record``."""
    full = T.StructType.fromDDL(schema).add("_corrupt_record", T.StringType())
    return spark.read.schema(full).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def read_samples(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """JSON arrays (``.json``) and JSONL, as one table."""
    out = None
    for path in paths:
        part = spark.read.schema(schema).option("multiLine", path.endswith(".json")).json(path)
        out = part if out is None else out.unionByName(part)
    return out


def read_journal(spark: SparkSession, path: str, key: str, schema: str) -> DataFrame:
    """An append-only journal: whole lines that parse, the last line of each key.

    A torn last line does not parse and is left out.  Files are read in splits;
    lines are ordered by file, the split's place in it, and place in the split.
    """
    at = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("place"))
    lines = spark.read.text(path).select(at.alias("__at"), F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r"))
    rows = lines.where(F.col(f"r.{key}").isNotNull())
    last = rows.groupBy(F.col(f"r.{key}").alias("__key")).agg(F.max_by("r", "__at").alias("r"))
    return last.select("r.*")


def read_labels(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """A catalogue from a folder with one JSON file a label, with the file's name as ``source_path``; an empty folder is an error."""
    rows = spark.read.schema(schema).option("multiLine", True).json(f"{folder.rstrip('/')}/*.json").withColumn("source_path", F.col("_metadata.file_name"))
    if not rows.take(1):
        raise ValueError(f"no labels in {folder}")
    return rows


def read_song_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text, encoding) of files in the first of four encodings that fits: UTF-8, GBK, CP1252, Latin-1."""

    def local(batches):
        for b in batches:
            texts, names = [], []
            for content in b.column(1).to_pylist():
                for name in ("utf-8", "gbk", "cp1252", "latin-1"):
                    try:
                        texts.append(content.decode(name))
                        names.append(name)
                        break
                    except UnicodeDecodeError:
                        continue
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(names, pa.string())], ["path", "text", "encoding"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(local, "path string, text string, encoding string")


def with_auxiliary(rows: DataFrame, side: DataFrame, key: str, defaults: dict) -> DataFrame:
    """Rows with the fields of a side input, and ``defaults`` where the side lacks the row or the field."""
    joined = rows.join(side.select(key, *defaults), key, "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def sessions(ready: DataFrame, importing: DataFrame) -> DataFrame:
    """Sessions, and a virtual row for each job whose session is not there yet, newest first (id, title, updated, status)."""
    jobs = importing.join(ready, "id", "left_anti").select("id", "title", "updated", F.lit("importing").alias("status"))
    return ready.select("id", "title", "updated", F.lit("ready").alias("status")).unionByName(jobs).orderBy(F.desc("updated"), "id")


def pack(samples: DataFrame, path: str) -> DataFrame:
    """Write samples (image, split, ...) by split with ids by first path, one row an image; images in several splits are returned and keep nothing from being written but themselves."""
    splits = samples.groupBy("image").agg(F.array_sort(F.collect_set("split")).alias("splits"), F.min_by(F.struct(*[c for c in samples.columns if c != "image"]), "split").alias("r"))
    leaks = splits.where(F.size("splits") > 1).select("image", "splits")
    sound = splits.where(F.size("splits") == 1).select("image", "r.*")
    write_jsonl(ranked(sound, "image", "id"), path, "split")
    return leaks


def read_coco(spark: SparkSession, path: str, prefix: str = "") -> DataFrame:
    """Boxes of a COCO file as (image_id, file_name, label, x0, y0, x1, y1); categories are a checked small side."""
    schema = (
        "images array<struct<id:bigint,file_name:string,width:int,height:int>>, categories array<struct<id:bigint,name:string>>, "
        "annotations array<struct<id:bigint,image_id:bigint,category_id:bigint,bbox:array<double>>>"
    )
    doc = spark.read.schema(schema).option("multiLine", True).json(path)
    boxes = doc.select(F.explode("annotations").alias("a")).select("a.*")
    images = doc.select(F.explode("images").alias("i")).select(F.col("i.id").alias("image_id"), "i.file_name")
    names = doc.select(F.explode("categories").alias("c")).select(F.col("c.id").alias("category_id"), F.col("c.name").alias("label"))
    b = F.col("bbox")
    return (
        boxes.join(names.where(F.col("label").startswith(prefix)), "category_id")
        .join(images, "image_id")
        .select("image_id", "file_name", "label", b[0].alias("x0"), b[1].alias("y0"), (b[0] + b[2]).alias("x1"), (b[1] + b[3]).alias("y1"))
    )


def coco_orphans(spark: SparkSession, path: str) -> DataFrame:
    """Annotations whose image the file does not hold."""
    schema = "images array<struct<id:bigint>>, annotations array<struct<id:bigint,image_id:bigint>>"
    doc = spark.read.schema(schema).option("multiLine", True).json(path)
    images = doc.select(F.explode("images").alias("i")).select(F.col("i.id").alias("image_id"))
    return doc.select(F.explode("annotations").alias("a")).select("a.*").join(images, "image_id", "left_anti")


def write_jsonl(df: DataFrame, path: str, split: str | None = None) -> None:
    """JSON lines, one folder a split; Spark's committer makes the publication atomic."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(split) if split else writer).json(path)


def write_coco(boxes: DataFrame, path: str, split: str = "split", images_a_file: int = 10_000) -> None:
    """COCO documents: of each split one for every ``images_a_file`` images, so that none grows with the data.

    Image ids run through a split by file name, annotation ids within an image;
    category ids are by name and the same in all documents.
    """
    names = boxes.select("label").distinct()
    names = ranked(names, "label", "category_id").withColumn("category_id", F.col("category_id") + 1)
    images = datasets._place(boxes.select(split, "file_name").distinct(), split, ["file_name"], "image_id").withColumn("image_id", F.col("image_id").cast("long"))
    rows = boxes.drop("image_id").join(names, "label").join(images, [split, "file_name"])
    own = F.row_number().over(Window.partitionBy(split, "image_id").orderBy("y0", "x0", "label"))
    rows = rows.withColumn("id", F.col("image_id") * 1_000_000 + own).withColumn("part", F.floor((F.col("image_id") - 1) / images_a_file))
    box = F.array("x0", "y0", F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    docs = rows.groupBy(split, "part").agg(
        F.array_sort(F.collect_set(F.struct(F.col("image_id").alias("id"), "file_name"))).alias("images"),
        F.array_sort(F.collect_list(F.struct("id", "image_id", "category_id", box.alias("bbox")))).alias("annotations"),
        F.array_sort(F.collect_set(F.struct(F.col("category_id").alias("id"), F.col("label").alias("name")))).alias("categories"),
    )
    docs.drop("part").write.mode("overwrite").partitionBy(split).json(path)


def merge_coco(parts: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """Boxes of several files under one set of categories: of each file its boxes (category_id, ...) and categories (category_id, name), by name."""
    out = None
    for boxes, categories in parts:
        named = boxes.join(categories.select("category_id", F.col("name").alias("label")), "category_id").drop("category_id")
        out = named if out is None else out.unionByName(named)
    ids = ranked(out.select("label").distinct(), "label", "category_id").withColumn("category_id", F.col("category_id") + 1)
    return out.join(ids, "label")
