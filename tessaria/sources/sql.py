"""SQL surface: the tables as views and the library's functions by name."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import exchange, measure_text, scalars
from .tables import table

TABLES = tuple("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split())


#: SQL functions and their types; chord_key is one of built-in expressions.
FUNCTIONS = {
    "m_parse": "string", "m_format": "string", "m_validate": "array<string>", "duration_ticks": "double", "transpose_key": "string", "convert_pitch": "string",
    "relation_voice": "int", "range_relation": "boolean", "diagram_normalize": "string", "spelled": "string",
}


def register(spark: SparkSession, folder: str | None = None, tables: tuple[str, ...] = TABLES) -> None:
    """Views of the tables below ``folder``; the library's functions and the table function ``measure_events`` by name."""
    for name in tables if folder else ():
        table(spark, folder, name).createOrReplaceTempView(name)
    spark.udf.register("measure_canonical", measure_text.canonical)
    spark.udf.register("fold_name", scalars.fold_name)
    for name, kind in FUNCTIONS.items():
        spark.udf.register(name, F.udf(getattr(exchange, name), kind, useArrow=True))
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION chord_key(s STRING) RETURNS STRING RETURN translate(regexp_replace(s, '(?U)\\\\s+', ''), '♭♯', 'b#')")

    @F.udtf(returnType="voice int, start string, duration string, status string, notes int")
    class MeasureEvents:
        """One row per event of a measure text: SELECT * FROM measure_events('M | V0{@0:q:r}')."""

        def eval(self, text: str):
            m = measure_text.parse(text)
            for v in (m or {}).get("voices", []):
                for e in v["events"]:
                    yield v["voice"], e["start"], e["duration"], e["status"], len(e["notes"])

    spark.udtf.register("measure_events", MeasureEvents)


def expression(spark: SparkSession, name: str, body: str, arguments: str, returns: T.DataType) -> None:
    """A SQL function made of built-in expressions only, so that Catalyst inlines it."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {returns.simpleString()} RETURN {body}")
