from pyspark.sql import types as T

from tessaria.sources import sql


def test_functions_in_sql(spark):
    sql.register(spark)
    rows = spark.sql("SELECT * FROM measure_events('M | V0{@0:q:s1f5,s2f5 @960:q:r}')").collect()
    assert [(r.voice, r.start, r.notes) for r in rows] == [(0, "0", 2), (0, "960", 0)]
    assert spark.sql("SELECT measure_canonical('M | V0{@0:q:s2f5,s1f3}') c").first().c == "M | V0{@0:q:s1f3,s2f5}"
    sql.expression(spark, "safe_ratio", "a / nullif(b, 0)", "a DOUBLE, b DOUBLE", T.DoubleType())
    assert spark.sql("SELECT safe_ratio(1, 0) x, safe_ratio(1, 2) y").first() == (None, 0.5)


def test_exchange_functions_in_sql(spark):
    sql.register(spark)
    one = lambda body: spark.sql(f"SELECT {body} x").first().x
    text = "M key=GMajor | V0{@0:q:p67(trill:p69:s) @960:h.:p60}"
    assert one(f"m_format(m_parse('{text}'))") == text and one("m_validate('M | V0{@0:q:s1f2,s1f3}')") == ["duplicate_string_in_chord"]
    assert one("duration_ticks('q.')") == 1440.0 and one("duration_ticks('y')") is None
    assert one("transpose_key('DMinor', 2)") == "EMinor" and one("transpose_key('AMajorFlat', 12)") == "AMajorFlat" and one("transpose_key('X', 1)") is None
    written = one(f"""convert_pitch('{text}', '{{"instrument_transpose": -2}}', true)""")
    assert written == "M key=AMajor | V0{@0:q:p69(trill:p71:s) @960:h.:p62}"
    assert one(f"""convert_pitch('{written}', '{{"instrument_transpose": -2}}', false)""") == text
    assert one(f"""convert_pitch('{text}', '{{"clef_octave": 72}}', false)""") is None
    assert one("""relation_voice('{"start":[1,0,0],"end":[1,2,0]}')""") == 1 and one("""relation_voice('{"start":[1,0],"end":[2,0]}')""") is None
    assert one("""range_relation('{"kind":"let"}')""") is True and one("""range_relation('{"shape":"curve"}')""") is False and one("""range_relation('{"start":[0,1],"end":"right"}')""") is True
    assert one("chord_key('E ♭ 7')") == "Eb7"
    assert one("diagram_normalize('3 : X/02/4 : -/1/3 : 2/1/2;2/1/2')") == "3:x/2/4:-/1/3:2/1/2" and one("diagram_normalize('1:x/2:1:-')") is None
    assert [one(f"spelled({p}, {f})") for p, f in ((60, 0), (61, 0), (61, -3), (66, 1), (71, -6), (70, 2), (59, 7))] == ["C4", "C#4", "Db4", "F#4", "Cb5", "A#4", "B3"]
