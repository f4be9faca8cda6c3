from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tessaria.functions import measure_text as M
from tessaria.functions import notation as N
from tessaria.functions import scalars as S

TEXTS = [
    "M tempo=84 time=6/8 | V0{@0:e:s4f0 @480:q.:s3f9(sl),s5f2<arpeggio,chord:E7> @1920:e:r}",
    "M section=Bridge | V0{@0:s[5:4]:p71 @192:s[5:4]:p72 @384:s[5:4]:p74 @576:s[5:4]:p76 @768:s[5:4]:z @960:w:e}",
    "M time=3/4 | V1{@0:h.:p55(vib)} || V2{@960:q:p50,p43 @1920:q:r}",
]


@pytest.mark.parametrize("text", TEXTS)
def test_texts_survive_a_round_trip(text):
    parsed = M.parse(text)
    assert not parsed["errors"]
    again = M.parse(M.format_measure(parsed))
    assert again["voices"] == parsed["voices"] and again["meta"] == parsed["meta"]


def test_error_codes():
    errors = lambda t: M.parse(t)["errors"]
    assert errors("M | V0{@480:e:s6f2,s6f4}") == ["duplicate_string_in_chord"]
    assert errors("M | V0{@240:k:r @0:q:r}") == ["invalid_duration", "non_increasing_event_starts"]
    assert errors("M tune=9 | V0{@0:h:^}") == ["unknown_field", "repeat_without_event"]
    assert errors("nothing of the kind") == ["not_a_measure"] and M.parse(None) is None
    assert M.format_measure(M.parse("M | V0{@0:h:s5f7,s2f1 @1920:h:s2f1,s5f7}")) == "M | V0{@0:h:s2f1,s5f7 @1920:h:^}"


def test_measure_columns(spark):
    df = spark.createDataFrame([(t,) for t in [*TEXTS, "M time=1/4 | V0{@0:h:r}", "no", None]], "t string")
    rows = df.select(M.parse_measure(F.col("t")).alias("m"), M.canonical("t").alias("c"), M.overfull(F.col("t")).alias("o")).collect()
    assert rows[0].m.voices[0].events[1].notes[0].fret == "9" and M.parse(rows[0].c)["voices"] == M.parse(TEXTS[0])["voices"]
    assert rows[3].o == [0] and rows[4].m.errors == ["not_a_measure"] and rows[5].m is None


@pytest.fixture(scope="module")
def pick(spark):
    one = spark.range(1)
    return lambda c: one.select(c.alias("x")).first().x


def test_scalars(spark, pick):
    tokens = ["e", "q..", "t.", "s[7:4]", "w", "y", "h...", None]
    df = spark.createDataFrame([(t,) for t in tokens], "t string")
    for t, g in zip(tokens, [r[0] for r in df.select(S.duration_ticks(F.col("t"))).collect()]):
        assert (None if g is None else Fraction(g.num, g.den)) == (M.ticks(t) if t else None)
    assert pick(S.staff_pitch(F.lit(33), F.lit(-1))) == 68 and pick(S.staff_pitch(F.lit(-2), F.lit(0))) == 9
    assert pick(S.string_pitch(F.lit(2), F.lit("8"), F.array(F.lit(62), F.lit(57)))) == 65
    assert pick(S.string_pitch(F.lit(2), F.lit("x"), F.array(F.lit(62), F.lit(57)))) is None
    assert pick(S.percent_decode(F.lit("x%2Fy+z"))) == "x/y+z" and pick(S.percent_decode(F.lit("%zz"))) == "%zz"
    assert pick(S.chord_key(F.lit("F ♯ 7"))) == "F#7"
    assert pick(S.fold_name(F.lit("Ærø 2!"))) == "ærø2"
    assert pick(S.add_effect(F.array(F.lit("b")), F.lit("b"))) == ["b"]


def test_white_space_json_and_tempo(pick):
    assert pick(S.clean_text(F.lit("\t x \n"))) == "x" and pick(S.clean_text(F.lit(" \t"))) is None
    assert pick(S.json_body(F.lit('so:\n```\n{"k":[2]}\n```'))) == '{"k":[2]}'
    assert pick(S.json_body(F.lit("{not json}"))) is None and pick(S.json_body(F.lit("none"))) is None
    assert pick(S.quarter_tempo(F.lit(72), F.lit(8), F.lit(False))) == 36
    assert pick(S.quarter_tempo(F.lit(900), F.lit(2), F.lit(True))) is None and pick(S.quarter_tempo(F.lit(0), F.lit(4), F.lit(False))) is None


def test_names_of_instruments(pick):
    text = lambda f, *t: [pick(f(F.lit(x).cast("string"))) for x in t]
    assert text(N.program_of, "Vln.", "2nd Violin in G", "Baritone Saxophone", "El. Pno", "Kazoo", None) == [40, 40, 67, 4, None, None]
    assert text(N.octave_mark, "8va", "15 mb.", "Ottava bassa", "8v") == [12, -24, -12, None]
    assert text(N.capo_fret, "Capo 3", "capo: fret VII", "CAPOTASTO at 12th fret", "capo 25", "capo IIII", "3") == [3, 7, 12, None, None, None]
    assert text(N.octave_convention, " Picc. ", "Double  Bass", "Tuba") == [12, -12, None]
    assert text(N.stated_transposition, "Concert Pitch.", "Transpose -5 semitones", "sounds 3 semitones lower", "Horn in F", "B♭ Trumpet", "Clarinet in E-flat", "Transpose 99 semitones", "Flute") == [0, -5, -3, -7, -2, 3, None, None]


def test_tunings(pick):
    of = lambda n, i, k: pick(N.tuning_of(F.lit(n), F.lit(i), F.lit(k).cast("int")))
    assert of("Drop D", "guitar", None) == [64, 59, 55, 50, 45, 38] and of("Guitar Standard Tuning", "bass", 4) is None
    assert of("bass half-step down", "bass", 5) == [42, 37, 32, 27, 22] and of("Dropped C", "bass", 4) == [41, 36, 31, 24]
    assert of("1/2 step down", "guitar", 7) == [63, 58, 54, 49, 44, 39, 34] and of("DADGAD", "guitar", 7) is None and of("standard", "pitched", None) is None
    assert pick(N.default_tuning(F.lit("bass"), F.lit(None).cast("int"))) == [43, 38, 33, 28]
    assert pick(N.default_tuning(F.lit("drums"), F.lit(None).cast("int"))) == [] and pick(N.default_tuning(F.lit("guitar"), F.lit(5))) is None


def test_durations_drums_and_bars(pick):
    assert pick(N.duration_token(F.lit(16), F.lit(2), F.lit(3), F.lit(2))) == "s..[3:2]" and pick(N.duration_token(F.lit(3), F.lit(0))) is None
    assert pick(N.drum_pitch(F.lit(9), F.lit("x"))) == 42 and pick(N.drum_pitch(F.lit(9), F.lit("normal"))) is None
    array = lambda *v: F.array(*[F.lit(x).cast("int") for x in v])
    got = pick(N.barres(array(2, 4, 4, 3, 2, 2), array(1, 3, 4, 2, 1, 1)))
    assert [tuple(b) for b in got] == [(2, 0, 5)]
    assert pick(N.barres(array(2, None, 2), array(1, 0, 1))) is None and pick(N.barres(array(2, 3), array(1, 1))) is None
    assert pick(N.barres(array(None, 1), array(0, 2))) == []
    assert pick(N.project_strings(array(7, 8, 9), array(0, 2, 5), -1)) == [-1, 7, 9]


def test_keys(spark, pick):
    for name, want in (("DMajor", (2, False)), ("EMajorFlat", (-3, False)), ("FMinorSharp", (3, True)), ("-8:minor", (-8, True)), ("HMajor", None), ("9:major", None)):
        got = pick(N.key_parts(F.lit(name)))
        assert (None if got is None else tuple(got)) == want, name
    rows = spark.range(17).crossJoin(spark.createDataFrame([(True,), (False,)], "m boolean")).select((F.col("id") - 8).cast("int").alias("f"), "m")
    for r in rows.withColumn("p", N.key_parts(N.key_name(F.col("f"), F.col("m")))).collect():
        assert tuple(r.p) == (r.f, r.m)
    for f in range(-8, 9):
        for shift in (-13, -1, 0, 2, 6, 24):
            got = pick(N.transpose_fifths(F.lit(f), F.lit(shift)))
            assert -7 <= got <= 7 and (7 * got - 7 * f - shift) % 12 == 0
    assert pick(N.transpose_fifths(F.lit(5), F.lit(1))) == 0 and pick(N.transpose_fifths(F.lit(1), F.lit(-1))) in (-6, 6)


def test_evidence_of_two_notes(pick):
    names = lambda *v: F.array(*[F.lit(x) for x in v]).cast("array<string>")
    shift = lambda t, e, c, k, *fx: pick(N.dual_shift(*[F.lit(x).cast(d) for x, d in ((t, "int"), (e, "boolean"), (c, "int"), (k, "int"))], names(*fx)))
    assert shift(-12, False, -12, 2) == -14 and shift(-12, True, -12, 2, "vib", "ottava:12") == -14 and shift(None, True, 0, 0) is None and shift(0, None, 0, 0) is None
    note = lambda s, p, *fx: F.struct(F.lit(s).cast("int").alias("string"), F.lit(p).cast("int").alias("pitch"), names(*fx).alias("effects"))
    assert tuple(pick(N.merge_notes(note(3, None, "b"), note(4, 60, "a", "b"), ["string", "pitch"]))) == (3, 60, ["b", "a"])


def test_scores_and_crops(pick):
    logits = F.array(F.lit(1.0), F.lit(3.0), F.lit(3.0))
    p = pick(N.softmax(logits))
    assert abs(sum(p) - 1) < 1e-12 and p[1] == p[2] > p[0] and pick(N.first_argmax(logits)) == 1
    assert pick(N.sigmoid(F.lit(0.0), 2.0)) == 0.5
    at = lambda *v: pick(N.crop_bounds(*[F.lit(float(x)) for x in v], 25.4, 2.0))
    assert tuple(at(100, 80, 10.5, 20, 30, 10)) == (8, 16, 42, 34) and tuple(at(100, 80, 0, 0, 200, 5)) == (0, 0, 100, 9) and at(100, 80, 200, 0, 5, 5) is None


def test_printed_texts(pick):
    chords = {"Am7": True, "B ♭ maj7": True, "C#m7b5/G#": True, "F(add9)": True, "N.C.": True, "G7b9b9": False, "Hello": False, "iv": True, "Dsus4sus4": False, "C11/9": True, "": False}
    for name, want in chords.items():
        assert pick(N.is_chord(F.lit(name))) is want, name
    assert pick(N.printed_text(F.lit(" Ｆｕｌｌ  ⻓\n"))) == "full 长"
    name = lambda t, f="in/put.song.pdf": pick(N.file_name(F.lit(t).cast("string"), F.lit(f)))
    assert name(' A/B: "C"? ') == "A_B_ _C__.gp5" and name("Untitled", "scan.7.pdf") == "scan.7.gp5" and name("con") == "_con.gp5" and name("x.GP5") == "x.gp5"
    assert name("...") == "score.gp5" and len(name("é" * 300).encode()) == 164 and name(None, "a.pdf") == "a.gp5"
