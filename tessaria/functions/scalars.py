"""Scalar functions as Column expressions; a few that Spark lacks are Arrow UDFs."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TICKS = 960  # of a quarter note
# Ticks of a whole note and the letters of its halvings.
WHOLE = 3840
VALUES = {"w": 1, "h": 2, "q": 4, "e": 8, "s": 16, "t": 32, "f": 64}
# Semitones of the natural steps above C.
SCALE = (0, 2, 4, 5, 7, 9, 11)


def clean_text(c: Column) -> Column:
    """Text without white space at its ends, NULL where nothing is left."""
    return F.nullif(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""), F.lit(""))


def json_body(c: Column) -> Column:
    """From the first ``{`` to the last ``}`` of an answer, code fences or not; NULL unless that is a JSON object."""
    body = clean_text(F.regexp_extract(c, r"(?s)\{.*\}", 0))
    return F.when(F.json_object_keys(body).isNotNull(), body)


def percent_decode(c: Column) -> Column:
    """Percent-decoded text; ``+`` stays, and a text that can't be decoded stays whole."""
    return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)


def percent_encode(c: Column) -> Column:
    return F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))


def chord_key(c: Column) -> Column:
    """A chord name without white space, flats and sharps in ASCII."""
    return F.translate(F.regexp_replace(c, r"(?U)\s+", ""), "♭♯", "b#")


@F.pandas_udf(T.StringType())
def fold_name(s: pd.Series) -> pd.Series:
    """Compatibility-normalised, case-folded, letters, digits and underscores only."""
    return s.map(lambda x: None if x is None else "".join(c for c in unicodedata.normalize("NFKC", x).casefold() if c.isalnum() or c == "_"))


def effect_class(c: Column) -> Column:
    return F.split_part(c, F.lit(":"), F.lit(1))


def safe_ratio(a: Column, b: Column, empty=None) -> Column:
    return F.when(b == 0, F.lit(empty)).otherwise(a / b)


def within(a: Column, b: Column, tolerance: int = 120) -> Column:
    return F.abs(a - b) <= tolerance


def box_overlap(a: Column, b: Column, least: float = 1e-9, smaller: bool = False) -> Column:
    """IoU of two box structs (x0, y0, x1, y1), or the share of the smaller box."""
    inter = F.greatest(F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]), F.lit(0.0)) * F.greatest(
        F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]), F.lit(0.0)
    )
    area = [(r["x1"] - r["x0"]) * (r["y1"] - r["y0"]) for r in (a, b)]
    whole = F.least(*area) if smaller else area[0] + area[1] - inter
    return inter / F.greatest(whole, F.lit(least))


def duration_parts(token: Column) -> Column:
    """struct(value, dots, enters, times) of a duration token such as ``e.[3:2]``; NULL where it is none."""
    pattern = r"^([whqestf])(\.{0,2})(?:\[([1-9][0-9]?):([1-9][0-9]?)\])?$"
    get = lambda i: F.regexp_extract(token, pattern, i)
    value = F.create_map(*[F.lit(x) for kv in VALUES.items() for x in kv])
    return F.when(
        token.rlike(pattern),
        F.struct(
            F.try_element_at(value, get(1)).alias("value"),
            F.char_length(get(2)).alias("dots"),
            F.coalesce(F.nullif(get(3), F.lit("")).cast("int"), F.lit(1)).alias("enters"),
            F.coalesce(F.nullif(get(4), F.lit("")).cast("int"), F.lit(1)).alias("times"),
        ),
    )


def duration_ticks(token: Column) -> Column:
    """Exact ticks of a token as struct(num, den), reduced."""
    p = duration_parts(token)
    dots = F.element_at(F.array(F.lit(1), F.lit(3), F.lit(7)), p["dots"] + 1)
    num = F.lit(WHOLE).cast("long") * dots * p["times"]
    den = p["value"].cast("long") * F.element_at(F.array(F.lit(1), F.lit(2), F.lit(4)), p["dots"] + 1) * p["enters"]
    return F.when(p.isNotNull(), reduced(num, den))


def reduced(num: Column, den: Column) -> Column:
    """struct(num, den) in lowest terms, by Euclid's steps folded (64-bit values need at most 92)."""
    start = F.struct(F.abs(num).cast("long").alias("a"), F.abs(den).cast("long").alias("b"))
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % s["b"]).alias("b")))
    g = F.aggregate(F.sequence(F.lit(1), F.lit(92)), start, step, lambda s: s["a"])
    return F.struct(F.floor(num / g).cast("long").alias("num"), F.floor(den / g).cast("long").alias("den"))


def staff_pitch(diatonic: Column, alter: Column) -> Column:
    """MIDI pitch of a diatonic number (C0 is 0) and an alteration."""
    scale = F.array(*[F.lit(s) for s in SCALE])
    return (12 * (F.floor(diatonic / 7) + 1) + F.element_at(scale, F.pmod(diatonic, F.lit(7)).cast("int") + 1) + alter).cast("int")


def string_pitch(string: Column, fret: Column, tuning: Column) -> Column:
    """Sounding pitch of a fretted string; NULL for a dead note or a string the tuning lacks."""
    return F.try_element_at(tuning, string.cast("int")) + fret.try_cast("int")


def quarter_tempo(bpm: Column, beat: Column, dotted: Column) -> Column:
    """Quarter notes a minute of a tempo given for another beat value; NULL where either is not in 1 to 999."""
    quarter = F.round(bpm * 4 / beat * F.when(dotted, 1.5).otherwise(1.0)).cast("int")
    return F.when(bpm.between(1, 999) & quarter.between(1, 999), quarter)


def add_effect(effects: Column, effect: Column) -> Column:
    return F.when(effect.isNull(), effects).otherwise(F.array_union(F.coalesce(effects, F.array().cast("array<string>")), F.array(effect)))
