"""Names, marks and keys of printed music as Column expressions.

Unknown text gives NULL, never a default.  White space and letters are
Unicode's, as in the measure text.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scalars import VALUES

# Printed abbreviations and words of instruments, and their General MIDI programs.
SHORT_PROGRAMS = {
    "pno": 0, "el pno": 4, "hpsi": 6, "clav": 7, "org": 16, "acc": 21, "harm": 22, "chr": 52, "syn chr": 54, "vln": 40, "vla": 41, "vlc": 42,
    "fl": 73, "picc": 72, "ob": 68, "clar": 71, "bn": 70, "tpt": 56, "tbn": 57, "tba": 58, "fhn": 60, "hp": 46, "sax": 65, "saxophone": 65,
    "vib": 11, "rec": 74, "whis": 78,
}
WORD_PROGRAMS = [
    ("piano", 0), ("violin", 40), ("viola", 41), ("cello|violoncello", 42), ("contrabass", 43), ("flute", 73), ("oboe", 68), ("clarinet", 71),
    ("bassoon", 70), ("english horn|cor anglais", 69), ("soprano sax|soprano saxophone", 64), ("alto sax|alto saxophone", 65),
    ("tenor sax|tenor saxophone", 66), ("baritone sax|baritone saxophone", 67), ("trumpet", 56), ("french horn|horn in f|f horn", 60),
]
# Marks of an octave and their semitones.
OCTAVE_MARKS = {
    "8va": 12, "8vaalta": 12, "ottava": 12, "8vb": -12, "8vabassa": -12, "8ba": -12, "ottavabassa": -12,
    "15ma": 24, "15maalta": 24, "15mb": -24, "15mabassa": -24, "15ba": -24,
}
# Instruments that sound an octave away from their notes.
OCTAVE_INSTRUMENTS = {"piccolo": 12, "picc": 12, "contrabass": -12, "double bass": -12, "guitar": -12, "bass guitar": -12}
# Transposing instruments, their keys and semitones.
TRANSPOSING = [
    ("clarinet", "bb", -2), ("clarinet", "a", -3), ("clarinet", "eb", 3), ("bass clarinet", "bb", -14), ("trumpet", "bb", -2), ("trumpet", "a", -3),
    ("trumpet", "c", 0), ("trumpet", "d", 2), ("trumpet", "eb", 3), ("soprano sax(?:ophone)?", "bb", -2), ("alto sax(?:ophone)?", "eb", -9),
    ("tenor sax(?:ophone)?", "bb", -14), ("baritone sax(?:ophone)?", "eb", -21), ("(?:french )?horn", "f", -7),
    ("(?:english horn|cor anglais)", "f", -7),
]
# Open strings, high to low, by instrument and number of strings.
OPEN_STRINGS = {
    ("guitar", 6): [64, 59, 55, 50, 45, 40], ("guitar", 7): [64, 59, 55, 50, 45, 40, 35], ("guitar", 8): [64, 59, 55, 50, 45, 40, 35, 30],
    ("bass", 4): [43, 38, 33, 28], ("bass", 5): [43, 38, 33, 28, 23], ("bass", 6): [48, 43, 38, 33, 28, 23], ("bass", 7): [53, 48, 43, 38, 33, 28, 23],
}
# Named tunings of six strings.
NAMED_TUNINGS = {
    "standard": [64, 59, 55, 50, 45, 40], "drop d": [64, 59, 55, 50, 45, 38], "drop c": [62, 57, 53, 48, 43, 36], "drop b": [61, 56, 52, 47, 42, 35],
    "dropped d tune down 1/2 step": [63, 58, 54, 49, 44, 37], "tune down 1/2 step": [63, 58, 54, 49, 44, 39], "tune down 1 step": [62, 57, 53, 48, 43, 38],
    "tune down 2 step": [60, 55, 51, 46, 41, 36], "dadgad": [62, 57, 55, 50, 45, 38], "open d": [62, 57, 54, 50, 45, 38], "open g": [62, 59, 55, 50, 43, 38],
    "open e": [64, 59, 56, 52, 47, 40], "open a": [64, 61, 57, 52, 45, 40], "double drop d": [62, 59, 55, 50, 45, 38],
}
# Other names of the same tunings.
TUNING_NAMES = {
    "half step down": "tune down 1/2 step", "1/2 step down": "tune down 1/2 step", "eb standard": "tune down 1/2 step", "e flat standard": "tune down 1/2 step",
    "whole step down": "tune down 1 step", "full step down": "tune down 1 step", "one step down": "tune down 1 step", "d standard": "tune down 1 step",
    "two steps down": "tune down 2 step", "c standard": "tune down 2 step", "dropped d": "drop d", "dropped c": "drop c", "dropped b": "drop b",
}
# Shift of all strings, and of four strings below a lowest one of 26.
TUNING_SHIFTS = {"standard": 0, "tune down 1/2 step": -1, "tune down 1 step": -2, "tune down 2 step": -4}
LOW_SHIFTS = {"drop d": 0, "drop c": -2, "drop b": -3, "dropped d tune down 1/2 step": -1}
# Positions from the bottom line and heads of a drum kit, and their MIDI notes.
DRUMS = {
    "normal": {0: 35, 1: 36, 2: 43, 3: 45, 4: 47, 5: 38, 6: 48, 7: 50}, "diamond": {5: 38, 8: 53}, "x": {-1: 44, 5: 37, 8: 51, 9: 42, 10: 55},
    "circle-x": {9: 46}, "circle-slash": {9: 46}, "heavy-x": {9: 57, 10: 49}, "heavy-x-hat": {11: 52}, "triangle-up": {5: 54, 7: 56, 8: 56, 9: 56},
}
# The form of a capo mark, and the phrases of a stated transposition.
CAPO_MARK = (
    r"(?iU)^\s*(?:capo|capodastro|capotasto|变调夹)\s*[:=.]?\s*(?:(?:at|on)\s+)?(?:fret\s+)?([0-9]{1,2}|[IVX]{1,5})(?:st|nd|rd|th)?\s*(?:fret|品)?\s*$"
)
TRANSPOSE_PHRASE = r"^(?:transpose|written to sounding:)\s*([+-]?[0-9]+)\s+semitones?$"
SOUNDS_PHRASE = r"^sounds\s+([0-9]+)\s+semitones?\s+(?:lower|higher)$"
CONCERT_PHRASES = ("concert pitch", "at concert pitch")
# Parts of a chord symbol, and the texts for no chord.
CHORD_SIGN = "(?:##|bb|#|b|x)?"
CHORD_ROOT = f"(?:[A-Ha-h]{CHORD_SIGN}|{CHORD_SIGN}(?:[IViv]+|[1-7]))"
CHORD_QUALITY = r"(?:[mM]aj|[mM]in|dim|aug|sus|dom|m|M|\+|-|°|ø|Δ|o)?"
CHORD_EXTENSION = "(?:2|4|5|6|7|9|11|13)"
CHORD_MODIFIER = "(?:[#b](?:5|6|7|9|11|13)|(?:[mM]aj|M)(?:7|9|11|13)|(?:sus|add|omit|no)(?:2|3|4|5|6|7|9|11|13)|alt)"
NO_CHORD = ("nc", "n.c", "n.c.", "nochord")
STEPS = "FCGDAEB"


def _pick(key: Column, table: dict) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def squeeze(c: Column) -> Column:
    """Lower case, white space as single blanks, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(c), r"(?U)\s+", " "))


def program_of(name: Column) -> Column:
    """General MIDI program of a printed name: the whole as an abbreviation, else the first instrument word of the list in it."""
    text = F.trim(F.regexp_replace(F.lower(name), "[^a-z]+", " "))
    padded = F.concat(F.lit(" "), text, F.lit(" "))
    words = [F.when(padded.rlike(f" (?:{w}) "), n) for w, n in WORD_PROGRAMS]
    return F.coalesce(_pick(text, SHORT_PROGRAMS), *words)


def octave_mark(text: Column) -> Column:
    return _pick(F.regexp_replace(F.lower(text), r"(?U)[\s.\-–_]", ""), OCTAVE_MARKS)


def capo_fret(text: Column) -> Column:
    """Fret 0 to 24 (Roman: 1 to 24) of a capo mark."""
    label = F.upper(F.regexp_extract(text, CAPO_MARK, 1))
    ones = ("", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX")
    roman = {"X" * (n // 10) + ones[n % 10]: n for n in range(1, 25)}
    number = label.try_cast("int")
    return F.coalesce(F.when(number <= 24, number), _pick(label, roman))


def octave_convention(name: Column) -> Column:
    return _pick(F.trim(F.regexp_replace(squeeze(name), r"\.+$", "")), OCTAVE_INSTRUMENTS)


def stated_transposition(name: Column) -> Column:
    """Semitones from written to sounding that a phrase states, -36 to 36."""
    text = F.regexp_replace(F.replace(squeeze(name), F.lit("−"), F.lit("-")), r"\.+$", "")
    own = F.regexp_extract(text, TRANSPOSE_PHRASE, 1).try_cast("int")
    by = F.regexp_extract(text, SOUNDS_PHRASE, 1).try_cast("int")
    by = F.when(text.endswith("lower"), -by).otherwise(by)
    flat = F.regexp_replace(F.replace(text, F.lit("♭"), F.lit("b")), r"\b([a-g])[ -]flat\b", "$1b")
    in_key = [F.when(flat.rlike(f"^(?:{i} in {k}|{k} {i})$"), n) for i, k, n in TRANSPOSING]
    within = [F.when(x.between(-36, 36), x) for x in (own, by)]
    return F.coalesce(F.when(text.isin(*CONCERT_PHRASES), 0), octave_convention(text), *within, *in_key)


def default_tuning(instrument: Column, strings: Column) -> Column:
    """Open strings, high to low; none for staff instruments, NULL where the number of strings settles nothing."""
    n = F.coalesce(strings, F.when(instrument == "bass", 4).otherwise(6))
    out = F.when(instrument.isin("pitched", "drums"), F.array().cast("array<int>"))
    for (i, k), tuning in OPEN_STRINGS.items():
        out = out.when((instrument == i) & (n == k), F.array(*[F.lit(p) for p in tuning]))
    return out


def tuning_of(name: Column, instrument: Column, strings: Column) -> Column:
    """Open strings of a named tuning; NULL where the name is unknown or is another instrument's."""
    label = F.regexp_replace(F.replace(F.replace(F.lower(F.trim(name)), F.lit("½"), F.lit("1/2")), F.lit("♭"), F.lit("b")), r"(?U)[\s\-–]+", " ")
    prefix = F.regexp_extract(label, "^(guitar|bass) ", 1)
    label = F.regexp_replace(F.regexp_replace(label, "^(?:guitar|bass) ", ""), " tuning$", "")
    label = F.coalesce(_pick(label, TUNING_NAMES), label)
    of_guitar = F.lit(None).cast("array<int>")
    for k, tuning in NAMED_TUNINGS.items():
        of_guitar = F.when(label == k, F.array(*[F.lit(p) for p in tuning])).otherwise(of_guitar)
    base = default_tuning(instrument, strings)
    every, low = _pick(label, TUNING_SHIFTS), _pick(label, LOW_SHIFTS)
    four = F.concat(F.slice(base, 1, 3), F.array(F.lit(26)))
    shifted = F.when(every.isNotNull(), F.transform(base, lambda p: p + every)).when(
        (instrument == "bass") & (F.size(base) == 4) & low.isNotNull(), F.transform(four, lambda p: p + low)
    )
    six = (instrument == "guitar") & F.coalesce(strings == 6, F.lit(True))
    known = F.when(six, of_guitar).when(instrument.isin("guitar", "bass"), shifted)
    return F.when((prefix == "") | (prefix == instrument), known)


def duration_token(value: Column, dots: Column, enters: Column | None = None, times: Column | None = None) -> Column:
    """The token of a note value (4: a quarter), its dots and its tuplet; NULL for a value that has none."""
    letter = _pick(value, {v: k for k, v in VALUES.items()})
    e, t = (F.coalesce(c, F.lit(1)) if c is not None else F.lit(1) for c in (enters, times))
    tuplet = F.when((e == 1) & (t == 1), "").otherwise(F.concat(F.lit("["), e.cast("string"), F.lit(":"), t.cast("string"), F.lit("]")))
    return F.concat(letter, F.repeat(F.lit("."), F.coalesce(dots, F.lit(0))), tuplet)


def drum_pitch(position: Column, head: Column) -> Column:
    """MIDI note of a head at a position of a drum staff; NULL where either is unknown."""
    out = F.lit(None).cast("int")
    for shape, notes in DRUMS.items():
        out = F.when(head == shape, _pick(position.cast("int"), notes)).otherwise(out)
    return out


def key_parts(name: Column) -> Column:
    """struct(fifths, minor) of a key name: a count of fifths (``-3:minor``), or a step, accidentals and Major or Minor."""
    counted = r"^([+-]?[0-9]+):(major|minor)$"
    own = F.regexp_extract(name, counted, 1).try_cast("int")
    minor = F.when(own.isNotNull(), name.endswith(":minor")).otherwise(name.contains("Minor"))
    plain = F.replace(F.replace(F.regexp_replace(name, "Major|Minor", ""), F.lit("Sharp"), F.lit("#")), F.lit("Flat"), F.lit("b"))
    plain = F.translate(plain, "♯♭", "#b")
    spelled = plain.rlike("^[A-G](?:#*|b*)$")
    sharps = F.char_length(F.regexp_replace(plain, "[^#]", "")) - F.char_length(F.regexp_replace(plain, "[^b]", ""))
    step = F.instr(F.lit(STEPS), F.substring(plain, 1, 1)) - 2  # C is 0 fifths
    fifths = F.coalesce(own, F.when(spelled, step + 7 * sharps - F.when(minor, 3).otherwise(0)))
    return F.when(fifths.between(-8, 8), F.struct(fifths.cast("int").alias("fifths"), minor.alias("minor")))


def key_name(fifths: Column, minor: Column) -> Column:
    """The step, accidentals and mode of a key of at most eight fifths."""
    at = fifths + F.when(minor, 3).otherwise(0) + 1  # F is 0
    step = F.substr(F.lit(STEPS), F.pmod(at, F.lit(7)).cast("int") + 1, F.lit(1))
    signs = F.floor(at / 7).cast("int")
    word = F.when(signs > 0, F.repeat(F.lit("Sharp"), signs)).otherwise(F.repeat(F.lit("Flat"), -signs))
    mode = F.when(minor, "Minor").otherwise("Major")
    return F.when(fifths.between(-8, 8), F.concat(step, mode, word))


def transpose_fifths(fifths: Column, shift: Column) -> Column:
    """Fifths of a key moved by semitones, at most seven: fewest accidentals, then nearest to where it was."""
    twelve = F.pmod(shift, F.lit(12))
    stay = F.when(fifths < -7, fifths + 12).when(fifths > 7, fifths - 12).otherwise(fifths)
    tonic = F.pmod(7 * fifths + twelve, F.lit(12))
    fits = F.filter(F.sequence(F.lit(-7), F.lit(7)), lambda f: F.pmod(7 * f, F.lit(12)) == tonic)
    best = F.array_min(F.transform(fits, lambda f: F.struct(F.abs(f).alias("a"), F.abs(f - fifths).alias("d"), f.cast("int").alias("f"))))
    return F.when(twelve == 0, stay.cast("int")).otherwise(best["f"])


def dual_shift(transpose: Column, explicit: Column, clef: Column, capo: Column, effects: Column) -> Column:
    """Semitones from a staff note to the sounding string: NULL while any part of it is unknown."""
    own = F.when(~explicit & (transpose == clef), 0).otherwise(transpose)
    marks = F.filter(F.transform(effects, lambda e: F.regexp_extract(e, r"^ottava:(-?[0-9]+)$", 1).try_cast("int")), lambda n: n.isNotNull())
    return own + clef - capo + F.coalesce(F.get(marks, F.lit(0)), F.lit(0)) + F.when(explicit.isNull(), F.lit(None)).otherwise(0)


def merge_notes(tab: Column, notation: Column, fields: list[str]) -> Column:
    """One note's evidence from two: a field of ``tab`` where it has one, else of ``notation``; effects are united."""
    empty = F.array().cast("array<string>")
    united = F.array_union(F.coalesce(tab["effects"], empty), F.coalesce(notation["effects"], empty))
    return F.struct(*[F.coalesce(tab[f], notation[f]).alias(f) for f in fields], united.alias("effects"))


def softmax(logits: Column, temperature: float = 1.0) -> Column:
    """Probabilities of an array of logits."""
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp((x - top) / temperature))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.transform(e, lambda x: x / total)


def first_argmax(values: Column) -> Column:
    """Place, from 0, of the largest value; the first of equal ones."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def sigmoid(logit: Column, temperature: float = 1.0) -> Column:
    return 1 / (1 + F.exp(-logit / temperature))


def crop_bounds(width: Column, height: Column, x: Column, y: Column, w: Column, h: Column, dpi: float, across_mm: float, along_mm: float = 4.0) -> Column:
    """struct(x0, y0, x1, y1): a box with margins in pixels, halves to even, within the page; NULL where nothing is left."""
    px, py = across_mm * dpi / 25.4, along_mm * dpi / 25.4

    def edge(value: Column, most: Column) -> Column:
        return F.least(F.greatest(F.rint(value), F.lit(0.0)), most.cast("double")).cast("int")

    x0, x1, y0, y1 = edge(x - px, width), edge(x + w + px, width), edge(y - py, height), edge(y + h + py, height)
    sound = (w > 0) & (h > 0) & (x1 > x0) & (y1 > y0)
    return F.when(sound, F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1")))


def barres(frets: Column, fingers: Column) -> Column:
    """array(struct(fret, first, last)): fingers 1 to 4 on several strings, by finger.

    NULL for an impossible diagram: one finger on several frets, or a string
    under a barre that is muted or stopped lower.  ``frets`` has NULL for a muted string.
    """
    places = F.sequence(F.lit(0), F.size(frets) - 1)

    def of_finger(k: Column) -> Column:
        at = F.filter(places, lambda i: F.get(fingers, i) == k)
        fret = F.get(frets, F.get(at, F.lit(0)))
        first, last = F.array_min(at), F.array_max(at)
        same = F.forall(at, lambda i: F.coalesce(F.get(frets, i) == fret, F.lit(False)))
        clear = F.forall(F.filter(places, lambda i: i.between(first, last)), lambda i: F.coalesce(F.get(frets, i) >= fret, F.lit(False)))
        return F.struct((F.size(at) > 1).alias("is"), (same & clear).alias("ok"), F.struct(fret.alias("fret"), first.alias("first"), last.alias("last")).alias("b"))

    found = F.filter(F.transform(F.sequence(F.lit(1), F.lit(4)), of_finger), lambda x: x["is"])
    return F.when(F.forall(found, lambda x: x["ok"]), F.transform(found, lambda x: x["b"]))


def project_strings(values: Column, high_to_low: Column, missing) -> Column:
    """Values by string, low to high, of the strings that ``high_to_low`` names (from 0, the highest)."""
    n = F.size(values)
    return F.transform(F.reverse(high_to_low), lambda i: F.coalesce(F.when(i < n, F.get(values, n - 1 - i)), F.lit(missing)))


@F.pandas_udf(T.StringType())
def printed_text(s: pd.Series) -> pd.Series:
    """Compatibility-normalised and case-folded, white space as single blanks; for looking a text up in another."""
    # Radicals that have no compatibility form.
    radicals = str.maketrans({"⻓": "长", "⻘": "青", "⻛": "风"})
    return s.map(lambda x: None if x is None else " ".join(unicodedata.normalize("NFKC", x.translate(radicals)).casefold().split()))


@F.pandas_udf(T.StringType())
def compatible(s: pd.Series) -> pd.Series:
    """NFKC form of a text."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def is_chord(name: Column) -> Column:
    """Whether a text is a chord symbol: root, quality, extension, at most four modifiers, a bracket, a bass; no modifier twice in a row."""
    inner = f"(?:{CHORD_MODIFIER}|{CHORD_EXTENSION}?)"
    bracket, bass = rf"(?:\({inner}(?:,?{inner}){{0,3}}\))?", f"(?:/(?:{CHORD_ROOT}|9|11|13))?"
    whole = rf"^{CHORD_ROOT}{CHORD_QUALITY}{CHORD_EXTENSION}?(?:M|\+|-|°|ø)?{CHORD_MODIFIER}{{0,4}}{bracket}{bass}$"
    twice = r"((?:[#b]|sus|add|omit|no)(?:11|13|[2345679]))\1(?![0-9])"
    text = F.translate(F.regexp_replace(compatible(name), r"(?U)\s+", ""), "♭♯", "b#")
    text = F.replace(F.replace(text, F.lit("major"), F.lit("maj")), F.lit("minor"), F.lit("min"))
    return F.lower(text).isin(*NO_CHORD) | (text.rlike(whole) & ~text.rlike(twice))


def file_name(title: Column, fallback: Column, suffix: str = ".gp5", most: int = 160, unnamed: str = "score") -> Column:
    """A file name from a title: no control or path characters, at most ``most`` bytes, no reserved device names."""
    own = F.regexp_replace(title, r"(?U)^\s+|\s+$", "")
    base = F.when(F.coalesce(own, F.lit("")).isin("") | F.lower(own).isin("untitled", "未命名乐谱"), F.regexp_replace(fallback, r"\.[^.]*$", "")).otherwise(own)
    name = F.regexp_replace(F.regexp_replace(base, r'[\p{Cc}<>:"/\\|?*]', "_"), "^[ .]+|[ .]+$", "")
    name = F.regexp_replace(name, rf"(?i){suffix.replace('.', '[.]')}$", "")
    bytes_ = F.transform(F.sequence(F.lit(1), F.char_length(name)), lambda i: F.octet_length(F.substr(name, F.lit(1), i)))
    fits = F.when(F.octet_length(name) <= most, name).otherwise(F.substr(name, F.lit(1), F.size(F.filter(bytes_, lambda n: n <= most))))
    fits = F.regexp_replace(fits, "[ .]+$", "")
    fits = F.when(F.coalesce(fits, F.lit("")) == "", unnamed).otherwise(fits)
    reserved = F.upper(F.split_part(fits, F.lit("."), F.lit(1))).rlike("^(?:CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])$")
    return F.concat(F.when(reserved, "_").otherwise(""), fits, F.lit(suffix))
