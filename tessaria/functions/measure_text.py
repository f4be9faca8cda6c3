"""The one-line measure text: parse to voices and events, format canonically, list errors.

``M time=4/4 | V0{@0:q:s1f5(vib)<pick_down> @960:q:r} || V1{@0:w:p48}``

A small hand parser on Arrow batches; everything after parsing is columns.
"""

from __future__ import annotations

import json
import re
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scalars import VALUES, WHOLE

FIELDS = ("time", "tempo", "key", "section", "bar", "rep", "alt")
_DURATION = re.compile(r"([whqestf])(\.{0,2})(?:\[([1-9][0-9]?):([1-9][0-9]?)\])?")
_NOTE = re.compile(r"(?:s([1-9][0-9]?)f([0-9]{1,2}|x))?(?:p([0-9]{1,3}))?(?:\(([^()]*)\))?")
_EVENT = re.compile(r"@([0-9]+(?:/[0-9]+)?):([^:\s\[]+(?:\[[^\]\s]*\])?):(.+)")
_VOICE = re.compile(r"\s*V([0-9]+)\{([^{}]*)\}\s*")

SCHEMA = (
    "struct<meta:map<string,string>,voices:array<struct<voice:int,events:array<struct<start:string,duration:string,status:string,"
    "notes:array<struct<string:int,fret:string,pitch:int,effects:array<string>>>,effects:array<string>>>>>,errors:array<string>>"
)


def ticks(token: str) -> Fraction | None:
    m = _DURATION.fullmatch(token)
    if not m:
        return None
    dots = len(m[2])
    return Fraction(WHOLE * (2 ** (dots + 1) - 1) * int(m[4] or 1), VALUES[m[1]] * 2**dots * int(m[3] or 1))


def _split(text: str, at: str) -> list[str]:
    """Split outside brackets."""
    out, depth, part = [], 0, ""
    for c in text:
        depth += (c in "(<[") - (c in ")>]")
        if c == at and depth == 0:
            out.append(part)
            part = ""
        else:
            part += c
    return [*out, part]


def _payload(body: str) -> dict | None:
    m = re.fullmatch(r"(.*?)(?:<([^<>]*)>)?", body)
    effects = [e for e in (m[2] or "").split(",") if e]
    if m[1] in ("r", "e", "z"):
        return {"status": {"r": "rest", "e": "empty", "z": "silent"}[m[1]], "notes": [], "effects": effects}
    notes = []
    for token in _split(m[1], ","):
        n = _NOTE.fullmatch(token)
        if not token or not n or not (n[1] or n[3]):
            return None
        notes.append(
            {"string": int(n[1]) if n[1] else None, "fret": n[2], "pitch": int(n[3]) if n[3] else None, "effects": [e for e in (n[4] or "").split(",") if e]}
        )
    return {"status": "normal", "notes": notes, "effects": effects}


def parse(text: str | None) -> dict | None:
    """Meta, voices and the list of errors; None for no text."""
    if text is None:
        return None
    out: dict = {"meta": {}, "voices": [], "errors": []}
    head, _, rest = text.strip().partition("|")
    words = head.split()
    if not words or words[0] != "M":
        return {**out, "errors": ["not_a_measure"]}
    for w in words[1:]:
        k, eq, v = w.partition("=")
        if not eq or k not in FIELDS:
            out["errors"].append("unknown_field")
        else:
            out["meta"][k] = v
    for part in rest.split("||") if rest.strip() else []:
        m = _VOICE.fullmatch(part)
        if not m:
            out["errors"].append("invalid_voice")
            continue
        events, last, end = [], None, Fraction(-1)
        for token in _split(m[2].strip(), " "):
            if not token:
                continue
            e = _EVENT.fullmatch(token)
            if not e:
                out["errors"].append("invalid_event")
                continue
            start = Fraction(e[1])
            if ticks(e[2]) is None:
                out["errors"].append("invalid_duration")
            if start <= end:
                out["errors"].append("non_increasing_event_starts")
            end = start
            body = last if e[3] == "^" else _payload(e[3])
            if body is None:
                out["errors"].append("repeat_without_event" if e[3] == "^" else "invalid_note")
                continue
            strings = [n["string"] for n in body["notes"] if n["string"]]
            if len(set(strings)) < len(strings):
                out["errors"].append("duplicate_string_in_chord")
            last = body
            events.append({"start": str(start), "duration": e[2], **body})
        if any(v["voice"] == int(m[1]) for v in out["voices"]):
            out["errors"].append("duplicate_voice")
        out["voices"].append({"voice": int(m[1]), "events": events})
    out["errors"] = list(dict.fromkeys(out["errors"]))
    return out


def _note(n: dict) -> str:
    place = f"s{n['string']}f{n['fret']}" if n.get("string") else ""
    pitch = f"p{n['pitch']}" if n.get("pitch") is not None else ""
    return place + pitch + (f"({','.join(n['effects'])})" if n.get("effects") else "")


def format_measure(m: dict | None) -> str | None:
    """Canonical text: fields in order, notes by string (then pitch falling), equal payloads as ``^``."""
    if m is None:
        return None
    head = " ".join(["M", *[f"{k}={m['meta'][k]}" for k in FIELDS if k in m["meta"]]])
    voices = []
    for v in m["voices"]:
        events, last = [], None
        for e in v["events"]:
            notes = sorted(e["notes"], key=lambda n: (n.get("string") or 99, -(n.get("pitch") or 0)))
            body = {"rest": "r", "empty": "e", "silent": "z"}.get(e["status"]) or ",".join(map(_note, notes))
            body += f"<{','.join(e['effects'])}>" if e.get("effects") else ""
            events.append(f"@{e['start']}:{e['duration']}:{'^' if body == last else body}")
            last = body
        voices.append(f"V{v['voice']}{{{' '.join(events)}}}")
    return head + (" | " + " || ".join(voices) if voices else "")


@F.pandas_udf(T.StringType())
def _parsed(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else json.dumps(parse(x)))


@F.pandas_udf(T.StringType())
def canonical(s: pd.Series) -> pd.Series:
    """The canonical form of a measure text, NULL where it has errors."""
    return s.map(lambda x: format_measure(m) if (m := parse(x)) and not m["errors"] else None)


def parse_measure(c: Column) -> Column:
    """struct<meta, voices, errors> of a measure text."""
    return F.from_json(_parsed(c), SCHEMA)


def overfull(c: Column) -> Column:
    """Voices of a measure text whose exact length is beyond its time signature (reported, never a fault)."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def over(s: pd.Series) -> pd.Series:
        def one(x):
            m = parse(x)
            sig = re.fullmatch(r"([0-9]+)/([0-9]+)", (m or {}).get("meta", {}).get("time", ""))
            if not sig or int(sig[2]) == 0:
                return []
            bar = Fraction(WHOLE * int(sig[1]), int(sig[2]))
            return [v["voice"] for v in m["voices"] if any(Fraction(e["start"]) + (ticks(e["duration"]) or 0) > bar for e in v["events"])]

        return s.map(one)

    return over(c)
