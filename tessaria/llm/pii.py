"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds the anchors (at-signs, plus signs,
digits, URL schemes and identifier cues); deterministic local parsers expand
each anchor to its boundaries and validate it.  Work is linear in the text and
local to a row, so nothing is shuffled and no text is cut.

Kinds: email, ip, card and phone as the base rules have them (leftmost, not
overlapping within a kind, a failing match is dropped and its characters are
spent), then account (after a cue, an IBAN by its check digits or a number of 8
to 17 digits), key (a secret after a cue such as ``token =``, ``token is`` or
``Bearer``, or by the form that issuers give it), national (SSN after a cue),
url and address (house number, name and kind of street, town and postcode if
they follow).  Added kinds are leftmost and do not overlap within a kind either.

Defined cases: null and empty texts have no spans; spans are in code points,
end exclusive; spans of different kinds may overlap; repeated rows are each
scanned.
"""

from __future__ import annotations

import functools
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LONG, STR, read_table

BASE = ("email", "ip", "card", "phone")
ADDED = ("account", "key", "national", "url", "address")
KINDS = (*BASE, *ADDED)

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LINK = r"(?:[\s:#.=]|\b(?:number|no|num|nr|is)\b){0,6}"
_IBAN = re.compile(_LINK + r"([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})(?![A-Za-z0-9])", re.I)
_ACCOUNT = re.compile(_LINK + r"([0-9]{8,17})(?![0-9A-Za-z])", re.I)
_KEY = re.compile(r"""["']?(?:\s{0,3}[:=]\s{0,3}|\s{1,3}is\s{1,3}:?\s{0,3})["']?([A-Za-z0-9_\-/+=.]{15,}[A-Za-z0-9_\-/+=])""")
_BEARER = re.compile(r"[ \t]{1,3}([A-Za-z0-9_\-/+=.~]{15,}[A-Za-z0-9_\-/+=~])")
#: What follows the first letters of keys whose issuers give them a form.
_FORMS = {
    "AKIA": re.compile(r"[A-Z0-9]{16}(?![A-Za-z0-9])"),
    "ASIA": re.compile(r"[A-Z0-9]{16}(?![A-Za-z0-9])"),
    "AIza": re.compile(r"[A-Za-z0-9_-]{35}"),
    "ghp_": re.compile(r"[A-Za-z0-9]{36}"),
    "github_pat_": re.compile(r"[A-Za-z0-9_]{22,}"),
    "sk-": re.compile(r"[A-Za-z0-9_-]{20,}"),
    "xoxb-": re.compile(r"[A-Za-z0-9-]{10,}"),
    "xoxp-": re.compile(r"[A-Za-z0-9-]{10,}"),
    "eyJ": re.compile(r"[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    "-----BEGIN ": re.compile(r"[A-Z ]{0,40}PRIVATE KEY-----[A-Za-z0-9+/=\s]*(?:-----END [A-Z ]{0,40}PRIVATE KEY-----)?"),
}
STREETS = ("Street", "Avenue", "Road", "Boulevard", "Lane", "Drive", "Court", "Square", "Highway")
_HOUSE = re.compile(r"(?<![0-9A-Za-z.,-])[0-9]{1,5}[A-Za-z]?(?: [A-Z][A-Za-z'.-]{0,30}){1,4} \Z")
_TOWN = re.compile(r"(?:, (?:Apt|Suite|Unit) [0-9]{1,5}[A-Z]?)?(?:, [A-Z][A-Za-z'-]+(?: [A-Z][A-Za-z'-]+){0,2}(?:,? [A-Z]{2})?(?:,? [0-9]{5}(?:-[0-9]{4})?)?)?(?![0-9A-Za-z])")
_NATIONAL = re.compile(r"[\s:#]{0,3}([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9])")
_URL = re.compile(r"""[^\s<>"'`|{}\\^]+""")

#: Cue words, each looked for in lower, title and upper case.
KEY_CUES = ("token", "secret", "password", "passwd", "passphrase", "api_key", "apikey", "api key", "api-key", "access_key", "access key", "private_key", "credential")
BEARER_CUES = ("bearer",)
ACCOUNT_CUES = ("iban", "account", "acct", "konto", "routing")
NATIONAL_CUES = ("ssn", "social security number")


@functools.cache
def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    a.add_word("@", ("@", 1))
    a.add_word("+", ("+", 1))
    for d in "0123456789":
        a.add_word(d, ("9", 1))
    for scheme in ("://", "www."):
        a.add_word(scheme, ("u", len(scheme)))
    for kind, cues in (("k", KEY_CUES), ("b", BEARER_CUES), ("a", ACCOUNT_CUES), ("n", NATIONAL_CUES)):
        for cue in cues:
            for form in {cue, cue.title(), cue.upper()}:
                a.add_word(form, (kind, len(form)))
    for form in _FORMS:
        a.add_word(form, ("f", len(form)))
    for street in STREETS:
        a.add_word(" " + street, ("s", len(street) + 1))
    a.make_automaton()
    return a


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        if i % 2:
            n = n * 2 - 9 if n > 4 else n * 2
        total += n
    return total % 10 == 0


def _octet(s: str) -> bool:
    s = s.lstrip("0")
    return len(s) < 3 or len(s) == 3 and s <= "255"


def _iban(s: str) -> str | None:
    """The longest valid account number that begins ``s``, as it is written."""
    for end in range(len(s), 14, -1):
        if s[end - 1] == " ":
            continue
        packed = s[:end].replace(" ", "")
        if 15 <= len(packed) <= 34 and int("".join(str(int(c, 36)) for c in packed[4:] + packed[:4])) % 97 == 1:
            return s[:end]
    return None


def spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of a text, by kind as listed in KINDS, then start."""
    if not text:
        return []
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    done = dict.fromkeys(KINDS, 0)
    last_digit = -2
    for at, (kind, size) in _automaton().iter(text):
        if kind == "9":
            new_run, last_digit = at != last_digit + 1, at
            if not new_run:
                continue
            if at >= done["ip"] and (m := _IP.match(text, at)):
                done["ip"] = m.end()
                if all(map(_octet, m.groups())):
                    found["ip"].append(m.span())
            if at >= done["card"] and (m := _CARD.match(text, at)):
                done["card"] = m.end()
                digits = m.group().replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and _luhn(digits):
                    found["card"].append(m.span())
        elif kind == "@":
            start = at
            while start > done["email"] and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                done["email"] = m.end()
                found["email"].append((start, m.end()))
        elif kind == "+":
            if at >= done["phone"] and (m := _PHONE.match(text, at)):
                done["phone"] = m.end()
                if 8 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                    found["phone"].append(m.span())
        elif kind == "u":
            start = at - size + 1
            if text[at] == "/":
                while start > done["url"] and text[start - 1].isascii() and text[start - 1].isalpha():
                    start -= 1
                if text[start : at - 2].lower() not in ("http", "https", "ftp"):
                    continue
            if start >= done["url"] and (m := _URL.match(text, start)):
                end = start + len(m.group().rstrip(".,;:!?)]*#$%&"))
                if "." in text[at + 1 : end].strip("."):
                    done["url"] = end
                    found["url"].append((start, end))
        elif kind == "k":
            if at >= done["key"] and (m := _KEY.match(text, at + 1)):
                done["key"] = m.end()
                found["key"].append(m.span(1))
        elif kind == "b":
            if at >= done["key"] and (m := _BEARER.match(text, at + 1)):
                done["key"] = m.end()
                found["key"].append(m.span(1))
        elif kind == "f":
            start = at - size + 1
            inner = start and text[start - 1].isascii() and text[start - 1].isalnum()
            if start >= done["key"] and not inner and (m := _FORMS[text[start : at + 1]].match(text, at + 1)):
                done["key"] = m.end()
                found["key"].append((start, m.end()))
        elif kind == "a":
            if at >= done["account"] and (m := _IBAN.match(text, at + 1)) and (s := _iban(m.group(1).upper())):
                done["account"] = m.start(1) + len(s)
                found["account"].append((m.start(1), m.start(1) + len(s)))
            elif at >= done["account"] and (m := _ACCOUNT.match(text, at + 1)):
                done["account"] = m.end()
                found["account"].append(m.span(1))
        elif kind == "s":
            if (m := _HOUSE.search(text, max(done["address"], at - size - 130), at - size + 2)) and (t := _TOWN.match(text, at + 1)):
                done["address"] = t.end()
                found["address"].append((m.start(), t.end()))
        elif at >= done["national"] and (m := _NATIONAL.match(text, at + 1)):
            done["national"] = m.end()
            found["national"].append(m.span(1))
    return [(k, *s) for k in KINDS for s in found[k]]


def redact(text: str | None, replace=lambda kind: f"<{kind}>") -> str | None:
    """The text with its spans replaced; overlapping spans are one, named by the first."""
    if not text:
        return text
    out, at = [], 0
    for kind, s, e in sorted(spans(text), key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], replace(kind)]
        at = max(at, e)
    return "".join([*out, text[at:]])


def find_pii(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keys`` and ``__spans``: array of (kind, start, end), one row per row of ``docs``."""
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    item = T.StructType([T.StructField("kind", STR), T.StructField("start", LONG), T.StructField("end", LONG)])
    out = T.StructType([*[docs.schema[k] for k in keys], T.StructField("__spans", T.ArrayType(item))])

    def local(batches):
        for b in batches:
            rows = [[{"kind": k, "start": s, "end": e} for k, s, e in spans(t.as_py())] for t in b.column(len(keys))]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keys)], pa.array(rows, pa.list_(span))], out.fieldNames())

    return docs.select(*keys, "text").mapInArrow(local, out)


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with its texts redacted."""
    at = docs.columns.index("text")

    def local(batches):
        for b in batches:
            yield b.set_column(at, b.schema.field(at), pa.array([redact(t.as_py()) for t in b.column(at)], b.schema.field(at).type))

    return docs.mapInArrow(local, docs.schema)


def op8_pii(spark, sf_dir: str) -> DataFrame:
    found = find_pii(read_table(spark, sf_dir, "documents").select("doc_id", "text"))

    def told(s):
        return F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))

    def joined(rows):
        return F.array_join(F.transform(rows, told), ",")

    def count(kind: str):
        return F.size(F.filter("__spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("__spans", lambda s: s["kind"].isin(*BASE))
    return found.select(
        "doc_id",
        *[count(k) for k in BASE],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined("__spans").alias("spans"),
    )
