"""Cross-measure assembly: from what single crops show to what a lane says.

One shuffle on the lane (source, part, staff, mode).  State facts are carried
forward with the window operator; relations are linked, chained and applied by
a fold over the measures of one lane, because a matched predecessor gives its
kind and value to its successor before the next bar is looked at.  Evidence is
never rewritten: results stand beside it, unknown stays NULL with an issue.
"""

from __future__ import annotations

import copy
import json
from collections import Counter, defaultdict

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.measure_text import format_measure, ticks
from ..operators import ordered
from ..operators.folds import per_group

LANE = ["source_id", "part_id", "staff_id", "mode"]
# Kinds of relations and, below, the codes of what keeps them unresolved.
RANGES = ("pm", "let", "ottava")
TECHNIQUES = ("hammer", "sl", "ss")


# --- state -------------------------------------------------------------------


def state_facts(records: DataFrame) -> DataFrame:
    """One row per record and state field: lane, ord, bar_index, field, status, value."""
    rows = records.select(*LANE, "ord", "bar_index", F.explode("observation.state").alias("field", "fact"))
    return rows.select(*LANE, "ord", "bar_index", "field", "fact.status", "fact.value")


def resolved_state(records: DataFrame, fields: list[str]) -> DataFrame:
    """Every record's fields after carry-forward; gaps and duplicate bars end a run, unknown stops inheritance.

    Duplicated bars neither give nor take: each of them is a run of its own.
    """
    spine = records.select(*LANE, "ord", "bar_index", F.explode(F.array(*[F.lit(f) for f in fields])).alias("field"))
    rows = spine.join(state_facts(records).select("ord", "field", "status", "value"), ["ord", "field"], "left")
    keys = [*LANE, "field"]
    same = Window.partitionBy(*keys, "bar_index")
    w = Window.partitionBy(*keys).orderBy("bar_index", "ord")
    rows = rows.withColumn("__n", F.count(F.lit(1)).over(same))
    breaks = (F.col("bar_index") != F.lag("bar_index").over(w) + 1) | (F.col("__n") > 1) | (F.lag("__n").over(w) > 1)
    rows = ordered.islands(rows, keys, ["bar_index", "ord"], breaks, "__run")
    out = ordered.carry_forward(rows, [*keys, "__run"], ["bar_index", "ord"], "status", "value")
    return out.select(*LANE, "ord", "bar_index", "field", "carried_status", "carried_value", (F.col("__n") > 1).alias("duplicate_bar"))


# --- relations of one lane ------------------------------------------------------


class Lane:
    """Measures of a lane in bar order, each {ord, bar, voices, relations}; ``run`` fills resolved, issues and chains."""

    def __init__(self, measures: list[dict]):
        self.measures = measures
        self.nodes: list[dict] = []
        self.after: dict[int, int] = {}
        self.before: dict[int, int] = {}
        for m in measures:
            m["resolved"], m["issues"] = copy.deepcopy(m["voices"]), []

    def event(self, m: dict, path, side: str = "resolved"):
        """The event and note index that a path [voice, event(, note)] names; None if there is no such place."""
        if not isinstance(path, list) or not 2 <= len(path) <= 3:
            return None
        events = next((v.get("events") or [] for v in m[side] if v.get("voice") == path[0]), None)
        if events is None or not 0 <= path[1] < len(events):
            return None
        if len(path) == 3 and not 0 <= path[2] < len(events[path[1]].get("notes") or []):
            return None
        return events[path[1]]

    def note(self, m: dict, path):
        e = self.event(m, path)
        return e["notes"][path[2]] if e is not None and len(path) == 3 else None

    @staticmethod
    def voice(r: dict):
        named = {p[0] for p in (r.get("start"), r.get("end")) if isinstance(p, list) and p}
        if r.get("voice") is not None:
            named.add(int(r["voice"]))
        return named.pop() if len(named) == 1 else None

    def issue(self, at: int, reason: str, **detail) -> None:
        row = {"reason": reason, **detail}
        if row not in self.measures[at]["issues"]:
            self.measures[at]["issues"].append(row)

    def run(self) -> None:
        bars = [m["bar"] for m in self.measures]
        times = Counter(bars)
        self.next = {i: i + 1 for i in range(len(bars) - 1) if bars[i + 1] == bars[i] + 1 and times[bars[i]] == times[bars[i + 1]] == 1}
        for i, m in enumerate(self.measures):
            for k, r in enumerate(m["relations"]):
                if any(isinstance(r.get(s), list) and self.event(m, r[s], "voices") is None for s in ("start", "end")):
                    self.issue(i, "invalid_relation_pointer", relation=k)
                    continue
                self.nodes.append({"at": i, "rel": k, **r})
        self.out, self.into = defaultdict(list), defaultdict(list)
        for n, r in enumerate(self.nodes):
            if r.get("end") == "right":
                self.out[r["at"]].append(n)
            if r.get("start") == "left":
                self.into[r["at"]].append(n)
        for i in range(len(self.measures)):
            if i in self.next:
                self.link(i, self.next[i])
        self.chains = [self.chain(n) for n in range(len(self.nodes)) if n not in self.before]
        for c in self.chains:
            self.finish(c)
        for c in sorted(self.chains, key=lambda c: (c["segments"][0]["at"], json.dumps(c["start"]))):
            self.apply(c)

    def link(self, i: int, j: int) -> None:
        out, into = self.out[i], self.into[j]

        def fits(a: dict, b: dict) -> bool:
            if a.get("kind") and b.get("kind") and a["kind"] != b["kind"]:
                return False
            curve = {"sl": "curve", "ss": "curve"}
            if a.get("shape") and b.get("shape") and a["shape"] != b["shape"]:
                kind = a.get("kind") or b.get("kind")
                if not (curve.get(kind) and {a["shape"], b["shape"]} == {"curve", "diagonal"}):
                    return False
            if any(a.get(f) is not None and b.get(f) is not None and a[f] != b[f] for f in ("value", "representation")):
                return False
            x, y = self.voice(a), self.voice(b)
            return x is None or y is None or x == y

        pairs = [(a, b) for a in out for b in into if fits(self.nodes[a], self.nodes[b])]
        left, right = (Counter(p[k] for p in pairs) for k in (0, 1))
        sure = [(a, b) for a, b in pairs if left[a] == right[b] == 1]
        # Parallel ranges that are left over: equally many on both sides, in the order of their lanes.
        left, right = ([n for n in side if n not in {x for p in sure for x in p} and self.nodes[n].get("lane") is not None] for side in (out, into))
        page = lambda m: (m.get("page"), m.get("system"))
        if len(left) == len(right) > 1 and page(self.measures[i]) == page(self.measures[j]):
            lanes = [[float(self.nodes[n]["lane"]) for n in side] for side in (left, right)]
            if all(len(set(x)) == len(x) for x in lanes):
                key = lambda n: float(self.nodes[n]["lane"])
                zipped = list(zip(sorted(left, key=key), sorted(right, key=key)))
                if all(fits(self.nodes[a], self.nodes[b]) for a, b in zipped):
                    sure += zipped
        for a, b in sure:
            self.after[a], self.before[b] = b, a
            for f in ("kind", "value"):
                if self.nodes[b].get(f) is None:
                    self.nodes[b][f] = self.nodes[a].get(f)

    def chain(self, n: int) -> dict:
        path = [n]
        while path[-1] in self.after:
            path.append(self.after[path[-1]])
        rows = [self.nodes[k] for k in path]
        kinds = {r["kind"] for r in rows if r.get("kind")}
        first, last = rows[0], rows[-1]
        return {
            "kind": kinds.pop() if len(kinds) == 1 else None,
            "start": [first["at"], *first["start"]] if isinstance(first.get("start"), list) else None,
            "end": [last["at"], *last["end"]] if isinstance(last.get("end"), list) else None,
            "segments": rows,
            "reason": None,
        }

    def finish(self, c: dict) -> None:
        """A slide that runs off its bar ends on the only note that starts the next one."""
        if c["kind"] in ("sl", "ss") and c["start"] and not c["end"]:
            last = c["segments"][-1]
            j = self.next.get(last["at"])
            if last.get("end") == "right" and j is not None:
                found = [
                    [j, v["voice"], 0, k]
                    for v in self.measures[j]["resolved"]
                    if self.voice(last) in (None, v["voice"]) and v.get("events")
                    for k, n in enumerate(v["events"][0].get("notes") or [])
                    if n.get("string") == (self.note(self.measures[c["start"][0]], c["start"][1:]) or {}).get("string")
                ]
                if len(found) == 1:
                    c["end"], c["reason"] = found[0], "unique_adjacent_visible_note"
        done = c["start"] and c["end"]
        c["status"] = "unknown" if c["kind"] is None else "resolved" if done or c["kind"] in RANGES and c["start"] and len(c["segments"]) > 1 else "open"

    def apply(self, c: dict) -> None:
        kind, at = c["kind"], c["segments"][0]["at"]
        c["coverage"] = []
        if kind is None:
            self.issue(at, "unknown_relation_kind")
            return
        if kind in RANGES:
            self.cover(c)
            return
        if c["status"] != "resolved":
            self.issue(at, f"{kind}_unresolved")
            return
        source, target = (self.note(self.measures[p[0]], p[1:]) for p in (c["start"], c["end"]))
        if source is None or target is None:
            self.fail(c, at, f"{kind}_endpoint_not_a_note")
        elif kind == "tie":
            if source.get("fret") is None:
                self.fail(c, at, "tie_value_unresolved")
            elif target.get("fret") is None or target["fret"] == source["fret"] and target.get("string") in (None, source.get("string")):
                target["string"], target["fret"] = source.get("string"), source["fret"]
                target.setdefault("effects", []).append("tie")
            else:
                self.fail(c, c["end"][0], "tie_endpoint_conflict")
        elif kind in TECHNIQUES:
            if source.get("fret") is None or target.get("fret") is None:
                self.fail(c, at, f"{kind}_value_unresolved")
            else:
                source.setdefault("effects", []).append(kind)

    def fail(self, c: dict, at: int, reason: str) -> None:
        """A relation whose endpoints are known but whose values do not let it hold."""
        c["status"], c["reason"] = "unresolved", reason
        self.issue(at, reason)

    def cover(self, c: dict) -> None:
        """The events from the first endpoint to the last, over whole bars between; a bare label covers its own event."""
        for r in c["segments"]:
            m = self.measures[r["at"]]
            for v in m["resolved"]:
                if self.voice(r) not in (None, v["voice"]) or self.voice(r) is None and len(m["resolved"]) > 1:
                    continue
                lo = r["start"][1] if isinstance(r.get("start"), list) else 0 if r.get("start") == "left" else None
                hi = r["end"][1] if isinstance(r.get("end"), list) else len(v["events"]) - 1 if r.get("end") == "right" else lo
                if lo is None:
                    self.issue(r["at"], f"{c['kind']}_extent_unresolved")
                    continue
                for k in range(lo, hi + 1):
                    c["coverage"].append([r["at"], v["voice"], k])
                    for n in v["events"][k].get("notes") or []:
                        if c["kind"] not in n.setdefault("effects", []):
                            n["effects"].append(c["kind"])


def measure_ir(m: dict) -> str | None:
    """Measure text of resolved voices; NULL where anything in it is not known."""
    voices = []
    for v in m["resolved"]:
        events = []
        for e in v.get("events") or []:
            if e.get("start") is None or e.get("duration") is None or ticks(e["duration"]) is None or e.get("status") is None:
                return None
            notes = []
            for n in e.get("notes") or []:
                if n.get("string") is None or n.get("fret") is None:
                    return None
                notes.append({"string": int(n["string"]), "fret": str(n["fret"]), "pitch": None, "effects": n.get("effects") or []})
            events.append({"start": str(e["start"]), "duration": e["duration"], "status": e["status"], "notes": notes, "effects": e.get("effects") or []})
        voices.append({"voice": v["voice"], "events": events})
    meta = {"time": m["time"]} if m.get("time") else {}
    return format_measure({"meta": meta, "voices": voices})


def assemble_lane(measures: list[dict]) -> Lane:
    lane = Lane(measures)
    lane.run()
    for i, m in enumerate(measures):
        m["ir"] = measure_ir(m)
        if m["ir"] is None:
            lane.issue(i, "incomplete_measure")
    return lane


def _lanes(records: DataFrame) -> DataFrame:
    """Records with the time signature that their lane's state gives them."""
    doc = F.from_json("observation", "struct<state:map<string,struct<status:string,value:string>>>")
    typed = records.withColumn("observation", doc)
    time = resolved_state(typed, ["time"]).select("ord", F.when(F.col("carried_status").isin("observed", "inherited"), F.col("carried_value")).alias("time"))
    rows = records.join(time, "ord")
    return rows.select(*[F.col(k).cast("string").alias(k) for k in LANE], "ord", "bar_index", "page", "system_index", "time", "observation")


def _assembled(g) -> Lane:
    measures = []
    for i in sorted(range(len(g["ord"])), key=lambda i: (g["bar_index"][i], g["ord"][i])):
        o = json.loads(g["observation"][i]) if g["observation"][i] else {}
        measures.append(
            {
                "ord": int(g["ord"][i]),
                "bar": int(g["bar_index"][i]),
                "page": g["page"][i],
                "system": g["system_index"][i],
                "time": g["time"][i] if isinstance(g["time"][i], str) else None,
                "voices": o.get("voices") or [],
                "relations": o.get("relations") or [],
            }
        )
    return assemble_lane(measures)


def assemble(records: DataFrame) -> DataFrame:
    """Records (with ``ord`` and the observation as JSON) to ord, resolved, issues and ir, a row a record.

    A lane is held whole by one task: it is one staff of one score.  Its state
    is carried by windows; only relations need the fold.
    """

    def one(g):
        head = [g[k][0] for k in LANE]
        return [(*head, m["ord"], json.dumps(m["resolved"]), json.dumps(m["issues"]), m["ir"]) for m in _assembled(g).measures]

    kinds = ", ".join(f"{k} string" for k in LANE) + ", ord bigint, resolved string, issues string, ir string"
    return per_group(_lanes(records), LANE, one, kinds)


def relations(records: DataFrame) -> DataFrame:
    """The chains of all lanes, a row a chain: kind, value, start, end, segments, coverage, status, reason.

    Places are JSON lists that begin with the record's ``ord``; a segment is [ord, place of the relation in its record].
    """

    def one(g):
        lane = _assembled(g)
        ords = [m["ord"] for m in lane.measures]
        place = lambda p: None if p is None else json.dumps([ords[p[0]], *p[1:]])
        head, out = [g[k][0] for k in LANE], []
        for c in lane.chains:
            values = {json.dumps(r["value"]) for r in c["segments"] if r.get("value") is not None}
            segments = json.dumps([[ords[r["at"]], r["rel"]] for r in c["segments"]])
            coverage = json.dumps([[ords[p[0]], *p[1:]] for p in c["coverage"]])
            value = values.pop() if len(values) == 1 else None
            out.append((*head, c["kind"], value, place(c["start"]), place(c["end"]), segments, coverage, c["status"], c["reason"]))
        return out

    names = [*LANE, "kind", "value", "start", "end", "segments", "coverage", "status", "reason"]
    return per_group(_lanes(records), LANE, one, ", ".join(f"`{k}` string" for k in names))
