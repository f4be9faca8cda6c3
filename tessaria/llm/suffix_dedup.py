"""Suffix-array dedup: remove every byte of a 100-byte string that also starts earlier.

Equal strings must meet in one place before suffixes can be sorted apart.  A
string's anchor is the leftmost of its 32-byte substrings with the smallest
hash; equal strings have equal anchors at equal offsets, so the anchors deal
the suffixes out without loss: all starts of a document that share an anchor
occurrence are one interval, and an interval with the bytes it reaches is a
context.  Contexts that are equal by two 64-bit hashes are told by their
first occurrence.  Where one anchor has several distinct contexts, starts whose
string's hash occurs once have no equal, and runs of the others that are equal
byte for byte are folded into the earliest.  The suffixes of what is left are
ordered by the difference-cover algorithm (sampled triples are sorted and
named, names recursed on, the remaining suffixes merged in), and neighbours
with equal 100-byte prefixes are found by comparing adjacent prefixes.

Equal contexts are folded within each batch before the shuffle, so a passage
held by a third of the corpus is one row a batch there, and the sorted stream
of an anchor is never held whole.  Anchors with more than ``MOST`` distinct
contexts are told start by start on hashes of their strings instead, with
map-side aggregation.  Each text is shuffled twice, by ``doc_id``.

Defined cases: null and empty texts have no bytes; texts under 100 bytes keep
them; rows that share a ``doc_id`` are one document, none earlier than the
other; rows with null ``doc_id`` are left whole and are nobody's earlier
occurrence; ids are integers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BIN, INT, LONG, materialize, read_table, schema
from .textcore import _BYTES, U, _powers, as_bytes, mix

LENGTH, ANCHOR = 100, 32
#: Distinct contexts of one anchor that are sorted together.
MOST = 4096
#: Bytes whose suffixes one call orders.
SORT = 1 << 20
#: Bytes whose anchors one call finds, starts of one text among them, and bits for a place among those.
BLOCK, PIECE, PLACE = 1 << 16, 1 << 21, 22


# --- difference cover ---------------------------------------------------------


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffix array of non-negative integers by the difference cover {1, 2} modulo 3."""
    n = len(s)
    if n < 8:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), dtype=np.int64)
    _, s = np.unique(s, return_inverse=True)
    t = np.concatenate((s.astype(np.int64) + 1, np.zeros(3, np.int64)))
    one, two = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.concatenate((one, two))
    order = np.lexsort((t[sample + 2], t[sample + 1], t[sample]))
    at = sample[order]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (t[at[1:]] != t[at[:-1]]) | (t[at[1:] + 1] != t[at[:-1] + 1]) | (t[at[1:] + 2] != t[at[:-1] + 2])
    names = np.empty(len(sample), dtype=np.int64)
    names[order] = np.cumsum(new)
    if not new.all():
        order = suffix_array(names)
        names[order] = np.arange(1, len(order) + 1)
    rank = np.zeros(n + 3, dtype=np.int64)
    rank[sample] = names
    by_rank = sample[order]
    by_rank = by_rank[by_rank < n]
    zero = np.arange(0, n, 3)
    zero = zero[np.lexsort((rank[zero + 1], t[zero]))]
    # Merge: how many sampled suffixes of either residue lie before each of the others.
    top = np.int64(n + 3)
    first, second = by_rank[by_rank % 3 == 1], by_rank[by_rank % 3 == 2]
    below = np.searchsorted(t[first] * top + rank[first + 1], t[zero] * top + rank[zero + 1])
    pair = np.unique(np.concatenate((t[second] * top + t[second + 1], t[zero] * top + t[zero + 1])), return_inverse=True)[1]
    below += np.searchsorted(pair[: len(second)] * top + rank[second + 2], pair[len(second) :] * top + rank[zero + 2])
    out = np.empty(n, dtype=np.int64)
    place = np.arange(len(zero)) + below
    out[place] = zero
    free = np.ones(n, dtype=bool)
    free[place] = False
    out[free] = by_rank
    return out


def equal_prefixes(contexts: list[bytes], starts: list[int], length: int = LENGTH) -> list[np.ndarray]:
    """Groups of places with equal ``length``-byte strings; context k has valid starts 0..starts[k]-1.

    Places count through the contexts laid end to end, each with one separator.
    """
    size = np.array([len(c) for c in contexts])
    edge = np.concatenate(([0], np.cumsum(size + 1)))
    text = np.full(edge[-1], 0, dtype=np.int64)
    valid = np.zeros(edge[-1], dtype=bool)
    for k, c in enumerate(contexts):
        text[edge[k] : edge[k] + len(c)] = np.frombuffer(c, dtype=np.uint8)
        text[edge[k] + len(c)] = 256 + k
        valid[edge[k] : edge[k] + starts[k]] = True
    sa = suffix_array(text)
    sa = sa[valid[sa]]
    if len(sa) < 2:
        return []
    view = np.lib.stride_tricks.sliding_window_view(text.astype(np.int32), length)
    same = np.zeros(len(sa), dtype=bool)
    for i in range(1, len(sa), 1 << 14):
        j = min(i + (1 << 14), len(sa))
        same[i:j] = (view[sa[i:j]] == view[sa[i - 1 : j - 1]]).all(axis=1)
    group = np.cumsum(~same)
    order = np.flatnonzero(same)
    if not len(order):
        return []
    wanted = np.unique(group[order])
    lo, hi = np.searchsorted(group, wanted), np.searchsorted(group, wanted, side="right")
    return [sa[a:b] for a, b in zip(lo.tolist(), hi.tolist())]


# --- anchors -------------------------------------------------------------------


def _sums(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of the bytes' terms, and what brings a difference of two to its start."""
    pw, iv = _powers(len(buf) + 1)
    c = np.zeros(len(buf) + 1, dtype=U)
    np.cumsum(_BYTES[buf] * pw[: len(buf)], out=c[1:])
    return c, iv


def _hasher(buf: np.ndarray):
    c, iv = _sums(buf)
    return lambda s, e: mix((c[e] - c[s]) * iv[s] + (e - s).astype(U) * U(0x9E3779B97F4A7C15))


def intervals(texts: list[bytes], length: int = LENGTH, anchor: int = ANCHOR) -> list[np.ndarray]:
    """(text, first start, last start, anchor hash, context hash) of the runs of starts that share an anchor occurrence.

    A text of over ``PIECE`` starts is taken in pieces; a run that crosses from one to the next is two.
    """
    z = np.zeros(0, np.int64)
    out, held, size = [(z,) * 5], [], 0
    for k, data in enumerate(texts):
        for i in range(0, len(data) - length + 1, PIECE):
            held.append((k, i, data[i : i + PIECE + length - 1]))
            size += len(held[-1][2])
            if size >= BLOCK:
                out.append(_laid(held, length, anchor))
                held, size = [], 0
    if held:
        out.append(_laid(held, length, anchor))
    return [np.concatenate(x) for x in zip(*out)]


def _laid(pieces: list[tuple[int, int, bytes]], length: int, anchor: int) -> tuple[np.ndarray, ...]:
    """``intervals`` of (text, its start, bytes), laid end to end; each has ``length`` bytes, all have under ``1 << PLACE``."""
    text, base, data = zip(*pieces)
    size = np.array([len(x) for x in data])
    edge = np.cumsum(size) - size
    buf = np.frombuffer(b"".join(data), dtype=np.uint8)
    n = len(buf)
    c, iv = _sums(buf)
    h = mix((c[anchor:] - c[:-anchor]) * iv[: n - anchor + 1])
    # The least of hash and place is the leftmost of the least hashes; as many bits of the hash count in every text.
    best, w, width = h >> U(PLACE) << U(PLACE) | np.arange(len(h), dtype=U), 1, length - anchor + 1
    while w < width:
        step = min(w, width - w)
        best = np.minimum(best[: len(best) - step], best[step:])
        w += step
    head = np.ones(len(best) + 1, dtype=bool)  # starts too near to a piece's end are runs of no piece
    head[1:-1] = best[1:] != best[:-1]
    head[edge] = head[edge + size - length + 1] = True
    first = np.flatnonzero(head)
    first, last = first[:-1], first[1:] - 1
    k = np.searchsorted(edge, first, side="right") - 1
    own = first - edge[k] <= size[k] - length
    first, last, k = first[own], last[own], k[own]
    place = (best[first] & U((1 << PLACE) - 1)).astype(np.int64)
    context = mix((c[last + length] - c[first]) * iv[first] + (last + length - first).astype(U) * U(0x9E3779B97F4A7C15))
    context ^= mix((place - first).astype(U))
    move = np.array(base)[k] - edge[k]
    return np.array(text)[k], first + move, last + move, h[place].view(np.int64), context.view(np.int64)


_ROW = dict(a=LONG, c=LONG, doc=LONG, l=LONG, r=LONG)


def _anchor_rows(docs: DataFrame) -> DataFrame:
    """(a, c, doc, l, r, later): an interval a row; equal contexts of a batch keep the first, the others are ``later``."""

    def local(batches):
        for whole in batches:
            for i in range(0, whole.num_rows, 2048):
                b = whole.slice(i, 2048)
                k, l, r, a, c = intervals([as_bytes(t) for t in b.column(1).to_pylist()])
                d = b.column(0).to_numpy()[k]
                order = np.argsort(a)
                again = a[order[1:]] == a[order[:-1]]
                some = np.append(again, False) | np.append(False, again) if len(a) else np.zeros(0, bool)
                x = order[some]
                order[some] = x[np.lexsort((l[x], d[x], c[x], a[x]))]
                a, c, d, l, r = (x[order] for x in (a, c, d, l, r))
                same = np.zeros(len(a), dtype=bool)
                same[1:] = (a[1:] == a[:-1]) & (c[1:] == c[:-1])
                if len(a):
                    head = np.flatnonzero(~same)[np.cumsum(~same) - 1]
                    same &= (d != d[head]) | (l != l[head])
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (a, c, d, l, r, same)], [*_ROW, "later"])

    return docs.select(F.col("doc_id").cast("long"), "text").where("doc_id is not null").mapInArrow(local, schema(**_ROW, later=T.BooleanType()))


def _streamed(batches, key: str, handle):
    """Feed tables of whole groups, sorted by ``key``, to ``handle``; only the last group is kept over."""
    rest = None
    for b in batches:
        t = pa.Table.from_batches([b])
        rest = t if rest is None else pa.concat_tables([rest, t]).combine_chunks()
        k = rest.column(key).to_numpy()
        last = int(np.searchsorted(k, k[-1])) if len(k) else 0
        if last:
            yield from handle(rest.slice(0, last))
            rest = rest.slice(last)
    if rest is not None and rest.num_rows:
        yield from handle(rest)


def _told(rows: DataFrame) -> DataFrame:
    """kind 0: starts l..r of doc are removed; kind 1: the first occurrence of one of several contexts of an anchor."""
    names = ["kind", "a", "doc", "l", "r"]

    def local(batches):
        last = None  # the context before, with its first occurrence
        held = None  # a first occurrence not told yet: its anchor may have no other context
        for b in batches:
            a, c, d, l, r = (b.column(i).to_numpy() for i in range(5))
            n = len(a)
            if not n:
                continue
            head = np.ones(n, dtype=bool)
            head[1:] = (a[1:] != a[:-1]) | (c[1:] != c[:-1])
            if last and last[:2] == (a[0], c[0]):
                head[0] = False
            group = np.cumsum(head)
            hd = np.concatenate(([last[2] if last else 0], d[head]))[group]
            hl = np.concatenate(([last[3] if last else 0], l[head]))[group]
            gone = ~head & ((d != hd) | (l != hl))
            # Distinct contexts next to each other with one anchor are both kind 1.
            ia = np.flatnonzero(head)
            fa, fd, fl, fr = a[ia], d[ia], l[ia], r[ia]
            if held is not None:
                fa, fd, fl, fr = (np.concatenate(([x], y)) for x, y in zip(held[:4], (fa, fd, fl, fr)))
            known = bool(held[4]) if held is not None else False
            many = np.zeros(len(fa), dtype=bool)
            eq = fa[1:] == fa[:-1]
            many[1:] |= eq
            many[:-1] |= eq
            if len(fa) and known:
                many[0] = True
            keep = many.copy()
            if len(fa):
                keep[-1] = False
                held = (fa[-1], fd[-1], fl[-1], fr[-1], bool(many[-1]))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate((np.zeros(gone.sum(), np.int32), np.ones(keep.sum(), np.int32)))),
                    *[pa.array(np.concatenate((x[gone], y[keep]))) for x, y in ((a, fa), (d, fd), (l, fl), (r, fr))],
                ],
                names,
            )
            j = n - 1
            last = (a[j], c[j], hd[j] if not head[j] else d[j], hl[j] if not head[j] else l[j])
        if held is not None and held[4]:
            yield pa.RecordBatch.from_arrays([pa.array([1], pa.int32()), *[pa.array([x], pa.int64()) for x in held[:4]]], names)

    rows = rows.repartition("a").sortWithinPartitions("a", "c", "doc", "l")
    return rows.mapInArrow(local, schema(kind=INT, a=LONG, doc=LONG, l=LONG, r=LONG))


def _contexts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(a, doc, l, bytes) of the intervals in ``wanted(a, doc, l, r)``."""
    lists = wanted.groupBy("doc").agg(F.collect_list(F.struct("a", "l", "r")).alias("w"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc"), "text").join(lists.hint("shuffle_hash"), "doc")

    def local(batches):
        for b in batches:
            out = [[], [], [], []]
            for d, t, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                data, s = as_bytes(t), w.values
                for a, l, r in zip(*(s.field(i).to_pylist() for i in range(3))):
                    for o, x in zip(out, (a, d, l, data[l : r + LENGTH])):
                        o.append(x)
            yield pa.RecordBatch.from_arrays([*(pa.array(o, pa.int64()) for o in out[:3]), pa.array(out[3], pa.binary())], ["a", "doc", "l", "data"])

    return rows.select("doc", "text", "w").mapInArrow(local, schema(a=LONG, doc=LONG, l=LONG, data=BIN))


def _recurring(h: np.ndarray) -> np.ndarray:
    """Whether a value is there more than once."""
    order = np.argsort(h)
    same = h[order[1:]] == h[order[:-1]]
    out = np.zeros(len(h), dtype=bool)
    out[order[1:][same]] = out[order[:-1][same]] = True
    return out


def later_starts(doc: np.ndarray, l: np.ndarray, data: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, l, r): starts l..r whose string also starts earlier in another of the contexts, at ``l`` of ``doc`` each.

    Hashes only tell which strings have no equal; the others are compared byte for byte.
    """
    size = np.array([len(x) for x in data])
    text = b"".join(data)
    c, iv = _sums(np.frombuffer(text, dtype=np.uint8))
    starts = size - LENGTH + 1
    k = np.repeat(np.arange(len(data)), starts)
    at = np.arange(len(k)) + np.repeat((LENGTH - 1) * np.arange(len(data)), starts)
    h = (c[at + LENGTH] - c[at]) * iv[at]
    move = l - (np.cumsum(size) - size)
    gone = [(np.zeros(0, np.int64),) * 3]
    while True:
        some = _recurring(h)
        h, k, at = h[some], k[some], at[some]
        if not len(h):
            break
        head = np.ones(len(h), dtype=bool)
        head[1:] = (k[1:] != k[:-1]) | (at[1:] != at[:-1] + 1)
        first = np.flatnonzero(head)
        last = np.append(first[1:], len(h)) - 1
        d, s = doc[k[first]], at[first] + move[k[first]]
        order = np.lexsort((s, d))
        own, seen = np.arange(len(first)), {}
        runs = [text[x:y] for x, y in zip(at[first].tolist(), (at[last] + LENGTH).tolist())]
        for i in order.tolist():
            own[i] = seen.setdefault(runs[i], i)
        kept = own == np.arange(len(own))
        later = (d != d[own]) | (s != s[own])
        gone.append((d[later], s[later], (s + last - first)[later]))
        if kept.all():
            gone.append(_ordered(d, s, runs))
            break
        some = np.repeat(kept, last - first + 1)
        h, k, at = h[some], k[some], at[some]
    return tuple(np.concatenate(x) for x in zip(*gone))


def _ordered(doc: np.ndarray, l: np.ndarray, data: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``later_starts`` by the order of the suffixes."""
    edge = np.concatenate(([0], np.cumsum([len(x) + 1 for x in data])))
    gone = [(np.zeros(0, np.int64),) * 2]
    for g in equal_prefixes(data, [len(x) - LENGTH + 1 for x in data]):
        k = np.searchsorted(edge, g, side="right") - 1
        d, s = doc[k], l[k] + g - edge[k]
        first = np.lexsort((s, d))[0]
        later = (d != d[first]) | (s != s[first])
        gone.append((d[later], s[later]))
    d, s = (np.concatenate(x) for x in zip(*gone))
    order = np.lexsort((s, d))
    d, s = d[order], s[order]
    head = np.ones(len(d), dtype=bool)
    head[1:] = (d[1:] != d[:-1]) | (s[1:] > s[:-1] + 1)
    return d[head], s[head], s[np.append(head[1:], True)[: len(s)]]


def _sorted_out(contexts: DataFrame) -> DataFrame:
    """Starts (doc, l, r) of contexts whose string has an earlier start in another context of the anchor."""

    def handle(t):
        a, doc, l = (t.column(c).to_numpy() for c in ("a", "doc", "l"))
        data = t.column("data").to_pylist()
        cut = np.concatenate(([0], np.flatnonzero(a[1:] != a[:-1]) + 1, [len(a)])).tolist()
        i = 0
        while i < len(cut) - 1:  # whole anchors up to SORT bytes
            j, size = i, 0
            while j < len(cut) - 1 and (j == i or size < SORT):
                size += sum(map(len, data[cut[j] : cut[j + 1]]))
                j += 1
            found = later_starts(doc[cut[i] : cut[j]], l[cut[i] : cut[j]], data[cut[i] : cut[j]])
            if len(found[0]):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["doc", "l", "r"])
            i = j

    rows = contexts.repartition("a").sortWithinPartitions("a")
    return rows.mapInArrow(lambda b: _streamed(b, "a", handle), schema(doc=LONG, l=LONG, r=LONG))


def _start_by_start(contexts: DataFrame) -> DataFrame:
    """The same for anchors with very many contexts: every start by the hashes of its string, summed map-side."""

    def explode(batches):
        for b in batches:
            for i in range(0, b.num_rows, 2048):
                out = []
                for d, l, data in zip(*(b.column(k).slice(i, 2048).to_pylist() for k in (1, 2, 3))):
                    at = np.arange(len(data) - LENGTH + 1)
                    one = _hasher(np.frombuffer(data, dtype=np.uint8))(at, at + LENGTH)
                    two = _hasher(np.frombuffer(data, dtype=np.uint8) ^ np.uint8(0x5A))(at, at + LENGTH)
                    out.append((one.view(np.int64), two.view(np.int64), np.full(len(at), d), at + l))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["h", "g", "doc", "l"])

    rows = contexts.mapInArrow(explode, schema(h=LONG, g=LONG, doc=LONG, l=LONG))
    first = rows.groupBy("h", "g").agg(F.min(F.struct("doc", "l")).alias("f"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return rows.join(first, ["h", "g"]).where(F.struct("doc", "l") > F.col("f")).select("doc", "l", F.col("l").alias("r"))


def removed_starts(docs: DataFrame) -> DataFrame:
    """(doc, l, r): every start l..r whose 100-byte string also starts earlier."""
    rows = materialize(_anchor_rows(docs), "sa-anchors")
    told = materialize(_told(rows.where("not later").drop("later")), "sa-told")
    wanted = told.where("kind = 1").drop("kind")
    sizes = wanted.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    large = materialize(sizes.where(F.col("n") > MOST).select("a"), "sa-large")
    contexts = materialize(_contexts(docs, wanted), "sa-contexts")
    if large.limit(1).count():
        found = _sorted_out(contexts.join(large, "a", "left_anti").select("a", "doc", "l", "data")).union(
            _start_by_start(contexts.join(large, "a", "left_semi").select("a", "doc", "l", "data"))
        )
    else:
        found = _sorted_out(contexts)
    return rows.where("later").select("doc", "l", "r").union(told.where("kind = 0").select("doc", "l", "r")).union(found)


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the kept bytes of every row."""
    gone = removed_starts(docs).groupBy("doc").agg(F.collect_list(F.struct("l", "r")).alias("gone"))
    gone = materialize(gone, "sa-gone").hint("shuffle_hash")
    rows = docs.select("doc_id", "text").join(gone, docs["doc_id"].cast("long") == gone["doc"], "left").select("doc_id", "text", "gone")
    out = T.StructType([docs.schema["doc_id"], *schema(n_bytes=LONG, n_removed=LONG, n_spans=LONG, kept=BIN).fields])

    def local(batches):
        for b in batches:
            cols = [[], [], [], []]
            for t, g in zip(b.column(1).to_pylist(), b.column(2)):
                data = as_bytes(t)
                spans, kept = 0, data
                if g.is_valid and len(data):
                    s = g.values
                    mark = np.zeros(len(data) + 1, dtype=np.int64)
                    np.add.at(mark, s.field(0).to_numpy(), 1)
                    np.add.at(mark, s.field(1).to_numpy() + LENGTH, -1)
                    cover = np.cumsum(mark)[:-1] > 0
                    spans = int(cover[0]) + int((cover[1:] & ~cover[:-1]).sum())
                    kept = np.frombuffer(data, dtype=np.uint8)[~cover].tobytes()
                for c, x in zip(cols, (len(data), len(data) - len(kept), spans, kept)):
                    c.append(x)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.binary())], out.fieldNames())

    return rows.mapInArrow(local, out)


def op5_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    kept = suffix_dedup(read_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
