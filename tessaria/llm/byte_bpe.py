"""Byte-level BPE encoding and decoding.

Encoding: texts are cut into pieces as the tokenizer's pattern does, and the
merges of distinct pieces are folded by Spark higher-order functions over their
byte arrays against a literal rank map (an array addressed by a hash of two
tokens, folded into one literal by Catalyst).  Pieces that are frequent in a
bounded sample of documents (at most ``FREQUENT``, folded once) are broadcast:
they spare work and shape no result.  All other pieces of a chunk of documents
are sent to the piece's task, where each is folded once for all chunks, and
their ids are sent back.  Chunks themselves are shuffled once, as numbers of
their pieces; the rare pieces are read from the same shuffle.  Decoding
concatenates the binary pieces of the ids.

The fold takes quadratic time, so a piece of more than ``WINDOW`` bytes is
folded as overlapping windows.  Two windows are joined where both have a token
boundary followed by the same token: then every two neighbouring tokens of the
result are neighbours in the encoding of some window, so no merge crosses their
boundary, and the result is the encoding of the whole piece.  Where windows
never agree (possible only in periodic runs), the piece's merges are made with
a heap instead.

Defined cases: null or empty text has no tokens and decodes to no bytes;
repeated rows are each encoded; null ids are returned as they are; one
unbroken run of any length is encoded in time proportional to it.  White
space, letters and numbers are those of Unicode's general categories.
"""

from __future__ import annotations

import base64
import functools
import heapq
import json
import pickle
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import BIN, INT, LONG, STR, lean, materialize, read_table, release, release_driver, schema, top_threshold, trim
from .textcore import mix

#: Pieces that are broadcast, at most, and documents (about) in which they are counted; the others are folded by their own tasks.
FREQUENT, SAMPLE = 250_000, 50_000
#: Places in chunks that a row of a folded piece holds, at most.
SENT = 4096
#: Bytes of text that are cut at a time, and that make one chunk of documents.
CUT_BYTES, CHUNK_BYTES = 1 << 20, 8 << 20
#: Bytes of a longer piece that are folded at a time; more than the longest token has.
WINDOW = 512
#: Bits of a token's rank.
BITS = 20

# --- cutting texts into pieces ----------------------------------------------

_WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@functools.cache
def _classes() -> np.ndarray:
    """Code point to 0 other, 1 letter, 2 number, 3 white space."""
    t = np.fromiter(({"L": 1, "N": 2}.get(unicodedata.category(chr(c))[0], 0) for c in range(0x110000)), np.uint8, 0x110000)
    t[_WHITE] = 3
    return t


def _code_points(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes and the place of each one's first byte."""
    at = np.flatnonzero((buf & 0xC0) != 0x80)
    cp = buf[at].astype(np.uint32)
    padded = np.concatenate((buf, np.zeros(3, np.uint8)))
    many = np.flatnonzero(cp >= 0xC0)
    lead, where = cp[many], at[many]
    size = 2 + (lead >= 0xE0) + (lead >= 0xF0)
    value = lead & (0x7F >> size)
    for k in range(1, 4):
        on = size > k
        value[on] = (value[on] << 6) | (padded[where[on] + k] & 0x3F)
    cp[many] = value
    return cp, at


def cut(buf: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Byte starts of the pieces of the texts ``buf[bounds[i]:bounds[i + 1]]``; each ends where the next one starts."""
    if not len(buf):
        return np.zeros(0, np.int64)
    cp, at = _code_points(buf) if buf.max() >= 0x80 else (buf, None)
    n = len(cp)
    kind = _classes()[cp]
    begins = np.zeros(n + 2, dtype=bool)  # a text begins here
    begins[bounds if at is None else np.searchsorted(at, bounds)] = True
    begins[n:] = True
    first = begins[:n].copy()
    first[1:] |= kind[1:] != kind[:-1]
    runs = np.flatnonzero(first)
    ends = np.append(runs[1:], n)
    rk = kind[runs]
    inner = ~begins[ends]  # something of the same text follows
    # A run of white space before something gives its last character away: a blank to what follows, else to itself.
    last = ends[(rk == 3) & inner]
    first[last - 1] = True
    first[last[cp[last - 1] == 0x20]] = False
    # A lone apostrophe that begins a piece takes s, t, m, d, re, ve or ll with it.
    p = runs[(rk == 0) & (ends - runs == 1) & inner]
    p = p[(cp[p] == 0x27) & first[p]]
    if len(p):
        one = cp[p + 1]
        two = np.where(begins[p + 2], 0, cp[np.minimum(p + 2, n - 1)])
        size = np.isin(one, [ord(c) for c in "stmd"]).astype(np.int64)
        for a, b in ("re", "ve", "ll"):
            size[(one == ord(a)) & (two == ord(b))] = 2
        p, size = p[size > 0], size[size > 0]
        first[p + 1] = False
        rest = p + 1 + size
        first[rest[rest < n]] = True
    starts = np.flatnonzero(first)
    return starts if at is None else at[starts]


# --- distinct pieces ---------------------------------------------------------

_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)


def _words(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as an overlapping view."""
    padded = np.concatenate((buf, np.zeros(16, np.uint8)))
    return np.ndarray((len(buf) + 8,), "<u8", padded, strides=(1,))


def distinct(buf: np.ndarray, starts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For spans of bytes: a place of each distinct one, its number of occurrences, and which one each span is.

    Spans of up to 7 bytes are their own key.  Longer ones are hashed, and every one is compared with the first of its
    key; if bytes differ, the spans are told apart by their bytes.
    """
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none, none
    view = _words(buf)
    key = view[starts] & _MASK[np.minimum(size, 8)]
    long = np.flatnonzero(size > 7)
    short = size <= 7
    key[short] |= size[short].astype(np.uint64) << np.uint64(56)
    at, have = long, key[long] + size[long].astype(np.uint64)
    off = 8
    while len(at):
        have = mix(have)
        key[at] = have | np.uint64(0xFF << 56)
        more = size[at] > off
        at, have = at[more], have[more]
        have = have ^ (view[starts[at] + off] & _MASK[np.minimum(size[at] - off, 8)])
        off += 8
    order = np.argsort(key)
    key = key[order]
    head = np.ones(len(order), dtype=bool)
    head[1:] = key[1:] != key[:-1]
    del key
    which = np.empty(len(order), dtype=np.int32)
    which[order] = np.cumsum(head, dtype=np.int32) - 1
    heads = np.flatnonzero(head)
    place, n = order[heads], np.diff(np.append(heads, len(order)))
    a, b = long, place[which[long]]
    same = (size[a] == size[b]).all()
    off = 0
    while same and len(a):
        m = _MASK[np.minimum(size[a] - off, 8)]
        same = ((view[starts[a] + off] & m) == (view[starts[b] + off] & m)).all()
        off += 8
        more = size[a] > off
        a, b = a[more], b[more]
    if same:
        return place, n, which
    seen: dict[bytes, int] = {}
    which = np.array([seen.setdefault(buf[s : s + z].tobytes(), len(seen)) for s, z in zip(starts.tolist(), size.tolist())])
    _, place, n = np.unique(which, return_index=True, return_counts=True)
    return place, n, which


def _gather(flat: np.ndarray, offset: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Concatenated ``flat[offset[i] : offset[i] + size[i]]``."""
    total = np.cumsum(size)
    return flat[np.arange(total[-1] if len(total) else 0) - np.repeat(total - size - offset, size)]


def _binaries(buf: np.ndarray, starts: np.ndarray, size: np.ndarray) -> pa.Array:
    """Spans of bytes as a binary column."""
    starts, size = starts.astype(np.int64), size.astype(np.int64)
    offset = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offset.tobytes()), pa.py_buffer(_gather(buf, starts, size).tobytes())])


class Chunk:
    """The pieces of some texts: ``starts`` and ``size`` of all in ``buf``, those of a text behind those before it.

    Pieces of more than WINDOW bytes stand as their windows; ``long`` has the place of the first window, their number
    and the bytes of the piece.  ``count``: pieces and windows of each text.
    """

    def __init__(self, text: pa.StringArray):
        if len(text):
            text = pa.concat_arrays([text, pa.array([], text.type)])  # one array of its own, without an offset
        if text.type != pa.large_binary():
            text = text.cast(pa.large_binary())
        bounds = np.frombuffer(text.buffers()[1], np.int64)[: len(text) + 1] if len(text) else np.zeros(1, np.int64)
        self.buf = np.frombuffer(text.buffers()[2] or b"", np.uint8)[: bounds[-1]] if len(text) else np.zeros(0, np.uint8)
        some, i = [np.zeros(0, np.int64)], 0
        while i < len(text):
            j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + CUT_BYTES, "right")) - 1)
            some.append(cut(self.buf[bounds[i] : bounds[j]], bounds[i:j] - bounds[i]) + bounds[i])
            i = j
        starts = np.concatenate(some)
        size = np.diff(np.append(starts, len(self.buf)))
        count = np.diff(np.searchsorted(starts, bounds))
        self.long = []
        over = np.flatnonzero(size > WINDOW)
        if len(over):
            text_of = np.searchsorted(bounds, starts[over], "right") - 1
            parts, sizes, done, at = [], [], 0, 0
            for p, t in zip(over.tolist(), text_of.tolist()):
                whole = int(size[p])
                windows = np.append(np.arange(0, whole - WINDOW, WINDOW // 2), whole - WINDOW)
                parts += [starts[done:p], starts[p] + windows]
                sizes += [size[done:p], np.full(len(windows), WINDOW)]
                at += p - done
                self.long.append((at, len(windows), whole))
                at += len(windows)
                count[t] += len(windows) - 1
                done = p + 1
            starts, size = np.concatenate([*parts, starts[done:]]), np.concatenate([*sizes, size[done:]])
        self.starts, self.size, self.count = starts.astype(np.int32), size.astype(np.int32), count


def _chunks(column: pa.Array):
    """(from, to) of rows with up to CHUNK_BYTES of text, one row at least."""
    import pyarrow.compute as pc

    total = np.concatenate(([0], np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))))
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(total, total[i] + CHUNK_BYTES, "right")) - 1)
        yield i, j
        i = j


# --- the rank map and the fold ----------------------------------------------


def parse_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return parse_ranks(f.read())


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class RankMap:
    """The ranks of all pairs of tokens whose bytes together are a token, as one literal array without collisions.

    A pair's key goes to slot ``key % spread + shift[key % len(shift)]``, modulo the array's length; an entry holds key
    and rank.  ``single`` has the token of each byte, ``odd`` the tokens that merges do not reach (by their bytes in hex).
    """

    @classmethod
    def shipped(cls, spark, data: bytes) -> RankMap:
        """The map of a file of ranks, made by a task: its tables of Python objects never are on the driver."""
        held = spark.sparkContext.broadcast(data)

        def local(batches):
            for b in batches:
                made = RankMap.made(parse_ranks(held.value))
                sizes = [made.spread, made.n_shifts, made.n_slots, int(made.any_odd)]
                yield pa.RecordBatch.from_arrays([pa.array([made.text]), pa.array([sizes])], ["text", "sizes"])

        out = T.StructType([T.StructField("text", STR), T.StructField("sizes", T.ArrayType(LONG))])
        row = spark.range(1).mapInArrow(lean(local), out).first()
        own = cls.__new__(cls)
        own.text, (own.spread, own.n_shifts, own.n_slots, odd) = row["text"], row["sizes"]
        own.any_odd = bool(odd)
        return own

    @classmethod
    def made(cls, ranks: dict[bytes, int]) -> RankMap:
        if any(bytes([c]) not in ranks for c in range(256)):
            raise ValueError("not every byte is a token")
        if max(ranks.values()) >> BITS:
            raise ValueError(f"a rank has more than {BITS} bits")
        if max(map(len, ranks)) >= WINDOW:
            raise ValueError(f"a token has {WINDOW} bytes or more")
        self = cls.__new__(cls)
        self.single = [ranks[bytes([c])] for c in range(256)]
        pairs = {
            ranks[t[:i]] << BITS | ranks[t[i:]]: r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks
        }
        odd = {t.hex().upper(): r for t, r in ranks.items() if len(t) > 1 and heap_merges(t, ranks) != [r]}
        size = max(len(pairs) * 5 // 4, 16) | 1  # odd, as keys are steps of a power of two
        groups: dict[int, list[int]] = {}
        n_shifts = max(len(pairs) // 2, 1) | 1
        for k in pairs:
            groups.setdefault(k % n_shifts, []).append(k)
        for self.spread in range((1 << 31) - 1, 0, -2):
            self.shift, self.slots = [0] * n_shifts, [-1] * size
            if all(self._place(g, ks, size) for g, ks in sorted(groups.items(), key=lambda x: -len(x[1]))):
                break
        # An empty slot is 0, which differs from every key but 0; that one's slot has another key.
        none = self.shift[0] % size
        for i, k in enumerate(self.slots):
            self.slots[i] = k << BITS | pairs[k] if k >= 0 else 1 << BITS if i == none else 0
        doc = {"single": self.single, "slots": self.slots, "shift": self.shift, "odd": odd}
        self.text, self.n_shifts, self.n_slots, self.any_odd = json.dumps(doc, separators=(",", ":")), n_shifts, size, bool(odd)
        return self

    def _place(self, group: int, keys: list[int], size: int) -> bool:
        at = [k % self.spread for k in keys]
        for shift in range(size):
            slots = {(x + shift) % size for x in at}
            if len(slots) < len(at):
                return False
            if all(self.slots[s] < 0 for s in slots):
                self.shift[group] = shift
                for k, x in zip(keys, at):
                    self.slots[(x + shift) % size] = k
                return True
        return False

    def fold(self, piece: Column) -> Column:
        """array<int>: the ids of one binary piece."""

        def whole(tables: Column) -> Column:
            folded = bpe_fold(piece, tables["single"], lambda key: self._rank(tables, key)).cast("array<int>")
            if not self.any_odd:
                return folded
            return F.coalesce(F.array(F.try_element_at(tables["odd"], F.hex(piece))), folded)

        kind = "struct<single:array<bigint>,slots:array<bigint>,shift:array<int>,odd:map<string,int>>"
        return _let(F.from_json(F.lit(self.text), kind), whole)

    def _rank(self, tables: Column, key: Column) -> Column:
        """The rank of a pair; where it is none, the entry's key differs and gives 2**BITS, above every rank."""
        shift = F.get(tables["shift"], (key % self.n_shifts).cast("int"))
        entry = F.get(tables["slots"], ((key % self.spread + shift) % self.n_slots).cast("int"))
        return F.least(entry.bitwiseXOR(F.shiftleft(key, BITS)), F.lit(1 << BITS).cast("long"))


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def bpe_fold(piece: Column, single: Column, rank) -> Column:
    """array<bigint>: the ids of one binary piece; ``rank(key)`` is 2**BITS where the two tokens of a key (or null) don't merge.

    The state has an entry a token, its id below its rank with the next token,
    and the lowest rank with its leftmost place (from 0).  Each merge filters
    one entry out and transforms two; interpreted slices and concatenations cost more.
    """
    mask, size = (1 << BITS) - 1, F.octet_length(piece)

    def id_of(entry: Column) -> Column:
        return entry.bitwiseAND(mask)

    def entry(a: Column, b: Column) -> Column:
        return _let(F.shiftleft(a, BITS) + b, lambda key: F.shiftleft(rank(key), BITS)) + a

    def state(entries: Column) -> Column:
        lowest = F.array_min(F.transform(entries, lambda x, i: x.bitwiseAND(~mask) + i))
        return F.struct(entries.alias("e"), lowest.alias("m"))

    def merge(now: Column, _) -> Column:
        def at(x: Column) -> Column:
            left = F.filter(now["e"], lambda _, j: j != x["next"])
            first = lambda: entry(x["low"], id_of(F.get(now["e"], x["next"] + 1)))
            return _let(F.transform(left, lambda e, j: F.when(j == x["at"], first()).when(j == x["before"], entry(id_of(e), x["low"])).otherwise(e)), state)

        place = id_of(now["m"]).cast("int")
        where = F.struct(F.shiftright(now["m"], BITS).alias("low"), (place - 1).alias("before"), place.alias("at"), (place + 1).alias("next"))
        return F.when(now["m"] < 1 << (2 * BITS), _let(where, at)).otherwise(now)

    def start(ids: Column) -> Column:
        return _let(F.transform(ids, lambda a, i: entry(a, F.get(ids, i + 1))), state)

    def bytes_of(letters: Column) -> Column:  # a character for each byte
        return F.transform(F.sequence(F.lit(1), size), lambda i: F.get(single, F.ascii(F.substr(letters, i, F.lit(1)))))

    begin = _let(_let(F.decode(piece, "ISO-8859-1"), bytes_of), start)
    return F.aggregate(F.sequence(F.lit(1), size), begin, merge, lambda s: F.transform(s["e"], id_of))


# --- pieces longer than a window ---------------------------------------------


def heap_merges(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one piece by its merges, lowest rank and leftmost first."""
    n = len(piece)
    end = list(range(1, n + 1))  # end of the part that starts here; 0 where none does
    before = list(range(-1, n - 1))
    heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, j, k = heapq.heappop(heap)
        if end[i] != j or j >= n or end[j] != k:
            continue
        end[i], end[j] = k, 0
        if k < n:
            before[k] = i
        for a, b in ((before[i], i), (i, k)):
            if a >= 0 and b < n and (r := ranks.get(piece[a : end[b]])) is not None:
                heapq.heappush(heap, (r, a, b, end[b]))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


def stitch(windows: list[np.ndarray], offset: list[int], size: np.ndarray) -> np.ndarray | None:
    """One encoding of windows that begin at ``offset``; ``size`` is the bytes of each id.  None if two never agree."""
    have = windows[0].astype(np.int64)
    at = np.cumsum(size[have]) - size[have]
    for ids, o in zip(windows[1:], offset[1:]):
        ids = ids.astype(np.int64)
        start = o + np.cumsum(size[ids]) - size[ids]
        i = np.searchsorted(at, start)
        ok = np.flatnonzero((i < len(at)) & (at[np.minimum(i, len(at) - 1)] == start) & (have[np.minimum(i, len(have) - 1)] == ids))
        if not len(ok):
            return None
        k = int(ok[len(ok) // 2])
        have, at = np.concatenate((have[: i[k]], ids[k:])), np.concatenate((at[: i[k]], start[k:]))
    return have


# --- corpus ------------------------------------------------------------------


def count_pieces(docs: DataFrame) -> DataFrame:
    """(piece, n): every distinct piece of the corpus and its occurrences."""

    def local(batches):
        for b in batches:
            for i, j in _chunks(b.column(0)):
                c = Chunk(b.column(0).slice(i, j - i))
                place, n = distinct(c.buf, c.starts, c.size)[:2]
                yield pa.RecordBatch.from_arrays([_binaries(c.buf, c.starts[place], c.size[place]), pa.array(n)], ["piece", "n"])
                trim()

    return docs.select("text").mapInArrow(lean(local), schema(piece=BIN, n=LONG)).groupBy("piece").agg(F.sum("n").alias("n"))


class Frequent:
    """The broadcast encodings: pieces by their bytes, and their ids as one flat array with offsets."""

    def __init__(self, got: pa.Table):
        self.pieces = got.column("piece")
        ids = pa.concat_arrays([*got.column("ids").chunks, pa.array([], got.schema.field("ids").type)])
        self.ids = ids.values.to_numpy().astype(np.uint32)
        self.offset = ids.offsets.to_numpy().astype(np.int64)

    @functools.cached_property
    def place(self) -> dict[bytes, int]:
        return {p: i for i, p in enumerate(self.pieces.to_pylist())}


@functools.lru_cache(1)
def _pieces(data: bytes) -> list[bytes]:
    """The bytes of each id of a file of ranks."""
    ranks = parse_ranks(data)
    out = [b""] * (max(ranks.values(), default=-1) + 1)
    for k, v in ranks.items():
        out[v] = k
    return out


def _packed(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(data).read_next_batch()


def _planes(a: np.ndarray) -> bytes:
    """Small integers, compressed byte by byte."""
    raw = np.ascontiguousarray(a.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes()
    return pa.compress(raw, codec="zstd", asbytes=True)


def _unplaned(data: bytes, n: int) -> np.ndarray:
    raw = np.frombuffer(pa.decompress(data, 4 * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, n).T).view("<u4").ravel()


def encode(docs: DataFrame, path: str | None = None, keys: tuple[str, ...] = ("doc_id",), decoded: bool = False) -> DataFrame:
    """``keys`` and ``ids`` (binary, little-endian unsigned 32-bit), one row per row of ``docs``.

    With ``decoded`` also ``data``, the bytes that the ids stand for: the same
    as :func:`decode`, without another round of Python workers.
    """
    spark = docs.sparkSession
    release(spark)
    with open(path or default_path(), "rb") as f:
        data = f.read()
    table = RankMap.shipped(spark, data)
    total = docs.count()
    some = docs.sample(SAMPLE / total, seed=1) if total > SAMPLE else docs
    counts = materialize(count_pieces(some), "bpe-pieces")
    least = top_threshold(counts, "n", FREQUENT)
    top = counts.where(F.col("n") >= least).repartition(spark.sparkContext.defaultParallelism)
    held = spark.sparkContext.broadcast(Frequent(top.select("piece", table.fold(F.col("piece")).alias("ids")).toArrow()))  # at most FREQUENT rows
    key_fields = [docs.schema[k] for k in keys]
    n_keys = len(keys)
    names = [f"k{k}" for k in range(n_keys)]
    tokens = spark.sparkContext.broadcast(data)
    out = T.StructType([*key_fields, T.StructField("ids", BIN), *([T.StructField("data", BIN)] if decoded else [])])

    def split(batches):
        """A row per chunk.  Its pieces are places in the frequent table or, below 0, in its own list of rare ones."""
        known, chunk = held.value.place, TaskContext.get().partitionId() << 32
        for whole in batches:
            for i, j in _chunks(whole.column(n_keys)):
                b = whole.slice(i, j - i)
                c = Chunk(b.column(n_keys))
                place, n, which = distinct(c.buf, c.starts, c.size)
                order = np.lexsort((place, -n))  # frequent ones get small numbers, which compress best; then the single ones as they come
                place, number, many = place[order], np.empty(len(order), np.int32), int((n > 1).sum())
                number[order] = np.arange(1, len(order) + 1)
                number[number > many] = 0
                pieces = _binaries(c.buf, c.starts[place], c.size[place])
                code = np.array([known.get(p, -1) for p in pieces.to_pylist()], dtype=np.int32)
                rare = np.flatnonzero(code < 0)
                code[rare] = -1 - np.arange(len(rare))
                of_texts = pa.RecordBatch.from_arrays([*b.columns[:n_keys], pa.array(c.count)], [*names, "count"])
                of_rare = pa.RecordBatch.from_arrays([pieces.take(pa.array(rare))], ["piece"])
                del pieces, order, place
                body = (_packed(of_texts), len(which), many, _planes(number[which]), _planes(code), c.long, _packed(of_rare))
                del c, which, of_rare
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([pickle.dumps(body)], pa.binary())], ["chunk", "body"])
                chunk += 1
                trim()

    def wanted(batches):
        for b in batches:
            for chunk, body in zip(b.column(0).to_pylist(), b.column(1)):
                rare = _unpacked(pickle.loads(body.as_buffer())[-1]).column(0)
                at = np.arange(len(rare), dtype=np.int32)
                yield pa.RecordBatch.from_arrays([rare, pa.array(np.full(len(rare), chunk)), pa.array(at)], ["piece", "chunk", "i"])

    def gathered(batches):
        """Sorted (piece, chunk, i) to a row a piece with up to SENT places in chunks."""
        for b in batches:
            kept, size = _runs(b.column(0))
            parts = np.concatenate([np.append(np.arange(0, n, SENT)[1:], n) + e - n for n, e in zip(size.tolist(), np.cumsum(size).tolist())]) if (size > SENT).any() else np.cumsum(size)
            first = np.concatenate(([0], parts[:-1]))
            at = pa.StructArray.from_arrays([b.column(1), b.column(2)], ["chunk", "i"])
            lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(at)), pa.int32()), at)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(first)), lists], ["piece", "at"])

    def join(_, left, right):
        known, token = held.value, _pieces(tokens.value)
        trim()
        parts = [_texts_of(pickle.loads(body.as_buffer()), right, known, token, n_keys, decoded) for body in left.column("body")]
        return pa.concat_tables([pa.Table.from_arrays(p, out.fieldNames()) for p in parts]) if parts else to_arrow_schema(out).empty_table()

    release_driver(spark)  # the last query's plans hold the rank map as text
    chunks = docs.select(*keys, "text").mapInArrow(lean(split), schema(chunk=LONG, body=BIN)).repartition("chunk")
    rare = chunks.mapInArrow(lean(wanted), schema(piece=BIN, chunk=LONG, i=INT)).repartition("piece").sortWithinPartitions("piece")
    rare = rare.mapInArrow(lean(gathered), T.StructType([T.StructField("piece", BIN), T.StructField("at", T.ArrayType(schema(chunk=LONG, i=INT)))]))
    rare = rare.select(table.fold(F.col("piece")).alias("ids"), "at").select("ids", F.explode("at").alias("at")).select("at.chunk", "at.i", "ids")
    return chunks.groupBy("chunk").cogroup(rare.groupBy("chunk")).applyInArrow(join, out)


def _runs(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Of a sorted column, the first place and the length of each run of equal values."""
    import pyarrow.compute as pc

    if not len(column):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.ones(len(column), dtype=bool)
    new[1:] = pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False)
    first = np.flatnonzero(new)
    return first, np.diff(np.append(first, len(column)))


def _texts_of(body: tuple, rare: pa.Table, known: Frequent, token: list[bytes], n_keys: int, decoded: bool) -> list:
    """The keys, ids and decoded bytes of the texts of a chunk, from its numbers and the ids (i, ids) of its rare pieces."""
    of_texts, n, many, planes, code, long, _ = body
    of_texts = _unpacked(of_texts)
    number = _unplaned(planes, n).astype(np.int32) - 1
    single = np.flatnonzero(number < 0)
    number[single] = many + np.arange(len(single), dtype=np.int32)
    code = _unplaned(code, many + len(single)).view(np.int32)
    lists = pa.concat_arrays([*rare.column("ids").chunks, pa.array([], pa.list_(pa.int32()))])
    place = np.empty(rare.num_rows, np.int64)
    place[rare.column("i").to_numpy()] = np.arange(rare.num_rows)
    begin = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy())))
    flat, offset = np.concatenate((known.ids, lists.flatten().to_numpy().astype(np.uint32))), np.concatenate((known.offset, known.offset[-1] + begin[1:]))
    own = code < 0
    code[own] = len(known.offset) - 1 + place[-1 - code[own]]
    at = code[number]
    del number, single
    ends = np.cumsum(of_texts.column(n_keys).to_numpy())
    size, by_bytes, data, ids = np.array([len(x) for x in token]), None, [], []
    get, lost = token.__getitem__, list(long)
    start = 0
    for end in ends.tolist():
        one = at[start:end]
        width = offset[one + 1] - offset[one]
        out = _gather(flat, offset[one], width)
        if lost and lost[0][0] < end:
            edge, parts, done = np.concatenate(([0], np.cumsum(width))), [], 0
            while lost and lost[0][0] < end:
                p, m, whole = lost.pop(0)
                p -= start
                windows = [out[edge[q] : edge[q + 1]] for q in range(p, p + m)]
                where = [*range(0, whole - WINDOW, WINDOW // 2), whole - WINDOW]
                both = stitch(windows, where, size)
                if both is None:
                    bytes_ = [b"".join(map(get, w.tolist())) for w in windows]
                    by_bytes = by_bytes or {t: k for k, t in enumerate(token) if t}
                    both = np.array(heap_merges(b"".join(x[: WINDOW // 2] for x in bytes_[:-1])[: where[-1]] + bytes_[-1], by_bytes))
                parts += [out[done : edge[p]], both.astype(np.uint32)]
                done = edge[p + m]
            out = np.concatenate([*parts, out[done:]])
        ids.append(out.astype("<u4").tobytes())
        if decoded:
            data.append(b"".join(map(get, out.tolist())))
        start = end
    return [*of_texts.columns[:n_keys], pa.array(ids, pa.binary()), *([pa.array(data, pa.binary())] if decoded else [])]


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``encoded`` with ``data``: the bytes of its ``ids``, concatenated piece by piece."""
    with open(path or default_path(), "rb") as f:
        held = encoded.sparkSession.sparkContext.broadcast(f.read())
    at = encoded.columns.index("ids")

    def local(batches):
        get = _pieces(held.value).__getitem__
        for b in batches:
            out = [b"".join(map(get, np.frombuffer(x.as_buffer(), dtype="<u4").tolist())) for x in b.column(at)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], [*b.schema.names, "data"])

    return encoded.mapInArrow(lean(local), T.StructType([*encoded.schema.fields, T.StructField("data", BIN)]))


def digests(encoded: DataFrame, path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """The keys, n_tokens, ids_sha256 and decoded_sha256 of an encoded table."""
    both = encoded if "data" in encoded.columns else decode(encoded, path)
    return both.select(
        *[c for c in encoded.columns if c != "data" and (keep_ids or c != "ids")],
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("data", 256).alias("decoded_sha256"),
    )


def op3_byte_bpe(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return digests(encode(docs, decoded=True))
