"""LM scoring with a log-bilinear neural model trained by noise-contrastive estimation.

Spark counts every token of the training documents.  The model's vocabulary is
every word of at least ``LEAST`` occurrences, at most ``VOCAB`` of them, the end
of a text, and one entry for all other words; a word of that entry is scored by
its probability times its smoothed share of it.  Words stand by frequency in a
tree of two levels of classes: a token's probability is that of its first
class, of its second within that, and of the word within that, each a softmax
over about the cube root of the vocabulary by batched matrix products.  So the
score of any text is normalised, whatever the size of the vocabulary.

Words and classes of both levels are trained together by noise-contrastive
estimation in numpy, over every training token.  Documents are dealt into
``ROUNDS`` by a hash.  In each round every partition trains on its documents
from the common parameters, and the changes of each row are averaged over the
partitions that touched it, weighted by its updates there; only rows that were
touched leave a partition, and rows are summed in a shuffle.

Counts of the most frequent words (at most ``FREQUENT``) are broadcast, as are
the parameters (at most 5 MB); all other words of a document leave its task as
(word, times) and meet their counts in a shuffle join, so no text is shuffled
and nothing unbounded is held.

Defined cases: null and empty texts are one end token; null ids count as the
empty string for the split; repeated rows are each counted and scored; with no
training token every probability is that of the unseen word.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BIN, DBL, LONG, lean, materialize, read_table, schema, top_threshold
from .textcore import NOT_SPACE, as_bytes, pick, span_hashes, spans

#: Words of the model at most, and occurrences that make one; dimension, noise words a batch.
VOCAB, LEAST, DIM, NOISE = (1 << 15) - 2, 3, 8, 16
ROUNDS = 2
FREQUENT = 500_000
#: Tokens of a step; rate and first squared gradient of its adaptive ascent.
STEP, RATE, FIRST = 1024, 0.1, 0.01
CHUNK, SCORE_CHUNK, COUNT_CHUNK, BLOCK = 256, 512, 4096, 4096
END, OTHER = 0, 1
FOLDS, HELD_OUT = 5, 1


def remainder(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))


def _cut(text):
    buf = np.frombuffer(as_bytes(text).lower(), dtype=np.uint8)
    return (buf, *spans(buf, NOT_SPACE))


def _chunks(batch, n: int):
    for i in range(0, batch.num_rows, n):
        yield batch.slice(i, n)


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n): all tokens of ``docs``; the end of a text is the empty word."""

    def local(batches):
        for whole in batches:
            for b in _chunks(whole, COUNT_CHUNK):
                cuts = [_cut(t) for t in b.column(0).to_pylist()]
                h = np.concatenate([span_hashes(*c) for c in cuts])
                _, first, n = np.unique(h, return_index=True, return_counts=True)
                words = [*pick(cuts, first), b""]
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array([*n.tolist(), b.num_rows], pa.int64())], ["word", "n"])

    return docs.select("text").mapInArrow(lean(local), schema(word=BIN, n=LONG)).groupBy("word").agg(F.sum("n").alias("n"))


def _hash(words: list[bytes]) -> np.ndarray:
    end = np.cumsum([len(w) for w in words]).astype(np.int64)
    return span_hashes(np.frombuffer(b"".join(words), dtype=np.uint8), end - [len(w) for w in words], end) if words else np.zeros(0, np.uint64)


class Lexicon:
    """Frequent words: sorted hashes, counts, and the model's entry of each (OTHER beyond the vocabulary)."""

    def __init__(self, words: list[bytes], counts: list[int], total: int, distinct: int):
        order = sorted((i for i, w in enumerate(words) if w), key=lambda i: (-counts[i], words[i]))
        klass = np.full(len(words), OTHER, dtype=np.int64)  # the model's entry of each word
        self.vocab = [i for i in order[:VOCAB] if counts[i] >= LEAST]
        klass[self.vocab] = np.arange(2, 2 + len(self.vocab))
        h = _hash(words)
        at = np.argsort(h)
        self.hash, self.count, self.klass = h[at], np.array(counts, dtype=np.int64)[at], klass[at]
        self.total, self.distinct = total, distinct
        self.ends = next((c for w, c in zip(words, counts) if not w), 0)
        known = [counts[i] for i in self.vocab]
        self.other_total = total - sum(known) - self.ends
        self.other_distinct = distinct - len(known) - (self.ends > 0)
        p = np.array([self.ends, self.other_total, *known], dtype=np.float64) + 0.5
        self.unigram = p / p.sum()

    def find(self, h: np.ndarray) -> np.ndarray:
        """Places of hashes, -1 where a word is not frequent."""
        shift, first, ended = self._buckets
        at = first.take(h >> shift).astype(np.int64)
        found = ended.take(at)
        less = np.flatnonzero(found < h)
        while len(less):  # the end is above every hash or equal to it
            at[less] += 1
            found[less] = ended.take(at[less])
            less = less[found[less] < h[less]]
        return np.where((found == h) & (at < len(self.hash)), at, -1)

    @functools.cached_property
    def _buckets(self) -> tuple[np.uint64, np.ndarray, np.ndarray]:
        """Hashes by their leading bits, about a quarter of one a bucket: the shift, each bucket's first place, and the hashes with an end."""
        bits = (4 * len(self.hash) + 1).bit_length()
        shift = np.uint64(64 - bits)
        n = np.bincount((self.hash >> shift).astype(np.int64), minlength=1 << bits)
        return shift, (np.cumsum(n) - n).astype(np.int32), np.append(self.hash, np.uint64((1 << 64) - 1))

    def classes(self, at: np.ndarray) -> np.ndarray:
        return np.where(at < 0, OTHER, self.klass[at]) if len(self.hash) else np.full(len(at), OTHER)


def contexts(lex: Lexicon, places: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries of the tokens of several texts (each with its end), of the word before, and of the one before that."""
    out = np.concatenate([x for p in places for x in (lex.classes(p), [END])]).astype(np.int64)
    size = np.array([len(p) + 1 for p in places])
    start = np.cumsum(size) - size
    one, two = np.roll(out, 1), np.roll(out, 2)
    one[start] = END
    two[start] = END
    two[(start + 1)[size > 1]] = END
    return out, one, two


def _put(x: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    """``x[rows] = values`` with each row moved as one item."""
    item = np.dtype((np.void, x.itemsize * x.shape[1]))
    x.view(item)[:, 0][rows] = np.ascontiguousarray(values, x.dtype).view(item)[:, 0]


class LogBilinear:
    """score(x | u, v) = (R[u] C1 + R[v] C2) . X[x] + c[x], for words x and classes of two levels; a table's last column is c.

    Entry i has the classes i // branch and i // branch**2.
    """

    def __init__(self, unigram: np.ndarray, dim: int = DIM, seed: int = 7):
        rng, v = np.random.default_rng(seed), len(unigram)
        self.branch = max(2, int(np.ceil(np.cbrt(v))))
        self._cumulative = np.cumsum(unigram)
        small = lambda n: rng.normal(0, 0.1, (n, dim)).astype(np.float32)
        self.R, self.C1, self.C2 = small(v), np.eye(dim, dtype=np.float32), np.eye(dim, dtype=np.float32) * np.float32(0.5)
        self.levels = []  # of words, of small classes, of large ones: their table, log noise and width
        for width in (1, self.branch, self.branch**2):
            p = np.add.reduceat(unigram, np.arange(0, v, width))
            noise = np.log(p).astype(np.float32)
            self.levels.append([np.column_stack((small(len(p)), noise)), noise, width])

    def tables(self) -> list[np.ndarray]:
        """All parameters as tables of rows: contexts, words and classes, then both context matrices."""
        return [self.R, *[x for x, *_ in self.levels], self.C1, self.C2]

    def load(self, tables: list[np.ndarray]) -> None:
        self.R, self.C1, self.C2 = tables[0], tables[-2], tables[-1]
        for level, t in zip(self.levels, tables[1:-2]):
            level[0] = t

    def start(self) -> None:
        self._square = [np.full_like(x, FIRST) for x in self.tables()]
        self.updates = [np.zeros(len(x), np.int64) for x in self.tables()[:-2]]

    def _ascend(self, k: int, x: np.ndarray, at: np.ndarray, grad: np.ndarray) -> None:
        """One step of the rows ``at`` (which may repeat) of table ``k``, by the sums of their gradients."""
        square = self._square[k]
        if len(x) <= 64:
            chosen = np.zeros((len(x), len(at)), np.float32)
            chosen[at, np.arange(len(at))] = 1
            g, rows, times = chosen @ grad, slice(None), chosen.sum(1).astype(np.int64)
            square += g * g
            x += np.float32(RATE) * g / np.sqrt(square)
        else:
            order = np.argsort(at.astype(np.uint16) if len(x) <= 1 << 16 else at, kind="stable")  # short integers are sorted by their digits
            at = at[order]
            first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
            g, rows, times = np.add.reduceat(grad.take(order, axis=0), first, axis=0), at[first], np.diff(np.append(first, len(at)))
            s = square.take(rows, axis=0) + g * g
            _put(square, rows, s)
            _put(x, rows, x.take(rows, axis=0) + np.float32(RATE) * g / np.sqrt(s))
        self.updates[k][rows] += times

    def step(self, w, u, v, rng, noise: int = NOISE) -> None:
        """One ascent of the objectives of all levels on a batch, with noise words shared by the batch."""
        n, dim = len(w), self.R.shape[1]
        drawn = np.minimum(np.searchsorted(self._cumulative, rng.random(noise)), len(self.R) - 1)
        ru, rv = self.R.take(u, axis=0), self.R.take(v, axis=0)  # much faster than by brackets
        q = np.ones((n, dim + 1), np.float32)  # the last column takes the biases
        q[:, :dim] = ru @ self.C1 + rv @ self.C2
        scale, shift = np.float32(1 / np.sqrt(n)), np.float32(np.log(noise))
        dq = np.zeros((n, dim + 1), np.float32)
        for i, (x, log_noise, width) in enumerate(self.levels):
            at, other = (w, drawn) if width == 1 else (w // width, drawn // width)
            xa, xo = x.take(at, axis=0), x.take(other, axis=0)
            pos = np.einsum("ij,ij->i", q, xa) - (log_noise[at] + shift)
            np.clip(pos, -30, 30, out=pos)
            pos = scale / (1 + np.exp(pos))  # 1 - sigmoid
            neg = q @ xo.T - (log_noise[other] + shift)
            np.clip(neg, -30, 30, out=neg)
            neg = -scale / (1 + np.exp(-neg))
            dq += pos[:, None] * xa + neg @ xo
            grad = np.empty((n + noise, dim + 1), np.float32)
            np.multiply(pos[:, None], q, out=grad[:n])
            grad[n:] = neg.T @ q
            self._ascend(i + 1, x, np.concatenate((at, other)), grad)
        dq = dq[:, :dim]
        du, dv = dq @ self.C1.T, dq @ self.C2.T
        for k, name, g in ((-2, "C1", ru.T @ dq), (-1, "C2", rv.T @ dq)):
            self._square[k] += g * g
            setattr(self, name, getattr(self, name) + np.float32(RATE) * g / np.sqrt(self._square[k]))
        self._ascend(0, self.R, np.concatenate((u, v)), np.concatenate((du, dv)))

    def log_probs(self, w: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Natural logarithms of the normalised probabilities of ``w`` after ``u`` and, before that, ``v``."""
        order = np.argsort(w.astype(np.uint16) if len(self.R) <= 1 << 16 else w, kind="stable")  # in this order, so are the classes
        w = w[order]
        q = np.ones((len(w), self.R.shape[1] + 1), np.float32)
        q[:, :-1] = self.R.take(u[order], axis=0) @ self.C1 + self.R.take(v[order], axis=0) @ self.C2
        total = np.zeros(len(w))
        for x, _, width in self.levels:
            size = self.branch if width < self.branch**2 else len(x)
            at = w // width
            group = at // size
            place, ones, buffer = at - group * size, np.ones(size, np.float32), np.empty((min(BLOCK, len(w)), size), np.float32)
            for i in range(0, len(w), BLOCK):
                g, z = group[i : i + BLOCK], buffer[: len(w) - i]
                cut = [0, *(np.flatnonzero(g[1:] != g[:-1]) + 1).tolist(), len(g)]
                for low, high in zip(cut, cut[1:]):
                    y = x[g[low] * size : (g[low] + 1) * size]
                    np.matmul(q[i + low : i + high], y.T, out=z[low:high, : len(y)])
                    z[low:high, len(y) :] = 0
                np.clip(z, -60, 60, out=z)  # so that no exponential overflows; each softmax is one of the cut scores
                own = z[np.arange(len(g)), place[i : i + BLOCK]]
                if len(y) < size:  # only a level's last group is short
                    z[low:, len(y) :] = -np.inf
                np.exp(z, out=z)
                total[i : i + BLOCK] += own - np.log(z @ ones)
        out = np.empty(len(w))
        out[order] = total
        return out


def train(docs: DataFrame, lex: Lexicon) -> LogBilinear:
    """The model after every token of ``docs`` has been one training step, in ROUNDS of averaged changes."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(lex)
    model = LogBilinear(lex.unigram)
    dealt = docs.select("text", F.pmod(F.xxhash64("text"), F.lit(ROUNDS)).alias("round"))
    for number in range(ROUNDS):
        common = spark.sparkContext.broadcast(model.tables())

        def local(batches, common=common, number=number):
            known, own = held.value, LogBilinear(held.value.unigram)
            own.load([t.astype(np.float32) for t in common.value])
            own.start()
            rng, seen = np.random.default_rng(3 + number), 0
            for whole in batches:
                for b in _chunks(whole, CHUNK):
                    hashes = [span_hashes(*_cut(t)) for t in b.column(0).to_pylist()]
                    size = np.cumsum([len(h) for h in hashes])[:-1]
                    w, u, v = contexts(known, np.split(known.find(np.concatenate(hashes)), size))
                    order = rng.permutation(len(w))
                    for i in range(0, len(w), STEP):
                        at = order[i : i + STEP]
                        own.step(w[at], u[at], v[at], rng)
                    seen += len(w)
            if not seen:
                return
            first = 0
            for i, (new, old) in enumerate(zip(own.tables(), common.value)):
                times = own.updates[i] if i < len(own.updates) else np.full(len(new), seen)
                rows = np.flatnonzero(times)
                change = (new[rows] - old[rows]).astype("<f2")
                cells = pa.array([r.tobytes() for r in change], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(first + rows), pa.array(times[rows].astype(np.int64)), cells], ["row", "n", "x"])
                first += len(new)

        def summed(batches):
            """Sorted rows to one a row of the parameters: its updates and the weighted sum of its changes."""
            held = None
            for b in batches:
                row, n = b.column(0).to_numpy(), b.column(1).to_numpy()
                edge, data = np.frombuffer(b.column(2).buffers()[1], np.int32)[b.column(2).offset :][: len(row) + 1], b.column(2).buffers()[2]
                first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1]))) if len(row) else np.zeros(0, np.int64)
                size, out = np.diff(edge)[first], []
                for part in np.split(first, np.flatnonzero(np.diff(size)) + 1) if len(first) else ():  # rows of one table
                    low = int(part[0])
                    high = int(first[np.searchsorted(first, part[-1]) + 1]) if part[-1] != first[-1] else len(row)
                    cells = np.frombuffer(data, "<f2", (edge[high] - edge[low]) // 2, edge[low]).reshape(high - low, -1)
                    sums = np.add.reduceat(cells.astype(np.float64) * n[low:high, None], part - low, axis=0)
                    out += zip(row[part].tolist(), np.add.reduceat(n[low:high], part - low).tolist(), sums)
                if held is not None and out and held[0] == out[0][0]:
                    out[0] = (held[0], held[1] + out[0][1], held[2] + out[0][2])
                elif held is not None:
                    out.insert(0, held)
                held = out.pop() if out else None
                yield _rows([(r, k, x.tobytes()) for r, k, x in out])
            yield _rows([(held[0], held[1], held[2].tobytes())] if held is not None else [])

        changes = dealt.where(F.col("round") == number).select("text").mapInArrow(lean(local), schema(row=LONG, n=LONG, x=BIN))
        changes = changes.repartition("row").sortWithinPartitions("row").mapInArrow(lean(summed), schema(row=LONG, n=LONG, x=BIN))
        got = changes.toArrow()  # at most a row for each of the parameters' rows
        tables = [t.astype(np.float32) for t in model.tables()]
        edge = np.cumsum([0, *map(len, tables)])
        rows, n, x = (got.column(k).to_pylist() for k in ("row", "n", "x"))
        for r, k, cell in zip(rows, n, x):
            i = int(np.searchsorted(edge, r, "right")) - 1
            tables[i][r - edge[i]] += (np.frombuffer(cell) / k).astype(np.float32)
        model.load(tables)
    return model


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary())], ["row", "n", "x"])


def fit(training: DataFrame) -> tuple[DataFrame, Lexicon, LogBilinear]:
    counts = materialize(count_words(training), "lm-counts")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    least = top_threshold(counts.where("octet_length(word) > 0"), "n", FREQUENT)
    top = counts.where((F.col("n") >= least) | (F.octet_length("word") == 0)).toArrow()  # at most FREQUENT + 1 rows
    lex = Lexicon(top.column("word").to_pylist(), top.column("n").to_pylist(), total, distinct)
    return counts, lex, train(training, lex)


def score(docs: DataFrame, counts: DataFrame, lex: Lexicon, model: LogBilinear, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast((lex, model))
    rare = pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())]))
    names = ["n_tokens", "n_known", "n_other", "base", "lbl"]
    fields = [T.StructField("__row", LONG), *[docs.schema[k] for k in keys]]
    fields += [T.StructField(n, LONG if n[0] == "n" else DBL) for n in names]
    fields.append(T.StructField("rare", T.ArrayType(T.StructType([T.StructField("word", BIN), T.StructField("n", LONG)]))))

    def local(batches):
        lx, lbl = held.value
        logc = np.log10(lx.count + 0.5)
        end_log, end_known = float(np.log10(lx.ends + 0.5)), int(lx.ends > 0)
        for whole in batches:
            for b in _chunks(whole, SCORE_CHUNK):
                cuts = [_cut(t) for t in b.column(1 + len(keys)).to_pylist()]
                h = np.concatenate([span_hashes(*c) for c in cuts])
                size = np.array([len(c[1]) for c in cuts])
                cut = np.cumsum(size)[:-1]
                place = lx.find(h)
                w, u, v = contexts(lx, np.split(place, cut))
                p = lbl.log_probs(w, u, v) / np.log(10.0)
                edge = np.concatenate(([0], np.cumsum(size + 1)))
                total = np.diff(np.concatenate(([0.0], np.cumsum(p, dtype=np.float64)))[edge])
                known = place >= 0
                lc = np.where(known, logc[place] if len(logc) else 0.0, 0.0)
                other = lx.classes(place) == OTHER
                at = np.concatenate(([0], np.cumsum(size)))

                def by_doc(x, at=at):
                    return np.diff(np.concatenate(([0], np.cumsum(x)))[at])

                lists = []
                for d, c in enumerate(cuts):
                    miss = np.flatnonzero(~known[at[d] : at[d + 1]])
                    if not len(miss):
                        lists.append([])
                        continue
                    _, first, n = np.unique(h[at[d] : at[d + 1]][miss], return_index=True, return_counts=True)
                    lists.append([{"word": x, "n": m} for x, m in zip(pick([c], miss[first]), n.tolist())])
                yield pa.RecordBatch.from_arrays(
                    [
                        *b.columns[: 1 + len(keys)],
                        pa.array(size + 1),
                        pa.array(by_doc(known.astype(np.int64)) + end_known),
                        pa.array(by_doc(other.astype(np.int64))),
                        pa.array(by_doc(lc) + end_log),
                        pa.array(total + by_doc(np.where(other, lc, 0.0))),
                        pa.array(lists, rare),
                    ],
                    ["__row", *keys, *names, "rare"],
                )

    rows = docs.select(F.monotonically_increasing_id().alias("__row"), *keys, "text").mapInArrow(lean(local), T.StructType(fields))
    rows = materialize(rows, "lm-rows")
    found = (
        rows.select("__row", F.explode("rare").alias("r"))
        .select("__row", F.col("r.word").alias("word"), F.col("r.n").alias("k"))
        .join(counts, "word", "left")
        .groupBy("__row")
        .agg(
            F.sum(F.col("k") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("rare_log"),
            F.sum(F.when(F.col("n") > 0, F.col("k"))).alias("rare_known"),
        )
    )
    rare_log = F.coalesce("rare_log", F.lit(0.0))
    whole = float(np.log10(lex.total + 0.5 * (lex.distinct + 1)))
    others = float(np.log10(lex.other_total + 0.5 * (lex.other_distinct + 1)))
    return rows.drop("rare").join(found, "__row", "left").select(
        *keys,
        "n_tokens",
        (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(lex.total).cast("long").alias("train_tokens"),
        (F.col("base") + rare_log - F.col("n_tokens") * whole).alias("base_score"),
        (F.col("lbl") + rare_log - F.col("n_other") * others).alias("score"),
    )


def op7_lm_score(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.withColumn("held_out", remainder(F.col("doc_id")) == HELD_OUT)
    counts, lex, model = fit(docs.where("not held_out"))
    return score(docs, counts, lex, model, ("doc_id", "held_out"))
