"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are partitioned by their number of distinct shingles into classes
of doubling size.  For a class of at most ``u`` shingles a document is a run of
overlapping windows of ``2u`` shingles with stride ``u``: an item lies inside
one window wherever it starts, and a window is at most a few times its size,
so MinHash works however long the document is.  One equal minimum of ``HASHES``
makes a candidate, and every candidate is verified by exact containment of the
item's shingles in the whole document.  An item has over half of its class's
bound, so a window that holds all of it has a similarity of 1/4 or more, and one
that holds 0.8 of it about 0.19: the chance that all minima differ is about 1e-8
and 1e-6 (the search is as good as exact, not exact).  Items of at most ``SHORT``
shingles, which must be contained whole, are looked up by one of their shingles,
exactly.

Items come in blocks of at most ``ITEMS`` (a bounded query set against all
rows), each a pass over the documents.  No document row is shuffled.

Defined cases: null or empty texts have no shingle, match nothing and stay;
a text of fewer than ``k`` words is one shingle of its whole sequence, which
also lets a document that *is* a short item match it; a short item inside a
longer document is looked for as a phrase of its own length; repeated rows of
an item count once, repeated documents are each reported; ids are integers, and
null ids are reported as they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import DBL, LONG, lean, materialize, read_table, release, schema
from .textcore import U, as_bytes, mix, shingle_hashes, word_hashes

K, THRESHOLD = 5, (4, 5)
HASHES = 64
LEAST = 8
#: Items of at most so many shingles need all of them; larger ones have over half of the least class.
SHORT = 4
#: Items of one block; about 1 KB each on the executors.
ITEMS = 50_000
#: Documents searched together.
CHUNK = 64

#: The h-th permutation of the (already mixed) shingle hashes is a product with the h-th odd number.
_SEEDS = mix(np.arange(1, HASHES + 1, dtype=U) * U(0x9E3779B97F4A7C15)) | U(1)


def _lower_words(text) -> np.ndarray:
    return word_hashes(as_bytes(text).lower())


def _minima(shingles: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.array([(shingles * s).min() for s in _SEEDS], dtype=U)


class ItemIndex:
    """One block of items: exact shingle sets, and MinHash tables by size class and shingle length."""

    def __init__(self, ids: list, texts: list[str | None], k: int = K):
        self.k = k
        self.ids: list = []
        self.sets: list[np.ndarray] = []
        self.length: list[int] = []  # words a shingle
        by: dict[tuple[int, int], list[int]] = {}
        short: dict[int, list[tuple[int, int]]] = {}
        for item, text in zip(ids, texts):
            w = _lower_words(text)
            if not len(w):
                continue
            n = min(k, len(w))
            s = np.unique(shingle_hashes(w, n))
            size = LEAST
            while size < len(s):
                size *= 2
            if len(s) <= SHORT:
                short.setdefault(n, []).append((int(s[0]), len(self.ids)))
            else:
                by.setdefault((n, size), []).append(len(self.ids))
            self.ids.append(item)
            self.sets.append(s)
            self.length.append(n)
        #: (words a shingle, class bound) -> per hash: sorted minima, their items
        self.tables = {}
        for key, rows in by.items():
            m = np.array([_minima(self.sets[i]) for i in rows])
            order = np.argsort(m, axis=0, kind="stable")
            self.tables[key] = (np.take_along_axis(m, order, axis=0), np.array(rows)[order])
        #: words a shingle -> the sorted first shingles of short items, their items
        self.short = {n: (np.array([h for h, _ in sorted(x)], dtype=U), [i for _, i in sorted(x)]) for n, x in short.items()}

    def holders(self, parts: list[np.ndarray], n: int) -> set[tuple[int, int]]:
        """(document, item) pairs where the document holds the first shingle of a short item."""
        if n not in self.short:
            return set()
        first, items = self.short[n]
        out: set[tuple[int, int]] = set()
        for d, p in enumerate(parts):
            shared = p[first[np.minimum(np.searchsorted(first, p), len(first) - 1)] == p]
            for s in np.unique(shared):
                left, right = np.searchsorted(first, s, "left"), np.searchsorted(first, s, "right")
                out.update((d, i) for i in items[left:right])
        return out

    def candidates(self, parts: list[np.ndarray], sizes: list[tuple[int, int]]) -> set[tuple[int, int]]:
        """(document, item) pairs where some window of the document shares a minimum with the item."""
        out: set[tuple[int, int]] = set()
        whole = np.concatenate(parts)
        length = np.array([len(p) for p in parts])
        first = np.cumsum(length) - length
        bounds = {}
        for _, u in sizes:
            count = -(-length // u)
            doc = np.repeat(np.arange(len(parts)), count)
            at = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
            bounds[u] = (first[doc] + at * u, doc, np.flatnonzero(doc[:-1] == doc[1:]))
        for h, seed in enumerate(_SEEDS):
            v = whole * seed
            for key in sizes:
                start, doc, pair = bounds[key[1]]
                block = np.minimum.reduceat(v, start)
                window = block.copy()
                window[pair] = np.minimum(block[pair], block[pair + 1])
                m, rows = self.tables[key]
                col = m[:, h]
                left = np.searchsorted(col, window)
                for w in np.flatnonzero(col[np.minimum(left, len(col) - 1)] == window).tolist():
                    i = int(left[w])
                    while i < len(col) and col[i] == window[w]:
                        out.add((int(doc[w]), int(rows[i, h])))
                        i += 1
        return out

    def search(self, texts: list) -> list[list[tuple[int, int]]]:
        """For each text the (item position, shared shingles) of the items it contains."""
        out: list[list[tuple[int, int]]] = [[] for _ in texts]
        words = [_lower_words(t) for t in texts]
        by_length: dict[int, list] = {n: [] for n in self.short}
        for key in self.tables:
            by_length.setdefault(key[0], []).append(key)
        for n, keys in by_length.items():
            docs = [d for d, w in enumerate(words) if len(w) >= n]
            if not docs:
                continue
            parts = [shingle_hashes(words[d], n) for d in docs]
            have: dict[int, np.ndarray] = {}
            for d, i in sorted(self.candidates(parts, keys) | self.holders(parts, n)):
                if d not in have:
                    have[d] = np.unique(parts[d])
                item = self.sets[i]
                at = np.minimum(np.searchsorted(have[d], item), len(have[d]) - 1)
                shared = int((have[d][at] == item).sum())
                if THRESHOLD[1] * shared >= THRESHOLD[0] * len(item):
                    out[docs[d]].append((i, shared))
        return out


def _searched(index: ItemIndex, column):
    """Matches of each text of an Arrow column, a chunk at a time."""
    for i in range(0, len(column), CHUNK):
        yield from index.search(column.slice(i, CHUNK).to_pylist())


def _item_blocks(items: DataFrame, most: int):
    """The items, repeated rows once, in blocks of about ``most``, one at a time."""
    items = items.select("item_id", "text").distinct()
    n = items.count()
    blocks = max(1, -(-n // most))
    for b in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        rows = part.select("item_id", "text").collect()
        if rows:
            yield rows


def contained_items(docs: DataFrame, items: DataFrame, k: int = K, most: int = ITEMS) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item, containment), one row per document and item it contains."""
    spark = docs.sparkSession
    out = schema(doc_id=LONG, item_id=LONG, n_shared=LONG, n_item=LONG, containment=DBL)
    found = spark.createDataFrame([], out)
    for rows in _item_blocks(items, most):
        index = spark.sparkContext.broadcast(ItemIndex([r[0] for r in rows], [r[1] for r in rows], k))

        def local(batches, index=index):
            x = index.value
            for b in batches:
                hits = [(d, x.ids[i], n, len(x.sets[i])) for d, found in zip(b.column(0).to_pylist(), _searched(x, b.column(1))) for i, n in found]
                cols = list(zip(*hits)) or [[], [], [], []]
                arrays = [pa.array(c, pa.int64()) for c in cols]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array([n / m for _, _, n, m in hits], pa.float64())], out.fieldNames())

        found = found.union(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(local), out))
    return found


def decontaminate(docs: DataFrame, items: DataFrame, k: int = K, most: int = ITEMS) -> DataFrame:
    """``docs`` without the documents that contain an item; judged row by row, nothing is joined."""
    spark = docs.sparkSession
    release(spark)
    at = docs.columns.index("text")
    for i, rows in enumerate(_item_blocks(items, most)):
        if i:  # one block of items, and one Python worker a task, at a time
            docs = materialize(docs, "decontaminated")
        index = spark.sparkContext.broadcast(ItemIndex([r[0] for r in rows], [r[1] for r in rows], k))

        def local(batches, index=index):
            for b in batches:
                yield b.filter(pa.array([not found for found in _searched(index.value, b.column(at))], pa.bool_()))

        docs = docs.mapInArrow(lean(local), docs.schema)
    return docs


def op6_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return contained_items(docs, read_table(spark, sf_dir, "benchmark"))


SQL_OP6 = r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM documents),
v AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM benchmark),
q AS (SELECT DISTINCT item_id, least(len(w), 5) AS k, array_to_string(w[i : i + least(len(w), 5) - 1], ' ') AS g FROM v, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS t(i) WHERE len(w) > 0),
m AS (SELECT item_id, count(*) AS n_item FROM q GROUP BY 1),
s AS (SELECT DISTINCT doc_id, k, array_to_string(w[i : i + k - 1], ' ') AS g FROM w, (SELECT DISTINCT k FROM q) z, unnest(range(1, len(w) - k + 2)) AS t(i) WHERE len(w) >= k),
o AS (SELECT doc_id, item_id, count(*) AS n_shared FROM s JOIN q USING (k, g) GROUP BY 1, 2)
SELECT doc_id, item_id, n_shared, n_item, n_shared / n_item::DOUBLE AS containment FROM o JOIN m USING (item_id) WHERE 5 * n_shared >= 4 * n_item
"""
