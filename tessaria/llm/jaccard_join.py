"""N-gram Jaccard join with signature trees.

Every document becomes the set of its word shingles.  Documents with equal
sets are one class.  Class representatives that can reach the threshold must
share a token of their prefixes (the first ``n - ceil(t*n) + 1`` tokens in one
global order, frequent tokens last), so the prefix tokens deal the work out:
each token's members are a block, long ones are split into bounded chunks, and
equal blocks are one.  Inside a block a signature tree is built (leaves are
documents sorted by size, inner nodes hold the OR and the AND of their
children's token bitmaps and their size range), and a dual traversal prunes
every node pair whose maximum possible overlap is below the threshold.
Surviving pairs are verified on the exact sets.

Rounds keep groups of near copies from making all pairs.  Each takes, of a
block's surviving pairs, only a spanning forest, the most similar pairs first;
these are verified on the exact sets, and blocks whose documents are all in one
component are done.  The first round looks at one block a document, the largest,
which joins most near copies; the second at all others; the third, with wider
bitmaps that leave hardly a pair that does not link, at the documents of blocks
in which a forest left pairs out (those that forests connect are one block now)
and at the chunk pairs of large groups; the last takes all pairs that are still
between components there.  A pair left out joins two
documents that links already connect, so no component changes.

Groups of a token in more than ``BLOCK`` documents are first split by size: a
document meets those of its own class of sizes and of the next.  Of such a
group, documents of the largest component meet only the others, in chunks.

Defined cases: null or empty text, or text without words, has the empty set
and is linked with nothing; fewer words than ``k`` make one shingle; rows that
share a ``doc_id`` are one document, that of the smallest text; rows with null ``doc_id`` are a component
of their own (null).  Shingles are 64-bit hashes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BIN, INT, LONG, STR, components, lean, materialize, read_table, release, schema, small_or_plain, top_threshold
from .textcore import as_bytes, shingle_hashes, word_hashes

#: Largest block that one task holds; longer ones are split into chunk pairs.
BLOCK = 256
#: Tokens in more documents than this are put last in the order; at most HOT_MOST are (8 bytes each).
HOT_LEAST, HOT_MOST = 8, 500_000
#: A bitmap has at least so many bits a token (of the second round's fewer documents more), a power of two between these.
FIRST, SECOND = 1, 16
LEAST_BITS, MOST_BITS = 512, 1 << 20
#: Documents whose sets a Python task holds at a time.
CHUNK = 256
SCAN = 2048
#: Bytes of bitmaps that a traversal gathers at a time, on each side.
HELD = 1 << 20


def shingle_set(text: str | None, k: int) -> np.ndarray:
    return np.unique(shingle_hashes(word_hashes(as_bytes(text).lower()), k))


def prefix_size(n: int, num: int, den: int = 100) -> int:
    return n - (-(-num * n // den)) + 1


def bits_for(n: int, each: int) -> int:
    return min(max(1 << (each * n - 1).bit_length(), LEAST_BITS), MOST_BITS) if n else LEAST_BITS


def signature(s: np.ndarray, each: int = FIRST) -> bytes:
    size = bits_for(len(s), each)
    bits = np.zeros(size, dtype=np.uint8)
    bits[(s & np.uint64(size - 1)).astype(np.int64)] = 1
    return np.packbits(bits).tobytes()


# --- signature tree ---------------------------------------------------------

_POP = np.array([bin(i).count("1") for i in range(1 << 16)], dtype=np.uint16)


def _popcount(a: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a).sum(axis=-1).astype(np.int64) if hasattr(np, "bitwise_count") else _POP[a.view(np.uint16)].sum(axis=-1)


class Tree:
    """A static tree over documents sorted by size: levels[0] are leaves, each upper node spans ``fan`` below."""

    def __init__(self, n: np.ndarray, sig: np.ndarray, fan: int = 8):
        self.fan = fan = len(n) if len(n) <= 4 * fan else fan
        self.levels = [(n, n, sig, sig)]  # least size, largest size, OR of bitmaps, AND of bitmaps
        while len(self.levels[-1][0]) > 1:
            lo, hi, any_, all_ = self.levels[-1]
            at = np.arange(0, len(lo), fan)
            self.levels.append(
                (np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.bitwise_or.reduceat(any_, at), np.bitwise_and.reduceat(all_, at))
            )


def dual_traversal(a: Tree, b: Tree, num: int, den: int = 100) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Leaf pairs (i, j) whose maximum possible overlap can still reach num/den of the union, and that overlap's share.

    A node pair's overlap is at most its larger node's size less the bits that
    every document below it has and no document below the other has.  Bitmaps
    of pairs are copied HELD bytes at a time: a block of near copies leaves all
    its pairs, and those of long documents would be gigabytes.
    """
    la, lb = len(a.levels) - 1, len(b.levels) - 1
    i, j = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)
    while True:
        (lo1, hi1), (lo2, hi2) = ([v[at] for v in t.levels[n][:2]] for t, n, at in ((a, la, i), (b, lb, j)))
        (any1, all1), (any2, all2) = a.levels[la][2:], b.levels[lb][2:]
        most = np.minimum(hi1, hi2)
        step = max(HELD // any1[0].nbytes, 1)
        for s in range(0, len(i), step):
            p, q = i[s : s + step], j[s : s + step]
            least = np.minimum(hi1[s : s + step] - _popcount(all1[p] & ~any2[q]), hi2[s : s + step] - _popcount(all2[q] & ~any1[p]))
            np.minimum(most[s : s + step], least, out=most[s : s + step])
        # overlap o and sizes x, y link when den*o >= num*(x + y - o)
        keep = (den + num) * most >= num * (lo1 + lo2)
        i, j = i[keep], j[keep]
        if la == 0 and lb == 0 or not len(i):
            return i, j, (most / np.maximum(lo1 + lo2, 1))[keep]
        if la:
            la -= 1
            i, j = _children(i, j, a.fan, len(a.levels[la][0]))
        if lb:
            lb -= 1
            j, i = _children(j, i, b.fan, len(b.levels[lb][0]))


def _children(i, j, fan, size):
    kids = (i[:, None] * fan + np.arange(fan)).ravel()
    other = np.repeat(j, fan)
    ok = kids < size
    return kids[ok], other[ok]


def _tree_pairs(n, sigs, x, y, num):
    """Places (i, j) that the trees over documents ``x`` and ``y`` leave, and the share of the overlap; wider bitmaps are folded to the narrower."""
    width = min(min(len(sigs[i]) for i in x), min(len(sigs[i]) for i in y))

    def grown(rows):
        out = np.empty((len(rows), width // 8), dtype=np.uint64)
        for r, i in enumerate(rows):
            v = np.frombuffer(sigs[i], dtype=np.uint64)
            out[r] = v if len(sigs[i]) == width else np.bitwise_or.reduce(v.reshape(-1, width // 8), axis=0)
        return Tree(n[rows], out)

    a = grown(x)
    i, j, share = dual_traversal(a, a if y is x else grown(y), num)
    return x[i], y[j], share


def block_pairs(doc, n, comp, sigs, side, num: int, forest: bool) -> tuple[list[tuple[int, int]], bool]:
    """Pairs of a block that the trees leave, and whether a forest left some of them out.  ``side`` 0 and 1: only pairs across; all equal: pairs within.

    Documents are dealt into trees by bitmap width; sizes within the threshold differ by one width at most.
    """
    order = np.lexsort((doc, n))
    doc, n, comp, side = doc[order], n[order], comp[order], side[order]
    sigs = [sigs[i] for i in order.tolist()]
    width = np.array([len(s) for s in sigs])
    across = side.min() != side.max()
    found = []
    for w in np.unique(width).tolist():
        here = np.flatnonzero(width == w)
        near = np.flatnonzero(width == 2 * w)
        for x, y in ((here, here), (here, near)):
            if across:
                for s in (0, 1) if y is near else (0,):
                    p, q = x[side[x] == s], y[side[y] == 1 - s]
                    if len(p) and len(q):
                        found.append(_tree_pairs(n, sigs, p, q, num))
            elif len(x) and len(y) and (y is not here or len(x) > 1):
                found.append(_tree_pairs(n, sigs, x, y, num))
    if not found:
        return [], False
    i, j, share = (np.concatenate(v) for v in zip(*found))
    keep = (comp[i] != comp[j]) & ((i < j) | across)
    i, j, share = i[keep], j[keep], share[keep]
    if forest:
        best = np.lexsort((j, i, -share))
        i, j = i[best], j[best]
        heads, own = np.unique(comp, return_inverse=True)
        own, root = own.tolist(), list(range(len(heads)))

        def find(v):
            while root[v] != v:
                root[v] = root[root[v]]
                v = root[v]
            return v

        out = []
        for p, q in zip(i.tolist(), j.tolist()):
            a, b = find(own[p]), find(own[q])
            if a != b:
                root[b] = a
                out.append((p, q))
                if len(out) == len(heads) - 1:
                    break
    else:
        out = list(zip(i.tolist(), j.tolist()))
    return [(int(min(doc[p], doc[q])), int(max(doc[p], doc[q]))) for p, q in out], len(out) < len(i)


# --- Spark ------------------------------------------------------------------


def _chunked(batch, n: int = CHUNK):
    for i in range(0, batch.num_rows, n):
        yield batch.slice(i, n)


def _scan(docs: DataFrame, k: int) -> DataFrame:
    """Kind 0: (doc_id, n, key, bitmap) a document; kind 1: (token, documents of a chunk that have it) where several have."""
    names = ["kind", "v", "n", "key", "sig"]

    def local(batches):
        for whole in batches:
            for b in _chunked(whole, SCAN):
                ns, keys, sigs, every = [], [], [], {}
                for t in b.column(1).to_pylist():
                    s = shingle_set(t, k)
                    ns.append(len(s))
                    keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    sigs.append(signature(s))
                    if len(s):
                        every.setdefault(keys[-1], s)  # copies within the chunk count once: they are one class
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.zeros(len(ns), np.int32)), b.column(0), pa.array(ns, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())],
                    names,
                )
                if every:
                    u, c = np.unique(np.concatenate(list(every.values())), return_counts=True)
                    u, c = u[c >= 3].view(np.int64), c[c >= 3]
                    none = pa.nulls(len(u), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(u), np.int32)), pa.array(u), pa.array(c.astype(np.int64)), none, none], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(local), schema(kind=INT, v=LONG, n=LONG, key=BIN, sig=BIN))


def _hot(scan: DataFrame) -> np.ndarray:
    """Frequent tokens, most frequent last; which ones only shapes the order of tokens, never the result."""
    counts = materialize(scan.where("kind = 1").groupBy("v").agg(F.sum("n").alias("n")).where(F.col("n") >= HOT_LEAST), "jj-hot")
    least = top_threshold(counts, "n", HOT_MOST)
    got = counts.where(F.col("n") >= least).toArrow()  # at most HOT_MOST rows
    v, n = got.column("v").to_numpy(), got.column("n").to_numpy()
    return v[np.lexsort((v, n))].view(np.uint64)


def _prefix_tokens(docs: DataFrame, k: int, num: int, hot) -> DataFrame:
    def local(batches):
        order = hot.value
        at = np.argsort(order)
        keys = order[at]
        for whole in batches:
            for b in _chunked(whole):
                tok, doc, size = [], [], []
                for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    s = shingle_set(t, k)
                    if d is None or not len(s):
                        continue
                    n = len(s)
                    p = prefix_size(n, num)
                    if len(keys):
                        i = np.minimum(np.searchsorted(keys, s), len(keys) - 1)
                        is_hot = keys[i] == s
                        cool = s[~is_hot]
                        if len(cool) < p:
                            warm = s[is_hot][np.argsort(at[i[is_hot]], kind="stable")]
                            s = np.concatenate((cool, warm))
                        else:
                            s = cool
                    tok.append(s[:p])
                    doc.append(np.full(p, d, dtype=np.int64))
                    size.append(np.full(p, n, dtype=np.int32))
                if tok:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(tok).view(np.int64)), pa.array(np.concatenate(doc)), pa.array(np.concatenate(size))],
                        ["tok", "doc", "n"],
                    )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(local), schema(tok=LONG, doc=LONG, n=INT))


def _sharper(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(doc, sig): wide bitmaps of the documents in ``ids(doc_id)``, which leave hardly a pair that does not link."""

    def local(batches):
        for whole in batches:
            for b in _chunked(whole):
                sigs = [signature(shingle_set(t, k), SECOND) for t in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sigs, pa.binary())], ["doc", "sig"])

    need = docs.join(small_or_plain(ids, ids.count()), "doc_id", "left_semi")
    return need.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(local), schema(doc=LONG, sig=BIN))


def _sets(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(doc, tokens): the exact sets of the documents in ``ids(doc_id)``."""

    def local(batches):
        for whole in batches:
            for b in _chunked(whole):
                s = [shingle_set(t, k).view(np.int64) for t in b.column(1).to_pylist()]
                off = np.concatenate(([0], np.cumsum([len(x) for x in s]))).astype(np.int32)
                flat = np.concatenate(s) if s else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(off), pa.array(flat))], ["doc", "tokens"])

    need = docs.join(small_or_plain(ids, ids.count()), "doc_id", "left_semi")
    out = T.StructType([T.StructField("doc", LONG), T.StructField("tokens", T.ArrayType(LONG))])
    return need.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(local), out)


def comparable(doc: np.ndarray, n: np.ndarray, num: int, den: int = 100) -> np.ndarray:
    """The documents, sorted by id, that have another one of a size within the threshold."""
    order = np.argsort(n, kind="stable")
    size = n[order]
    near = num * size[1:].astype(np.int64) <= den * size[:-1].astype(np.int64)
    keep = np.zeros(len(size), dtype=bool)
    keep[1:] |= near
    keep[:-1] |= near
    return np.sort(doc[order[keep]])


def _shared(tokens: DataFrame, num: int) -> DataFrame:
    """Groups of the prefix tokens that several documents have: ``docs`` of up to BLOCK, or (tok, doc) of larger ones.

    Tokens are shuffled once and read as a sorted stream; no more than BLOCK rows of a token are held.
    Documents that no other of their group can match by size are left out.
    """
    list_ = pa.list_(pa.int64())

    def local(batches):
        seen: set[bytes] = set()
        tok, held = None, []  # the open group's (docs, sizes) while it is small; None once it is known to be large

        def close(lists):
            if held:
                key = comparable(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), num)
                if len(key) > 1:
                    name = hashlib.blake2b(key.tobytes(), digest_size=16).digest()
                    if name not in seen:
                        if len(seen) > 200_000:
                            seen.clear()
                        seen.add(name)
                        lists.append(key)

        def small(lists):
            none = pa.nulls(len(lists), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(lists, list_), none, none], ["docs", "tok", "doc"])

        for b in batches:
            t, d, n = (b.column(i).to_numpy() for i in range(3))
            cut = np.concatenate(([0], np.flatnonzero(t[1:] != t[:-1]) + 1, [len(t)])) if len(t) else np.zeros(1, np.int64)
            lists, toks, docs = [], [], []
            # Most tokens are in one document: only the first, the last and the longer groups are looked at.
            size = np.diff(cut)
            look = np.flatnonzero(size > 1)
            if len(size):
                look = np.union1d(look, [0, len(size) - 1])
            for g in look.tolist():
                s, e = int(cut[g]), int(cut[g + 1])
                if t[s] != tok:
                    close(lists)
                    tok, held = t[s], []
                if held is not None and sum(len(h[0]) for h in held) + e - s <= BLOCK:
                    held.append((d[s:e], n[s:e]))
                    continue
                for h in held or ():
                    toks.append(np.full(len(h[0]), tok))
                    docs.append(h[0])
                held = None
                toks.append(t[s:e])
                docs.append(d[s:e])
            yield small(lists)
            if docs:
                toks, docs = np.concatenate(toks), np.concatenate(docs)
                yield pa.RecordBatch.from_arrays([pa.nulls(len(docs), list_), pa.array(toks), pa.array(docs)], ["docs", "tok", "doc"])
        lists = []
        close(lists)
        yield small(lists)

    out = T.StructType([T.StructField("docs", T.ArrayType(LONG)), T.StructField("tok", LONG), T.StructField("doc", LONG)])
    return tokens.repartition("tok").sortWithinPartitions("tok").mapInArrow(lean(local), out)


def _small_blocks(shared: DataFrame) -> DataFrame:
    """(block, doc, side): distinct lists of at most BLOCK documents that share a prefix token."""
    lists = shared.where("docs is not null").select("docs").distinct()
    return lists.select(F.sha2(F.to_json("docs"), 256).alias("block"), F.explode("docs").alias("doc")).withColumn("side", F.lit(0))


def _large_groups(shared: DataFrame, members: DataFrame, num: int) -> DataFrame:
    """(grp, doc, c): documents that share a token of more than BLOCK, in groups by size, and the group's count.

    Sizes are in classes of ratio ``num``/100, so that documents within the threshold are in one class or neighbours;
    group g of a token has the classes g and g + 1, and is kept if it has a document of class g.
    """
    large = shared.where("tok is not null").select("tok", "doc").join(members.select("doc", "n"), "doc")
    q = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / num)) + 1e-9)
    large = large.withColumn("q", q).select("doc", "tok", "q", F.explode(F.array(F.col("q"), F.col("q") - 1)).alias("g"))
    per = large.groupBy("tok", "g").agg(F.count(F.lit(1)).alias("c"), F.min("q").alias("least")).where("c > 1 and least = g")
    rows = large.join(per, ["tok", "g"])
    return rows.select(F.concat_ws("_", "tok", "g").alias("grp"), "doc", "c")


def _chunk(c: Column) -> Column:
    return F.greatest(F.ceil(F.coalesce(c, F.lit(0)) / BLOCK), F.lit(1)).cast("int")


def _place(count: Column) -> Column:
    return F.pmod(F.xxhash64("doc", "grp"), count).cast("int")


def _large_chunks(groups: DataFrame) -> DataFrame:
    """Blocks of large groups: each chunk by itself."""
    return groups.select(F.concat_ws(":", "grp", _place(_chunk(F.col("c")))).alias("block"), "doc", F.lit(0).alias("side"))


def _large_pairs(groups: DataFrame, comp: DataFrame) -> DataFrame:
    """Blocks in which every two documents of a large group meet that are not both in its largest component.

    Documents of the largest component, in chunks, meet each chunk of the others; those meet each other.
    """
    rows = groups.join(comp, "doc")
    per = rows.groupBy("grp", "comp").agg(F.count(F.lit(1)).alias("k"))
    top = per.groupBy("grp").agg(F.max(F.struct("k", "comp")).alias("top"), F.sum("k").alias("c")).where("c > top.k")
    top = top.select("grp", F.col("top.comp").alias("big"), _chunk(F.col("top.k")).alias("ca"), _chunk(F.col("c") - F.col("top.k")).alias("cs"))
    rows = rows.join(top, "grp")
    own = F.col("comp") == F.col("big")
    big = rows.where(own).withColumn("mine", _place(F.col("ca"))).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cs") - 1)))
    big = big.select(F.concat_ws(":", "grp", F.lit("a"), "mine", "other").alias("block"), "doc", F.lit(0).alias("side"))
    rest = rows.where(~own).withColumn("mine", _place(F.col("cs")))
    against = rest.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("ca") - 1)))
    against = against.select(F.concat_ws(":", "grp", F.lit("a"), "other", "mine").alias("block"), "doc", F.lit(1).alias("side"))
    among = rest.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cs") - 1)))
    among = among.select(
        F.concat_ws(":", "grp", F.lit("s"), F.least("mine", "other"), F.greatest("mine", "other")).alias("block"),
        "doc",
        (F.col("mine") > F.col("other")).cast("int").alias("side"),
    )
    return big.union(against).union(among)


def _regrouped(blocks: DataFrame, comp: DataFrame, roots: DataFrame) -> DataFrame:
    """Blocks by the components of all pairs that forests took, verified or not, as two documents of a pair left out are in one.

    ``comp(doc, comp)`` and ``roots(v, component)`` of its components.  Documents of such a component of up to BLOCK are one
    block, instead of one for each token that they share; of a larger one, a block keeps its own.
    """
    tried = comp.join(roots.withColumnRenamed("v", "comp"), "comp").select("doc", "component")
    size = tried.groupBy("component").agg(F.count(F.lit(1)).alias("c"))
    rows = blocks.join(tried.join(size, "component"), "doc")
    name = F.when(F.col("c") <= BLOCK, F.concat(F.lit("c:"), "component")).otherwise(F.concat_ws(":", "block", "component"))
    return rows.select(name.alias("block"), "doc", F.lit(0).alias("side")).distinct()


def _several(blocks: DataFrame, members: DataFrame) -> DataFrame:
    """The blocks that hold more than one component."""
    per = blocks.join(members.select("doc", "comp"), "doc").groupBy("block").agg(F.min("comp").alias("l"), F.max("comp").alias("h"))
    return blocks.join(per.where("l <> h").select("block"), "block").select(blocks.columns)


def _candidates(blocks: DataFrame, members: DataFrame, num: int, forest: bool) -> DataFrame:
    """Distinct surviving pairs (a, b) of all blocks that hold more than one component.

    Of a forest also (null, null, block) for each block that has further pairs.
    """
    rows = _several(blocks, members).join(members, "doc")

    def trees(batches):
        """Rows come sorted by block; a block is bounded, so one is held at a time."""
        rest = None
        for b in batches:
            t = pa.Table.from_batches([b])
            rest = t if rest is None else pa.concat_tables([rest, t])
            ids = rest.column("block").combine_chunks()
            last = int(pc.index(ids, ids[-1]).as_py()) if len(ids) else 0
            if last:
                yield pairs_of(rest.slice(0, last))
                rest = rest.slice(last)
        if rest is not None and rest.num_rows:
            yield pairs_of(rest)

    def pairs_of(t):
        ids = t.column("block").to_numpy()
        at = np.concatenate(([0], np.flatnonzero(ids[1:] != ids[:-1]) + 1, [len(ids)]))
        doc, n, comp, side = (t.column(c).to_numpy() for c in ("doc", "n", "comp", "side"))
        sig = t.column("sig")
        out, more = [], []
        for s, e in zip(at[:-1].tolist(), at[1:].tolist()):
            pairs, rest = block_pairs(doc[s:e], n[s:e], comp[s:e], sig.slice(s, e - s).to_pylist(), side[s:e], num, forest)
            out += pairs
            if rest:
                more.append(ids[s])
        out = list(dict.fromkeys(out))
        pad = [None] * len(more)
        return pa.RecordBatch.from_arrays(
            [*(pa.array([p[i] for p in out] + pad, pa.int64()) for i in (0, 1)), pa.array([None] * len(out) + more, pa.string())], ["a", "b", "block"]
        )

    rows = rows.select("block", "doc", "n", "comp", "sig", "side").repartition("block").sortWithinPartitions("block")
    return rows.mapInArrow(lean(trees), schema(a=LONG, b=LONG, block=STR)).distinct()


def _verified(pairs: DataFrame, docs: DataFrame, k: int, num: int, den: int = 100) -> DataFrame:
    """Pairs whose exact sets meet the threshold."""
    ids = materialize(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "jj-used")
    sets = materialize(_sets(docs, ids, k), "jj-sets")
    left = sets.select(F.col("doc").alias("a"), F.col("tokens").alias("x"))
    right = sets.select(F.col("doc").alias("b"), F.col("tokens").alias("y"))
    shared = F.size(F.array_intersect("x", "y"))
    return (
        pairs.join(left, "a")
        .join(right, "b")
        .where((den + num) * shared >= num * (F.size("x") + F.size("y")))
        .select("a", "b")
    )


def _one_row_an_id(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` with the smallest text of each repeated id; only texts of repeated ids are moved."""
    several = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("doc_id")
    several = materialize(several, "jj-repeated")
    n = several.count()
    if not n:
        return docs
    ids = small_or_plain(several, n)
    one = docs.join(ids, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    return materialize(docs.join(ids, "doc_id", "left_anti").unionByName(one), "jj-docs")


def _owners(scan: DataFrame) -> DataFrame:
    """(doc, n, sig, rep): every document and the smallest one with its set.

    Sets that a thousandth of all documents or more have are at most 1,000: they are broadcast, so no task gets a large group.
    """
    rows = scan.where("kind = 0 and v is not null").select(F.col("v").alias("doc"), "n", "key", "sig")
    classes = materialize(rows.where("key is not null").groupBy("key").agg(F.min("doc").alias("rep"), F.count(F.lit(1)).alias("c")).where("c > 1"), "jj-class")
    often = rows.count() / 1000
    hot = classes.where(F.col("c") >= often).select("key", F.col("rep").alias("hot"))
    rows = rows.join(F.broadcast(hot), "key", "left")
    told = rows.where("hot is not null or key is null").select("doc", "n", "sig", F.coalesce("hot", "doc").alias("rep"))
    rest = rows.where("hot is null and key is not null").join(classes.where(F.col("c") < often).select("key", "rep"), "key", "left")
    return told.union(rest.select("doc", "n", "sig", F.coalesce("rep", "doc").alias("rep")))


def jaccard_classes(docs: DataFrame, k: int = 5, num: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each distinct non-null ``doc_id``."""
    spark = docs.sparkSession
    release(spark)
    docs = _one_row_an_id(docs.select("doc_id", "text"))
    scan = materialize(_scan(docs, k), "jj-scan")
    owners = materialize(_owners(scan), "jj-owner")
    extra = materialize(owners.where("doc <> rep or n = 0").select(F.col("doc").alias("doc_id")), "jj-copies")
    alone = docs.join(small_or_plain(extra, extra.count()), "doc_id", "left_anti").where("doc_id is not null")

    hot = spark.sparkContext.broadcast(_hot(scan))
    shared = materialize(_shared(_prefix_tokens(alone, k, num, hot), num), "jj-shared")
    groups = materialize(_large_groups(shared, owners, num), "jj-groups")
    blocks = materialize(_small_blocks(shared).union(_large_chunks(groups)), "jj-blocks")

    def verified(pairs: DataFrame) -> DataFrame:
        return materialize(_verified(pairs, docs, k, num), "jj-links")

    def contracted(pairs: DataFrame, comp: DataFrame) -> DataFrame:
        """Components of pairs of documents as pairs of their components: (v, component)."""
        ends = [comp.select(F.col("doc").alias(c), F.col("comp").alias(f"c{c}")) for c in ("a", "b")]
        return components(pairs.join(ends[0], "a").join(ends[1], "b").where("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")))

    def labelled(comp: DataFrame, links: DataFrame) -> DataFrame:
        """``comp(doc, comp)`` after further links."""
        if links.limit(1).count() == 0:
            return comp
        roots = contracted(links, comp).withColumnRenamed("v", "comp")
        return materialize(comp.join(roots, "comp", "left").select("doc", F.coalesce("component", "comp").alias("comp")), "jj-comp")

    def told(blocks: DataFrame, comp: DataFrame, sigs: DataFrame, tried: DataFrame | None, forest: bool = True) -> tuple[DataFrame, DataFrame]:
        """Pairs not tried before, and the blocks whose forest left pairs out."""
        rows = materialize(_candidates(blocks, sigs.join(comp, "doc"), num, forest), "jj-pairs")
        pairs = rows.where("a is not null").select("a", "b")
        pairs = pairs if tried is None else materialize(pairs.join(tried, ["a", "b"], "left_anti"), "jj-fresh")
        return pairs, rows.where("block is not null").select("block")

    sigs = owners.where("doc = rep").select("doc", "n", "sig")
    comp = sigs.select("doc", F.col("doc").alias("comp"))
    # 1: the largest block of each document
    sizes = blocks.groupBy("block").agg(F.count(F.lit(1)).alias("c"))
    largest = blocks.join(sizes, "block").groupBy("doc").agg(F.max(F.struct("c", "block")).alias("b")).select("b.block").distinct()
    tried, _ = told(blocks.join(largest, "block").select(blocks.columns), comp, sigs, None)
    comp = labelled(comp, verified(tried))
    release(spark)
    # 2: all blocks that still have several components
    fresh, left = told(blocks, comp, sigs, tried)
    tried, comp = tried.union(fresh), labelled(comp, verified(fresh))
    release(spark)
    # 3: only documents of blocks whose forest left pairs out, and chunk pairs of large groups, have anything new
    again = _regrouped(blocks.join(left, "block"), comp, contracted(tried, comp)).union(_large_pairs(groups, comp))
    again = materialize(_several(again, comp), "jj-again")
    ids = materialize(again.select(F.col("doc").alias("doc_id")).distinct(), "jj-used")
    sigs = materialize(sigs.drop("sig").join(_sharper(docs, ids, k), "doc"), "jj-sharper")
    fresh, left = told(again, comp, sigs, tried)
    tried, comp = tried.union(fresh), labelled(comp, verified(fresh))
    release(spark)
    # 4: what the last forests left out and is still between components
    last, _ = told(again.join(left, "block").select(again.columns), comp, sigs, tried, False)
    comp = labelled(comp, verified(last))
    return owners.join(comp.withColumnRenamed("doc", "rep"), "rep", "left").select(
        F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("comp", "rep").alias("component_id")
    )


def jaccard_dedup(docs: DataFrame, k: int = 5, num: int = 80) -> DataFrame:
    """``docs`` with one document of each component (its smallest id); rows without id stay."""
    classes = jaccard_classes(docs, k, num)
    gone = materialize(classes.where("doc_id <> component_id").select("doc_id"), "jj-gone")
    return docs.join(small_or_plain(gone, gone.count()), "doc_id", "left_anti").select(docs.columns)


def op9_jaccard_join(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard_classes(docs, k=4, num=85)


SQL_OP9 = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS g FROM d, unnest(range(1, greatest(len(w) - 3, least(len(w), 1)) + 1)) AS t(i)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT doc_id AS v, doc_id AS c FROM documents UNION SELECT u.b, r.c FROM r JOIN u ON u.a = r.v)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.c) AS component_id
FROM d JOIN r ON r.v = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY 1, 2
"""
