"""HTML main-text extraction with wrappers inferred for each host.

Union-free regular expressions: the pages of a host are token streams with
their text as slots.  Runs of equal siblings (also with a period of two or
three) become repeated groups, and the streams of further pages are aligned
with the wrapper one after the other: equal tokens match, different texts make
a variable text slot, and tokens that only one side has become optional
groups.  The wrapper's main region is its article elements, else its main
elements, else the element that holds most of the variable text.

Every page is then matched with its host's wrapper by the same alignment, and
its text is what stands in slots of the main region, fixed or variable, in page
order; tokens that the wrapper lacks belong to the region of the group in which
they stand.  Elements that are menus, headers, footers, sidebars, notices,
adverts, forms, scripts, styles or comments by their name, role, or a whole
class or id are left out.  A page of which no text is in the region, or whose
host has no wrapper, gives its own article, else its main element, else all
that no excluded element holds.  Nothing else is dropped: a sentence that all
articles of a host have stays.

A wrapper is inferred from every different page of its host.  Each page's tree
is made where the page is read, with digests for its texts; trees are dealt by
their page's hash into parts of about ``PART`` pages, a part is aligned in the
order of the hashes, and the parts' wrappers are aligned likewise, ``PART`` at a
time, until a host has one.  So no task holds more than two trees, a host that
holds a third of all pages is spread over many tasks, and the result depends on
the pages alone.  Wrappers are broadcast under a counted bound, joined by host
beyond it.

Defined cases: null or empty html gives the empty text; a null address is the
empty host; elements nested more than ``DEEP`` deep count as their ancestor;
repeated rows and ids are each extracted; copies count once for the wrapper.
"""

from __future__ import annotations

import difflib
import hashlib
import html as _html
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LONG, STR, materialize, read_table, schema, small_or_plain

#: Pages, or wrappers of parts, that one task aligns in a row.
PART = 256
#: Characters of wrappers that are broadcast; beyond, a join by host.
WRAPPERS = 20_000_000
#: Characters of wrappers that a worker keeps as trees, and hosts whose counts are broadcast.
KNOWN, HOSTS = 2_000_000, 100_000
#: Longest text that stands in a tree as it is; a longer one is held by its digest.
SHORT = 24
#: Nesting that paths and wrappers tell apart.
DEEP = 200
#: Children of two groups, multiplied, up to which their alignment is the longest; beyond, by longest matching runs.
ALIGN = 250_000

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>"""
    r"""|<(script|style|noscript|template|textarea|iframe|svg|title)\b[^>]*>.*?(?:</\1\s*>|\Z)"""
    r"""|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+|[^>]*)>""",
    re.S | re.I,
)
_ATTR = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split()
)
EXCLUDED = frozenset("head nav footer aside form button select option fieldset dialog menu object audio video canvas map".split())
CLOSES = {
    "p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"},
}
NO_P = frozenset(
    "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split()
)
HOLDERS = frozenset("article main body div section td ul ol table blockquote nav aside footer header form html".split())

_WORDS = (
    r"ads?|adverts?|advertisement|advertising|adsense|sponsored|sponsors?|promos?|promotion|banners?|cookies?|consent|gdpr|notices?|alerts?|sidebars?|menus?|nav|navbar|"
    r"navigation|breadcrumbs?|footer|header|masthead|comments?|commentlist|repl(?:y|ies)|discussion|disqus|share|sharing|social|related|recommended|newsletter|"
    r"subscribe|signup|login|popup|modal|overlay|widgets?|search|pagination|pager|toolbar|copyright|disclaimer"
)
#: A class or id that is such a word, alone or with words for places and boxes around it ("site-header", "comments-list"), but not within others ("search-engine").
_BAD = re.compile(
    rf"(?:(?:site|page|main|global|top|bottom|left|right|post|article|entry|content|user|reader|the|js)[_-])*(?:{_WORDS})"
    rf"(?:[_-](?:{_WORDS}|bar|box|block|section|area|list|links?|buttons?|form|wrap|wrapper|container|inner|outer|panel|item|unit|slot|text|content|top|bottom|left|right|[0-9]+))*",
    re.I,
)


def _marks(attrs: str) -> tuple[str, dict[str, str]]:
    found = {m[0].lower(): m[1] or m[2] or m[3] for m in _ATTR.findall(attrs)} if attrs else {}
    return (" ".join(found.get("class", "").split()), found)


def blocks(page: str | None) -> list[tuple[tuple[str, ...], str, bool]]:
    """(path, text, excluded) of every text block of a page, in order."""
    if not page:
        return []
    out: list[tuple[tuple[str, ...], str, bool]] = []
    stack: list[tuple[str, tuple[str, ...], bool, bool]] = [("", (), False, False)]  # tag, path, excluded, within an article
    held: list[str] = []

    def flush():
        if held:
            text = " ".join(_html.unescape("".join(held)).split())
            held.clear()
            if text:
                out.append((stack[-1][1], text, stack[-1][2]))

    def pop(tag: str) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] == tag:
                flush()
                del stack[i:]
                return

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            held.append(page[at : m.start()])
        at = m.end()
        tag = m[3]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in INLINE:
            continue
        if tag in ("br", "wbr"):
            held.append(" ")
            continue
        if m[2]:
            pop(tag)
            flush()
            continue
        flush()
        if tag in VOID:
            continue
        closing = CLOSES.get(tag) or ({"p"} if tag in NO_P else ())
        while len(stack) > 1 and stack[-1][0] in closing:
            stack.pop()
        _, path, bad, article = stack[-1]
        name, found = _marks(m[4])
        bad = bad or tag in EXCLUDED or tag == "header" and not article
        if not bad and tag not in ("article", "main", "body", "html"):
            role = found.get("role", "").lower()
            bad = any(map(_BAD.fullmatch, [*name.split(), *found.get("id", "").split()]))
            bad = bad or role in ("navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert")
        key = f"{tag}.{name}" if name else tag
        stack.append((tag, (*path, key) if len(path) < DEEP else path, bad, article or tag in ("article", "main")))
    held.append(page[at:] if "<" not in page[at:] else re.sub(r"<[^>]*\Z", "", page[at:]))
    flush()
    return out


# --- wrappers ----------------------------------------------------------------


class Node:
    """A token of a wrapper or a page: an element with children, or a text slot (key ``#``) with the places of its texts in the page."""

    __slots__ = ("key", "kids", "text", "places", "pages", "optional", "repeated", "chars", "bad", "main")

    def __init__(self, key: str, text: str | None = None, place: int | None = None, bad: bool = False):
        self.key, self.kids, self.text, self.bad, self.main = key, [], text, bad, False
        self.places = [] if place is None else [place]
        self.pages, self.optional, self.repeated, self.chars = 1, False, False, len(text or "")

    @property
    def tag(self) -> str:
        return self.key.split(".", 1)[0]

    def regex(self) -> str:
        body = "#PCDATA" if self.key == "#" and self.text is None else repr(self.text) if self.key == "#" else f"<{self.key}>{''.join(k.regex() for k in self.kids)}</>"
        return f"({body})+" if self.repeated else f"({body})?" if self.optional else body

    def packed(self) -> list:
        """[key, 1 optional + 2 repeated + 4 main, children or text]; a variable slot's text is null."""
        flags = self.optional + 2 * self.repeated + 4 * self.main
        return [self.key, flags, self.text if self.key == "#" else [k.packed() for k in self.kids]]

    def state(self) -> list:
        """What ``merge`` and ``finish`` need: [key, 1 optional + 2 repeated + 4 excluded, children], or a slot's text and its characters."""
        flags = self.optional + 2 * self.repeated + 4 * self.bad
        if self.key != "#":
            return [self.key, flags, [k.state() for k in self.kids]]
        text = self.text
        if text is not None and len(text) > SHORT:
            text = hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()  # longer than SHORT too, so once only
        return [self.key, flags, text, self.chars]

    @staticmethod
    def restored(row: list) -> Node:
        node = Node(row[0], bad=bool(row[1] & 4))
        node.optional, node.repeated = bool(row[1] & 1), bool(row[1] & 2)
        if row[0] == "#":
            node.text, node.chars = row[2:]
        else:
            node.kids = [Node.restored(r) for r in row[2]]
        return node

    @staticmethod
    def unpacked(row: list) -> Node:
        key, flags, rest = row
        node = Node(key, rest if key == "#" else None)
        node.optional, node.repeated, node.main = bool(flags & 1), bool(flags & 2), bool(flags & 4)
        if key != "#":
            node.kids = [Node.unpacked(r) for r in rest]
        return node


def tree(rows: list[tuple[tuple[str, ...], str, bool]]) -> Node:
    """The token tree of a page's blocks, equal siblings folded."""
    root = Node("root")
    open_ = [root]
    path: tuple[str, ...] = ()
    for place, (where, text, bad) in enumerate(rows):
        same = 0
        while same < min(len(path), len(where)) and path[same] == where[same]:
            same += 1
        if same == len(where) and same == len(path) and same and where[-1].split(".")[0] not in HOLDERS:
            same -= 1  # the same path again: a sibling, unless the element holds several blocks
        del open_[same + 1 :]
        for key in where[same:]:
            node = Node(key)
            open_[-1].kids.append(node)
            open_.append(node)
        open_[-1].kids.append(Node("#", text, place, bad))
        path = where
    return fold(root)


def fold(node: Node) -> Node:
    """Runs of equal siblings, or of equal pairs or triples of siblings, become repeated groups."""
    kids = [fold(k) for k in node.kids]
    for period in (1, 2, 3):
        i, out = 0, []
        while i < len(kids):
            out += kids[i : i + period]
            j = i + period
            while j + period <= len(kids) and [k.key for k in kids[j : j + period]] == [k.key for k in kids[i : i + period]]:
                for a, b in zip(out[-period:], kids[j : j + period]):
                    merge(a, b)
                    a.repeated = True
                j += period
            if j == i + period:
                del out[len(out) - min(period, len(kids) - i) :]
                out.append(kids[i])
                i += 1
            else:
                i = j
        kids = out
    node.kids = kids
    return node


def align(x: list[str], y: list[str]) -> list[tuple[int, int]]:
    """Pairs of equal places of two sequences, in order."""
    head = 0
    while head < min(len(x), len(y)) and x[head] == y[head]:
        head += 1
    tail = 0
    while tail < min(len(x), len(y)) - head and x[-1 - tail] == y[-1 - tail]:
        tail += 1
    out = [(i, i) for i in range(head)]
    a, b = x[head : len(x) - tail], y[head : len(y) - tail]
    ia, ib = range(head, head + len(a)), range(head, head + len(b))
    if len(a) * len(b) > ALIGN:  # what only one side has is left out first
        both = set(a) & set(b)
        ia, ib = [i for i in ia if x[i] in both], [j for j in ib if y[j] in both]
        a, b = [x[i] for i in ia], [y[j] for j in ib]
    if len(a) * len(b) > ALIGN:
        for m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks():
            out += [(ia[m.a + k], ib[m.b + k]) for k in range(m.size)]
    elif a and b:
        n, m = len(a), len(b)
        length = [[0] * (m + 1) for _ in range(n + 1)]
        for i in range(n - 1, -1, -1):
            for j in range(m - 1, -1, -1):
                length[i][j] = length[i + 1][j + 1] + 1 if a[i] == b[j] else max(length[i + 1][j], length[i][j + 1])
        i = j = 0
        while i < n and j < m:
            if a[i] == b[j]:
                out.append((ia[i], ib[j]))
                i, j = i + 1, j + 1
            elif length[i + 1][j] >= length[i][j + 1]:
                i += 1
            else:
                j += 1
    return out + [(len(x) - k, len(y) - k) for k in range(tail, 0, -1)]


def merge(a: Node, b: Node) -> Node:
    """Align ``b`` with the wrapper ``a``, in place."""
    a.chars += b.chars
    a.repeated |= b.repeated
    a.optional |= b.optional
    a.bad &= b.bad
    if a.key == "#":
        a.places += b.places
        a.text = a.text if a.text == b.text else None
        return a
    out, i, j = [], 0, 0
    for p, q in [*align([k.key for k in a.kids], [k.key for k in b.kids]), (len(a.kids), len(b.kids))]:
        for k in (*a.kids[i:p], *b.kids[j:q]):
            k.optional = True
            out.append(k)
        if p < len(a.kids):
            a.kids[p].pages += b.kids[q].pages
            out.append(merge(a.kids[p], b.kids[q]))
        i, j = p + 1, q + 1
    a.kids = out
    return a


def infer(pages: list[str | None]) -> list | None:
    """The wrapper of a host's pages, packed, with its main region marked; None without a page that has text."""
    distinct = [rows for rows in map(blocks, sorted({p for p in pages if p})) if rows]
    if not distinct:
        return None
    w = tree(distinct[0])
    for rows in distinct[1:]:
        merge(w, tree(rows))
    return finish(w, len(distinct))


def finish(w: Node, pages: int) -> list:
    """The wrapper ``w`` of so many different pages, packed, with its main region marked."""
    by_tag: dict[str, list[Node]] = {"article": [], "main": []}
    weight: dict[int, tuple[int, Node]] = {}

    def walk(node: Node, holder: Node) -> bool:
        """Whether anything under ``node`` is not excluded; collects regions and the variable text of each holder."""
        holder = node if node.tag in HOLDERS else holder
        fine = False
        for k in node.kids:
            if k.key != "#":
                fine |= walk(k, holder)
            elif not k.bad:
                fine = True
                if k.text is None or pages == 1:
                    weight[id(holder)] = (weight.get(id(holder), (0, holder))[0] + k.chars, holder)
        if fine and node.tag in by_tag:
            by_tag[node.tag].append(node)
        return fine

    walk(w, w)
    heaviest = max(weight.values(), key=lambda x: x[0])[1:] if weight else ()

    def mark(node: Node) -> None:
        node.main = True
        for k in node.kids:
            mark(k)

    for node in by_tag["article"] or by_tag["main"] or heaviest:
        mark(node)
    return w.packed()


def read(rows: list[tuple[tuple[str, ...], str, bool]], wrapper: Node) -> list[int]:
    """Places of the blocks that stand in the wrapper's main region."""
    out: list[int] = []

    def all_of(node: Node) -> None:
        out.extend(node.places)
        for k in node.kids:
            all_of(k)

    def match(w: Node, page: Node) -> None:
        pairs = dict((q, p) for p, q in align([k.key for k in w.kids], [k.key for k in page.kids]))
        for q, k in enumerate(page.kids):
            if q not in pairs:
                if w.main:
                    all_of(k)
            elif k.key != "#":
                match(w.kids[pairs[q]], k)
            elif w.kids[pairs[q]].main:
                out.extend(k.places)

    match(wrapper, tree(rows))
    return sorted(i for i in out if not rows[i][2])


def extract(page: str | None, wrapper: Node | None = None) -> str:
    """The main text of a page, matched with its host's wrapper."""
    rows = blocks(page)
    main = [rows[i][1] for i in read(rows, wrapper)] if wrapper is not None else []
    if not main:
        fine = [(p, t) for p, t, bad in rows if not bad]
        for tag in ("article", "main"):
            main = main or [t for p, t in fine if any(k.split(".", 1)[0] == tag for k in p)]
        main = main or [t for _, t in fine]
    return "\n\n".join(main)


# --- Spark -------------------------------------------------------------------


def with_host(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1))
    return pages.withColumn("__host", host)


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper as JSON) of every host that has text; every different page of it is aligned."""
    rows = with_host(pages).where("html is not null").select("__host", F.md5(F.col("html").cast("binary")).alias("__h"), "html")

    def trees(batches):
        for b in batches:
            found = [blocks(page.as_py()) for page in b.column(2)]
            packed = [json.dumps(tree(f).state(), separators=(",", ":"), ensure_ascii=False) if f else None for f in found]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(packed, pa.string())], ["__host", "__h", "tree"])

    def aligned(batches):
        """Trees in the order of host, part and hash to one of each part, under its first hash."""
        at, held, size = None, None, 0
        for b in batches:
            out = []
            for host, part, h, packed, n in zip(*(c.to_pylist() for c in b.columns)):
                node = Node.restored(json.loads(packed))
                if at is not None and at[:2] == (host, part):
                    held, size = merge(held, node), size + n
                    continue
                if at is not None:
                    out.append((*at, held, size))
                at, held, size = (host, part, h), node, n
            yield _parts(out)
        yield _parts([(*at, held, size)] if at is not None else [])

    def finished(batches):
        for b in batches:
            done = [json.dumps(finish(Node.restored(json.loads(t)), n)) for t, n in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(done, pa.string())], ["__host", "wrapper"])

    level = schema(__host=STR, __part=LONG, __h=STR, tree=STR, n=LONG)
    made = rows.mapInArrow(trees, schema(__host=STR, __h=STR, tree=STR)).where("tree is not null")
    made = materialize(made.groupBy("__host", "__h").agg(F.min("tree").alias("tree")), "html-trees")
    hosts = made.groupBy("__host").agg(F.ceil(F.count(F.lit(1)) / PART).alias("__parts"))
    hosts = materialize(hosts, "html-hosts")
    most = hosts.agg(F.max("__parts")).first()[0] or 1
    todo = made.join(small_or_plain(hosts, hosts.count(), HOSTS), "__host")
    todo = todo.select("__host", F.pmod(F.xxhash64("__h"), "__parts").alias("__part"), "__h", "tree", F.lit(1).cast("long").alias("n"))
    while True:
        todo = todo.repartition("__host", "__part").sortWithinPartitions("__host", "__part", "__h").mapInArrow(aligned, level)
        todo = materialize(todo, "html-parts")
        if most <= 1:
            return materialize(todo.select("__host", "tree", "n").mapInArrow(finished, schema(__host=STR, wrapper=STR)), "html-wrappers")
        todo, most = todo.withColumn("__part", F.floor(F.col("__part") / PART)), -(-most // PART)


def _parts(rows: list[tuple]) -> pa.RecordBatch:
    host, part, h, held, n = zip(*rows) if rows else ([],) * 5
    packed = [json.dumps(w.state(), separators=(",", ":"), ensure_ascii=False) for w in held]
    arrays = [pa.array(host, pa.string()), pa.array(part, pa.int64()), pa.array(h, pa.string()), pa.array(packed, pa.string()), pa.array(n, pa.int64())]
    return pa.RecordBatch.from_arrays(arrays, ["__host", "__part", "__h", "tree", "n"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    pages = pages.select("page_id", "url", "html")
    learned = wrappers(pages)
    size = learned.agg(F.sum(F.length("wrapper") + F.length("__host"))).first()[0] or 0
    side = F.broadcast(learned) if size <= WRAPPERS else learned
    rows = with_host(pages).join(side, "__host", "left").select("page_id", "url", "html", "wrapper", "__host")
    out = T.StructType([pages.schema["page_id"], pages.schema["url"], T.StructField("text", STR), T.StructField("n_chars", LONG)])

    def local(batches):
        known: dict[str, Node] = {}
        held = 0
        for b in batches:
            texts = []
            for page, w, host in zip(b.column(2), b.column(3), b.column(4).to_pylist()):
                if w.is_valid and host not in known:
                    packed = w.as_py()
                    if held + len(packed) > KNOWN:
                        known.clear()
                        held = 0
                    known[host] = Node.unpacked(json.loads(packed))
                    held += len(packed)
                texts.append(extract(page.as_py(), known.get(host)))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], out.fieldNames()
            )

    return rows.mapInArrow(local, out)


def op2_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract_pages(read_table(spark, sf_dir, "pages"))
