"""Plain versions of the operators, in Python objects, that tests hold the Spark ones against."""

import re
import statistics
from collections import Counter

import numpy as np

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed: int, n: int) -> str:
    rng = np.random.default_rng(seed)
    return " ".join(WORDS[i] + str(rng.integers(0, 50)) for i in rng.integers(0, len(WORDS), n))


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def linked(texts, k, num):
    """The set of each text and the smallest place it is linked with."""
    sets = []
    for t in texts:
        w = words(lower(t))
        n = min(k, len(w))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set())
    root = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= num * len(a | b):
                x, y = root[i], root[j]
                root = [min(x, y) if r in (x, y) else r for r in root]
    return sets, root


def kneser_ney(texts):
    """p(third | two before) by dictionaries: interpolated modified Kneser-Ney over 128 symbols, as a function of a trigram."""
    from collections import Counter

    grams = Counter(g for t in texts for g in zip([0, 0, *t], [0, *t], t))

    def level(counts, lower):
        n = [sum(c == k for c in counts.values()) or 1 for k in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1])
        d = [1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]]
        d = [min(max(x, 0.05), top) for x, top in zip(d, (0.95, 1.9, 2.8))]
        total, held = Counter(), Counter()
        for g, c in counts.items():
            total[g[:-1]] += c
            held[g[:-1]] += min(d[min(c, 3) - 1], c)

        def p(g):
            if g[:-1] not in total:
                return lower(g[1:])
            c = counts.get(g, 0)
            return (c - min(d[min(c, 3) - 1], c) if c else 0) / total[g[:-1]] + held[g[:-1]] / total[g[:-1]] * lower(g[1:])

        return p

    pairs = Counter(g[1:] for g in grams)
    ends = Counter(g[1:] for g in pairs)
    one = lambda g: (0.5 + ends.get(g, 0)) / (64 + sum(ends.values()))
    return level(grams, level(pairs, one))


def base_failed(text):
    w = words(text)
    tri = [tuple(w[j : j + 3]) for j in range(len(w) - 2)]
    n = Counter(tri)
    repeat = {j + k for j, x in enumerate(tri) if n[x] > 1 for k in range(3)}
    return len(w) < 50 or 100 * len(repeat) > 50 * len(w)


def plain(text):
    """Characters without case, white space as a blank, digits as 0."""
    return [0x30 if c.isdigit() else 0x20 if c.isspace() and c != "\n" else ord(c.lower()) if len(c.lower()) == 1 else ord(c) for c in text or ""]


def quality_of(rows, least):
    """Of rows (text, lang): scores (typical passage, whole text) by place, and which are kept; languages of under ``least`` rows are one."""
    n = Counter("und" if lang is None else lang for _, lang in rows)
    name = [lang if n[lang] >= least else "" for lang in ("und" if lang is None else lang for _, lang in rows)]
    scores, kept = {}, {}
    for model in set(name):
        at = [i for i, x in enumerate(name) if x == model]
        texts = [plain(rows[i][0]) for i in at]
        seen = Counter(c for t in texts for c in t)
        own = {c: i + 1 for i, c in enumerate(sorted(seen, key=lambda c: (-seen[c], c))[:100])}
        coded = [[own.get(c, 101 + c % 27) for c in t] for t in texts]
        p = kneser_ney(coded)
        for i, t in zip(at, coded):
            logs = [-np.log10(p(g)) for g in zip([0, 0, *t], [0, *t], t)]
            if logs:
                cut = np.linspace(0, len(logs), max(1, len(logs) // 50) + 1).astype(int)
                scores[i] = statistics.median([np.mean(logs[a:b]) for a, b in zip(cut, cut[1:])]), np.mean(logs)
        judged = [i for i in at if i in scores and not base_failed(rows[i][0])]
        limits = []
        for k, (wide, floor) in enumerate(((5, 0.04), (16, 0.16))):
            x = sorted(round(scores[i][k], 3) for i in judged)
            mid = x[(len(x) - 1) // 2] if x else 0
            limits.append((mid, max(wide * 1.4826 * sorted(abs(v - mid) for v in x)[(len(x) - 1) // 2], floor) if x else 0))
        for i in at:
            kept[i] = i in judged and all(abs(scores[i][k] - mid) <= half for k, (mid, half) in enumerate(limits))
    return scores, kept


def line_dedup(rows):
    """Texts of rows {id: text} without lines of three-line windows that occur earlier."""
    seen, cover = set(), {}
    for i in sorted(rows):
        lines = rows[i].split("\n")
        for p in range(len(lines) - 2):
            w = tuple(lines[p : p + 3])
            if "".join(w).strip():
                if w in seen:
                    cover.setdefault(i, set()).update((p, p + 1, p + 2))
                seen.add(w)
    return {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in cover.get(i, ())) for i, t in rows.items()}


def contains(text, item, k=5):
    q, w = words(lower(item)), words(lower(text))
    n = min(k, len(q))
    have = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
    want = {tuple(q[i : i + n]) for i in range(len(q) - n + 1)} if n else set()
    return bool(want) and 5 * len(want & have) >= 4 * len(want)
