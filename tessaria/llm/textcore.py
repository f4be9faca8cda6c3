"""Vectorised word and shingle hashing over UTF-8 bytes.

A word's hash is a polynomial over a fixed 64-bit byte table, taken from
prefix sums modulo 2**64, so that no Python object is made per word.  Hashes
depend on nothing but the bytes: not on the process, hash seed or partition.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_MASK = (1 << 64) - 1


def _splitmix(n: int, seed: int) -> np.ndarray:
    out, x = [], seed
    for _ in range(n):
        x = (x + 0x9E3779B97F4A7C15) & _MASK
        z = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & _MASK
        out.append(z ^ (z >> 31))
    return np.array(out, dtype=U)


_BYTES = _splitmix(256, 11)
_P = 0xD6E8FEB86659FD93
_PINV = pow(_P, -1, 1 << 64)
_STEP = _splitmix(64, 5) | U(1)
_pow = np.ones(1, dtype=U)
_inv = np.ones(1, dtype=U)

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
NOT_SPACE = ~SPACE
#: Word bytes of the licence scan: digits, a-z and every non-ASCII byte.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n:
        size = max(n, 2 * len(_pow), 4096)
        with np.errstate(over="ignore"):
            p, q = np.full(size, _P, dtype=U), np.full(size, _PINV, dtype=U)
            p[0] = q[0] = 1
            _pow, _inv = np.multiply.accumulate(p), np.multiply.accumulate(q)
    return _pow, _inv


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(32))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(29))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(32))


def spans(buf: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes for which the table ``inside`` is true."""
    m = np.empty(len(buf) + 2, dtype=np.int8)
    m[0] = m[-1] = 0
    m[1:-1] = inside[buf]
    d = np.diff(m)
    return np.flatnonzero(d == 1), np.flatnonzero(d == -1)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span."""
    if not len(starts):
        return np.zeros(0, dtype=U)
    pw, iv = _powers(len(buf) + 1)
    with np.errstate(over="ignore"):
        c = np.zeros(len(buf) + 1, dtype=U)
        np.cumsum(_BYTES[buf] * pw[: len(buf)], out=c[1:])
        return mix((c[ends] - c[starts]) * iv[starts] + (ends - starts).astype(U) * U(_P))


def word_hashes(data: bytes, inside: np.ndarray = NOT_SPACE) -> np.ndarray:
    buf = np.frombuffer(data, dtype=np.uint8)
    return span_hashes(buf, *spans(buf, inside))


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-word shingles in order; fewer words make one shingle of the whole sequence; none, none."""
    n = len(words)
    if n == 0:
        return np.zeros(0, dtype=U)
    w = min(k, n)
    with np.errstate(over="ignore"):
        a = np.full(n - w + 1, w, dtype=U)
        for j in range(w):
            a += words[j : j + n - w + 1] * _STEP[j]
    return mix(a)


def as_bytes(text) -> bytes:
    """UTF-8 of a text; null is empty; A-Z untouched."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def pick(cuts: list, at: np.ndarray) -> list[bytes]:
    """The bytes of spans ``at``, counted through all ``cuts`` of (buf, starts, ends)."""
    ends = np.cumsum([len(c[1]) for c in cuts])
    doc = np.searchsorted(ends, at, side="right")
    off = at - np.concatenate(([0], ends))[doc]
    out = []
    for d, o in zip(doc.tolist(), off.tolist()):
        buf, s, e = cuts[d]
        out.append(buf[s[o] : e[o]].tobytes())
    return out
