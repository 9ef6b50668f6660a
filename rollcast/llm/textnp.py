"""Vectorised text kernels shared by the operators: many texts are laid end to end
in one byte buffer, so hashing words, shingles and byte windows costs a few numpy
passes and no Python work per word."""

from __future__ import annotations

import numpy as np

np.seterr(over="ignore")  # hashes wrap modulo 2^64

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser: it spreads polynomial hashes over all bits."""
    x = np.asarray(x, U64)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def powers(n: int, base: int = _BASE) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        out = np.full(size, U64(base), U64)
        out[0] = 1
        have = _powers[base] = np.multiply.accumulate(out)
    return have[:n]


def batches(texts, most: int = 2 << 20):
    """Slices (start, stop) of a sequence of byte strings, of about `most` bytes each;
    a longer text is a slice of its own."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield start, i
            start, size = i, 0
        size += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


def encode(series) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    return [t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in series]


def lay(texts: list[bytes], sep: bytes = b" ") -> tuple[np.ndarray, np.ndarray]:
    """One buffer with a separator after each text, and where each text starts (n + 1 offsets)."""
    buf = np.frombuffer(sep.join(texts) + sep, np.uint8)
    lens = np.fromiter((len(t) + len(sep) for t in texts), np.int64, len(texts))
    return buf, np.concatenate([[0], np.cumsum(lens)])


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """P with P[j] - P[i] = base^i * hash(buf[i:j]), modulo 2^64: for windows of at most a few
    hundred bytes (of longer ones, some that are built alike have equal hashes)."""
    out = np.zeros(len(buf) + 1, U64)
    np.cumsum((buf.astype(U64) + U64(1)) * powers(len(buf)), out=out[1:])
    return out


def span_hash(p: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hash of buf[start:stop], the same wherever the bytes stand."""
    inv = powers(len(p), _INV)
    return mix((p[stop] - p[start]) * inv[start])


def block_hash(buf: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hash of buf[start:stop] of any length: the sum of a mixed value of each 8 bytes and
    their place. Unlike a polynomial modulo 2^64, it has no algebra by which words that are
    built alike (a Thue-Morse word and its complement) could meet."""
    n = (stop - start + 7) >> 3
    first = np.concatenate([[0], np.cumsum(n)])[:-1]
    j = np.arange(int(n.sum())) - np.repeat(first, n)
    at = np.repeat(start, n) + 8 * j
    data = np.concatenate([buf, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))[at]
    spare = np.maximum(0, at + 8 - np.repeat(stop, n)).astype(U64) * U64(8)  # bits behind the end
    v = mix((eight & (U64(0xFFFFFFFFFFFFFFFF) >> spare)) ^ mix(j.astype(U64) + U64(_BASE)))
    total = np.add.reduceat(v, first) if len(v) else np.zeros(0, U64)
    return mix(total + (stop - start).astype(U64))


P61 = (1 << 61) - 1
_BASE61 = 0x9E3779B97F4A7C15 % P61
_powers61: dict[int, np.ndarray] = {}


def mulmod61(a, b) -> np.ndarray:
    """a b modulo 2^61 - 1, of numbers below it."""
    a, b = np.asarray(a, U64), np.asarray(b, U64)
    m31, m30 = U64((1 << 31) - 1), U64((1 << 30) - 1)
    ah, al, bh, bl = a >> U64(31), a & m31, b >> U64(31), b & m31
    mid = ah * bl + al * bh
    x = ah * bh * U64(2) + (mid >> U64(30)) + ((mid & m30) << U64(31)) + al * bl
    x = (x & U64(P61)) + (x >> U64(61))
    return np.where(x >= U64(P61), x - U64(P61), x)


def powers61(n: int, base: int = _BASE61) -> np.ndarray:
    have = _powers61.get(base)
    if have is None or len(have) < n:
        have = np.ones(1, U64)
        while len(have) < max(n, 1 << 10):
            have = np.concatenate([have, mulmod61(have, U64(pow(base, len(have), P61)))])
        _powers61[base] = have
    return have[:n]


def prefix_hash61(values: np.ndarray) -> np.ndarray:
    """P with P[j] - P[i] = base^i * hash(values[i:j]), modulo 2^61 - 1: Karp-Rabin over
    64-bit values."""
    term = mulmod61(values % U64(P61), powers61(len(values)))
    low, high = np.cumsum(term & U64((1 << 31) - 1)), np.cumsum(term >> U64(31))
    out = np.zeros(len(values) + 1, U64)
    out[1:] = (mulmod61(high % U64(P61), U64(1 << 31)) + low % U64(P61)) % U64(P61)
    return out


def span_hash61(p: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    inv = powers61(len(p), pow(_BASE61, -1, P61))
    return mulmod61((p[stop] + U64(P61) - p[start]) % U64(P61), inv[start])


def words(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs without white space."""
    gap = SPACE[buf]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], gap, [True]]).astype(np.int8)))
    return edge[::2], edge[1::2]


def word_hashes(texts: list[bytes], lower: bool = True):
    """(hash, document index, start, end) of every word of the texts, in order."""
    buf, offs = lay(texts)
    if lower:
        buf = LOWER[buf]
    start, stop = words(buf)
    doc = np.searchsorted(offs, start, "right") - 1
    return block_hash(buf, start, stop), doc, start - offs[doc], stop - offs[doc]


def shingle_hashes(h: np.ndarray, doc: np.ndarray, n_docs: int, k: int = 5):
    """(hash, document, index of the first word) of k-word shingles. A document of fewer
    words has one shingle, the whole sequence."""
    count = np.bincount(doc, minlength=n_docs)
    n = len(h)
    first = np.concatenate([[0], np.cumsum(count)])[:-1]
    out = np.zeros(max(0, n - k + 1), U64)
    for j in range(k):
        out = mix(out + h[j : n - k + 1 + j]) if n >= k else out
    keep = np.flatnonzero(doc[: n - k + 1] == doc[k - 1 :]) if n >= k else np.zeros(0, np.int64)
    short = np.flatnonzero((count > 0) & (count < k))
    tails = np.zeros(len(short), U64)
    for i, d in enumerate(short):
        x = U64(0)
        for w in h[first[d] : first[d] + count[d]]:
            x = mix(x + w)
        tails[i] = mix(x + U64(count[d]))
    return np.concatenate([out[keep], tails]), np.concatenate([doc[keep], short]), np.concatenate([keep, first[short]])


def distinct_by_doc(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (hash, document), sorted by document, then hash."""
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[keep], doc[keep]


def shingle_sets(texts: list[bytes], k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Each text's set of shingle hashes: hashes sorted within the document, and n + 1 offsets."""
    h, doc, *_ = word_hashes(texts)
    s, d, _ = shingle_hashes(h, doc, len(texts), k)
    s, d = distinct_by_doc(s, d)
    return s, np.concatenate([[0], np.cumsum(np.bincount(d, minlength=len(texts)))])
