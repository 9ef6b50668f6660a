"""Content-defined anchors: positions that any two equal windows of bytes share."""

from __future__ import annotations

import numpy as np

from . import textnp as X

_HALF = np.uint64(32)


def owned_windows(buf: np.ndarray, offs: np.ndarray, length: int, gram: int):
    """(key, first, last, anchor): each window of `length` bytes that lies in one text is
    owned by its minimizer, of its `gram`-byte strings the leftmost of the smallest hash;
    windows first to last (starts in the buffer) are owned by the string at `anchor`, whose
    hash is `key`. Equal windows have equal keys at equal offsets. Each text is followed
    by one separator byte; offs are the texts' starts and the end."""
    none = np.zeros(0, np.int64)
    n, w = len(buf) - gram + 1, length - gram + 1
    if n < w:
        return none.astype(np.uint64), none, none, none
    at = np.arange(n)
    h = X.span_hash(X.prefix_hash(buf), at, at + gram)
    best, span = (h >> _HALF << _HALF) | at.astype(np.uint64), 1
    while span * 2 <= w:  # best[i]: smallest of the span strings from i
        best = np.minimum(best[:-span], best[span:])
        span *= 2
    m = n - w + 1
    best = np.minimum(best[:m], best[w - span : w - span + m])
    lens = np.diff(offs) - 1
    long = lens >= length
    edge = np.zeros(m + 1, np.int8)
    np.add.at(edge, offs[:-1][long], 1)
    np.add.at(edge, (offs[:-1] + lens - length + 1)[long], -1)
    start = np.flatnonzero(np.cumsum(edge)[:m] > 0)
    if not len(start):
        return none.astype(np.uint64), none, none, none
    anchor = (best[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)]))
    last = start[np.append(new[1:], len(start)) - 1]
    return h[anchor[new]], start[new], last, anchor[new]
