"""Shared kernels against plain Python."""

import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from rollcast.llm import textnp as X
from rollcast.llm.anchors import owned_windows

text = st.text("aAbB \n\té-1", max_size=60)


def words(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    return re.findall(r"[^\x20\x09-\x0D]+", low)


@settings(max_examples=60, deadline=None)
@given(st.lists(text, max_size=6), st.integers(1, 5))
def test_shingle_sets(texts, k):
    s, offs = X.shingle_sets([t.encode() for t in texts], k)
    want = []
    for t in texts:
        w = words(t)
        want.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    got = [set(s[a:b].tolist()) for a, b in zip(offs[:-1], offs[1:])]
    assert [len(g) for g in got] == [len(w) for w in want]
    for i in range(len(texts)):
        for j in range(i):
            assert len(got[i] & got[j]) == len(want[i] & want[j])


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text("ab", max_size=80), min_size=1, max_size=4), st.integers(6, 12))
def test_windows_are_owned_once_and_alike(texts, length):
    gram = 4
    raw = [t.encode() for t in texts]
    buf, offs = X.lay(raw, b"\0")
    key, first, last, anchor = owned_windows(buf, offs, length, gram)
    owner = {}
    for k, a, b, m in zip(key, first, last, anchor):
        for s in range(a, b + 1):
            assert s not in owner and s <= m <= s + length - gram
            owner[s] = (int(k), int(m - s))
    want = {offs[i] + j for i, t in enumerate(raw) for j in range(len(t) - length + 1)}
    assert set(owner) == want
    seen = {}
    for s, o in owner.items():
        assert seen.setdefault(bytes(buf[s : s + length]), o) == o


def test_span_hash_is_of_the_bytes():
    buf = np.frombuffer(b"abcabcab", np.uint8)
    p = X.prefix_hash(buf)
    h = X.span_hash(p, np.arange(6), np.arange(6) + 3)
    assert h[0] == h[3] and h[1] == h[4] and len(set(h.tolist())) == 3


def thue_morse(n, a, b):
    w, v = [a], [b]
    while len(w) < n:
        w, v = w + v, v + w
    return w, v


def test_words_that_are_built_alike_differ():
    for n in (64, 1024, 2048, 4096, 65536):
        pair = [b"".join(x) for x in thue_morse(n, b"a", b"b")]
        h = X.word_hashes([b" ".join(pair)])[0]
        assert h[0] != h[1]
        h = X.word_hashes([b" ".join([*pair, b"x" + pair[0], pair[0]])])[0]
        assert len(set(h.tolist())) == 3 and h[0] == h[3]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=40).map(lambda b: bytes(c | 0x80 for c in b)), min_size=1, max_size=8))
def test_block_hash_is_of_the_bytes(words_):
    h = X.word_hashes([b" ".join(words_), b"zz " + b" ".join(words_[::-1])], lower=False)[0].tolist()
    n = len(words_)
    assert h[:n] == h[n + 1 :][::-1] and len(set(h[:n])) == len(set(words_))


def test_karp_rabin_modulo_a_prime():
    rng = np.random.default_rng(0)
    a, b = (rng.integers(0, X.P61, 200, dtype=np.uint64) for _ in range(2))
    assert X.mulmod61(a, b).tolist() == [int(x) * int(y) % X.P61 for x, y in zip(a, b)]
    v = rng.integers(0, 2**64, 3000, dtype=np.uint64)
    p = X.prefix_hash61(np.concatenate([v, v]))
    at = np.arange(0, 2990, 7)
    assert (X.span_hash61(p, at, at + 10) == X.span_hash61(p, at + 3000, at + 3010)).all()
    assert len(set(X.span_hash61(p, at, at + 10).tolist())) == len(at)
    w, u = (np.array(x, np.uint64) for x in thue_morse(4096, 5, 2**63 + 11))
    p, q = X.prefix_hash61(w), X.prefix_hash61(u)
    assert p[-1] != q[-1]


def test_batches_cover_all():
    texts = [b"x" * n for n in (0, 5, 100, 3, 0, 7)]
    assert [i for a, b in X.batches(texts, 10) for i in range(a, b)] == list(range(6))
    assert list(X.batches([], 10)) == []
