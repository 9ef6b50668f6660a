"""Operators on whole texts and long mixes."""

import random
from fractions import Fraction

import numpy as np
import pytest

from rollcast.llm import mixing, paragraph_dedup


def test_copies_lose_all_their_words(spark):
    rng = random.Random(3)
    fresh = lambda n: " ".join(f"u{rng.randrange(10**6)}" for _ in range(n))
    texts = [fresh(n) for n in (12, 25, 30, 45, 60, 100, 101, 300) for _ in range(5)]
    line = fresh(40)
    rows = [(i, t) for i, t in enumerate(texts)] + [(100 + i, t) for i, t in enumerate(texts)]
    rows += [(200, fresh(80) + " " + line), (201, fresh(80) + " " + line), (202, line + " " + fresh(80)), (203, line + " " + fresh(80))]
    near = texts[-1].split()
    near[150] = "changed"
    rows.append((300, " ".join(near)))
    got = {r["id"]: r for r in paragraph_dedup.remove_near_passages(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i in range(len(texts)):
        assert got[i]["n_removed"] == 0  # nothing is lost but in the copy
        assert not bytes(got[100 + i]["kept"]).split()
    end, start = bytes(got[201]["kept"]).split(), bytes(got[203]["kept"]).split()
    assert end[-1] != line.split()[-1].encode() and start[0] != line.split()[0].encode()
    kept = bytes(got[300]["kept"]).decode().split()
    assert near[0] not in kept and near[-1] not in kept


def test_default_mix_serves_every_row(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"s{i % 19}") for i in range(3000)] + [(None, None)]
    got = mixing.mix(spark, spark.createDataFrame(rows, "doc_id long, source string")).toPandas()
    assert got["in_mix"].all() and got["mix_position"].is_unique and len(got) == len(rows)


@pytest.mark.parametrize("target", [{"a": 1, "b": 1, "c": 1}, {"a": 1e-5, "b": 0.3, "c": 0.69999}, {s: n**0.7 for s, n in (("a", 37), ("b", 50021), ("c", 91193), ("d", 7))}])
def test_mix_keeps_to_exact_targets(target):
    exact, have = mixing.targets({}, target, mixing.TEMPER, mixing.PERIOD), dict.fromkeys(target, 60000)
    slots = {s: [] for s in target}
    for s, k, slot in mixing.serve(have, exact, 0.0):
        assert k == len(slots[s])
        slots[s].append(slot)
    n, total = sum(map(len, slots.values())), sum(exact.values())
    assert n >= 60000
    for s, w in exact.items():
        got = np.cumsum(np.bincount(slots[s], minlength=n))
        assert np.abs(got - np.arange(1, n + 1) * float(w / total)).max() < 1 + 1e-6
    laid = mixing.phases(have, exact, 0.0)
    for p in (laid or [])[:1]:  # None: the schedule is beyond the plan, and the blocks are served in order
        assert p["length"] == n
        for s in exact:
            x = (np.array(p["slots"][s], np.int64)[None] + p["period"] * np.arange(n // p["period"] + 1)[:, None]).ravel()
            assert x[x < n].tolist() == slots[s]
