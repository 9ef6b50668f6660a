"""Mixing sources to target weights by Pfair scheduling.

A source of weight w (weights add up to 1) owes its k-th block, k = 1, 2, ..., between the
release floor((k - 1) / w) and the deadline ceil(k / w). One block is served a slot: of
the sources whose next block is released, the one with the earliest deadline. On one
server this earliest-deadline-first order is optimal, so at every slot each source is
within one block of its share w * t.

Weights are exact: whole numbers a_i that add up to P, so the order repeats every P slots.
There are two ways to the same slots. If sources * P is small, one period of each phase
is scheduled on the driver (`phases`), and block k of a source stands at slot (k div a_i)
* P + the slot of block k mod a_i. Else a task serves block after block (`serve`), holds a
few numbers a source, and writes a table of slots that is joined with the rows. Rows
are placed by their rank in the source."""

from __future__ import annotations

import bisect
import heapq
import math
from fractions import Fraction

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stash, aside, back, tune
from .ranks import hash63, ranked

PERIOD = 1000
BLOCK = 8
TEMPER, STOP = 0.7, 1.0
#: Numbers that the driver schedules and broadcasts at most, sources * period * phases; 8 MB.
PLAN = 1_000_000
#: Sources whose counts the driver reads.
SOURCES = 1000


def integer_weights(weights: dict, period: int = PERIOD) -> tuple[dict, int]:
    """Weights as whole numbers that add up to the period, by largest remainder, at least
    one each. The period is at least four times the number of sources."""
    period = max(period, 4 * len(weights))
    total = sum(Fraction(w) for w in weights.values())
    exact = {s: Fraction(w) * period / total for s, w in weights.items()}
    out = {s: max(1, int(x)) for s, x in exact.items()}
    order = sorted(exact, key=lambda s: (out[s] - exact[s], s))
    while (left := period - sum(out.values())) > 0:
        for s in order[:left]:
            out[s] += 1
    while (left := sum(out.values()) - period) > 0:
        for s in sorted((s for s in out if out[s] > 1), key=lambda s: (exact[s] - out[s], s))[:left]:
            out[s] -= 1
    return out, period


def schedule(parts: dict, period: int) -> list:
    """The source served at each slot of one period: earliest deadline first among the
    released blocks; ties go to the smaller name."""
    release = [(0, s, 0) for s in parts]
    heapq.heapify(release)
    ready, out = [], []
    for t in range(period):
        while release and release[0][0] <= t:
            _, s, k = heapq.heappop(release)
            heapq.heappush(ready, (-(-(k + 1) * period // parts[s]), s, k))
        _, s, k = heapq.heappop(ready)
        out.append(s)
        if k + 1 < parts[s]:
            heapq.heappush(release, ((k + 1) * period // parts[s], s, k + 1))
    return out


def exact_weights(weights: dict) -> tuple[dict, int]:
    """The smallest whole numbers in the weights' proportions, and their sum."""
    exact = {s: Fraction(w) for s, w in weights.items()}
    base = math.lcm(*(x.denominator for x in exact.values()))
    parts = {s: int(x * base) for s, x in exact.items()}
    common = math.gcd(*parts.values())
    parts = {s: a // common for s, a in parts.items()}
    return parts, sum(parts.values())


def as_written(weight) -> Fraction:
    """A weight as its decimal digits say: 0.1 is a tenth."""
    out = Fraction(str(weight)) if isinstance(weight, float) else Fraction(weight)
    if out < 0:
        raise ValueError(f"a weight below zero: {weight}")
    return out


def targets(counts: dict, weights: dict | None, temper: float, period: int) -> dict:
    """The target weight of each source that has one: what is given, or else the row count to
    the power `temper`, in whole parts of `period` (of four times the sources if that is
    more), one at least."""
    if weights is None:
        return integer_weights({s: n**temper for s, n in counts.items()}, period)[0] if counts else {}
    return {s: w for s, x in weights.items() if (w := as_written(x))}


def serve(have: dict, target: dict, stop: float):
    """(source, block, slot) of every block in order: the slots of `phases`, one after another."""
    left = {s: n for s, n in have.items() if n and s in target}
    total, gone = sum(target.values()), sum(w for s, w in target.items() if not have.get(s))
    first, slot = dict.fromkeys(left, 0), 0
    while left and (stop >= 1 or gone <= stop * total):
        parts, period = exact_weights({s: target[s] for s in left})
        release = [(0, s, 0) for s in parts]
        heapq.heapify(release)
        ready, done, t = [], dict.fromkeys(parts, 0), 0
        while True:
            while release and release[0][0] <= t:
                _, s, k = heapq.heappop(release)
                heapq.heappush(ready, (-(-(k + 1) * period // parts[s]), s, k))
            _, s, k = heapq.heappop(ready)
            if k == left[s]:
                break
            yield s, first[s] + k, slot + t
            done[s] = k + 1
            heapq.heappush(release, ((k + 1) * period // parts[s], s, k + 1))
            t += 1
        slot += t
        for s, n in done.items():
            first[s] += n
            left[s] -= n
            if not left[s]:
                del left[s]
                gone += target[s]


def phases(have: dict, target: dict, stop: float, plan: int = PLAN) -> list[dict] | None:
    """Blocks of each source (have) laid out in phases of constant weights. A phase ends at
    the first slot whose source has no block left; sources without blocks leave, and the
    others go on with their weights scaled up. The mix ends when sources of more than
    `stop` of the target weight have left. A phase: slot (its first), length, period,
    parts, slots (of each source in a period), first (each source's first block). None if
    that takes more than `plan` numbers."""
    left = {s: n for s, n in have.items() if n and s in target}
    total, gone = sum(target.values()), sum(w for s, w in target.items() if not have.get(s))
    first, slot, out = dict.fromkeys(left, 0), 0, []
    while left and (stop >= 1 or gone <= stop * total):
        parts, period = exact_weights({s: target[s] for s in left})
        plan -= period
        if plan < 0:
            return None
        slots = {}
        for t, s in enumerate(schedule(parts, period)):
            slots.setdefault(s, []).append(t)
        length = min(n // parts[s] * period + slots[s][n % parts[s]] for s, n in left.items())
        out.append({"slot": slot, "length": length, "period": period, "parts": parts, "slots": slots, "first": dict(first)})
        for s in list(left):
            n = length // period * parts[s] + bisect.bisect_left(slots[s], length % period)
            left[s] -= n
            first[s] += n
            if not left[s]:
                del left[s]
                gone += target[s]
        slot += length
    return out


def _slots_of_plan(spark: SparkSession, d: DataFrame, laid: list[dict]) -> DataFrame:
    rows = [
        (s, p["first"][s], p["first"][s] + p["length"] // p["period"] * a + bisect.bisect_left(p["slots"][s], p["length"] % p["period"]), p["slot"], p["period"], a, p["slots"][s])
        for p in laid for s, a in p["parts"].items()
    ]
    plan = spark.createDataFrame(rows, "__s string, b long, e long, slot long, period long, a long, slots array<long>")
    plan = plan.where("b < e").groupBy("__s").agg(F.collect_list(F.struct("b", "e", "slot", "period", "a", "slots")).alias("__plan"))
    out = d.join(F.broadcast(plan), "__s", "left")  # PLAN numbers at most
    out = out.withColumn("__p", F.get(F.filter("__plan", lambda p: (p.b <= F.col("__k")) & (F.col("__k") < p.e)), 0))
    n = F.col("__k") - F.col("__p.b")
    return out.withColumn("mix_slot", F.col("__p.slot") + F.floor(n / F.col("__p.a")) * F.col("__p.period") + F.get(F.col("__p.slots"), F.pmod(n, F.col("__p.a")).cast("int")))


def _slots_of_server(spark: SparkSession, d: DataFrame, counts: DataFrame, rule) -> DataFrame:
    """`d` with mix_slot, from a table of all blocks' slots that one task writes in order."""
    block, weights, temper, period, stop = rule

    def run(frames):
        n = {s: int(k) for pdf in frames for s, k in zip(pdf["__s"], pdf["n"])}
        have, out = {s: -(-k // block) for s, k in n.items()}, []
        for row in serve(have, targets(n, weights, temper, period), stop):
            out.append(row)
            if len(out) == 100_000:
                yield pd.DataFrame(out, columns=["__s", "__k", "mix_slot"])
                out = []
        yield pd.DataFrame(out, columns=["__s", "__k", "mix_slot"])

    table = Stash(spark).put(counts.repartition(1).mapInPandas(run, "__s string, __k long, mix_slot long"), "slots")
    return d.join(table, ["__s", "__k"], "left")


def mix(spark: SparkSession, docs: DataFrame, weights: dict | None = None, *, source_col: str = "source", id_col: str = "doc_id", period: int = PERIOD, block: int = BLOCK, temper: float = TEMPER, stop: float = STOP, plan: int = PLAN) -> DataFrame:
    """`docs` with mix_rank (rank in the source), mix_slot (block slot), mix_position (row
    position in the mix) and in_mix.

    weights: the exact target of each source (a float counts as its decimal digits say);
    sources without one are not in the mix. By default `targets` makes them of the row
    counts: whole parts of `period`, which are then the exact targets. A source that runs
    out leaves the mix, and the others keep their proportions (`phases`); the mix ends when
    sources of more than `stop` of the weight have left, with 1 when all rows of weighted
    sources are served. The rows beyond that end are what the targets leave over: in_mix
    is false, slot and position are null, and they are returned too. A source's last block
    may be short.

    There may be any number of sources. Beyond SOURCES of them, or `plan` numbers of a
    schedule, one task serves the blocks in order; it takes time by the number of blocks
    and, for phases, by the square of the number of sources that leave one by one.

    A null source counts as the empty name. Rows of a source are served in order of the hash
    of their id; rows that repeat an id, and rows without one, are rows like any, next to
    their likes in the order. Columns of `docs` with the four names are replaced; all
    others are kept, whatever their names. An empty table gives no rows."""
    d = aside(docs, source_col, id_col).withColumn("__s", F.coalesce(F.col(source_col).cast("string"), F.lit("")))
    counts = d.groupBy("__s").agg(F.count(F.lit(1)).alias("n"))
    few = counts.limit(SOURCES + 1).collect()
    laid = None
    if len(few) <= SOURCES:
        n = {r["__s"]: r["n"] for r in few}
        laid = phases({s: -(-k // block) for s, k in n.items()}, targets(n, weights, temper, period), stop, plan)
    out = ranked(d, ["__s"], hash63(id_col), [id_col], "mix_rank").withColumn("__k", F.floor(F.col("mix_rank") / block))
    out = _slots_of_server(spark, out, counts, (block, weights, temper, period, stop)) if laid is None else _slots_of_plan(spark, out, laid)
    out = out.withColumn("mix_position", F.col("mix_slot") * block + F.pmod("mix_rank", F.lit(block))).withColumn("in_mix", F.col("mix_slot").isNotNull())
    return back(out, docs, (source_col, id_col), ("mix_rank", "mix_slot", "mix_position", "in_mix"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return mix(spark, spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source"))
