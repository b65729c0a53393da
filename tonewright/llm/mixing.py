"""Mixing sources to target weights by Pfair scheduling.

A source of weight w is a task that is due one block every 1/w slots: its block number k may not come
before slot ``floor(k / w)`` and has to come before slot ``ceil((k + 1) / w)``. Each slot takes, among
the blocks that may come, the one with the earliest deadline. So after any number of slots a source
is less than one block away from its share. Weights are taken as exact fractions, never rounded, and the schedule
is laid out to its end.

Segments of the schedule are placed in Spark, each on its own. What they need is where each source stands
at their ends: its share rounded down or up. ``advance`` finds that without placing a block. Blocks due by
the end of a segment have to be in it; of those that may come, the ones with the earliest deadlines are in it, as
far as the slots after their releases hold them (nested sets, so the best choice is made from the last
release to the first).

Every document is used. A source that ends before the others starts again, so weights hold to the end; the
mixture ends when every source has been used up at least once. A given weight that is far too small for its
source makes a long mixture: about the source's blocks divided by its weight.

Nulls and odd input: a null source is a source of its own; a null text counts as no bytes; an empty table
gives an empty result; equal rows are placed one by one; extra columns don't matter, and columns named
like the result are replaced.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator, Mapping, Sequence
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tonewright.llm.common import checkpoint, running_total

PERIOD = 4096
SEGMENT = 4096
BLOCK_BYTES = 1 << 16
TEMPERATURE = 0.85


def slots_of_weights(weights: Mapping[str | None, float], period: int = PERIOD) -> dict[str | None, int]:
    """Weights as whole slots of a period: largest remainders, at least one slot each."""
    if len(weights) > period:
        raise ValueError("there are more sources than slots in a period")
    if any(w <= 0 for w in weights.values()):
        raise ValueError("a weight has to be above zero")
    total = sum(weights.values())
    exact = {s: w / total * period for s, w in weights.items()}
    slots = {s: max(1, int(x)) for s, x in exact.items()}
    by_rest = sorted(exact, key=lambda s: (slots[s] - exact[s], s is None, s or ""))
    left = period - sum(slots.values())
    for i in range(max(left, 0)):
        slots[by_rest[i % len(by_rest)]] += 1
    while left < 0:  # the least slots pushed the sum too high
        slots[max(slots, key=lambda s: (slots[s], s or ""))] -= 1
        left += 1
    return slots


def whole_shares(weights: Sequence[float | Fraction]) -> list[int]:
    """Whole numbers in exactly the proportions of the weights."""
    if any(not w > 0 for w in weights):
        raise ValueError("a weight has to be above zero")
    exact = [Fraction(w) for w in weights]
    whole = math.lcm(*(w.denominator for w in exact))
    return [int(w * whole) for w in exact]


def advance(shares: Sequence[int], done: Sequence[int], first: int, last: int) -> list[int]:
    """Blocks of each source before slot ``last``, from those before slot ``first``."""
    total = sum(shares)
    due = [s * last // total for s in shares]
    came = [k * total // s - first for s, a, b in zip(shares, done, due) for k in range(a, b)]
    releases = np.maximum(np.array(came, np.int64), 0)
    size = last - first
    # slots from each slot on that blocks due in the segment leave free
    free = np.arange(size, 0, -1) - np.bincount(releases, minlength=size)[::-1].cumsum()[::-1]
    early = sorted((
        (max(b * total // s - first, 0), -(-(b + 1) * total // s), i)
        for i, (s, a, b) in enumerate(zip(shares, done, due)) if a <= b and s * last % total
    ), reverse=True)
    chosen: list[tuple[int, int]] = []
    for number, (release, deadline, i) in enumerate(early):
        heapq.heappush(chosen, (-deadline, i))
        before = early[number + 1][0] if number + 1 < len(early) else -1
        if before < release:
            room = int(free[before + 1: release + 1].min())
            while len(chosen) > room:
                heapq.heappop(chosen)
    state = [max(a, b) for a, b in zip(done, due)]
    for _, i in chosen:
        state[i] += 1
    assert sum(state) == last
    return state


def place(
    shares: Sequence[int], done: Sequence[int], until: Sequence[int], first: int
) -> Iterator[tuple[int, int, int]]:
    """``(source, block, slot)`` from slot ``first`` on for the blocks from ``done`` up to ``until``: earliest
    deadline first among released blocks."""
    total = sum(shares)
    coming = [(a * total // shares[i], i, a) for i, (a, b) in enumerate(zip(done, until)) if a < b]
    ready: list[tuple[int, int, int]] = []  # deadline, source, block
    heapq.heapify(coming)
    last = first + sum(until) - sum(done)
    for slot in range(first, last):
        while coming and coming[0][0] <= slot:
            _, i, k = heapq.heappop(coming)
            heapq.heappush(ready, (min(-(-(k + 1) * total // shares[i]), last), i, k))
        deadline, i, k = heapq.heappop(ready)
        assert slot < deadline
        yield i, k, slot
        if k + 1 < until[i]:
            heapq.heappush(coming, ((k + 1) * total // shares[i], i, k + 1))


def one_period(slots: Mapping[str | None, int]) -> list[tuple[str | None, int, int]]:
    """``(source, block, slot)`` of one period."""
    # equal deadlines: the heavier source, then the name
    rank = sorted(slots, key=lambda s: (-slots[s], s is None, s or ""))
    shares = [slots[s] for s in rank]
    return [(rank[i], k, slot) for i, k, slot in place(shares, [0] * len(rank), shares, 0)]


def lay_out(shares: Sequence[int], blocks: Sequence[int], size: int) -> tuple[list[tuple[int, bytes, bytes]], list[int]]:
    """Segments ``(first slot, ahead at its begin, ahead at its end)`` until every source has come round, and how
    often each source is used by then. A bit for each source says whether its share is rounded up."""
    total = sum(shares)

    def ahead(state: list[int], slot: int) -> bytes:
        return np.packbits([n > s * slot // total for n, s in zip(state, shares)]).tobytes()

    segments: list[tuple[int, bytes, bytes]] = []
    first, done = 0, [0] * len(shares)
    while True:
        until = advance(shares, done, first, first + size)
        segments.append((first, ahead(done, first), ahead(until, first + size)))
        if all(n >= b for n, b in zip(until, blocks)):
            break
        first, done = first + size, until
    uses, short = list(done), sum(n < b for n, b in zip(done, blocks))
    for i, k, _ in place(shares, done, until, first):
        if not short:
            break
        uses[i] = k + 1
        short -= k + 1 == blocks[i]
    return segments, uses


def slots_of_blocks(spark: SparkSession, shares: list[int], segments: list[tuple[int, bytes, bytes]], size: int) -> DataFrame:
    """``number, turn, slot``: where block ``turn`` (counted on when a source starts again) of each source comes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum(shares)

        def state(slot: int, ahead: bytes) -> list[int]:
            bits = np.unpackbits(np.frombuffer(ahead, np.uint8), count=len(shares)).tolist()
            return [s * slot // total + bit for s, bit in zip(shares, bits)]

        for batch in batches:
            for row in batch.to_pylist():
                first = row["first"]
                made = place(shares, state(first, row["begin"]), state(first + size, row["end"]), first)
                columns = np.array(list(made), np.int64).T
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["number", "turn", "slot"])

    rows = spark.createDataFrame(segments, "first long, begin binary, end binary")
    return rows.mapInArrow(run, "number long, turn long, slot long")


def mix_schedule(
    docs: DataFrame,
    weights: Mapping[str | None, float] | None = None,
    source: str = "source",
    text: str = "text",
    key: str = "doc_id",
    block_bytes: int = BLOCK_BYTES,
    period: int | None = None,
    temperature: float = TEMPERATURE,
) -> DataFrame:
    """Where each document comes: ``doc_id, k, source, size, block, epoch, slot``, one row for each use.

    Without ``weights`` a source's weight is its size to the power of ``temperature``, which raises
    small sources; less than a block counts as one, since it fills a slot. With ``period`` the weights are rounded
    to whole slots of it, otherwise they are exact. A document belongs to the block in which its first byte lies, in the order of a hash. ``k``
    is a hash of the row.
    """
    spark = docs.sparkSession
    light = docs.select(
        F.col(key).alias("doc_id"), F.xxhash64(key, source, text).alias("k"), F.col(source).alias("source"),
        (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 1).cast("long").alias("size"),
    )
    # the stream is in order of source, so a hot source spreads over many ranges
    light = running_total(
        light, [F.col("source"), F.xxhash64("k"), F.col("k"), F.col("doc_id")], F.col("size"), "place")
    light = checkpoint(light)
    sums = light.groupBy("source").agg(F.sum("size").alias("total"), F.min("place").alias("begin")).collect()
    totals = {r["source"]: r["total"] for r in sums}
    chosen = dict(weights) if weights is not None else {s: max(t, block_bytes) ** temperature for s, t in totals.items()}
    missing = set(totals) - set(chosen)
    if missing:
        raise ValueError(f"no weight for {sorted(map(str, missing))}")
    chosen = {s: chosen[s] for s in totals}
    if period is not None and totals:
        chosen = slots_of_weights(chosen, period)
    # equal deadlines: the heavier source, then the name
    rank = sorted(chosen, key=lambda s: (-chosen[s], s is None, s or ""))
    shares = whole_shares([chosen[s] for s in rank])
    blocks = [-(-totals[s] // block_bytes) for s in rank]
    size = max(SEGMENT, 4 * len(rank))  # what is kept of a segment grows with the number of sources
    segments, uses = lay_out(shares, blocks, size) if rank else ([], [])
    begins = {r["source"]: r["begin"] for r in sums}
    facts = spark.createDataFrame(
        [(s, i, begins[s], blocks[i], uses[i]) for i, s in enumerate(rank)],
        "source string, number long, begin long, blocks long, uses long",
    )
    # a row for each source
    used = (
        light.alias("d").join(
            F.broadcast(facts.alias("f")), F.col("d.source").eqNullSafe(F.col("f.source"))
        )
        .select("d.doc_id", "d.k", "d.source", "d.size", "blocks", "uses", "number",
                F.floor((F.col("place") - F.col("begin")) / F.lit(block_bytes)).alias("block"))
        .withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(
            (F.col("uses") - 1 - F.col("block")) / F.col("blocks")))))
        .withColumn("turn", F.col("block") + F.col("epoch") * F.col("blocks"))
    )
    return used.join(slots_of_blocks(spark, shares, segments, size), ["number", "turn"]).select(
        "doc_id", "k", "source", "size", "block", "epoch", "slot")


def mix_documents(docs: DataFrame, weights: Mapping[str | None, float] | None = None, **options) -> DataFrame:
    """The rows of the mixture: every row of ``docs`` as often as the schedule uses it.

    Needs columns ``doc_id, source, text``.
    """
    plan = mix_schedule(docs, weights, **options)
    used = plan.groupBy(F.col("k").alias("_tw_k")).agg(F.count("*").alias("_tw_used"))
    named = docs.withColumn("_tw_k", F.xxhash64("doc_id", "source", "text"))
    same = Window.partitionBy("_tw_k")
    # equal rows share their uses
    rows = named.withColumn("_tw_same", F.count("*").over(same)).withColumn(
        "_tw_number", F.row_number().over(same.orderBy("_tw_k")))
    times = F.floor(F.col("_tw_used") / F.col("_tw_same")) + (
        F.col("_tw_number") <= F.col("_tw_used") % F.col("_tw_same")).cast("long")
    return (
        rows.join(used, "_tw_k").withColumn("_tw_copy", F.explode(F.sequence(F.lit(1).cast("long"), times)))
        .select(*[F.col(c) for c in docs.columns])
    )
