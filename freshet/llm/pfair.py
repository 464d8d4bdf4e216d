"""Mixing sources to target weights by Pfair scheduling.

Documents of a source, in hash order, fill blocks of ``block_chars`` characters. The target is a
fluid: while a source has blocks left it gets its weight over the weights of all that have some, so
after v rounds a source of weight w has had v * w blocks, and T(v) slots are used, the sum of
min(blocks, v * w) over all sources. Its block k is released in slot floor(T(k / w)) and due at
ceil(T((k + 1) / w)); as long as no source is empty these are floor(k / share) and
ceil((k + 1) / share). The fluid itself shows that all deadlines can be kept, so earliest deadline
first keeps them, and at any slot every source is less than one block off the fluid. Weights are
taken as the exact fractions that they are, without rounding, from the first slot to the last.

The phase of a block is the number of times at which sources had run empty when its share of the
fluid began, its target that share. The schedule is made on the driver, which holds one entry per
source, and is written a part at a time as a table of blocks; documents are joined to it. With
``period``, shares are rounded to whole slots of that many; with ``max_sources``, sources beyond the
largest so many are mixed as one, named "". Both are off unless asked for.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Iterable, Iterator, Mapping
from fractions import Fraction
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from freshet.session import shared_dir

BLOCK_CHARS = 1 << 16
ROWS_PER_CHUNK = 50_000
#: Blocks of the schedule that the driver holds before they are written.
WRITTEN_AT_ONCE = 500_000
SCHEDULE = pa.schema([("p_source", pa.string()), ("p_block", pa.int64()), ("p_slot", pa.int64()), ("p_phase", pa.int32()), ("p_target", pa.float64())])


class Fluid:
    """The exact shares of sources: when each block begins and ends, in slots."""

    def __init__(self, blocks: Mapping[str, int], weights: Mapping[str, float]):
        exact = {s: Fraction(weights[s]) for s, n in blocks.items() if n > 0}
        scale = math.lcm(*(w.denominator for w in exact.values()))
        self.weight = {s: int(w * scale) for s, w in exact.items()}
        # rounds after which sources are empty, each once, with what has gone by then
        self.empty, self.gone, self.active = [], [0], [sum(self.weight.values())]
        for v, s in sorted((Fraction(blocks[s], w), s) for s, w in self.weight.items()):
            if not self.empty or self.empty[-1] != v:
                self.empty.append(v)
                self.gone.append(self.gone[-1])
                self.active.append(self.active[-1])
            self.gone[-1] += blocks[s]
            self.active[-1] -= self.weight[s]
        self.about = [v.numerator / v.denominator for v in self.empty]  # correctly rounded, so in order

    def phase(self, source: str, k: int) -> int:
        """How many of ``empty`` are not after the beginning of block k."""
        w = self.weight[source]
        at = bisect_left(self.about, k / w)
        while at < len(self.empty) and self.empty[at].numerator * w <= k * self.empty[at].denominator:
            at += 1
        return at

    def begin(self, source: str, k: int, phase: int) -> tuple[int, int]:
        """Floor and ceiling of the time at which block k begins and block k - 1 ends."""
        whole, rest = divmod(k * self.active[phase], self.weight[source])
        return self.gone[phase] + whole, self.gone[phase] + whole + bool(rest)


def exact_schedule(blocks: Mapping[str, int], weights: Mapping[str, float]) -> Iterator[tuple[str, int, int, int, float]]:
    """(source, block, slot, phase, target) of every block, slot after slot."""
    fluid = Fluid(blocks, weights)
    waiting: list[tuple] = []  # (release, deadline, source, block, phase, release and phase of the next)
    ready: list[tuple] = []  # the same from the deadline on

    def offer(s: str, k: int, release: int, phase: int) -> None:
        following = fluid.phase(s, k + 1)
        low, high = fluid.begin(s, k + 1, following)
        heapq.heappush(waiting, (release, high, s, k, phase, low, following))

    for s in sorted(fluid.weight):
        offer(s, 0, 0, 0)
    for t in range(sum(n for n in blocks.values() if n > 0)):
        while waiting and waiting[0][0] <= t:
            heapq.heappush(ready, heapq.heappop(waiting)[1:])
        deadline, s, k, phase, release, following = heapq.heappop(ready)
        if deadline <= t:
            raise AssertionError("a deadline was missed")
        yield s, k, t, phase, fluid.weight[s] / fluid.active[phase]
        if k + 1 < blocks[s]:
            offer(s, k + 1, release, following)


def schedule(shares: list[int]) -> list[int]:
    """Slots of one period: for each slot the number of the source that has it. Shares add up to its length."""
    period = sum(shares)
    waiting = [(0, i, 0) for i, q in enumerate(shares) if q]  # (release, source, block)
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int]] = []  # (deadline, source, block)
    slots = []
    for t in range(period):
        while waiting and waiting[0][0] <= t:
            _, i, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(k + 1) * period // shares[i]), i, k))
        deadline, i, k = heapq.heappop(ready)
        if deadline <= t:
            raise AssertionError("a deadline was missed")
        slots.append(i)
        if k + 1 < shares[i]:
            heapq.heappush(waiting, ((k + 1) * period // shares[i], i, k + 1))
    return slots


def whole_shares(weights: Mapping[str, float], period: int) -> dict[str, int]:
    """Whole numbers that add up to the period, one at least, by largest remainder."""
    total = sum(weights.values())
    rest = period - len(weights)
    exact = {s: w / total * rest for s, w in weights.items()}
    shares = {s: 1 + math.floor(x) for s, x in exact.items()}
    order = sorted(weights, key=lambda s: (math.floor(exact[s]) - exact[s], s))
    for s in order[: period - sum(shares.values())]:
        shares[s] += 1
    return shares


def plan(blocks: Mapping[str, int], weights: Mapping[str, float], period: int) -> list[tuple]:
    """Phases as rows (source, phase, from_block, to_block, share, first_slot, places, target)."""
    left, done, at, rows, phase = {s: n for s, n in blocks.items() if n > 0}, dict.fromkeys(blocks, 0), 0, [], 0
    while left:
        active = {s: weights[s] for s in left}
        shares = whole_shares(active, period)
        names = sorted(shares)
        slots = schedule([shares[s] for s in names])
        rounds = min(left[s] // shares[s] for s in names)
        taken = {s: rounds * shares[s] for s in names}
        length = rounds * period
        if all(taken[s] < left[s] for s in names):  # part of another round, until a source is empty
            for i in slots:
                taken[names[i]] += 1
                length += 1
                if taken[names[i]] == left[names[i]]:
                    break
        places: dict[str, list[int]] = {s: [] for s in names}
        for t, i in enumerate(slots):
            places[names[i]].append(t)
        total = sum(active.values())
        for s in names:
            if taken[s]:
                rows.append((s, phase, done[s], done[s] + taken[s], shares[s], at, places[s], active[s] / total))
            done[s] += taken[s]
            left[s] -= taken[s]
            if not left[s]:
                del left[s]
        at += length
        phase += 1
    return rows


def rounded_schedule(blocks: Mapping[str, int], weights: Mapping[str, float], period: int) -> Iterator[tuple[str, int, int, int, float]]:
    """As ``exact_schedule``, by whole slots of a period."""
    for s, phase, lo, hi, share, first, places, target in plan(blocks, weights, period):
        for k in range(hi - lo):
            yield s, lo + k, first + k // share * period + places[k % share], phase, target


def _written(spark: SparkSession, rows: Iterable[tuple]) -> DataFrame:
    """The schedule as a table, written a part at a time."""
    path, rows = shared_dir(spark, "mix-schedule"), iter(rows)
    part = list(islice(rows, WRITTEN_AT_ONCE))
    while True:
        columns = zip(*part) if part else [[]] * len(SCHEDULE)
        made = pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, SCHEDULE)], schema=SCHEDULE)
        spark.createDataFrame(made).write.mode("append").parquet(path)
        if not (part := list(islice(rows, WRITTEN_AT_ONCE))):
            return spark.read.parquet(path)


def mix(docs: DataFrame, weights: Mapping[str, float] | None = None, block_chars: int = BLOCK_CHARS, period: int | None = None, max_sources: int | None = None, name: str = "mix") -> DataFrame:
    """The rows with a struct ``mix`` (``name`` gives it another name; a column of that name is replaced): source, block, phase, target, slot, place (in the block).

    Ordered by (mix.slot, mix.place) they are the mixture. ``weights``: a positive weight per
    source, sources without one getting the smallest; None: the square root of a source's
    characters. A null source is "". A document's length is that of its whole text, one at least
    (null or empty text); one longer than a block takes the slots of the blocks it spans, of which
    only the first is named. Documents of equal hash are ordered by doc_id, then by length; rows
    equal in both are interchangeable. An empty table gives an empty mixture.
    """
    if max_sources is not None and max_sources < 1 or weights and min(weights.values()) <= 0:
        raise ValueError("max_sources and weights must be positive")
    if period is not None and (max_sources is None or period < max_sources + 1):
        raise ValueError("a period needs a slot for every source")
    spark = docs.sparkSession
    size = F.greatest(F.coalesce(F.length("text"), F.lit(0)), F.lit(1)).cast("long")
    light = docs.select(F.coalesce("source", F.lit("")).alias("s"), size.alias("n"))
    totals = light.groupBy("s").agg(F.sum("n").alias("n"), F.count("*").alias("rows")).orderBy(F.desc("n"), "s")
    if max_sources is not None:
        totals = totals.limit(max_sources)
    named = {r.s: r.n for r in totals.collect()}
    overall = light.agg(F.sum("n").alias("n"), F.count("*").alias("rows")).first()
    if (rest := (overall.n or 0) - sum(named.values())) > 0:
        named[""] = named.get("", 0) + rest
    lowest = min(weights.values()) if weights else None
    target = {s: float(weights.get(s, lowest)) if weights else math.sqrt(n) for s, n in named.items()}
    blocks = {s: -(-n // block_chars) for s, n in named.items()}
    slots = _written(spark, exact_schedule(blocks, target) if period is None else rounded_schedule(blocks, target, period))

    # a source's documents are dealt over chunks of its hash range, so that a large source is many tasks
    bits = max(4, math.ceil(math.log2(max(1, (overall.rows or 0) / ROWS_PER_CHUNK))) + 4)
    source = F.coalesce("source", F.lit(""))
    if max_sources is not None and named:
        source = F.when(source.isin([s for s in named if s]), source).otherwise(F.lit(""))
    order = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    # the caller's columns travel in one struct, so that no name can clash
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.struct(source.alias("source"), size.alias("size"), order.alias("order"), F.shiftrightunsigned(order, 64 - bits).alias("chunk")).alias("mix"),
        F.col("doc_id").alias("o_id"),
    )
    keys = rows.select("mix.*")
    sums = keys.groupBy("source", "chunk").agg(F.sum("size").alias("n"))
    earlier = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(F.col("source").alias("o_source"), F.col("chunk").alias("o_chunk"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("o_before"))
    inner = Window.partitionBy("mix.source", "mix.chunk").orderBy("mix.order", "o_id", "mix.size").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("o_upto", F.sum("mix.size").over(inner))
    rows = rows.join(offsets, (F.col("mix.source") == F.col("o_source")) & (F.col("mix.chunk") == F.col("o_chunk")))
    begins = F.col("o_before") + F.col("o_upto") - F.col("mix.size")
    rows = rows.withColumns({"o_block": F.floor(begins / block_chars).cast("long"), "o_place": begins % block_chars})
    rows = rows.join(slots, (F.col("mix.source") == F.col("p_source")) & (F.col("o_block") == F.col("p_block")))
    made = F.struct(
        F.col("mix.source").alias("source"), F.col("o_block").alias("block"), F.col("p_phase").alias("phase"), F.col("p_target").alias("target"), F.col("p_slot").alias("slot"), F.col("o_place").alias("place")
    )
    return rows.select(*[F.col(f"row.`{c}`") for c in docs.columns if c != name], made.alias(name))
