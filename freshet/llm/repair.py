"""Repair of conversation structure by lightest derivations.

A repaired conversation's role initials read ``(s?(ua)+)?``. A row may be kept (cost 0), given the role
user or assistant (1) or deleted (2, a must for blank and repeated rows); a truncated row that stays costs
5 more, and an empty user or assistant row inserted anywhere costs 5. Of the cheapest repairs the one whose
audit, the initials K R D I of its edits in order, comes first in ASCII order is taken.

Every row's edits are deductions: from "the rows before stand repaired in state q" and an edit that leads
from q to r follows "the rows up to here stand repaired in state r". Weights are (cost, audit); an edit only
adds to both, and adding the same edit keeps the order of two weights, as equally dear audits of one item
are never prefixes of each other. So the functions are superior, and Knuth's agenda finalises items in
the order of their weights until the goal's weight is known. Rows come in blocks; a block's agenda gives the
lightest way between any two states, and a second agenda over the blocks of a conversation, with those ways
as its edits, finds the whole. An insertion belongs to the row after it, or to the end.

Rows are put in order by range partitioning over (conv_id, turn, role, text), nulls first, so a conversation
of any length is spread over tasks; the second agenda reads about 200 bytes per block of it. A null role
or text is one space; a null conv_id makes one conversation; an empty role fits no state. Equal turns
stand in the order of role and text. Empty tables give no rows. Other columns are not carried, so none can clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Hashable, Iterable, Iterator
from functools import lru_cache
from heapq import heappop, heappush

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from freshet.llm.common import give_back, in_batches, keep

BLOCK_ROWS, BLOCK_CHARS = 512, 1 << 19
WHITE = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 1, 2, 5, 5
CLEAN, BLANK, DUPLICATE, TRUNCATED = "-", "b", "d", "t"
ROLES = {"u": "user", "a": "assistant"}
# states: nothing yet, after the system row, after a user row, after an assistant row
STATES = (0, 1, 2, 3)
NEXT: dict[tuple[int, str], int] = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ENDS = {0: (0, ""), 1: (2 * INSERT_COST, INSERT * 2), 2: (INSERT_COST, INSERT), 3: (0, "")}

Weight = tuple[int, str]
Item = Hashable


def lightest(start: Item, deduce: Callable[[Item], Iterable[tuple[Item, Weight]]], goals: Iterable[Item]) -> dict[Item, tuple[Weight, Item | None]]:
    """Knuth's agenda: the items finalised until all goals are, or no more can be deduced, with weight and premise.

    ``deduce`` gives (conclusion, weight of the axiom) of every rule that has the item as its open premise.
    """
    final: dict[Item, tuple[Weight, Item | None]] = {}
    pending: dict[Item, Weight] = {start: (0, "")}
    agenda: list[tuple[Weight, Item, Item | None]] = [((0, ""), start, None)]
    left = set(goals)
    while agenda and left:
        weight, item, premise = heappop(agenda)
        if item in final:
            continue
        final[item] = weight, premise
        left.discard(item)
        for conclusion, (cost, audit) in deduce(item):
            value = weight[0] + cost, weight[1] + audit
            if conclusion not in final and (conclusion not in pending or value < pending[conclusion]):
                pending[conclusion] = value
                heappush(agenda, (value, conclusion, item))
    return final


def _edits(initial: str, fault: str, state: int) -> Iterator[tuple[int, Weight]]:
    """(state after, weight) of every edit of one row."""
    yield state, (DELETE_COST, DELETE)
    if fault in (CLEAN, TRUNCATED):
        more = TRUNCATED_COST if fault == TRUNCATED else 0
        if (state, initial) in NEXT:
            yield NEXT[state, initial], (more, KEEP)
        for role in ROLES:
            if (state, role) in NEXT:
                yield NEXT[state, role], (REROLE_COST + more, REROLE)


@lru_cache(1 << 14)
def ways(initials: str, faults: str, begin: int) -> dict[int, Weight]:
    """The lightest way through a block from a state to each state that can be reached."""
    n = len(initials)

    def deduce(item: tuple[int, int]) -> Iterator[tuple[Item, Weight]]:
        i, state = item
        if i == n:
            return
        for role in ROLES:
            if (state, role) in NEXT:
                yield (i, NEXT[state, role]), (INSERT_COST, INSERT)
        for after, weight in _edits(initials[i], faults[i], state):
            yield (i + 1, after), weight

    goals = [(n, q) for q in STATES]
    final = lightest((0, begin), deduce, goals)
    return {q: final[n, q][0] for q in STATES if (n, q) in final}


def through(blocks: list[list[tuple[int, int, int, int]]]) -> tuple[int, list[tuple[int, int]], str]:
    """(cost, (state before, state after) of every block, edits at the end) of the lightest repair.

    Each block is given by (state before, state after, cost, rank of the audit among the block's audits).
    """
    steps = [{} for _ in blocks]
    for found, block in zip(steps, blocks):
        for before, after, cost, rank in block:
            found.setdefault(before, []).append((after, (cost, chr(rank))))

    end = len(steps) + 1, 0

    def deduce(item: tuple[int, int]) -> Iterator[tuple[Item, Weight]]:
        i, state = item
        if i < len(steps):
            for after, weight in steps[i].get(state, ()):
                yield (i + 1, after), weight
        elif item != end:
            yield end, ENDS[state]

    final = lightest((0, 0), deduce, [end])
    (cost, _), item = final[end]
    tail, path = ENDS[item[1]][1], []
    while item[0]:
        before = final[item][1]
        path.append((before[1], item[1]))
        item = before
    return cost, path[::-1], tail


def applied(roles: list[str], said: list[str], audit: str, state: int) -> tuple[list[str], list[str], list[str]]:
    """(edits, roles, texts) of the rows that an audit leaves; roles follow from the states."""
    edits, out_roles, out_texts, i = [], [], [], 0
    for edit in audit:
        if edit == DELETE:
            i += 1
            continue
        if edit == KEEP:
            role, text, initial = roles[i], said[i], roles[i][0]
        else:
            initial = "u" if (state, "u") in NEXT else "a"
            role, text = ROLES[initial], "" if edit == INSERT else said[i]
        i += edit != INSERT
        state = NEXT[state, initial]
        edits.append(edit)
        out_roles.append(role)
        out_texts.append(text)
    return edits, out_roles, out_texts


# --- tables ----------------------------------------------------------------------


def rows_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with a space for null roles and texts."""
    said = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *said)


def damage(conversations: DataFrame) -> DataFrame:
    """The rows with faults put in by crc32 of ``conv_id:turn``, for trials: one in four is touched."""
    named = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    rows = rows_of(conversations).withColumn("kind", F.crc32(F.concat(named[0], F.lit(":"), named[1])) % 20)
    kind = F.col("kind")
    text = F.when(kind == 1, "").when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    again = F.explode(F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.where("kind != 0").select("conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), again.alias("copy")).drop("copy")


def _marked(rows: DataFrame) -> DataFrame:
    """Rows with the marks of their own text, and whether role and text stood in an earlier turn."""
    bare = F.rtrim(F.col("text"), F.lit(WHITE))
    own = F.when(bare == "", BLANK).when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), TRUNCATED).otherwise(CLEAN)
    key = F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), 256)
    rows = rows.withColumns({"own": own, "key": key})
    first = rows.groupBy(F.col("conv_id").alias("c"), F.col("key").alias("k")).agg(F.min(F.struct("turn")).alias("first"))
    joined = rows.join(first, rows["conv_id"].eqNullSafe(first["c"]) & (rows["key"] == first["k"]))
    return joined.select("conv_id", "turn", "role", "text", "own", (~F.col("turn").eqNullSafe(F.col("first.turn"))).alias("seen"))


_BLOCKS = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("part", pa.int64()),
        ("block", pa.int64()),
        ("roles", pa.list_(pa.string())),
        ("texts", pa.list_(pa.string())),
        ("faults", pa.string()),
        ("turns", pa.list_(pa.int64())),
        ("n_turns", pa.int64()),
        ("illegal", pa.int64()),
        ("ways", pa.list_(pa.struct([("before", pa.int32()), ("after", pa.int32()), ("cost", pa.int64()), ("rank", pa.int32()), ("audit", pa.string())]))),
    ]
)
_BLOCKS_SQL = (
    "conv_id long, part long, block long, roles array<string>, texts array<string>, faults string, turns array<long>, n_turns long, illegal long, "
    "ways array<struct<before:int,after:int,cost:bigint,rank:int,audit:string>>"
)
LEGAL = ("su", "ua", "au")


def _initials(roles: list[str]) -> str:
    return "".join(r[:1] or "-" for r in roles)


def _block(conv, part: int, block: int, rows: list[tuple], starts: Iterable[int]) -> tuple[int, tuple]:
    """One row of _BLOCKS of sorted (turn, role, text, own, seen) rows, with its size."""
    roles, said = [r[1] for r in rows], [r[2] for r in rows]
    faults = "".join(r[3] if r[3] == BLANK or not r[4] else DUPLICATE for r in rows)
    initials = _initials(roles)
    known = [r[0] for r in rows if r[0] is not None]
    found = [(before, after, cost, audit) for before in starts for after, (cost, audit) in ways(initials, faults, before).items()]
    rank = {a: i for i, a in enumerate(sorted({w[3] for w in found}))}
    made = [{"before": p, "after": q, "cost": c, "rank": rank[a], "audit": a} for p, q, c, a in found]
    turns = [known[0], known[-1]] if known else []
    n_turns = len(set(known))
    illegal = sum(x + y not in LEGAL for x, y in zip(initials, initials[1:]))
    size = sum(map(len, said)) + 64 * len(rows)
    return size, (conv, part, block, roles, said, faults, turns, n_turns, illegal, made)


def blocks(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Blocks of consecutive rows of a conversation, in order of (part, block), with the ways through them."""
    ordered = _marked(rows).repartitionByRange("conv_id", "turn", "role", "text").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()

        def made():
            number, held, chars, conv, last = 0, [], 0, None, None
            # the first conversation of a task may have begun in the one before; any other begins here
            starts, begun = STATES, False
            for batch in batches:
                for own, turn, role, text, mark, seen in zip(*(c.to_pylist() for c in batch.columns)):
                    if begun and (own != conv or len(held) >= block_rows or chars >= BLOCK_CHARS):
                        yield _block(conv, part, number, held, starts)
                        number, held, chars = number + 1, [], 0
                        starts, last = ((0,), None) if own != conv else (STATES, last)
                    conv, begun = own, True
                    # equal rows of one turn are neighbours: the first of them counts
                    held.append((turn, role, text, mark, seen or last == (turn, role, text)))
                    last = turn, role, text
                    chars += len(text)
            if begun:
                yield _block(conv, part, number, held, starts)

        yield from in_batches(made(), _BLOCKS)
        give_back()

    return ordered.mapInArrow(run, _BLOCKS_SQL)


_CHOSEN = pa.schema(
    [("part", pa.int64()), ("block", pa.int64()), ("before", pa.int32()), ("after", pa.int32()), ("tail", pa.string())]
    + [(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
)


def _chosen(made: DataFrame) -> DataFrame:
    """The way chosen through every block, and the counts of each conversation beside its last block."""
    light = F.transform("ways", lambda w: F.struct(w["before"], w["after"], w["cost"], w["rank"]))
    ends = F.array(*[F.substring(F.element_at("roles", i), 1, 1) for i in (1, -1)])
    count = [F.size(F.split("faults", kind)) - 1 for kind in (BLANK, DUPLICATE, TRUNCATED)]
    small = made.select("conv_id", "part", "block", light.alias("ways"), ends.alias("ends"), "turns", "n_turns", *[c.alias(n) for c, n in zip(count, "bdt")], "illegal")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def chain(held: list[dict]):
            cost, path, tail = through([[tuple(w.values()) for w in r["ways"]] for r in held])
            illegal = sum(r["illegal"] for r in held) + sum(x["ends"][1] + y["ends"][0] not in LEGAL for x, y in zip(held, held[1:]))
            turns = [r["turns"] for r in held if r["turns"]]
            distinct = sum(r["n_turns"] for r in held) - sum(x[1] == y[0] for x, y in zip(turns, turns[1:]))
            gaps = turns[-1][1] - turns[0][0] + 1 - distinct if turns else 0
            counts = gaps, *(sum(r[c] for r in held) for c in "bdt"), illegal, cost
            for i, (r, (before, after)) in enumerate(zip(held, path)):
                last = i == len(held) - 1
                yield 96, (r["part"], r["block"], before, after, tail if last else "", *(counts if last else [None] * 6))

        def rows():
            held: list[dict] = []
            for batch in batches:
                for row in batch.to_pylist():
                    if held and held[-1]["conv_id"] != row["conv_id"]:
                        yield from chain(held)
                        held = []
                    held.append(row)
            if held:
                yield from chain(held)

        yield from in_batches(rows(), _CHOSEN)

    by_conversation = small.repartition("conv_id").sortWithinPartitions("conv_id", "part", "block")
    return by_conversation.mapInArrow(run, "part long, block long, before int, after int, tail string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long")


_REPAIRED = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("block", pa.int64()), ("audit", pa.string()), ("edits", pa.list_(pa.string())), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))])
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def repair_blocks(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Repaired blocks: (conv_id, part, block, audit, edits, roles, texts) and, beside a conversation's last block, its counts.

    Blocks of a conversation are in order by (part, block). The blocks are written to the run folder first,
    so that all that follows sees the same ones.
    """
    made, _ = keep(blocks(rows_of(rows), block_rows), "repair")
    chosen = _chosen(made)
    joined = made.join(chosen.select(F.col("part").alias("p"), F.col("block").alias("b"), "before", "after", "tail", *[F.col(c).alias(f"c_{c}") for c in COUNTS]), (F.col("part") == F.col("p")) & (F.col("block") == F.col("b")))
    way = F.element_at(F.filter("ways", lambda w: (w["before"] == F.col("before")) & (w["after"] == F.col("after"))), 1)
    ready = joined.select("conv_id", "part", "block", "roles", "texts", F.concat(way["audit"], "tail").alias("audit"), F.col("before").alias("state"), *[f"c_{c}" for c in COUNTS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([*_REPAIRED, *[(c, pa.int64()) for c in COUNTS]])

        def out():
            for batch in batches:
                for conv, part, block, roles, said, audit, state, *counts in zip(*(c.to_pylist() for c in batch.columns)):
                    edits, roles, said = applied(roles, said, audit, state)
                    yield sum(map(len, said)), (conv, part, block, audit, edits, roles, said, *counts)

        yield from in_batches(out(), schema)
        give_back()

    return ready.mapInArrow(
        run, "conv_id long, part long, block long, audit string, edits array<string>, roles array<string>, texts array<string>, " + ", ".join(f"{c} long" for c in COUNTS)
    )


def repair(conversations: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(conv_id, part, block, place, edit, role, text): the repaired rows; (part, block, place) orders a conversation."""
    made = repair_blocks(conversations, block_rows)
    each = made.select("conv_id", "part", "block", F.posexplode(F.arrays_zip("edits", "roles", "texts")).alias("place", "row"))
    return each.select("conv_id", "part", "block", "place", F.col("row.edits").alias("edit"), F.col("row.roles").alias("role"), F.col("row.texts").alias("text"))


def audits(conversations: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per conversation that has rows: counts, cost, audit and the digest of its repaired rows.

    The rows of a conversation stream through one task in order, as its digest asks for; only
    the audit, a letter per edit, is held.
    """
    made = repair_blocks(conversations, block_rows)
    ordered = made.drop("edits").repartition("conv_id").sortWithinPartitions("conv_id", "part", "block")
    schema = pa.schema([("conv_id", pa.int64()), *[(c, pa.int64()) for c in COUNTS], ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out():
            whole, audit, first = hashlib.sha256(), [], True
            for batch in batches:
                for conv, _, _, edits, roles, said, *counts in zip(*(c.to_pylist() for c in batch.columns)):
                    for role, text in zip(roles, said):
                        whole.update(("" if first else "\n").encode() + f"{role}:{text}".encode())
                        first = False
                    audit.append(edits)
                    if counts[0] is not None:  # the conversation's last block
                        yield 256, (conv, *counts, "".join(audit), whole.hexdigest())
                        whole, audit, first = hashlib.sha256(), [], True

        yield from in_batches(out(), schema)
        give_back()

    return ordered.mapInArrow(run, "conv_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", audit string, repaired_sha256 string")


def damaged_and_repaired(conversations: DataFrame) -> DataFrame:
    """Every conversation's report after damage; one that has lost all rows has zeros and an empty audit."""
    found = audits(damage(conversations)).withColumnRenamed("conv_id", "c")
    every = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    joined = every.join(found, every["conv_id"].eqNullSafe(found["c"]), "left")
    empty: Column = F.lit(hashlib.sha256(b"").hexdigest())
    return joined.select(
        "conv_id",
        *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in COUNTS],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", empty).alias("repaired_sha256"),
    )
