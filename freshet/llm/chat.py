"""Chat formatting in budgeted windows.

A window is a run of whole turns of a conversation, chosen by prefix sums of turn tokens, and holds at most
``budget`` tokens. Every window starts with the conversation's system turn (if its first turn is one), then
repeats as many of the turns right before its own as fit into ``history`` tokens and into what is left of the budget,
then has its own turns. What the system turn and the history leave is a stride. Turns that begin within one stride
share a window; the last of them, if it runs over the stride and does not fit any more, has a window of its own.
Only a turn that is longer than what the system turn leaves exceeds the budget, alone in its window, which is marked.
The loss mask covers the text of assistant turns in their own window only, so a repeated target is masked out.

Template: ``<s>`` opens a window, ``[role]`` a turn, ``</s>`` ends it. Inside roles and texts the
characters ``\\ < [ ]`` are written ``\\0 \\1 \\2 \\3``, so no text can hold a control string, and
the original comes back exactly. All of it is DataFrame expressions.

Order within a conversation is (turn, role, text), nulls first; null roles and texts are empty;
repeated rows are turns of their own; rows with a null conv_id form one conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

BUDGET, HISTORY = 512, 128
#: Control characters and what stands for them, in the order of escaping.
ESCAPES = (("\\", "\\0"), ("<", "\\1"), ("[", "\\2"), ("]", "\\3"))
TURN_COST = 4  # tokens that the marks of a turn count for
CHUNK = 1024  # turn numbers per partial sum, so that no window function holds a long conversation


def escape(text: Column) -> Column:
    for plain, written in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def unescape(text: Column) -> Column:
    for plain, written in reversed(ESCAPES):
        text = F.replace(text, F.lit(written), F.lit(plain))
    return text


def _turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, idx, role, text, tokens, before): place and prefix sum of every turn."""
    rows = conversations.select(
        F.col("conv_id"),
        F.col("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    words = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    rows = rows.withColumns({"tokens": (words + TURN_COST).cast("long"), "chunk": F.coalesce(F.floor(F.col("turn") / CHUNK), F.lit(-(1 << 62)))})
    inner = Window.partitionBy("conv_id", "chunk").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumns({"i": F.count("*").over(inner), "s": F.sum("tokens").over(inner)})
    earlier = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("conv_id", "chunk").agg(F.count("*").alias("n"), F.sum("tokens").alias("t"))
    sums = sums.select(
        F.col("conv_id").alias("c"),
        F.col("chunk").alias("k"),
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n0"),
        F.coalesce(F.sum("t").over(earlier), F.lit(0)).alias("t0"),
    )
    joined = placed.join(sums, placed["conv_id"].eqNullSafe(sums["c"]) & (placed["chunk"] == sums["k"]))
    return joined.select("conv_id", (F.col("i") + F.col("n0")).alias("idx"), "role", "text", "tokens", (F.col("s") + F.col("t0") - F.col("tokens")).alias("before"))


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def _members(turns: DataFrame, budget: int, history: int) -> DataFrame:
    """(m_conv, window, m_idx, main, over): which turns a window holds. Only places and sizes of turns are read."""
    light = turns.select("conv_id", "idx", "tokens", "before", "role")
    system = light.where("idx = 1 and role = 'system'").select(F.col("conv_id").alias("c"), F.col("tokens").alias("system"))
    sized = light.join(system, _same("conv_id", "c"), "left").withColumn("system", F.coalesce("system", F.lit(0)))
    # the system turn counts against the budget and is no part of the run that is cut into strides
    own = sized.where("idx > 1 or system = 0").withColumn("before", F.col("before") - F.col("system"))
    left = F.greatest(F.lit(budget) - F.col("system"), F.lit(1))
    own = own.withColumn("reach", F.least(F.lit(history), F.floor(left / 2))).withColumn("stride", left - F.col("reach"))
    first, last = F.floor(F.col("before") / F.col("stride")), F.floor((F.col("before") + F.col("tokens") - 1) / F.col("stride"))
    # a stride holds a bounded number of turns, as each counts for its marks at least
    begun = F.min("before").over(Window.partitionBy("conv_id", "stride", first))
    fits = (first == last) | (F.col("before") + F.col("tokens") - begun <= left)
    own = own.withColumn("own", F.when(fits, first * 2).otherwise(first * 2 + 1))
    held = own.groupBy("conv_id", "own").agg(F.min("before").alias("begins"), F.sum("tokens").alias("sum"), F.min("system").alias("system"), F.min("reach").alias("reach"))
    over = F.col("sum") + F.col("system") > budget
    room = F.least(F.col("reach"), F.greatest(F.lit(budget) - F.col("system") - F.col("sum"), F.lit(0)))
    held = held.select(F.col("conv_id").alias("w_conv"), F.col("own").alias("window"), "begins", room.alias("room"), over.alias("over"))
    # no stride is shorter than the history, so a turn is repeated in the three windows after its own at most
    dealt = own.select("conv_id", "idx", "before", "own", F.explode(F.expr("sequence(own, own + 3)")).alias("at"))
    found = dealt.join(held, _same("conv_id", "w_conv") & (F.col("at") == F.col("window")))
    main = F.col("at") == F.col("own")
    found = found.where(main | ((F.col("before") < F.col("begins")) & (F.col("before") >= F.col("begins") - F.col("room"))))
    found = found.select(F.col("w_conv").alias("m_conv"), "window", F.col("idx").alias("m_idx"), main.alias("main"), "over")
    # the system turn comes first in every window; it is new in the conversation's first one
    start = held.groupBy(F.col("w_conv").alias("s_conv")).agg(F.min("window").alias("s_first"))
    leads = held.join(start, _same("w_conv", "s_conv")).join(system, _same("w_conv", "c"))
    leads = leads.select(F.col("w_conv").alias("m_conv"), "window", F.lit(1).cast("long").alias("m_idx"), (F.col("window") == F.col("s_first")).alias("main"), "over")
    alone = system.join(held.select("w_conv").distinct(), _same("c", "w_conv"), "left_anti")
    alone = alone.select(F.col("c").alias("m_conv"), F.lit(0).cast("long").alias("window"), F.lit(1).cast("long").alias("m_idx"), F.lit(True).alias("main"), (F.col("system") > budget).alias("over"))
    return found.unionByName(leads).unionByName(alone)


def windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, loss_role: str = "assistant") -> DataFrame:
    """(conv_id, window, formatted, n_turns, n_repeated, repeats, n_tokens, over_budget, loss_spans) of (conv_id, turn, role, text).

    loss_spans: code-point offsets [start, end) into formatted, in order. The turns marked in ``repeats`` belong to
    earlier windows. n_tokens is at most the budget but where over_budget says that a single turn does not fit.
    Windows of a conversation are in order by number. Needs 0 <= history <= budget - history.
    """
    if not 0 <= history <= budget - history:
        raise ValueError("history must be between 0 and half of the budget")
    turns = _turns(conversations)
    members = _members(turns, budget, history)
    dealt = turns.join(members, _same("conv_id", "m_conv") & (F.col("idx") == F.col("m_idx")))
    item = F.struct("idx", "main", "tokens", "role", "text")
    found = dealt.groupBy("conv_id", "window").agg(F.array_sort(F.collect_list(item)).alias("near"), F.max("over").alias("over_budget"))
    heads = F.transform("near", lambda x: F.concat(F.lit("["), escape(x["role"]), F.lit("]")))
    bodies = F.transform("near", lambda x: escape(x["text"]))
    found = found.withColumns({"heads": heads, "bodies": bodies})
    parts = F.zip_with("heads", "bodies", lambda h, b: F.concat(h, b, F.lit("</s>")))
    marked = F.expr(
        "aggregate(sequence(0, size(near) - 1), "
        "struct(3L as at, cast(array() as array<struct<start:bigint,end:bigint>>) as spans), "
        "(a, i) -> struct(a.at + length(heads[i]) + length(bodies[i]) + 4L as at, "
        f"if(near[i].main and near[i].role = '{loss_role}', "
        "concat(a.spans, array(struct(a.at + length(heads[i]) as start, a.at + length(heads[i]) + length(bodies[i]) as end))), a.spans) as spans), "
        "a -> a.spans)"
    )
    return found.select(
        "conv_id",
        "window",
        F.concat(F.lit("<s>"), F.array_join(parts, "")).alias("formatted"),
        F.size("near").alias("n_turns"),
        F.size(F.filter("near", lambda x: ~x["main"])).alias("n_repeated"),
        F.transform("near", lambda x: ~x["main"]).alias("repeats"),
        F.aggregate("near", F.lit(0).cast("long"), lambda n, x: n + x["tokens"]).alias("n_tokens"),
        "over_budget",
        marked.alias("loss_spans"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted window: array<struct<role, text>>."""
    parts = F.split(F.substring(formatted, 4, 1 << 30), "</s>")
    parts = F.slice(parts, F.lit(1), F.size(parts) - 1)
    return F.transform(
        parts,
        lambda p: F.struct(unescape(F.substr(F.substring_index(p, "]", 1), F.lit(2))).alias("role"), unescape(F.substr(p, F.instr(p, "]") + 1)).alias("text")),
    )


def digests(made: DataFrame) -> DataFrame:
    """One row per conversation, read back from the windows."""
    fresh = F.filter(F.arrays_zip(read_turns(F.col("formatted")).alias("t"), F.col("repeats").alias("old")), lambda x: ~x["old"])["t"]
    loss = F.transform("loss_spans", lambda s: unescape(F.substr("formatted", (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    each = made.select("conv_id", "window", fresh.alias("fresh"), F.array_join(loss, "").alias("loss"), F.length("formatted").alias("chars"))
    said = F.array_join(F.transform("fresh", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    each = each.select("conv_id", "window", F.size("fresh").alias("n"), said.alias("said"), "loss", "chars")
    whole = each.groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"), F.array_sort(F.collect_list(F.struct("window", "said", "loss"))).alias("all"), F.sum("chars").alias("formatted_chars")
    )
    turns, loss = F.array_join(F.col("all.said"), ""), F.array_join(F.col("all.loss"), "")
    return whole.select(
        "conv_id",
        F.col("n_turns").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )
