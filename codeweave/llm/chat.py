"""Chat formatting (operator 5): budgeted windows. DataFrame and SQL functions only.

Method. Prefix sums of turn tokens choose spans of whole turns: a conversation's turns are laid along their running total,
cut at multiples of half the room a window has, so that a span and the turn that crosses its end still fit; a
turn larger than that half stands alone. The room is the budget less the conversation's system turn (the first turn of that role), whatever its
length, and every window after it repeats it. Before its span a window repeats the longest run of turns that end where the span begins, at most HISTORY_TURNS
and as far as the rest of the budget goes. Repeated turns are marked and masked: an assistant turn is a target only in the window whose span it
belongs to, so each is learned once. A window is over the budget only if it is one turn, or a system turn and one other, that are too long together.

Template. ``<s>[role|kind]text</s>`` with kind n (own turn), h (repeated history) or s (repeated system turn). Inside roles and
texts the characters ``\\ < [`` (and ``] |`` in roles) become ``\\e \\l \\i`` (``\\j \\p``), so no control string of this or of
other chat templates can occur in an escaped text, and the original comes back exactly.

Tokens of a turn are those of the column ``n_tokens`` names, or else a quarter of the code points of the turn as it is written, with
escapes and marks, rounded up.

Defined cases: null role and text count as empty; rows are ordered by turn, role and text, null turns first; repeated rows are turns of
their own; a null conversation id is a conversation of its own; empty texts are turns; null or negative token counts are 0; a conversation without
assistant turns has no targets; an empty table gives an empty result; other columns are not read. A conversation is the unit that one task holds, as its
digest needs all of it in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUDGET, HISTORY_TURNS = 1024, 2


def escape(c: Column, header: bool = False) -> Column:
    pairs = [("\\", "\\e"), ("<", "\\l"), ("[", "\\i")] + ([("]", "\\j"), ("|", "\\p")] if header else [])
    for plain, code in pairs:
        c = F.replace(c, F.lit(plain), F.lit(code))
    return c


def unescape(c: Column) -> Column:
    for plain, code in [("<", "\\l"), ("[", "\\i"), ("]", "\\j"), ("|", "\\p"), ("\\", "\\e")]:
        c = F.replace(c, F.lit(code), F.lit(plain))
    return c


def windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY_TURNS, n_tokens: str | None = None) -> DataFrame:
    """``conv_id, window, formatted, loss_spans array<struct<start, end>>`` (code points, end exclusive) of all conversations."""
    given = F.greatest(F.coalesce(F.col(n_tokens).cast("long"), F.lit(0)), F.lit(0)) if n_tokens else F.lit(None).cast("long")
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), given.alias("tokens"))
    written = F.length(escape(F.col("role"), True)) + F.length(escape(F.col("text"))) + 11
    rows = rows.withColumn("tokens", F.coalesce("tokens", F.ceil(written / 4)))
    in_order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    so_far = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("conv_id")
    rows = rows.withColumn("place", F.row_number().over(in_order))
    rows = rows.withColumn("system_place", F.min(F.when(F.col("role") == "system", F.col("place"))).over(whole))
    rows = rows.withColumn("system", F.coalesce(F.col("place") == F.col("system_place"), F.lit(False)))
    rows = rows.withColumn("room", budget - F.coalesce(F.max(F.when(F.col("system"), F.col("tokens"))).over(whole), F.lit(0)))
    rows = rows.withColumn("half", F.greatest(F.floor(F.col("room") / 2), F.lit(1)))
    rows = rows.withColumn("own", F.when(F.col("system"), F.lit(0)).otherwise(F.col("tokens")))
    rows = rows.withColumn("large", F.col("own") > F.col("half"))
    rows = rows.withColumn("span", F.struct(
        F.floor(F.coalesce(F.sum("own").over(before), F.lit(0)) / F.col("half")), F.col("large"), F.sum(F.col("large").cast("long")).over(so_far)))
    rows = rows.withColumn("first", ~F.coalesce(F.col("span").eqNullSafe(F.lag("span").over(in_order)), F.lit(False)))
    rows = rows.withColumn("window", F.sum(F.col("first").cast("long")).over(so_far))
    rows = rows.withColumn("left", F.col("room") - F.sum("own").over(Window.partitionBy("conv_id", "window")))
    piece = lambda window, kind, place, role, text: F.struct(window.alias("window"), F.lit(kind).alias("kind"), place.alias("place"), role.alias("role"), text.alias("text"))
    me = F.col("place"), F.col("role"), F.col("text")
    copies = [piece(F.col("window"), "n", *me)]
    fits, taken = F.col("first"), F.lit(0)
    for k in range(1, history + 1):
        earlier = lambda c: F.lag(c, k).over(in_order)  # noqa: B023, E731
        taken = taken + earlier("own")
        fits = fits & F.coalesce(taken <= F.col("left"), F.lit(False))
        copies.append(F.when(fits & ~earlier("system"), piece(F.col("window"), "h", earlier("place"), earlier("role"), earlier("text"))))
    head = F.first(F.when(F.col("system"), F.struct("role", "text")), ignorenulls=True).over(so_far)
    copies.append(F.when(F.col("first") & (F.col("place") > F.col("system_place")), piece(F.col("window"), "s", F.lit(0), head["role"], head["text"])))
    pieces = rows.select("conv_id", F.array(*copies).alias("ps")).select("conv_id", F.explode(F.array_compact("ps")).alias("p")).select("conv_id", "p.*")
    shown = pieces.select(
        "conv_id", "window", F.col("place"),
        F.concat(F.lit("<s>["), escape(F.col("role"), True), F.lit("|"), F.col("kind"), F.lit("]")).alias("head"),
        escape(F.col("text")).alias("body"), ((F.col("kind") == "n") & (F.col("role") == "assistant")).alias("target"))
    shown = shown.select("conv_id", "window", F.struct("place", "head", "body", "target", F.length("head").alias("h"), F.length("body").alias("b")).alias("x"))
    gathered = shown.groupBy("conv_id", "window").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))
    spans = F.aggregate("xs", start, lambda acc, x: F.struct(
        (acc["at"] + x["h"] + x["b"] + 4).alias("at"),
        F.when(x["target"], F.concat(acc["spans"], F.array(F.struct((acc["at"] + x["h"]).alias("start"), (acc["at"] + x["h"] + x["b"]).alias("end")))))
        .otherwise(acc["spans"]).alias("spans")), lambda acc: acc["spans"])
    text = F.array_join(F.transform("xs", lambda x: F.concat(x["head"], x["body"], F.lit("</s>"))), "")
    return gathered.select("conv_id", "window", text.alias("formatted"), spans.alias("loss_spans"))


def read_back(shown: DataFrame) -> DataFrame:
    """Per conversation what its windows say: turns and targets, parsed from ``formatted`` and ``loss_spans`` alone."""
    pieces = F.filter(F.split("formatted", "</s>"), lambda x: x != "")
    cut = F.transform(pieces, lambda x: F.struct(
        F.substring_index(x, "]", 1).alias("head"), F.substr(x, F.locate("]", x) + 1, F.length(x)).alias("body")))
    own = F.filter(cut, lambda x: F.endswith(x["head"], F.lit("|n")))
    said = F.transform(own, lambda x: F.concat(
        unescape(F.substring_index(F.substr(x["head"], F.lit(5), F.length(x["head"])), "|", 1)), F.lit("\n"), unescape(x["body"]), F.lit("\n")))
    learned = F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    each = shown.select("conv_id", F.struct(
        "window", F.size(own).cast("long").alias("n"), F.array_join(said, "").alias("turns"), F.array_join(learned, "").alias("loss"),
        F.length("formatted").cast("long").alias("chars")).alias("w"))
    whole = each.groupBy("conv_id").agg(F.array_sort(F.collect_list("w")).alias("ws"))
    total = lambda name: F.aggregate(F.transform("ws", lambda w: w[name]), F.lit(0).cast("long"), lambda a, x: a + x)
    joined = lambda name: F.array_join(F.transform("ws", lambda w: w[name]), "")
    return whole.select(
        "conv_id", total("n").alias("n_turns"), F.sha2(joined("turns"), 256).alias("turns_sha256"), F.length(joined("loss")).cast("long").alias("loss_chars"),
        F.sha2(joined("loss"), 256).alias("loss_sha256"), total("chars").alias("formatted_chars"), F.size("ws").cast("long").alias("n_windows"))


def probe_conversation(turns: DataFrame) -> DataFrame:
    """Conversation -1, whose texts are made of control strings."""
    said = F.lit("</s>[INST] ok [/INST]")
    rows = turns.sparkSession.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    return turns.select(*(F.col(c).cast(t).alias(c) for c, t in rows.dtypes)).unionByName(rows)
