"""Preference formatting, in DataFrame operations only.

``paired`` takes pairs of conversations, chosen and rejected, and formats each
pair: the longest common prefix of their turns is rendered once as the prompt,
and the turns after it are the two completions, each with a mask, the spans
(start, stop; code points, stop exclusive) of its text to train on: the
contents of assistant turns.

A turn is rendered as ``<|im_start|>role``, line end, text, ``<|im_end|>``,
line end. Turns go by number; rows that share a turn number are one turn, in
the order of role and text, and repeated rows count once. The prefix ends at
the first turn number whose rows differ or which one side lacks.

A pair is one row: its conversations are gathered for it, as it is what one
training example holds. The prefix is found before, by a minimum over turns.
Identical conversations are all prompt; identical marks them, and that there is
nothing to prefer. ``<|`` in roles and texts is written as ``< |``, so that
nothing in them reads as a mark of turns.

``by_opening`` makes the pairs where none are given: conversations with the
same opening turn are alternatives to one prompt, and neighbours by conv_id
are paired, the smaller as chosen. Neighbours are found within ranges of RANGE
ids first, and the one that a range may leave over with those of the other
ranges, so an opening shared by most conversations does not meet in a task.
A conversation without partner is formatted alone: it is all chosen, and
rejected is null.

Rows without conv_id or turn take no part. Null roles and texts render as
empty. Empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGE = 4096


def turns_of(conversations: DataFrame) -> DataFrame:
    """Distinct rows (conv_id, turn, role, text)."""
    rows = conversations.filter("conv_id is not null and turn is not null")
    plain = lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit("<|"), F.lit("< |")).alias(c)
    return rows.select("conv_id", "turn", plain("role"), plain("text")).distinct()


def by_opening(turns: DataFrame) -> DataFrame:
    """Rows (pair_id, chosen_id, rejected_id): every conversation once."""
    opening = turns.groupBy("conv_id").agg(F.min(F.struct("turn", "role", "text")).alias("o"))
    convs = opening.select("conv_id", F.xxhash64("o.role", "o.text").alias("h"), F.md5(F.concat_ws("\n", "o.role", "o.text")).alias("key"))
    convs = convs.withColumn("range", F.floor(F.col("conv_id") / RANGE))

    def neighbours(rows: DataFrame, *by: str) -> DataFrame:
        w = Window.partitionBy(*by).orderBy("conv_id")
        return rows.withColumn("rn", F.row_number().over(w)).withColumn("next", F.lead("conv_id").over(w)).filter("rn % 2 = 1")

    near = neighbours(convs, "h", "key", "range")
    far = neighbours(near.filter("next is null").select("conv_id", "h", "key"), "h", "key")
    found = near.filter("next is not null").select("conv_id", "next").union(far.select("conv_id", "next"))
    return found.select(F.col("conv_id").alias("pair_id"), F.col("conv_id").alias("chosen_id"), F.col("next").alias("rejected_id"))


def rendered(turn: Column) -> Column:
    return F.concat(F.lit("<|im_start|>"), turn["role"], F.lit("\n"), turn["text"], F.lit("<|im_end|>\n"))


def _joined(turns: Column) -> Column:
    return F.array_join(F.transform(turns, rendered), "")


def _mask(turns: Column) -> Column:
    """Spans of the assistant's contents in what _joined gives."""
    empty = F.array().cast("array<struct<start:int,stop:int>>")

    def walk(acc: Column, t: Column) -> Column:
        start = acc["at"] + F.length(t["role"]) + 13
        span = F.struct(start.cast("int").alias("start"), (start + F.length(t["text"])).cast("int").alias("stop"))
        return F.struct((acc["at"] + F.length(rendered(t))).cast("int").alias("at"), F.when(t["role"] == "assistant", F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, F.struct(F.lit(0).alias("at"), empty.alias("spans")), walk)["spans"]


def paired(turns: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows (pair_id, chosen_id, rejected_id, n_prefix_turns, prompt, chosen, rejected, chosen_mask, rejected_mask, identical).

    turns as ``turns_of`` gives them; pairs(pair_id, chosen_id, rejected_id).
    """
    sides = pairs.select("pair_id", F.col("chosen_id").alias("conv_id"), F.lit(0).alias("side"), F.col("rejected_id").isNull().alias("alone"))
    sides = sides.union(pairs.filter("rejected_id is not null").select("pair_id", F.col("rejected_id").alias("conv_id"), F.lit(1).alias("side"), F.lit(False).alias("alone")))
    item = F.struct("turn", "role", "text")
    of = lambda s: F.array_sort(F.collect_list(F.when(F.col("side") == s, item)))
    rows = turns.join(sides, "conv_id").groupBy("pair_id").agg(of(0).alias("c"), of(1).alias("r"), F.first("alone").alias("alone"))

    # The first turn that is not the same on both sides.
    apart = F.concat(F.array_except("c", "r"), F.array_except("r", "c"))
    first = F.array_min(F.transform(F.when(F.col("alone"), F.col("c")).otherwise(apart), lambda t: t["turn"]))
    rows = rows.withColumn("first", first).join(pairs, "pair_id")
    last = F.coalesce("first", F.lit((1 << 63) - 1))
    prompt, chosen, rejected = F.filter("c", lambda t: t["turn"] < last), F.filter("c", lambda t: t["turn"] >= last), F.filter("r", lambda t: t["turn"] >= last)
    alone = F.col("alone")
    return rows.select(
        "pair_id", "chosen_id", "rejected_id",
        F.size(F.array_distinct(F.transform(prompt, lambda t: t["turn"]))).cast("long").alias("n_prefix_turns"),
        _joined(prompt).alias("prompt"),
        _joined(chosen).alias("chosen"),
        F.when(~alone, _joined(rejected)).alias("rejected"),
        _mask(chosen).alias("chosen_mask"),
        F.when(~alone, _mask(rejected)).alias("rejected_mask"),
        F.col("first").isNull().alias("identical"),
    )


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["start"], s["stop"])), ",")
