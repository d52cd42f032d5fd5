"""Preference pairs: the common turns of two conversations as prompt, what follows as completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlake.llm.common import durable
from ledgerlake.llm.sketches import successors

OPEN, MIDDLE, CLOSE = "<|", "|>\n", "<|end|>\n"
TRAINED = "assistant"  # the role whose words a completion teaches
BLOCK_BITS = 9  # conversations whose ids agree but for so many bits make a block


def _rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(MIDDLE), text, F.lit(CLOSE))


def formatted(turns: DataFrame) -> DataFrame:
    """pair_id, prompt_turns, prompt, chosen, rejected, chosen_mask, rejected_mask.

    `turns` has a row per turn: pair_id, side ('chosen' or 'rejected'), turn, role, text. The
    prompt is the longest prefix of turns with the same role and text on both sides, each
    rendered as <|role|>, its text and <|end|>. A completion is the rest of its side; its mask
    lists the parts [start, end) of it, in code points, that are taught: the text and end mark
    of each assistant turn. All else, the prompt included, is masked.

    Turns stand in order of `turn`, those without number first, then of role and text; rows
    that are equal in all of these count once, and all others count. A null role or text is
    empty. Rows without pair_id or with another side are left out. A pair with one
    side has an empty prompt and an empty other completion; sides that are equal have empty
    completions. Other columns are ignored.

    The sides are compared by the position of each turn among those of its side."""
    rows = turns.filter("pair_id is not null and side in ('chosen', 'rejected')").select(
        "pair_id", "side", F.coalesce(F.col("turn").cast("long"), F.lit(-(2**63))).alias("turn"),
        F.struct(F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                 F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("said"),
    )
    said = lambda side: F.transform(
        F.array_sort(F.collect_list(F.when(F.col("side") == side, F.struct("turn", "said")))), lambda t: t["said"]).alias(side)
    return _rendered_pairs(rows.distinct().groupBy("pair_id").agg(said("chosen"), said("rejected")))


def _rendered_pairs(paired: DataFrame) -> DataFrame:
    """formatted() of rows pair_id, chosen, rejected: arrays of (role, text) in order."""
    least = F.least(F.size("chosen"), F.size("rejected"))
    places = F.when(least > 0, F.sequence(F.lit(0), least - 1)).otherwise(F.array().cast("array<int>"))
    differs = F.filter(places, lambda i: F.get("chosen", i) != F.get("rejected", i))
    paired = paired.withColumn("first", F.coalesce(F.get(differs, F.lit(0)), least))
    rest = lambda side: F.slice(side, F.col("first") + 1, F.size(side)).alias(side)
    paired = paired.select("pair_id", F.slice("chosen", F.lit(1), F.col("first")).alias("shared"), rest("chosen"), rest("rejected"))
    prompt = F.array_join(F.transform("shared", lambda t: _rendered(t["role"], t["text"])), "")
    completion = lambda side: F.array_join(
        F.transform(side, lambda s: _rendered(s["role"], s["text"])), "").alias(side)
    return paired.select(
        "pair_id", F.size("shared").alias("prompt_turns"), prompt.alias("prompt"),
        completion("chosen"), completion("rejected"),
        _mask("chosen").alias("chosen_mask"), _mask("rejected").alias("rejected_mask"),
    )


def _mask(side: str) -> Column:
    """The taught parts of a completion."""
    def step(at: Column, said: Column) -> Column:
        start = at["place"] + F.length(said["role"]) + len(OPEN) + len(MIDDLE)
        end = start + F.length(said["text"]) + len(CLOSE)
        span = F.struct(start.alias("start"), end.alias("end"))
        taught = F.when(said["role"] == TRAINED, F.concat(at["spans"], F.array(span))).otherwise(at["spans"])
        return F.struct(end.alias("place"), taught.alias("spans"))

    none = F.array().cast("array<struct<start:int,end:int>>")
    return F.aggregate(side, F.struct(F.lit(0).alias("place"), none.alias("spans")), step, lambda at: at["spans"])


def _sides(conversations: DataFrame) -> DataFrame:
    """pair_id, chosen, rejected: arrays of (turn, role, text) in order; see pairs_of().

    Texts move once, to the block of their conv_id. The conversation before the first of a
    block is the last one of the nearest block below that has any: its assistant turns are
    sent along."""
    said = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.coalesce(F.col("turn").cast("long"), F.lit(-(2**63))).alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    block = F.shiftright("conv_id", BLOCK_BITS)
    lasts = durable(said.groupBy(block.alias("block")).agg(F.max("conv_id").alias("conv_id")))
    lowest, highest = lasts.agg(F.min("block"), F.max("block")).first()
    above = successors(lasts.select("block"), lowest or 0, highest or 0)
    sent = durable(lasts.join(above, "block").filter("above is not null").select("conv_id", F.col("above").alias("block")))
    before = said.filter(F.col("role") == TRAINED).join(sent, "conv_id").select(*said.columns, "block")
    rows = said.withColumn("block", block).unionByName(before).repartition("block")
    # Grouping and window keep the rows where they are.
    talks = rows.groupBy("block", "conv_id").agg(F.array_sort(F.collect_set(F.struct("turn", "role", "text"))).alias("chosen"))
    taught = F.filter("chosen", lambda t: t["role"] == TRAINED)
    talks = talks.withColumn("taught", taught)
    talks = talks.withColumn("earlier", F.lag("taught").over(Window.partitionBy("block").orderBy("conv_id")))
    talks = talks.filter(F.col("block") == block).withColumn("last", F.element_at(F.when(F.size("taught") > 0, F.col("taught")), -1))
    place = F.size(F.filter("taught", lambda t: t["turn"] == F.col("last.turn")))
    same = F.filter("earlier", lambda t: t["turn"] == F.col("last.turn"))
    talks = talks.withColumn("other", F.coalesce(F.get(same, place - 1)["text"], F.lit("")))
    changed = F.transform("chosen", lambda t: F.when(
        t == F.col("last"), F.struct(t["turn"].alias("turn"), t["role"].alias("role"), F.col("other").alias("text"))).otherwise(t))
    return talks.select(F.col("conv_id").alias("pair_id"), "chosen", F.array_sort(F.array_distinct(changed)).alias("rejected"))


def pairs_of(conversations: DataFrame) -> DataFrame:
    """Preference pairs from a table of conversations, as `turns` for formatted(): a
    conversation as it is was chosen; in the rejected one the last assistant turn says
    what the assistant says in the turn of the same number of the conversation before it, which
    has the next smaller conv_id there is, or nothing if there is none. Of different assistant
    turns with one number the first by text answers to the first, the second to the second.
    Repeated rows count once. Conversations without assistant have equal sides; rows without
    conv_id are left out. An empty table gives no rows; other columns are ignored."""
    sides = _sides(conversations)
    listed = lambda side: sides.select("pair_id", F.lit(side).alias("side"), F.explode(side).alias("t")).select(
        "pair_id", "side", "t.turn", "t.role", "t.text")
    return listed("chosen").union(listed("rejected"))


def pairs(conversations: DataFrame) -> DataFrame:
    """formatted(pairs_of(conversations)), without grouping the turns again."""
    bare = lambda side: F.transform(side, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias(side)
    return _rendered_pairs(_sides(conversations).select("pair_id", bare("chosen"), bare("rejected")))
