"""Preference pairs: the longest common prefix of turns once as prompt, then both completions with their loss masks.

A part of a pair (prompt, chosen or rejected) is rendered in segments of SEGMENT turn numbers, one row each: an
ordinary pair has three rows, and a conversation of any length is never gathered whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Turn numbers that one row renders.
SEGMENT = 256


def _rendered(role: str = "role", text: str = "text"):
    return F.concat(F.lit("<|"), F.coalesce(role, F.lit("")), F.lit("|>\n"), F.coalesce(text, F.lit("")), F.lit("<|end|>\n"))


def preference_turns(turns: DataFrame) -> DataFrame:
    """pair_id, part (prompt, chosen or rejected), turn, role, loss_mask and rendered for each turn that is emitted.

    ``turns`` has pair_id, side (0: chosen, 1: rejected), turn, role and text.  The prompt of a pair
    is every turn before the first at which the two sides' (role, text) differ, taken from the chosen
    side; later turns are completions, whose assistant turns alone have loss_mask 1.  Equal sides
    have prompt rows only; a side without turns leaves the other one whole.  Several rows of one turn
    are compared as a bag, by value, and all emitted.  A null role or text renders as empty and equals null alone.
    Rows without pair_id, side or turn are left out.  An empty table gives an empty result; other columns are ignored.
    """
    rows = turns.select("pair_id", "side", "turn", "role", "text").where("pair_id is not null and turn is not null and side in (0, 1)")
    one_sided = rows.groupBy("pair_id", "turn", "role", "text").agg(F.sum(1 - 2 * F.col("side")).alias("more")).where("more <> 0")
    parted = one_sided.groupBy("pair_id").agg(F.min("turn").alias("parted"))
    prompt = F.col("parted").isNull() | (F.col("turn") < F.col("parted"))
    part = F.when(prompt, "prompt").when(F.col("side") == 0, "chosen").otherwise("rejected")
    told = rows.join(parted, "pair_id", "left").withColumn("part", part).where("part <> 'prompt' or side = 0")
    return told.select("pair_id", "part", "turn", "role", F.when((F.col("part") != "prompt") & (F.col("role") == "assistant"), 1).otherwise(0).alias("loss_mask"), _rendered().alias("rendered"))


def preference_parts(turns: DataFrame) -> DataFrame:
    """pair_id, part, segment, first_turn, n_turns, rendered and loss_mask of each part of each pair.

    What :func:`preference_turns` emits, the turns of a segment joined in order of turn, role and text;
    ``loss_mask`` has a digit for each of them, 1 where it is trained on.  Nulls, repeats, ties and empty tables
    are treated as there; equal rows of one turn may change places.
    """
    told = preference_turns(turns).withColumn("segment", F.floor(F.col("turn") / SEGMENT))
    turn = F.sort_array(F.collect_list(F.struct("turn", F.col("rendered"), F.col("loss_mask"))))
    parts = told.groupBy("pair_id", "part", "segment").agg(turn.alias("of"))
    return parts.select(
        "pair_id", "part", "segment", F.col("of")[0]["turn"].alias("first_turn"), F.size("of").cast("long").alias("n_turns"),
        F.array_join(F.col("of.rendered"), "").alias("rendered"), F.array_join(F.col("of.loss_mask").cast("array<string>"), "").alias("loss_mask"),
    )


def contrasted(conversations: DataFrame) -> DataFrame:
    """Turns of preference pairs, one pair for each conversation that has an assistant's turn.

    Chosen is the conversation up to its last assistant's turn.  Rejected is the same with that turn answered
    as the other conversation of its pair of neighbours (2k and 2k + 1) ends: a reply to something else.  Without such a
    neighbour there is no rejected side.  Rows without conv_id or turn are left out; a null text or role is a value like any other.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").where("conv_id is not null and turn is not null")
    last = rows.where("role = 'assistant'").groupBy("conv_id").agg(F.max("turn").alias("last"))
    told = rows.join(last, "conv_id").where("turn <= last")
    own = told.select(F.col("conv_id").alias("pair_id"), "turn", "role", "text", F.expr("if(turn < last, array(0, 1), array(0))").alias("sides"))
    reply = told.where("turn = last and role = 'assistant'").select((F.col("conv_id") + 1 - 2 * F.pmod("conv_id", F.lit(2))).alias("pair_id"), "role", "text")
    foreign = reply.join(last.withColumnRenamed("conv_id", "pair_id"), "pair_id").select("pair_id", F.col("last").alias("turn"), "role", "text", F.array(F.lit(1)).alias("sides"))
    paired = reply.select("pair_id").distinct().withColumn("paired", F.lit(True))
    both = own.join(paired, "pair_id", "left").select("pair_id", "turn", "role", "text", F.when(F.col("paired"), F.col("sides")).otherwise(F.array(F.lit(0))).alias("sides"))
    return both.unionByName(foreign).select("pair_id", F.explode("sides").alias("side"), "turn", "role", "text")
