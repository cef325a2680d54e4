"""Chat formatting by perspective rotation.

Every participant of a conversation (each role but the system's) is once the
assistant: the dialogue is rendered with that speaker as assistant, all others as
users under their names, and the loss mask covers exactly the assistant's words
with the closing mark. Each perspective is one dialogue. It is stored in parts of
PART_TURNS turns at most, so no task gathers a conversation of unbounded length:
the parts' texts in order, joined by line breaks, are the dialogue, `start` is where
a part begins in it, and masks are places in the whole dialogue.

Turns are numbered within (conversation, block of turn numbers) and gathered by
part, then meet the conversation's list of participants; rendering and mask places
are array expressions, and parts are placed by running sums of their lengths.

Nulls and edge cases: rows without conv_id belong to no conversation and give
nothing; a null turn sorts first; a null role is the participant `unknown`; a null
text is empty; repeated rows are turns of their own, rows of one turn are in the
order of role and text; the marks' opening `<|` in a text or role becomes `< |`, in a
role the closing `|>` becomes `| >` and a line break a space; a conversation of the
system alone gives no rows; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PART_TURNS = 64
SYSTEM = "system"


def _safe(text: Column) -> Column:
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def _safe_role(role: Column) -> Column:
    return F.translate(F.replace(_safe(role), F.lit("|>"), F.lit("| >")), "\r\n", "  ")


def turns_in_parts(turns: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """conv_id, block, piece (a part's place, block first) and said, the part's (turn, role, text) in order."""
    role = F.coalesce(F.col("role").cast("string"), F.lit("unknown"))
    turn = F.coalesce(F.col("turn").cast("long"), F.lit(-(1 << 62)))
    rows = turns.where(F.col("conv_id").isNotNull()).select("conv_id", turn.alias("turn"), role.alias("role"), _safe(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text"))
    rows = rows.withColumn("block", F.floor(F.col("turn") / part_turns).cast("long"))
    place = F.row_number().over(Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text"))
    rows = rows.withColumn("piece", F.floor((place - 1) / part_turns).cast("long"))
    return rows.groupBy("conv_id", "block", "piece").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("said"))


def rotate(turns: DataFrame, part_turns: int = PART_TURNS, system: str = SYSTEM) -> DataFrame:
    """conv_id, perspective, part, n_turns, start, text and masks, an array of (start, end) in code points, end exclusive."""
    parts = turns_in_parts(turns, part_turns)
    role = F.coalesce(F.col("role").cast("string"), F.lit("unknown"))
    speakers = turns.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").alias("speaker_conv"), role.alias("perspective")).distinct().where(F.col("perspective") != system)
    seen = parts.join(speakers, parts["conv_id"] == speakers["speaker_conv"])
    own = F.col("perspective")

    def opening(x: Column) -> Column:
        head = F.when(x["role"] == system, F.lit("<|system|>")).when(x["role"] == own, F.lit("<|assistant|>")).otherwise(F.concat(F.lit("<|user:"), _safe_role(x["role"]), F.lit("|>")))
        return F.concat(head, F.lit("\n"))

    pieces = F.transform("said", lambda x: F.struct(opening(x).alias("head"), F.concat(x["text"], F.lit("<|end|>")).alias("body"), (x["role"] == own).alias("learn")))
    seen = seen.withColumn("pieces", pieces)
    text = F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"])), "\n")
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + F.length(p["head"])
        end = start + F.length(p["body"])
        return F.struct((end + 1).alias("at"), F.when(p["learn"], F.concat(acc["masks"], F.array(F.struct(start.alias("start"), end.alias("end"))))).otherwise(acc["masks"]).alias("masks"))

    masks = F.aggregate("pieces", F.struct(F.lit(0).cast("long").alias("at"), none.alias("masks")), step, lambda acc: acc["masks"])
    done = seen.select("conv_id", "perspective", "block", "piece", F.size("said").alias("n_turns"), text.alias("text"), masks.alias("own_masks"))
    order = Window.partitionBy("conv_id", "perspective").orderBy("block", "piece")
    start = F.coalesce(F.sum(F.length("text") + 1).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = done.withColumn("part", F.row_number().over(order) - 1).withColumn("start", start.cast("long"))
    moved = F.transform("own_masks", lambda m: F.struct((m["start"] + F.col("start")).alias("start"), (m["end"] + F.col("start")).alias("end")))
    return placed.select("conv_id", "perspective", "part", "n_turns", "start", "text", moved.alias("masks"))


def digest(turns: DataFrame) -> DataFrame:
    """What query op5 returns: the masks joined as start:end."""
    masks = F.array_join(F.transform("masks", lambda m: F.concat_ws(":", m["start"].cast("string"), m["end"].cast("string"))), ",")
    return rotate(turns).withColumn("masks", masks)
