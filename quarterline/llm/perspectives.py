"""Conversations seen by each participant: that speaker is the assistant, the others are named users.

A view of a conversation is the same turns once more with other headers, so it is made turn
by turn: a row per (conversation, speaker, turn) with the segment, its place in the view and the part of it
that is trained on. Segments in order are the rendered view; nothing needs a whole conversation in one
row or task. Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: roles that set the scene and are nobody's view
CONTEXT = ("system",)
#: turns per block when places are added up
BLOCK = 512
HEAD, TAIL = "<|im_start|>", "<|im_end|>\n"


def _named(role: Column) -> Column:
    return F.concat(F.lit("user name="), role)


def segment(role: Column, text: Column, own: Column, context: Column) -> Column:
    """One rendered turn."""
    who = F.when(context, role).when(own, F.lit("assistant")).otherwise(_named(role))
    return F.concat(F.lit(HEAD), who, F.lit("\n"), text, F.lit(TAIL))


def views(turns: DataFrame, context: tuple[str, ...] = CONTEXT) -> DataFrame:
    """Rows of every view of ``turns`` (conv_id, turn, role, text).

    conv_id, speaker, position (from 0), role, segment, start (code points of the view before it), length,
    mask_start and mask_end: the part of the view trained on, the text and end mark of the speaker's own turns; both NULL
    elsewhere. Speakers are the distinct roles of a conversation outside of ``context``; a conversation with none has
    no view. Turns follow ``turn``, then role and text; NULL turns come first, a NULL role is ``unknown``, a NULL
    text is empty, repeated rows are turns of their own. Rows with a NULL conv_id are one conversation. Other columns are
    ignored; an empty table gives an empty one.

    Places add up inside blocks of turns and then over blocks, so a conversation with a third of all
    turns is spread over many tasks. The views number (speakers x turns): that is the result asked for.
    """
    rows = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    ).withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 40))))
    scene = F.col("role").isin(*context) if context else F.lit(False)
    sized = rows.select(
        "*", scene.alias("scene"),
        F.length(segment(F.col("role"), F.col("text"), F.lit(False), scene)).alias("other_length"),
        F.length(segment(F.col("role"), F.col("text"), F.lit(True), scene)).alias("own_length"))
    # per block: turns, their length as seen by others, and what each speaker's own turns change
    per_role = sized.groupBy("conv_id", "block", "role", "scene").agg(
        F.count("*").alias("turns"), F.sum("other_length").alias("length"),
        F.sum(F.col("own_length") - F.col("other_length")).alias("change"))
    speakers = per_role.filter(~F.col("scene")).select("conv_id", F.col("role").alias("speaker")).distinct()
    same = F.col("c").eqNullSafe(F.col("conv_id"))
    totals = per_role.groupBy("conv_id", "block").agg(F.sum("turns").alias("turns"), F.sum("length").alias("length"))
    blocks = totals.join(speakers.withColumnRenamed("conv_id", "c"), same).drop("c").join(
        per_role.filter(~F.col("scene")).select(
            F.col("conv_id").alias("c"), F.col("block").alias("k"), F.col("role").alias("s"), "change"),
        same & (F.col("k") == F.col("block")) & (F.col("s") == F.col("speaker")), "left").drop("c", "k", "s")
    earlier = Window.partitionBy("conv_id", "speaker").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    nothing = F.lit(0).cast("bigint")
    offsets = blocks.select(
        F.col("conv_id").alias("c"), F.col("block").alias("k"), "speaker",
        F.coalesce(F.sum("turns").over(earlier), nothing).alias("turns_before"),
        F.coalesce(F.sum(F.col("length") + F.coalesce("change", F.lit(0))).over(earlier), nothing).alias("length_before"))
    seen = sized.join(offsets, same & (F.col("k") == F.col("block"))).withColumn(
        "own", (F.col("role") == F.col("speaker")) & ~F.col("scene"))
    inside = Window.partitionBy("conv_id", "speaker", "block").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    length = F.when(F.col("own"), F.col("own_length")).otherwise(F.col("other_length")).cast("bigint")
    placed = seen.withColumn("length", length).withColumns({
        "position": F.col("turns_before") + F.row_number().over(inside) - 1,
        "start": F.col("length_before") + F.sum("length").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length"),
    })
    end = F.col("start") + F.col("length") - 1
    return placed.select(
        "conv_id", "speaker", "position", "role",
        segment(F.col("role"), F.col("text"), F.col("own"), F.col("scene")).alias("segment"), "start", "length",
        F.when(F.col("own"), end - F.length("text") - (len(TAIL) - 1)).alias("mask_start"),
        F.when(F.col("own"), end).alias("mask_end"))
