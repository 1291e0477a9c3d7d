"""Chat formatting by rotating perspectives.

For every participant of a conversation the dialogue is rendered with that speaker as the assistant and all others as
named users; only the assistant's words are trained on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import positions

SHARED = "system"
UNNAMED = "unknown"


def _harmless(text: Column) -> Column:
    """The text with its marks broken up."""
    return F.replace(text, F.lit("<|im_"), F.lit("<| im_"))


def _shown(role: Column) -> Column:
    """A role as it stands in a header: marks broken up, line ends as spaces; a null role has the name for it."""
    return F.translate(_harmless(F.coalesce(role, F.lit(UNNAMED))), "\n\r", "  ")


def _piece(head: Column, message: Column) -> Column:
    return F.concat(F.lit("<|im_start|>"), head, F.lit("\n"), message["text"], F.lit("<|im_end|>\n"))


def rotate(turns: DataFrame, chunk: int = 64) -> DataFrame:
    """One row per conversation, speaker and run of ``chunk`` messages.

    Columns: conv_id, speaker, chunk (0, 1, ...: the dialogue is their texts joined), n_messages, n_trained, rendered,
    spans array<struct<start, end>> (character offsets in ``rendered`` of the words and the end mark the speaker is
    trained on) and masks array<int> (1 for the speaker's messages).

    Speakers are the distinct roles but ``system``, whose messages stay shared instructions in every perspective; a
    conversation with no other role gives no rows. Messages are ordered by turn (null last), role and text. A null role
    is a speaker of its own, null, shown as ``unknown``; a null text is empty, a null conv_id is a conversation of its
    own. Repeated rows are messages of their own. Marks inside a text or a role are broken up and line ends in a role
    become spaces, so neither can start a turn; speakers are told apart by their roles as given. Other columns are not
    read. Conversations of any length are rendered in bounded rows: no task holds a whole one.
    """
    text = _harmless(F.coalesce(F.col("text"), F.lit("")))
    rows = turns.select("conv_id", F.col("turn").isNull().alias("__last"), "turn", "role", text.alias("text"))
    rows = positions(rows, [F.col(c) for c in ("conv_id", "__last", "turn", "role", "text")], "__position", "turns")
    begins = rows.groupBy("conv_id").agg(F.min("__position").alias("__begin"))
    rows = rows.join(begins.withColumnRenamed("conv_id", "__conv"), F.expr("conv_id <=> __conv"))
    place = F.col("__position") - F.col("__begin")
    chunks = rows.select(
        "conv_id", (place - F.pmod(place, F.lit(chunk))).alias("__first"), place.alias("__place"), "role", "text",
    ).groupBy("conv_id", "__first").agg(F.sort_array(F.collect_list(F.struct("__place", "role", "text"))).alias("messages"))
    speakers = rows.filter(~F.col("role").eqNullSafe(SHARED)).select(F.col("conv_id").alias("__conv"), F.col("role").alias("speaker")).distinct()
    seen = chunks.join(speakers, F.expr("conv_id <=> __conv"))

    def piece(m: Column) -> Column:
        head = F.when(m["role"].eqNullSafe(SHARED), SHARED).when(m["role"].eqNullSafe(F.col("speaker")), "assistant")
        head = head.otherwise(F.concat(F.lit("user name="), _shown(m["role"])))
        return _piece(head, m)

    def grow(acc: Column, m: Column) -> Column:
        size = F.length(piece(m))
        mine = m["role"].eqNullSafe(F.col("speaker"))
        # The trained part leaves out the header line before it and the line feed after it.
        span = F.struct((acc["at"] + F.length(F.lit("<|im_start|>assistant\n"))).alias("start"), (acc["at"] + size - 1).alias("end"))
        return F.struct((acc["at"] + size).alias("at"), F.when(mine, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    none = F.array().cast("array<struct<start:int,end:int>>")
    return seen.select(
        "conv_id", "speaker", F.expr(f"__first div {chunk}").alias("chunk"), F.size("messages").cast("long").alias("n_messages"),
        F.size(F.filter("messages", lambda m: m["role"].eqNullSafe(F.col("speaker")))).cast("long").alias("n_trained"),
        F.array_join(F.transform("messages", piece), "").alias("rendered"),
        F.aggregate("messages", F.struct(F.lit(0).alias("at"), none.alias("spans")), grow, lambda acc: acc["spans"]).alias("spans"),
        F.transform("messages", lambda m: m["role"].eqNullSafe(F.col("speaker")).cast("int")).alias("masks"),
    )
