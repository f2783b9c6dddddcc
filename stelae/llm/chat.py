"""Chat formatting by multi-party perspective rotation, in DataFrame functions only.

For every participant of a conversation the dialogue is rendered anew: that speaker's turns are the assistant's, all
others are users who carry their names, and the training mask covers the content of the assistant's turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the template.
OPEN, NAME, HEAD, CLOSE = "<|im_start|>", " name=", "\n", "<|im_end|>\n"
NARRATOR = "system"


def segments(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each turn and perspective: (conv_id, perspective, turn, speaker, as_role, rendered, mask, mask_from, mask_to).

    ``perspective`` is every speaker of the conversation but the narrator ``system``, whose turns stay system turns in
    each rendering. ``mask`` says whether the turn is trained on; ``mask_from``/``mask_to`` bound its content within
    ``rendered``, in code points, end exclusive (equal where the mask is off). A null speaker is named ``unknown``, a
    null text is empty; rows without a conversation are left out; repeated turns are rendered each. No turns are
    gathered: a long conversation is as many rows, and the speakers of a conversation are found by partial aggregation.
    """
    said = turns.where(F.col(conv).isNotNull()).select(
        F.col(conv).alias("conv_id"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("unknown")).alias("speaker"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("content"),
    )
    seats = said.where(F.col("speaker") != NARRATOR).select("conv_id", F.col("speaker").alias("perspective")).distinct()
    return _render(said.join(seats, "conv_id"))


def _render(pairs: DataFrame) -> DataFrame:
    own = F.col("speaker") == F.col("perspective")
    as_role = F.when(own, "assistant").when(F.col("speaker") == NARRATOR, NARRATOR).otherwise("user")
    name: Column = F.when(~own & (F.col("speaker") != NARRATOR), F.concat(F.lit(NAME), "speaker")).otherwise("")
    head = F.concat(F.lit(OPEN), as_role, name, F.lit(HEAD))
    start = F.length(head)
    return pairs.select(
        "conv_id",
        "perspective",
        "turn",
        "speaker",
        as_role.alias("as_role"),
        F.concat(head, "content", F.lit(CLOSE)).alias("rendered"),
        own.alias("mask"),
        start.cast("bigint").alias("mask_from"),
        F.when(own, start + F.length("content")).otherwise(start).cast("bigint").alias("mask_to"),
    )


def dialogues(turns: DataFrame, block: int = 256, **columns: str) -> DataFrame:
    """Renderings joined to texts: (conv_id, perspective, block, rendered, masks), turns in order of (turn, speaker, text).

    ``block`` numbers spans of that many turn numbers, so that no row gathers more than a span, however long the
    conversation; a conversation of fewer turns is one row. ``masks`` are (start, end) of the trained contents within
    the row's text, in code points.
    """
    parts = segments(turns, **columns).withColumn("block", F.floor(F.coalesce(F.col("turn"), F.lit(0)) / block))
    piece = F.struct("turn", "speaker", "rendered", "mask", "mask_from", "mask_to")
    lined = parts.groupBy("conv_id", "perspective", "block").agg(F.array_sort(F.collect_list(piece)).alias("parts"))
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("masks"))
    walked = F.aggregate(
        "parts",
        zero,
        lambda a, x: F.struct(
            (a["at"] + F.length(x["rendered"])).alias("at"),
            F.when(x["mask"], F.concat(a["masks"], F.array(F.struct((a["at"] + x["mask_from"]).alias("start"), (a["at"] + x["mask_to"]).alias("end")))))
            .otherwise(a["masks"])
            .alias("masks"),
        ),
        lambda a: a["masks"],
    )
    return lined.select("conv_id", "perspective", "block", F.array_join(F.transform("parts", lambda x: x["rendered"]), "").alias("rendered"), walked.alias("masks"))
