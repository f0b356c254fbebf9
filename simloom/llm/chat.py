"""Multi-party perspective rotation: every participant of a dialogue gets a copy in which it is the assistant."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simloom.operators.prefix import numbered

#: Turns of one rendered row; longer dialogues go on in further parts, none is cut off.
PART_TURNS = 512
OPEN, CLOSE = "<|", "|>\n"
END = "<|end|>\n"


def rotate(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text",
           system: str = "system", part_turns: int = PART_TURNS) -> DataFrame:
    """(conv, perspective, part, n_turns, n_trained, rendered, spans): a row per participant and part of a dialogue.

    Participants are the distinct non-empty speakers other than ``system``. A turn of the perspective is rendered
    under ``assistant``, another speaker's under ``user`` with the speaker's name, system turns and turns without a speaker under
    ``system``. ``spans`` covers ``rendered`` from left to right as (chars, train): only the text and end mark of the
    perspective's own turns are trained on. Turns go by (turn, speaker, text) with NULL first; NULL text is
    empty. A dialogue without participants gives no rows, one with a NULL id is a dialogue of its own. A dialogue
    of more than ``part_turns`` turns is rendered in parts, so no row grows without bound.
    """
    rows = turns.select(
        F.col(conv).alias("_conv"), F.col(turn).alias("_turn"),
        F.coalesce(F.col(speaker).cast("string"), F.lit("")).alias("_who"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"),
    )
    placed = numbered(rows, ["_conv"], ["_turn", "_who", "_text"], "_n").withColumn(
        "_part", F.expr(f"(_n - 1) div {int(part_turns)}"))
    people = rows.filter((F.col("_who") != "") & (F.col("_who") != system)).select(
        F.col("_conv").alias("_c"), F.col("_who").alias("perspective")).distinct()
    seen = placed.join(people, F.col("_conv").eqNullSafe(F.col("_c"))).drop("_c")
    own = F.col("_who") == F.col("perspective")
    head = F.concat(
        F.lit(OPEN),
        F.when(own, F.lit("assistant"))
        .when((F.col("_who") == "") | (F.col("_who") == system), F.lit("system"))
        .otherwise(F.concat(F.lit("user name="), F.col("_who"))),
        F.lit(CLOSE),
    )
    body = F.concat(F.col("_text"), F.lit(END))
    piece = F.struct(F.col("_n").alias("n"), own.alias("own"), head.alias("head"), body.alias("body"))
    grouped = seen.groupBy("_conv", "perspective", "_part").agg(
        F.sort_array(F.collect_list(piece)).alias("p"), F.count("*").alias("n_turns"), F.count_if(own).alias("n_trained"))
    spans = F.flatten(F.transform("p", lambda x: F.array(
        F.struct(F.char_length(x["head"]).alias("chars"), F.lit(False).alias("train")),
        F.struct(F.char_length(x["body"]).alias("chars"), x["own"].alias("train")),
    )))
    rendered = F.array_join(F.transform("p", lambda x: F.concat(x["head"], x["body"])), "")
    return grouped.select(F.col("_conv").alias(conv), "perspective", F.col("_part").alias("part"), "n_turns", "n_trained",
                          rendered.alias("rendered"), spans.alias("spans"))
