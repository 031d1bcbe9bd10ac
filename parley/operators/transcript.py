"""Numbered bilingual transcripts and the two panel views.

Each processed turn has two texts: English (``en``) and the patient language
(``xx``). Numbering restarts after a clear event (a new epoch). The two panels
are projections of the same rows, so pairing a turn across panels needs no
join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.functions import fixed_values as fv
from parley.functions.text import is_nonblank, tag
from parley.operators.route import speaker_of
from parley.operators.sequence import reset_count


def chat_events(conversations: DataFrame) -> DataFrame:
    """Event form of the conversation table: a system row opens a fresh chat
    (a clear event); user / assistant rows are turns."""
    return conversations.select(
        "conv_id", "turn",
        F.when(F.col("role") == "system", F.lit("clear")).otherwise(F.lit("turn")).alias("kind"),
        speaker_of(F.col("role")).alias("speaker"), "text")


def number_turns(events: DataFrame, digest: bool = False) -> DataFrame:
    """``conv_id, turn, epoch, turn_no``: ``epoch`` = clear events at or
    before the row; ``turn_no`` = 1, 2, ... over the non-blank turns of the
    epoch. Clear rows and blank turns are dropped. The text is reduced to a
    blank flag first, so the numbering shuffles only narrow rows (and to ``digest``, if asked)."""
    narrow = events.select("conv_id", "turn", (F.col("kind") == "clear").alias("_clear"),
                           ((F.col("kind") == "turn") & is_nonblank(F.col("text"))).alias("_shown"),
                           *([F.xxhash64("text").alias("digest")] if digest else []))
    n = reset_count(narrow, "conv_id", "turn", "_clear", "_shown", "epoch", "turn_no")
    return n.where(F.col("_shown")).select("conv_id", "turn", "epoch", "turn_no", *(["digest"] if digest else []))


def current_epoch(numbered: DataFrame, events: DataFrame) -> DataFrame:
    """The numbered turns since their conversation's last clear event; a clear
    with nothing after it leaves none. Only (conv_id, count) is joined."""
    last = events.groupBy("conv_id").agg(F.sum((F.col("kind") == "clear").cast("long")).alias("epoch"))
    last = last.select(F.col("conv_id").alias("_conv"), F.col("epoch").alias("_epoch"))
    return (numbered
            .join(last, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("epoch") == F.col("_epoch")), "left_semi"))


def transcript(processed: DataFrame, events: DataFrame) -> DataFrame:
    """One row per shown turn of the current epoch: ``conv_id, epoch, turn_no, speaker, role, en,
    xx, tag, simplified, error``. A failed turn shows its message on its own
    side and a placeholder on the other; a failed doctor turn has no tag; the
    rewrite is shown only when non-empty. A null conversation or turn number is a key
    like any other; turns of one key are told apart by their texts."""
    numbered = current_epoch(number_turns(events, digest=True), events).select(
        F.col("conv_id").alias("_conv"), F.col("turn").alias("_turn"), F.col("digest").alias("_digest"), "epoch", "turn_no")
    p = processed.join(numbered, F.col("conv_id").eqNullSafe(F.col("_conv")) & F.col("turn").eqNullSafe(F.col("_turn"))
                       & (F.xxhash64("original") == F.col("_digest")))
    doctor = F.col("speaker") == "doctor"
    failed = F.col("error").isNotNull()
    en = F.when(doctor, F.col("original")).otherwise(
        F.when(failed, F.lit(fv.PLACEHOLDER_PATIENT_FAILED)).otherwise(F.col("translation")))
    xx = F.when(~doctor, F.col("original")).otherwise(
        F.when(failed, F.lit(fv.PLACEHOLDER_DOCTOR_FAILED)).otherwise(F.col("translation")))
    shown_tag = F.when(doctor & ~failed, tag(F.col("medical"), F.col("confidence")))
    shown_simpl = F.when(doctor & ~failed & (F.length("simplified") > 0), F.col("simplified"))
    return p.select("conv_id", "epoch", "turn_no", "speaker",
                    F.when(doctor, F.lit("assistant")).otherwise(F.lit("user")).alias("role"),
                    en.alias("en"), xx.alias("xx"), shown_tag.alias("tag"),
                    shown_simpl.alias("simplified"), "error")


def panel_history(tr: DataFrame) -> DataFrame:
    """Both panels in long form ``conv_id, epoch, panel, turn_no, role,
    content`` (one pass: each transcript row yields its two panel rows)."""
    e = F.explode(F.array(
        F.struct(F.lit("doctor").alias("panel"), F.col("en").alias("content")),
        F.struct(F.lit("patient").alias("panel"), F.col("xx").alias("content"))))
    return (tr.select("conv_id", "epoch", "turn_no", "role", e.alias("p"))
            .select("conv_id", "epoch", F.col("p.panel").alias("panel"), "turn_no", "role",
                    F.col("p.content").alias("content")))


def bilingual_pairs(tr: DataFrame) -> DataFrame:
    """The same turn in both panels, side by side."""
    return tr.select("conv_id", "epoch", "turn_no", "role",
                     F.col("en").alias("doctor_panel"), F.col("xx").alias("patient_panel"))
