"""Labelled corpus construction: positive and negative scans, text
extraction, non-empty / non-blank filters, union, class counts and weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parley.functions.text import is_nonblank, is_nonempty

# Turns per partial string when a conversation's user text is concatenated.
CONCAT_BLOCK_TURNS = 1024


def positive_corpus(documents: DataFrame) -> DataFrame:
    """Positive class: English documents whose text is truthy (null and ``""``
    dropped, whitespace-only kept)."""
    return (documents.where(F.col("lang") == "en")
            .where(is_nonempty(F.col("text")))
            .select(F.lit("pos").alias("source"), F.col("doc_id").alias("id"),
                    "text", F.lit(1).alias("label")))


def user_text_nested(dialogues: DataFrame) -> DataFrame:
    """Nested form (``id, conversations: array<{from, value}>``): the values of
    turns whose ``from`` is exactly ``human``, in order, joined by one space;
    no such turn gives ``""``. Map-only, no shuffle."""
    human = F.filter("conversations", lambda c: c["from"] == F.lit("human"))
    return dialogues.select(
        "id",
        F.coalesce(F.array_join(F.transform(human, lambda c: c["value"]), " "),
                   F.lit("")).alias("text"))


def dialogues_of(conversations: DataFrame) -> DataFrame:
    """The nested form of the conversation table: one row per conversation with its
    turns in order, user as ``human`` and assistant as ``gpt``."""
    who = (F.when(F.col("role") == "user", F.lit("human")).when(F.col("role") == "assistant", F.lit("gpt"))
           .otherwise(F.col("role")))
    turns = F.sort_array(F.collect_list(F.struct("turn", who.alias("from"), F.col("text").alias("value"))))
    return conversations.groupBy(F.col("conv_id").alias("id")).agg(F.transform(
        turns, lambda t: F.struct(t["from"].alias("from"), t["value"].alias("value"))).alias("conversations"))


def user_text_flat(conversations: DataFrame, block: int = CONCAT_BLOCK_TURNS) -> DataFrame:
    """Flat form: user turns of each conversation joined by one space in turn
    order; a conversation without one gives ``""``. Concatenation happens in two steps (blocks of ``block`` turns, then
    the blocks) so one very long conversation is split over many tasks before
    its final string is assembled."""
    user = F.when(F.col("role") == "user", F.struct("turn", "text"))      # others aren't collected
    chunks = (conversations.groupBy("conv_id", F.floor(F.col("turn") / block).alias("blk"))
              .agg(F.collect_list(user).alias("said"))
              .select("conv_id", "blk", F.when(F.size("said") > 0, F.array_join(
                  F.transform(F.sort_array("said"), lambda x: x["text"]), " ")).alias("chunk")))
    said = F.when(F.col("chunk").isNotNull(), F.struct("blk", "chunk"))
    return (chunks.groupBy("conv_id")
            .agg(F.array_join(F.transform(F.sort_array(F.collect_list(said)),
                                          lambda x: x["chunk"]), " ").alias("text")))


def negative_corpus(conversations: DataFrame) -> DataFrame:
    """Negative class: per-conversation user text, blank ones dropped; the text
    itself is passed on unstripped."""
    return (user_text_flat(conversations).where(is_nonblank(F.col("text")))
            .select(F.lit("neg").alias("source"), F.col("conv_id").alias("id"),
                    "text", F.lit(0).alias("label")))


def corpus_build(documents: DataFrame, conversations: DataFrame,
                 materialize_negatives: bool = False) -> DataFrame:
    """Bag union of both labelled corpora: ``source, id, text, label``.
    ``materialize_negatives`` writes the grouped negative side once (it is a
    shuffle aggregation) for callers that read the corpus several times."""
    neg = negative_corpus(conversations)
    if materialize_negatives:
        from parley.session import cut_lineage
        neg = cut_lineage(neg, "negatives")
    return positive_corpus(documents).unionByName(neg)


def class_counts(corpus: DataFrame) -> DataFrame:
    """Rows per class, the balanced size ``n = min`` and the total ``2n``.
    The window runs over the per-class table (one row per label)."""
    per = corpus.groupBy("label").agg(F.count(F.lit(1)).alias("n_class"))
    everything = Window.partitionBy()
    n = F.min("n_class").over(everything)
    return per.select("label", "n_class", n.alias("n_per_class"),
                      (n * F.count(F.lit(1)).over(everything)).alias("n_total"))


def class_weights(train: DataFrame) -> DataFrame:
    """Balanced class weights ``N / (k * n_c)`` over the training rows."""
    per = train.groupBy("label").agg(F.count(F.lit(1)).alias("n_class"))
    everything = Window.partitionBy()
    total = F.sum("n_class").over(everything)
    k = F.count(F.lit(1)).over(everything)
    return per.select("label", "n_class",
                      (total / (k * F.col("n_class"))).alias("weight"))


def reusable_corpus(documents: DataFrame, conversations: DataFrame) -> DataFrame:
    """A corpus that is cheap to read twice, as sampling does: the grouped negative
    side (a shuffle aggregation) is written once, the documents are scanned again."""
    return corpus_build(documents, conversations, materialize_negatives=True)
