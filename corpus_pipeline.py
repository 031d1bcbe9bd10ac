"""Corpus pipeline: quality rules, near duplicates, decontamination, personal data, SentencePiece.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame. Each stage's result is written as Parquet and read again as
the next one's docs, so a lost executor repeats one stage's tasks at most. All but
the last stage return all columns of ``documents``, whatever they are.

1. ``quality``: documents the quality rules reject go.
2. ``near_duplicates``: one document of each group stays, the least doc_id. Texts
   are near at a Jaccard similarity of 0.8 of their five-word shingles.
3. ``decontaminate``: documents with a benchmark window go.
4. ``personal_data``: spans of personal data are masked in the text.
5. ``sentencepiece``: ids and decoded text of every document left.

Rows with a null text count as empty, which the quality rules reject.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from parley.llm import crf_pii, hamming_dedup, quality, sentencepiece_bpe, wu_manber
from parley.llm.common import table
from parley.llm.queries import tokenizer_file
from parley.session import checkpoint_dir

#: The general rule for near copies; op6's own contract says 85.
NEAR_PERCENT = 80


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.kept_rows(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return hamming_dedup.first_of_groups(docs, NEAR_PERCENT)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return wu_manber.clean_rows(docs, table(spark, sf_dir, "benchmark"))


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return crf_pii.masked(docs)


def sentencepiece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, decoded."""
    out = sentencepiece_bpe.encode_decode(docs, tokenizer_file("piece_bpe_32k.model"), with_ids=True)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontaminate", decontamination_stage),
    ("personal_data", personal_data_stage),
    ("sentencepiece", sentencepiece_stage),
]

#: SQL can't express the stages; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    base = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        path = f"{base}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
