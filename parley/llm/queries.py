"""The registered queries of the operators, with production parameters."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from parley.llm.common import table


def tokenizer_file(name: str) -> str:
    """A public vocabulary file: in the folder PARLEY_TOKENIZERS names, else of the installed package."""
    folder = os.environ.get("PARLEY_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers
    return public_tokenizers.path(name)


def q_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parley.llm.token_counts import token_counts
    return token_counts(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), limit=512)


def q_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parley.llm.rans_store import stored_ids
    return stored_ids(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), end_id=0)


def q_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parley.llm.sentencepiece_bpe import encode_decode
    return encode_decode(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def q_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parley.llm.quality import quality_rules
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def q_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parley.llm.nnpu_toxicity import toxicity
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def q_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parley.llm.crf_pii import digest, personal_data
    return digest(personal_data(table(spark, sf_dir, "documents")))


def q_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parley.llm.wu_manber import contamination, digest
    return digest(contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def q_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parley.llm.hamming_dedup import near_duplicates
    return near_duplicates(table(spark, sf_dir, "documents"))


def q_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parley.llm.ngram_lm import score_documents
    return score_documents(table(spark, sf_dir, "documents"))


def q_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parley.llm.suffix_dedup import repeated_bytes
    return repeated_bytes(table(spark, sf_dir, "documents"))


def q_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parley.llm.merkle_manifest import verification
    return verification(table(spark, sf_dir, "documents"))


def q_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parley.llm.phrase_mining import collocations
    return collocations(table(spark, sf_dir, "documents"))


def q_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parley.llm.warc_bundles import warc_records
    return warc_records(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_repeated_bytes": q_repeated_bytes,
        "op2_quality": q_quality,
        "op3_token_counts": q_token_counts,
        "op4_language_model": q_language_model,
        "op5_token_store": q_token_store,
        "op6_near_duplicates": q_near_duplicates,
        "op7_sentencepiece": q_sentencepiece,
        "op8_toxicity": q_toxicity,
        "op9_personal_data": q_personal_data,
        "op10_decontaminate": q_decontaminate,
        "op11_merkle_manifest": q_manifest,
        "op12_collocations": q_collocations,
        "op13_warc_bundles": q_warc,
    }


def oracle_sql() -> dict[str, str]:
    from parley.llm import oracle
    return oracle.oracle_sql()
