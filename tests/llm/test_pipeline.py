"""The pipeline's stages against brute force on the smallest tables."""

import duckdb

import corpus_pipeline
from parley.llm import crf_pii, quality
from parley.llm.common import table
from parley.llm.queries import tokenizer_file
from tests.conftest import SF_SMALL
from tests.llm import rows as R


def test_pipeline_equals_brute_force(spark):
    import sentencepiece
    rows = duckdb.sql(f"select doc_id, text from '{SF_SMALL}/documents.parquet'").fetchall()
    items = duckdb.sql(f"select item_id, text from '{SF_SMALL}/benchmark.parquet'").fetchall()
    counts = {i: R.quality(t) for i, t in rows}
    docs = {i: t for i, t in rows if counts[i][0] >= 50 and 100 * counts[i][4] <= 50 * counts[i][0]}
    found = quality.quality_rules(table(spark, SF_SMALL, "documents"), table(spark, SF_SMALL, "labels"))
    docs = {i: docs[i] for i in docs if i in {r["doc_id"] for r in found.where("kept").collect()}}
    least = R.groups(list(docs.items()), corpus_pipeline.NEAR_PERCENT)
    docs = {i: t for i, t in docs.items() if least[i] == i}
    hit = R.contaminated(list(docs.values()), items)
    docs = {i: t for (i, t), (_, n, _) in zip(docs.items(), hit) if not n}
    lib = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF_SMALL).collect()}
    assert got.keys() == docs.keys()
    for i, t in docs.items():
        if not any("0" <= c <= "9" or c == "@" for c in t):      # else masked: see test_personal_data
            assert got[i]["ids"] == lib.encode(t) and got[i]["decoded"] == lib.decode(got[i]["ids"])
        else:
            assert not crf_pii.base_spans(got[i]["decoded"])


def test_stages_keep_the_columns(spark):
    docs = spark.createDataFrame(R.documents(), R.SCHEMA)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF_SMALL)
        assert out.columns == docs.columns, name
        assert stage(spark, docs.limit(0), SF_SMALL).count() == 0, name


def test_near_copies_from_80_percent_go(spark):
    base = [f"w{k}" for k in range(300)]
    docs = [(0, " ".join(base), "en", 0, "p", 0)]
    for wrong in range(4, 9):                             # similarity 0.87, 0.84, 0.82, 0.79, 0.76
        words = list(base)
        for k in range(wrong):
            words[20 + 30 * k] = f"x{wrong}.{k}"
        docs.append((wrong, " ".join(words), "en", 0, "p", 0))
    for wrong, *row in docs[1:]:
        got = corpus_pipeline.near_duplicate_stage(spark, spark.createDataFrame([docs[0], (wrong, *row)], R.SCHEMA), SF_SMALL)
        assert {r["doc_id"] for r in got.collect()} == ({0} if wrong < 7 else {0, wrong})


def test_near_duplicate_stage_equals_brute_force_at_80_percent(spark):
    rows = duckdb.sql(f"select doc_id, text from '{SF_SMALL}/documents.parquet'").fetchall()
    got = corpus_pipeline.near_duplicate_stage(spark, table(spark, SF_SMALL, "documents"), SF_SMALL)
    assert {r["doc_id"] for r in got.collect()} == set(R.groups(rows, 80).values())
