"""Rows the test tables lack: null and unsupported languages, long texts, marks, folder streams."""

import pytest
from pyspark.sql import functions as F

from parley.functions import fixed_values as fv
from parley.operators import audit, classifier, infer, rewrite, route, transcript
from parley.streaming import turns
from tests.conftest import SF_SMALL


def test_every_request_has_an_output_or_an_error(spark):
    long = "word " * 3000
    reqs = [(1, 0, "en_XX", "ne_NP", "the patient has edema"), (2, 0, None, "ne_NP", "hello"), (3, 0, "en_XX", "tlh_XX", "hello"),
            (4, 0, "es_XX", "en_XX", long), (5, 0, "es_XX", None, "hola")]
    df = spark.createDataFrame(reqs, "conv_id long, turn long, src_lang string, tgt_lang string, text string")
    got = {r["conv_id"]: r for r in route.process_turns(df, classifier.demo_model(spark)).collect()}
    assert got.keys() == {1, 2, 3, 4, 5}
    assert got[4]["translation"] == long and got[1]["translation"]
    assert got[2]["error"] == "unsupported language null" and got[2]["translation"] is None
    assert got[3]["error"] == "unsupported language tlh_XX" and got[5]["error"] == "unsupported language null"


def test_script_share_counts_letters_only(spark):
    words = {"Devanagari": "हिन्दी", "Myanmar": "မြန်မာ", "Sinhala": "සිංහල", "Arabic": "مُحَمَّد", "Cyrillic": "Привет", "Latin": "café"}
    df = spark.createDataFrame(list(words.items()), "script string, out string")
    for r in audit.script_share(df, "out", "script").collect():
        assert r["script_share"] == 1.0, r


def test_stream_reads_a_folder_of_part_files(spark, tmp_path):
    rows = spark.read.parquet(f"{SF_SMALL}/conversations.parquet")
    rows.repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    stream = turns.read_stream(spark, str(tmp_path), max_files=5)
    got = turns.run_to_table(stream.select("conv_id", "turn"), spark, "folder")
    assert got.count() == rows.count() > 0


def test_rows_go_to_the_backend_their_mode_names(spark, monkeypatch):
    rows = [(1, 0, "en_XX", "ne_NP", "the patient has edema", "local", "local"),
            (2, 0, "es_XX", "en_XX", "hola", "local", "api"), (3, 0, "es_XX", "en_XX", "hola", "local", "other")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, src_lang string, tgt_lang string, text string, "
                                     "simplify_mode string, translate_mode string")
    model = classifier.demo_model(spark)
    monkeypatch.delenv("HF_TOKEN", raising=False)
    monkeypatch.delenv("HUGGING_FACE_HUB_TOKEN", raising=False)
    with pytest.raises(RuntimeError, match="HF_TOKEN"):
        route.process_turns(df, model)
    monkeypatch.setenv("HF_TOKEN", "x")
    got = {r["conv_id"]: r for r in route.process_turns(df, model).collect()}
    assert got[1]["translation"] and got[3]["translation"] == "hola"
    assert got[2]["translation"] is None and "no client" in got[2]["error"]


def test_credentials_are_checked_before_a_plug_in_rewriter_runs(spark, monkeypatch):
    monkeypatch.delenv("HF_TOKEN", raising=False)
    monkeypatch.delenv("HUGGING_FACE_HUB_TOKEN", raising=False)
    df = spark.createDataFrame([(1, 0, "en_XX", "ne_NP", "edema")], "conv_id long, turn long, src_lang string, tgt_lang string, text string")
    monkeypatch.setattr(infer, "run_backend", lambda *a, **k: pytest.fail("ran before the check"))
    with pytest.raises(RuntimeError, match="HF_TOKEN"):
        route.process_turns(df, classifier.demo_model(spark), infer.Backend(), "api")


def test_a_changed_unit_after_a_blank_is_found(spark):
    rows = [("take 500 mg", "take 500 ml", False), ("take 500 mg", "take 500mg", True), ("5 great days", "5 big days", True),
            ("2.5 ml, 10 %", "10% and 2.5 ml", True), ("500 µg", "500 mg", False), ("room 7", "room 8", False)]
    df = spark.createDataFrame(rows, "a string, b string, kept boolean")
    for r in audit.number_check(df, "a", "b").collect():
        assert r["numbers_kept"] == r["kept"], r


def test_both_rewrites_read_a_term_table_alike(spark):
    table = [("X-ray", "picture of the bones"), ("edema", "water"), ("edema", "swelling"), ("  Acute   pain ", "sudden pain"),
             ("c++", "code"), ("", "nothing"), (None, "null"), ("null", None), ("vitamin b-12 level", "b-12"), ("pain", "ache")]
    texts = ["An X-ray, an x-RAY and axx-ray", "edema; acute pain, acute  pain", "c++ and c", "", "Vitamin B-12 level: pain", "null", None]
    terms = spark.createDataFrame(table, "term string, plain string")
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    one = {r["id"]: r["o"] for r in df.select("id", rewrite.rewrite(F.col("text"), table).alias("o")).collect()}
    two = {r["id"]: r["o"] for r in rewrite.rewrite_joined(df, "text", terms, "o").collect()}
    assert one == two
    assert one[0] == "An picture of the bones, an picture of the bones and axx-ray"
    assert one[1] == "swelling; sudden pain, acute  ache" and one[2] == texts[2] and one[4] == "b-12: ache" and one[6] is None


def test_views_show_the_current_epoch_alone(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "system", "clear"), (1, 2, "user", "b"), (1, 3, "user", " "), (1, 4, "assistant", "c"),
            (2, 0, "user", "d"), (2, 1, "system", "clear"), (3, 0, "user", "e")]
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    events = transcript.chat_events(conv)
    done = route.process_turns(route.turn_requests(conv), classifier.demo_model(spark))
    tr = transcript.transcript(done, events)
    own = F.when(F.col("role") == "user", F.col("xx")).otherwise(F.col("en"))
    got = sorted((r["conv_id"], r["epoch"], r["turn_no"], r["own"]) for r in tr.select("*", own.alias("own")).collect())
    assert got == [(1, 1, 1, "b"), (1, 1, 2, "c"), (3, 0, 1, "e")]
    assert transcript.panel_history(tr).count() == 6


def test_null_conversations_and_turns_are_numbered(spark):
    rows = [(None, 1, "user", "a"), (None, 2, "system", "s"), (None, 5000, "user", "b"), (None, 5001, "user", "c"),
            (7, 1, "user", "a"), (7, 9000, "user", "b"), (7, None, "user", "c")]
    events = transcript.chat_events(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    numbered = transcript.number_turns(events)
    got = {tuple(r) for r in numbered.collect()}
    assert got == {(None, 1, 0, 1), (None, 5000, 1, 1), (None, 5001, 1, 2), (7, 1, 0, 1), (7, 9000, 0, 2), (7, None, 0, 3)}
    assert {tuple(r) for r in transcript.current_epoch(numbered, events).collect()} == got - {(None, 1, 0, 1)}
