import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parley.functions import fixed_values as fv
from parley.operators import classifier, infer, langs, rewrite, route
from tests.conftest import rows


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "s string").select(expr.alias("o")).first()["o"]


def brute_rewrite(text, table):
    """Leftmost-longest whole-word replacement, written the plain way."""
    terms = {t.lower(): p for t, p in table}
    out, i, n = [], 0, len(text)
    word = re.compile(r"[^\W]", re.U)
    while i < n:
        starts_word = i == 0 or not word.match(text[i - 1])
        best = None
        if starts_word:
            for t in terms:
                j = i + len(t)
                if text[i:j].lower() == t and (j == n or not word.match(text[j])):
                    if best is None or len(t) > len(best):
                        best = t
        if best:
            out.append(terms[best])
            i += len(best)
        else:
            out.append(text[i])
            i += 1
    return "".join(out)


def test_glossary_examples(spark):
    r = rewrite.rewrite(F.col("s"))
    assert one(spark, r, "Severe edema and Hypertension.") == \
        "Severe swelling caused by fluid and high blood pressure."
    assert one(spark, r, "edemas, edema edema") == "edemas, swelling caused by fluid swelling caused by fluid"
    assert one(spark, r, "acute myocardial infarction; myocardial infarction") == \
        "sudden heart attack; heart attack"
    assert one(spark, r, "edematous") == "swollen"
    assert one(spark, r, "") == ""


TABLE = [("ab", "X"), ("ab cd", "Y"), ("cd", "Z"), ("b", "W")]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from(["ab", "cd", "b", "AB", "abc", " ", ",", "é", "x"]), max_size=8))
def test_rewrite_matches_brute_force(spark, parts):
    text = "".join(parts)
    assert one(spark, rewrite.rewrite(F.col("s"), TABLE), text) == brute_rewrite(text, TABLE)


def test_joined_rewrite_equals_brute_force(spark):
    import random
    rnd = random.Random(7)
    pieces = ["ab", "cd", "b", "AB", "abc", " ", ",", "é", "x"]
    texts = ["".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 10))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    table = spark.createDataFrame(TABLE, "term string, plain string")
    got = dict(rows(rewrite.rewrite_joined(df, "text", table, "o"), "id", "o"))
    assert got == {i: brute_rewrite(t, TABLE) for i, t in enumerate(texts)}


def test_joined_rewrite_glossary_on_documents(spark):
    from parley.sources import tables
    from tests.conftest import SF_SMALL
    d = tables.documents(spark, SF_SMALL).select("doc_id", "text")
    d = d.unionByName(spark.createDataFrame(
        [(-1, "Acute myocardial infarction with edema, no hypertension."), (-2, None), (-3, "")],
        "doc_id long, text string"))
    table = spark.createDataFrame(fv.GLOSSARY, "term string, plain string")
    a = rewrite.rewrite_joined(d, "text", table, "o")
    b = d.withColumn("o", rewrite.rewrite(F.col("text")))
    assert rows(a, "doc_id", "o") == rows(b, "doc_id", "o")
    assert dict(rows(a, "doc_id", "o"))[-1] == "sudden heart attack with swelling caused by fluid, no high blood pressure."


def test_compiled_table_is_bounded():
    with pytest.raises(ValueError):
        rewrite.compile_terms([(f"t{i}", "x") for i in range(rewrite.MAX_COMPILED_TERMS + 1)])


class FailsOnMarker(infer.Backend):
    """Fails for texts containing 'BOOM'; counts no state across rows."""

    def predict(self, texts, src, tgt):
        for t in texts:
            if "BOOM" in t:
                raise ValueError("backend failed")
        return [t.upper() for t in texts]


def test_per_row_error_capture(spark):
    data = [(i, "en_XX", "xh_ZA", "ok text" if i % 3 else "BOOM here") for i in range(60)]
    df = spark.createDataFrame(data, "id long, src string, tgt string, text string")
    out = infer.run_backend(df, FailsOnMarker(), "src", "tgt", "text", "out", "err")
    got = rows(out, "id", "out", "err")
    assert len(got) == 60
    for i, o, e in got:
        if i % 3:
            assert (o, e) == ("OK TEXT", None)
        else:
            assert (o, e) == (None, "backend failed")


def test_hot_key_salting_keeps_every_row(spark):
    data = [(i, "en_XX", "xh_ZA", "same hot text" if i % 10 else f"cold {i}") for i in range(400)]
    df = spark.createDataFrame(data, "id long, src string, tgt string, text string")
    plain = infer.run_backend(df, FailsOnMarker(), "src", "tgt", "text", "out", "err",
                              materialize=False)
    salted = infer.run_backend(df, FailsOnMarker(), "src", "tgt", "text", "out", "err",
                               materialize=False, hot_rows=50)
    want = [(i, t.upper()) for i, _, _, t in data]
    assert rows(plain, "id", "out") == sorted(want)
    assert rows(salted, "id", "out") == sorted(want)


def test_remote_backend_needs_token(spark, monkeypatch):
    monkeypatch.delenv("HF_TOKEN", raising=False)
    monkeypatch.delenv("HUGGING_FACE_HUB_TOKEN", raising=False)
    df = spark.createDataFrame([(1, "en_XX", "xh_ZA", "x")], "id long, src string, tgt string, text string")
    with pytest.raises(RuntimeError, match="needs a token"):
        infer.run_backend(df, infer.resolve_translate("api"), "src", "tgt", "text", "o", "e")


def test_backend_fall_through(spark):
    df = spark.createDataFrame([("api",), ("local",), ("other",), (None,)], "m string")
    got = [(r[0], r[1]) for r in df.select(infer.simplify_backend_name(F.col("m")),
                                           infer.translate_backend_name(F.col("m"))).collect()]
    assert got == [("api", "api"), ("local", "local"), ("api", "local"), ("api", "local")]


def test_language_table_and_unknown(spark):
    t = langs.lang_table(spark)
    assert [r["lang_code"] for r in t.collect()] == [c for _, c, _ in fv.LOW_RESOURCE_LANGS] + ["en_XX"]
    df = spark.createDataFrame([("Xhosa",), ("Klingon",)], "lang_name string")
    with pytest.raises(KeyError, match="Klingon"):
        langs.require_known(df)


def _conv(spark, data):
    return spark.createDataFrame(data, "conv_id long, turn long, role string, text string")


def test_process_turns_directions(spark):
    conv = _conv(spark, [
        (1, 0, "assistant", "She was diagnosed with stage 3 hypertension."),
        (1, 1, "user", "Habari, nina maumivu ya kichwa."),
        (1, 2, "assistant", "What are you doing this weekend?"),
        (1, 3, "user", " \t"),
    ])
    out = route.process_turns(route.turn_requests(conv), classifier.demo_model(spark))
    got = {r["turn"]: r for r in out.collect()}
    assert set(got) == {0, 1, 2}                          # blank turn skipped
    d0, p1, d2 = got[0], got[1], got[2]
    assert (d0["src_lang"], d0["tgt_lang"]) == ("en_XX", "xh_ZA")      # conv 1 -> Xhosa
    assert d0["medical"] is True and d0["simplified"] == "She was diagnosed with stage 3 high blood pressure."
    assert d0["translation"] == "She was diagnosed with stage 3 high uxinzelelo lwegazi."
    assert p1["medical"] is None and p1["simplified"] is None and p1["confidence"] is None
    assert (p1["src_lang"], p1["tgt_lang"], p1["translation"]) == ("xh_ZA", "en_XX",
                                                                 "Habari, nina maumivu ya kichwa.")
    assert d2["medical"] is False and d2["simplified"] is None
    assert d2["translation"] == "What are you doing le weekend?"


def test_english_to_english_is_still_classified(spark):
    df = spark.createDataFrame([(1, 0, "Administer 500mg of paracetamol twice daily.", "en_XX", "en_XX")],
                               "conv_id long, turn long, text string, src_lang string, tgt_lang string")
    out = route.classify_gated(df, classifier.demo_model(spark)).first()
    assert out["medical"] is True


class EmptyRewriter(infer.Backend):
    """A rewrite model that answers with whitespace only."""

    def predict(self, texts, src, tgt):
        return ["  \n" for _ in texts]


def test_empty_rewrite_is_translated_and_not_shown(spark):
    from parley.operators import transcript
    conv = _conv(spark, [(1, 0, "assistant", "She was diagnosed with hypertension."),
                         (1, 1, "assistant", "What are you doing this weekend?")])
    out = route.process_turns(route.turn_requests(conv), classifier.demo_model(spark),
                              simplify_mode=EmptyRewriter())
    got = {r["turn"]: r for r in out.collect()}
    assert got[0]["medical"] is True and got[0]["simplified"] == ""       # output trimmed to ""
    assert got[0]["translation"] == ""                              # the empty text is translated
    assert got[1]["simplified"] is None and got[1]["translation"].endswith("weekend?")
    tr = {r["turn_no"]: r for r in transcript.transcript(out, transcript.chat_events(conv)).collect()}
    assert tr[1]["simplified"] is None and tr[1]["tag"].startswith("médico")   # not displayed


class OnlyGated(infer.Backend):
    """Refuses any text that the gate should have kept away."""

    def predict(self, texts, src, tgt):
        for t in texts:
            if "patient-side" in t or "weekend" in t:
                raise ValueError("ungated text reached the rewrite backend")
        return [t.lower() for t in texts]


def test_only_gated_domain_rows_reach_the_rewrite_backend(spark):
    conv = _conv(spark, [(2, 0, "assistant", "Administer 500mg of paracetamol twice daily."),
                         (2, 1, "user", "patient-side text about pain"),
                         (2, 2, "assistant", "What are you doing this weekend?")])
    out = route.process_turns(route.turn_requests(conv), classifier.demo_model(spark),
                              simplify_mode=OnlyGated())
    got = {r["turn"]: r for r in out.collect()}
    assert all(r["error"] is None for r in got.values())
    assert got[0]["simplified"] == "administer 500mg of paracetamol twice daily."
    assert got[1]["simplified"] is None and got[2]["simplified"] is None


def test_joined_rewrite_scores_each_row_by_itself(spark):
    data = [(None, "edema and hypertension"), (2, "edema"), (2, "hypertension"), (None, "nothing"), (2, None), (2, "edema")]
    df = spark.createDataFrame(data, "id long, text string").repartition(3)
    table = spark.createDataFrame(fv.GLOSSARY, "term string, plain string")
    got = rewrite.rewrite_joined(df, "text", table, "o").collect()
    want = df.select("id", "text", rewrite.rewrite(F.col("text")).alias("o")).collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(got) == len(data)


@pytest.mark.parametrize("bit_terms", [20_000, 3])
def test_candidates_are_tested_before_they_become_rows(spark, monkeypatch, bit_terms):
    monkeypatch.setattr(rewrite, "MAX_BIT_TERMS", bit_terms)
    df = spark.createDataFrame([(k, f"word{k} edema and hypertension x{k % 7} y") for k in range(200)], "id long, text string")
    terms = [(f"x{k} y", f"plain{k}") for k in range(7)] + [("edema", "swelling"), (f"word{3}", "three")]
    table = spark.createDataFrame(terms, "term string, plain string")
    got = rewrite.rewrite_joined(df, "text", table, "o").collect()
    want = df.select("id", "text", rewrite.rewrite(F.col("text"), terms).alias("o")).collect()
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_joined_rewrite_takes_along_only_what_a_phrase_may_have(spark):
    """Per word and match, the arrays of the whole text were copied."""
    text = " ".join(("edema", "of the", "skin,", "no\nhypertension")[k % 4] for k in range(20_000))
    df = spark.createDataFrame([(1, text), (2, "no match"), (3, None), (4, ""), (5, ", edema."), (6, "ΟΔΟΣ'Α, ΟΔΟΣ")], "id long, text string")
    terms = [("edema", "swelling"), ("of the", "der"), ("hypertension", "high pressure"), ("οδοσ'α", "road a"), ("οδος", "road")]
    got = dict(rows(rewrite.rewrite_joined(df, "text", spark.createDataFrame(terms, "term string, plain string"), "o"), "id", "o"))
    assert got[1] == text.replace("edema", "swelling").replace("of the", "der").replace("hypertension", "high pressure")
    assert [got[k] for k in (2, 3, 4, 5, 6)] == ["no match", None, "", ", swelling.", "road a, road"]
    long = df.where("id = 1").select(F.col("id").alias("_row"), "text")
    found = rewrite._candidates(long, "text", (), 2, lambda w: w == "of")
    assert {(r["e"] - r["i"], r["term"]) for r in found.collect()} == {(0, "of"), (2, "of the")} and found.count() == 10_000
