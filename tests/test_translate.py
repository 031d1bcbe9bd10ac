"""Phrase-table translation: both forms against a brute-force reading, and its errors."""

import random
import unicodedata

import pytest

from parley.functions import fixed_values as fv
from parley.operators import langs, rewrite, route, translate
from tests.conftest import rows

TABLE = [("en_XX", "xh_ZA", "pain", "intlungu"), ("en_XX", "xh_ZA", "chest pain", "iintlungu zesifuba"),
         ("en_XX", "xh_ZA", "pain in the chest", "isifuba"), ("en_XX", "xh_ZA", "the", "i"), ("en_XX", "xh_ZA", "the chest", "isifuba 2"),
         ("ne_NP", "en_XX", "र", "and"), ("ne_NP", "en_XX", "औषधि", "medicine"), ("en_XX", "xh_ZA", None, "x"),
         ("es_XX", "en_XX", "la", "the"), ("en_XX", "xh_ZA", "the", "ii")]


def brute(text, src, tgt):
    """Leftmost-longest whole words, one position at a time."""
    def word(c):
        return c == "_" or unicodedata.category(c)[0] in "LMN"
    terms = {}
    for s, t, p, v in TABLE:
        if (s, t) == (src, tgt) and p:
            terms[p] = min(v, terms.get(p, v))
    out, i = "", 0
    while i < len(text):
        hits = [p for p in terms if text[i:i + len(p)].lower() == p and (i == 0 or not word(text[i - 1]))
                and (i + len(p) == len(text) or not word(text[i + len(p)]))]
        if hits:
            best = max(hits, key=len)
            out, i = out + terms[best], i + len(best)
        else:
            out, i = out + text[i], i + 1
    return out


def test_both_forms_equal_brute_force(spark):
    rnd = random.Random(5)
    pieces = ["pain", "chest", "in", "the", "la", "Pain", " ", " ", " ", ",", "र", "राम", "औषधि", "-"]
    pairs = [("en_XX", "xh_ZA"), ("ne_NP", "en_XX"), ("es_XX", "en_XX"), ("en_XX", "en_XX")]
    data = [(i, *rnd.choice(pairs), "".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 40)))) for i in range(300)]
    df = spark.createDataFrame(data, "id long, s string, t string, x string")
    table = spark.createDataFrame(TABLE, "src string, tgt string, phrase string, translation string")
    want = sorted((i, brute(x, s, t), None) for i, s, t, x in data)
    assert rows(translate.translated(df, "s", "t", "x", "o", "e", TABLE), "id", "o", "e") == want
    assert rows(translate.translate_joined(df, "s", "t", "x", "o", "e", table), "id", "o", "e") == want


def test_errors_nulls_and_long_texts(spark):
    long = "pain " * 30_000
    data = [(1, "en_XX", "xh_ZA", long), (2, None, "xh_ZA", "pain"), (3, "en_XX", "tlh_XX", "pain"), (4, "en_XX", None, "pain"),
            (5, "en_XX", "xh_ZA", None), (6, None, None, None), (7, "en_XX", "xh_ZA", "")]
    df = spark.createDataFrame(data, "id long, s string, t string, x string")
    table = translate.phrase_table(spark)
    one = {r["id"]: (r["o"], r["e"]) for r in translate.translated(df, "s", "t", "x", "o", "e").collect()}
    two = {r["id"]: (r["o"], r["e"]) for r in translate.translate_joined(df, "s", "t", "x", "o", "e", table).collect()}
    assert one == two
    assert one[1] == ("intlungu " * 30_000, None) and one[5] == (None, None) == one[6] and one[7] == ("", None)
    assert one[2] == (None, "unsupported language null") == one[4] and one[3] == (None, "unsupported language tlh_XX")


def test_empty_phrase_table_leaves_texts_as_they_are(spark):
    df = spark.createDataFrame([(1, "en_XX", "xh_ZA", "pain")], "id long, s string, t string, x string")
    empty = translate.phrase_table(spark).limit(0)
    assert rows(translate.translate_joined(df, "s", "t", "x", "o", "e", empty), "o") == [("pain",)]
    assert rows(translate.translated(df, "s", "t", "x", "o", "e", []), "o") == [("pain",)]


def test_translation_is_a_map(spark):
    df = spark.createDataFrame([(1, "en_XX", "xh_ZA", "pain")], "id long, s string, t string, x string")
    plan = translate.translated(df, "s", "t", "x", "o", "e")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_unknown_language_name_fails_the_job(spark):
    df = spark.createDataFrame([("Xhosa",), ("Klingon",)], "lang_name string")
    with pytest.raises(Exception, match="unknown language name: Klingon"):
        langs.lookup_codes(df, strict=True).collect()


def test_phrase_rows_are_whole_words_of_known_languages():
    table = fv.phrase_rows()
    assert {c for r in table for c in r[:2]} == set(fv.MODEL_CODES)
    assert all(rewrite.compile_terms([(p, v)])[0] and p and v for _, _, p, v in table) and route
