import html
import math
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parley.functions import fixed_values as fv
from parley.functions import text as tx


def one(spark, expr, value, schema="s string"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("o")).first()["o"]


def py_tokens(s):
    # the classic TF-IDF token rule, in Python
    return re.findall(r"(?u)\b\w\w+\b", s.lower())


def test_tokens_match_python_rule(spark):
    texts = ["Doctor, I have been experiencing chest pain and difficulty breathing.",
             "Administer 500mg of paracetamol twice daily.", "a b c", "", "Ünïcode wörds_ok 3 x9"]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    got = [r["t"] for r in df.select(tx.tokens(F.col("s")).alias("t")).collect()]
    assert got == [py_tokens(t) for t in texts]


def test_bigrams_follow_unigrams(spark):
    got = one(spark, tx.terms(F.col("s")), "She was diagnosed with stage 3 hypertension.")
    u = ["she", "was", "diagnosed", "with", "stage", "hypertension"]
    assert got == u + [f"{a} {b}" for a, b in zip(u, u[1:])]
    assert one(spark, tx.terms(F.col("s")), "single") == ["single"]      # no bigram
    assert one(spark, tx.terms(F.col("s")), "a") == []                    # 1-letter words are not tokens


def test_nonempty_keeps_blank(spark):
    df = spark.createDataFrame([(None,), ("",), ("   ",), ("x",)], "s string")
    got = [r["s"] for r in df.where(tx.is_nonempty(F.col("s"))).collect()]
    assert sorted(got) == ["   ", "x"]


WS = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.sampled_from(list(WS) + ["a", "é", "​", "\x00"]), max_size=6))
def test_nonblank_and_strip_equal_python(spark, s):
    df = spark.createDataFrame([(s,)], "s string")
    r = df.select(tx.is_nonblank(F.col("s")).alias("nb"), tx.py_strip(F.col("s")).alias("st")).first()
    assert r["nb"] == bool(s.strip())
    assert r["st"] == s.strip()


def test_html_escape_matches_stdlib(spark):
    s = "a & b < c > d \"q\" 'x' &amp;"
    assert one(spark, tx.html_escape(F.col("s")), s) == html.escape(s)


def test_confidence_edges(spark):
    df = spark.createDataFrame([(0.0,), (1000.0,), (-1000.0,), (2.0,), (-2.0,)], "m double")
    got = [r["c"] for r in df.select(tx.confidence(F.col("m")).alias("c")).collect()]
    assert got[0] == 0.5 and got[1] == 1.0 and got[2] == 1.0
    assert math.isclose(got[3], 1 / (1 + math.exp(-2)))
    assert math.isclose(got[4], 1 - 1 / (1 + math.exp(2)))
    pos = [r["p"] for r in df.select(tx.is_positive(F.col("m")).alias("p")).collect()]
    assert pos == [False, True, False, True, False]


def test_tag_format(spark):
    df = spark.createDataFrame([(True, 0.994), (False, 0.97), (None, 0.8), (True, None), (True, 0.125)],
                               "m boolean, c double")
    got = [r["t"] for r in df.select(tx.tag(F.col("m"), F.col("c")).alias("t")).collect()]
    assert got == ["médico · 99% conf.", "no médico · 97% conf.", None, "médico",
                   f"médico · {12.5:.0f}% conf."]


def test_chat_messages(spark):
    m = one(spark, tx.chat_messages(F.col("s")), "hello")
    assert [(x["role"], x["content"]) for x in m] == [("system", fv.SYSTEM_PROMPT), ("user", "hello")]


def test_word_count_is_str_split(spark):
    for s in ["a  b\tc\n", " ", "x　y\x1cz"]:
        assert one(spark, tx.word_count(F.col("s")), s) == len(s.split())
