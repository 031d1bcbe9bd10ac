import math
import random

import pytest
from pyspark.sql import functions as F

from parley.operators import classifier, evaluate, features
from tests.conftest import rows

# Fixed documented cases: short sentences with the label that the model must give.
DEMO = [
    ("Doctor, I have been experiencing chest pain and difficulty breathing.", True),
    ("She was diagnosed with stage 3 hypertension.", True),
    ("Administer 500mg of paracetamol twice daily.", True),
    ("What are you doing this weekend?", False),
    ("I really enjoyed the movie last night.", False),
]


def test_demo_sentences(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(DEMO)], "id long, text string")
    got = rows(classifier.classify(df, classifier.demo_model(spark)), "id", "medical", "confidence")
    assert [m for _, m, _ in got] == [e for _, e in DEMO]
    assert all(0.5 <= c <= 1.0 for _, _, c in got)


def test_unknown_terms_give_intercept(spark):
    m = classifier.demo_model(spark)
    df = spark.createDataFrame([(1, "zzz qqq"), (2, "")], "id long, text string")
    got = rows(classifier.score(df, m), "id", "margin")
    assert got == [(1, m.intercept), (2, m.intercept)]
    assert rows(classifier.margins(df, ["id"], m), "id", "margin") == got
    assert rows(classifier.margins_joined(df, ["id"], m), "id", "margin") == got


def test_margin_formula_by_hand(spark):
    w = spark.createDataFrame([("pain", 2.0, 1.5), ("movie", 3.0, -1.0)], "term string, idf double, coef double")
    m = classifier.LinearTextModel(w, 0.1, 2)
    df = spark.createDataFrame([(1, "pain pain movie other")], "id long, text string")
    x_pain, x_movie = 2 * 2.0, 1 * 3.0
    want = (x_pain * 1.5 + x_movie * -1.0) / math.sqrt(x_pain ** 2 + x_movie ** 2) + 0.1
    assert math.isclose(classifier.score(df, m).first()["margin"], want)


def _separable(spark, n=40):
    med = ["patient dose fever infection", "blood pressure medication tablet", "surgery pain hospital nurse"]
    day = ["movie weekend party friends", "music dinner holiday shopping", "walk weather nice park"]
    data = [("pos", i, med[i % 3] + f" w{i}", 1) for i in range(n)]
    data += [("neg", i, day[i % 3] + f" v{i}", 0) for i in range(n)]
    return spark.createDataFrame(data, "source string, id long, text string, label int")


def test_train_sql_and_model_paths_agree(spark, tmp_path):
    train = _separable(spark)
    pm, table = classifier.train_svm(train, max_iter=200)
    preds = classifier.predict(pm, train)
    m = evaluate.eval_metrics(preds).first()
    assert m["accuracy"] == 1.0 and m["macro_f1"] == 1.0
    sql = classifier.margins_joined(train, ["source", "id"], table).select("source", "id", F.col("margin").alias("m1"))
    both = sql.join(preds.select("source", "id", F.col("margin").alias("m2")), ["source", "id"])
    diff = both.select(F.max(F.abs(F.col("m1") - F.col("m2")))).first()[0]
    assert diff < 1e-9
    # save / load round trip
    path = str(tmp_path / "model")
    classifier.save_model(pm, table, path)
    pm2, table2 = classifier.load_model(spark, path)
    assert table2.intercept == table.intercept
    again = classifier.predict(pm2, train).select("source", "id", F.col("margin").alias("m3"))
    assert both.join(again, ["source", "id"]).select(
        F.max(F.abs(F.col("m2") - F.col("m3")))).first()[0] == 0.0


def test_held_out_accuracy(spark):
    """Rows unseen in training, of the same two vocabularies."""
    rnd = random.Random(9)
    med = "patient dose fever infection blood pressure medication tablet surgery pain hospital nurse".split()
    day = "movie weekend party friends music dinner holiday shopping walk weather nice park".split()
    data = [(i, " ".join(rnd.choices(med if i % 2 else day, k=6) + [f"w{i}"]), i % 2) for i in range(300)]
    df = spark.createDataFrame(data, "id long, text string, label int")
    pm, _ = classifier.train_svm(df.where("id < 200"), max_iter=200)
    m = evaluate.eval_metrics(classifier.predict(pm, df.where("id >= 200"))).first()
    assert m["n"] == 100 and m["accuracy"] >= 0.95


def test_missing_model_message(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="train one with"):
        classifier.load_model(spark, str(tmp_path / "nothing"))


def test_vocabulary_top_k_ties_by_term(spark):
    c = spark.createDataFrame([(1, "bb aa cc aa"), (2, "cc dd")], "id long, text string")
    st = features.term_stats(c)
    assert rows(st.where(F.length("term") == 2)) == [("aa", 2, 1), ("bb", 1, 1), ("cc", 2, 2), ("dd", 1, 1)]
    top = [r["term"] for r in features.vocab_topk(st, 3).collect()]
    assert top == ["aa", "cc", "aa cc"]
    idf = dict(rows(features.idf_table(features.vocab_topk(st, 10), 2), "term", "idf"))
    assert math.isclose(idf["cc"], math.log(3 / 3) + 1) and math.isclose(idf["aa"], math.log(3 / 2) + 1)


def test_tfidf_rows_are_unit_length(spark):
    c = spark.createDataFrame([(1, "aa bb aa"), (2, "bb cc")], "id long, text string")
    vocab = features.idf_table(features.vocab_topk(features.term_stats(c)), 2)
    t = features.tfidf(c, ["id"], "text", vocab.select("term", "idf"))
    norms = rows(t.groupBy("id").agg(F.sum(F.col("weight") ** 2).alias("n")))
    assert all(math.isclose(n, 1.0) for _, n in norms)


def test_metrics_and_confusion(spark):
    p = spark.createDataFrame([("s", 1, "t", 1, 1), ("s", 2, "t", 1, 0), ("s", 3, "t", 0, 0), ("s", 4, "t", 0, 0)],
                              "source string, id long, text string, label int, prediction int")
    m = evaluate.eval_metrics(p).first()
    assert m["accuracy"] == 0.75
    assert math.isclose(m["macro_precision"], (1.0 + 2 / 3) / 2)
    assert math.isclose(m["macro_recall"], (0.5 + 1.0) / 2)
    assert rows(evaluate.confusion(p)) == [(0, 2, 0), (1, 1, 1)]
    assert rows(evaluate.misclassified(p), "id", "kind") == [(2, "false_negative")]


def test_no_positive_prediction_counts_zero(spark):
    p = spark.createDataFrame([("s", 1, "t", 1, 0), ("s", 2, "t", 0, 0)],
                              "source string, id long, text string, label int, prediction int")
    m = evaluate.eval_metrics(p).first()
    assert m["macro_precision"] == 0.25      # (0.5 + 0) / 2
    assert rows(evaluate.confusion(p)) == [(0, 1, 0), (1, 1, 0)]
