"""The distributed squared-hinge solver against a dense Newton method in numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.operators import classifier, features, svm
from parley.operators.corpus import class_weights
from tests.conftest import rows


def dense(x, y, c):
    """Minimum of the penalised squared hinge, by full Newton steps with halving."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])

    def value(w):
        gap = np.maximum(0, 1 - y * (x @ w))
        return w @ w / 2 + (c * gap * gap).sum()
    for _ in range(200):
        gap = np.maximum(0, 1 - y * (x @ w))
        gradient = w - x.T @ (2 * c * gap * y)
        if np.linalg.norm(gradient) < 1e-12:
            break
        on = x[gap > 0]
        step = np.linalg.solve(np.eye(len(w)) + on.T @ (2 * c[gap > 0, None] * on), -gradient)
        t = 1.0
        while value(w + t * step) > value(w) and t > 1e-12:
            t /= 2
        w = w + t * step
    return w


def corpus(spark, n, seed):
    rng = np.random.default_rng(seed)
    words = np.array("patient dose fever walk movie party blood music pain weekend the and of".split())
    data = []
    for k in range(n):
        label = int(rng.random() < 0.3)
        share = np.where(np.arange(len(words)) % 2 == label, 2.0, 1.0)
        data.append(("s", k if k % 7 else None, " ".join(rng.choice(words, rng.integers(0, 9), p=share / share.sum())), label))
    data += [("s", 1, None, 1), ("s", 1, "", 0), ("s", 2, "zzz", 1), ("s", 3, data[3][2], 0), ("s", 3, "patient", None)]
    return spark.createDataFrame(data, "source string, id long, text string, label int").repartition(3)


def matrix(train, vocab, idf):
    out = []
    for text, label in [(r["text"] or "", r["label"]) for r in train.collect() if r["label"] is not None]:
        tok = text.split()
        seen = tok + [f"{a} {b}" for a, b in zip(tok, tok[1:])]
        x = np.array([seen.count(t) * i for t, i in zip(vocab, idf)])
        out.append((x / (np.linalg.norm(x) or 1.0), 2.0 * label - 1, label))
    return np.array([r[0] for r in out]), np.array([r[1] for r in out]), [r[2] for r in out]


@pytest.mark.parametrize("n,seed", [(60, 1), (400, 2)])
def test_solver_equals_dense_newton(spark, n, seed):
    train = corpus(spark, n, seed).where("label is not null")
    vocab, idf = features.fit_vocabulary(train, 40, n_docs=train.count())
    weight = {r["label"]: r["weight"] for r in class_weights(train).collect()}
    x, y, labels = matrix(train, vocab, idf)
    want = dense(x, y, np.array([weight[k] for k in labels]))
    table = svm.blocks(train.join(F.broadcast(class_weights(train).select("label", "weight")), "label"), vocab, idf)
    coefs, intercept, passes = svm.fit(table, len(vocab), tol=1e-10)
    assert np.abs(np.append(coefs, intercept) - want).max() < 1e-6
    assert passes < 140
    loose, _, fewer = svm.fit(table, len(vocab), tol=1e-4)
    assert fewer < 60 and np.abs(loose - want[:-1]).max() < 1e-2


def test_blocks_may_be_many(spark):
    train = corpus(spark, 300, 3).where("label is not null")
    vocab, idf = features.fit_vocabulary(train, 30, n_docs=train.count())
    one = svm.blocks(train.withColumn("weight", F.lit(1.0)).coalesce(1), vocab, idf)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        many = svm.blocks(train.withColumn("weight", F.lit(1.0)), vocab, idf)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1024")
    assert many.count() > 15 > one.count()
    a, b = svm.fit(one, len(vocab), tol=1e-9), svm.fit(many, len(vocab), tol=1e-9)
    assert np.abs(a[0] - b[0]).max() < 1e-7 and abs(a[1] - b[1]) < 1e-7


def test_degenerate_training_sets(spark):
    schema = "source string, id long, text string, label int, weight double"
    for data in ([], [("s", 1, "", 1, 1.0)], [("s", 1, None, 0, 1.0), ("s", 2, "", None, 1.0)], [("s", 1, "pain", 1, None)]):
        table = svm.blocks(spark.createDataFrame(data, schema), ["pain"], [1.0])
        coefs, intercept, _ = svm.fit(table, 1, tol=1e-10)
        assert coefs.tolist() == [0.0]
        # one row without terms: |b|^2 / 2 + (1 - y b)^2 is least at y 2/3
        known = [r for r in data if r[3] is not None and r[4] is not None]
        assert intercept == pytest.approx((2 / 3 if known[0][3] else -2 / 3) if known else 0.0)


def test_every_row_is_scored_by_itself(spark):
    """Null and repeated ids, extra columns with the pipeline's own names."""
    m = classifier.demo_model(spark)
    w = {r["term"]: (r["idf"], r["coef"]) for r in m.weights.collect()}
    texts = ["pain and movie", "the weekend movie", None, "", "chest pain fever", "unknown"]
    data = [(i, t, 0.5, "x") for i in (None, 2, 2) for t in texts]
    df = spark.createDataFrame(data, "id long, text string, raw double, features string").repartition(3)

    def margin(t):
        tok = [x for x in (t or "").split() if len(x) > 1]
        seen = tok + [f"{a} {b}" for a, b in zip(tok, tok[1:])]
        x = {k: seen.count(k) * w[k][0] for k in set(seen) & set(w)}
        return sum(v * w[k][1] for k, v in x.items()) / (math.sqrt(sum(v * v for v in x.values())) or 1.0) + m.intercept
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    want = sorted(((i, round(margin(t), 9)) for i, t, *_ in data), key=key)
    for form in (classifier.margins, classifier.margins_joined):
        got = form(df, ["id"], m).collect()
        assert sorted(((r["id"], round(r["margin"], 9)) for r in got), key=key) == want
    scored = classifier.classify(df, m)
    assert scored.columns == [*df.columns, "margin", "medical", "confidence"]
    assert sorted(((r["id"], r["raw"], r["features"]) for r in scored.collect()), key=str) == sorted(((i, 0.5, "x") for i, *_ in data), key=str)


def test_margins_of_an_empty_table(spark):
    df = spark.createDataFrame([], "id long, text string")
    assert rows(classifier.margins(df, ["id"], classifier.demo_model(spark))) == []
    none = classifier.LinearTextModel(spark.createDataFrame([], "term string, idf double, coef double"), 0.25, 0)
    one = spark.createDataFrame([(1, "pain")], "id long, text string")
    assert rows(classifier.margins(one, ["id"], none)) == [(1, 0.25)]


def test_a_block_has_a_bounded_number_of_rows(spark):
    """A block was as many rows as Spark sent at once."""
    data = [("s", k, f"pain fever w{k % 9}" if k % 5 else "", k % 2, 1.0) for k in range(2_500)]
    rows = spark.createDataFrame(data, "source string, id long, text string, label int, weight double").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    try:
        table = svm.blocks(rows, ["fever", "pain", "w1"], [1.0, 2.0, 3.0])
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1024")
    found = [svm.Block(r) for r in table.collect()]
    assert sorted(len(b.y) for b in found) == [452, 1024, 1024]
    assert sum(len(b.x) for b in found) == 2_000 * 2 + sum(1 for k in range(2_500) if k % 5 and k % 9 == 1)
    assert np.allclose(sum((b.x ** 2).sum() for b in found), 2_000)
