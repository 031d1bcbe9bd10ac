"""Alignment audits against a full edit table and by hand."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.operators import alignment as A

GLOSSARY = [("hypertension", "high blood pressure"), ("myocardial infarction", "heart attack")]


def full_table(a, b):
    n, m = len(a), len(b)
    t = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            t[i][j] = t[i + 1][j + 1] + 1 if a[i] == b[j] else max(t[i + 1][j], t[i][j + 1])
    out, i, j = [], 0, 0
    while i < n and j < m:
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif t[i + 1][j] >= t[i][j + 1]:
            i += 1
        else:
            j += 1
    return out, t[0][0]


@pytest.mark.parametrize("band", [1, 32])
def test_align_is_a_longest_common_subsequence(monkeypatch, band):
    monkeypatch.setattr(A, "BAND", band)
    rng = random.Random(6)
    for _ in range(300):
        a = [rng.randrange(rng.choice([2, 5, 40])) for _ in range(rng.randrange(0, 60))]
        b = list(a)
        for _ in range(rng.randrange(0, 12)):
            k = rng.randrange(len(b) + 1)
            b[k:k + rng.randrange(0, 4)] = [rng.randrange(6) for _ in range(rng.randrange(0, 9))]
        if rng.random() < 0.2:
            b = [rng.randrange(6) for _ in range(rng.randrange(0, 80))]
        got = A.align(np.array(a, np.int64), np.array(b, np.int64))
        assert all(a[i] == b[j] for i, j in got)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:]))
        assert len(got) == full_table(a, b)[1]
        assert A._banded(np.array(a, np.int64), np.array(b, np.int64)) == full_table(a, b)[0]


CASES = [
    # source, output, (lost, moved), added
    ("Do not give aspirin.", "Do not give aspirin.", (0, 0), []),
    ("Do not give aspirin if fever.", "Do give aspirin if not fever.", (1, 0), []),
    ("The patient has no fever, but the pain is severe.", "The patient has fever, but no pain is severe.", (1, 0), []),
    ("The patient has no pain and fever.", "The patient has no fever and pain.", (0, 1), []),
    ("No history of hypertension.", "No history of high blood pressure.", (0, 0), []),
    ("Patient without hypertension today.", "Patient without high blood pressure today.", (0, 0), []),
    ("There is no fever.", "There is no fever. Take aspirin daily.", (0, 0), ["take", "aspirin", "daily"]),
    ("Acute myocardial infarction.", "Acute heart attack of the heart.", (0, 0), []),
    ("Myocardial damage.", "Heart damage.", (0, 0), ["heart"]),
    ("not", "", (1, 0), []),
    ("no.", "no.", (0, 0), []),
    (None, "not new", (0, 0), ["new"]),
    ("without pain", None, (1, 0), []),
]


def test_what_negations_govern(spark):
    rows = [(None if k % 3 else 1, s, o, "x") for k, (s, o, *_) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "id long, s string, o string, added_by string").repartition(3)
    got = A.audit(df, "s", "o", GLOSSARY)
    assert got.columns[:4] == df.columns
    found = {(r["s"], r["o"]): r for r in got.collect()}
    for s, o, (lost, moved), added in CASES:
        r = found[(s, o)]
        assert (r["negations_lost"], r["negations_moved"], r["added"]) == (lost, moved, added), (s, o, r)
    assert [tuple(g) for g in found[CASES[3][:2]]["governed"]] == [("no", "pain", "moved")]
    assert A.audit(df.limit(0), "s", "o").collect() == []


def test_random_rewrites_equal_the_full_table(spark, monkeypatch):
    rng = random.Random(4)
    vocab = "the pain no not fever , . aspirin without and hypertension is severe dose".split()
    rows = []
    for _ in range(200):
        a = [rng.choice(vocab) for _ in range(rng.randrange(0, 25))]
        b = [w for w in a if rng.random() < 0.9]
        for _ in range(rng.randrange(0, 4)):
            b.insert(rng.randrange(len(b) + 1), rng.choice(vocab))
        rows.append((" ".join(a), " ".join(b)))
    got = [tuple(r)[2:] for r in A.audit(spark.createDataFrame(rows, "s string, o string").coalesce(1), "s", "o", GLOSSARY).collect()]
    known = {"hypertension": [(["hypertension"], ["high", "blood", "pressure"])], "myocardial": [(["myocardial", "infarction"], ["heart", "attack"])]}
    plain = lambda a, b: full_table(a.tolist(), b.tolist())[0]
    real = A.align
    monkeypatch.setattr(A, "align", plain)
    for (s, o), g in zip(rows, got):
        a, b = s.split(), o.split()
        want = A.compare(a, b, known)
        if real(np.array([vocab.index(t) for t in a], np.int64), np.array([vocab.index(t) for t in b], np.int64)) == full_table(a, b)[0]:
            assert (g[0], g[1], g[2], [tuple(x) for x in g[3]], g[4], g[5]) == (*want[:3], [tuple(x) for x in want[3]], *want[4:])


def test_a_long_text(spark):
    words = [f"w{k % 997}" for k in range(60_000)]
    out = list(words)
    del out[30_000:30_040]
    out.insert(100, "not")
    df = spark.createDataFrame([(" ".join(words), " ".join(out))], "s string, o string")
    r = A.audit(df, "s", "o").select(F.size("added").alias("n"), "negations").first()
    assert r["n"] == 0 and r["negations"] == 0
    assert len(A.align(np.arange(60_000) % 997, np.delete(np.arange(60_000) % 997, slice(30_000, 30_040)))) == 59_960


def test_tokens_are_sent_as_one_text(spark):
    """Lists of all texts' tokens were held at once."""
    df = spark.createDataFrame([("No  pain\u00a0now,\x0bno\tFEVER.", "pain\u00a0now,\x0bno fever. ΟΔΟΣ"), (" ", None)], "s string, o string")
    done = A.audit(df, "s", "o", GLOSSARY)
    args = [j.toString() for j in [done._jdf.queryExecution().optimizedPlan()]][0]
    assert args.count("array_join") == 2
    got = {r["s"]: r for r in done.collect()}
    r = got["No  pain\u00a0now,\x0bno\tFEVER."]
    assert (r["negations"], r["negations_lost"], r["added"]) == (2, 1, ["οδος"]) and got[" "]["negations"] == 0
