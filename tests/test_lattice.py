"""Lattice translation against the enumeration of all segmentations."""

import itertools
import random

from pyspark.sql import functions as F

from parley.operators import lattice as L

ENTRY = "src string, tgt string, phrase string, translation string, score long"
LM = "tgt string, prev string, next string, score long"


def segmentations(n):
    for cut in itertools.product([0, 1], repeat=max(n - 1, 0)):
        ends = [k + 1 for k, c in enumerate(cut) if c] + [n]
        yield list(zip([0, *ends[:-1]], ends)) if n else []


def brute(words, table, lm):
    """All best scores' outputs over every segmentation and translation."""
    best, outs = None, set()
    for seg in segmentations(len(words)):
        choices = []
        for a, b in seg:
            key = " ".join(words[a:b]).lower()
            choices.append([(t, s) for p, t, s in table if p == key] + ([(words[a], L.PASS)] if b - a == 1 else []))
        for pick in itertools.product(*choices):
            out = " ".join(t for t, _ in pick).split()
            path = ["", *[w.lower() for w in out], ""]
            score = sum(s for _, s in pick) + sum(lm.get(p, L.UNSEEN) for p in zip(path, path[1:]))
            if best is None or score > best:
                best, outs = score, set()
            if score == best:
                outs.add(" ".join(out))
    return best, outs


def test_equals_enumeration(spark):
    rng = random.Random(3)
    src, out = ["a", "b", "c", "d"], ["x", "y", "z w", "v"]
    table = {(" ".join(rng.choices(src, k=rng.randrange(1, 4))), " ".join(rng.choices(out, k=rng.randrange(1, 3)))) for _ in range(40)}
    table = [(p, t, -rng.randrange(1, 9000)) for p, t in sorted(table)]
    words = ["", "x", "y", "z", "w", "v", *src]
    lm = {(p, q): -rng.randrange(1, 12000) for p in words for q in words if rng.random() < 0.6}
    texts = [[rng.choice(src + ["E"]) for _ in range(rng.randrange(0, 7))] for _ in range(40)]
    rows = [(k if k % 5 else None, " ".join(t), "fr_XX", "en_XX", "x") for k, t in enumerate(texts)] + [(7, None, "fr_XX", "en_XX", "x"), (7, "a", "qq", "en_XX", "x"), (7, "a b", "en_XX", "fr_XX", "x")]
    df = spark.createDataFrame(rows, "id long, text string, s string, t string, edges string").repartition(3)
    got = L.translated(df, "s", "t", "text", spark.createDataFrame([("fr_XX", "en_XX", *e) for e in table], ENTRY),
                       spark.createDataFrame([("en_XX", *p, s) for p, s in lm.items()], LM)).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["text"] is None:
            assert r["translation"] is None and r["error"] is None
        elif r["s"] == "qq":
            assert r["error"] == "unsupported language qq" and r["translation"] is None
        elif r["s"] == "en_XX":
            assert r["translation"] == "a b" and r["path_score"] == 2 * L.PASS + 3 * L.UNSEEN
        else:
            score, outs = brute(r["text"].split(), table, lm)
            assert r["path_score"] == score and r["translation"] in outs and not r["truncated"]


def test_blanks_marks_case_and_the_cap(spark):
    table = spark.createDataFrame([("fr_XX", "en_XX", "aujourd'hui", "today", -10), ("fr_XX", "en_XX", "tension artérielle", "blood pressure", -10)], ENTRY)
    none = spark.createDataFrame([], LM)
    df = spark.createDataFrame([(1, "  La Tension \t artérielle, aujourd'hui!"), (2, "mot " * 300), (3, "mot " * 200), (4, " \n")], "id long, text string")
    df = df.withColumn("s", F.lit("fr_XX")).withColumn("t", F.lit("en_XX"))
    got = {r["id"]: r for r in L.translated(df, "s", "t", "text", table, none).collect()}
    assert got[1]["translation"] == "La blood pressure, today!"
    assert got[2]["translation"] == " ".join(["mot"] * 200) and got[2]["truncated"]
    assert got[3]["translation"] == " ".join(["mot"] * 200) and not got[3]["truncated"]
    assert got[4]["translation"] == "" and got[4]["path_score"] == L.UNSEEN
    assert L.translated(df.limit(0), "s", "t", "text", table, none).collect() == []


def test_bigram_scores(spark):
    docs = spark.createDataFrame([("The pain, the fever",), ("the pain",), (None,)], "text string")
    got = {(r["prev"], r["next"]): r["score"] for r in L.bigram_scores(docs, "en_XX").collect()}
    assert got[("the", "pain")] == round(1000 * -0.405465) and got[("pain", ",")] == round(-693.147) and got[("", "the")] == 0
    e = spark.createDataFrame([("a", "b", "p", "x"), ("a", "b", "p", "x"), ("a", "b", "p", "y"), ("a", "b", "q", "x")], "src string, tgt string, phrase string, translation string")
    assert {(r["phrase"], r["translation"], r["score"]) for r in L.entries(e).collect()} == {("p", "x", -693), ("p", "y", -693), ("q", "x", 0)}


def test_a_place_takes_along_only_what_an_entry_may_have(spark):
    """Every place took along all tokens of its row."""
    text = " \t".join(("Tension", "artérielle,", "\u00a0x", "ΟΔΟΣ'")[k % 4] for k in range(400))
    df = spark.createDataFrame([(1, text), (2, ""), (3, None)], "id long, text string")
    both = df.select("id", F.transform(L.tokens(F.col("text")), L.word).alias("a"), L.words(F.col("text")).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in both) and len(both[0]["b"]) > 400
    table = spark.createDataFrame([("fr_XX", "en_XX", "tension artérielle", "blood pressure", -10)], ENTRY)
    rows = df.where("id < 3").select(F.col("id").alias("_row"), F.lit("fr_XX").alias("_src"), F.lit("en_XX").alias("_tgt"), L.tokens(F.col("text")).alias("_tokens"))
    runs = L._runs(rows, 2)
    assert "_tokens" not in runs.columns and runs.count() == 2 * len(both[0]["b"]) - 1
    got = {r["_row"]: r["edges"] for r in L.lattices(rows, table, spark.createDataFrame([], LM)).collect()}
    assert len(got[1]) == 100 and got[2] == []
