"""Commits, versioned models, panel upkeep, seeded streams, stored answers, nested files, two-pass vocabulary."""

import json
import os
import random
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from parley.operators import classifier, features, heavy, infer, route, transcript
from parley.sources import commits, sinks, tables
from parley.streaming import panels, turns
from tests.conftest import rows

CONV = "conv_id long, turn long, role string, text string"


def test_commits_are_whole_and_once(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    df = spark.range(5).toDF("n")
    assert commits.read(spark, path, df.schema).count() == 0
    assert sinks.append_turns(df, path, "a") and not sinks.append_turns(df, path, "a")
    assert sinks.append_turns(df, path, "b")
    assert sinks.read_turns(df, path).count() == 10
    # a write that stops before its log entry leaves nothing that is read
    monkeypatch.setattr(commits, "_log", lambda *a: pytest.fail("stopped"))
    with pytest.raises(pytest.fail.Exception):
        commits.commit(df, path, "c")
    monkeypatch.undo()
    assert len(os.listdir(tmp_path / "t" / "data")) == 3
    assert sinks.read_turns(df, path).count() == 10
    assert sinks.append_turns(df, path, "c") and sinks.read_turns(df, path).count() == 15
    # two writers at once: the second finds the number taken, or the id
    real = commits.entries
    stale = real(spark, path)[:-1]
    seen = iter([stale])
    monkeypatch.setattr(commits, "entries", lambda s, p: next(seen, None) or real(s, p))
    assert commits._log(spark, path, "d", {"folder": "none"})
    monkeypatch.undo()
    assert [e["id"] for e in commits.entries(spark, path)] == ["a", "b", "c", "d"]


def test_a_load_during_a_save_gets_a_whole_model(spark, tmp_path, monkeypatch):
    train = spark.createDataFrame([("s", k, "pain fever dose" if k % 2 else "movie walk party", k % 2) for k in range(20)], "source string, id long, text string, label int")
    pm, table = classifier.train_svm(train)
    path = str(tmp_path / "m")
    classifier.save_model(pm, table, path)
    other = classifier.LinearTextModel(table.weights.withColumn("coef", -F.col("coef")), 7.0, table.n_terms)
    monkeypatch.setattr(commits, "publish", lambda *a: pytest.fail("stopped"))
    with pytest.raises(pytest.fail.Exception):
        classifier.save_model(other.pipeline(), other, path)
    monkeypatch.undo()
    assert classifier.load_model(spark, path)[1].intercept == table.intercept
    classifier.save_model(other.pipeline(), other, path)
    pm2, table2 = classifier.load_model(spark, path)
    assert table2.intercept == 7.0
    a = rows(classifier.predict(pm2, train), "id", "margin")
    assert a == rows(classifier.margins_joined(train, ["id"], table2), "id", "margin")


def _chat(seed, n_conv=6, n=9):
    rng = random.Random(seed)
    out = []
    for c in [*range(n_conv), None]:
        for t in [*range(n), None]:
            role = rng.choices(["assistant", "user", "system"], [5, 5, 2])[0] if t is not None else "user"
            out.append((c, t, role, rng.choice([f"text {c} {t}", "pain and fever today", " \n"]) if t is not None else f"late {c}"))
    return out


def test_panels_equal_the_batch_after_every_batch(spark, tmp_path):
    data = _chat(3)
    model = classifier.demo_model(spark)
    path = str(tmp_path / "p")

    def requests(df):
        return route.process_turns(route.turn_requests(df.withColumn("conv_id", F.coalesce("conv_id", F.lit(99)))), model)

    chat = [(99 if c is None else c, t, r, x) for c, t, r, x in data]
    parts = [[r for r in chat if r[1] is not None and r[1] < 4], [r for r in chat if r[1] is not None and r[1] >= 4 and r[0] < 3],
             [r for r in chat if r[1] is None or r[1] >= 4 and r[0] >= 3], [(2, 50, "system", "")], [(2, 51, "user", "again")]]
    seen = []
    for k, part in enumerate(parts):
        df = spark.createDataFrame(part, CONV)
        for _ in range(2):                                # the second is a replay
            panels.update(path, f"b{k}", transcript.chat_events(df), requests(df), buckets=4)
        seen += part
        whole = spark.createDataFrame(seen, CONV)
        want = transcript.panel_history(transcript.transcript(requests(whole), transcript.chat_events(whole)))
        assert Counter(map(tuple, panels.history(spark, path).collect())) == Counter(map(tuple, want.collect()))
    log = commits.entries(spark, path)
    assert len(log) == len(parts) and len(log[-1]["buckets"]) == 1
    # the same turns again, under another batch: they replace themselves
    df = spark.createDataFrame(parts[1], CONV)
    before = Counter(map(tuple, panels.history(spark, path).collect()))
    panels.update(path, "again", transcript.chat_events(df), requests(df), buckets=4)
    assert Counter(map(tuple, panels.history(spark, path).collect())) == before


def test_views_keep_null_keys(spark):
    data = [(None, 1, "user", "one"), (None, None, "user", "two"), (3, None, "user", "three"), (3, 1, "assistant", "four"), (3, None, "user", "five")]
    df = spark.createDataFrame(data, CONV)
    ev = transcript.chat_events(df)
    done = df.select("conv_id", "turn", F.when(F.col("role") == "user", "patient").otherwise("doctor").alias("speaker"), F.col("text").alias("original"),
                     F.lit("t").alias("translation"), F.lit(None).cast("string").alias("error"), F.lit(True).alias("medical"), F.lit(0.9).alias("confidence"), F.lit(None).cast("string").alias("simplified"))
    assert transcript.transcript(done, ev).count() == 5


def _stream(spark, folder, parts):
    for k, part in enumerate(parts):
        spark.createDataFrame(part, CONV).coalesce(1).write.parquet(f"{folder}/conversations.parquet/p{k}")
    return spark.readStream.schema(tables.SCHEMAS["conversations"]).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{folder}/conversations.parquet")


@pytest.mark.parametrize("cut", [0, 2, 5, 9])
def test_batch_prefix_and_stream_are_the_batch_whole(spark, tmp_path, cut):
    data = _chat(cut + 1)
    prefix = [r for r in data if r[1] is not None and r[1] < cut]
    rest = [r for r in data if r[1] is None or r[1] >= cut]
    names = ["conv_id", "turn", "epoch", "turn_no"]
    whole = transcript.number_turns(transcript.chat_events(spark.createDataFrame(data, CONV))).select(*names)
    before = transcript.chat_events(spark.createDataFrame(prefix, CONV))
    stream = turns.events_of(_stream(spark, str(tmp_path), [rest]))
    got = turns.run_to_table(turns.number_turns_stream(stream, after=before), spark, "seeded").select(*names)
    both = transcript.number_turns(before).select(*names).unionByName(got)
    assert Counter(map(tuple, both.collect())) == Counter(map(tuple, whole.collect()))


class FakeState:
    def __init__(self, value=None, timed_out=False):
        self.get, self.exists, self.hasTimedOut, self.timeout, self.removed = value, value is not None, timed_out, None, False

    def update(self, value):
        self.get, self.exists = value, True

    def setTimeoutDuration(self, ms):
        self.timeout = ms

    def remove(self):
        self.removed = True


def test_idle_state_expires():
    number = turns._numbering(60_000)
    state = FakeState((2, 5))
    frame = pd.DataFrame({"conv_id": [1, 1], "turn": [8, 7], "clear": [False, False], "shown": [True, True], "seed_epoch": [-1, -1], "seed_last": [-1, -1]})
    out = next(number((1,), iter([frame]), state))
    assert out.values.tolist() == [[1, 7, 2, 6], [1, 8, 2, 7]] and state.get == (2, 7) and state.timeout == 60_000
    late = FakeState((2, 7), timed_out=True)
    assert next(number((1,), iter([]), late)).empty and late.removed


class Counting(infer.Backend):
    """Writes down each call."""

    def __init__(self, folder, budget=None):
        self.folder = folder
        self.token_budget = budget

    def predict(self, texts, src, tgt):
        with open(os.path.join(self.folder, f"{os.urandom(8).hex()}.json"), "w") as f:
            json.dump(texts, f)
        if any(t == "bad" for t in texts):
            raise ValueError("cannot")
        return [t.upper() for t in texts]


def _calls(folder):
    return [json.loads((folder / n).read_text()) for n in os.listdir(folder)]


def test_a_second_run_asks_only_for_what_is_missing(spark, tmp_path):
    folder = tmp_path / "calls"
    folder.mkdir()
    backend = Counting(str(folder))
    data = [(k, f"text {k % 5}", "en", "fr") for k in range(20)] + [(50, None, "en", "fr")]
    df = spark.createDataFrame(data, "id long, text string, s string, t string")

    def run(df):
        out = infer.run_backend(df, backend, "s", "t", "text", "out", "err", store=str(tmp_path / "store"))
        return {r["id"]: (r["out"], r["err"]) for r in out.collect()}
    first = run(df)
    assert first[7] == ("TEXT 2", None) and first[50] == (None, None)
    n = len(_calls(folder))
    assert run(df) == first and len(_calls(folder)) == n           # no call
    more = df.unionByName(spark.createDataFrame([(60, "new", "en", "fr"), (61, "bad", "en", "fr")], df.schema))
    again = run(more)
    assert again[60] == ("NEW", None) and again[61] == (None, "cannot") and {k: again[k] for k in first} == first
    assert {t for c in _calls(folder) for t in c} == {f"text {k}" for k in range(5)} | {"new", "bad"}
    n = len(_calls(folder))
    assert run(more)[61] == (None, "cannot") and {t for c in _calls(folder)[:] for t in c} and len(_calls(folder)) == n + 1


def test_calls_keep_the_token_budget(spark, tmp_path):
    backend = Counting(str(tmp_path), budget=10)
    df = spark.createDataFrame([(k, "w " * (1 + k % 4) + str(k), "en", "fr") for k in range(40)] + [(99, "long " * 30, "en", "fr")], "id long, text string, s string, t string")
    out = infer.run_backend(df, backend, "s", "t", "text", "out", "err").collect()
    assert all(r["out"] == r["text"].upper() for r in out) and len(out) == 41
    for texts in _calls(tmp_path):
        assert len(texts) == 1 or sum(len(t.split()) for t in texts) <= 10


def test_nested_lines(spark, tmp_path):
    good = [{"id": 1, "conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}, {"from": "human", "value": "c"}]},
            {"id": 2, "conversations": []}, {"id": 3}, {"conversations": None, "other": {"x": 1}}]
    bad = ["{broken", '{"id": "seven", "conversations": []}', '{"id": 5, "conversations": {"from": "x"}}', "[1]"]
    (tmp_path / "a.jsonl").write_text("\n".join([json.dumps(g) for g in good[:2]] + ["", bad[0], bad[1]]) + "\n")
    (tmp_path / "b.jsonl").write_text("\n".join([bad[2], *[json.dumps(g) for g in good[2:]]]))
    ok, wrong = tables.read_dialogues(spark, str(tmp_path))
    assert sorted(str(r["id"]) for r in ok.collect()) == ["1", "2", "3", "None"]
    assert sorted(r["line"] for r in wrong.collect()) == sorted(bad[:3])
    assert {os.path.basename(r["file"]) for r in wrong.collect()} == {"a.jsonl", "b.jsonl"}
    from parley.operators import corpus
    flat = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "user", "c")], CONV)
    assert rows(corpus.user_text_nested(ok).where("text <> ''"), "id", "text") == rows(corpus.user_text_flat(flat), "conv_id", "text")


@pytest.mark.parametrize("spare", [1, 4, 8])
def test_two_pass_vocabulary(spark, spare):
    rng = random.Random(spare)
    words = [f"w{k}" for k in range(400)]
    data = [(k, " ".join(rng.choices(words, [1 / (j + 1) for j in range(400)], k=rng.randrange(0, 60)))) for k in range(150)] + [(None, None), (1, "")]
    df = spark.createDataFrame(data, "id long, text string").repartition(6)
    for k in (1, 20, 200, 50_000):
        want = rows(features.vocab_topk(features.term_stats(df), k))
        assert rows(heavy.vocab_topk(df, k, spare=spare)) == want
    real = {r["term"]: r["tf"] for r in features.term_stats(df).collect()}
    counts, lost = heavy.summary(df, 100)
    assert len(counts) <= 100 and lost <= sum(real.values()) / 100
    assert all(n <= real[t] <= n + lost for t, n in counts.items()) and all(real[t] <= lost for t in set(real) - set(counts))
    some = heavy.survivors((counts, lost), 5)
    assert some is not None and len(some) < len(real) / 20
    assert rows(heavy.vocab_topk(df.limit(0), 5)) == []


def test_a_summary_counts_a_bounded_number_of_terms_at_once(spark, monkeypatch):
    """All terms of the texts that Spark sent at once were counted together."""
    from parley.operators import heavy
    df = spark.createDataFrame([(" ".join(f"w{k % 50} x{k}" for k in range(n, n + 3_000)),) for n in range(0, 30_000, 3_000)] + [(None,), ("",)], "text string")
    monkeypatch.setattr(heavy, "AT_ONCE", 1_000)
    got = [tuple(r) for r in heavy.vocab_topk(df, 40).orderBy("term").collect()]
    assert got == [tuple(r) for r in features.vocab_topk(features.term_stats(df), 40).orderBy("term").collect()]
