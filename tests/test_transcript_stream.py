import os
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from parley.functions import fixed_values as fv
from parley.operators import classifier, route, sequence, transcript
from parley.streaming import turns
from tests.conftest import rows


def _conv(spark, data):
    return spark.createDataFrame(data, "conv_id long, turn long, role string, text string")


def test_blocked_reset_count_equals_windows(spark):
    import random
    rnd = random.Random(4)
    data = []
    for c in range(6):
        for t in rnd.sample(range(3000), 500):
            clear = rnd.random() < (0.02 if c % 2 else 0.2)
            data.append((c, t, clear, not clear and rnd.random() < 0.7))
    df = spark.createDataFrame(data, "c long, t long, r boolean, f boolean")
    w = Window.partitionBy("c").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    want = df.withColumn("e", F.sum(F.col("r").cast("long")).over(w))
    want = want.withColumn("n", F.sum(F.col("f").cast("long")).over(
        Window.partitionBy("c", "e").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)))
    for block in (16, 256, 4096):
        got = sequence.reset_count(df, "c", "t", "r", "f", "e", "n", block)
        assert rows(got, "c", "t", "e", "n") == rows(want, "c", "t", "e", "n")


def test_clear_restarts_numbering(spark):
    conv = _conv(spark, [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "system", "clear"),
                         (1, 3, "user", "  "), (1, 4, "user", "c"), (2, 0, "system", "s"), (2, 1, "user", "d")])
    got = rows(transcript.number_turns(transcript.chat_events(conv)), "conv_id", "turn", "epoch", "turn_no")
    assert got == [(1, 0, 0, 1), (1, 1, 0, 2), (1, 4, 1, 1), (2, 1, 1, 1)]


def test_transcript_views_and_failures(spark):
    conv = _conv(spark, [(1, 0, "assistant", "She was diagnosed with hypertension."),
                         (1, 1, "user", "molo <b>"), (1, 2, "assistant", "ok")])
    processed = route.process_turns(route.turn_requests(conv), classifier.demo_model(spark))
    # force failures on turns 1 and 2 to check the placeholders
    processed = processed.withColumn(
        "error", F.when(F.col("turn") >= 1, F.lit("boom"))).withColumn(
        "translation", F.when(F.col("turn") == 0, F.col("translation")))
    tr = {r["turn_no"]: r for r in transcript.transcript(processed, transcript.chat_events(conv)).collect()}
    assert tr[1]["role"] == "assistant" and tr[1]["tag"].startswith("médico · ")
    assert tr[1]["simplified"] == "She was diagnosed with high blood pressure."
    assert tr[2]["role"] == "user" and tr[2]["en"] == fv.PLACEHOLDER_PATIENT_FAILED and tr[2]["xx"] == "molo <b>"
    assert tr[3]["xx"] == fv.PLACEHOLDER_DOCTOR_FAILED and tr[3]["tag"] is None
    panels = transcript.panel_history(transcript.transcript(processed, transcript.chat_events(conv)))
    assert panels.count() == 6


def _write_parts(spark, parts, tmp_path):
    base = str(tmp_path / ("stream-" + uuid.uuid4().hex[:8]))
    for i, data in enumerate(parts):
        _conv(spark, data).coalesce(1).write.parquet(f"{base}/part{i}")
        # one parquet file per micro-batch, named as the stream source expects
        f = [x for x in os.listdir(f"{base}/part{i}") if x.endswith(".parquet")][0]
        os.rename(f"{base}/part{i}/{f}", f"{base}/conversations-{i}.parquet")
    return base


def test_stream_numbering_across_micro_batches(spark, tmp_path):
    parts = [
        [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "x")],
        [(1, 2, "system", "c"), (1, 3, "user", "d"), (2, 1, "assistant", " ")],
        [(1, 4, "assistant", "e"), (2, 2, "user", "y")],
    ]
    base = _write_parts(spark, parts, tmp_path)
    stream = (spark.readStream.schema("conv_id long, turn long, role string, text string")
              .option("maxFilesPerTrigger", 1).option("pathGlobFilter", "conversations-*.parquet").parquet(base))
    got = rows(turns.run_to_table(turns.number_turns_stream(turns.events_of(stream)), spark, "t"),
               "conv_id", "turn", "epoch", "turn_no")
    batch = rows(transcript.number_turns(transcript.chat_events(_conv(spark, sum(parts, [])))),
                 "conv_id", "turn", "epoch", "turn_no")
    assert got == batch == [(1, 0, 0, 1), (1, 1, 0, 2), (1, 3, 1, 1), (1, 4, 1, 2), (2, 0, 0, 1), (2, 2, 0, 2)]


def test_stream_scoring_is_map_only(spark, tmp_path):
    from tests.test_classifier import _separable
    pm, _ = classifier.train_svm(_separable(spark), max_iter=50)
    parts = [[(1, 0, "assistant", "patient dose fever"), (1, 1, "user", "x")],
             [(2, 0, "assistant", "movie weekend party")]]
    base = _write_parts(spark, parts, tmp_path)
    stream = (spark.readStream.schema("conv_id long, turn long, role string, text string")
              .option("maxFilesPerTrigger", 1).option("pathGlobFilter", "conversations-*.parquet").parquet(base))
    got = rows(turns.run_to_table(turns.score_stream(stream, pm), spark, "s"), "conv_id", "medical")
    assert got == [(1, True), (2, False)]
