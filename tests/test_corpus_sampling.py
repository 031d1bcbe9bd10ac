import math
import random

from pyspark.sql import functions as F

from parley.operators import corpus, sampling
from tests.conftest import SF_MID, rows


def test_nested_extract(spark):
    df = spark.createDataFrame([
        (1, [("human", "hi"), ("gpt", "x"), ("human", "there")]),
        (2, [("Human", "no"), ("gpt", "y")]),
        (3, []),
    ], "id long, conversations array<struct<from:string,value:string>>")
    got = dict((r["id"], r["text"]) for r in corpus.user_text_nested(df).collect())
    assert got == {1: "hi there", 2: "", 3: ""}


def test_flat_extract_orders_and_splits_blocks(spark):
    data = [(7, t, "user", f"w{t}") for t in random.Random(1).sample(range(50), 50)]
    data += [(7, 99, "assistant", "skip"), (8, 0, "user", "only"), (9, 0, "assistant", "x")]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    want = " ".join(f"w{t}" for t in range(50))
    for block in (4, 1024):   # many partial strings, or one
        got = dict(rows(corpus.user_text_flat(df, block=block), "conv_id", "text"))
        assert got == {7: want, 8: "only", 9: ""}


def test_corpus_filters(spark):
    docs = spark.createDataFrame([(1, None, "en"), (2, "", "en"), (3, "  ", "en"), (4, "x", "fr"), (5, "y", "en")],
                                 "doc_id long, text string, lang string")
    conv = spark.createDataFrame([(1, 0, "user", " \n"), (2, 0, "user", " a "), (3, 0, "assistant", "b")],
                                 "conv_id long, turn long, role string, text string")
    got = rows(corpus.corpus_build(docs, conv), "source", "id", "text", "label")
    assert got == [("neg", 2, " a ", 0), ("pos", 3, "  ", 1), ("pos", 5, "y", 1)]


def test_class_counts(spark):
    c = spark.createDataFrame([("pos", i, "t", 1) for i in range(5)] + [("neg", i, "t", 0) for i in range(3)],
                              "source string, id long, text string, label int")
    assert rows(corpus.class_counts(c)) == [(0, 3, 3, 6), (1, 5, 3, 6)]


def _corpus(spark, n_pos, n_neg):
    return spark.createDataFrame(
        [("pos", i, f"p{i}", 1) for i in range(n_pos)] + [("neg", i, f"n{i}", 0) for i in range(n_neg)],
        "source string, id long, text string, label int")


def test_bucketed_rank_equals_window(spark):
    c = _corpus(spark, 9000, 7000).withColumn("_k", sampling.order_key("42", F.col("source"), F.col("id")))
    for q in (1, 37, 2000, 6999, 7000):
        quotas = spark.createDataFrame([(0, q), (1, q)], "label int, quota long")
        a = sampling.flag_first_n(c, "label", "_k", "id", quotas, "f")
        b = sampling.flag_first_n_window(c, "label", "_k", "id", quotas, "f")
        assert rows(a, "source", "id", "f") == rows(b, "source", "id", "f")


def test_balanced_sample_exact_and_stable(spark):
    c = _corpus(spark, 3000, 1234)
    a = sampling.balanced_sample(c)
    counts = dict(rows(a.groupBy("label").count()))
    assert counts == {0: 1234, 1: 1234}
    b = sampling.balanced_sample(c.repartition(13))
    assert rows(a, "source", "id") == rows(b, "source", "id")


def test_stratified_split_sizes(spark):
    for n_pos, n_neg in ((8, 7), (100, 100), (51, 348)):
        s = sampling.stratified_split(_corpus(spark, n_pos, n_neg))
        n = n_pos + n_neg
        got = dict(((lbl, sp), k) for lbl, sp, k in rows(s.groupBy("label", "split").count()))
        n_test = math.ceil(0.2 * n)        # double arithmetic, as in the classic splitter
        assert got.get((0, "test"), 0) + got.get((1, "test"), 0) == n_test
        for lbl, size in ((1, n_pos), (0, n_neg)):
            assert got.get((lbl, "test"), 0) + got.get((lbl, "train"), 0) == size
            assert abs(got.get((lbl, "test"), 0) - n_test * size / n) < 1.0
        assert s.select("source", "id").distinct().count() == n


def test_split_test_size_is_ceil(spark):
    s = sampling.stratified_split(_corpus(spark, 8, 8))
    assert s.where(F.col("split") == "test").count() == math.ceil(0.2 * 16) == 4


def test_training_split_on_tables(spark):
    from parley.plans import catalog
    s = catalog._split(spark, SF_MID)
    got = dict(((lbl, sp), k) for lbl, sp, k in rows(s.groupBy("label", "split").count()))
    assert got == {(0, "test"): 20, (0, "train"): 80, (1, "test"): 20, (1, "train"): 80}


def test_nested_and_flat_extraction_agree(spark):
    flat = spark.read.parquet(f"{SF_MID}/conversations.parquet")
    nested = corpus.dialogues_of(flat)
    a = dict(rows(corpus.user_text_nested(nested), "id", "text"))
    b = dict(rows(corpus.user_text_flat(flat), "conv_id", "text"))
    assert a == b


def test_cutoffs_narrow_a_crowded_bucket(spark):
    """Few distinct keys and many ties: the boundary is found by longer prefixes."""
    rnd = random.Random(2)
    keys = ["abc" + "0" * 26 + f"{i:03x}" for i in range(5)]
    data = [(g, rnd.choice(keys), i) for i in range(600) for g in (0, 1)]
    df = spark.createDataFrame(data, "label int, k string, id long")
    for quota in (1, 77, 599, 600, 900):
        got = sampling.cutoffs(df, "label", "k", "id", {0: quota, 1: quota}, bucket_rows=10)
        for g in (0, 1):
            own = sorted((k, i) for lbl, k, i in data if lbl == g)
            assert got.get(g) == ((*own[quota - 1], 1, 1) if quota <= 600 else None)


def test_repeated_and_null_ids_give_exact_counts(spark):
    schema = "source string, id long, text string, label int"
    data = [("s", 2, "same", 1)] * 3 + [("s", None, f"t{k}", 1) for k in range(4)] + [("s", 2, f"u{k}", 0) for k in range(5)] + [(None, None, "x", 0)] * 6
    df = spark.createDataFrame(data, schema).repartition(4)
    assert rows(sampling.balanced_sample(df).groupBy("label").count()) == [(0, 7), (1, 7)]
    for quota in range(1, 9):
        keyed = df.withColumn("_k", sampling.order_key("z", F.col("source"), F.col("id")))
        quotas = spark.createDataFrame([(0, quota), (1, quota)], "label int, quota long")
        got = sampling.flag_first_n(keyed, "label", "_k", "id", quotas, "f")
        assert got.count() == len(data)
        kept = got.where("f").select("label", "_k", "id").collect()
        want = sampling.flag_first_n_window(keyed, "label", "_k", "id", quotas, "f").where("f").select("label", "_k", "id").collect()
        assert sorted(map(str, kept)) == sorted(map(str, want))
    split = sampling.stratified_split(df.unionByName(df))
    assert rows(split.groupBy("label", "split").count()) == [(0, "test", 5), (0, "train", 17), (1, "test", 3), (1, "train", 11)]


def test_groups_without_rows_or_quota(spark):
    df = spark.createDataFrame([(0, "a" * 32, 1), (1, "b" * 32, 2)], "label int, k string, id long")
    quotas = spark.createDataFrame([(0, 0), (2, 5)], "label int, quota long")
    assert rows(sampling.flag_first_n(df, "label", "k", "id", quotas, "f")) == [(0, "a" * 32, 1, False)]
    assert rows(sampling.flag_first_n(df.where("false"), "label", "k", "id", quotas, "f")) == []


def test_spread_only_for_poorly_split_scans(spark):
    from parley.sources import tables
    cores = spark.sparkContext.defaultParallelism
    d = tables.documents(spark, SF_MID)
    assert tables.spread(d).rdd.getNumPartitions() == 2 * cores
    big = d.repartition(3 * cores)
    assert tables.spread(big) is big
