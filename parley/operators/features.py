"""TF-IDF features: term statistics, top-k vocabulary, smoothed IDF and
L2-normalised weights — as aggregations, so the optimiser plans them.

Term statistics come from ONE explode of ``(term, 1, 0)`` per occurrence and
``(term, 0, 1)`` per distinct term of a text, summed per term: the aggregate
is partial on the map side (a frequent term such as "the" is collapsed in each
task before the shuffle) and needs no (text, term) shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.functions.text import let, terms
from parley.plans.sizing import broadcast_fixed

MAX_FEATURES = 10_000


def term_stats(corpus: DataFrame, text_col: str = "text") -> DataFrame:
    """``term, tf`` (occurrences over the corpus), ``df`` (texts containing it)."""
    def occurrences(t):
        return F.concat(
            F.transform(t, lambda x: F.struct(x.alias("term"), F.lit(1).alias("tf"), F.lit(0).alias("df"))),
            F.transform(F.array_distinct(t),
                        lambda x: F.struct(x.alias("term"), F.lit(0).alias("tf"), F.lit(1).alias("df"))))
    e = corpus.select(F.explode(let(terms(F.col(text_col)), occurrences)).alias("e"))
    return (e.groupBy(F.col("e.term").alias("term"))
            .agg(F.sum("e.tf").cast("long").alias("tf"), F.sum("e.df").cast("long").alias("df")))


def vocab_topk(stats: DataFrame, k: int = MAX_FEATURES) -> DataFrame:
    """The ``k`` most frequent terms, ties by term (a bounded TakeOrdered)."""
    return stats.orderBy(F.desc("tf"), F.asc("term")).limit(k)


def idf_table(vocab: DataFrame, n_docs: int) -> DataFrame:
    """Smoothed IDF ``ln((1+N)/(1+df)) + 1`` for each vocabulary term."""
    return vocab.select("term", "tf", "df",
                        (F.log((F.lit(1.0) + F.lit(n_docs)) / (F.lit(1.0) + F.col("df")))
                         + F.lit(1.0)).alias("idf"))


def fit_vocabulary(train: DataFrame, k: int = MAX_FEATURES, text_col: str = "text",
                   n_docs: int | None = None) -> tuple[list[str], list[float]]:
    """Vocabulary and IDF fitted on the training texts. Only the <= k vocabulary
    rows and one count reach the driver."""
    if n_docs is None:
        n_docs = train.count()
    rows = (idf_table(vocab_topk(term_stats(train, text_col), k), n_docs)
            .orderBy("term").select("term", "idf").collect())
    return [r["term"] for r in rows], [float(r["idf"]) for r in rows]


def term_counts(df: DataFrame, id_cols: list[str], text_col: str, vocab: DataFrame,
                bound: int) -> DataFrame:
    """In-vocabulary term counts per text: ``ids, term, tf, <vocab columns>``.
    The vocabulary (at most ``bound`` rows) is broadcast; the count is partial
    map-side, so only distinct in-vocabulary (text, term) pairs are shuffled."""
    vb = broadcast_fixed(vocab, bound, "vocabulary")
    toks = df.select(*id_cols, F.explode(terms(F.col(text_col))).alias("term"))
    vcols = [c for c in vocab.columns if c != "term"]
    return (toks.join(vb, "term")
            .groupBy(*id_cols, "term", *vcols).agg(F.count(F.lit(1)).alias("tf")))


def tfidf(df: DataFrame, id_cols: list[str], text_col: str, vocab_idf: DataFrame,
          bound: int = MAX_FEATURES) -> DataFrame:
    """Long-form TF-IDF: ``ids, term, weight`` with ``weight = tf*idf / ||tf*idf||``
    over the text's in-vocabulary terms."""
    tc = term_counts(df, id_cols, text_col, vocab_idf.select("term", "idf"), bound)
    # a text's pairs meet once (at most ``bound`` of them); norm and weights come from that array
    pairs = tc.groupBy(*id_cols).agg(F.collect_list(
        F.struct("term", (F.col("tf") * F.col("idf")).alias("x"))).alias("_pairs"))
    norm = F.sqrt(F.aggregate("_pairs", F.lit(0.0), lambda acc, p: acc + p["x"] * p["x"]))
    weighed = pairs.select(*id_cols, norm.alias("_norm"), F.explode("_pairs").alias("_p"))
    return weighed.select(*id_cols, F.col("_p.term").alias("term"),
                          (F.col("_p.x") / F.col("_norm")).alias("weight"))
