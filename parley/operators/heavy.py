"""The most frequent terms in two passes that shuffle only what may be among them.

1. Every task keeps a Misra-Gries summary of its terms: at most ``capacity`` counts, from
   which the least are subtracted whenever there are more. Summaries merge the same way
   (``treeAggregate``), so the driver gets one of that size. A count falls short of the
   term's real one by at most what was subtracted in all, which is at most the number of
   terms divided by the capacity.
2. The k-th largest count is a proven lower cutoff: k terms have at least that many. If
   it is above what was subtracted, a term outside the summary can't be among the k; so a
   second pass counts exactly the terms of the summary that may reach the cutoff (at
   most ``capacity`` of them, broadcast), and no other term is shuffled.

Otherwise, where the terms are too even for the capacity, all are counted.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.functions.text import let, terms
from parley.operators import features
from parley.plans.sizing import broadcast_fixed

#: Counts kept for each term wanted.
SPARE = 8
#: Terms that a task counts at once.
AT_ONCE = 1 << 17

Summary = tuple[dict[str, int], int]


def pruned(counts: dict[str, int], lost: int, capacity: int) -> Summary:
    """At most ``capacity`` counts: the next largest is subtracted from all."""
    if len(counts) <= capacity:
        return counts, lost
    off = int(-np.partition(-np.fromiter(counts.values(), np.int64, len(counts)), capacity)[capacity])
    return {t: n - off for t, n in counts.items() if n > off}, lost + off


def merged(a: Summary, b: Summary, capacity: int) -> Summary:
    counts = dict(a[0])
    for t, n in b[0].items():
        counts[t] = counts.get(t, 0) + n
    return pruned(counts, a[1] + b[1], capacity)


def summary(corpus: DataFrame, capacity: int, text_col: str = "text") -> Summary:
    """(counts, most that any term's count falls short) of all terms of the corpus."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, lost, held = {}, 0, []

        def add() -> None:
            nonlocal counts, lost
            found = pc.value_counts(pa.chunked_array(held, pa.string()))
            for term, n in zip(found.field("values").to_pylist(), found.field("counts").to_pylist()):
                counts[term] = counts.get(term, 0) + n
            held.clear()
            if len(counts) > 2 * capacity:
                counts, lost = pruned(counts, lost, capacity)
        for batch in batches:
            held.append(batch.column(0))
            if sum(map(len, held)) >= AT_ONCE:
                add()
        add()
        yield pa.RecordBatch.from_pydict({"s": pa.array([pickle.dumps(pruned(counts, lost, capacity))], pa.binary())})
    # a row a term, so what a task holds follows neither the texts' lengths nor their number; the
    # outer explode is the plain one here, without a filter that computes the terms again
    each = corpus.select(F.explode_outer(terms(F.coalesce(F.col(text_col), F.lit("")))).alias("t")).where("t IS NOT NULL")
    parts = each.mapInArrow(run, "s binary")
    both = lambda a, b: merged(a, b, capacity)
    return parts.rdd.map(lambda r: pickle.loads(r["s"])).treeAggregate(({}, 0), both, both, depth=2)


def survivors(found: Summary, k: int) -> list[str] | None:
    """The terms that may be among the k most frequent; None where others may be, too."""
    counts, lost = found
    if lost == 0 and len(counts) <= k:
        return list(counts)
    if len(counts) < k:
        return None
    cutoff = sorted(counts.values(), reverse=True)[k - 1]
    return [t for t, n in counts.items() if n + lost >= cutoff] if cutoff > lost else None


def vocab_topk(corpus: DataFrame, k: int = features.MAX_FEATURES, text_col: str = "text", spare: int = SPARE) -> DataFrame:
    """``features.vocab_topk(features.term_stats(corpus), k)``: term, tf, df."""
    wanted = survivors(summary(corpus, spare * k, text_col), k)
    if wanted is None:
        return features.vocab_topk(features.term_stats(corpus, text_col), k)
    spark = corpus.sparkSession
    table = spark.createDataFrame([(t,) for t in wanted], "term string")
    return features.vocab_topk(stats_of(corpus, broadcast_fixed(table, spare * k, "terms that may be frequent"), text_col), k)


def stats_of(corpus: DataFrame, some: DataFrame, text_col: str = "text") -> DataFrame:
    """``term, tf, df`` of some terms; those of a text are counted in its row, the others
    go before the shuffle."""
    def occurrences(t):
        each = lambda x, tf, df: F.struct(x.alias("term"), F.lit(tf).alias("tf"), F.lit(df).alias("df"))
        return F.concat(F.transform(t, lambda x: each(x, 1, 0)), F.transform(F.array_distinct(t), lambda x: each(x, 0, 1)))
    e = corpus.select(F.explode(let(terms(F.col(text_col)), occurrences)).alias("e")).select("e.*")
    return (e.join(some, "term").groupBy("term").agg(F.sum("tf").cast("long").alias("tf"), F.sum("df").cast("long").alias("df")))
