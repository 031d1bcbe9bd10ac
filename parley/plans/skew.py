"""Joining many request rows back to one result row per key, with hot keys
split.

A key repeated by a large share of the requests (one text sent a million
times) would put all those rows into one join task. The result side already
knows each key's multiplicity (it comes from the deduplicating aggregate), so:

1. hot keys are those with ``mult > hot_rows``: at most ``total_rows /
   hot_rows`` of them — bounded, so they are broadcast with their number of
   salts, ``mult / hot_rows`` rounded up;
2. a hot result row is replicated once a salt, other result rows get salt 0;
3. a request row of a hot key gets one of its key's salts from a hash of the
   whole row (stable under task retries), others get 0;
4. the join runs on the key and the salt.

The key is a fixed-width digest, so no text is shuffled as a key or read from the
result side. Requests without a key have no result; they take any of ``NULL_SALTS``
salts, as a null key would hold them all in one task too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.plans.sizing import broadcast_if_small

HOT_KEY_ROWS = 200_000
NULL_SALTS = 4096


def salted_join_back(reqs: DataFrame, results: DataFrame, key: str, mult: str,
                     hot_rows: int = HOT_KEY_ROWS) -> DataFrame:
    """Left join ``reqs`` to ``results`` (unique on ``key``, with multiplicity
    column ``mult``); a hot key is spread over as many tasks as it has times
    ``hot_rows`` rows. Both inputs' key column stays in the result once."""
    hot = results.where(F.col(mult) > hot_rows).select(
        key, F.ceil(F.col(mult) / hot_rows).cast("int").alias("_salts"))
    hot, _ = broadcast_if_small(hot, "hot keys")
    res = (results.join(hot, key, "left")
           .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)))
           .drop("_salts", mult))
    row = F.xxhash64(*[F.col(c) for c in reqs.columns])
    salts = F.when(F.col(key).isNull(), F.lit(NULL_SALTS)).otherwise(F.coalesce("_salts", F.lit(1)))
    req = (reqs.join(hot, key, "left")
           .withColumn("_salt", F.pmod(row, salts).cast("int")).drop("_salts"))
    return req.join(res, [key, "_salt"], "left").drop("_salt")
