"""Batched model inference with per-row error capture.

A backend is a small object with ``predict(texts, src, tgt) -> list[str]``.
It is created lazily once per Python worker (Spark reuses workers), so an
expensive model loads once and is reused across batches.

``run_backend``:

1. deduplicates the requests on ``(src, tgt, text)`` — a partial aggregate, so
   a text repeated millions of times is collapsed map-side before the shuffle;
2. sorts each partition by language pair, so Arrow batches are (mostly) one
   pair and the backend is called once per pair and batch;
3. calls the backend in ``mapInPandas`` (Arrow batches, bounded by
   ``spark.sql.execution.arrow.maxRecordsPerBatch``); a failing batch is
   halved until its failing rows stand alone, so an error stays with its row;
4. materialises the requests (read twice) and the results in the checkpoint
   folder (inference is the expensive part; a lost executor downstream does
   not re-run it, and the upstream is not computed twice);
5. joins the results back on a digest of the request; the results hold no
   text of it. Keys repeated by very many
   requests are salted (``parley.plans.skew``), so one hot text does not land
   in one join task.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from typing import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.plans.skew import HOT_KEY_ROWS, salted_join_back
from parley.sources import commits

_WORKER_BACKENDS: dict = {}


class Backend:
    """Base class. Subclasses override ``predict`` (and ``check`` if they need
    credentials)."""
    name = "base"
    #: Words of a call, at most (a longer text is alone in its call); None: a whole Arrow batch.
    token_budget: int | None = None

    def check(self) -> None:
        """Validated on the driver before any plan is built."""

    def load(self) -> None:
        """Called once per Python worker before the first batch."""

    def predict(self, texts: list[str], src: str, tgt: str) -> list[str]:
        raise NotImplementedError

    def key(self):
        return (type(self).__name__, tuple(sorted(self.__dict__.items())))


class RemoteBackend(Backend):
    """Plug-in point for a hosted model. Needs a token in the environment;
    without one the job stops before any call, with a message saying so."""
    name = "remote"

    def __init__(self, task: str, model: str):
        self.task, self.model = task, model

    @staticmethod
    def token():
        return os.environ.get("HF_TOKEN") or os.environ.get("HUGGING_FACE_HUB_TOKEN")

    def check(self):
        if not self.token():
            raise RuntimeError(
                f"the 'api' {self.task} backend needs a token in HF_TOKEN or "
                "HUGGING_FACE_HUB_TOKEN; use mode 'local' for the offline backend")

    def predict(self, texts, src, tgt):
        raise RuntimeError(f"no client for the remote {self.task} model is installed")


def _get_worker_backend(backend: Backend) -> Backend:
    k = backend.key()
    b = _WORKER_BACKENDS.get(k)
    if b is None:
        backend.load()
        _WORKER_BACKENDS[k] = b = backend
    return b


def _call(backend: Backend, texts: list[str], src: str, tgt: str):
    """Whole batch first; a failing batch is halved until its failing rows stand alone."""
    try:
        outs = backend.predict(texts, src, tgt)
        return list(outs), [None] * len(texts)
    except Exception as e:  # noqa: BLE001 - the error is the row's data
        if len(texts) == 1:
            return [None], [str(e)]
        half = len(texts) // 2
        left, right = (_call(backend, part, src, tgt) for part in (texts[:half], texts[half:]))
        return left[0] + right[0], left[1] + right[1]


def _batches(backend: Backend, texts: list[str]) -> Iterator[list[str]]:
    """Texts in batches of at most ``backend.token_budget`` words; a longer text is alone."""
    if backend.token_budget is None:
        yield texts
        return
    held, size = [], 0
    for text in texts:
        words = len(text.split())
        if held and size + words > backend.token_budget:
            yield held
            held, size = [], 0
        held.append(text)
        size += words
    if held:
        yield held


def run_backend(reqs: DataFrame, backend: Backend, src: str, tgt: str, text: str,
                out: str, err: str, materialize: bool = True,
                hot_rows: int = HOT_KEY_ROWS, store: str | None = None) -> DataFrame:
    """Append ``out`` (model output) and ``err`` (error text) to every request;
    a request without a text has neither.

    ``store`` names a folder that keeps the answers under their requests' digests, a
    table of commits for each backend: a job that starts again, or any other, asks only
    for what it lacks. Failed requests aren't kept, so they are asked again."""
    backend.check()
    # a digest of the request: JSON leaves a null language out, so null and "" differ
    request = F.to_json(F.struct(F.col(src).alias("s"), F.col(tgt).alias("t"), F.col(text).alias("x")))
    columns = reqs.columns
    reqs = reqs.withColumn("_key", F.when(F.col(text).isNotNull(), F.sha2(request, 256)))
    if materialize:
        # read twice below (deduplication, join back): write the requests once
        # rather than recompute their whole upstream (scoring, rewriting).
        from parley.session import cut_lineage
        reqs = cut_lineage(reqs, "requests")
    distinct = (reqs.where(F.col(text).isNotNull())
                .groupBy("_key", src, tgt, text).agg(F.count(F.lit(1)).alias("_mult"))
                .sortWithinPartitions(src, tgt))
    schema = T.StructType([T.StructField("_key", T.StringType()), T.StructField("_mult", T.LongType()),
                           T.StructField(out, T.StringType()), T.StructField(err, T.StringType())])

    def fn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        b = _get_worker_backend(backend)
        for pdf in batches:
            if pdf.empty:
                continue
            pieces = []
            for (s, t), g in pdf.groupby([src, tgt], sort=False, dropna=False):
                s, t = (None if pd.isna(x) else x for x in (s, t))
                done = [_call(b, part, s, t) for part in _batches(b, g[text].tolist())]
                outs, errs = ([x for d in done for x in d[k]] for k in (0, 1))
                g = g[["_key", "_mult"]].copy()
                g[out] = outs
                g[err] = errs
                pieces.append(g)
            yield pd.concat(pieces, ignore_index=True)

    if store is None:
        results = distinct.mapInPandas(fn, schema)
        if materialize:
            from parley.session import cut_lineage
            results = cut_lineage(results, "inference")
    else:
        results = _with_store(reqs.sparkSession, distinct, lambda d: d.sortWithinPartitions(src, tgt).mapInPandas(fn, schema), out, err,
                              f"{store}/{hashlib.sha256(repr(backend.key()).encode()).hexdigest()[:16]}")
    joined = salted_join_back(reqs, results, "_key", "_mult", hot_rows)
    return joined.select(*columns, out, err)


def _with_store(spark, distinct: DataFrame, ask, out: str, err: str, path: str) -> DataFrame:
    """(_key, _mult, out, err) of the requests, from the store and, for the rest, by ``ask``."""
    from parley.session import cut_lineage
    held = commits.read(spark, path, "digest string, answer string")
    # two jobs may have asked the same at once: one answer each
    held = held.groupBy("digest").agg(F.min("answer").alias("answer"))
    new = cut_lineage(ask(distinct.join(held, F.col("_key") == F.col("digest"), "left_anti")), "inference")
    known = distinct.select("_key", "_mult").join(held, F.col("_key") == F.col("digest")).select(
        "_key", "_mult", F.col("answer").alias(out), F.lit(None).cast("string").alias(err))
    known = cut_lineage(known, "stored-answers")
    fresh = new.where(F.col(err).isNull()).select(F.col("_key").alias("digest"), F.col(out).alias("answer"))
    if not fresh.isEmpty():
        commits.commit(fresh, path, uuid.uuid4().hex)
    return new.unionByName(known)


# -- backend choice -----------------------------------------------------------

def simplify_backend_name(mode) -> F.Column:
    """Rewrite backend: 'local' -> local, anything else -> api."""
    return F.when(mode == "local", F.lit("local")).otherwise(F.lit("api"))


def translate_backend_name(mode) -> F.Column:
    """Translation backend: 'api' -> api, anything else -> local."""
    return F.when(mode == "api", F.lit("api")).otherwise(F.lit("local"))


def resolve_simplify(mode):
    """'local' -> the glossary rewrite (a column expression, no Python);
    a ``Backend`` object -> itself (plug-in); anything else -> the remote
    plug-in."""
    if isinstance(mode, Backend):
        return mode
    if mode == "local":
        return "glossary"
    return RemoteBackend("simplify", "chat-model")


def resolve_translate(mode):
    """'api' -> the remote plug-in; a ``Backend`` object -> itself; anything
    else -> the phrase table (a column expression, no Python)."""
    if isinstance(mode, Backend):
        return mode
    if mode == "api":
        return RemoteBackend("translate", "translation-model")
    return "phrases"
