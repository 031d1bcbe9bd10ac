"""Structured Streaming forms of turn handling.

* ``number_turns_stream`` (stateful): per conversation, state = (epoch, last
  turn number). A clear event raises the epoch and restarts numbering; blank
  turns are skipped. ``applyInPandasWithState`` keyed by conversation; rows of
  one micro-batch are ordered by ``turn``. A micro-batch is bounded by files or bytes
  of the source, which bounds what one key sees at once: its turn and two flags a row.
  It may go on from a batch of earlier events, and forget idle conversations.
* ``score_stream`` (stateless): the model-form classifier is map-only, so the
  stream runs in append mode with no aggregation.
* ``process_stream`` (micro-batch): ``foreachBatch`` runs the batch
  ``process_turns`` (deduplication, joins) per micro-batch and writes each
  batch to its own folder, overwriting on retry — a replayed batch does not
  duplicate rows.
* ``panel_stream`` (micro-batch): keeps the panel views up to date.

Outputs, checkpoints and sinks live under the session's checkpoint folder.
"""

from __future__ import annotations

import os
import uuid

import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from parley.functions.text import is_nonblank
from parley.operators import classifier, route, transcript
from parley.session import checkpoint_dir, cut_lineage
from parley.sources.tables import SCHEMAS
from parley.streaming import panels

NUMBERED = T.StructType([
    T.StructField("conv_id", T.LongType()),
    T.StructField("turn", T.LongType()),
    T.StructField("epoch", T.LongType()),
    T.StructField("turn_no", T.LongType()),
])
STATE = T.StructType([T.StructField("epoch", T.LongType()), T.StructField("last", T.LongType())])


def scratch(spark: SparkSession, what: str) -> str:
    return os.path.join(checkpoint_dir(spark), "streams", f"{what}-{uuid.uuid4().hex[:12]}")


def read_stream(spark: SparkSession, sf_dir: str, table: str = "conversations",
                max_files: int | None = None, max_bytes: int = 1 << 30) -> DataFrame:
    """A stream over ``{table}.parquet``, a file or a folder of part files; a
    missing table fails here instead of giving an empty stream. A micro-batch takes
    ``max_files`` files, or else about ``max_bytes`` of them."""
    reader = spark.readStream.schema(SCHEMAS[table])
    reader = (reader.option("maxFilesPerTrigger", max_files) if max_files
              else reader.option("maxBytesPerTrigger", max_bytes))
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir.rstrip('/')}/{table}.parquet")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.getFileStatus(path).isDirectory():
        return reader.parquet(path.toString())
    return reader.option("pathGlobFilter", f"{table}.parquet").parquet(sf_dir)


def _numbering(idle_ms: int | None):
    """The state function; a conversation without rows for ``idle_ms`` is forgotten."""
    def number(key, pdfs, state):
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({f.name: pd.Series([], dtype="Int64") for f in NUMBERED})
            return
        pdf = pd.concat(list(pdfs), ignore_index=True)
        seeds = pdf["seed_epoch"] >= 0
        epoch, last = state.get if state.exists else (0, 0)
        if seeds.any() and not state.exists:
            epoch, last = (int(pdf.loc[seeds, c].iloc[0]) for c in ("seed_epoch", "seed_last"))
        pdf = pdf[~seeds].sort_values("turn", kind="stable", na_position="last")
        c = pdf["clear"].astype("int64").cumsum()
        ep = epoch + c
        keep = pdf["shown"].astype(bool)
        t = pdf[keep]
        no = t.groupby(ep[keep]).cumcount() + 1 + (c[keep] == 0).astype("int64") * last
        out = pd.DataFrame({"conv_id": t["conv_id"].astype("Int64"), "turn": t["turn"].astype("Int64"),
                            "epoch": ep[keep].astype("int64"), "turn_no": no.astype("int64")})
        new_epoch = int(ep.iloc[-1]) if len(ep) else epoch
        if len(out) and int(out["epoch"].iloc[-1]) == new_epoch:
            new_last = int(out["turn_no"].iloc[-1])
        else:
            new_last = last if new_epoch == epoch else 0
        state.update((new_epoch, new_last))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield out
    return number


def seeds_of(events: DataFrame) -> DataFrame:
    """``conv_id, seed_epoch, seed_last``: where a stream goes on after these events."""
    epochs = events.groupBy("conv_id").agg(F.sum((F.col("kind") == "clear").cast("long")).alias("seed_epoch"))
    last = (transcript.number_turns(events).groupBy(F.col("conv_id").alias("_conv"), F.col("epoch").alias("_epoch"))
            .agg(F.max("turn_no").alias("_last")))
    met = epochs.join(last, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("seed_epoch") == F.col("_epoch")), "left")
    return met.select("conv_id", "seed_epoch", F.coalesce("_last", F.lit(0)).cast("long").alias("seed_last"))


def number_turns_stream(events: DataFrame, after: DataFrame | None = None, idle_ms: int | None = None) -> DataFrame:
    """Numbered turns of a stream of ``events_of`` rows. ``after``, the events of a batch
    that came before, sets the state they start from: its seeds are written once and read
    as a second source, whole, with the first micro-batch. ``idle_ms`` bounds the state by
    the conversations of that time; one that comes back later starts at 1 again."""
    rows = events.withColumns({"seed_epoch": F.lit(-1).cast("long"), "seed_last": F.lit(-1).cast("long")})
    if after is not None:
        seeds = cut_lineage(seeds_of(after), "turn-seeds")
        spark = seeds.sparkSession
        path = seeds.inputFiles()[0].rsplit("/", 1)[0]
        arriving = spark.readStream.schema(seeds.schema).parquet(path)
        none = {"turn": F.lit(None).cast("long"), "clear": F.lit(False), "shown": F.lit(False)}
        rows = rows.unionByName(arriving.withColumns(none))
    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return rows.groupBy("conv_id").applyInPandasWithState(_numbering(idle_ms), NUMBERED, STATE, "append", timeout)


def events_of(stream: DataFrame) -> DataFrame:
    """``conv_id, turn, clear, shown``: the text stays out of the state path."""
    clear = F.coalesce(F.col("role") == "system", F.lit(False))
    return stream.select("conv_id", "turn", clear.alias("clear"), (~clear & is_nonblank(F.col("text"))).alias("shown"))


def run_to_table(stream: DataFrame, spark: SparkSession, what: str) -> DataFrame:
    """Run a stream to completion (availableNow) into parquet; read it back."""
    base = scratch(spark, what)
    q = (stream.writeStream.format("parquet").outputMode("append")
         .option("checkpointLocation", base + "/_checkpoint")
         .trigger(availableNow=True).start(base + "/data"))
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(base + "/data")


def stream_turn_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_to_table(number_turns_stream(events_of(read_stream(spark, sf_dir))), spark,
                        "turn-numbers")


def score_stream(stream: DataFrame, model: PipelineModel) -> DataFrame:
    """Map-only scoring of arriving turns with the model-form classifier."""
    doctor = stream.where(F.col("role") == "assistant")
    return classifier.predict(model, doctor).select("conv_id", "turn", "margin", "medical", "confidence")


def process_stream(spark: SparkSession, sf_dir: str, model: classifier.LinearTextModel) -> DataFrame:
    """Each micro-batch of turns through ``process_turns``; results read back."""
    base = scratch(spark, "process-turns")

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        out = route.process_turns(route.turn_requests(batch), model)
        out.write.mode("overwrite").parquet(f"{base}/data/batch={batch_id}")

    q = (read_stream(spark, sf_dir).writeStream.foreachBatch(per_batch)
         .option("checkpointLocation", base + "/_checkpoint")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(base + "/data").drop("batch")


def panel_stream(stream: DataFrame, model: classifier.LinearTextModel, path: str, buckets: int = panels.BUCKETS) -> None:
    """Keep the panels at ``path`` up to date with arriving turns (``panels.update``);
    runs until what is there is done, and goes on from there when called again."""
    def per_batch(batch: DataFrame, batch_id: int) -> None:
        rows = cut_lineage(batch, "panel-turns")
        processed = route.process_turns(route.turn_requests(rows), model)
        panels.update(path, f"batch-{batch_id}", transcript.chat_events(rows), processed, buckets)

    (stream.writeStream.foreachBatch(per_batch).option("checkpointLocation", f"{path}/_checkpoint")
     .trigger(availableNow=True).start().awaitTermination())
