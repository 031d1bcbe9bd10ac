"""The panel views of a chat, kept up to date batch by batch.

The store is a table of commits (``parley.sources.commits``), its rows dealt over a
fixed number of buckets by their conversation. It holds what a view needs: the clear
events of a conversation, and the turns, processed, since the last of them. A batch
reads the buckets of its conversations, merges its rows (a turn that comes again
replaces itself), and commits these buckets anew; readers take each bucket from the
last commit that wrote it. So a batch rewrites the buckets it touches only, a replayed
batch changes nothing, and a reader never sees half of a batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.operators import transcript
from parley.session import cut_lineage
from parley.sources import commits

BUCKETS = 1024
#: Columns of a processed turn that the views use.
SHOWN = ["original", "translation", "medical", "confidence", "simplified", "error"]
STORE = ("conv_id long, turn long, kind string, speaker string, text string, "
         "original string, translation string, medical boolean, confidence double, simplified string, error string, bucket int")


def _rows(events: DataFrame, processed: DataFrame, buckets: int) -> DataFrame:
    """Events with what became of them; a turn without a result is not shown."""
    p = processed.select(F.col("conv_id").alias("_conv"), F.col("turn").alias("_turn"), *SHOWN)
    both = events.join(p, F.col("conv_id").eqNullSafe(F.col("_conv")) & F.col("turn").eqNullSafe(F.col("_turn"))
                       & (F.col("text") == F.col("original")), "left")
    return both.withColumn("bucket", F.pmod(F.xxhash64("conv_id"), F.lit(buckets)).cast("int")).select(*[c.split()[0] for c in STORE.split(", ")])


def _latest(spark: SparkSession, path: str) -> dict[int, str]:
    """bucket -> folder of the last commit that wrote it."""
    out = {}
    for e in commits.entries(spark, path):
        out.update(dict.fromkeys(e["buckets"], f"{path}/data/{e['folder']}/bucket={{}}"))
    return {b: folder.format(b) for b, folder in out.items()}


def stored(spark: SparkSession, path: str, buckets: list[int] | None = None) -> DataFrame:
    """The store's rows, of some buckets or all."""
    found = _latest(spark, path)
    schema = spark.createDataFrame([], STORE).schema
    parts: dict[str, list[str]] = {}
    for b, folder in found.items():
        if buckets is None or b in buckets:
            parts.setdefault(folder.rsplit("/", 1)[0], []).append(folder)
    out = spark.createDataFrame([], STORE)
    for base, folders in parts.items():                  # at most as many as buckets
        out = out.unionByName(spark.read.schema(schema).option("basePath", base).parquet(*folders))
    return out


def update(path: str, batch_id: str, events: DataFrame, processed: DataFrame, buckets: int = BUCKETS) -> bool:
    """Bring the store up to date with a batch of events and their processed turns."""
    spark = events.sparkSession
    if commits.committed(spark, path, batch_id):
        return False
    new = cut_lineage(_rows(events, processed, buckets), "panel-batch")
    touched = sorted(r[0] for r in new.select("bucket").distinct().collect())      # at most ``buckets``
    names = new.columns
    merged = stored(spark, path, touched).withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    # a row that comes again replaces itself: equal rows are one, the newest result stays
    own = ["conv_id", "turn", "kind", "speaker", "text", "bucket"]
    merged = merged.groupBy(*own).agg(F.max(F.struct("_new", *SHOWN)).alias("_r")).select(*own, "_r.*")
    cleared = merged.where("kind = 'clear'").groupBy(F.col("conv_id").alias("_conv")).agg(F.max("turn").alias("_clear"))
    kept = merged.join(cleared, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").where(
        "kind = 'clear' OR _clear IS NULL OR turn IS NULL OR turn > _clear")
    return commits.commit(kept.select(*names).repartition("bucket"), path, batch_id, "bucket", buckets=touched)


def history(spark: SparkSession, path: str) -> DataFrame:
    """Both panels as the store has them: ``transcript.panel_history`` of all batches."""
    rows = stored(spark, path)
    events = rows.select("conv_id", "turn", "kind", "speaker", "text")
    processed = rows.where("kind = 'turn' AND original IS NOT NULL").select("conv_id", "turn", "speaker", *SHOWN)
    return transcript.panel_history(transcript.transcript(processed, events))
