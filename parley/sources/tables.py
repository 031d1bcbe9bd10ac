"""Table scans with declared schemas.

Reading with an explicit schema skips inference and lets Catalyst prune
columns and push filters into the parquet scan (``ReadSchema`` /
``PushedFilters`` in the plan).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.session import cut_lineage

SCHEMAS = {
    "conversations": T.StructType([
        T.StructField("conv_id", T.LongType()),
        T.StructField("turn", T.LongType()),
        T.StructField("role", T.StringType()),
        T.StructField("text", T.StringType()),
    ]),
    "documents": T.StructType([
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]),
    "labels": T.StructType([
        T.StructField("doc_id", T.LongType()),
        T.StructField("quality", T.IntegerType()),
        T.StructField("toxic", T.IntegerType()),
    ]),
    "benchmark": T.StructType([
        T.StructField("item_id", T.LongType()),
        T.StructField("text", T.StringType()),
    ]),
}

# Nested negative-corpus row: a dialogue as a list of {from, value} turns.
NESTED_DIALOGUE = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("conversations", T.ArrayType(T.StructType([
        T.StructField("from", T.StringType()),
        T.StructField("value", T.StringType()),
    ]))),
])


def read_dialogues(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nested dialogues of JSON-lines files, by the declared schema: (the dialogues; the
    lines that aren't one, as ``file, line``). A line that isn't JSON, or has a field of
    another type, is bad; a missing field is null; blank lines don't count."""
    schema = T.StructType([*NESTED_DIALOGUE.fields, T.StructField("_bad", T.StringType())])
    lines = (spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
             .withColumn("_file", F.col("_metadata.file_path")))
    lines = cut_lineage(lines, "dialogues")             # both halves come from one reading
    return lines.where("_bad IS NULL").drop("_bad", "_file"), lines.where("_bad IS NOT NULL").select(F.col("_file").alias("file"), F.col("_bad").alias("line"))


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def file_versions(spark: SparkSession, sf_dir: str, *names: str) -> list[tuple[str, int, int]]:
    """(path, bytes, modification time) of the tables' files, sorted."""
    out = []
    for name in names:
        path = spark._jvm.org.apache.hadoop.fs.Path(table_path(sf_dir, name))
        files = path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, True)
        while files.hasNext():
            f = files.next()
            out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return sorted(out)


def spread(df: DataFrame) -> DataFrame:
    """Round-robin a scan that yields fewer splits than twice the cluster's
    cores (e.g. one large single-row-group file) so heavy per-row text work
    (tokenising, regex rewriting) is not stuck in a few tasks. Used only in
    front of such work; large inputs already have thousands of splits and are
    left untouched. Filters and column pruning still reach the scan."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < 2 * cores:
        return df.repartition(2 * cores)
    return df


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reader = spark.read
    if name in SCHEMAS:
        reader = reader.schema(SCHEMAS[name])
    return reader.parquet(table_path(sf_dir, name))


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "conversations")


def documents(spark: SparkSession, sf_dir: str, spread_rows: bool = False) -> DataFrame:
    d = read_table(spark, sf_dir, "documents")
    return spread(d) if spread_rows else d


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "labels")
