"""Commits of table folders: whole or not at all, once for each commit id.

A table is a folder with ``data`` (a folder for each write, of any name) and ``_log``
(one small JSON file for each commit, numbered). A write puts its files into a new data
folder first and then adds one log file under the next free number; readers read the log
and the data folders it names, so they see whole commits only, and files of a write that
failed are never read. A commit whose id the log has is not written again: a retried or
replayed write adds nothing. Of two writers that want one number, one finds it taken and
takes the next.

The log file is written under another name and renamed, which object stores without an
atomic rename don't offer: there, one writer at a time.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def entries(spark: SparkSession, path: str) -> list[dict]:
    """The table's commits in their order; none for a table that isn't there."""
    fs, folder = _fs(spark, f"{path}/_log")
    if not fs.exists(folder):
        return []
    names = sorted(s.getPath().getName() for s in fs.listStatus(folder))
    out = []
    for name in names:
        if name.endswith(".json"):
            stream = fs.open(spark._jvm.org.apache.hadoop.fs.Path(folder, name))
            try:
                out.append(json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
            finally:
                stream.close()
    return out


def committed(spark: SparkSession, path: str, commit_id: str) -> bool:
    return any(e["id"] == commit_id for e in entries(spark, path))


def _log(spark: SparkSession, path: str, commit_id: str, entry: dict) -> bool:
    """Add a log entry; False where the id is there already."""
    fs, folder = _fs(spark, f"{path}/_log")
    fs.mkdirs(folder)
    hidden = spark._jvm.org.apache.hadoop.fs.Path(folder, f".{uuid.uuid4().hex}.tmp")
    stream = fs.create(hidden, False)
    stream.write(bytearray(json.dumps({"id": commit_id, **entry}).encode("utf-8")))
    stream.close()
    while True:
        found = entries(spark, path)
        if any(e["id"] == commit_id for e in found):
            fs.delete(hidden, False)
            return False
        target = spark._jvm.org.apache.hadoop.fs.Path(folder, f"{len(found):012d}.json")
        if not fs.exists(target) and fs.rename(hidden, target):
            return True


def new_folder(path: str) -> str:
    return f"{path}/data/{uuid.uuid4().hex}"


def commit(df: DataFrame, path: str, commit_id: str, partition_by: str | None = None, **entry) -> bool:
    """Write ``df`` as one commit; False (and nothing written) where the id is there already."""
    spark = df.sparkSession
    if committed(spark, path, commit_id):
        return False
    folder = new_folder(path)
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    writer.parquet(folder)
    return _log(spark, path, commit_id, {"folder": folder.rsplit("/", 1)[1], **entry})


def publish(spark: SparkSession, path: str, folder: str) -> None:
    """Commit a data folder that was written before, under its own name."""
    name = folder.rsplit("/", 1)[1]
    _log(spark, path, name, {"folder": name})


def folders(spark: SparkSession, path: str) -> list[str]:
    """Data folders of all commits."""
    return [f"{path}/data/{e['folder']}" for e in entries(spark, path)]


def read(spark: SparkSession, path: str, schema) -> DataFrame:
    """All commits' rows."""
    found = folders(spark, path)
    if not found:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*found)
