"""Sinks: append-only turn tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from parley.sources import commits


def append_turns(df: DataFrame, path: str, commit_id: str) -> bool:
    """Append processed turns to a turn table as one commit. A commit of an id that the
    table has adds no row, so a retried append doesn't repeat turns; a reader sees
    whole commits alone."""
    return commits.commit(df, path, commit_id)


def read_turns(df_like: DataFrame, path: str) -> DataFrame:
    return commits.read(df_like.sparkSession, path, df_like.schema)
