"""Language dimension and the name -> code lookup (equi-join)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.functions import fixed_values as fv
from parley.plans.sizing import broadcast_fixed

LANG_SCHEMA = T.StructType([
    T.StructField("lang_name", T.StringType(), False),
    T.StructField("lang_code", T.StringType(), False),
    T.StructField("script", T.StringType(), False),
    T.StructField("resource", T.StringType(), False),
])


def lang_table(spark: SparkSession) -> DataFrame:
    """Seven rows: the six low-resource languages in interface order, then
    English. A fixed table, so broadcasting it is always safe."""
    rows = [(n, c, s, "low") for n, c, s in fv.LOW_RESOURCE_LANGS]
    rows.append((*fv.HIGH_RESOURCE, "high"))
    return spark.createDataFrame(rows, LANG_SCHEMA)


def doc_lang_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(fv.DOC_LANG_CODES, "lang string, lang_code string")


def patient_language(conv_id: Column) -> Column:
    """Patient language of a test conversation (the tables carry none): the
    interface list taken round-robin by conversation id."""
    names = F.array(*[F.lit(n) for n, _, _ in fv.LOW_RESOURCE_LANGS])
    return F.element_at(names, (F.pmod(conv_id, F.lit(len(fv.LOW_RESOURCE_LANGS))) + 1).cast("int"))


def lookup_codes(df: DataFrame, name_col: str = "lang_name", strict: bool = False) -> DataFrame:
    """Left equi-join of language names to codes against the broadcast 7-row
    table; unknown names get a null code (see ``require_known``), or fail the job as it
    runs if ``strict``."""
    langs = broadcast_fixed(lang_table(df.sparkSession).select("lang_name", "lang_code"),
                            bound=7, what="languages")
    if name_col != "lang_name":
        langs = langs.withColumnRenamed("lang_name", name_col)
    looked = df.join(langs, on=name_col, how="left")
    if strict:
        unknown = F.raise_error(F.concat(F.lit("unknown language name: "), F.coalesce(F.col(name_col), F.lit("null"))))
        looked = looked.withColumn("lang_code", F.coalesce("lang_code", unknown.cast("string")))
    return looked


def unknown_codes(df: DataFrame, code_col: str) -> DataFrame:
    """Left-anti join: rows whose language code is not offered."""
    langs = broadcast_fixed(lang_table(df.sparkSession).select(F.col("lang_code").alias(code_col)),
                            bound=7, what="languages")
    return df.join(langs, on=code_col, how="left_anti")


def require_known(df: DataFrame, name_col: str = "lang_name") -> DataFrame:
    """An unknown language name fails the job (it is not a per-row error).
    Only a handful of offending names reach the driver."""
    looked = lookup_codes(df, name_col)
    bad = [r[0] for r in looked.where(F.col("lang_code").isNull())
           .select(name_col).distinct().limit(5).collect()]
    if bad:
        raise KeyError(f"unknown language name(s): {bad}")
    return looked
