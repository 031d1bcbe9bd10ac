"""Phrase-table translation.

A table of ``(src, tgt, phrase, translation)`` rows; every whole-word phrase of a
text's language pair is replaced (case does not count, leftmost-longest, as in
``parley.operators.rewrite``), other words stay as they are. Texts have no length
limit. A language code outside ``fixed_values.MODEL_CODES`` (null among them) is the
row's error; a row without a text has neither output nor error.

* ``translated`` compiles the table into one map-only column expression a pair;
* ``translate_joined`` joins words to a table of any size on (src, tgt, phrase).

Both give the same texts. Neither is a neural model; one plugs in through
``infer.Backend``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions import fixed_values as fv
from parley.functions.text import let
from parley.operators import rewrite


def phrase_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(fv.phrase_rows(), "src string, tgt string, phrase string, translation string")


def language_error(src: Column, tgt: Column) -> Column:
    """The message of the first unsupported code of the pair, else null."""
    def wrong(code):
        return F.when(~F.coalesce(code.isin(fv.MODEL_CODES), F.lit(False)),
                      F.concat(F.lit("unsupported language "), F.coalesce(code, F.lit("null"))))
    return F.coalesce(wrong(src), wrong(tgt))


def _checked(df: DataFrame, src: str, tgt: str, text: str, out: str, err: str, value: Column) -> DataFrame:
    wrong = F.when(F.col(text).isNotNull(), language_error(F.col(src), F.col(tgt)))
    return df.withColumn(err, wrong).withColumn(out, F.when(F.col(err).isNull(), value))


def translated(df: DataFrame, src: str, tgt: str, text: str, out: str, err: str,
               table: list[tuple[str, str, str, str]] | None = None) -> DataFrame:
    """Append ``out`` and ``err``, map-only; the table's rows must fit one expression
    (``rewrite.MAX_COMPILED_TERMS`` a pair)."""
    pairs: dict = {}
    for s, t, phrase, plain in fv.phrase_rows() if table is None else table:
        pairs.setdefault((s, t), []).append((phrase, plain))
    # one look-up of the row's pair, so the plan's size doesn't follow the number of pairs
    compiled = {pair: rewrite.compile_terms(terms) for pair, terms in sorted(pairs.items())}
    if not compiled:
        return _checked(df, src, tgt, text, out, err, F.col(text))
    pair = F.struct(F.col(src).alias("s"), F.col(tgt).alias("t"))
    key = lambda s, t: F.struct(F.lit(s).alias("s"), F.lit(t).alias("t"))
    patterns = F.create_map(*[x for (s, t), (p, _) in compiled.items() for x in (key(s, t), F.lit(p))])
    maps = F.create_map(*[x for (s, t), (_, m) in compiled.items() for x in (key(s, t), m)])
    row = F.struct(F.try_element_at(patterns, pair).alias("p"), F.try_element_at(maps, pair).alias("m"))
    value = F.coalesce(let(row, lambda r: rewrite.replaced(F.col(text), r["p"], r["m"])["text"]), F.col(text))
    return _checked(df, src, tgt, text, out, err, value)


def translate_joined(df: DataFrame, src: str, tgt: str, text: str, out: str, err: str, table: DataFrame) -> DataFrame:
    """The same by a join on (src, tgt, phrase)."""
    terms = table.select(F.col("src").alias(src), F.col("tgt").alias(tgt),
                         F.col("phrase").alias("term"), F.col("translation").alias("plain"))
    done = rewrite.rewrite_joined(df, text, terms, "_value", on=(src, tgt))
    return _checked(done, src, tgt, text, out, err, F.col("_value")).drop("_value")
