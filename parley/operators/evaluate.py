"""Hold-out evaluation: accuracy, macro precision / recall / F1, confusion
matrix and the misclassified listing — one aggregation pass each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions.text import preview


def _safe_div(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def eval_metrics(preds: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    """One row: n, accuracy, macro precision, macro recall, macro F1 (mean of
    the two class F1s); a zero denominator counts as 0."""
    y, p = F.col(label), F.col(pred)

    def cnt(cond):
        return F.sum(F.when(cond, 1).otherwise(0)).cast("long")

    m = preds.agg(F.count(F.lit(1)).alias("n"),
                  cnt((y == 1) & (p == 1)).alias("tp"), cnt((y == 0) & (p == 1)).alias("fp"),
                  cnt((y == 1) & (p == 0)).alias("fn"), cnt((y == 0) & (p == 0)).alias("tn"))
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    p1, r1 = _safe_div(tp, tp + fp), _safe_div(tp, tp + fn)
    p0, r0 = _safe_div(tn, tn + fn), _safe_div(tn, tn + fp)
    m = m.select("n", ((tp + tn) / F.col("n")).alias("accuracy"),
                 p1.alias("p1"), r1.alias("r1"), p0.alias("p0"), r0.alias("r0"))
    f1 = lambda pp, rr: _safe_div(2 * F.col(pp) * F.col(rr), F.col(pp) + F.col(rr))
    return m.select("n", "accuracy",
                    ((F.col("p0") + F.col("p1")) / 2).alias("macro_precision"),
                    ((F.col("r0") + F.col("r1")) / 2).alias("macro_recall"),
                    ((f1("p0", "r0") + f1("p1", "r1")) / 2).alias("macro_f1"))


def confusion(preds: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    """2x2 matrix, rows = actual 0/1, columns pred_0 / pred_1; empty cells are 0."""
    spark = preds.sparkSession
    cells = (preds.groupBy(F.col(label).cast("int").alias("actual"))
             .pivot(pred, [0, 1]).agg(F.count(F.lit(1))))
    actual = spark.createDataFrame([(0,), (1,)], "actual int")
    return (F.broadcast(actual).join(cells, "actual", "left")
            .select("actual", F.coalesce(F.col("0"), F.lit(0)).cast("long").alias("pred_0"),
                    F.coalesce(F.col("1"), F.lit(0)).cast("long").alias("pred_1")))


def misclassified(preds: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    """False positives (0 -> 1) and false negatives (1 -> 0) with a 120-char preview."""
    y, p = F.col(label), F.col(pred)
    return (preds.where(y != p)
            .select("source", "id",
                    F.when(y == 0, F.lit("false_positive")).otherwise(F.lit("false_negative")).alias("kind"),
                    preview(F.col("text")).alias("preview")))
