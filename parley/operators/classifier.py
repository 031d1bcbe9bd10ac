"""Linear text classifier over TF-IDF features.

Two equivalent ways to score:

* model form — a ``PipelineModel`` (SQL tokeniser -> CountVectorizerModel -> IDF
  scaling -> L2 Normalizer -> linear model). Map-only: every row is scored from its own
  terms, whatever its keys, so it also runs inside a plain streaming query.
* table form — explode terms, join the weight table ``(term, idf, coef)``, sum per row;
  for weight tables of any size.

Training fits vocabulary and IDF with aggregations, then a squared-hinge SVM with
balanced class weights and a penalised intercept (``parley.operators.svm``).
"""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LinearSVCModel
from pyspark.ml.common import _py2java
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer, SQLTransformer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions import fixed_values as fv
from parley.functions.text import confidence, is_positive
from parley.operators import features, svm
from parley.operators.corpus import class_weights
from parley.plans.sizing import DEFAULT_BROADCAST_ROWS
from parley.session import cut_lineage
from parley.sources import commits

# Same tokeniser as ``parley.functions.text.terms``, as SQL for SQLTransformer.
TERMS_SQL = (
    "element_at(transform(array(filter(split(lower({col}), '[^\\\\p{{L}}\\\\p{{N}}_]+', -1), "
    "t -> length(t) >= 2)), "
    "u -> concat(u, zip_with(slice(u, 1, greatest(size(u) - 1, 0)), "
    "slice(u, 2, greatest(size(u) - 1, 0)), (a, b) -> concat(a, ' ', b)))), 1)"
)


@dataclass
class LinearTextModel:
    """Weight table ``(term, idf, coef)`` plus intercept; ``n_terms`` bounds the
    table (it is broadcast)."""
    weights: DataFrame
    intercept: float
    n_terms: int

    def pipeline(self) -> PipelineModel:
        """The model form; at most ``n_terms`` rows of weights reach the driver."""
        if not hasattr(self, "_pipeline"):
            if self.n_terms > DEFAULT_BROADCAST_ROWS:
                raise ValueError(f"{self.n_terms} terms don't fit one vector; use margins_joined")
            w = self.weights.select("term", "idf", "coef").orderBy("term").collect()
            self._pipeline = pipeline_of([r["term"] for r in w], [r["idf"] for r in w], [r["coef"] for r in w], self.intercept)
        return self._pipeline


def demo_model(spark: SparkSession) -> LinearTextModel:
    w = spark.createDataFrame(fv.DEMO_WEIGHTS, "term string, idf double, coef double")
    return LinearTextModel(w, fv.DEMO_INTERCEPT, len(fv.DEMO_WEIGHTS))


def score(df: DataFrame, model: LinearTextModel, text_col: str = "text", out: str = "margin") -> DataFrame:
    """Append the signed margin ``sum(tf*idf*coef)/||tf*idf|| + b`` to every row (norm
    over in-vocabulary terms; no known term, also no text -> margin = b). Map-only."""
    row = df.select(F.struct("*").alias("_row"), F.col(text_col).alias("text"))
    raw = vector_to_array(F.col("raw"))[1]
    return model.pipeline().transform(row).select("_row.*", raw.alias(out))


def margins(df: DataFrame, id_cols: list[str], model: LinearTextModel,
            text_col: str = "text", out: str = "margin") -> DataFrame:
    """``ids, margin`` of every row."""
    return score(df.select(*id_cols, F.col(text_col).alias("_text")), model, "_text", out).drop("_text")


def margins_joined(df: DataFrame, id_cols: list[str], model: LinearTextModel,
                   text_col: str = "text", out: str = "margin") -> DataFrame:
    """The same by a join of the terms with the weight table, for tables beyond one
    vector. Rows get a number in a written table (ids may repeat or be null); only
    in-vocabulary pair counts and one sum per row are shuffled."""
    rows = cut_lineage(df.select(*id_cols, F.col(text_col).alias("_text"))
                       .withColumn("_row", F.monotonically_increasing_id()), "scored-rows")
    tc = features.term_counts(rows, ["_row"], "_text", model.weights, model.n_terms)
    x = F.col("tf") * F.col("idf")
    sums = tc.groupBy("_row").agg(F.sum(x * F.col("coef")).alias("_dot"), F.sum(x * x).alias("_sq"))
    margin = F.coalesce(F.col("_dot") / F.sqrt(F.col("_sq")), F.lit(0.0)) + F.lit(float(model.intercept))
    return rows.drop("_text").join(sums, "_row", "left").select(*id_cols, margin.alias(out))


def classify(df: DataFrame, model: LinearTextModel, text_col: str = "text") -> DataFrame:
    """Margin, predicted label (margin > 0) and confidence in [0.5, 1]."""
    s = score(df, model, text_col)
    return s.withColumn("medical", is_positive(F.col("margin"))).withColumn(
        "confidence", confidence(F.col("margin")))


def linear_stage(coefs: list[float], intercept: float) -> LinearSVCModel:
    """The linear model of given coefficients as a pipeline stage."""
    spark = SparkSession.active()
    made = spark._jvm.org.apache.spark.ml.classification.LinearSVCModel(
        f"linear_{uuid.uuid4().hex[:12]}", _py2java(spark.sparkContext, Vectors.dense(coefs)), float(intercept))
    return (LinearSVCModel(made).setFeaturesCol("features").setRawPredictionCol("raw").setPredictionCol("pred_d"))


def pipeline_of(vocab: list[str], idf: list[float], coefs: list[float], intercept: float) -> PipelineModel:
    # a vectorizer needs one term at least; no text has this one
    vocab, idf, coefs = (vocab, idf, coefs) if vocab else ([""], [1.0], [0.0])
    return PipelineModel(stages=feature_stages(vocab, idf) + [linear_stage(coefs, intercept)])


# -- training ---------------------------------------------------------------

def feature_stages(vocab: list[str], idf: list[float], text_col: str = "text") -> list:
    return [
        SQLTransformer(statement=f"SELECT *, {TERMS_SQL.format(col=f"coalesce({text_col}, '')")} AS terms FROM __THIS__"),
        CountVectorizerModel.from_vocabulary(vocab, inputCol="terms", outputCol="tf"),
        ElementwiseProduct(scalingVec=Vectors.dense(idf), inputCol="tf", outputCol="tfidf"),
        Normalizer(p=2.0, inputCol="tfidf", outputCol="features"),
    ]


def train_svm(train: DataFrame, max_features: int = features.MAX_FEATURES,
              max_iter: int = 2000, tol: float = 1e-4, text_col: str = "text",
              label: str = "label"):
    """Fit vocabulary + IDF on ``train`` and a squared-hinge SVM with C = 1 times the
    balanced class weights ``N/(k*n_c)`` and a penalised intercept. Returns
    ``(PipelineModel, LinearTextModel)``."""
    spark = train.sparkSession
    n = train.count()
    vocab, idf = features.fit_vocabulary(train, max_features, text_col, n_docs=n)
    # Two rows (one per class): broadcast is bounded by the number of labels.
    weights = F.broadcast(class_weights(train).select(label, "weight"))
    table = svm.blocks(train.join(weights, label), vocab, idf, text_col, label)
    coefs, intercept, _ = svm.fit(table, len(vocab), max_iter, tol)
    coefs = coefs.tolist()
    weights = spark.createDataFrame(list(zip(vocab, idf, coefs)), "term string, idf double, coef double")
    model = LinearTextModel(weights, intercept, len(vocab))
    return pipeline_of(vocab, idf, coefs, intercept), model


def predict(pipeline_model: PipelineModel, df: DataFrame) -> DataFrame:
    """Model-form scoring (map-only): adds margin, prediction, medical, confidence."""
    out = pipeline_model.transform(df)
    m = vector_to_array("raw")[1]
    return (out.withColumn("margin", m)
            .withColumn("prediction", (m > 0).cast("int"))
            .withColumn("medical", is_positive(m))
            .withColumn("confidence", confidence(m))
            .drop("terms", "tf", "tfidf", "features", "raw", "pred_d"))


# -- model sink / load ------------------------------------------------------

def save_model(pipeline_model: PipelineModel, table: LinearTextModel, path: str) -> None:
    """Add a version to a model folder: the Spark pipeline plus the weight table
    (intercept as a row with a null term), and last the commit that readers go by. A
    load during a save gets the version before, whole."""
    spark = table.weights.sparkSession
    folder = commits.new_folder(path)
    pipeline_model.write().save(f"{folder}/pipeline")
    icpt = spark.createDataFrame([(None, 0.0, table.intercept)], "term string, idf double, coef double")
    table.weights.unionByName(icpt).write.parquet(f"{folder}/weights")
    commits.publish(spark, path, folder)


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel, LinearTextModel]:
    """Load a model folder's last version; a missing one fails with a message telling
    how to train it."""
    versions = commits.folders(spark, path)
    if not versions:
        raise FileNotFoundError(
            f"no trained model at {path}; train one with "
            "parley.operators.classifier.train_svm(...) and save_model(...)")
    w = spark.read.parquet(f"{versions[-1]}/weights")
    icpt = w.where(F.col("term").isNull()).select("coef").first()
    weights = w.where(F.col("term").isNotNull())
    return (PipelineModel.load(f"{versions[-1]}/pipeline"),
            LinearTextModel(weights, float(icpt[0]), weights.count()))


def model_path(spark: SparkSession, name: str) -> str:
    from parley.session import checkpoint_dir
    return os.path.join(checkpoint_dir(spark), "models", name)
