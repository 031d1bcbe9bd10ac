"""parley — directional message processing on Spark.

Corpus building, TF-IDF features, a linear-SVM domain classifier, gated
plain-language rewriting, batched translation with per-row error capture,
output audits and numbered bilingual transcripts, in batch and streaming.
Everything is DataFrame / SQL / ``pyspark.ml`` code; Python only runs per
Arrow batch inside model backends and the streaming state function.
"""

from parley.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
