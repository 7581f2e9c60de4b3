"""M3: train a token classifier on BIO-aligned tokens with class weights.

The transformer fine-tuning loop of a single GPU machine is re-aimed as a
distributed ``pyspark.ml`` pipeline: hashed token/context features and a
multinomial logistic regression whose ``weightCol`` is the class weight
(A11).  Training rows are tokens of the training split; the fitted model
scores tokens of any document table (a scorer for ``annotate``).
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanlab.operators import bio


def features(tokens: DataFrame, doc_col: str = "doc_id") -> DataFrame:
    """Per token: word, neighbours and affixes as a bag of feature strings."""
    w = Window.partitionBy(doc_col).orderBy("i")
    lw = F.lower("w")
    return tokens.withColumn("feats", F.array(
        F.concat(F.lit("w="), lw),
        F.concat(F.lit("p="), F.coalesce(F.lower(F.lag("w").over(w)), F.lit("<s>"))),
        F.concat(F.lit("n="), F.coalesce(F.lower(F.lead("w").over(w)), F.lit("</s>"))),
        F.concat(F.lit("s3="), F.substring(lw, -3, 3)),
        F.concat(F.lit("p3="), F.substring(lw, 1, 3)),
        F.concat(F.lit("len="), F.least(F.length("w"), F.lit(12)).cast("string")),
    ))


def fit(aligned: DataFrame, weights: DataFrame, num_features: int = 1 << 18,
        max_iter: int = 30, reg: float = 1e-4, doc_col: str = "doc_id"
        ) -> PipelineModel:
    """Fit on ``aligned`` tokens ``(doc_id, i, w, tag)``; ``weights`` is the
    (label_id, label, weight) table of :func:`spanlab.operators.stats.class_weights`
    (9 rows, broadcast)."""
    data = features(aligned, doc_col).withColumn("label_id", bio.label_id_expr(F.col("tag")))
    data = data.join(F.broadcast(weights.select("label_id", "weight")), "label_id", "left") \
        .withColumn("weight", F.coalesce("weight", F.lit(1.0))) \
        .withColumn("label", F.col("label_id").cast("double"))
    pipe = Pipeline(stages=[
        HashingTF(inputCol="feats", outputCol="features", numFeatures=num_features),
        LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight",
                           family="multinomial", maxIter=max_iter, regParam=reg),
    ])
    return pipe.fit(data)


def scorer(model: PipelineModel, doc_col: str = "doc_id"):
    """Scorer ``tokens -> (doc_id, i, s, e, w, tag, score)`` for ``annotate``."""
    def score(tokens: DataFrame) -> DataFrame:
        p = model.transform(features(tokens, doc_col))
        prob = vector_to_array(F.col("probability"))
        return p.select(doc_col, "i", "s", "e", "w",
                        bio.id_label_expr(F.col("prediction").cast("int")).alias("tag"),
                        F.array_max(prob).alias("score"))
    return score
