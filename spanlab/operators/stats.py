"""Training statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanlab import schemas


def vocabulary(spark: SparkSession) -> DataFrame:
    """The BIO label vocabulary as a (label_id, label) table (9 rows)."""
    return spark.createDataFrame(list(schemas.ID2LABEL.items()), "label_id int, label string")


def class_weights(entities: DataFrame, spark: SparkSession, label_col: str = "label") -> DataFrame:
    """Weight per BIO label = sqrt(max_count / count) of its entity type.

    ``O`` keeps 1.0; a type absent from the data counts 1.  The label counts
    are one partial aggregate; the max runs over the few count rows.
    """
    counts = entities.groupBy(F.col(label_col).alias("_type")).agg(F.count("*").alias("_n"))
    counts = counts.withColumn("_max", F.max("_n").over(Window.partitionBy()))
    vocab = vocabulary(spark).withColumn("_type", F.substring("label", 3, 1 << 30))
    # one count row per label present in the data: no broadcast hint (its size
    # is not bounded by the vocabulary); AQE broadcasts it when it measures small
    j = vocab.join(counts, "_type", "left")
    mx = F.max("_max").over(Window.partitionBy())  # spread max to absent labels (9 rows)
    w = F.when(F.col("label") == "O", F.lit(1.0)).otherwise(
        F.round(F.sqrt(mx.cast("double") / F.coalesce("_n", F.lit(1)).cast("double")), 6))
    return j.select("label_id", "label", w.alias("weight"))
