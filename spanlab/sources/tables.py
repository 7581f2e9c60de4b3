"""Tabular sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanlab import schemas


_BAD_LINE = "_bad_line"


def _annotation_csv(spark: SparkSession, path: str, multi_line: bool) -> DataFrame:
    schema = T.StructType([*schemas.ANNOTATION_CSV.fields, T.StructField(_BAD_LINE, T.StringType())])
    return (spark.read.schema(schema).option("header", True).option("quote", '"').option("escape", '"')
            .option("multiLine", multi_line).option("mode", "PERMISSIVE")
            .option("columnPruning", False)  # a pruned parser would not notice extra cells
            .option("columnNameOfCorruptRecord", _BAD_LINE).csv(path))


def read_annotation_csv(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Annotation CSV with a header; every column a string (never inferred).

    Rows with too many or too few cells are left to :func:`rejected_csv_lines`.  Line
    breaks inside quoted cells need ``multi_line``, which makes a file one task.
    """
    return _annotation_csv(spark, path, multi_line).where(F.col(_BAD_LINE).isNull()).drop(_BAD_LINE)


def rejected_csv_lines(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """V1: ``(file, line)`` of the CSV rows whose number of cells is wrong."""
    rows = _annotation_csv(spark, path, multi_line)
    # every column is named: Spark refuses a query that names the corrupt column alone
    read = F.length(F.concat_ws("", *[f.name for f in schemas.ANNOTATION_CSV.fields])) >= 0
    return (rows.where(F.col(_BAD_LINE).isNotNull() & read)
            .select(F.input_file_name().alias("file"), F.col(_BAD_LINE).alias("line")))


def texts_frame(spark: SparkSession, texts: list[str]) -> DataFrame:
    """An in-memory batch of texts keyed by input position (small API input)."""
    if not texts:
        raise ValueError("an empty list of texts")
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def write_splits(df: DataFrame, path: str) -> None:
    """One dataset partitioned by ``split`` (readers prune partitions)."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def read_split(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """Read all splits or one (partition pruning on ``split``)."""
    df = spark.read.parquet(path)
    return df if split is None else df.where(F.col("split") == split)


def flatten(df: DataFrame) -> DataFrame:
    """Struct/array columns to strings so that a table can go to CSV."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)):
            cols.append(F.to_json(F.col(f.name)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def write_csv(df: DataFrame, path: str) -> None:
    """Result table as CSV with a header (nested columns as JSON text)."""
    flatten(df).write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """Result rows as JSON lines."""
    df.write.mode("overwrite").json(path)


def write_windows(win: DataFrame, path: str) -> None:
    """Window examples (tokens, attention mask, labels) for a trainer,
    partitioned by split when present."""
    w = win.write.mode("overwrite")
    if "split" in win.columns:
        w = w.partitionBy("split")
    w.parquet(path)
