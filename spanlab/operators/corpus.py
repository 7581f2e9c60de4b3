"""Annotation corpus: cleaning, span parsing, validation, statistics
(C1-C5, C8, C10, V1, V3-V5, A1-A3, A7-A10).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanlab.functions.text import span_envelope, span_list, trim_ws

TEXT_COLUMNS = ("doc_name", "label", "code", "content")


def parse_spans(ann: DataFrame, span_col: str = "full_span") -> DataFrame:
    """C3 + C4 + C5: add ``span_start``/``span_end`` (envelope: first start,
    last end, gap included), ``spans`` (sub-span list) and
    ``is_discontinuous``; bad numbers give nulls, never an exception."""
    start, end = span_envelope(span_col)
    return (ann.withColumn("span_start", start).withColumn("span_end", end)
            .withColumn("spans", span_list(span_col))
            .withColumn("is_discontinuous", F.size("spans") > 1))


def clean(ann: DataFrame, keep_spans: bool = False) -> DataFrame:
    """C1 + C3: strip every text column, parse the span envelope, drop the raw span.

    Output D2: ``doc_name, id, label, code, content, span_start, span_end``.
    """
    out = ann
    for c in TEXT_COLUMNS:
        if c in out.columns:
            out = out.withColumn(c, trim_ws(c))
    out = parse_spans(out)
    drop = ["full_span"] + ([] if keep_spans else ["spans", "is_discontinuous"])
    return out.drop(*drop)


def validity(df: DataFrame) -> DataFrame:
    """V1/V3: reason a cleaned row is unusable (null when valid)."""
    reason = (F.when(F.col("doc_name").isNull() | (F.col("doc_name") == ""), F.lit("no_doc"))
              .when(F.col("span_start").isNull() | F.col("span_end").isNull(), F.lit("bad_span"))
              .when((F.col("span_start") < 0) | (F.col("span_end") < F.col("span_start")),
                    F.lit("bad_range"))
              .when(F.col("label").isNull() | (F.col("label") == ""), F.lit("no_label")))
    return df.withColumn("reject_reason", reason)


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantine rows with ``reject_reason``) -- nothing raises."""
    v = validity(df)
    return (v.where(F.col("reject_reason").isNull()).drop("reject_reason"),
            v.where(F.col("reject_reason").isNotNull()))


def null_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """V5: nulls per column, one row (column, n_null) per column."""
    cols = columns or df.columns
    agg = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    stack = ", ".join(f"'{c}', `{c}`" for c in cols)
    return agg.selectExpr(f"stack({len(cols)}, {stack}) as (column_name, n_null)")


def label_distribution(df: DataFrame, label_col: str = "label") -> DataFrame:
    """A1: count per label and its share of all rows (6 places), most frequent first."""
    counts = df.groupBy(label_col).agg(F.count("*").alias("count"))
    total = F.sum("count").over(Window.partitionBy())  # over <= #labels rows
    return (counts.withColumn("share", F.round(F.col("count") / total, 6))
            .orderBy(F.desc("count"), label_col))  # W10: a row per label


def n_documents(df: DataFrame, doc_col: str = "doc_name", approx: bool = False) -> DataFrame:
    """A2: number of distinct documents (exact, or HyperLogLog++)."""
    f = F.approx_count_distinct if approx else F.count_distinct
    return df.agg(f(doc_col).alias("n_documents"))


def avg_length_by_label(df: DataFrame, label_col: str = "label",
                        content_col: str = "content") -> DataFrame:
    """A3 + C8: mean content length per label (6 places)."""
    return df.groupBy(label_col).agg(
        F.round(F.avg(F.length(content_col)), 6).alias("avg_length"),
        F.count("*").alias("n"))


def doc_length_stats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Document length mean / min / max in chars."""
    n = F.length(text_col)
    return docs.agg(F.count("*").alias("n_docs"), F.round(F.avg(n), 6).alias("mean_chars"),
                    F.min(n).cast("long").alias("min_chars"),
                    F.max(n).cast("long").alias("max_chars"))


def discontinuous_stats(ann: DataFrame) -> DataFrame:
    """Entities and documents with discontinuous spans (raw span strings)."""
    disc = F.col("full_span").contains(";")
    per_doc = ann.groupBy("doc_name").agg(F.count("*").alias("n"),
                                          F.count_if(disc).alias("n_disc"))
    return per_doc.agg(
        F.count("*").alias("n_docs"),
        F.count_if(F.col("n_disc") > 0).alias("n_docs_discontinuous"),
        F.sum("n").alias("n_entities"),
        F.sum("n_disc").alias("n_entities_discontinuous"),
    )


def reconcile(parsed: DataFrame, expected: DataFrame, doc_col: str = "doc_name") -> DataFrame:
    """Per document, parsed vs expected entity counts and their difference.

    Full outer join of two per-document counts; documents missing on one side
    count 0 there.
    """
    a = parsed.groupBy(doc_col).agg(F.count("*").alias("n_parsed"))
    b = expected.groupBy(doc_col).agg(F.count("*").alias("n_expected"))
    j = a.join(b, doc_col, "full_outer")
    return j.select(doc_col, F.coalesce("n_parsed", F.lit(0)).alias("n_parsed"),
                    F.coalesce("n_expected", F.lit(0)).alias("n_expected"),
                    (F.coalesce("n_parsed", F.lit(0)) - F.coalesce("n_expected", F.lit(0)))
                    .alias("diff"))


def long_doc_share(token_counts: DataFrame, limit: int = 512) -> DataFrame:
    """A10: share of documents with more than ``limit`` tokens."""
    return token_counts.agg(
        F.count("*").alias("n_docs"),
        F.count_if(F.col("n_tokens") > limit).alias("n_long"),
        F.round(F.avg((F.col("n_tokens") > limit).cast("int")), 6).alias("share_long"))


def line_types(lines: DataFrame, line_col: str = "line") -> DataFrame:
    """C14: count of standoff lines per first character."""
    return (lines.where(F.length(line_col) > 0)
            .groupBy(F.substring(line_col, 1, 1).alias("line_type")).count())
