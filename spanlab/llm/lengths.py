"""Token counts as an exact length histogram.

Documents are aggregated by their encoded length; the histogram is as small as the
number of different lengths, whatever the corpus.  Suffix sums over it answer
totals, quantiles and totals truncated at any context limit without the documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanlab.llm import bpe
from spanlab.llm.common import materialise, read

#: Lengths of one bucket of the two-level sums.
BUCKET = 64


def histogram(lengths: DataFrame, column: str = "n_tokens") -> DataFrame:
    """``(length, n_docs)``; rows with a null length are not counted."""
    return (lengths.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("long").alias("length"))
            .agg(F.count("*").alias("n_docs")))


def suffix_sums(hist: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """For every length L of the histogram, as the context limit:

    ``docs_at_least`` and ``tokens_at_least`` (documents of L tokens or more),
    ``docs_up_to``, ``truncated_total`` (tokens if every document is cut at L) and
    ``quantile`` (share of the documents with at most L tokens).

    Buckets of lengths are summed first; a length's suffix is the rest of its bucket
    and all later buckets, so no task sorts the whole histogram.
    """
    hist = hist.withColumn("bucket", F.floor(F.col("length") / bucket))
    sums = hist.groupBy("bucket").agg(F.sum("n_docs").alias("docs"), F.sum(F.col("length") * F.col("n_docs")).alias("tokens"))
    # a row per bucket: bounded by the longest document
    every = Window.orderBy(F.desc("bucket"))
    later = every.rowsBetween(Window.unboundedPreceding, -1)
    whole = every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rest = sums.select("bucket", F.coalesce(F.sum("docs").over(later), F.lit(0)).alias("docs_later"),
                       F.coalesce(F.sum("tokens").over(later), F.lit(0)).alias("tokens_later"),
                       F.sum("docs").over(whole).alias("all_docs"), F.sum("tokens").over(whole).alias("all_tokens"))
    inside = Window.partitionBy("bucket").orderBy(F.desc("length"))
    at_least = (hist.join(rest, "bucket")
                .withColumn("docs_at_least", F.sum("n_docs").over(inside) + F.col("docs_later"))
                .withColumn("tokens_at_least", F.sum(F.col("length") * F.col("n_docs")).over(inside) + F.col("tokens_later")))
    return at_least.select(
        "length", "n_docs", "docs_at_least", "tokens_at_least",
        (F.col("all_docs") - F.col("docs_at_least") + F.col("n_docs")).alias("docs_up_to"),
        (F.col("all_tokens") - F.col("tokens_at_least") + F.col("length") * F.col("docs_at_least")).alias("truncated_total"),
        ((F.col("all_docs") - F.col("docs_at_least") + F.col("n_docs")) / F.col("all_docs")).alias("quantile"))


def truncated_total(sums: DataFrame, limit: int) -> int:
    """Tokens of the corpus if every document is cut at ``limit``."""
    row = sums.where(F.col("length") >= limit).agg(F.max("docs_at_least").alias("d")).first()
    below = sums.where(F.col("length") < limit).agg(F.sum(F.col("length") * F.col("n_docs")).alias("t")).first()
    return (below.t or 0) + limit * (row.d or 0)


def quantile(sums: DataFrame, q: float) -> int | None:
    """Smallest length that at least the share ``q`` of the documents does not exceed."""
    return sums.where(F.col("quantile") >= q).agg(F.min("length").alias("l")).first().l


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per encoded length of ``documents``; a null or empty text has 0 tokens."""
    import public_tokenizers as P

    encoded = bpe.encode(read(spark, sf_dir, "documents").select("doc_id", "text"),
                         P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    return suffix_sums(materialise(histogram(encoded.select(F.size("tokens").alias("n_tokens"))), "lengths"))
