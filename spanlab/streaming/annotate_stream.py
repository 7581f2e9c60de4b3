"""Continuous annotation of a document stream.

Ordered windows (tokens, BIO decode) are not allowed on streaming
DataFrames, and documents are independent of each other, so each
micro-batch runs the batch ``annotate`` plan unchanged (``foreachBatch``):
the streamed result equals the batch result by construction.  Exactly-once
output comes from the sink being idempotent per ``batch_id`` (overwrite of
the batch's own partition) together with the query checkpoint, which must
sit in shared storage on a cluster.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spanlab.operators import annotate as an
from spanlab.operators import tokens as tok
from spanlab.session import release


def annotate_stream(stream: DataFrame, scorer: an.Scorer, link_index: DataFrame | None,
                    sink: Callable[[DataFrame, int], None], checkpoint_location: str,
                    fuzzy: bool = True, threshold: float = 0.8, doc_col: str = "doc_id",
                    trigger: dict | None = None, query_name: str | None = None,
                    tokenizer: tok.Tokenizer = tok.tokenize
                    ) -> StreamingQuery:
    """Start a streaming query that annotates every new document.

    ``stream`` is a streaming DataFrame with ``(doc_id, text)``; ``sink(df,
    batch_id)`` writes one annotated micro-batch; ``link_index`` is a static
    DataFrame (stream-static join inside each batch).
    """
    if not stream.isStreaming:
        raise ValueError("annotate_stream needs a streaming DataFrame")

    if link_index is not None:
        link_index = link_index.persist()  # prepared once, read by every batch

    def run(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()  # read by the tagger and for the output
        try:
            out = an.annotate(batch, scorer, link_index, fuzzy, threshold, doc_col, tokenizer)
            sink(out.withColumn("batch_id", F.lit(batch_id)), batch_id)
        finally:
            release()
            batch.unpersist()

    w = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint_location)
    if query_name:
        w = w.queryName(query_name)
    if trigger:
        w = w.trigger(**trigger)
    return w.start()


def parquet_sink(path: str) -> Callable[[DataFrame, int], None]:
    """Idempotent sink: each batch overwrites its own ``batch_id`` partition,
    so a replayed batch after a failure does not duplicate rows."""
    def write(df: DataFrame, batch_id: int) -> None:
        (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("batch_id").parquet(path))
    return write
