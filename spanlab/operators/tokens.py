"""Tokens and sliding windows.

The tokenizer is row-local; windows are per document.  Callers that run several per-document
operators should hash partition the documents on ``doc_id`` once
(:func:`by_document`); every window/aggregate below is keyed on ``doc_id`` and
reuses that layout instead of shuffling the (much larger) token table.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanlab import schemas
from spanlab.functions.text import BLANK

#: W1 plug-in: (documents, document column) -> (doc, i, s, e, w).
Tokenizer = Callable[[DataFrame, str], DataFrame]
#: Input bytes of one task of a per-document plan.
DOCUMENT_BYTES = 32 << 20
#: Bytes of text that :func:`pieces` cuts at once.
CUT_BYTES = 1 << 20
_PIECES = T.ArrayType(T.StructType([T.StructField("s", T.IntegerType()), T.StructField("e", T.IntegerType()),
                                    T.StructField("w", T.StringType())]))


def by_document(docs: DataFrame, doc_col: str = "doc_id",
                num_partitions: int | None = None) -> DataFrame:
    """Hash partition documents on their key (the one shuffle of a plan).

    The partition count is explicit, so that AQE does not coalesce it: the document
    shuffle is small in bytes, but the token work after it is large.  It is the
    session's ``spark.sql.shuffle.partitions``, or more where the estimated input
    exceeds DOCUMENT_BYTES a partition.
    """
    if num_partitions is None:
        num_partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        if size < 1 << 60:  # a source without statistics says Long.MaxValue
            num_partitions = max(num_partitions, -(-size // DOCUMENT_BYTES))
    return docs.repartition(num_partitions, doc_col)


def _blank_table() -> np.ndarray:
    table = np.zeros(0x3002, bool)  # the last entry stands for everything above
    for c in (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
              0x2028, 0x2029, 0x202F, 0x205F, 0x3000):
        table[c] = True
    return table


def pieces(texts: pa.Array) -> pa.Array:
    """Non-blank runs of every text with code point offsets, vectorised over the batch.

    Some CUT_BYTES are cut at a time: the working arrays take many times the bytes of their texts.
    """
    stops = np.cumsum(np.asarray(pc.binary_length(texts).fill_null(0), np.int64))
    edges = [0, *(np.flatnonzero(np.diff(stops // CUT_BYTES)) + 1).tolist(), len(texts)]
    parts = [_pieces_of(texts.slice(a, b - a)) for a, b in zip(edges, edges[1:]) if a < b]
    return pa.concat_arrays(parts) if len(parts) > 1 else parts[0] if parts else _pieces_of(texts)


def _pieces_of(texts: pa.Array) -> pa.Array:
    strings = [t or "" for t in texts.to_pylist()]
    joined = "".join(strings)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    ends = np.cumsum([len(t) for t in strings], dtype=np.int64)
    starts = ends - np.array([len(t) for t in strings], np.int64)
    word = ~_blank_table()[np.minimum(points, 0x3001)]
    opens, closes = word.copy(), word.copy()
    opens[1:] &= ~word[:-1]
    closes[:-1] &= ~word[1:]
    # a run ends with its text
    edge = ends[(ends > 0) & (ends < len(points))]
    opens[edge] |= word[edge]
    closes[edge - 1] |= word[edge - 1]
    s, e = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    of = np.searchsorted(ends, s, side="right")
    width = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
    byte = np.concatenate([[0], np.cumsum(np.where(word, width, 0))])
    data = np.frombuffer(joined.encode("utf-8", "surrogatepass"), np.uint8)[np.repeat(word, width)]
    w = pa.LargeStringArray.from_buffers(
        len(s), pa.py_buffer(np.concatenate([byte[s], byte[-1:]]).astype(np.int64).tobytes()),
        pa.py_buffer(data.tobytes())).cast(pa.string())
    items = pa.StructArray.from_arrays(
        [pa.array((s - starts[of]).astype(np.int32)), pa.array((e - starts[of]).astype(np.int32)), w],
        names=["s", "e", "w"])
    counts = np.bincount(of, minlength=len(strings))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), items)


_pieces = F.arrow_udf(pieces, _PIECES)


def piece_arrays(text: Column) -> Column:
    """W1 as a column: the non-blank runs of a text as ``array<struct<s,e,w>>`` (null: empty)."""
    return _pieces(text)


def tokenize(docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text)`` -> ``(doc_id, i, s, e, w)``, one row per non-blank run.

    Row-local: a vectorised Arrow function cuts whole batches of texts, and only
    tokens are exploded.  No shuffle or sort, and rows that share a document key do
    not mix.  ``i`` is the 0-based token index, ``s`` and ``e`` are code point offsets.
    """
    cut = docs.select(F.col(doc_col), F.posexplode(_pieces(F.col(text_col))).alias("i", "_t"))
    return cut.select(F.col(doc_col), "i", F.col("_t.s").alias("s"), F.col("_t.e").alias("e"),
                      F.col("_t.w").alias("w"))


def token_counts(docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Number of tokens per document, computed row-wise (no shuffle)."""
    n = F.size(F.regexp_extract_all(F.col(text_col), F.lit(rf"([^{BLANK}]+)"), 1))
    return docs.select(F.col(doc_col), n.cast("int").alias("n_tokens"))


def truncate(tokens: DataFrame, max_length: int = 512, specials: int = 2) -> DataFrame:
    """keep the tokens that fit in one window of ``max_length``."""
    return tokens.where(F.col("i") < F.lit(max_length - specials))


def window_geometry(max_length: int, stride: int, specials: int) -> tuple[int, int]:
    """(content, step) of a window: content tokens per window, start-to-start step."""
    content = max_length - specials
    step = content - stride
    if content <= 0 or step <= 0:
        raise ValueError("need max_length - specials > stride >= 0")
    return content, step


def n_chunks_expr(n_tokens, content: int, step: int):
    """1 if n <= content else 1 + ceil((n - content) / step)."""
    n = F.col(n_tokens) if isinstance(n_tokens, str) else n_tokens
    return F.when(n <= content, F.lit(1)).otherwise(
        F.lit(1) + F.ceil((n - F.lit(content)) / F.lit(step)).cast("int"))


def window_tokens(tokens: DataFrame, max_length: int = 512, stride: int = 256,
                  specials: int = 0, doc_col: str = "doc_id") -> DataFrame:
    """Every token placed in each overlapping window that holds it.

    Output ``(doc_id, chunk, j, i, s, e, w, overlap)``: ``j`` is the position
    inside the window, ``overlap`` marks tokens already held by the previous
    window (W6); further columns of ``tokens`` (tags) come along.  Each token lands in ``ceil(content/step)`` windows at most;
    the token count per document comes from an un-ordered window on the
    existing ``doc_id`` partitioning.
    """
    content, step = window_geometry(max_length, stride, specials)
    n = F.max("i").over(Window.partitionBy(doc_col)) + 1
    t = tokens.withColumn("_n", n).withColumn("_nc", n_chunks_expr(F.col("_n"), content, step))
    rest = [c for c in tokens.columns if c not in (doc_col, "i", "s", "e", "w")]
    lo = F.greatest(F.lit(0), F.floor((F.col("i") - F.lit(content)) / F.lit(step)) + 1)
    hi = F.least(F.floor(F.col("i") / F.lit(step)), F.col("_nc") - 1)
    return (
        t.withColumn("chunk", F.explode(F.sequence(lo.cast("int"), hi.cast("int"))))
        .select(
            doc_col, "chunk",
            (F.col("i") - F.col("chunk") * step).cast("int").alias("j"),
            "i", "s", "e", "w",
            ((F.col("chunk") > 0) & (F.col("i") < (F.col("chunk") - 1) * step + content))
            .alias("overlap"), *rest,
        )
    )


def windows(tokens: DataFrame, max_length: int = 512, stride: int = 256,
            specials: int = 0, doc_col: str = "doc_id") -> DataFrame:
    """W2+W5: one row per window with its token range and character range."""
    wt = window_tokens(tokens, max_length, stride, specials, doc_col)
    return wt.groupBy(doc_col, "chunk").agg(
        F.min("i").alias("first_i"),
        F.max("i").alias("last_i"),
        F.count("*").alias("n_tokens"),
        F.min("s").alias("start_char"),
        F.max("e").alias("end_char"),
        F.count_if("overlap").alias("n_overlap"),
    )


def window_arrays(window_tokens_df: DataFrame, label_col: str | None = None,
                  doc_col: str = "doc_id") -> DataFrame:
    """One row per window, tokens (and labels) as ordered arrays.

    The group is one window: bounded by ``max_length``.
    """
    fields = [F.col("j"), F.col("s"), F.col("e"), F.col("w")]
    if label_col is not None:
        fields.append(F.col(label_col).alias("label"))
    agg = F.array_sort(F.collect_list(F.struct(*fields)))
    out = window_tokens_df.groupBy(doc_col, "chunk").agg(agg.alias("tokens"))
    cols = [F.col(doc_col), F.col("chunk"),
            F.transform("tokens", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"),
                                                     x["w"].alias("w"))).alias("tokens")]
    if label_col is not None:
        cols.append(F.transform("tokens", lambda x: x["label"]).alias("labels"))
    return out.select(*cols)


def pad_windows(win: DataFrame, max_length: int = 512) -> DataFrame:
    """Pad token/label arrays to ``max_length`` and add the attention mask."""
    k = F.size("tokens")
    out = win.withColumn("_pad", F.greatest(F.lit(max_length) - k, F.lit(0)))
    pad = F.col("_pad")
    pad_token = F.struct(F.lit(0).alias("s"), F.lit(0).alias("e"), F.lit("").alias("w"))
    out = out.withColumn("attention_mask",
                         F.concat(F.array_repeat(F.lit(1), k), F.array_repeat(F.lit(0), pad)))
    out = out.withColumn("tokens", F.concat("tokens", F.array_repeat(pad_token, pad)))
    if "labels" in win.columns:
        out = out.withColumn("labels", F.concat("labels",
                                                F.array_repeat(F.lit(schemas.IGNORE_INDEX), pad)))
    return out.drop("_pad")
