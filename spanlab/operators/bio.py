"""BIO tags: decode (W3), encode/align (W4, J9), merge windows (W7),
span de-duplication (W13), softmax/argmax scoring (M1).

Ordered windows keyed on ``doc_id`` (gaps and islands); :mod:`spanlab.operators.automaton`
has the row-local form for lexicon phrases.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanlab import schemas
from spanlab.functions.text import text_slice

# Position bin width (chars) for range joins between tokens and spans.
RANGE_BIN = 64


def start_flag(tag: Column, prev: Column) -> Column:
    """True when a token opens an entity: ``B-x``, or ``I-x`` not continuing an ``x``."""
    same_type = F.substring(prev, 3, 1 << 30) == F.substring(tag, 3, 1 << 30)
    return tag.startswith("B-") | (
        tag.startswith("I-") & (prev.isNull() | (prev == "O") | ~same_type)
    )


def decode(tags: DataFrame, doc_col: str = "doc_id", order_col: str = "s",
           tag_col: str = "tag", score_col: str | None = "score",
           keys: tuple[str, ...] = ()) -> DataFrame:
    """Token tags -> entities
    ``(doc_id, *keys, ord, label, start, end, n_tokens, first_end, last_start[, score])``.

    Gaps and islands: a start flag from ``lag(tag)``, entity number = running
    count of flags, then one aggregate per entity.  ``O`` ends an entity; an
    orphan ``I-`` opens one.  ``score`` is the mean token score rounded to 4
    places (A20).  ``keys`` decode several tag sequences per document in the
    same pass (e.g. gold and prediction, or one per model).
    """
    part = [doc_col, *keys]
    w = Window.partitionBy(*part).orderBy(order_col)
    flagged = tags.withColumn(
        "_flag", start_flag(F.col(tag_col), F.lag(tag_col).over(w)).cast("int"))
    flagged = flagged.withColumn(
        "ord", F.sum("_flag").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    aggs = [
        F.min("s").alias("start"),
        F.max("e").alias("end"),
        F.count("*").alias("n_tokens"),
        F.min_by("e", "s").alias("first_end"),
        F.max("s").alias("last_start"),
    ]
    if score_col is not None:
        aggs.append(F.round(F.avg(score_col), 4).alias("score"))
    # every token of an entity has the same type: grouping by it keeps the
    # groups and leaves only numeric (hash) aggregates
    return (flagged.where(F.col(tag_col) != "O")
            .groupBy(*part, "ord", F.substring(tag_col, 3, 1 << 30).alias("label"))
            .agg(*aggs))


def decode_columns(tags: DataFrame, sides: dict[str, tuple[str, str | None]],
                   doc_col: str = "doc_id", order_col: str = "s") -> DataFrame:
    """W3 for several tag columns of the same tokens in one pass.

    ``sides`` maps a side name to ``(tag column, score column or None)``;
    e.g. gold plus every model's prediction.  One sort on the token order;
    the lag and running-count windows of all columns run in the same Window
    operators; only non-``O`` tokens are exploded to ``(side, ...)`` rows.
    Output as :func:`decode` with ``keys=("side",)``.
    """
    w = Window.partitionBy(doc_col).orderBy(order_col)
    df = tags
    for k, (tc, _) in sides.items():
        df = df.withColumn(f"_f_{k}", start_flag(F.col(tc), F.lag(tc).over(w)).cast("int"))
    for k in sides:
        df = df.withColumn(f"_o_{k}",
                           F.sum(f"_f_{k}").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    items = [F.struct(F.lit(k).alias("side"), F.col(tc).alias("tag"), F.col(f"_o_{k}").alias("ord"),
                      (F.col(sc) if sc else F.lit(None).cast("double")).alias("score"))
             for k, (tc, sc) in sides.items()]
    ex = df.select(doc_col, "s", "e", F.explode(F.array(*items)).alias("_x"))
    ex = ex.where(F.col("_x.tag") != "O")
    return ex.groupBy(doc_col, F.col("_x.side").alias("side"), F.col("_x.ord").alias("ord"),
                      F.substring("_x.tag", 3, 1 << 30).alias("label")).agg(
        F.min("s").alias("start"), F.max("e").alias("end"), F.count("*").alias("n_tokens"),
        F.min_by("e", "s").alias("first_end"), F.max("s").alias("last_start"),
        F.round(F.avg("_x.score"), 4).alias("score"))


def with_text(entities: DataFrame, docs: DataFrame, doc_col: str = "doc_id",
              text_col: str = "text", start: str = "start", end: str = "end",
              out: str = "text") -> DataFrame:
    """Attach the entity surface text, sliced from the document."""
    d = docs.select(F.col(doc_col), F.col(text_col).alias("_doc_text"))
    return (entities.join(d, doc_col, "inner")
            .withColumn(out, text_slice("_doc_text", start, end)).drop("_doc_text"))


def dedupe_spans(spans: DataFrame, doc_col: str = "doc_id", mode: str = "last") -> DataFrame:
    """Dict-style de-duplication of gold spans keyed by ``(start, end)``.

    ``mode="last"``: one row per span key with the label of the last row and the
    ordinal of the first (what a dict keyed by span does); ``"keep"``: as is.
    Input needs ``ord`` (row order), ``start``, ``end``, ``label``.
    """
    if mode == "keep":
        return spans
    if mode != "last":
        raise ValueError("mode must be 'last' or 'keep'")
    # the documents' layout first: this grouping and those of the document's spans need no further shuffle
    from spanlab.operators.tokens import by_document
    return by_document(spans, doc_col).groupBy(doc_col, "start", "end").agg(
        F.min("ord").alias("ord"), F.max_by("label", "ord").alias("label"))


def _bins(start: Column, end: Column) -> Column:
    """Position bins touched by [start, end) (at least one)."""
    lo = F.floor(start / RANGE_BIN).cast("int")
    hi = F.floor(F.greatest(end - 1, start) / RANGE_BIN).cast("int")
    return F.sequence(lo, hi)


def token_span_pairs(tokens: DataFrame, spans: DataFrame, doc_col: str = "doc_id") -> DataFrame:
    """(token, span) pairs with token.s >= span.start and token.e <= span.end.

    Range join by position bins: a span is listed once per 64-char bin it
    touches, a token joins on the bin of its start; the containment test runs
    only on those candidates.  No per-document product.
    """
    sp = spans.select(doc_col, F.col("ord").alias("span_ord"), F.col("start").alias("span_s"),
                      F.col("end").alias("span_e"), F.col("label").alias("span_label"))
    sp = sp.withColumn("_bin", F.explode(_bins(F.col("span_s"), F.col("span_e"))))
    tk = tokens.withColumn("_bin", F.floor(F.col("s") / RANGE_BIN).cast("int"))
    return (tk.join(sp, [doc_col, "_bin"], "inner")
            .where((F.col("s") >= F.col("span_s")) & (F.col("e") <= F.col("span_e")))
            .drop("_bin"))


def align(tokens: DataFrame, spans: DataFrame, doc_col: str = "doc_id") -> DataFrame:
    """BIO tag per token from gold spans.

    A token inside several spans takes the first span in row order (Q13).  The
    first token taken by a span gets ``B-``, later ones ``I-``; tokens in no
    span get ``O``.  Output ``(doc_id, i, s, e, w, tag, span_ord)`` and any further
    columns of ``tokens``.
    """
    pairs = token_span_pairs(tokens, spans, doc_col)
    best = pairs.groupBy(doc_col, "i").agg(
        F.min_by(F.struct("span_ord", "span_label"), "span_ord").alias("_m"))
    best = best.withColumn("_so", F.col("_m.span_ord"))
    first = F.min("i").over(Window.partitionBy(doc_col, "_so"))
    best = best.withColumn("_first_i", first).select(doc_col, "i", "_m", "_first_i")
    rest = [c for c in tokens.columns if c not in (doc_col, "i", "s", "e", "w", "tag", "span_ord")]
    tagged = tokens.join(best, [doc_col, "i"], "left")
    tag = F.when(F.col("_m").isNull(), F.lit("O")).otherwise(
        F.concat(F.when(F.col("i") == F.col("_first_i"), F.lit("B-")).otherwise(F.lit("I-")),
                 F.col("_m.span_label")))
    return tagged.select(doc_col, "i", "s", "e", "w", tag.alias("tag"),
                         F.col("_m.span_ord").alias("span_ord"), *rest)


def window_labels(aligned: DataFrame, max_length: int = 512, stride: int = 256, specials: int = 0,
                  mask: str = "none", doc_col: str = "doc_id") -> DataFrame:
    """W4 over windows + W6: the aligned tokens in their windows, with a label id.

    Tags travel with the tokens into the windows, so nothing is joined back.

    An entity is begun (``B-``) only at its first appearance in (chunk, token)
    order, so a token re-seen in the next window's overlap carries ``I-``
    (Q15).  ``mask="overlap"`` sets overlap positions to the ignore index.
    """
    from spanlab.operators.tokens import window_geometry, window_tokens
    content, step = window_geometry(max_length, stride, specials)
    first_chunk = F.greatest(F.lit(0), F.floor((F.col("i") - F.lit(content)) / F.lit(step)) + 1)
    wt = window_tokens(aligned, max_length, stride, specials, doc_col)
    tag = F.when(F.col("tag").startswith("B-") & (F.col("chunk") != first_chunk),
                 F.concat(F.lit("I-"), F.substring("tag", 3, 1 << 30))).otherwise(F.col("tag"))
    wt = wt.withColumn("tag", tag)
    label_id = label_id_expr(F.col("tag"))
    if mask == "overlap":
        label_id = F.when(F.col("overlap"), F.lit(schemas.IGNORE_INDEX)).otherwise(label_id)
    elif mask != "none":
        raise ValueError("mask must be 'none' or 'overlap'")
    return wt.withColumn("label_id", label_id)


def label_id_expr(tag: Column) -> Column:
    """BIO tag -> label id (literal map, JVM side)."""
    m = F.create_map(*[x for lbl, i in schemas.LABEL2ID.items() for x in (F.lit(lbl), F.lit(i))])
    return m[tag]


def id_label_expr(label_id: Column) -> Column:
    """Label id -> BIO tag."""
    m = F.create_map(*[x for i, lbl in schemas.ID2LABEL.items() for x in (F.lit(i), F.lit(lbl))])
    return m[label_id]


def softmax_argmax(logits: Column) -> tuple[Column, Column]:
    """M1: (argmax index, max probability) of a logits array, numerically stable."""
    mx = F.array_max(logits)
    ex = F.transform(logits, lambda x: F.exp(x.cast("double") - mx.cast("double")))
    total = F.aggregate(ex, F.lit(0.0), lambda acc, x: acc + x)
    idx = (F.array_position(logits, mx) - 1).cast("int")
    return idx, (F.lit(1.0) / total)


def merge_windows(window_preds: DataFrame, doc_col: str = "doc_id") -> DataFrame:
    """One prediction per token start offset -- the earliest window wins.

    Input ``(doc_id, chunk, j, s, e, tag, score)``; output the same without
    ``chunk``/``j``, one row per ``(doc_id, s)``.
    """
    return window_preds.groupBy(doc_col, "s").agg(
        F.min_by(F.struct("e", "tag", "score"), F.struct("chunk", "j")).alias("_p")
    ).select(doc_col, "s", "_p.e", "_p.tag", "_p.score")
