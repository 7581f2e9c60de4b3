"""Derived views over the driver's tables (Spark side).

The driver tables hold no annotations, so gold tags, predictions from several
"models", an annotation CSV image, a lexicon and mentions are derived from
them with md5 buckets.  ``spanlab.plans.oracle`` defines the same views in
DuckDB SQL; both must stay in step.
"""

from __future__ import annotations

import hashlib
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlab.functions.text import md5_bucket
from spanlab.operators import documents as dc, tokens as tok
from spanlab.session import keep

# ---------------------------------------------------------------------------
# Fixed values of the test fixtures (our own choice, mirrored in oracle.py).
# Gold tag of a token = first row whose bound exceeds md5_bucket(w || 'g').
TAG_BUCKETS = [
    (6, "B-morphologie"),
    (12, "I-morphologie"),
    (16, "B-topographie"),
    (20, "I-topographie"),
    (21, "B-differenciation"),
    (22, "I-differenciation"),
    (26, "B-expression_CIM"),
    (30, "I-expression_CIM"),
]
# Prediction noise (percent of tokens re-tagged) per model.
MODELS = [("m1", 20), ("m2", 30), ("m3_optimized", 10)]
DEFAULT_MODEL = "m1"
# ---------------------------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def tag_from_bucket(b: Column) -> Column:
    expr = None
    for bound, tag in TAG_BUCKETS:
        expr = (F.when(b < bound, F.lit(tag)) if expr is None
                else expr.when(b < bound, F.lit(tag)))
    return expr.otherwise(F.lit("O"))


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """v_docs, hash partitioned on doc_id (the one shuffle of per-doc plans)."""
    # every 7th document has no-break spaces after its full stops
    text = F.when(F.col("doc_id") % 7 == 3, F.replace("text", F.lit(". "), F.lit(".\u00a0"))).otherwise(F.col("text"))
    d = table(spark, sf_dir, "documents").select(
        "doc_id", text.alias("text"), F.length("text").cast("long").alias("n_chars"), "lang")
    return tok.by_document(d)


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tok.tokenize(docs(spark, sf_dir))


def gold_tags_of(tokens_df: DataFrame) -> DataFrame:
    # bucket in its own column: evaluated once, not once per CASE branch
    b = md5_bucket(F.concat(F.col("w"), F.lit("g")))
    return (tokens_df.withColumn("_b", b).withColumn("tag", tag_from_bucket(F.col("_b")))
            .drop("_b"))


def pred_tags_of(gold_tags: DataFrame, model: str, noise: int) -> DataFrame:
    key = F.concat(F.col("doc_id").cast("string"), F.lit("/"), F.col("s").cast("string"),
                   F.lit("/"), F.lit(model))
    noisy = md5_bucket(F.concat(key, F.lit("p"))) < noise
    alt = tag_from_bucket(F.col("_hb"))
    gold_tags = gold_tags.withColumn("_hb", md5_bucket(F.concat(F.col("w"), F.lit("h"))))
    # dyadic scores (k/256): sums and means are exact, so rounding is stable
    score = F.lit(0.5) + md5_bucket(F.concat(key, F.lit("q")), 128).cast("double") / F.lit(256.0)
    return gold_tags.select(
        "doc_id", "i", "s", "e", "w",
        F.when(noisy, alt).otherwise(F.col("tag")).alias("tag"),
        score.alias("score"),
    )


def gold_tags(spark, sf_dir):
    return gold_tags_of(tokens(spark, sf_dir))


def pred_tags(spark, sf_dir, model: str = DEFAULT_MODEL):
    noise = dict(MODELS)[model]
    return pred_tags_of(gold_tags(spark, sf_dir), model, noise)


def preds_multi_tags(spark, sf_dir) -> DataFrame:
    """Token predictions of all models in one table (``model`` column)."""
    g = gold_tags(spark, sf_dir)
    out = None
    for m, noise in MODELS:
        p = pred_tags_of(g, m, noise).withColumn("model", F.lit(m))
        out = p if out is None else out.unionByName(p)
    return out


def sides_of(gold_tags: DataFrame, models: list[tuple[str, int]] | None = None) -> DataFrame:
    """Gold tags plus one (tag, score) column pair per model, on the same
    token rows (``tag_<model>``, ``score_<model>``)."""
    models = [(DEFAULT_MODEL, dict(MODELS)[DEFAULT_MODEL])] if models is None else models
    g = gold_tags.withColumn("_hb", md5_bucket(F.concat(F.col("w"), F.lit("h"))))
    for m, noise in models:
        key = F.concat(F.col("doc_id").cast("string"), F.lit("/"), F.col("s").cast("string"),
                       F.lit("/"), F.lit(m))
        noisy = md5_bucket(F.concat(key, F.lit("p"))) < noise
        g = g.withColumn(f"tag_{m}", F.when(noisy, tag_from_bucket(F.col("_hb")))
                         .otherwise(F.col("tag")))
        g = g.withColumn(f"score_{m}", F.lit(0.5) + md5_bucket(F.concat(key, F.lit("q")), 128)
                         .cast("double") / F.lit(256.0))
    return g.drop("_hb")


# ---- the same tags inside a document's row ----------------------------------------

TAG_NAMES = [tag for _, tag in TAG_BUCKETS] + ["O"]


def _buckets(values, modulo: int = 100) -> np.ndarray:
    """:func:`md5_bucket` of byte strings."""
    digests = b"".join([hashlib.md5(v, usedforsecurity=False).digest()[:4] for v in values])
    return np.frombuffer(digests, ">u4").astype(np.int64) % modulo


_MD5_SHIFTS = np.repeat([[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]], 4, axis=0).reshape(64)
_MD5_SINES = (np.abs(np.sin(np.arange(1, 65))) * (1 << 32)).astype(np.uint32)
#: Bytes of a message that fills one block of MD5, with its end mark and length.
MD5_BLOCK = 55


def _word_buckets(words: pa.Array, salt: bytes, modulo: int = 100) -> np.ndarray:
    """:func:`md5_bucket` of every word and ``salt``: MD5 of all short words at once, a vector per step."""
    edge = np.frombuffer(words.buffers()[1], np.int32)[words.offset:words.offset + len(words) + 1].astype(np.int64)
    size = np.diff(edge)
    short = np.flatnonzero(size + len(salt) <= MD5_BLOCK)
    out = np.zeros(len(words), np.int64)
    rest = np.flatnonzero(size + len(salt) > MD5_BLOCK)
    out[rest] = _buckets([w.encode() + salt for w in words.take(pa.array(rest)).to_pylist()], modulo)
    if not len(short):
        return out
    n, row = size[short], np.arange(len(short))
    held = np.frombuffer(words.buffers()[2] or b"", np.uint8)
    block = np.zeros((len(short), 64), np.uint8)
    of = np.repeat(row, n)
    place = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    block[of, place] = held[np.repeat(edge[short], n) + place]
    for k, byte in enumerate(salt + b"\x80"):
        block[row, n + k] = byte
    block[:, 56:64] = (8 * (n + len(salt))).astype("<u8").view(np.uint8).reshape(-1, 8)
    m = np.ascontiguousarray(block.view("<u4").T)
    first = [np.full(len(short), x, np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
    a, b, c, d = first
    for i in range(64):
        if i < 16:
            f, g = d ^ (b & (c ^ d)), i
        elif i < 32:
            f, g = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif i < 48:
            f, g = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, g = c ^ (b | ~d), 7 * i % 16
        f = f + a + _MD5_SINES[i] + m[g]
        shift = np.uint32(_MD5_SHIFTS[i])
        a, d, c, b = d, c, b, b + ((f << shift) | (f >> (np.uint32(32) - shift)))
    out[short] = (a + first[0]).byteswap().astype(np.int64) % modulo
    return out


def word_codes(t: dc.Tokens, salt: str) -> np.ndarray:
    """:func:`tag_from_bucket` of every token's word and ``salt``, as places in TAG_NAMES; different words are hashed once."""
    words = t.w.dictionary_encode()
    bucket = _word_buckets(words.dictionary, salt.encode())
    of_word = np.searchsorted([bound for bound, _ in TAG_BUCKETS], bucket, side="right")
    return of_word[words.indices.to_numpy()]


def gold_codes(t: dc.Tokens) -> dc.Tags:
    return dc.Tags(word_codes(t, "g"), TAG_NAMES)


def _places(keys: pa.Array, t: dc.Tokens, tail: str, modulo: int = 100) -> np.ndarray:
    """The bucket of ``doc/s/tail`` for every token; ``modulo`` where the document has no key."""
    names = [None if k is None else f"{k}/" for k in keys.to_pylist()]
    known = np.array([n is not None for n in names], bool)[t.doc] if len(names) else np.zeros(0, bool)
    out = np.full(len(t.doc), modulo)
    out[known] = _buckets([f"{names[d]}{s}/{tail}".encode() for d, s in zip(t.doc[known].tolist(), t.s[known].tolist())], modulo)
    return out


def pred_codes(keys: pa.Array, t: dc.Tokens, gold: dc.Tags, model: str, noise: int, scores: bool = False) -> dc.Tags:
    """The tags of :func:`pred_tags_of` (and its scores)."""
    noisy = _places(keys, t, model + "p") < noise
    codes = np.where(noisy, word_codes(t, "h"), gold.codes)
    score = None
    if scores:
        k = _places(keys, t, model + "q", 128)
        score = np.where(k < 128, 0.5 + k / 256.0, np.nan)
    return dc.Tags(codes, TAG_NAMES, score)


def entities(spark, sf_dir, models: list[tuple[str, int]] | None = None, gold: bool = True, scores: bool = True,
             text: bool = False) -> DataFrame:
    """Decoded gold entities and those of ``models``, in a ``side`` column."""
    return dc.decode(docs(spark, sf_dir), sides(models, gold, scores), text)


def sides(models: list[tuple[str, int]] | None = None, gold: bool = True, scores: bool = False) -> dc.Tagger:
    """The gold tags and those of ``models`` by side."""
    def tags(keys: pa.Array, t: dc.Tokens) -> dict[str, dc.Tags]:
        true = gold_codes(t)
        return ({"gold": true} if gold else {}) | {
            m: pred_codes(keys, t, true, m, noise, scores) for m, noise in models or []}
    return tags


def entities_by_side(spark, sf_dir, models: list[tuple[str, int]] | None = None) -> DataFrame:
    """Decoded gold and predicted entities in one table (``side`` column),
    decoded in one pass and kept: read by every consumer."""
    models = [(DEFAULT_MODEL, dict(MODELS)[DEFAULT_MODEL])] if models is None else models
    return keep(entities(spark, sf_dir, models, scores=False).select(
        "doc_id", "side", "ord", "label", "start", "end"))


def gold(spark, sf_dir) -> DataFrame:
    """v_gold: decoded gold entities ``(doc_id, ord, start, end, label, n_tokens)``."""
    return entities(spark, sf_dir).drop("side", "score")


def pred(spark, sf_dir, model: str = DEFAULT_MODEL) -> DataFrame:
    return entities(spark, sf_dir, [(model, dict(MODELS)[model])], gold=False).drop("side")


def ann_csv(spark, sf_dir) -> DataFrame:
    """v_ann_csv: the gold entities as D1 string rows, with messy cells.

    Every 7th entity of two or more tokens is written as a discontinuous span
    ``"s m;n e"`` (first token end, last token start); some cells are padded
    with blanks/tabs to exercise cleaning.
    """
    g = entities(spark, sf_dir, text=True)
    disc = ((F.col("ord") % 7) == 0) & (F.col("n_tokens") >= 2)
    gap = F.when(disc, F.concat("first_end", F.lit(";"), "last_start"))  # a null is left out between the others
    # written once each: a method of much generated code is not compiled
    padded = lambda by, before, x, after: F.concat(
        F.when(by, before).otherwise(""), x, F.when(by, after).otherwise(""))
    span = padded((F.col("ord") % 5) == 0, " ", F.concat_ws(" ", F.col("start").cast("string"), gap, F.col("end").cast("string")), "\t")
    code = F.concat(F.lit("8"), F.lpad(md5_bucket(F.concat("label", F.lit("|"), "text"), 1000)
                                       .cast("string"), 3, "0"), F.lit("/3"))
    label = padded((F.col("ord") % 3) == 0, " \u00a0", F.col("label"), "")
    content = padded((F.col("ord") % 4) == 0, "\t", F.col("text"), "\u2009 ")
    return g.select(
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".ann")).alias("doc_name"),
        F.concat(F.lit("T"), F.col("ord").cast("string")).alias("id"),
        label.alias("label"),
        code.alias("code"),
        content.alias("content"),
        span.alias("full_span"),
    )


def _span_string(g: DataFrame) -> DataFrame:
    """Add ``sp``: ``"s e"``, or ``"s m;n e"`` for every 7th entity of >= 2 tokens."""
    disc = ((F.col("ord") % 7) == 0) & (F.col("n_tokens") >= 2)
    return g.withColumn("sp", F.when(disc, F.concat_ws(
        " ", F.col("start").cast("string"),
        F.concat(F.col("first_end").cast("string"), F.lit(";"), F.col("last_start").cast("string")),
        F.col("end").cast("string"))).otherwise(
        F.concat_ws(" ", F.col("start").cast("string"), F.col("end").cast("string"))))


def ann_lines(spark, sf_dir) -> DataFrame:
    """v_ann_lines: a standoff image of the gold entities, one row per line.

    Line numbers leave room between entities: ``T`` line at ``10*ord``; its
    code note at ``+1`` (for 70% of entities); a second, later note at ``+2``
    for every 11th (last one wins); a dangling note at ``+3`` for every 13th;
    a malformed ``T`` line at ``+4`` for every 17th; a free ``#`` comment at
    ``+5`` for every 19th; spans of one and of three numbers at ``+6`` and ``+7`` for
    every 23rd and 29th.
    """
    g = entities(spark, sf_dir, text=True)
    g = _span_string(g)
    code = F.concat(F.lit("8"), F.lpad(md5_bucket(F.concat("label", F.lit("|"), "text"), 1000)
                                       .cast("string"), 3, "0"), F.lit("/3"))
    tid = F.concat(F.lit("T"), F.col("ord").cast("string"))
    text = F.regexp_replace("text", r"\s+", " ")
    ln = F.col("ord") * 10
    rows = [
        (ln, F.lit(True), F.concat_ws("\t", tid, F.concat_ws(" ", "label", "sp"), text)),
        (ln + 1, md5_bucket(F.concat(F.lit("n"), "label", "text")) < 70,
         F.concat_ws("\t", F.concat(F.lit("#"), F.col("ord").cast("string")),
                     F.concat(F.lit("AnnotatorNotes "), tid), code)),
        (ln + 2, (F.col("ord") % 11) == 0,
         F.concat_ws("\t", F.concat(F.lit("#"), F.col("ord").cast("string"), F.lit("b")),
                     F.concat(F.lit("AnnotatorNotes "), tid), F.concat(F.lit("X"), code))),
        (ln + 3, (F.col("ord") % 13) == 0,
         F.concat_ws("\t", F.concat(F.lit("#"), F.col("ord").cast("string"), F.lit("d")),
                     F.concat(F.lit("AnnotatorNotes T"), (F.col("ord") + 1000000).cast("string")),
                     code)),
        (ln + 4, (F.col("ord") % 17) == 0,
         F.concat(tid, F.lit("x\tbroken"))),
        (ln + 5, (F.col("ord") % 19) == 0, F.lit("# free comment")),
        (ln + 6, (F.col("ord") % 23) == 0, F.concat(tid, F.lit("y\tmorphologie 12\tone number"))),
        (ln + 7, (F.col("ord") % 29) == 0, F.concat(tid, F.lit("z\tmorphologie 0 5 9\tthree numbers"))),
    ]
    arr = F.filter(F.array(*[F.struct(n.cast("long").alias("line_no"), keep.alias("keep"),
                                      line.alias("line")) for n, keep, line in rows]),
                   lambda x: x["keep"])
    out = g.select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("doc_name"),
                   F.explode(arr).alias("_l"))
    return out.select("doc_name", "_l.line_no", "_l.line")


def lexicon(spark, sf_dir) -> DataFrame:
    """v_lexicon: (label, content, code, ordinal) from ``part``, some keys accented."""
    content = F.when(F.col("p_partkey") % 11 == 0, F.replace("p_name", F.lit("a"), F.lit("à"))).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select(
        F.col("p_type").alias("label"), content.alias("content"),
        F.col("p_brand").alias("code"), F.col("p_partkey").alias("ordinal"))


def mentions(spark, sf_dir) -> DataFrame:
    """v_mentions: part names with one character deleted, BIO-prefixed labels,
    some upper-cased, blank-padded or accented (as their key is, or unlike it)."""
    key = F.col("p_partkey")
    p = table(spark, sf_dir, "part").withColumn("x", F.when(key % 11 == 0, F.replace("p_name", F.lit("a"), F.lit("à")))
                                                .when(key % 13 == 0, F.replace("p_name", F.lit("o"), F.lit("ô")))
                                                .otherwise(F.col("p_name")))
    pos = (key % F.length("x")).cast("int")  # 0-based deleted position
    typo = F.concat(F.substring("x", 1, pos), F.substring("x", pos + 2, 1 << 30))
    text = (F.when((F.col("p_partkey") % 3) == 0, F.upper(typo))
            .when((F.col("p_partkey") % 3) == 1, F.concat(F.lit("  "), typo, F.lit(" ")))
            .otherwise(typo))
    label = F.concat(F.when((F.col("p_partkey") % 2) == 0, F.lit("B-")).otherwise(F.lit("I-")),
                     F.col("p_type"))
    return p.select(F.col("p_partkey").alias("mention_id"), text.alias("text"),
                    label.alias("label"))


def turn_id() -> Column:
    """One id for a conversation and a turn."""
    return F.col("conv_id") * (1 << 32) + F.col("turn")


def msgs(spark, sf_dir) -> DataFrame:
    """v_msgs: a batch of texts (conversation turns) keyed by one id (32 bits for the turn)."""
    c = table(spark, sf_dir, "conversations")
    return tok.by_document(c.select(turn_id().alias("doc_id"), "text"))


def logits(spark, sf_dir) -> DataFrame:
    """v_logits: all embedding floats folded into 9 label logits (value k, k + 9, ... summed)."""
    e = table(spark, sf_dir, "embeddings")
    part = lambda k: F.filter("embedding", lambda x, i: i % 9 == k)
    return e.select("vec_id", F.array(*[
        F.aggregate(part(k), F.lit(0.0), lambda a, x: a + x.cast("double")) for k in range(9)]).alias("logits"))
