"""Queries: tokens, windows, BIO encode/decode, scoring (W1-W7, W13, W14,
F5, A10, A11, A24, M1)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from spanlab import schemas
from spanlab.operators import bio, corpus, documents as dc, splits
from spanlab.operators import tokens as tok
from spanlab.plans import testviews as tv
from spanlab.plans.catalogue import query
from spanlab.plans.oracle import _tag_case, bucket, register
from spanlab.session import keep

# Window geometry of the window queries: our tokenizer emits no special
# tokens, so a 512 window holds 512 tokens and consecutive windows share 256.
MAX_LEN, STRIDE, SPECIALS = 512, 256, 0
CONTENT, STEP = tok.window_geometry(MAX_LEN, STRIDE, SPECIALS)
# Truncation limit of the baseline (2 specials in a 512 window).
TRUNC_LEN, TRUNC_SPECIALS = 512, 2


@query("tokenize", "SELECT doc_id, i, s, e, w FROM v_tokens")
def q_tokenize(spark, sf):
    return tv.tokens(spark, sf)


@query("truncate", f"""
SELECT doc_id, count(*) AS n_kept, max(e) AS last_char FROM v_tokens
WHERE i < {TRUNC_LEN - TRUNC_SPECIALS} GROUP BY doc_id""")
def q_truncate(spark, sf):
    t = tok.truncate(tv.tokens(spark, sf), TRUNC_LEN, TRUNC_SPECIALS)
    return t.groupBy("doc_id").agg(F.count("*").alias("n_kept"), F.max("e").alias("last_char"))


@query("decode_bio", """
SELECT doc_id, ord, start, "end", label, score, n_tokens, text FROM v_pred_text""")
def q_decode_bio(spark, sf):
    ents = tv.entities(spark, sf, [("m1", 20)], gold=False, text=True)
    return ents.select("doc_id", "ord", "start", "end", "label", "score",
                                         "n_tokens", "text")


@query("window_counts", rf"""
SELECT doc_id, n_tokens,
       CASE WHEN n_tokens <= {CONTENT} THEN 1
            ELSE 1 + ceil((n_tokens - {CONTENT}) / {STEP}.0)::INTEGER END AS n_chunks
FROM (SELECT doc_id, len(regexp_extract_all(text, '([^@BLANK@]+)', 1))::INTEGER AS n_tokens
      FROM documents)""")
def q_window_counts(spark, sf):
    c = tok.token_counts(tv.table(spark, sf, "documents"))
    return c.withColumn("n_chunks", tok.n_chunks_expr("n_tokens", CONTENT, STEP))


register("o_doc_n", """o_doc_n AS (
  SELECT doc_id, count(*) AS n FROM v_tokens GROUP BY doc_id)""")
register("o_chunks", f"""o_chunks AS (
  SELECT doc_id, n, c AS chunk, (c * {STEP})::INTEGER AS first_i,
         (least(c * {STEP} + {CONTENT}, n) - 1)::INTEGER AS last_i
  FROM (SELECT doc_id, n, unnest(range(0, CASE WHEN n <= {CONTENT} THEN 1
                 ELSE 1 + ceil((n - {CONTENT}) / {STEP}.0)::INTEGER END)) AS c
        FROM o_doc_n))""")
register("o_win_tokens", f"""o_win_tokens AS (
  SELECT t.doc_id, c.chunk, (t.i - c.chunk * {STEP})::INTEGER AS j, t.i, t.s, t.e, t.w,
         (c.chunk > 0 AND t.i < (c.chunk - 1) * {STEP} + {CONTENT}) AS overlap
  FROM v_tokens t JOIN o_chunks c ON c.doc_id = t.doc_id
   AND t.i BETWEEN c.first_i AND c.last_i)""")


@query("windows", f"""
SELECT c.doc_id, c.chunk::INTEGER AS chunk, c.first_i, c.last_i,
       (c.last_i - c.first_i + 1)::BIGINT AS n_tokens,
       f.s AS start_char, l.e AS end_char,
       CASE WHEN c.chunk = 0 THEN 0
            ELSE least(c.last_i, (c.chunk - 1) * {STEP} + {CONTENT} - 1) - c.first_i + 1
       END::BIGINT AS n_overlap
FROM o_chunks c
JOIN v_tokens f ON f.doc_id = c.doc_id AND f.i = c.first_i
JOIN v_tokens l ON l.doc_id = c.doc_id AND l.i = c.last_i""")
def q_windows(spark, sf):
    return tok.windows(tv.tokens(spark, sf), MAX_LEN, STRIDE, SPECIALS)


# ---- gold spans from the annotation CSV image, keyed back to doc_id --------

def gold_spans(spark, sf):
    """Cleaned CSV annotations as spans ``(doc_id, ord, start, end, label)``."""
    c = corpus.clean(tv.ann_csv(spark, sf))
    return c.select(
        F.regexp_extract("doc_name", r"^doc_(\d+)", 1).cast("long").alias("doc_id"),
        F.regexp_extract("id", r"(\d+)$", 1).cast("long").alias("ord"),
        F.col("span_start").alias("start"), F.col("span_end").alias("end"), "label")


register("o_clean", r"""o_clean AS (
  SELECT regexp_replace(doc_name, '@TRIM@', '', 'g') AS doc_name, id,
         regexp_replace(label, '@TRIM@', '', 'g') AS label,
         regexp_replace(code, '@TRIM@', '', 'g') AS code,
         regexp_replace(content, '@TRIM@', '', 'g') AS content,
         TRY_CAST(sp[1] AS INTEGER) AS span_start, TRY_CAST(sp[-1] AS INTEGER) AS span_end
  FROM (SELECT *, string_split_regex(regexp_replace(full_span, '@TRIM@', '', 'g'),
                                     '[; \t]+') AS sp FROM v_ann_csv))""")
register("o_spans", r"""o_spans AS (
  SELECT regexp_extract(doc_name, '^doc_(\d+)', 1)::BIGINT AS doc_id,
         regexp_extract(id, '(\d+)$', 1)::BIGINT AS ord,
         span_start AS start, span_end AS "end", label
  FROM o_clean)""")
register("o_dedupe", """o_dedupe AS (
  SELECT doc_id, start, "end", min(ord) AS ord, arg_max(label, ord) AS label
  FROM o_spans GROUP BY doc_id, start, "end")""")
register("o_align", """o_align AS (
  SELECT t.doc_id, t.i, t.s, t.e, t.w,
         CASE WHEN m.ord IS NULL THEN 'O'
              WHEN t.i = min(t.i) OVER (PARTITION BY t.doc_id, m.ord) THEN 'B-' || m.label
              ELSE 'I-' || m.label END AS tag
  FROM v_tokens t
  LEFT JOIN (SELECT t.doc_id, t.i, min(d.ord) AS ord, arg_min(d.label, d.ord) AS label
             FROM v_tokens t JOIN o_dedupe d ON d.doc_id = t.doc_id
              AND t.s >= d.start AND t.e <= d."end"
             GROUP BY t.doc_id, t.i) m ON m.doc_id = t.doc_id AND m.i = t.i)""")


def aligned(spark, sf):
    return dc.align(tv.docs(spark, sf), bio.dedupe_spans(gold_spans(spark, sf)))


@query("gold_dedupe", """SELECT doc_id, start, "end", ord, label FROM o_dedupe""")
def q_gold_dedupe(spark, sf):
    return bio.dedupe_spans(gold_spans(spark, sf))


@query("align_bio", "SELECT doc_id, i, s, e, w, tag FROM o_align")
def q_align_bio(spark, sf):
    return aligned(spark, sf).drop("span_ord")


def labelled_windows(spark, sf, extra=None, names=(), words=True):
    """Windows of the documents with their gold tags as arrays."""
    return dc.labelled_windows(tv.docs(spark, sf), bio.dedupe_spans(gold_spans(spark, sf)), MAX_LEN, STRIDE, SPECIALS,
                               extra, names, words)


def labelled_arrays(spark, sf):
    """Windows with tokens and label ids: ``(doc_id, chunk, tokens, labels)``."""
    return labelled_windows(spark, sf).select(
        "doc_id", "chunk", "tokens", F.transform("tags", bio.label_id_expr).alias("labels"))


register("o_win_labels", f"""o_win_labels AS (
  SELECT w.doc_id, w.chunk, w.j, w.i, w.overlap,
         CASE WHEN a.tag LIKE 'B-%' AND w.chunk <> greatest(0, floor((w.i - {CONTENT}) / {STEP}.0)::INTEGER + 1)
              THEN 'I-' || substr(a.tag, 3) ELSE a.tag END AS tag
  FROM o_win_tokens w JOIN o_align a ON a.doc_id = w.doc_id AND a.i = w.i)""")


@query("overlap_mask", """
SELECT doc_id, chunk::INTEGER AS chunk, count(*) FILTER (WHERE overlap) AS n_ignored,
       count(*) FILTER (WHERE NOT overlap AND tag <> 'O') AS n_entity_tokens,
       count(*) FILTER (WHERE NOT overlap AND tag LIKE 'B-%') AS n_begin,
       count(*) FILTER (WHERE tag LIKE 'B-%') AS n_begin_unmasked
FROM o_win_labels GROUP BY doc_id, chunk""")
def q_overlap_mask(spark, sf):
    wl = labelled_windows(spark, sf, words=False)
    count = lambda array, test: F.size(F.filter(array, test)).cast("long")
    # the overlap leads the window
    wl = wl.withColumn("own", F.slice("tags", F.col("n_overlap").cast("int") + 1, F.greatest(F.size("tags"), F.lit(1))))
    return wl.select(
        "doc_id", "chunk", F.col("n_overlap").alias("n_ignored"),
        count("own", lambda t: t != "O").alias("n_entity_tokens"),
        count("own", lambda t: t.startswith("B-")).alias("n_begin"),
        count("tags", lambda t: t.startswith("B-")).alias("n_begin_unmasked"))


@query("window_pad", f"""
SELECT doc_id, chunk::INTEGER AS chunk, {MAX_LEN} AS n_positions, count(*)::INTEGER AS n_real,
       ({MAX_LEN} - count(*))::INTEGER AS n_pad,
       (sum(CASE WHEN tag = 'O' THEN 0 ELSE 1 END) + {MAX_LEN} - count(*))::INTEGER AS n_nonzero_label,
       ({MAX_LEN} - count(*))::INTEGER AS n_ignored
FROM o_win_labels GROUP BY doc_id, chunk""")
def q_window_pad(spark, sf):
    p = tok.pad_windows(labelled_arrays(spark, sf), MAX_LEN)
    return p.select(
        "doc_id", "chunk",
        F.size("tokens").alias("n_positions"),
        F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).alias("n_real"),
        F.size(F.filter("attention_mask", lambda x: x == 0)).alias("n_pad"),
        F.size(F.filter("labels", lambda x: x != 0)).alias("n_nonzero_label"),
        F.size(F.filter("labels", lambda x: x == schemas.IGNORE_INDEX)).alias("n_ignored"))


_PAD = f"({MAX_LEN} - count(*))"
_LABEL_ID = "(list_position([" + ", ".join(f"'{x}'" for x in schemas.LABELS) + "], l.tag) - 1)::VARCHAR"


@query("window_contents", f"""
SELECT doc_id, chunk::INTEGER AS chunk,
       md5(string_agg(w.w, ' ' ORDER BY w.j) || repeat(' ', {_PAD}::INTEGER)) AS words_md5,
       md5(string_agg(w.s::VARCHAR || '-' || w.e::VARCHAR, ',' ORDER BY w.j) || repeat(',0-0', {_PAD}::INTEGER))
         AS offsets_md5,
       md5(string_agg({_LABEL_ID}, ',' ORDER BY w.j) || repeat(',{schemas.IGNORE_INDEX}', {_PAD}::INTEGER)) AS labels_md5,
       md5(repeat('1', count(*)::INTEGER) || repeat('0', {_PAD}::INTEGER)) AS mask_md5
FROM o_win_tokens w JOIN o_win_labels l USING (doc_id, chunk, j) GROUP BY doc_id, chunk""")
def q_window_contents(spark, sf):
    """Digests of the padded arrays themselves."""
    p = tok.pad_windows(labelled_arrays(spark, sf), MAX_LEN)
    text = lambda sep, array: F.md5(F.array_join(array, sep))
    return p.select(
        "doc_id", "chunk",
        text(" ", F.transform("tokens", lambda x: x["w"])).alias("words_md5"),
        text(",", F.transform("tokens", lambda x: F.concat_ws("-", x["s"], x["e"]))).alias("offsets_md5"),
        text(",", F.col("labels").cast("array<string>")).alias("labels_md5"),
        text("", F.col("attention_mask").cast("array<string>")).alias("mask_md5"))


# ---- window predictions and their merge (W7) -------------------------------

def disagree(tag):
    """A token's m1 tag, re-tagged in ~10% of (window, token) positions so that overlapping
    windows disagree (needs doc_id, s, chunk and w)."""
    from spanlab.functions.text import md5_bucket
    key = F.concat(F.col("doc_id").cast("string"), F.lit("/"), F.col("s").cast("string"),
                   F.lit("/"), F.col("chunk").cast("string"), F.lit("w"))
    alt = tv.tag_from_bucket(md5_bucket(F.concat("w", F.lit("x"))))
    return F.when(md5_bucket(key) < 10, alt).otherwise(tag)


def disagreeing(keys, t, tags, at, chunk):
    """:func:`disagree` for the places of a batch of documents (token ``at`` in window ``chunk``)."""
    names = [None if k is None else f"{k}/" for k in keys.to_pylist()]
    known = np.array([n is not None for n in names], bool)[t.doc[at]] if len(names) else np.zeros(0, bool)
    noisy = np.zeros(len(at), bool)
    noisy[known] = tv._buckets([f"{names[d]}{s}/{c}w".encode() for d, s, c in zip(
        t.doc[at][known].tolist(), t.s[at][known].tolist(), chunk[known].tolist())]) < 10
    return dc.Tags(np.where(noisy, tv.word_codes(t, "x")[at], tags.codes[at]), tags.names)


def window_preds(spark, sf):
    """Per-window predictions; tags and scores travel with the tokens into the windows."""
    pt = tv.pred_tags_of(tv.gold_tags_of(tv.tokens(spark, sf)), "m1", 20)
    wt = tok.window_tokens(pt, MAX_LEN, STRIDE, SPECIALS)
    return wt.withColumn("tag", disagree(F.col("tag")))


register("o_win_preds", f"""o_win_preds AS (
  SELECT w.doc_id, w.chunk, w.j, p.s, p.e, p.w, p.score,
         CASE WHEN {bucket("w.doc_id::VARCHAR || '/' || p.s::VARCHAR || '/' || w.chunk::VARCHAR || 'w'")} < 10
              THEN {_tag_case(bucket("p.w || 'x'"))}
              ELSE p.tag END AS tag
  FROM o_win_tokens w JOIN v_pred_tags p ON p.doc_id = w.doc_id AND p.i = w.i)""")
register("o_merged", """o_merged AS (
  SELECT doc_id, s, arg_min(e, chunk) AS e, arg_min(tag, chunk) AS tag,
         arg_min(score, chunk) AS score
  FROM o_win_preds GROUP BY doc_id, s)""")


@query("merge_windows", "SELECT doc_id, s, e, tag, score FROM o_merged")
def q_merge_windows(spark, sf):
    return bio.merge_windows(window_preds(spark, sf))


_TAG_OF_ID = ("CASE list_position(logits, list_max(logits)) - 1 "
              + " ".join(f"WHEN {i} THEN '{lbl}'" for i, lbl in schemas.ID2LABEL.items())
              + " END")


@query("softmax_argmax", f"""
SELECT vec_id, (list_position(logits, list_max(logits)) - 1)::INTEGER AS label_id,
       {_TAG_OF_ID} AS tag,
       round(1.0 / list_sum(list_transform(logits, lambda x: exp(x::DOUBLE - list_max(logits)::DOUBLE))), 6)
         AS score
FROM v_logits""")
def q_softmax_argmax(spark, sf):
    lg = tv.logits(spark, sf)
    idx, p = bio.softmax_argmax(F.col("logits"))
    return lg.select("vec_id", idx.alias("label_id"), bio.id_label_expr(idx).alias("tag"),
                     F.round(p, 6).alias("score"))


# ---- class weights (A11) over the train split -------------------------------

def _vocab_sql() -> str:
    rows = ", ".join(f"({i}, '{lbl}')" for i, lbl in schemas.ID2LABEL.items())
    return f"(VALUES {rows}) AS vocab(label_id, label)"


register("o_split_docs", """o_split_docs AS (
  SELECT doc_name, CASE WHEN rk <= floor(n * 0.8::DOUBLE) THEN 'train'
                        WHEN rk <= floor(n * 0.8::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'val'
                        ELSE 'test' END AS split, rk
  FROM (SELECT doc_name, row_number() OVER (ORDER BY md5(doc_name || '42'), doc_name) AS rk,
               count(*) OVER () AS n
        FROM (SELECT DISTINCT doc_name FROM o_clean)))""")
register("o_split", """o_split AS (
  SELECT c.*, d.split FROM o_clean c JOIN o_split_docs d USING (doc_name))""")


register("o_train_counts", """o_train_counts AS (
  SELECT label, count(*) AS n FROM o_split WHERE split = 'train' GROUP BY label)""")


@query("class_weights", f"""
SELECT vocab.label_id::INTEGER AS label_id, vocab.label,
       CASE WHEN vocab.label = 'O' THEN 1.0
            ELSE round(sqrt((SELECT max(n) FROM o_train_counts)::DOUBLE
                            / coalesce(cnt.n, 1)::DOUBLE), 6) END AS weight
FROM {_vocab_sql()}
LEFT JOIN o_train_counts cnt ON cnt.label = substr(vocab.label, 3)""")
def q_class_weights(spark, sf):
    from spanlab.operators.stats import class_weights
    c = keep(corpus.clean(tv.ann_csv(spark, sf)).select("doc_name", "label"))  # documents and rows
    train = splits.exact_split(c).where(F.col("split") == "train")
    return class_weights(train, spark)


# ---- a plugged-in model over windows (M1, W7) --------------------------------

def word_model():
    """A stand-in model: a word's label is the md5 of the word modulo 9, with a lead of 4."""
    import hashlib

    import numpy as np

    def predict(batch):
        out = []
        for words in batch:
            logits = np.zeros((len(words), 9))
            for j, w in enumerate(words):
                logits[j, int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 9] = 4.0
            out.append(logits)
        return out
    return predict


@query("score_windows", f"""
SELECT doc_id, i, s, e, w,
       CASE {bucket("w", 9)} {" ".join(f"WHEN {i} THEN '{lbl}'" for i, lbl in schemas.ID2LABEL.items())} END AS tag,
       round(exp(4.0) / (exp(4.0) + 8.0), 6) AS score
FROM v_tokens""")
def q_score_windows(spark, sf):
    from spanlab.operators.scoring import score_documents
    scored = score_documents(tv.docs(spark, sf), word_model, MAX_LEN, STRIDE, SPECIALS)
    return scored.withColumn("score", F.round("score", 6))


# ---- sequence training (M3) --------------------------------------------------

@query("crf_tagger")
def q_crf_tagger(spark, sf):
    """A conditional random field fitted on the training documents tags the others: gold and best tag, and
    its probability, of every token."""
    from spanlab.operators import crf
    parts = splits.hash_split(tv.gold_tags(spark, sf), "doc_id", method="md5")
    model = crf.fit(parts.where(F.col("split") == "train"))
    rest = parts.where(F.col("split") != "train")
    tagged = crf.scorer(model, MAX_LEN, STRIDE, SPECIALS)(rest.select("doc_id", "i", "s", "e", "w"))
    gold = rest.select("doc_id", "i", "split", F.col("tag").alias("gold_tag"))
    return tagged.join(gold, ["doc_id", "i"]).withColumn("score", F.round("score", 4))
