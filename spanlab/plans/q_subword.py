"""Queries: windows of subword tokens as a model reads them, and their labels.

SQL cannot restate a tokenizer; the tests compare with the tokenizer's own overflow windows and
with a plain alignment.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from spanlab import schemas
from spanlab.operators import subword
from spanlab.operators import tokens as tok
from spanlab.plans import testviews as tv
from spanlab.plans.catalogue import query

MAX_LENGTH, STRIDE = 512, 256
VOCABULARY, BEGIN, END, PAD = "word_bpe_49k.json", "<|startoftext|>", "<|endoftext|>", "<|endoftext|>"


def vocabulary(spark) -> subword.Vocabulary:
    import public_tokenizers

    return subword.Vocabulary(spark, public_tokenizers.path(VOCABULARY))


def word_spans(docs):
    """Stand-in annotations ``(doc_id, ord, start, end, label)``: about one word in eight, every third of them
    with the word after it, so that spans overlap; the label follows from its place.  Row-local."""
    labels = sorted({x[2:] for x in schemas.LABELS if x.startswith("B-")})
    words = docs.select("doc_id", tok.piece_arrays(F.col("text")).alias("_w"))
    hit = F.filter(F.transform("_w", lambda w, k: F.struct(
        k.alias("ord"), w["s"].alias("start"),
        F.when(F.pmod(F.xxhash64(w["w"]), F.lit(24)) == 0, F.try_element_at("_w", k + 2)["e"]).otherwise(w["e"]).alias("end"),
        F.pmod(F.xxhash64(w["w"]), F.lit(24)).cast("int").alias("b"))), lambda x: (x["b"] < 3) & x["end"].isNotNull())
    names = F.array(*map(F.lit, labels))
    return words.select("doc_id", F.explode(hit).alias("_x")).select(
        "doc_id", "_x.ord", "_x.start", "_x.end", F.element_at(names, F.col("_x.ord") % len(labels) + 1).alias("label"))


@query("subword_windows")
def q_subword_windows(spark, sf):
    """Every document as windows of 512 ids, 256 shared, with special and padded places; digests of the arrays."""
    win = subword.encode_windows(tv.table(spark, sf, "documents").select("doc_id", "text"), vocabulary(spark),
                                 BEGIN, END, PAD, MAX_LENGTH, STRIDE)
    return win.select("doc_id", "chunk", F.size("tokens").alias("n_tokens"), "n_overlap",
                      F.element_at("offsets", 2)["s"].alias("start_char"),
                      F.xxhash64("input_ids").alias("ids_hash"), F.xxhash64("attention_mask").alias("mask_hash"),
                      F.xxhash64("offsets").alias("offsets_hash"))


@query("subword_labels")
def q_subword_labels(spark, sf):
    """Training windows: label ids of the subwords under the annotated spans; digests of the arrays."""
    docs = tv.table(spark, sf, "documents").select("doc_id", "text")
    win = subword.labelled_windows(docs, word_spans(docs), vocabulary(spark), BEGIN, END, PAD, MAX_LENGTH, STRIDE)
    return win.select("doc_id", "chunk", F.size("tokens").alias("n_tokens"),
                      F.size(F.filter("labels", lambda x: x > 0)).alias("n_entity_tokens"),
                      F.xxhash64("input_ids").alias("ids_hash"), F.xxhash64("labels").alias("labels_hash"))
