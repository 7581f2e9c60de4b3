"""Benchmark decontamination by winnowing.

Words are lower-cased (A-Z only) runs of digits, letters a-z and non-ASCII
characters.  An item's windows are its runs of ``span`` consecutive words, or
the whole item if it has fewer.  A document word is hit if it lies in an
occurrence of a window.

Winnowing (Schleimer, Wilkerson, Aiken, SIGMOD 2003) hashes k-grams of words and
keeps the smallest hash of every sliding window of ``span - k + 1`` k-grams, so
two texts that share ``span`` words share a kept hash.  Items shorter than
``span`` form classes of their own length with their own k and window, which
gives them the same guarantee.  Kept hashes of documents and items are joined;
what they hit is extended to the shared windows word by word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanlab.llm.common import UPPER, materialise, modest_batches, read, row_key, small

SPAN = 10
GRAM = 5
#: Bytes of text that are hashed together.
HELD_BYTES = 1 << 20

#: Fixed: what separates words once A-Z are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_IS_WORD = np.zeros(256, bool)
_IS_WORD[0x30:0x3A] = _IS_WORD[0x61:0x7B] = _IS_WORD[0x80:] = True
_BYTE = np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64) * 2 + 1
_BASE, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_MIX = np.uint64(0xFF51AFD7ED558CCD)


def words(text: str | None) -> list[bytes]:
    """Words of a text as UTF-8."""
    low = _FOLD[np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)]
    low[~_IS_WORD[low]] = 32
    return low.tobytes().split()


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, text it is of); equal words have equal hashes."""
    flat = _FOLD[np.frombuffer(b" ".join(texts) + b" ", np.uint8)]
    is_word = _IS_WORD[flat]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], is_word, [False]]).view(np.int8)))
    first, stop = edge[::2], edge[1::2]
    terms = _BYTE[flat] * _powers(_BASE, len(flat))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
    h = (sums[stop] - sums[first]) * _powers(_BASE_INVERSE, len(flat))[first]
    h ^= h >> np.uint64(32)
    h *= _MIX
    h ^= h >> np.uint64(29)
    ends = np.cumsum([len(t) + 1 for t in texts])
    return h, np.searchsorted(ends, first, side="right")


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key columns..., text) -> (key columns..., n_words)."""
    for batch in batches:
        n = []
        for t in batch.column(batch.num_columns - 1):
            is_word = _IS_WORD[_FOLD[np.frombuffer((t.as_py() or "").encode("utf-8", "surrogatepass"), np.uint8)]]
            n.append(int(np.count_nonzero(is_word[1:] & ~is_word[:-1])) + int(is_word[:1].sum()))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n, pa.int64())],
                                         names=[*batch.schema.names[:-1], "n_words"])


def count_words(texts: DataFrame) -> DataFrame:
    """The columns of ``texts`` with the last one, the text, replaced by n_words."""
    return texts.mapInArrow(_count_words, T.StructType(
        [*texts.schema.fields[:-1], T.StructField("n_words", T.LongType())]))


def winnow(h: np.ndarray, of: np.ndarray, span: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Kept (text, k-gram hash) pairs, distinct: the least hash of every window.

    Texts of fewer words than ``span`` share no span and keep nothing.
    """
    k = min(gram, span)
    w = span - k + 1
    n = len(h) - k + 1
    if n < w:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    g = np.zeros(n, np.uint64)
    for j in range(k):
        g = g * _STEP + h[j:j + n]
    g ^= g >> np.uint64(31)
    g *= _MIX
    least = g[:n - w + 1].copy()
    for j in range(1, w):
        np.minimum(least, g[j:j + n - w + 1], out=least)
    whole = of[:len(least)] == of[span - 1:]  # the window lies in one text
    least, text = least[whole], of[:len(whole)][whole]
    new = np.ones(len(least), bool)
    new[1:] = (least[1:] != least[:-1]) | (text[1:] != text[:-1])
    return text[new], least[new]


def _fingerprints(spans: list[int], gram: int):
    """(key columns..., text) -> (key columns..., span, hash)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.columns[:-1]
            texts = [(t.as_py() or "").encode("utf-8", "surrogatepass") for t in batch.column(batch.num_columns - 1)]
            at = 0
            while at < len(texts):
                stop, held = at, 0
                while stop < len(texts) and (stop == at or held + len(texts[stop]) <= HELD_BYTES):
                    held += len(texts[stop])
                    stop += 1
                h, of = word_hashes(texts[at:stop])
                for span in spans:
                    row, kept = winnow(h, of, span, gram)
                    if len(row):
                        take = pa.array(row + at)
                        yield pa.RecordBatch.from_arrays(
                            [*(c.take(take) for c in keys), pa.array(np.full(len(row), span, np.int32)),
                             pa.array(kept.view(np.int64))], names=[*batch.schema.names[:-1], "span", "h"])
                at = stop
    return run


def occurrences(doc: list[bytes], item: list[bytes], span: int) -> list[tuple[int, int]]:
    """Maximal runs [start, stop) of document words covered by the item's windows."""
    n = min(span, len(item))
    if not n or len(doc) < n:
        return []

    def cut(ws: list[bytes]) -> list[bytes]:
        joined = b" ".join(ws)
        stops = (np.cumsum([len(w) + 1 for w in ws]) - 1).tolist()
        starts = [0, *(s + 1 for s in stops[:-1])]
        return [joined[a:b] for a, b in zip(starts, stops[n - 1:])]

    wanted = set(cut(item))
    runs: list[tuple[int, int]] = []
    for at, window in enumerate(cut(doc)):
        if window in wanted:
            if runs and at <= runs[-1][1]:
                runs[-1] = (runs[-1][0], at + n)
            else:
                runs.append((at, at + n))
    return runs


def _verify(span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, spans, last, doc = [], [], None, []
            texts, items = batch.column(3), batch.column(4)
            for i in range(batch.num_rows):
                if (text := texts[i].as_py()) != last or not i:
                    last, doc = text, words(text)
                if found := occurrences(doc, words(items[i].as_py()), span):
                    rows.append(i)
                    spans.append([{"start": a, "stop": b} for a, b in found])
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(c.take(take) for c in batch.columns[:3]),
                 pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))],
                names=["k1", "k2", "item_id", "spans"])
    return run


def contamination(docs: DataFrame, items: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """``(k1, k2, item_id, spans)`` for every document row and item that share a window.

    ``docs`` has doc_id and text, ``items`` item_id and text; k1 and k2 identify
    the row (see :func:`keyed`).  Null, empty and wordless texts share nothing.
    """
    modest_batches(docs.sparkSession)
    docs, items = keyed(docs), items.select("item_id", "text")
    lengths = count_words(items.select("text")).select(F.least("n_words", F.lit(span)).alias("n"))
    spans = sorted(r.n for r in lengths.where("n > 0").distinct().collect())  # at most `span` values
    if not spans:
        return docs.limit(0).select(
            "k1", "k2", F.lit(None).cast(items.schema["item_id"].dataType).alias("item_id"),
            F.lit(None).cast("array<struct<start:int,stop:int>>").alias("spans"))
    find = _fingerprints(spans, gram)
    id_type = items.schema["item_id"].dataType.simpleString()
    kept = materialise(items.mapInArrow(find, f"item_id {id_type}, span int, h long").distinct(), "winnow-items")
    prints = docs.select("k1", "k2", "text").mapInArrow(find, "k1 long, k2 long, span int, h long")
    pairs = materialise(
        prints.join(small(kept), ["span", "h"]).select("k1", "k2", "item_id").distinct(), "winnow-pairs")
    texts = docs.select("k1", "k2", "text").join(small(pairs.select("k1", "k2").distinct()),
                                                  ["k1", "k2"], "left_semi").distinct()
    both = (pairs.join(texts, ["k1", "k2"])
            .join(items.withColumnRenamed("text", "item_text"),
                  pairs.item_id.eqNullSafe(items.item_id)).select(
                "k1", "k2", pairs.item_id, "text", "item_text"))
    return both.mapInArrow(_verify(span), f"k1 long, k2 long, item_id {id_type}, "
                                          "spans array<struct<start:int,stop:int>>")


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and a 128-bit key of both: rows with one key have one result."""
    return docs.select("doc_id", "text").withColumns(row_key())


def report(docs: DataFrame, items: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """Per document row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Without a hit items_sha256 is that of the empty string.  Items with a null
    id count as hits but not as items.
    """
    hits = materialise(contamination(docs, items, span, gram), "winnow-hits")
    covered = (hits.select("k1", "k2", F.explode("spans").alias("s"))
               .select("k1", "k2", F.explode(F.sequence("s.start", F.col("s.stop") - 1)).alias("at"))
               .distinct().groupBy("k1", "k2").agg(F.count("*").alias("n_hit")))
    named = hits.groupBy("k1", "k2").agg(
        F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    found = materialise(covered.join(named, ["k1", "k2"]), "winnow-found")
    return (count_words(keyed(docs).select("doc_id", "k1", "k2", "text"))
            .join(small(found), ["k1", "k2"], "left")
            .select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                    F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
                    F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
                    F.col("n_hit").isNotNull().alias("contaminated")))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(read(spark, sf_dir, "documents").select("doc_id", "text"),
                  read(spark, sf_dir, "benchmark"))


_LOW = f"translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}')"
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOW}, '{WORD}') AS w FROM documents),
i AS (SELECT item_id, w, least(len(w), {SPAN}) AS n
      FROM (SELECT item_id, regexp_extract_all({_LOW}, '{WORD}') AS w FROM benchmark) WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS s
       FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM i)),
dw AS (SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS s
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p
             FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
hit AS MATERIALIZED (SELECT doc_id, p, n, item_id FROM dw JOIN iw USING (n, s)),
cov AS (SELECT doc_id, count(DISTINCT q) AS n_hit
        FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)
"""
