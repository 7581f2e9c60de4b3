"""Byte-level BPE encoding and decoding by a global distinct-word shuffle.

1. Texts are cut into pre-tokens.  A block (a run of documents of about
   ``block_bytes``) keeps its distinct words once and, for every pre-token in
   order, the word's slot in the block: the exploded (word, position) pairs in
   compact form.  Blocks are one written table, bucketed by block.
2. A block's words are dealt by hash into ``buckets`` packed rows.  All rows of a
   bucket meet in one task, which encodes each distinct word once.  A frequent
   word is one entry of each block's row, so buckets are even at any skew.
3. The ids go back to the block packed in the same order and meet its slots
   again, which restores the ids of each document by position.

Decoding joins ids with the token-byte table, which is bounded by the
vocabulary and therefore broadcast.
"""

from __future__ import annotations

import base64
import heapq
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanlab.llm.common import bucketed, modest_batches, read

BLOCK_BYTES = 8 << 20
BUCKETS = 256
#: A rank file of more bytes than this is refused: it is broadcast to every task.
MAX_VOCABULARY_BYTES = 64 << 20


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> id from a rank file (base64 token, blank, id per line)."""
    size = os.path.getsize(path)
    if size > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} has {size} bytes; at most {MAX_VOCABULARY_BYTES} are broadcast")
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def encode_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Merge the adjacent pair of lowest rank (leftmost of equals) until none is left."""
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    if n < 2:
        return [ranks[word]] if n else []
    # parts are linked by their start offsets; end[i] is where the part at i stops
    end = list(range(1, n + 1))
    prev = list(range(-1, n - 1))
    alive = [True] * n
    heap = []
    for i in range(n - 1):
        r = ranks.get(word[i:i + 2])
        if r is not None:
            heap.append((r, i, i + 2))
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or end[i] >= stop or end[i] == n or end[end[i]] != stop:
            continue  # one of the two parts has been merged since
        alive[end[i]] = False
        end[i] = stop
        if stop < n:
            prev[stop] = i
            r = ranks.get(word[i:end[stop]])
            if r is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        p = prev[i]
        if p >= 0:
            r = ranks.get(word[p:stop])
            if r is not None:
                heapq.heappush(heap, (r, p, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i:end[i]]])
        i = end[i]
    return out


def pack(a: np.ndarray) -> bytes:
    """Unsigned integers, byte plane by byte plane, compressed."""
    a = np.ascontiguousarray(a, dtype="<u4")
    planes = a.view(np.uint8).reshape(-1, 4).T.tobytes()
    return len(a).to_bytes(8, "little") + pa.Codec("zstd").compress(planes, asbytes=True)


def unpack(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = pa.Codec("zstd").decompress(data[8:], 4 * n, asbytes=True)
    return np.frombuffer(planes, np.uint8).reshape(4, n).T.copy().view("<u4").reshape(-1)


def pack_words(words: list[bytes]) -> bytes:
    lens = pack(np.array([len(w) for w in words], np.uint32))
    return len(lens).to_bytes(8, "little") + lens + pa.Codec("zstd").compress(b"".join(words), asbytes=True)


def unpack_words(data: bytes) -> list[bytes]:
    n = int.from_bytes(data[:8], "little")
    stops = np.cumsum(unpack(data[8:8 + n]), dtype=np.int64)
    joined = pa.Codec("zstd").decompress(data[8 + n:], int(stops[-1]) if len(stops) else 0, asbytes=True)
    starts = [0, *stops.tolist()]
    return [joined[a:b] for a, b in zip(starts, starts[1:])]


def _cut_blocks(pattern: str, block_bytes: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex
        from pyspark import TaskContext

        find = regex.compile(pattern).findall
        task = TaskContext.get().partitionId()
        id_type = None
        n_blocks = held = 0
        ids: list = []
        counts: list[int] = []
        slots: list[np.ndarray] = []
        words: dict[str, int] = {}

        def flush() -> pa.RecordBatch:
            nonlocal n_blocks, held, ids, counts, slots, words
            flat = np.concatenate(slots)
            slots = []
            # frequent words get small slots: their high bytes pack to nothing
            order = np.argsort(-np.bincount(flat, minlength=len(words)), kind="stable")
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order))
            listed = [w.encode() for w in words]
            listed = [listed[i] for i in order]
            bucket = np.array([zlib.crc32(w) % buckets for w in listed], np.uint32)
            parts: dict[int, list[bytes]] = {}
            for w, b in zip(listed, bucket.tolist()):
                parts.setdefault(b, []).append(w)
            out = pa.record_batch([
                pa.array([(task << 32) | n_blocks], pa.int64()),
                pa.array([ids], pa.list_(id_type)),
                pa.array([counts], pa.list_(pa.int32())),
                pa.array([pack(rank[flat])], pa.binary()),
                pa.array([pack(bucket)], pa.binary()),
                pa.array([[{"bucket": b, "words": pack_words(w)} for b, w in sorted(parts.items())]],
                         pa.list_(pa.struct([("bucket", pa.int32()), ("words", pa.binary())]))),
            ], names=["block", "ids", "counts", "slots", "bucket_of", "parts"])
            n_blocks, held, ids, counts, slots, words = n_blocks + 1, 0, [], [], [], {}
            return out

        for batch in batches:
            id_type = batch.schema.field(0).type
            keys, texts = batch.column(0), batch.column(1)
            for i in range(batch.num_rows):
                text = texts[i].as_py() or ""
                found = find(text)
                slot = words.setdefault
                ids.append(keys[i].as_py())
                counts.append(len(found))
                slots.append(np.fromiter((slot(w, len(words)) for w in found), np.uint32, len(found)))
                held += len(text)
                if held >= block_bytes:
                    yield flush()
        if ids:
            yield flush()
    return run


def _encode_buckets(ranks):
    """Rows of a bucket in turn -> each block's ids of that bucket's words, packed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, bucket = ranks.value, None
        known: dict[bytes, list[int]] = {}
        for batch in batches:
            blocks, out = [], []
            for block, at, words in zip(*(c.to_pylist() for c in batch.columns)):
                if at != bucket:
                    known, bucket = {}, at
                coded = []
                for w in unpack_words(words):
                    ids = known.get(w)
                    if ids is None:
                        ids = known[w] = encode_word(w, table)
                    coded.append(ids)
                lens = pack(np.array([len(c) for c in coded], np.uint32))
                flat = pack(np.array([i for c in coded for i in c], np.uint32))
                blocks.append((block, at))
                out.append(len(lens).to_bytes(8, "little") + lens + flat)
            yield pa.record_batch([
                pa.array([b for b, _ in blocks], pa.int64()), pa.array([b for _, b in blocks], pa.int32()),
                pa.array(out, pa.binary())], names=["block", "bucket", "codes"])
    return run


def _join_positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(ids, counts, slots, bucket_of, codes) of a block -> its documents' ids."""
    for batch in batches:
        for row in range(batch.num_rows):
            keys, counts, slots, bucket_of, codes = (c[row] for c in batch.columns)
            counts, slots = np.asarray(counts.values), unpack(slots.as_py())
            lens, flat = [], []
            for part in sorted(codes.as_py() or [], key=lambda p: p["bucket"]):
                data = part["codes"]
                n = int.from_bytes(data[:8], "little")
                lens.append(unpack(data[8:8 + n]))
                flat.append(unpack(data[8 + n:]))
            # the parts hold the words by (bucket, slot); size and start of each slot's ids
            by_bucket = np.argsort(unpack(bucket_of.as_py()), kind="stable")
            size = np.zeros(len(by_bucket), np.int64)
            start = np.zeros(len(by_bucket), np.int64)
            if lens:
                n = np.concatenate(lens).astype(np.int64)
                size[by_bucket], start[by_bucket] = n, np.cumsum(n) - n
            codebook = np.concatenate(flat) if flat else np.zeros(0, np.uint32)
            stops = np.concatenate([[0], np.cumsum(counts)])
            for first in range(0, len(counts), 512):  # documents at a time
                last = min(first + 512, len(counts))
                at = slots[stops[first]:stops[last]]
                each = size[at]
                ends = np.concatenate([[0], np.cumsum(each)])
                out = codebook[np.repeat(start[at] - ends[:-1], each) + np.arange(ends[-1])]
                bounds = ends[stops[first:last + 1] - stops[first]]
                tokens = pa.LargeListArray.from_arrays(
                    pa.array(bounds, pa.int64()), pa.array(out.astype(np.int32)))
                yield pa.record_batch([keys.values.slice(first, last - first),
                                       tokens.cast(pa.list_(pa.int32()))], names=["id", "tokens"])


def _coded_blocks(docs: DataFrame, ranks_path: str, pattern: str, id_col: str, text_col: str,
                  block_bytes: int, buckets: int) -> DataFrame:
    """Blocks with the ids of their words: the input of :func:`_join_positions`."""
    spark = docs.sparkSession
    modest_batches(spark)
    id_type = docs.schema[id_col].dataType
    ranks = spark.sparkContext.broadcast(load_ranks(ranks_path))
    part_type = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("words", T.BinaryType())])
    blocks = bucketed(
        docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        .mapInArrow(_cut_blocks(pattern, block_bytes, buckets), T.StructType([
            T.StructField("block", T.LongType()), T.StructField("ids", T.ArrayType(id_type)),
            T.StructField("counts", T.ArrayType(T.IntegerType())),
            T.StructField("slots", T.BinaryType()), T.StructField("bucket_of", T.BinaryType()),
            T.StructField("parts", T.ArrayType(part_type))])), "bpe_blocks", "block")
    codes = (blocks.select("block", F.explode("parts").alias("p"))
             .select("block", "p.bucket", "p.words")
             .repartition("bucket").sortWithinPartitions("bucket")
             .mapInArrow(_encode_buckets(ranks), "block long, bucket int, codes binary")
             .groupBy("block").agg(F.collect_list(F.struct("bucket", "codes")).alias("codes")))  # <= buckets
    return blocks.join(codes, "block", "left").select("ids", "counts", "slots", "bucket_of", "codes")


def _token_fields(docs: DataFrame, id_col: str) -> list[T.StructField]:
    return [T.StructField("id", docs.schema[id_col].dataType), T.StructField("tokens", T.ArrayType(T.IntegerType()))]


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id",
           text_col: str = "text", block_bytes: int = BLOCK_BYTES, buckets: int = BUCKETS) -> DataFrame:
    """``(id_col, tokens array<int>)``, one row per row of ``docs``.

    A null or empty text has no tokens; repeated rows and null ids stay as they
    are; other columns of ``docs`` are not looked at.
    """
    coded = _coded_blocks(docs, ranks_path, pattern, id_col, text_col, block_bytes, buckets)
    return coded.mapInArrow(_join_positions, T.StructType(_token_fields(docs, id_col))).select(
        F.col("id").alias(id_col), "tokens")


def decode(encoded: DataFrame, ranks_path: str, tokens_col: str = "tokens",
           out_col: str = "decoded") -> DataFrame:
    """Add ``out_col`` (binary): the bytes of the ids in ``tokens_col``.

    The token-byte table is bounded by the vocabulary file and broadcast.  A
    null list decodes to null, an id outside the table raises.
    """
    run = _decoder(encoded.sparkSession, ranks_path, tokens_col, out_col)
    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields,
                                                 T.StructField(out_col, T.BinaryType())]))


def _decoder(spark: SparkSession, ranks_path: str, tokens_col: str, out_col: str):
    ranks = load_ranks(ranks_path)
    table: list[bytes | None] = [None] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        table[i] = token
    shared = spark.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens_of = pa.array(shared.value, pa.large_binary())
        for batch in batches:
            at = batch.schema.get_field_index(tokens_col)
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                lists = part.column(at)
                ids = lists.flatten()
                known = np.asarray(ids)
                if len(known) and not 0 <= known.min() <= known.max() < len(tokens_of):
                    raise ValueError("an id is not in the token-byte table")
                joined = tokens_of.take(ids)
                if joined.null_count:
                    raise ValueError("an id is not in the token-byte table")
                offsets = np.frombuffer(joined.buffers()[1], np.int64)[
                    joined.offset:joined.offset + len(joined) + 1]
                data = joined.buffers()[2]
                bounds = np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths().fill_null(0)))])
                ends = offsets[bounds]
                out = [data[ends[i]:ends[i + 1]].to_pybytes() if data is not None else b""
                       for i in range(len(part))]
                valid = lists.is_valid().to_pylist()
                out = [x if ok else None for x, ok in zip(out, valid)]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(out, pa.binary())], names=[*part.schema.names, out_col])

    return run


def digest(tokens: Column) -> Column:
    """SHA-256 of the decimal ids joined by commas."""
    return F.sha2(F.concat_ws(",", tokens.cast("array<string>")), 256)


def encode_digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, tokens, n_tokens, ids_sha256, decoded_sha256 of every document."""
    decoded = _decoder(docs.sparkSession, ranks_path, "tokens", "decoded")

    def restore_and_decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return decoded(_join_positions(batches))  # in one worker: two would double its memory

    coded = _coded_blocks(docs, ranks_path, pattern, "doc_id", "text", BLOCK_BYTES, BUCKETS)
    return coded.mapInArrow(restore_and_decode, T.StructType([
        *_token_fields(docs, "doc_id"), T.StructField("decoded", T.BinaryType())])
    ).withColumnRenamed("id", "doc_id").select(
        "doc_id", "tokens", F.size("tokens").cast("long").alias("n_tokens"),
        digest(F.col("tokens")).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return encode_digests(read(spark, sf_dir, "documents").select("doc_id", "text"),
                          P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).drop("tokens")
