"""Best-two-fit packing of token sequences, planned on the histogram of their lengths.

1. Documents are encoded where they are read and cut into pieces of at most the
   capacity.  Every batch of rows (a chunk) numbers its pieces per length.
2. Packing looks at lengths alone, so it runs on the histogram of all pieces, which has
   at most ``capacity`` rows whatever the corpus.  A bin is filled greedily with the
   largest lengths that fit; then its smallest document makes room for two unpacked ones
   that fill the widened gap more tightly, as long as such a pair exists.  A bin
   recurs as often as its lengths allow, so the plan is a list of bins with repeats: the
   same bins as packing one by one, in steps that do not grow with the corpus.
3. Counts per chunk and length become offsets, so each piece knows its number among all
   pieces of its length, and the plan names the place of that number.
"""

from __future__ import annotations

import array
import functools
import os
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanlab.llm.common import materialise, modest_batches, read

CAPACITY = 2048
#: Id after each document.
END = 0
#: Encoded words that a worker keeps.
CACHE = 1 << 19
#: Plain words encoded in one call.
JOINED = 5000
#: Words of more characters are not kept.
LONG_WORD = 200
#: Chunks are summed in so many groups before their offsets are known.
CHUNK_GROUPS = 1024


#: ASCII punctuation, but for apostrophes, between a letter or digit and a blank: a token of its own.
_STOP = r"([A-Za-z0-9])([!-&(-/:-@\[-`{-~]+)([ \n])"


class WordEncoder:
    """Ids of whole texts from a cache of the ids of their blank-separated words.

    For tokenizers that drop white space and never let a token or a normalisation reach
    across it.  Words are split and told apart in Arrow; Python sees the different ones.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are text
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, i in vocabulary.items():
            self.ends[i] = token.endswith("</w>")
        self.known: dict[str, bytes] = {"": b""}

    def _learn(self, words: list[str]) -> None:
        if len(self.known) + len(words) > CACHE:
            self.known = {"": b""}
        plain = [w for w in words if w.isalpha()]
        rest = [w for w in words if not w.isalpha()]
        for at in range(0, len(plain), JOINED):
            part = plain[at:at + JOINED]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.uint32)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(part):  # a word of several parts: normalising made a letter into more
                rest += part
                continue
            data, cuts = ids.tobytes(), (4 * stops).tolist()
            self.known.update(zip(part, [data[a:b] for a, b in zip([0, *cuts], cuts)]))
        for at in range(0, len(rest), JOINED):
            part = rest[at:at + JOINED]
            for word, found in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)):
                self.known[word] = array.array("I", found.ids).tobytes()

    def encode(self, texts: pa.Array) -> tuple[bytes, np.ndarray]:
        """Little-endian 32-bit ids of all texts, and where in them (in bytes) a text ends, from 0."""
        texts = pc.fill_null(texts, "")
        split = pc.split_pattern(pc.replace_substring(pc.replace_substring_regex(texts, _STOP, r"\1 \2\3"), "\n", " "), " ")
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        if new := [w for w in words if w not in self.known]:
            if len(self.known) + len(new) > CACHE:
                self.known, new = {"": b""}, words
            self._learn(new)
        ids = pa.array([self.known[w] for w in words], pa.large_binary()).take(coded.indices)
        for word in new:
            if len(word) > LONG_WORD:
                self.known.pop(word, None)
        starts = ids.buffers()[1]
        byte_at = np.frombuffer(starts, np.int64, len(ids) + 1) if len(ids) else np.zeros(1, np.int64)
        return ids.buffers()[2] or b"", byte_at[split.offsets.to_numpy()]


@functools.lru_cache(1)
def _encoder(path: str) -> WordEncoder:
    """A worker's encoder, kept for its tasks."""
    return WordEncoder(path)


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, tokens: bool = False) -> DataFrame:
    """A row per piece of every document: the columns of ``docs`` but the text, and

    ``piece`` (from 0), ``start`` (ids of the document before it), ``length``,
    ``ids_crc32`` (of the ids as little-endian 32-bit numbers), ``tokens`` (these bytes,
    if asked for), ``chunk`` and ``number`` (of the piece among those of its length in
    its chunk).  An id END follows each document, so a null or empty text is a piece of
    one id.  Only documents over ``capacity`` ids are cut.
    """
    modest_batches(docs.sparkSession)
    made = [("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType()),
            *([("tokens", T.BinaryType())] if tokens else []), ("chunk", T.LongType()), ("number", T.LongType())]
    taken = {"text", "tokens", "rank", "sequence_id", "offset", *(n for n, _ in made)}
    rest = [f for f in docs.schema.fields if f.name.lower() not in taken]
    width, end = 4 * capacity, END.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for batch in batches:
            at = batch.schema.get_field_index("text")
            rows, piece, crc, data, sizes = [], [], [], [], []
            encoded, stops = encoder.encode(batch.column(at))
            encoded = memoryview(encoded)
            for row in range(batch.num_rows):
                ids = bytes(encoded[stops[row]:stops[row + 1]]) + end
                for n, lo in enumerate(range(0, len(ids), width)):
                    part = ids[lo:lo + width]
                    rows.append(row), piece.append(n), sizes.append(len(part) >> 2), crc.append(zlib.crc32(part))
                    if tokens:
                        data.append(part)
            length, number = np.array(sizes, np.int64), np.empty(len(rows), np.int64)
            order = np.argsort(length, kind="stable")
            firsts = np.flatnonzero(np.diff(length[order], prepend=-1))
            number[order] = np.arange(len(rows)) - np.repeat(firsts, np.diff([*firsts, len(rows)]))
            piece = np.array(piece, np.int32)
            taken_rows = pa.array(rows, pa.int64())
            columns = dict(zip(batch.schema.names, batch.columns))
            yield pa.RecordBatch.from_arrays(
                [*(columns[f.name].take(taken_rows) for f in rest), pa.array(piece), pa.array(piece * np.int64(capacity)),
                 pa.array(length), pa.array(crc, pa.int64()), *([pa.array(data, pa.binary())] if tokens else []),
                 pa.array(np.full(len(rows), uuid.uuid4().int >> 65, np.int64)), pa.array(number)],
                names=[*(f.name for f in rest), *(n for n, _ in made)])

    schema = T.StructType([*rest, *(T.StructField(n, t) for n, t in made)])
    return docs.select(*[f.name for f in rest], "text").mapInArrow(run, schema)


class _Bin:
    """One bin being filled from the lengths that are left."""

    def __init__(self, left: np.ndarray, fits: np.ndarray, capacity: int):
        self.left, self.fits = left, fits  # fits[v]: the largest length left that is v at most, or 0
        self.room = capacity
        self.used: dict[int, int] = {}
        self.peak: dict[int, int] = {}

    def take(self, length: int) -> None:
        self.left[length] -= 1
        self.room -= length
        self.used[length] = n = self.used.get(length, 0) + 1
        self.peak[length] = max(n, self.peak.get(length, 0))
        if not self.left[length]:
            after = np.flatnonzero(self.left[length:])
            self.fits[length:length + after[0] if len(after) else None] = self.fits[length - 1]

    def give(self, length: int) -> None:
        self.left[length] += 1
        self.room += length
        self.used[length] -= 1
        if not self.used[length]:
            del self.used[length]
        if self.left[length] == 1:
            after = np.flatnonzero(self.left[length + 1:])
            self.fits[length:length + 1 + after[0] if len(after) else None] = length

    def fill(self) -> None:
        while length := int(self.fits[self.room]):
            self.take(length)

    def swap(self) -> bool:
        """Replace the smallest length by the two that fill its gap best, if they fill it better."""
        smallest = min(self.used)
        gap = self.room + smallest
        first = np.flatnonzero(self.left[:gap])
        second = self.fits[gap - first]
        alone = (second == first) & (self.left[first] < 2)
        second = np.where(alone, self.fits[np.maximum(first - 1, 0)], second)
        both = np.where(second > 0, first + second, 0)
        if not len(both) or both.max() <= smallest:
            return False
        best = int(both.argmax())
        self.take(int(first[best]))
        self.take(int(second[best]))
        self.give(smallest)
        return True


@dataclass
class Plan:
    """Where the pieces of every length go, in the order of their ranks.

    Entry i holds ``each[i]`` pieces of a length in each of a run of equal bins, from
    sequence ``base[i]`` and place ``offset[i]`` on; ``key`` is the length and the
    first rank.
    """

    key: np.ndarray
    each: np.ndarray
    base: np.ndarray
    offset: np.ndarray
    n_sequences: int

    RANKS = 48

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence_id, offset) of pieces."""
        key = (length << self.RANKS) + rank
        i = np.searchsorted(self.key, key, "right") - 1
        copy, slot = np.divmod(key - self.key[i], self.each[i])
        return self.base[i] + copy, self.offset[i] + slot * length


def best_two_fit(counts: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Bins as (pieces per length, how often the bin recurs); ``counts[l]`` pieces have length l."""
    left = np.zeros(capacity + 1, np.int64)
    left[:len(counts)] = counts
    fits = np.maximum.accumulate(np.where(left > 0, np.arange(capacity + 1), 0))
    bins = []
    while fits[capacity]:
        bin_ = _Bin(left, fits, capacity)
        bin_.fill()
        while bin_.room and bin_.swap():
            bin_.fill()
        # the next bins choose the same while every length is left as often as this one needed it
        again = min((int(left[n]) + used - bin_.peak[n]) // used for n, used in bin_.used.items())
        if again > 0:
            for n, used in bin_.used.items():
                left[n] -= again * used
            fits[:] = np.maximum.accumulate(np.where(left > 0, np.arange(capacity + 1), 0))
        bins.append((dict(sorted(bin_.used.items(), reverse=True)), 1 + max(again, 0)))
    return bins


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> Plan:
    rows, base, ranks = [], 0, np.zeros(capacity + 1, np.int64)
    for lengths, times in best_two_fit(counts, capacity):
        offset = 0
        for length, each in lengths.items():
            rows.append(((length << Plan.RANKS) + int(ranks[length]), each, base, offset))
            ranks[length] += each * times
            offset += each * length
        base += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return Plan(*(np.ascontiguousarray(c) for c in table.T), n_sequences=base)


def packed(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The written rows of :func:`pieces` with ``sequence_id`` (from 0) and ``offset``.

    No sequence is longer than ``capacity``; offsets are gapless from 0.  Which of several
    pieces of one length goes where depends on the chunks they were read in.
    """
    group = F.pmod(F.xxhash64("chunk"), F.lit(CHUNK_GROUPS)).alias("group")
    counts = materialise(cut.groupBy("length", group, "chunk").agg(F.count("*").alias("n")), "pack-counts")
    # at most `capacity` rows
    histogram = np.zeros(capacity + 1, np.int64)
    for row in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():
        histogram[row.length] = row.n
    where = plan(histogram, capacity)

    earlier = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    groups = counts.groupBy("length", "group").agg(F.sum("n").alias("n")).select(
        "length", "group", F.coalesce(F.sum("n").over(earlier("length").orderBy("group")), F.lit(0)).alias("groups_before"))
    before = counts.join(groups, ["length", "group"]).select("chunk", "length", (
        F.coalesce(F.sum("n").over(earlier("length", "group").orderBy("chunk")), F.lit(0))
        + F.col("groups_before")).alias("before"))
    ranked = cut.join(before, ["chunk", "length"]).withColumn("rank", F.col("number") + F.col("before")).select(
        *[c for c in cut.columns if c not in ("chunk", "number")], "rank")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [batch.schema.get_field_index(n) for n in ("length", "rank")]
            sequence, offset = where.place(*(batch.column(i).to_numpy() for i in at))
            yield pa.RecordBatch.from_arrays(
                [*(c for i, c in enumerate(batch.columns) if i != at[1]), pa.array(sequence), pa.array(offset)],
                names=[*(n for n in batch.schema.names if n != "rank"), "sequence_id", "offset"])

    schema = T.StructType([*(f for f in ranked.schema.fields if f.name != "rank"),
                           T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.mapInArrow(run, schema)


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, tokens: bool = False) -> DataFrame:
    """Encode, cut and pack ``docs`` (doc_id, text and any other columns): :func:`packed` rows.

    Repeated rows are packed each; a null doc_id is kept.
    """
    return packed(materialise(pieces(docs, path, capacity, tokens), "pack-pieces"), capacity)


def sequences(rows: DataFrame) -> DataFrame:
    """``(sequence_id, tokens, starts)`` of packed rows with tokens: the ids as little-endian
    32-bit numbers, and where each document begins.  A group is bounded by the capacity."""
    parts = rows.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "tokens"))).alias("parts"))
    return parts.select("sequence_id", F.unhex(F.array_join(F.transform("parts.tokens", F.hex), "")).alias("tokens"),
                        F.col("parts.offset").alias("starts"))


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    rows = pack(read(spark, sf_dir, "documents").select("doc_id", "text"), P.path("word_bpe_49k.json"))
    return rows.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
