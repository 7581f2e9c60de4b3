"""Exact deduplication through counting quotient filters.

1. Every partition puts the 64-bit fingerprints of its texts into a counting
   quotient filter: a fingerprint's high bits (the quotient) name a run, the rest
   (the remainder) is kept in the run with a count.  No bit is lost, so a filter
   is the multiset of its fingerprints.
2. Filters are cut by quotient into ranges; the pieces of a range meet in one task
   and are merged: the filter of a range is built anew from the sorted fingerprints of
   all its pieces, counts added.
3. Only texts whose fingerprint has a count above one go to byte verification: they
   are grouped by their normalised text itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanlab.llm.common import UPPER, groups, materialise, modest_batches, read, small

#: Quotient bits that name the range a piece of a filter is merged in.
RANGE_BITS = 12
#: Fingerprints of one filter.
FILTER_SIZE = 1 << 20
#: Copies of a group are dealt to so many tasks before their texts are compared.
SALTS = 16


@dataclass
class QuotientFilter:
    """Sorted runs of remainders with counts.

    ``runs[i]`` is the number of remainders of quotient ``first + i``; remainders
    have ``bits`` bits.
    """

    first: int
    bits: int
    runs: np.ndarray
    remainders: np.ndarray
    counts: np.ndarray

    @classmethod
    def of(cls, fingerprints: np.ndarray, counts: np.ndarray | None = None) -> QuotientFilter:
        """Of any fingerprints; as many quotient bits as the number of them asks for."""
        if counts is None:
            values, counts = np.unique(fingerprints, return_counts=True)
        else:
            values, at = np.unique(fingerprints, return_inverse=True)
            counts = np.bincount(at, counts, len(values)).astype(np.int64)
        bits = 64 - max(RANGE_BITS, int(len(values)).bit_length())
        quotients = values >> np.uint64(bits)
        first = int(quotients[0]) if len(values) else 0
        runs = np.bincount((quotients - np.uint64(first)).astype(np.int64)) if len(values) else np.zeros(0, np.int64)
        return cls(first, bits, runs, values & np.uint64((1 << bits) - 1), counts.astype(np.int64))

    def fingerprints(self) -> np.ndarray:
        quotients = np.repeat(np.arange(len(self.runs), dtype=np.uint64) + np.uint64(self.first), self.runs)
        return (quotients << np.uint64(self.bits)) | self.remainders

    def merge(self, other: QuotientFilter) -> QuotientFilter:
        """The filter of both multisets."""
        return QuotientFilter.of(np.concatenate([self.fingerprints(), other.fingerprints()]),
                                 np.concatenate([self.counts, other.counts]))

    def pieces(self, range_bits: int) -> Iterator[tuple[int, bytes]]:
        """(range, fingerprints and counts of the range) for every range that has any."""
        values = self.fingerprints()
        ranges = (values >> np.uint64(64 - range_bits)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(ranges, prepend=-1))
        for a, b in zip(cuts, [*cuts[1:], len(values)]):
            piece = QuotientFilter.of(values[a:b], self.counts[a:b])
            yield int(ranges[a]), piece.to_bytes()

    def to_bytes(self) -> bytes:
        head = np.array([self.first, self.bits, len(self.runs), len(self.remainders)], np.int64)
        return b"".join([head.tobytes(), self.runs.astype(np.uint32).tobytes(),
                         self.remainders.tobytes(), self.counts.tobytes()])

    @classmethod
    def from_bytes(cls, data: bytes) -> QuotientFilter:
        first, bits, n_runs, n = np.frombuffer(data, np.int64, 4).tolist()
        at = 32 + 4 * n_runs
        return cls(first, bits, np.frombuffer(data, np.uint32, n_runs, 32).astype(np.int64),
                   np.frombuffer(data, np.uint64, n, at), np.frombuffer(data, np.int64, n, at + 8 * n))


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    for batch in batches:
        texts = [(t.as_py() or "").encode("utf-8", "surrogatepass").lower() for t in batch.column(1)]
        yield pa.record_batch([
            batch.column(0),
            pa.array(np.array([xxhash.xxh64_intdigest(t) for t in texts], np.uint64).view(np.int64)),
            pa.array([hashlib.sha256(t).hexdigest() for t in texts])], names=["doc_id", "fp", "text_sha256"])


def _with_fp(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    for batch in batches:
        texts = [(t.as_py() or "").encode("utf-8", "surrogatepass").lower() for t in batch.column(1)]
        yield pa.record_batch([
            batch.column(0),
            pa.array(np.array([xxhash.xxh64_intdigest(t) for t in texts], np.uint64).view(np.int64)),
            pa.array(texts, pa.binary())], names=["doc_id", "fp", "norm"])


def _build(range_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n = 0

        def flush() -> pa.RecordBatch:
            made = list(QuotientFilter.of(np.concatenate(held)).pieces(range_bits))
            return pa.record_batch([pa.array([r for r, _ in made], pa.int32()),
                                    pa.array([p for _, p in made], pa.binary())], names=["range", "piece"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch.column(0).to_numpy().view(np.uint64))
                n += batch.num_rows
            if n >= FILTER_SIZE:
                yield flush()
                held, n = [], 0
        if held:
            yield flush()
    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in groups(batches, ["range"]):
        merged = QuotientFilter.of(np.zeros(0, np.uint64))
        held: list[QuotientFilter] = []
        for piece in table.column("piece"):
            held.append(QuotientFilter.from_bytes(piece.as_py()))
            if len(held) == 64:
                merged, held = _sum([merged, *held]), []
        merged = _sum([merged, *held])
        many = merged.counts > 1
        yield pa.record_batch([pa.array(merged.fingerprints()[many].view(np.int64)),
                               pa.array(merged.counts[many])], names=["fp", "n"])


def _sum(filters: list[QuotientFilter]) -> QuotientFilter:
    return QuotientFilter.of(np.concatenate([f.fingerprints() for f in filters]),
                             np.concatenate([f.counts for f in filters]))


def repeated_fingerprints(fingerprints: DataFrame, range_bits: int = RANGE_BITS) -> DataFrame:
    """``(fp, n)`` of the values of the one long column that occur more than once."""
    return (fingerprints.mapInArrow(_build(range_bits), "range int, piece binary")
            .repartition("range").sortWithinPartitions("range").mapInArrow(_merge, "fp long, n long"))


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row.

    Texts are compared with A-Z lower-cased; null counts as empty.  The largest
    doc_id of equal texts stays (null only where all of them are null); rows that
    repeat that doc_id are all marked as kept.
    """
    modest_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    id_field = docs.schema["doc_id"]
    digests = materialise(docs.mapInArrow(_digests, T.StructType([
        id_field, T.StructField("fp", T.LongType()), T.StructField("text_sha256", T.StringType())])), "exact-digests")
    repeated = materialise(repeated_fingerprints(digests.select("fp")), "exact-repeated")
    texts = docs.mapInArrow(_with_fp, T.StructType([
        id_field, T.StructField("fp", T.LongType()), T.StructField("norm", T.BinaryType())]))
    salted = small(repeated.select("fp", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")))
    verified = materialise(
        texts.withColumn("salt", F.pmod(F.hash("doc_id"), F.lit(SALTS))).join(salted, ["fp", "salt"])
        .groupBy("fp", "norm").agg(F.max("doc_id").alias("keep"), F.count("*").alias("size")).where("size > 1")
        .select(F.sha2("norm", 256).alias("text_sha256"), "keep", "size"), "exact-groups")
    return (digests.join(small(verified), "text_sha256", "left")
            .select("doc_id", F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("keep")).alias("keep_id"),
                    F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
                    (F.col("size").isNull() | F.col("doc_id").eqNullSafe(F.col("keep"))).alias("kept"),
                    "text_sha256"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(read(spark, sf_dir, "documents"))


ORACLE_SQL = f"""
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}') AS t FROM documents)
WINDOW w AS (PARTITION BY t)
"""
