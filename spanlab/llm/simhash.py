"""SimHash near-duplicates by bit-sliced comparison.

A text's fingerprint has the bits that are set in over half of its shingles'
64-bit hashes.  Distinct fingerprints at ``radius`` or fewer differing bits are
linked:

* The 64 bits fall into ``radius + 2`` bands; two linked fingerprints agree in
  at least two of them, so a table per pair of bands holds every link.
* The fingerprints of a bucket are stored vertically, one bit plane per bit.
  For each of them a carry-save counter of three planes adds the differing bits
  of all others at once and is abandoned when all have exceeded the radius.
* A bucket over ``TILE`` fingerprints is cut into chunks, and every pair of
  chunks is compared as a tile of its own.
* A tile emits edges that span its linked fingerprints, never all its pairs; the
  components come from distributed union-find.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanlab.llm.common import components, groups, materialise, modest_batches, read

#: Contract of the query and of the pipeline's stage.
SHINGLE = 3
RADIUS = 2
SEED = 42
#: Fingerprints of one side of a comparison.
TILE = 2048


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of one text: ASCII-lower-cased, words between ASCII white space."""
    import xxhash

    hashed = xxhash.xxh64_intdigest
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = len(words) - shingle + 1
    if n <= 1:
        hashes = np.array([hashed(joined, SEED)], np.uint64)
    else:
        # a shingle is a slice of the joined words
        lens = np.fromiter(map(len, words), np.int64, len(words))
        stops = np.cumsum(lens + 1) - 1
        starts = (stops - lens)[:n].tolist()
        hashes = np.fromiter((hashed(joined[a:b], SEED) for a, b in zip(starts, stops[shingle - 1:].tolist())),
                             np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at:at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, text_col: str = "text") -> DataFrame:
    """The columns of ``docs`` but the text, and ``fp`` (the 64 bits as a long)."""
    modest_batches(docs.sparkSession)
    rest = [f for f in docs.schema.fields if f.name != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            fps = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(at)], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [*(c for i, c in enumerate(batch.columns) if i != at), pa.array(fps.view(np.int64))],
                names=[*(n for n in batch.schema.names if n != text_col), "fp"])

    return docs.mapInArrow(run, T.StructType([*rest, T.StructField("fp", T.LongType())]))


def _planes(fps: np.ndarray) -> list[int]:
    """Bit planes of n fingerprints: integers of n bits."""
    bits = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    packed = np.packbits(bits, axis=0, bitorder="little")
    return [int.from_bytes(packed[:, i].tobytes(), "little") for i in range(64)]


def within(query: int, planes: list[int], n: int, radius: int) -> int:
    """The fingerprints of the planes at ``radius`` or fewer bits from the query, as a bit set.

    Bits of the counters are carried as in a carry-save adder; ``over`` keeps
    who has exceeded the radius, and the block is abandoned when all have.
    """
    full = (1 << n) - 1
    counters = [0] * radius.bit_length()
    limit = radius + 1
    over = 0
    for i, plane in enumerate(planes):
        carry = (plane ^ full if query >> i & 1 else plane) & ~over
        for k in range(len(counters)):
            if not carry:
                break
            counters[k], carry = counters[k] ^ carry, counters[k] & carry
        over |= carry
        # counters equal to radius + 1 exceed it too (if it fits into them)
        if limit >> len(counters) == 0:
            hit = full
            for k, c in enumerate(counters):
                hit &= c if limit >> k & 1 else ~c
            over |= hit
        if over == full:
            return 0
    return full & ~over


def _members(found: int) -> Iterator[int]:
    while found:
        low = found & -found
        yield low.bit_length() - 1
        found ^= low


def spanning_edges(left: np.ndarray, right: np.ndarray | None, radius: int) -> list[tuple[int, int]]:
    """Edges that connect whatever links within ``left``, or between the two sides."""
    columns = left if right is None else right
    planes, n = _planes(columns), len(columns)
    parent = list(range(len(left) + (0 if right is None else n)))
    shift = 0 if right is None else len(left)
    out = []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, q in enumerate(left.tolist()):
        for j in _members(within(q, planes, n, radius)):
            a, b = root(i), root(j + shift)
            if a != b:
                parent[a] = b
                out.append((q, int(columns[j])))
    return out


def _compare(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a: list[int] = []
        b: list[int] = []

        def flush():
            out = pa.record_batch([pa.array(np.array(x, np.uint64).view(np.int64)) for x in (a, b)], names=["a", "b"])
            a.clear(), b.clear()
            return out

        for tile in groups(batches, ["which", "bucket", "lo", "hi"]):
            fps = tile.column("fp").to_numpy().view(np.uint64)
            side = tile.column("chunk").to_numpy()
            lo, hi = tile.column("lo")[0].as_py(), tile.column("hi")[0].as_py()
            edges = (spanning_edges(fps, None, radius) if lo == hi
                     else spanning_edges(fps[side == lo], fps[side == hi], radius))
            for x, y in edges:
                a.append(x), b.append(y)
            if len(a) > 50_000:
                yield flush()
        yield flush()
    return run


def links(fps: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Spanning edges (a, b) of distinct fingerprints ``fp`` at ``radius`` bits or fewer."""
    bands = radius + 2
    cuts = [round(i * 64 / bands) for i in range(bands + 1)]
    band = [F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1))
            for lo, hi in zip(cuts, cuts[1:])]
    keys = [(i, F.xxhash64(band[x], band[y])) for i, (x, y) in enumerate(combinations(range(bands), 2))]
    rows = fps.select("fp", F.explode(F.array(*[
        F.struct(F.lit(i).alias("which"), k.alias("bucket")) for i, k in keys])).alias("k")
    ).select("fp", "k.which", "k.bucket")
    sizes = rows.groupBy("which", "bucket").agg(F.count("*").alias("n")).where("n > 1")
    met = rows.join(sizes, ["which", "bucket"])
    chunks = F.ceil(F.col("n") / F.lit(tile)).cast("int")
    dealt = (met.withColumn("chunks", chunks)
             .withColumn("chunk", F.pmod(F.xxhash64("fp", F.lit("chunk")), F.col("chunks")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
             .select("which", "bucket", F.least("chunk", "other").alias("lo"),
                     F.greatest("chunk", "other").alias("hi"), "chunk", "fp"))
    tile_key = ["which", "bucket", "lo", "hi"]
    return (dealt.repartition(*tile_key).sortWithinPartitions(*tile_key)
            .mapInArrow(_compare(radius), "a long, b long"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, fp, component)`` of every row; component is the smallest id reachable.

    A null, empty or blank text has fingerprint zero and links like any other.
    Rows with a null id take part but never name a component, unless no id is
    known in it (then it is null).  Repeated rows are returned as often.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    marked = materialise(fingerprints(docs, shingle), "simhash")
    least = materialise(marked.groupBy("fp").agg(F.min("id").alias("least")), "simhash-fp")
    roots = components(links(least.select("fp"), radius), "simhash-links")
    known = least.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp"))
    named = known.join(known.groupBy("root").agg(F.min("least").alias("component")), "root")
    return (marked.join(named.select("fp", "component"), "fp")
            .select(F.col("id").alias(id_col), "fp", "component"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"))
