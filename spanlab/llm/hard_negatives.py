"""Hard-negative mining by threshold joins over suffix-norm indexes.

For each anchor, its best rows of the same label are positives; for each of them, the
best rows of other labels in a window of scores below the positive's are negatives.
Both are searches for the best rows in a score window, answered by threshold joins in
the manner of L2AP:

1. Rows are packed into blocks.  For a threshold t, a block is indexed by panels of
   dimensions: a row is left out of its leading panels as long as the norms of both
   sides over them cannot reach t, since a pair that meets only there is no answer.
2. The index is read from the last panel to the first.  It accumulates the partial
   scores of the queries with the rows in each panel, and drops pairs whose partial score
   plus the product of the remaining norms stays under t.  What is left is completed exactly.
3. Rows found at t or more are complete, so a window that has its k rows is filled.  The
   other windows are searched again with a lower threshold, the last time with none.

Scores are integers, so nothing depends on the order of the sums.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanlab.llm.common import BROADCAST_BYTES, materialise, modest_batches, read

#: Contract of the query.
POSITIVES = 5
NEGATIVES = 3
LOW, HIGH = 50, 95
SCALE = 256
#: Components of one block of rows, and queries of one block.
BLOCK = 1 << 18
QUERIES = 256
#: Dimensions of a panel.
PANEL = 16
#: Vectors whose integer norm reaches this take no part: their scores may not fit in a long.
NORM_LIMIT = 1 << 31
#: Shares of the score that a search can reach, tried in turn as thresholds; then none.
SHARES = (0.5, 0.3)
#: Rows of a block found for a window by fewer than this share of the queries' pairs are completed one by one.
SPARSE = 0.1
#: Blocks of one partition of the join, where the queries are not broadcast.
DEAL = 8

NONE = -(1 << 62)


def scaled(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of every component as a long; null if a component is null or not finite."""
    usable = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float(1 << 40))))
    return F.when(usable, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def _matrix(vectors: pa.Array) -> np.ndarray:
    """Rows of numbers, zero beyond the end of a shorter one."""
    sizes = np.diff(vectors.offsets.to_numpy())
    values = vectors.flatten().to_numpy()
    if len(sizes) and (sizes == sizes[0]).all():
        return values.reshape(len(sizes), int(sizes[0]))
    out = np.zeros((len(sizes), int(sizes.max(initial=0))), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def blocks(rows: DataFrame) -> DataFrame:
    """(block, dim, ids, labels, vectors): rows (id, label, vector of longs) packed as bytes.

    A block's number leaves 20 bits free, in which a row's place in it makes the row's key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        numbers = itertools.count(TaskContext.get().partitionId() << 40, 1 << 20)

        def flush() -> pa.RecordBatch:
            dim = max(1, *(m.shape[1] for _, _, m in held))
            vectors = np.concatenate([np.pad(m, ((0, 0), (0, dim - m.shape[1]))) for _, _, m in held])
            row = [next(numbers), dim, *(np.concatenate([h[i] for h in held]).tobytes() for i in (0, 1)), vectors.tobytes()]
            held.clear()
            return pa.record_batch([pa.array([x]) for x in row], names=["block", "dim", "ids", "labels", "vectors"])

        for batch in batches:
            matrix = _matrix(batch.column(2))
            norms = np.sqrt((matrix.astype(float) ** 2).sum(axis=1))
            fits = norms < NORM_LIMIT
            ids, labels = (batch.column(i).to_numpy()[fits] for i in (0, 1))
            matrix = matrix[fits]
            step = max(1, BLOCK // max(1, matrix.shape[1]))
            for at in range(0, len(ids), step):
                held.append((ids[at:at + step], labels[at:at + step], matrix[at:at + step]))
                if sum(m.size for _, _, m in held) >= BLOCK:
                    yield flush()
        if held:
            yield flush()

    return rows.select(F.col("id").cast("long"), F.col("label").cast("long"), "vector").mapInArrow(
        run, "block long, dim long, ids binary, labels binary, vectors binary")


def unpacked(packed: DataFrame, divisor: int) -> DataFrame:
    """(query, id, label, vector) of the rows of blocks whose id the divisor divides.

    query, the row's key, tells where the row is itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, dim, ids, labels, vectors in zip(*(c.to_pylist() for c in batch.columns)):
                ids, labels = (np.frombuffer(x, np.int64) for x in (ids, labels))
                own = np.flatnonzero(ids % divisor == 0)
                if len(own):
                    matrix = np.frombuffer(vectors, np.int64).reshape(len(ids), dim)[own]
                    yield pa.record_batch([
                        pa.array(block + own), pa.array(ids[own]), pa.array(labels[own]),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1, dtype=np.int32) * dim), pa.array(matrix.ravel()))],
                        names=["query", "id", "label", "vector"])

    return packed.mapInArrow(run, "query long, id long, label long, vector array<long>")


class SuffixIndex:
    """One block of rows, indexed for scores of ``least`` or more with queries whose norms over the
    leading panels are at most ``query_norms``."""

    def __init__(self, vectors: np.ndarray, order: np.ndarray):
        self.vectors = vectors[:, order]
        self.cuts = list(range(0, vectors.shape[1], PANEL))
        self.norms = leading_norms(self.vectors, self.cuts)

    def omit(self, query_norms: np.ndarray, least: float) -> None:
        """Leave every row out of as many leading panels as cannot reach ``least``, and sort by that."""
        outside = (self.norms * query_norms[None, :] < least - 1).astype(np.int64)
        outside[:, 0] = 1  # nothing comes before the first panel
        first = np.cumprod(outside, axis=1).sum(axis=1) - 1  # the first panel that indexes the row
        self.rows = np.argsort(first, kind="stable")
        self.first = first[self.rows]


def leading_norms(vectors: np.ndarray, cuts: list[int]) -> np.ndarray:
    """Norms over the dimensions before each cut, and over all."""
    squares = np.cumsum(vectors.astype(float) ** 2, axis=1)
    return np.sqrt(np.concatenate([np.zeros((len(vectors), 1)), *(squares[:, c - 1:c] for c in cuts[1:]), squares[:, -1:]], axis=1))


def reached(queries: np.ndarray, index: SuffixIndex, least: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, rows, scores) of the pairs that reach the query's threshold."""
    norms = leading_norms(queries, index.cuts)
    index.omit(norms.max(axis=0), float(least.min()))
    exact = float if norms[:, -1].max() * index.norms[:, -1].max() < 2 ** 52 else np.int64
    vectors, given = index.vectors[index.rows].astype(exact), queries.astype(exact)
    row_norms = index.norms[index.rows]
    partial = np.zeros((len(queries), len(vectors)), exact)
    alive = None
    for panel in range(len(index.cuts) - 1, -1, -1):
        n = int(np.searchsorted(index.first, panel, "right"))  # rows indexed by this panel
        if alive is None:
            alive = np.zeros(partial.shape, bool)
        lo = index.cuts[panel]
        hi = index.cuts[panel + 1] if panel + 1 < len(index.cuts) else queries.shape[1]
        # a row's last panel makes it a candidate of every query; others only lose candidates
        if panel == len(index.cuts) - 1:
            alive[:, :n] = True
        if not n:
            continue
        partial[:, :n] += given[:, lo:hi] @ vectors[:n, lo:hi].T
        if panel:
            rest = np.outer(norms[:, panel], row_norms[:n, panel])
            rest *= 1 + 1e-9
            rest += partial[:, :n]
            alive[:, :n] &= rest >= least[:, None] - 1
            if np.count_nonzero(alive) < SPARSE * alive.size:
                break
    # complete the pairs that are left with the panels that they have not met
    at_query, at_row = np.nonzero(alive)
    scores = partial[at_query, at_row]
    unmet = np.asarray(index.cuts)[np.maximum(index.first[at_row], panel)]
    for stop in np.unique(unmet):
        if stop:
            which = np.flatnonzero(unmet == stop)
            for some in np.array_split(which, len(which) // 65536 + 1):
                scores[some] += np.einsum("ij,ij->i", given[at_query[some], :stop], vectors[at_row[some], :stop])
    scores = scores.astype(np.int64)
    good = scores >= least[at_query]
    at_query, at_row, scores = at_query[good], index.rows[at_row[good]], scores[good]
    for a, b in zip(*_spans(at_query)):
        yield int(at_query[a]), at_row[a:b], scores[a:b]


def _spans(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(np.diff(values, prepend=-1))
    return starts, np.append(starts[1:], len(values))


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: highest scores, then smallest ids."""
    if len(scores) > k:
        limit = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= limit)
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((ids[near], -scores[near]))[:k]]


def search(packed: DataFrame, queries: DataFrame, k: int, same_label: bool) -> DataFrame:
    """(query, w, id, score): for every window w of a query the ``k`` best rows with low <= score <= high
    and score >= least, of the query's label or of others; the query's own row is none.

    ``queries`` is a written table (query, label, vector, least, windows), windows
    an array of structs (w, low, high).  Queries go to every block of rows: as one broadcast if
    their measured size allows, else dealt with the blocks over partitions.
    """
    spark = packed.sparkSession
    modest_batches(spark)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, QUERIES):
                part = batch.slice(at, QUERIES)
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema) as writer:
                    writer.write_batch(part)
                yield pa.record_batch([pa.array([sink.getvalue().to_pybytes()])], names=["queries"])

    asked = materialise(queries.mapInArrow(pack, "queries binary"), "negatives-queries")
    size = asked.agg(F.sum(F.octet_length("queries"))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        left, right = packed.withColumn("p", F.lit(0)), F.broadcast(asked.withColumn("p", F.lit(0)))
    else:
        parts = max(1, packed.count() // DEAL)
        left = packed.withColumn("p", F.pmod(F.xxhash64("block"), F.lit(parts)).cast("int"))
        right = asked.withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, dim, ids, labels, vectors, sent in zip(*(c for c in batch.columns)):
                ids, labels = (np.frombuffer(x.as_buffer(), np.int64) for x in (ids, labels))
                table = pa.ipc.open_stream(sent.as_buffer()).read_all().combine_chunks()
                asked_of = {n: table.column(n).to_pylist() for n in ("query", "label", "windows")}
                given = _matrix(table.column("vector").chunk(0))
                dim = dim.as_py()
                matrix = np.frombuffer(vectors.as_buffer(), np.int64).reshape(len(ids), dim)
                width = min(dim, given.shape[1])
                order = np.argsort((matrix[:, :width].astype(float) ** 2).sum(axis=0), kind="stable")
                index = SuffixIndex(matrix[:, :width], order)
                out: tuple[list, ...] = ([], [], [], [])
                for q, rows, scores in reached(given[:, :width][:, order], index, table.column("least").to_numpy()):
                    fits = (labels[rows] == asked_of["label"][q]) == same_label
                    fits &= rows != asked_of["query"][q] - block.as_py()  # not itself
                    rows, scores = rows[fits], scores[fits]
                    for w in asked_of["windows"][q]:
                        inside = (scores >= w["low"]) & (scores <= w["high"])
                        for i in _best(ids[rows[inside]], scores[inside], k):
                            for column, x in zip(out, (asked_of["query"][q], w["w"], ids[rows[inside][i]], scores[inside][i])):
                                column.append(int(x))
                yield pa.record_batch([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int64()),
                                       pa.array(out[3], pa.int64())], names=["query", "w", "id", "score"])

    met = left.join(right, "p").select("block", "dim", "ids", "labels", "vectors", "queries")
    found = met.mapInArrow(run, "query long, w int, id long, score long")
    return ranked(found, k)


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query", "w").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def filled(packed: DataFrame, queries: DataFrame, k: int, same_label: bool, shares: tuple[float, ...] = SHARES) -> DataFrame:
    """(query, w, id, score, rank): the ``k`` best rows of every window, or all that it has.

    ``queries`` as in :func:`search` with ``reach`` (the score that ``shares`` are shares of)
    instead of ``least``.  Thresholds are lowered until every window has its rows.
    """
    out, open_ = [], queries
    for share in (*shares, None):
        low = F.array_min(F.transform("windows", lambda w: w["low"]))
        asked = materialise(open_.withColumn("least", low if share is None else F.greatest(
            low, F.floor(F.col("reach") * share).cast("long"))), "negatives-asked")
        if out and asked.isEmpty():
            break
        found = materialise(search(packed, asked.drop("reach"), k, same_label), "negatives-found")
        windows = asked.select("query", "least", F.explode("windows").alias("win")).select("query", "least", "win.*")
        state = windows.join(found.groupBy("query", "w").agg(F.count("*").alias("n")), ["query", "w"], "left")
        done = (F.coalesce("n", F.lit(0)) >= k) | (F.col("least") <= F.col("low"))
        out.append(found.join(state.where(done).select("query", "w"), ["query", "w"]))
        if share is None:
            break
        rest = state.where(~done).groupBy("query").agg(F.collect_list(F.struct("w", "low", "high")).alias("windows"))
        open_ = asked.drop("windows", "least").join(rest, "query")
    result = out[0]
    for more in out[1:]:
        result = result.unionByName(more)
    return result


def hard_negatives(rows: DataFrame, every: int = 50, positives: int = POSITIVES, negatives: int = NEGATIVES,
                   low: int = LOW, high: int = HIGH) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``rows`` are (id long, label long, vector array<long>).  Anchors are the rows whose id
    ``every`` divides; their positives are the best ``positives`` other rows of the label,
    and a positive's negatives the best ``negatives`` rows of other labels with
    low % <= negative score / positive score <= high %.  Best: highest inner product, then
    smallest id.  Rows with a null id, label or vector take no part; nor do vectors whose
    norm is 2^31 or more, whose scores may not fit in a long.  A shorter vector counts as
    zero beyond its end.  Rows that repeat an id are rows of their own, also as anchors.
    """
    rows = rows.where("id is not null and label is not null and vector is not null")
    packed = materialise(blocks(rows), "negatives-blocks")
    anchors = materialise(unpacked(packed, every), "negatives-anchors")
    # the longest row bounds the scores that an anchor can reach
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    top = _largest_norm(packed)
    whole = F.array(F.struct(F.lit(0).alias("w"), F.lit(NONE).alias("low"), F.lit(-NONE).alias("high")))
    queries = anchors.withColumn("reach", norm * F.lit(top)).withColumn("windows", whole)
    best = materialise(filled(packed, queries, positives, True).select(
        "query", F.col("rank").alias("w"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")),
        "negatives-positives")

    # integer bounds of the window: ceil(low * p / 100) and floor(high * p / 100)
    p = F.col("positive_score")
    least = -F.floor(-(p.cast("decimal(30,0)") * low) / F.lit(100)).cast("long")
    most = F.floor(p.cast("decimal(30,0)") * high / F.lit(100)).cast("long")
    windows = best.select("query", "w", least.alias("low"), most.alias("high")).where("low <= high")
    windows = windows.groupBy("query").agg(  # at most `positives` in each
        F.collect_list(F.struct("w", "low", "high")).alias("windows"), F.min("high").cast("double").alias("reach"))
    found = filled(packed, anchors.join(windows, "query"), negatives, False, (0.85, 0.7))
    return (found.join(best, ["query", "w"]).join(anchors.select("query", F.col("id").alias("anchor_id")), "query")
            .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
                    "positive_score", F.col("score").alias("negative_score")))


def _largest_norm(packed: DataFrame) -> float:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                m = np.frombuffer(data.as_buffer(), np.int64).reshape(-1, dim).astype(float) if dim else np.zeros((1, 1))
                yield pa.record_batch([pa.array([float(np.sqrt((m ** 2).sum(axis=1)).max())])], names=["n"])

    return packed.select("dim", "vectors").mapInArrow(run, "n double").agg(F.max("n")).first()[0] or 0.0


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.select(F.col("vec_id").alias("id"), label.alias("label"), scaled(F.col("embedding")).alias("vector")))


ORACLE_SQL = """
WITH rows_ AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM rows_ a JOIN rows_ b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
met AS (
  SELECT p.anchor_id, p.positive_id, n.id AS negative_id, p.positive_score, n.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.id) AS rank
  FROM positives p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT n.same
   AND 50 * p.positive_score <= 100 * n.score AND 100 * n.score <= 95 * p.positive_score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM met WHERE rank <= 3
"""
