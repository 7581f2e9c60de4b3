"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads UTF-8 bytes (A-Z folded to a-z) in segments of ``SEGMENT``
bytes, one gated recurrent unit forwards and one backwards; every position gets
a probability for each language from both states, and a document's probability
is the mean over all its positions.  It is trained here in numpy by
backpropagation through time on a bounded sample of labelled snippets; scoring
runs in Arrow batches over whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanlab.llm.common import few_by_hash, modest_batches, read

SEGMENT = 96
HIDDEN = 12
#: The training sample: at most so many documents of a language, one snippet of
#: at most SNIPPET characters from a place in the text chosen by hash.
SAMPLE_PER_LANGUAGE = 400
SNIPPET = 384
MAX_LANGUAGES = 512
STEPS = 260
BATCH = 256
#: Segments scored together, and bytes of text held together.
WIDTH = 1024
HELD_BYTES = 1 << 20
UNDETERMINED = "und"


@dataclass
class Direction:
    """One gated recurrent unit, feature-major: table (3H, 256), u (3H, H), b (H,)."""

    table: np.ndarray
    u: np.ndarray
    b: np.ndarray


@dataclass
class Network:
    languages: list[str]
    forward: Direction
    backward: Direction
    out: np.ndarray  # (L, 2H)
    bias: np.ndarray  # (L,)


def _fold() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


FOLD = _fold()


def segments(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts -> (bytes by (segment, position) padded with 0, real lengths, piece of each)."""
    n = np.array([len(p) for p in pieces], np.int64)
    count = -(-n // SEGMENT)
    starts = np.concatenate([[0], np.cumsum(count)])
    flat = np.zeros(int(starts[-1]) * SEGMENT, np.uint8)
    for p, s, size in zip(pieces, starts * SEGMENT, n):
        flat[s:s + size] = np.frombuffer(p, np.uint8)
    lengths = np.full(int(starts[-1]), SEGMENT, np.int64)
    last = starts[1:][count > 0] - 1
    lengths[last] = (n - (count - 1) * SEGMENT)[count > 0]
    return FOLD[flat].reshape(-1, SEGMENT), lengths, np.repeat(np.arange(len(pieces)), count)


def _states(d: Direction, x: np.ndarray) -> np.ndarray:
    """States (T, H, B) of bytes x (T, B)."""
    size = d.u.shape[1]
    table, u = d.table.copy(), d.u.copy()
    table[:2 * size] *= 0.5  # sigmoid(v) = (1 + tanh(v / 2)) / 2
    u[:2 * size] *= 0.5
    b = d.b[:, None]
    h = np.zeros((size, x.shape[1]), np.float32)
    out = np.empty((x.shape[0], size, x.shape[1]), np.float32)
    for t in range(x.shape[0]):
        g = np.take(table, x[t], axis=1)
        v = u @ h
        a = g[:2 * size]
        a += v[:2 * size]
        np.tanh(a, out=a)
        a += 1
        a *= 0.5
        n = v[2 * size:]
        n += b
        n *= a[:size]
        n += g[2 * size:]
        np.tanh(n, out=n)
        h = h - n
        h *= a[size:]
        h += n
        out[t] = h
    return out


def position_probabilities(net: Network, x: np.ndarray) -> np.ndarray:
    """(T, L, B) probabilities of bytes x (T, B)."""
    size = net.forward.u.shape[1]
    logits = np.matmul(net.out[:, :size], _states(net.forward, x))
    logits += np.matmul(net.out[:, size:], _states(net.backward, x[::-1])[::-1])
    logits += net.bias[:, None]
    logits -= logits.max(axis=1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=1, keepdims=True)
    return logits


def pooled(net: Network, texts: list[bytes]) -> np.ndarray:
    """Mean probabilities (texts, L) over every position; zeros for an empty text."""
    total = np.zeros((len(texts), len(net.languages)))
    held: list[tuple[int, bytes]] = []
    size = 0

    def score():
        x, lengths, of = segments([p for _, p in held])
        owner = np.array([i for i, _ in held])[of]
        for s in range(0, len(x), WIDTH):
            n = len(x[s:s + WIDTH])
            block = np.zeros((WIDTH, SEGMENT), np.uint8)  # always the same width: the same sums anywhere
            block[:n] = x[s:s + WIDTH]
            real = np.zeros(WIDTH, np.int64)
            real[:n] = lengths[s:s + WIDTH]
            p = position_probabilities(net, np.ascontiguousarray(block.T))
            p *= (np.arange(SEGMENT)[:, None] < real)[:, None, :]
            np.add.at(total, owner[s:s + n], p.sum(axis=0).T[:n].astype(np.float64))

    for i, text in enumerate(texts):
        step = HELD_BYTES // SEGMENT * SEGMENT
        for at in range(0, len(text), step):
            piece = text[at:at + step]
            held.append((i, piece))
            size += len(piece)
            if size >= HELD_BYTES:
                score()
                held, size = [], 0
    if held:
        score()
    return total / np.maximum([len(t) for t in texts], 1)[:, None]


def _train_states(d: Direction, x: np.ndarray):
    size = d.u.shape[1]
    h = np.zeros((size, x.shape[1]), np.float32)
    kept = []
    for t in range(x.shape[0]):
        g = d.table[:, x[t]]
        v = d.u @ h
        a = 0.5 + 0.5 * np.tanh(0.5 * (g[:2 * size] + v[:2 * size]))
        r, z = a[:size], a[size:]
        un = v[2 * size:] + d.b[:, None]
        n = np.tanh(g[2 * size:] + r * un)
        kept.append((h, r, z, un, n))
        h = n + z * (h - n)
    return np.stack([k[0] for k in kept[1:]] + [h]), kept


def _backward(d: Direction, x: np.ndarray, kept, dout: np.ndarray):
    """Backpropagation through time: gradients of table, u and b."""
    size = d.u.shape[1]
    dh = np.zeros_like(dout[0])
    du, db = np.zeros_like(d.u), np.zeros_like(d.b)
    dg = np.empty((x.shape[0], 3 * size, x.shape[1]), np.float32)
    for t in range(x.shape[0] - 1, -1, -1):
        h, r, z, un, n = kept[t]
        dh = dh + dout[t]
        dn = dh * (1 - z) * (1 - n * n)
        dg[t, :size] = dn * un * r * (1 - r)
        dg[t, size:2 * size] = dh * (h - n) * z * (1 - z)
        dg[t, 2 * size:] = dn
        dv = dg[t].copy()
        dv[2 * size:] *= r
        du += dv @ h.T
        db += dv[2 * size:].sum(axis=1)
        dh = dh * z + d.u.T @ dv
    flat, by = dg.transpose(1, 0, 2).reshape(3 * size, -1), x.reshape(-1)
    order = np.argsort(by, kind="stable")
    seen, first = np.unique(by[order], return_index=True)
    dtable = np.zeros_like(d.table)
    dtable[:, seen] = np.add.reduceat(flat[:, order], first, axis=1)
    return dtable, du, db


def train(snippets: list[tuple[bytes, str]], hidden: int = HIDDEN, steps: int = STEPS,
          seed: int = 7) -> Network:
    """Fit the network on (bytes, language) pairs with Adam; languages weigh alike."""
    rng = np.random.default_rng(seed)
    languages = sorted({lang for _, lang in snippets})
    size, n_langs = hidden, len(languages)

    def direction() -> Direction:
        return Direction(rng.normal(0, 0.3, (3 * size, 256)).astype(np.float32),
                         rng.normal(0, size ** -0.5, (3 * size, size)).astype(np.float32),
                         np.zeros(size, np.float32))

    net = Network(languages, direction(), direction(),
                  rng.normal(0, 0.3, (n_langs, 2 * size)).astype(np.float32),
                  np.zeros(n_langs, np.float32))
    if n_langs < 2:
        return net
    index = {lang: i for i, lang in enumerate(languages)}
    x, lengths, of = segments([s for s, _ in snippets])
    label = np.array([index[lang] for _, lang in snippets])[of]
    by_lang = [np.flatnonzero(label == i) for i in range(n_langs)]
    by_lang = [b for b in by_lang if len(b)]
    params = [net.forward.table, net.forward.u, net.forward.b, net.backward.table,
              net.backward.u, net.backward.b, net.out, net.bias]
    first = [np.zeros_like(p) for p in params]
    second = [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        which = rng.integers(0, len(by_lang), BATCH)
        rows = np.array([by_lang[w][rng.integers(len(by_lang[w]))] for w in which])
        xb, y = np.ascontiguousarray(x[rows].T), label[rows]
        mask = (np.arange(SEGMENT)[:, None] < lengths[rows]).astype(np.float32)
        hf, kf = _train_states(net.forward, xb)
        hb, kb = _train_states(net.backward, xb[::-1])
        both = np.concatenate([hf, hb[::-1]], axis=1)  # (T, 2H, B)
        logits = np.matmul(net.out, both) + net.bias[:, None]
        logits -= logits.max(axis=1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=1, keepdims=True)
        p[:, y, np.arange(BATCH)] -= 1
        p *= (mask / mask.sum())[:, None, :]
        dout = np.matmul(p.transpose(0, 2, 1), net.out).transpose(0, 2, 1)
        gout = np.einsum("tlb,thb->lh", p, both, optimize=True)
        grads = [*_backward(net.forward, xb, kf, dout[:, :size]),
                 *_backward(net.backward, xb[::-1], kb, dout[::-1, size:]),
                 gout, p.sum(axis=(0, 2))]
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        rate = 0.02 * min(1.0, 2 * (1 - step / (steps + 1)))
        for q, g, m, v in zip(params, grads, first, second):
            g = g * min(1.0, 1.0 / max(norm, 1e-9))
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            q -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    return net


def sample(docs: DataFrame, lang: Column, learn: Column, per_language: int = SAMPLE_PER_LANGUAGE):
    """The bounded training sample: [(utf-8 snippet, language)].

    ``per_language`` different texts of each language, by hash of the text, so the
    same corpus gives the same sample in any order of rows.  Copies of a text count once.
    """
    text = F.col("text")
    room = F.greatest(F.length(text) - SNIPPET, F.lit(0)) + 1
    known = docs.where(learn & lang.isNotNull() & (F.trim(text) != ""))
    hashed = known.select(lang.alias("l"), F.xxhash64("text", F.lit("sample")).alias("h"),
                          F.substring(text, F.pmod(F.xxhash64("text"), room).cast("int") + 1, F.lit(SNIPPET)).alias("s"))
    # one row per text: few_by_hash's limits hold for different hashes, and copies share theirs
    texts = hashed.groupBy("l", "h").agg(F.min("s").alias("s"))
    rows = few_by_hash(texts, "l", "h", per_language, MAX_LANGUAGES)
    found = rows.orderBy("l", "h", "s").limit(per_language * MAX_LANGUAGES).collect()
    return [(r.s.encode(), r.l) for r in found]


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        net = shared.value
        letter = regex.compile(r"\p{L}").search
        names = np.array([*net.languages, UNDETERMINED], dtype=object)
        for batch in batches:
            at = batch.schema.get_field_index("text")
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                texts = part.column(at).to_pylist()
                known = [bool(net.languages) and t is not None and letter(t) is not None for t in texts]
                p = pooled(net, [t.encode() if ok else b"" for t, ok in zip(texts, known)])
                best = p.argmax(axis=1) if net.languages else np.zeros(len(texts), int)
                score = p.max(axis=1) if net.languages else np.zeros(len(texts))
                best = np.where(known, best, len(names) - 1)
                yield pa.RecordBatch.from_arrays([
                    *(c for i, c in enumerate(part.columns) if i != at),
                    pa.array(names[best].tolist(), pa.string()),
                    pa.array(np.round(np.clip(np.where(known, score, 0), 0, 1), 4))],
                    names=[*(n for n in part.schema.names if n != "text"), "lang_pred", "score"])
    return run


def predict(docs: DataFrame, net: Network, keep: list[str]) -> DataFrame:
    """``keep`` columns plus lang_pred and score; only ``text`` is an input.

    A null text, a text without a letter, and any text when nothing was learned
    is ``und`` with score 0.
    """
    spark = docs.sparkSession
    modest_batches(spark)
    shared = spark.sparkContext.broadcast(net)
    chosen = docs.select(*keep, "text")
    fields = [f for f in chosen.schema.fields[:-1]]
    return chosen.mapInArrow(_score(shared), T.StructType([
        *fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def fit(docs: DataFrame) -> Network:
    """Learn from documents of the folds 0 and 2 that have a language."""
    return train(sample(docs, F.col("lang"), fold(F.col("doc_id")) != 1))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    net = fit(docs.select("doc_id", "text", "lang"))
    return predict(docs.select("doc_id", "text"), net, ["doc_id"]).select(
        "doc_id", F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"),
        "lang_pred", "score")
