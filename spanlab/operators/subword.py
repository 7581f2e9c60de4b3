"""Subword tokens of a given vocabulary, and the windows a model reads.

The vocabulary is a ``tokenizers`` file named by the caller; nothing is trained.  The
driver reads the file once and shares it; a worker builds the tokenizer once for all its
tasks.  Tokens carry code point offsets, so spans align to them like to any other token.

A window holds ``max_length`` ids.  Its first and last real ids are the special ones given,
so that ``max_length - specials`` stay for content (510 of 512, starts 254 apart with a
stride of 256).  Cutting is row-local: token and window arrays are built inside a
document's row, without a shuffle; labels cost one join of documents and their spans.
"""

from __future__ import annotations

import hashlib
import os
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanlab import schemas
from spanlab.operators import tokens as tok

#: A larger vocabulary file is refused, as every executor receives it.
MAX_FILE_BYTES = 64 << 20
#: Characters handed to the tokenizer at a time.
CALL_CHARS = 1 << 20


@lru_cache(maxsize=4)
def _load(digest: str, read):
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks already fill the cores
    t = Tokenizer.from_str(read())
    t.no_truncation()
    t.no_padding()
    t.encode_special_tokens = True  # their strings in a text are ordinary text
    return t


class Vocabulary:
    """A tokenizer file, shared with the workers by a broadcast of its text."""

    def __init__(self, spark: SparkSession, path: str):
        size = os.path.getsize(path)
        if size > MAX_FILE_BYTES:
            raise ValueError(f"{path} has {size} bytes, more than {MAX_FILE_BYTES}")
        with open(path, encoding="utf-8") as f:
            text = f.read()
        self.digest = hashlib.md5(text.encode()).hexdigest()
        self.shared = spark.sparkContext.broadcast(text)

    def _read(self) -> str:
        return self.shared.value

    def __eq__(self, other):
        return isinstance(other, Vocabulary) and self.digest == other.digest

    def __hash__(self):
        return hash(self.digest)

    def tokenizer(self):
        return _load(self.digest, self._read)

    def id(self, token: str) -> int:
        """The id of a (special) token; one that the vocabulary lacks is an error."""
        found = self.tokenizer().token_to_id(token)
        if found is None:
            raise ValueError(f"the vocabulary has no token {token!r}")
        return found

    def arrays(self, text: Column, spans: Column | None = None, surface: bool = True) -> Column:
        """A text as ``array<struct<s,e,id,...>>`` (null: empty).

        With ``surface`` also ``w``, the text between the offsets, and ``word``, the number of the word
        that the tokenizer cuts first.  Blanks that a token has taken in at either side are outside its
        offsets, so a token is contained in the span of its word; a token of blanks alone keeps its own.
        With ``spans`` (``array<struct<ord,start,end,label>>``; null: none) also ``label_id``, as :func:`_labels`.
        """
        fields = ["s", "e", "id"] + (["w", "word"] if surface else []) + (["label_id"] if spans is not None else [])
        kind = T.ArrayType(T.StructType([T.StructField(f, T.StringType() if f == "w" else T.IntegerType())
                                         for f in fields]))

        if spans is None:
            def cut(texts: pa.Array) -> pa.Array:
                return _cut(self.tokenizer(), texts, None, surface)
            return F.arrow_udf(cut, kind)(text)

        def cut_labelled(texts: pa.Array, of: pa.Array) -> pa.Array:
            return _cut(self.tokenizer(), texts, of, surface)
        return F.arrow_udf(cut_labelled, kind)(text, spans)


_BLANK = tok._blank_table()


def _trim(text: str, at: np.ndarray) -> np.ndarray:
    """Offsets without the blanks at their sides, unless there is nothing else."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    blank = _BLANK[np.minimum(points, 0x3001)]
    if not blank.any():
        return at
    place = np.arange(len(points) + 1, dtype=np.int32)
    after = np.minimum.accumulate(np.append(np.where(blank, len(points), place[:-1]), len(points))[::-1])[::-1]
    before = np.maximum.accumulate(np.append(0, np.where(blank, 0, place[1:])))
    s, e = after[at[:, 0]], before[at[:, 1]]
    return np.where((s < e)[:, None], np.stack([s, e], 1), at).astype(np.int32)


def _labels(at: np.ndarray, spans: list[dict] | None) -> np.ndarray:
    """The label ids of a document's tokens.

    A token inside several spans takes the one of the smallest ``ord``; the first token that a span takes
    gets ``B-``, later ones ``I-``.  A span whose label is not in the vocabulary of labels is an error.
    """
    out = np.full(len(at), schemas.LABEL2ID["O"], np.int32)
    if not spans or not len(at):
        return out
    spans = sorted((x for x in spans if x["start"] is not None and x["end"] is not None), key=lambda x: x["ord"])
    starts, ends = (np.array([x[k] for x in spans], np.int64) for k in ("start", "end"))
    owner = np.full(len(at), -1)
    if (np.diff(at, axis=0) >= 0).all():  # the tokens inside a span are neighbours
        lo, hi = np.searchsorted(at[:, 0], starts).tolist(), np.searchsorted(at[:, 1], ends, "right").tolist()
        for k in range(len(spans) - 1, -1, -1):  # the smallest is painted last
            owner[lo[k]:hi[k]] = k
    else:
        for k in range(len(spans) - 1, -1, -1):
            owner[(at[:, 0] >= starts[k]) & (at[:, 1] <= ends[k])] = k
    inside = owner >= 0
    if inside.any():
        begin, go_on = (np.array([schemas.LABEL2ID[f"{x}-{y['label']}"] for y in spans], np.int32) for x in "BI")
        out[inside] = go_on[owner[inside]]
        taken, first = np.unique(np.where(inside, owner, len(spans)), return_index=True)
        real = taken < len(spans)
        out[first[real]] = begin[taken[real]]
    return out


def _cut(tokenizer, texts: pa.Array, spans: pa.Array | None, surface: bool) -> pa.Array:
    strings = [t or "" for t in texts.to_pylist()]
    none = np.zeros(0, np.int32)
    at, ids, words, pieces, labels, counts = [none.reshape(0, 2)], [none], [], [], [none], [0]
    held, chars = [], 0
    for k, text in enumerate(strings):
        held.append(k)
        chars += len(text)
        if chars < CALL_CHARS and k + 1 < len(strings):
            continue
        for d, enc in zip(held, tokenizer.encode_batch([strings[d] for d in held], add_special_tokens=False)):
            n = len(enc)
            counts.append(n)
            ids.append(np.fromiter(enc.ids, np.int32, n))
            own = np.fromiter(chain.from_iterable(enc.offsets), np.int32, 2 * n).reshape(-1, 2)
            own = _trim(strings[d], own) if n else own
            at.append(own)
            if surface:
                words += enc.word_ids
                pieces += [strings[d][a:b] for a, b in own.tolist()]
            if spans is not None:
                labels.append(_labels(own, spans[d].as_py()))
        held, chars = [], 0
    at = np.concatenate(at)
    columns = {"s": pa.array(np.ascontiguousarray(at[:, 0])), "e": pa.array(np.ascontiguousarray(at[:, 1])),
               "id": pa.array(np.concatenate(ids))}
    if surface:
        columns |= {"w": pa.array(pieces, pa.string()), "word": pa.array(words, pa.int32())}
    if spans is not None:
        columns["label_id"] = pa.array(np.concatenate(labels))
    items = pa.StructArray.from_arrays(list(columns.values()), names=list(columns))
    return pa.ListArray.from_arrays(pa.array(np.cumsum(counts).astype(np.int32)), items)


def tokenizer(vocabulary: Vocabulary, text_col: str = "text") -> tok.Tokenizer:
    """The W1 plug-in for :func:`annotate.annotate`, :func:`bio.align` and the window operators:
    ``(doc, i, s, e, w, id, word)``, one row per subword.  Row-local."""
    def tokenize(docs: DataFrame, doc_col: str = "doc_id") -> DataFrame:
        cut = docs.select(F.col(doc_col), F.posexplode(vocabulary.arrays(F.col(text_col))).alias("i", "_t"))
        return cut.select(F.col(doc_col), "i", "_t.s", "_t.e", "_t.w", "_t.id", "_t.word")
    return tokenize


def cut_windows(tokens: Column, max_length: int = 512, stride: int = 256, specials: int = 2) -> Column:
    """A document's token array as the array of its windows, each a slice.

    A token is in ``ceil(content / step)`` slices at most, so this is linear in the document.
    A document without tokens has one empty window (A24).
    """
    content, step = tok.window_geometry(max_length, stride, specials)
    n = tok.n_chunks_expr(F.size(tokens), content, step)
    return F.transform(F.sequence(F.lit(0), n - 1), lambda c: F.slice(tokens, c * step + 1, content))


def model_inputs(windows: DataFrame, begin_id: int | None, end_id: int | None, pad_id: int,
                 max_length: int = 512) -> DataFrame:
    """``tokens`` (and ``labels``) of a window as the arrays a model reads, all of ``max_length``.

    Adds ``input_ids``, ``attention_mask``, ``special_tokens_mask`` and ``offsets`` (0, 0 at special
    and padded places); ``labels`` get the ignore index there.  A window that does not fit is an error.
    """
    begin = [begin_id] if begin_id is not None else []
    end = [end_id] if end_id is not None else []
    k = F.size("tokens")
    room = F.lit(max_length - len(begin) - len(end)) - k
    pad = F.when(room >= 0, room).otherwise(
        F.raise_error(F.concat(F.lit("a window of more tokens than fit: "), k.cast("string"))).cast("int"))

    def framed(first, middle, last, fill):
        lits = lambda values: F.array(*[F.lit(v) for v in values]).cast("array<int>")
        return F.concat(lits(first), middle, lits(last), F.array_repeat(F.lit(fill).cast("int"), pad))

    nowhere = F.struct(F.lit(0).alias("s"), F.lit(0).alias("e"))
    place = F.transform("tokens", lambda t: F.struct(t["s"].alias("s"), t["e"].alias("e")))
    out = windows.withColumns({
        "input_ids": framed(begin, F.transform("tokens", lambda t: t["id"]), end, pad_id),
        "attention_mask": framed([1] * len(begin), F.array_repeat(F.lit(1), k), [1] * len(end), 0),
        "special_tokens_mask": framed([1] * len(begin), F.array_repeat(F.lit(0), k), [1] * len(end), 1),
        "offsets": F.concat(F.array_repeat(nowhere, len(begin)), place, F.array_repeat(nowhere, pad + len(end)))})
    if "labels" in windows.columns:
        ignore = schemas.IGNORE_INDEX
        out = out.withColumn("labels", framed([ignore] * len(begin), F.col("labels").cast("array<int>"),
                                              [ignore] * len(end), ignore))
    return out


def _windows(rows: DataFrame, vocabulary: Vocabulary, begin: str | None, end: str | None, pad: str | None,
             max_length: int, stride: int, *keys: str) -> DataFrame:
    """The windows of the token arrays ``_all``."""
    specials = sum(t is not None for t in (begin, end))
    content, step = tok.window_geometry(max_length, stride, specials)
    out = rows.select(*keys, F.posexplode(cut_windows(F.col("_all"), max_length, stride, specials))
                      .alias("chunk", "tokens"))
    out = out.withColumn("n_overlap", F.when(F.col("chunk") > 0, F.least(F.lit(content - step), F.size("tokens")))
                         .otherwise(0))
    if "label_id" in rows.schema["_all"].dataType.elementType.names:
        # an entity begins once: what the window before holds as well only goes on (Q15)
        again = F.create_map(*[F.lit(schemas.LABEL2ID[x]) for label, i in schemas.LABEL2ID.items()
                               for x in (label, label.replace("B-", "I-", 1) if label.startswith("B-") else label)])
        out = out.withColumn("labels", F.transform("tokens", lambda t, j: F.when(
            j < F.col("n_overlap"), again[t["label_id"]]).otherwise(t["label_id"])))
    ids = [t if t is None else vocabulary.id(t) for t in (begin, end, pad)]
    return model_inputs(out, ids[0], ids[1], ids[2] or 0, max_length)


def encode_windows(docs: DataFrame, vocabulary: Vocabulary, begin: str | None = None, end: str | None = None,
                   pad: str | None = None, max_length: int = 512, stride: int = 256,
                   doc_col: str = "doc_id", text_col: str = "text", surface: bool = False) -> DataFrame:
    """Documents as model windows, one row per window; no shuffle.

    ``(doc, chunk, tokens, n_overlap, input_ids, attention_mask, special_tokens_mask, offsets)``;
    ``n_overlap`` tokens at the front are in the window before as well (W6).  ``begin``, ``end`` and
    ``pad`` name special tokens (no ``begin`` or ``end``: none is put; no ``pad``: id 0).  Rows that
    share a document key stay apart as windows of their own rows.
    """
    cut = docs.select(F.col(doc_col), vocabulary.arrays(F.col(text_col), surface=surface).alias("_all"))
    return _windows(cut, vocabulary, begin, end, pad, max_length, stride, doc_col)


def labelled_windows(docs: DataFrame, spans: DataFrame, vocabulary: Vocabulary, begin: str | None = None,
                     end: str | None = None, pad: str | None = None, max_length: int = 512, stride: int = 256,
                     doc_col: str = "doc_id", text_col: str = "text", surface: bool = False) -> DataFrame:
    """Training windows: the rows of :func:`encode_windows` with ``labels``, the label ids of the subwords
    under the gold spans ``(doc, ord, start, end, label)``.

    One join of documents and their spans on the document key; a row holds the spans of one document beside its
    text, and no token goes through a shuffle.  Special and padded places get the ignore index.
    """
    fields = [F.col(c) for c in ("ord", "start", "end", "label")]
    of = spans.groupBy(doc_col).agg(F.collect_list(F.struct(*fields)).alias("_spans"))
    rows = docs.select(F.col(doc_col), F.col(text_col).alias("_text")).join(of, doc_col, "left")
    cut = rows.select(F.col(doc_col), vocabulary.arrays(F.col("_text"), F.col("_spans"), surface).alias("_all"))
    return _windows(cut, vocabulary, begin, end, pad, max_length, stride, doc_col)
