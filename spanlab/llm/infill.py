"""Fill-in-the-middle transformation with cuts found in a compressed boundary set.

A text is cut at code points, but sliced as UTF-8 bytes.  The byte offsets at which a
code point starts (and the end) form a set in the manner of Roaring bitmaps: offsets
fall into containers by their high bits, and a container is a sorted array, a bitmap
or a list of runs, whichever is smallest.  Cumulative cardinalities over the
containers find the one that holds the i-th boundary; a select inside it returns the
byte offset.  Two selects give both cuts of a document.

Which units are cut, and the form, follow from a hash of the document's id, so a rerun
gives the same output.
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

from spanlab.llm.common import modest_batches, read

#: Markers of the three parts in the output.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 1
#: Of 100 documents so many stay plain; of 100 others so many put the suffix first.
PLAIN_PERCENT = 10
SPM_PERCENT = 20
#: Offsets of one container.
SPAN = 1 << 16


@dataclass
class Runs:
    starts: np.ndarray  # first offset of every run
    before: np.ndarray  # members in the runs before it

    def select(self, i: int) -> int:
        run = int(np.searchsorted(self.before, i, "right")) - 1
        return int(self.starts[run]) + i - int(self.before[run])


@dataclass
class Array:
    offsets: np.ndarray

    def select(self, i: int) -> int:
        return int(self.offsets[i])


@dataclass
class Bitmap:
    words: np.ndarray  # 8 bytes a row
    before: np.ndarray  # members in the words before

    def select(self, i: int) -> int:
        word = int(np.searchsorted(self.before, i, "right")) - 1
        bits = np.flatnonzero(np.unpackbits(self.words[word], bitorder="little"))
        return word * 64 + int(bits[i - int(self.before[word])])


def container(members: np.ndarray) -> Runs | Array | Bitmap:
    """The smallest container of a boolean mask of up to SPAN offsets with a member at least."""
    edges = np.flatnonzero(np.diff(members, prepend=False, append=False))
    starts, stops = edges[::2], edges[1::2]
    lengths = stops - starts
    n = int(lengths.sum())
    if 4 * len(starts) <= min(2 * n, SPAN // 8):
        return Runs(starts.astype(np.uint16), np.cumsum(lengths) - lengths)
    if 2 * n <= SPAN // 8:
        return Array(np.flatnonzero(members).astype(np.uint16))
    bits = np.zeros(SPAN, bool)
    bits[:len(members)] = members
    words = np.packbits(bits, bitorder="little").reshape(-1, 8)
    ones = np.bitwise_count(words).sum(axis=1, dtype=np.int64)
    return Bitmap(words, np.cumsum(ones) - ones)


class Boundaries:
    """Where code points start in UTF-8 bytes, and where the last one ends."""

    def __init__(self, data: bytes):
        starts = np.ones(len(data) + 1, bool)
        starts[:-1] = (np.frombuffer(data, np.uint8) & 0xC0) != 0x80
        self.containers: list[Runs | Array | Bitmap] = []
        self.bases: list[int] = []
        cards = []
        for base in range(0, len(starts), SPAN):
            part = starts[base:base + SPAN]
            if n := int(np.count_nonzero(part)):
                self.containers.append(container(part))
                self.bases.append(base)
                cards.append(n)
        self.upto = np.cumsum(cards)

    def __len__(self) -> int:
        return int(self.upto[-1])

    def select(self, i: int) -> int:
        """The i-th boundary, from 0, as a byte offset."""
        at = int(np.searchsorted(self.upto, i, "right"))
        return self.bases[at] + self.containers[at].select(i - (int(self.upto[at - 1]) if at else 0))


def draws(doc_id: int | None, seed: int = SEED) -> list[int]:
    """The first four 32-bit words of the document's hash; a null id counts as an empty one."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[i:i + 4], "big") for i in (0, 4, 8, 12)]


def transform(text: str | None, doc_id: int | None, seed: int = SEED, plain_percent: int = PLAIN_PERCENT,
              spm_percent: int = SPM_PERCENT) -> tuple[int, str, int | None, int | None, bytes]:
    """(n, form, prefix_chars, middle_chars, output) of one text."""
    data = (text or "").encode("utf-8", "surrogatepass")
    boundaries = Boundaries(data)
    n = len(boundaries) - 1
    h1, h2, h3, h4 = draws(doc_id, seed)
    marked = any(m.encode() in data for m in (PREFIX, SUFFIX, MIDDLE))
    if not data or marked or h3 % 100 >= 100 - plain_percent:
        return n, "plain", None, None, data
    first, last = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = boundaries.select(first), boundaries.select(last)
    prefix, middle, suffix = data[:a], data[a:b], data[b:]
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    if h4 % 100 < spm_percent:
        return n, "spm", first, last - first, b"".join([s, suffix, p, prefix, m, middle])
    return n, "psm", first, last - first, b"".join([p, prefix, s, suffix, m, middle])


_OUT = T.StructType([T.StructField("n", T.LongType()), T.StructField("form", T.StringType()),
                     T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()),
                     T.StructField("output", T.StringType())])


def fill_in_middle(docs: DataFrame, seed: int = SEED, plain_percent: int = PLAIN_PERCENT,
                   spm_percent: int = SPM_PERCENT) -> DataFrame:
    """``docs`` with n, form, prefix_chars, middle_chars and output for every row.

    ``form`` is ``psm`` (prefix, suffix, middle), ``spm`` (suffix, prefix, middle) or
    ``plain`` (output is the text): empty and null texts, texts that hold a marker, and
    ``plain_percent`` of the rest.  Rows with one doc_id draw the same numbers; a null
    doc_id draws as an empty one.  Columns with the names of the output are replaced.
    """
    modest_batches(docs.sparkSession)
    rest = [f for f in docs.schema.fields if f.name.lower() not in {x.name for x in _OUT}]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = dict(zip(batch.schema.names, batch.columns))
            made = [transform(t.as_py(), i.as_py(), seed, plain_percent, spm_percent)
                    for t, i in zip(columns["text"], columns["doc_id"])]
            cells = list(zip(*made)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [*(columns[f.name] for f in rest), pa.array(cells[0], pa.int64()), pa.array(cells[1], pa.string()),
                 pa.array(cells[2], pa.int64()), pa.array(cells[3], pa.int64()),
                 pa.array(cells[4], pa.binary()).cast(pa.string())],
                names=[*(f.name for f in rest), *_OUT.names])

    return docs.select(*[f.name for f in rest]).mapInArrow(run, T.StructType([*rest, *_OUT.fields]))


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made from."""
    def parts(first: str, second: str) -> list[Column]:
        s, m = F.locate(second, output), F.locate(MIDDLE, output)
        head = len(first) + 1
        return [F.substring(output, F.lit(head), s - head), F.substring(output, s + len(second), m - s - len(second)),
                F.substring(output, m + len(MIDDLE), F.length(output))]

    prefix, suffix, middle = parts(PREFIX, SUFFIX)
    suffix_, prefix_, middle_ = parts(SUFFIX, PREFIX)
    return (F.when(form == "psm", F.concat(prefix, middle, suffix))
            .when(form == "spm", F.concat(prefix_, middle_, suffix_)).otherwise(output))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return fill_in_middle(docs).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


ORACLE_SQL = """
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n,
         sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
words AS (
  SELECT doc_id, t, n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
         ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM drawn),
cut AS (
  SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM words),
parts AS (
  SELECT *, substring(t, 1, a) AS p, substring(t, a + 1, b - a) AS m, substring(t, b + 1) AS s FROM cut)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                        WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE t END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts
"""
