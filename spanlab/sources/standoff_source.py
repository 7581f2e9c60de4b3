"""Standoff corpora as a Spark data source, in batch and as a stream.

``spark.read.format("standoff").load(folder)`` gives one row per document: the ``.txt`` and the
``.ann`` file of one stem, paired when the files are listed, so that pairing needs no join and a
stream needs no state.  Entities carry their codes, and lines that do not parse are listed beside
them, by the rules of :func:`standoff.parse`.

=================  ============================================================================
doc_name           the files' name without its ending
source_file        the text file (the annotation file where there is no text)
text               null without a text file
entities           array of (id, line_no, label, spans, text, icdo_code); null without annotations
rejected           array of (line_no, reason); line 0 stands for a file that is not UTF-8
=================  ============================================================================

Options: ``path``; ``partitionBytes`` (files of a task are planned up to so many bytes, 16 MB);
``recursive`` (false); ``mode`` (PERMISSIVE, or FAILFAST to raise on a rejected line);
``settleSeconds`` (stream: files younger than this wait for a later batch, 10).  Files whose names
begin with ``_`` or ``.`` are not read; a file of no bytes is an empty text.  Folders are opened by ``pyarrow.fs``.

A stream's offset is the newest modification time it has read.  A pair is read again when one of
its files changes (so also when annotations follow a text later); sinks that keep one version per
document key on ``source_file``.  A file that is put there with a modification time before the
offset, by a copy that keeps times, is not seen.
"""

from __future__ import annotations

import re
import time
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from spanlab.sources.standoff import SPANS

SCHEMA = T.StructType().add("doc_name", "string").add("source_file", "string").add("text", "string").add(
    "entities", T.ArrayType(T.StructType().add("id", "string").add("line_no", "integer").add("label", "string")
                            .add("spans", T.ArrayType(T.StructType().add("start", "integer").add("end", "integer")))
                            .add("text", "string").add("icdo_code", "string"))).add(
    "rejected", T.ArrayType(T.StructType().add("line_no", "integer").add("reason", "string")))
PARTITION_BYTES = 16 << 20
#: Bytes of the files in one Arrow batch.
BATCH_BYTES = 4 << 20
_SPANS = re.compile(SPANS)
_INT_MAX = (1 << 31) - 1


def parse_document(text: str) -> tuple[list[dict], list[dict]]:
    """(entities with codes, rejected lines) of one annotation file.

    Of lines that repeat an entity id the last one stays, in its place by line number; so does the last code.
    """
    entities, notes, rejected = {}, [], []
    for n, line in enumerate(re.split("\r?\n", text), 1):
        parts = line.split("\t", 2)
        if line.startswith("T"):
            label, blank, places = (parts[1] if len(parts) > 1 else "").partition(" ")
            spans = []
            if len(parts) == 3 and blank and _SPANS.match(places):
                spans = [dict(zip(("start", "end"), map(int, p.split(" ")))) for p in places.split(";")]
            if spans and all(0 <= s["start"] <= s["end"] <= _INT_MAX for s in spans):
                entities.pop(parts[0], None)
                entities[parts[0]] = {"id": parts[0], "line_no": n, "label": label, "spans": spans, "text": parts[2],
                                      "icdo_code": None}
            else:
                rejected.append({"line_no": n, "reason": "malformed_entity"})
        elif line.startswith("#"):
            of = parts[1].split(" ", 1) if len(parts) == 3 else []
            if len(of) == 2:
                notes.append((n, of[1], parts[2]))
            else:
                rejected.append({"line_no": n, "reason": "malformed_note"})
    for n, ref, code in notes:
        if ref in entities:
            entities[ref]["icdo_code"] = code
        else:
            rejected.append({"line_no": n, "reason": "dangling_ref"})
    return list(entities.values()), sorted(rejected, key=lambda r: r["line_no"])


class Pairs(InputPartition):
    def __init__(self, pairs: list[tuple]):
        super().__init__(None)
        self.pairs = pairs


class _Folder:
    """What the batch and the stream reader share: listing, planning and reading of pairs."""

    def __init__(self, options: dict):
        if "path" not in options:
            raise ValueError("the standoff source needs a path")
        self.uri = options["path"]
        if self.uri.startswith("file:/") and not self.uri.startswith("file://"):
            self.uri = "file://" + self.uri.removeprefix("file:")
        self.bytes = int(options.get("partitionbytes", PARTITION_BYTES))
        self.recursive = str(options.get("recursive", "false")).lower() == "true"
        self.mode = options.get("mode", "PERMISSIVE")
        if self.mode not in ("PERMISSIVE", "FAILFAST"):
            raise ValueError("mode must be PERMISSIVE or FAILFAST")
        self.settle_ns = int(float(options.get("settleseconds", 10)) * 1e9)

    def store(self) -> tuple[pyarrow.fs.FileSystem, str]:
        if "://" in self.uri:
            return pyarrow.fs.FileSystem.from_uri(self.uri)
        return pyarrow.fs.LocalFileSystem(), self.uri

    def pairs(self) -> list[tuple]:
        """(stem path, text file or None, annotation file or None, bytes, newest modification), sorted."""
        fs, root = self.store()
        found: dict[str, dict] = {}
        for f in fs.get_file_info(pyarrow.fs.FileSelector(root, recursive=self.recursive)):
            stem, dot, kind = f.path.rpartition(".")
            if f.is_file and kind in ("txt", "ann") and not f.base_name.startswith(("_", ".")):
                found.setdefault(stem, {})[kind] = f
        return [(stem, *(files[k].path if k in files else None for k in ("txt", "ann")),
                 sum(f.size or 0 for f in files.values()), max(f.mtime_ns or 0 for f in files.values()))
                for stem, files in sorted(found.items())]

    def plan(self, pairs: list[tuple]) -> list[Pairs]:
        """Neighbours up to ``partitionBytes``; a larger pair is a partition of its own."""
        out, size = [], 0
        for pair in pairs:
            if not out or size + pair[3] > self.bytes:
                out.append(Pairs([]))
                size = 0
            out[-1].pairs.append(pair)
            size += pair[3]
        return out or [Pairs([])]

    def read(self, partition: Pairs) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(SCHEMA)
        fs, _ = self.store()
        rows, size = [], 0
        for pair in partition.pairs:
            rows.append(self._row(fs, *pair[:3]))
            size += pair[3]
            if size >= BATCH_BYTES:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    def _row(self, fs, stem: str, txt: str | None, ann: str | None) -> dict:
        rejected, held = [], {}
        for kind, path in (("text", txt), ("annotation", ann)):
            if path is not None:
                with fs.open_input_stream(path) as f:
                    data = f.read()
                try:
                    held[kind] = data.decode("utf-8")
                except UnicodeDecodeError as error:
                    rejected.append({"line_no": 0, "reason": f"{kind} file is not UTF-8 at byte {error.start}"})
        entities = None
        if "annotation" in held:
            entities, bad = parse_document(held["annotation"])
            rejected += bad
        if rejected and self.mode == "FAILFAST":
            raise ValueError(f"invalid annotation line {stem}:{rejected[0]['line_no']} {rejected[0]['reason']}")
        return {"doc_name": stem.rpartition("/")[2], "source_file": txt or ann, "text": held.get("text"),
                "entities": entities, "rejected": rejected}


class StandoffReader(_Folder, DataSourceReader):
    def partitions(self) -> list[Pairs]:
        return self.plan(self.pairs())


class StandoffStreamReader(_Folder, DataSourceStreamReader):
    def __init__(self, options: dict):
        super().__init__(options)
        self.seen = 0

    def initialOffset(self) -> dict:
        return {"ns": 0}

    def latestOffset(self) -> dict:
        """The newest modification that has settled; it never goes back when files are deleted."""
        ready = time.time_ns() - self.settle_ns
        self.seen = max([self.seen, *(p[4] for p in self.pairs() if p[4] <= ready)])
        return {"ns": self.seen}

    def partitions(self, start: dict, end: dict) -> list[Pairs]:
        self.seen = max(self.seen, start["ns"])  # after a restart
        return self.plan([p for p in self.pairs() if start["ns"] < p[4] <= end["ns"]])


class StandoffSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "standoff"

    def schema(self) -> T.StructType:
        return SCHEMA

    def reader(self, schema: T.StructType) -> StandoffReader:
        return StandoffReader(self.options)

    def streamReader(self, schema: T.StructType) -> StandoffStreamReader:
        return StandoffStreamReader(self.options)


def register(spark: SparkSession) -> None:
    """Make the format ``standoff`` known to the session."""
    spark.dataSource.register(StandoffSource)


def entities(corpus: DataFrame) -> DataFrame:
    """``(doc_name, id, line_no, label, spans, text, icdo_code)``, one row per entity; batch or stream."""
    return corpus.select("doc_name", F.explode("entities").alias("_e")).select("doc_name", "_e.*")


def quarantine(corpus: DataFrame) -> DataFrame:
    """``(doc_name, line_no, reason)``, one row per rejected line; batch or stream."""
    return corpus.select("doc_name", F.explode("rejected").alias("_r")).select("doc_name", "_r.*")


def orphans(corpus: DataFrame) -> DataFrame:
    """Texts without an annotation file, and annotation files without a text, by ``missing``."""
    readable = ~F.exists("rejected", lambda r: r["line_no"] == 0)
    return corpus.where(readable & (F.col("entities").isNull() | F.col("text").isNull())).select(
        "doc_name", F.when(F.col("text").isNull(), "text").otherwise("annotation").alias("missing"))
