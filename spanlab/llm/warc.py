"""WARC archives as a PySpark data source.

    spark.dataSource.register(WarcDataSource)
    records.write.format("warc").mode("append").save(path)
    spark.read.format("warc").load(path).where("record_type = 'response'")

Writing: a task writes its records to files of about ``file_bytes``, each record a
gzip member of its own whose extra field states its length; the driver publishes
the files of successful tasks in a manifest, so the files of lost or repeated
attempts are never read.

Reading: files are planned into partitions.  Equality and membership predicates on
record type and headers are pushed into the scan.  Of a member only the headers are
inflated first; a record that the predicates reject, and any payload when the option
``payload`` is ``false``, is skipped by its stated length without being inflated.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In,
                                    InputPartition, IsNotNull, WriterCommitMessage)
from pyspark.sql.types import StructType

from spanlab.llm.common import read
from spanlab.session import checkpoint_dir

SCHEMA = ("record_id string, record_type string, target_uri string, refers_to string, "
          "payload_digest string, content_length long, payload binary")
#: Columns that are headers: the name in the archive.
HEADERS = {"record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI",
           "refers_to": "WARC-Refers-To", "payload_digest": "WARC-Payload-Digest"}
FILE_BYTES = 64 << 20
#: Files of a partition are planned up to so many bytes.
PARTITION_BYTES = 64 << 20
MIN_REVISIT_BYTES = 1000
_DATE = "1970-01-01T00:00:00Z"


def store(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system and path of a folder's URI."""
    if "://" not in uri and uri.startswith("file:"):
        uri = "file://" + uri.removeprefix("file:")
    if "://" not in uri:
        return pyarrow.fs.LocalFileSystem(), uri
    return pyarrow.fs.FileSystem.from_uri(uri)


def _clean(value: str) -> str:
    """Header values stay on their line."""
    return " ".join(value.split())


def member(record: dict) -> bytes:
    """One record as a gzip member that states its own compressed length."""
    payload = record.get("payload") or b""
    revisit = record.get("record_type") == "revisit"
    http = (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
            + str(len(payload)).encode() + b"\r\n\r\n")
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Date: {_DATE}"]
    for column, header in HEADERS.items():
        if record.get(column) is not None:
            lines.append(f"{header}: {_clean(str(record[column]))}")
    if revisit:
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    head = ("\r\n".join(lines) + "\r\n\r\n").encode()
    data = head + block + b"\r\n\r\n"
    deflate = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    # RFC 1952 extra field: subfield "sl", the lengths of the member and of its data
    size = 10 + 2 + 4 + 16 + len(body) + 8
    extra = b"sl" + struct.pack("<H", 16) + struct.pack("<QQ", size, len(data))
    return (b"\x1f\x8b\x08\x04" + b"\0" * 4 + b"\0\xff" + struct.pack("<H", len(extra)) + extra + body
            + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF))


def _member_start(f) -> tuple[int, int | None] | None:
    """(bytes of the gzip header, stated length of the member) at the file's position."""
    head = f.read(10)
    if not head:
        return None
    if len(head) < 10 or head[:3] != b"\x1f\x8b\x08":
        raise ValueError("no gzip member where a record should start")
    size, stated, flags = 10, None, head[3]
    if flags & 4:
        n = struct.unpack("<H", f.read(2))[0]
        extra = f.read(n)
        size += 2 + n
        at = 0
        while at + 4 <= n:
            length = struct.unpack("<H", extra[at + 2:at + 4])[0]
            if extra[at:at + 2] == b"sl" and length == 16:
                stated = struct.unpack("<Q", extra[at + 4:at + 12])[0]
            at += 4 + length
    for bit in (8, 16):  # name, comment
        if flags & bit:
            while (c := f.read(1)) not in (b"\0", b""):
                size += 1
            size += 1
    if flags & 2:
        f.read(2)
        size += 2
    return size, stated


def records(f, wanted, payload: bool) -> Iterator[tuple]:
    """Rows of SCHEMA from an open archive; ``wanted`` judges the headers."""
    start = 0
    while True:
        f.seek(start)
        opened = _member_start(f)
        if opened is None:
            return
        size, stated = opened
        inflate = zlib.decompressobj(-15)
        data, ended = b"", False
        while b"\r\n\r\n" not in data and not ended:  # headers first
            chunk = inflate.unconsumed_tail or f.read(4096)
            data += inflate.decompress(chunk, 4096)
            ended = inflate.eof or not chunk
        head, _, block = data.partition(b"\r\n\r\n")
        lines = head.decode("utf-8", "replace").split("\r\n")
        headers = dict(line.split(": ", 1) for line in lines[1:] if ": " in line)
        row = {c: headers.get(h) for c, h in HEADERS.items()}
        keep = wanted(row)
        content_length = int(headers.get("Content-Length", 0))
        body = None
        if keep and payload and row["record_type"] != "revisit":
            parts = [block]
            while not inflate.eof:
                chunk = inflate.unconsumed_tail or f.read(1 << 16)
                if not chunk:
                    raise ValueError("an archive ends within a record")
                parts.append(inflate.decompress(chunk))
            body = b"".join(parts)[:content_length].partition(b"\r\n\r\n")[2]
        if keep:
            yield (*row.values(), content_length, body)
        if stated is not None:
            start += stated
            continue
        # a foreign member without a stated length: its end is where inflating ends
        f.seek(start + size)
        inflate = zlib.decompressobj(-15)
        used = 0
        while not inflate.eof:
            chunk = f.read(1 << 16)
            if not chunk:
                return
            tail = chunk
            while tail and not inflate.eof:
                inflate.decompress(tail, 1 << 20)
                tail = inflate.unconsumed_tail
            used += len(chunk)
        start += size + used - len(inflate.unused_data) + 8


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(paths)
        self.paths = paths


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.payload = str(options.get("payload", "true")).lower() != "false"
        self.partition_bytes = int(options.get("partition_bytes", PARTITION_BYTES))
        self.allowed: dict[str, list[frozenset]] = {}
        self.present: set[str] = set()

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            known = isinstance(f, (EqualTo, In, IsNotNull)) and len(f.attribute) == 1 and f.attribute[0] in HEADERS
            if not known:
                yield f
            elif isinstance(f, IsNotNull):
                self.present.add(f.attribute[0])
            else:
                values = [f.value] if isinstance(f, EqualTo) else f.value
                self.allowed.setdefault(f.attribute[0], []).append(frozenset(values))

    def partitions(self) -> list[Files]:
        fs, folder = store(self.path)
        listed = fs.get_file_info(pyarrow.fs.FileSelector(folder, recursive=False, allow_not_found=True))
        size = {f.base_name: f.size for f in listed}
        manifests = sorted(n for n in size if n.startswith("_manifest-"))
        names = sorted(n for n in size if n.endswith((".warc.gz")))
        if manifests:
            published: list[str] = []
            for m in manifests:
                with fs.open_input_stream(f"{folder}/{m}") as f:
                    published += json.loads(f.read())
            names = sorted(published)
        parts: list[list[str]] = []
        held = 0
        for name in names:
            if not parts or held + size[name] > self.partition_bytes:
                parts.append([])
                held = 0
            parts[-1].append(name)
            held += size[name]
        return [Files(p) for p in parts] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        fs, folder = store(self.path)

        def wanted(row: dict) -> bool:
            return (all(row[c] is not None for c in self.present)
                    and all(row[c] in values for c, sets in self.allowed.items() for values in sets))

        for name in partition.paths:
            with fs.open_input_file(f"{folder}/{name}") as f:
                yield from records(f, wanted, self.payload)


class Written(WriterCommitMessage):
    def __init__(self, names: list[str]):
        self.names = names


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.file_bytes = int(options.get("file_bytes", FILE_BYTES))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, folder = store(self.path)
        fs.create_dir(folder, recursive=True)
        names: list[str] = []
        out, size = None, 0
        for batch in iterator:
            for at in range(0, batch.num_rows, 64):
                for record in batch.slice(at, 64).to_pylist():
                    if out is None:
                        names.append(f"part-{uuid.uuid4().hex}.warc.gz")
                        out, size = fs.open_output_stream(f"{folder}/{names[-1]}", compression=None), 0
                    data = member(record)
                    out.write(data)
                    size += len(data)
                    if size >= self.file_bytes:
                        out.close()
                        out = None
        if out is not None:
            out.close()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        fs, folder = store(self.path)
        fs.create_dir(folder, recursive=True)
        names = sorted(n for m in messages if m for n in m.names)
        with fs.open_output_stream(f"{folder}/_manifest-{uuid.uuid4().hex}", compression=None) as f:
            f.write(json.dumps(names).encode())

    def abort(self, messages: list[Written | None]) -> None:
        fs, folder = store(self.path)
        for name in (n for m in messages if m for n in m.names):
            fs.delete_file(f"{folder}/{name}")


class WarcDataSource(DataSource):
    """Options: path, payload (false: headers only), partition_bytes, file_bytes."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        if overwrite:
            raise ValueError("archives are only appended to")
        return WarcWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def to_records(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Records of ``pages`` (page_id, url, html).

    The payload is the html in UTF-8 (null: empty).  Of equal payloads of
    ``min_bytes`` or more the record with the largest page_id is the response and
    the others revisit it; pages with a null id are always responses, and so are
    rows that repeat the largest id.
    """
    pages = pages.select(F.col("page_id"), "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    large = pages.where(F.length("payload") >= min_bytes).where("page_id is not null")
    equal = (large.groupBy(F.sha2("payload", 256).alias("same")).agg(
        F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("same", "first"))
    marked = pages.join(equal, (F.sha2("payload", 256) == F.col("same")) & F.col("page_id").isNotNull(), "left")
    revisit = F.col("first").isNotNull() & (F.col("first") != F.col("page_id"))
    return marked.select(
        F.col("page_id").cast("string").alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.col("url").alias("target_uri"),
        F.when(revisit, F.col("first").cast("string")).alias("refers_to"),
        F.concat(F.lit("sha1:"), F.sha1("payload")).alias("payload_digest"),
        F.length("payload").cast("long").alias("content_length"), "payload")


def write(record_rows: DataFrame, path: str) -> None:
    register(record_rows.sparkSession)
    record_rows.write.format("warc").mode("append").save(path)


def scan(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Records of the archives in a folder.

    Spark keeps pushed predicates with the loaded relation, so one scan is for one set of
    predicates: call this again instead of filtering a scan in two ways within a plan.
    """
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def round_trip(pages: DataFrame, path: str) -> DataFrame:
    """Write the archives, read them back, and report each page from what was read."""
    spark = pages.sparkSession
    id_type = pages.schema["page_id"].dataType.simpleString()
    write(to_records(pages), path)

    def read_responses() -> DataFrame:
        return scan(spark, path).where("record_type = 'response'").select(
            "record_id", F.length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"))

    responses = read_responses()
    revisits = scan(spark, path, payload=False).where("record_type = 'revisit'").select("record_id", "refers_to")
    originals = read_responses().dropDuplicates(["record_id"]).withColumnRenamed("record_id", "original")
    resolved = revisits.join(originals, F.col("refers_to") == F.col("original")).drop("original")
    return (responses.select("*", F.lit("response").alias("record_type"), F.lit(None).cast("string").alias("refers_to"))
            .unionByName(resolved.withColumn("record_type", F.lit("revisit")))
            .select(F.col("record_id").cast(id_type).alias("page_id"), "payload_bytes", "payload_digest",
                    "record_type", F.col("refers_to").cast(id_type).alias("refers_to")))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(read(spark, sf_dir, "pages"),
                      f"{checkpoint_dir(spark)}/spanlab-warc-{uuid.uuid4().hex}")


ORACLE_SQL = f"""
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= {MIN_REVISIT_BYTES} AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= {MIN_REVISIT_BYTES} AND page_id < top THEN top END AS refers_to
FROM (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n, sha1(coalesce(html, '')) AS digest,
             max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top FROM pages)
"""
