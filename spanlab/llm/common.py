"""Helpers the operators of this package share."""

from __future__ import annotations

import os
import re
import uuid
import weakref
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanlab.session import checkpoint_dir, freed_shuffles

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def share_package(spark: SparkSession) -> None:
    """Let the Python workers of a local session import this package from any working folder.

    On a cluster the package is deployed with the application (``--py-files``).
    """
    sc = spark.sparkContext
    if sc.master.startswith("local["):
        known = sc.environment.get("PYTHONPATH", "").split(os.pathsep)
        if _ROOT not in known:
            sc.environment["PYTHONPATH"] = os.pathsep.join([_ROOT, *filter(None, known)])


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def row_key() -> dict[str, Column]:
    """A 128-bit key of a document row's doc_id and text, null or not: k1 and k2."""
    return {"k1": F.xxhash64("doc_id", "text"), "k2": F.xxhash64(F.lit("row"), "text", "doc_id")}


def modest_batches(spark: SparkSession) -> None:
    """Arrow batches of whole texts: at most so many rows and bytes at once in a task."""
    for name, most in (("maxRecordsPerBatch", 2000), ("maxBytesPerBatch", 8 << 20)):
        key = f"spark.sql.execution.arrow.{name}"
        have = spark.conf.get(key, None)
        have = int(re.match(r"-?\d+", have)[0]) if have else 0
        if not 0 < have <= most:
            spark.conf.set(key, str(most))


def few_by_hash(rows: DataFrame, group: str, h: str, per_group: int, most_groups: int) -> DataFrame:
    """At most ``per_group`` rows of each of the ``most_groups`` largest groups: those with the
    smallest hashes ``h`` (a long).  A group's hashes are to be different: rows with one hash
    pass or fail together.

    Group sizes set a hash limit that lets through about four times as many rows as
    asked for, so that what is ranked per group does not grow with the input.
    """
    sizes = (rows.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("n"))
             .orderBy(F.desc("n"), group).limit(most_groups).collect())
    if not sizes:
        return rows.limit(0)
    limits = F.create_map(*[F.lit(x) for r in sizes for x in (
        r[0], -(1 << 63) + min((1 << 64) - 1, (4 * per_group << 64) // r[1]))])
    near = rows.where(F.col(h) <= limits[F.col(group)])
    rank = F.row_number().over(Window.partitionBy(group).orderBy(h, *[c for c in rows.columns if c not in (group, h)]))
    return near.withColumn("__rank", rank).where(F.col("__rank") <= per_group).drop("__rank")


def fresh(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_row_key(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """``docs`` with its row key under fresh names, and those names."""
    names = [fresh(docs, k) for k in row_key()]
    return docs.withColumns(dict(zip(names, row_key().values()))), names


def rows_in(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """Rows of ``docs`` whose key is (``left_semi``) or is not (``left_anti``) in the table ``keys`` (k1, k2)."""
    marked, names = with_row_key(docs)
    return marked.join(small(keys.toDF(*names)), names, how).select(*docs.columns)


def materialise(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder and read it back.

    Cuts the lineage: every consumer reads the written rows, which outlive any
    executor.  The folder is the one ``spark.checkpoint.dir`` names.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/spanlab-{what}-{uuid.uuid4().hex}"
    with freed_shuffles(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


#: Where written tables lie, as long as their DataFrame is used.
_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def discard(*tables: DataFrame) -> None:
    """Delete tables of :func:`materialise` whose every consumer has been written."""
    for table in tables:
        spark, path = table.sparkSession, _PATHS.pop(table)
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def bucketed(df: DataFrame, what: str, key: str) -> DataFrame:
    """Write ``df`` as a table bucketed by ``key`` in the shared warehouse and read it back.

    Joins on ``key`` then leave this side where it is.
    """
    spark = df.sparkSession
    name = f"spanlab_{what}_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with freed_shuffles(spark):
        df.write.bucketBy(n, key).option("compression", "zstd").format("parquet").saveAsTable(name)
    return spark.table(name)


#: A written table of at most so many rows, with so many bytes in strings and arrays, is broadcast.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 16 << 20


def _bytes(name: str, kind: T.DataType) -> Column:
    """Bytes of a value of variable width: a string's, or 8 for an element of an array and those of its strings."""
    c = F.col(name)
    if not isinstance(kind, T.ArrayType):
        return F.coalesce(F.octet_length(c), F.lit(0)).cast("long")
    text = F.octet_length(F.concat_ws("", c)) if isinstance(kind.elementType, T.StringType) else F.lit(0)
    return (F.greatest(F.size(c), F.lit(0)) * 8 + text).cast("long")


def small(df: DataFrame) -> DataFrame:
    """``df`` (a written table) with a broadcast hint, if its row count and the bytes of its
    strings and arrays allow; else as it is."""
    wide = [_bytes(f.name, f.dataType) for f in df.schema if isinstance(f.dataType, (T.ArrayType, T.StringType, T.BinaryType))]
    n, size = df.agg(F.count("*"), F.sum(sum(wide, F.lit(0).cast("long")))).first()
    return F.broadcast(df) if n <= BROADCAST_ROWS and (size or 0) <= BROADCAST_BYTES else df


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Consecutive rows with equal keys, across batch borders.

    The caller has hash partitioned and sorted the rows by ``keys``.
    """
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(batch.schema.get_field_index(k)).to_pylist() for k in keys]
        rows = list(zip(*cols))
        start = 0
        for i, key in enumerate(rows):
            if key != last:
                if i > start:
                    held.append(batch.slice(start, i - start))
                if held:
                    yield pa.Table.from_batches(held)
                held, start, last = [], i, key
        held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def components(edges: DataFrame, what: str,
               log: Callable[[int, int], None] | None = None) -> DataFrame:
    """Distributed union-find: ``edges(a, b)`` -> ``(node, root)``.

    Alternates the large-star and small-star steps of Kiveris et al. (SoCC
    2014): every node is linked to the smallest node it sees until the edges
    form stars.  A step is one aggregation (partial sums before the shuffle)
    and one join that Spark may split when a node is hot; no neighbour list is
    collected.  Each round is a written table, so a lost executor costs one
    round at most.  ``root`` is the smallest node of the component; isolated
    nodes do not appear.
    """
    a, b = F.col("a"), F.col("b")
    edges = materialise(
        edges.where(a != b).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct(),
        what)

    def digest(df: DataFrame) -> tuple:
        row = df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return tuple(row)

    before, turn = digest(edges), 0
    while before[0]:
        # large star: every larger neighbour of u goes to the least node around u
        both = edges.union(edges.select(b.alias("a"), a.alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = (both.where(a < b).join(least, "a")
                 .select(F.col("m").alias("a"), "b").where(a != b).distinct())
        # small star: b and its smaller neighbours go to the least of them
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        joined = large.join(least, "b")
        small = (joined.select(F.col("m").alias("a"), F.col("a").alias("b"))
                 .union(joined.select(F.col("m").alias("a"), "b")).where(a != b).distinct())
        last, edges = edges, materialise(small, what)
        discard(last)
        after, turn = digest(edges), turn + 1
        if log:
            log(turn, after[0])
        if after == before:
            break
        before = after
    return edges.select(b.alias("node"), a.alias("root")).union(
        edges.select(a.alias("node"), a.alias("root")).distinct())
