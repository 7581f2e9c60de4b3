"""Session helpers.

The library never owns the cluster session; these helpers only build a local
one for tests and benchmarks, and find the shared checkpoint folder.
"""

from __future__ import annotations

import contextlib
import os
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "spanlab") -> SparkSession:
    """A local session for tests/bench (never used on a cluster)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("SPANLAB_DRIVER_MEMORY", "16g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    share_package(spark)
    configure(spark)
    return spark


#: Rows and bytes of an Arrow batch.
ARROW_ROWS, ARROW_BYTES = 1000, 8 << 20


def configure(spark: SparkSession) -> None:
    """Session settings the operators are designed around.

    * co-partitioning on a subset of join keys: our per-document plans are
      hash partitioned on ``doc_id`` once; joins on ``(doc_id, label)`` can
      reuse that layout instead of shuffling again;
    * union output partitioning off (see below);
    * Arrow batches bounded in rows and bytes: a Python worker holds a batch of texts and
      its tokens, which must not grow with the partition.
    """
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    # Broadcast only on measured sizes.  The static planner estimates from file
    # sizes and does not scale through explode, so a 2 MB text table exploded
    # into tokens x n-grams was once broadcast at > 1 GB.  AQE decides after the
    # shuffle map stage, on the bytes actually written; explicit broadcast()
    # hints (label vocabulary, bucket offsets: bounded by construction) still apply.
    adaptive = spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold", None)
    if not adaptive:
        static = spark.conf.get("spark.sql.autoBroadcastJoinThreshold", "10485760")
        spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold",
                       static if static.strip() != "-1" else "10485760")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    # A union of hash-partitioned children must not claim their partitioning:
    # combined with the relaxed co-partitioning above it can yield a plan whose
    # RDD partition counts disagree.  The cost is one small shuffle after unions.
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    for name, most in (("maxRecordsPerBatch", ARROW_ROWS), ("maxBytesPerBatch", ARROW_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = re.fullmatch(r"(-?\d+)b?", spark.conf.get(key))  # one with a unit is the caller's choice
        if now and not 0 < int(now[1]) < most:
            spark.conf.set(key, str(most))


_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def share_package(spark: SparkSession) -> None:
    """Let the Python workers of a local session import this package from any working folder.

    On a cluster the package is deployed with the application (``--py-files``).
    """
    sc = spark.sparkContext
    if sc.master.startswith("local["):
        known = sc.environment.get("PYTHONPATH", "").split(os.pathsep)
        if _ROOT not in known:
            sc.environment["PYTHONPATH"] = os.pathsep.join([_ROOT, *filter(None, known)])


_KEPT: list[DataFrame] = []
_SCRATCH: list[DataFrame] = []


def keep(df: DataFrame) -> DataFrame:
    """Persist an intermediate that several consumers of one plan read.

    ``MEMORY_AND_DISK``: lost blocks are recomputed from lineage.  For narrow tables
    only (entities, matches), never for exploded tokens.  :func:`release` frees
    them once the results are written.
    """
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    _KEPT.append(df)
    return df


def release() -> None:
    """Unpersist everything that :func:`keep` holds in this process, and delete the tables of :func:`scratch`."""
    while _KEPT:
        _KEPT.pop().unpersist()
    while _SCRATCH:
        drop_written(_SCRATCH.pop())


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster.

    Read ``spark.checkpoint.dir`` from the session; only when it is unset (as in
    local tests) create one under the system temp folder and register it.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() if hasattr(sc, "getCheckpointDir") else None
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return conf_dir
    master = sc.master or ""
    if not master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; a shared folder is required on a cluster"
        )
    local_dir = tempfile.mkdtemp(prefix="spanlab-ckpt-")
    sc.setCheckpointDir(local_dir)
    return local_dir


@contextlib.contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a query go when it has ended, not when the driver's garbage collector finds out."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def written(df: DataFrame) -> DataFrame:
    """``df`` written under the shared checkpoint folder and read back: an intermediate that many jobs
    read and that outlives lost executors.  :func:`drop_written` frees it.

    The shuffle files of the plan that made it are freed: else those of all written steps of a query
    lie on the disks at once."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/written-{uuid.uuid4().hex}"
    with freed_shuffles(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch(df: DataFrame) -> DataFrame:
    """:func:`written`, and freed by :func:`release`: for intermediates of a plan that grow with its input."""
    df = written(df)
    _SCRATCH.append(df)
    return df


def drop_written(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`written`, after its last reader."""
    spark = df.sparkSession
    for folder in {os.path.dirname(f) for f in df.inputFiles()}:
        if os.path.basename(folder).startswith("written-"):
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
