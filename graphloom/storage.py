"""Shared storage for intermediate tables.

Lineage is cut by writing a table into the folder that driver and executors
share.  The folder is the session's ``spark.checkpoint.dir``; one is made only
where that setting is absent, as in local tests.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_made: list[tuple[SparkSession, str]] = []
_own: list[str] = []
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_root(spark: SparkSession) -> str:
    """Folder shared by driver and executors, from ``spark.checkpoint.dir``."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="graphloom-"))
        root = _own[0]
    return root.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; it is removed when the driver ends."""
    path = f"{shared_root(spark)}/graphloom/{uuid.uuid4().hex}/{name}"
    _made.append((spark, path))
    return path


@contextmanager
def _shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Within it, a query's shuffle files are deleted when it ends, not when the driver's garbage is collected."""
    before = spark.conf.get(_FREE, None)
    spark.conf.set(_FREE, "true")
    try:
        yield
    finally:
        spark.conf.unset(_FREE) if before is None else spark.conf.set(_FREE, before)


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as parquet into the shared folder and read it back.

    The returned frame has no lineage above the written files, so a lost
    executor costs only the tasks that ran on it.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    with _shuffles_freed(spark):
        writer.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._shared_path = path
    return table


#: Rows that a slice of a step holds: bounds the shuffle files that exist at once.
SLICE_ROWS = 4_000_000
SLICE_BYTES = 1 << 27


def plan_slices(df: DataFrame, most: int | None = None) -> int:
    """How many slices a step over a frame is run in, 64 at most, by the bytes of the tables it reads (the estimate of a
    plan with joins is their product); tables of unknown size do not count."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return min(64, slices(sum(x for x in sizes if x < 1 << 60), most or SLICE_BYTES))


def slices(rows: int, most: int | None = None) -> int:
    """How many slices a step over so many rows is run in."""
    return 1 + rows // (most or SLICE_ROWS)


def materialize_slices(df: DataFrame, by: str, n: int, name: str, step: Callable[[DataFrame], DataFrame] = lambda x: x) -> DataFrame:
    """``materialize`` of ``step(df)``, run one after the other on ``n`` parts of ``df`` by the hash of a column, so that
    only one part's shuffle files exist at a time.  The step must treat rows of different ``by`` separately."""
    if n == 1:
        return materialize(step(df), name)
    return materialize_parts((step(df.where(F.pmod(F.xxhash64(by), F.lit(n)) == i)) for i in range(n)), df.sparkSession, name)


def materialize_parts(parts: Iterable[DataFrame], spark: SparkSession, name: str) -> DataFrame:
    """``materialize`` of the union of frames, written one after the other; each is made when the one before it is written."""
    path = shared_path(spark, name)
    for part in parts:
        with _shuffles_freed(spark):
            part.write.mode("append").parquet(path)
    table = spark.read.schema(part.schema).parquet(path)
    table._shared_path = path
    return table


def discard(table: DataFrame) -> None:
    """Delete the files of a frame that ``materialize`` gave, once nothing reads them any more."""
    drop(table.sparkSession, table._shared_path)
    _made.remove((table.sparkSession, table._shared_path))


def drop(spark: SparkSession, path: str) -> None:
    """Delete a path that ``shared_path`` gave, through Hadoop's file system."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target.getParent(), True)


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        try:
            if spark.sparkContext._jsc is not None:
                drop(spark, path)
        except Exception:  # the JVM may be gone already
            return
