"""Work that outlives one plan: shared intermediate tables and gapless numbering.

Nothing here uses localCheckpoint or a folder of one machine: intermediate
tables are Parquet under the folder named by ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LOCAL_SHARED = "/tmp/checkpoints/catalens"
#: The most bytes that one broadcast may have.
BROADCAST_BYTES = 64 << 20
#: Intermediate tables by thread or task, so that two users of one driver never release each other's.
_written: ContextVar[list[tuple[SparkSession, str] | None]] = ContextVar("written")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only on a local master."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return LOCAL_SHARED


def _tables() -> list[tuple[SparkSession, str] | None]:
    try:
        return _written.get()
    except LookupError:
        _written.set([])
        return _written.get()


def _path(spark: SparkSession, path: str):
    """A path of the cluster's file system, and that file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def passing(spark: SparkSession, path: str) -> str:
    """``path``, to be deleted when the driver ends."""
    p, files = _path(spark, path)
    files.deleteOnExit(p)
    return path


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a cut lineage that lost executors can't undo.

    The table is there until ``release``, or until the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _tables().append((spark, passing(spark, path)))
    return spark.read.schema(df.schema).parquet(path)


def small(written_table: DataFrame, rows: int) -> DataFrame:
    """A written table of narrow rows, marked to be broadcast if it has at most ``rows`` of them.

    ``rows`` comes from ``BROADCAST_BYTES`` and the size of a row. Beyond that the table is
    returned as it is, and a join deals both sides out.
    """
    return F.broadcast(written_table) if written_table.count() <= rows else written_table


def written() -> int:
    """How many intermediate tables this thread has had so far."""
    return len(_tables())


def release(first: int, last: int) -> None:
    """Delete this thread's intermediate tables written between two counts; what reads them must have been written."""
    tables = _tables()
    for k in range(first, min(last, len(tables))):
        if tables[k] is not None:
            p, files = _path(*tables[k])
            files.delete(p, True)
            tables[k] = None


def numbered(df: DataFrame, order: Sequence[str | Column], name: str = "idx") -> DataFrame:
    """Add a gapless long ``name`` from 0 in ``order``, without bringing rows to one task.

    Rows are range-partitioned and sorted once and written; each partition's
    start is the number of rows before it, one small row per partition.
    ``order`` must tell rows apart, or ties fall in any (then fixed) order.
    """
    spark = df.sparkSession
    placed = materialize(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_at")),
        "numbered",
    )
    starts, before = [], 0
    for part, n in sorted(placed.groupBy("_part").count().collect()):
        starts.append((part, before))
        before += n
    table = spark.createDataFrame(starts or [(0, 0)], "_part int, _start long")
    return placed.join(F.broadcast(table), "_part").withColumn(name, F.col("_start") + F.col("_at")).drop("_part", "_at", "_start")
