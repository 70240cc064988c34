"""Tables that are made once and read many times, in a folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import hashlib
import shutil
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Folders of this process, oldest first.
WRITTEN: list[str] = []
_LOCAL: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only in local mode, where one machine is all there is."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not at:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _LOCAL:
            _LOCAL.append(tempfile.mkdtemp(prefix="tables-"))
            atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
        at = "file://" + _LOCAL[0]
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(at)
    return at


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, removed by :func:`remove` or when the process ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    WRITTEN.append(path)
    return path


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Delete folders of :func:`new_folder`, by the file system that Spark has for them."""
    sc = spark.sparkContext
    for path in paths:
        at = sc._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)
        if path in WRITTEN:
            WRITTEN.remove(path)


@atexit.register
def _leave_nothing() -> None:
    try:
        spark = SparkSession.getActiveSession()
        if spark is not None:
            remove(spark, [p for p in WRITTEN if not (_LOCAL and p.startswith("file://" + _LOCAL[0]))])
    except Exception:  # noqa: BLE001  the session has gone before
        pass


def stored(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """``df`` written and read again: a result that several branches of a plan need is worked out once, and lineage is cut."""
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """``df`` with ``name``: 1, 2, ... in an order, by a range sort and the row counts of its partitions."""
    spark = df.sparkSession
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id())
    placed = stored(spark, placed, "in-order")
    cells = placed.groupBy("__part").agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))  # a row for each partition
    shift = cells.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n") - F.col("__first") + 1).alias("__shift"))
    return placed.join(F.broadcast(shift), "__part").withColumn(name, F.col("__at") + F.col("__shift")).drop("__part", "__at", "__shift")


def version_of(sources: DataFrame) -> str:
    """Changes when a file of the sources is added, removed or replaced."""
    files = spark_files(sources)
    return hashlib.sha256("\n".join(files).encode()).hexdigest()[:16]


def spark_files(df: DataFrame) -> list[str]:
    jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    out = []
    for name in sorted(df.inputFiles()):
        path = jvm.org.apache.hadoop.fs.Path(name)
        s = path.getFileSystem(conf).getFileStatus(path)
        out.append(f"{name} {s.getLen()} {s.getModificationTime()}")
    return out
