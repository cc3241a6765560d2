"""Spark session defaults and lineage helpers."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Settings the job relies on. On a cluster the operator passes its own values
# (shuffle partitions sized to the data, spark.checkpoint.dir on shared storage).
JOB_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

_written: dict[str, SparkSession] = {}


def build_session(master: str | None = None, app: str = "milepost",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(JOB_CONF)
    conf["spark.ui.enabled"] = "false"
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


# what a task reads, where the session says nothing: a sort or a hash table of its rows, several
# times their stored size, then stays far below a task's share of an executor at any input size
TASK_SIZES = {
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8MB",
    "spark.sql.files.maxPartitionBytes": "16MB",
}
# partitions that a shuffle is dealt into at least, before AQE merges those below the size above
START_PARTITIONS = 1024


def bound_tasks(spark: SparkSession) -> None:
    """Have more input mean more tasks, not larger ones; a session's own sizes stay."""
    start = max(START_PARTITIONS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    sizes = TASK_SIZES | {"spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(start)}
    for key, size in sizes.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, size)


def shared_dir(spark: SparkSession) -> str:
    """The folder shared by driver and executors: ``spark.checkpoint.dir``.

    Where it is unset, a folder under the session's warehouse is used, which Spark
    itself requires to be shared.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def cut_lineage(df: DataFrame, spark: SparkSession | None = None) -> DataFrame:
    """Write ``df`` once as parquet under the shared folder and read it back.

    The lineage runs exactly once (a reliable RDD checkpoint of an uncached plan
    runs it twice), the written table survives the loss of any executor, and the
    re-read plan carries real file sizes, so the planner's broadcast decisions see
    the true size of small tables. ``drop_tables`` deletes the folders; what is
    left is deleted when the driver ends. ``spark`` names another session of the same
    application that shall own the table.
    """
    spark = spark or df.sparkSession
    path = f"{shared_dir(spark)}/tables/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    _written[path] = spark
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def keep_until_end(spark: SparkSession, path: str) -> str:
    """Have ``drop_tables`` delete ``path``, as the tables of ``cut_lineage``."""
    _written[path] = spark
    return path


def drop_tables(spark: SparkSession) -> int:
    """Delete every table that ``cut_lineage`` wrote in this session; returns their number.

    Call it once the results built on them have been written or collected.
    """
    jvm, hadoop = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    paths = [p for p, s in _written.items() if s is spark]
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(hadoop).delete(path, True)
        del _written[p]
    return len(paths)


@atexit.register
def _drop_all() -> None:
    for spark in set(_written.values()):
        if spark.sparkContext._jsc is not None:
            drop_tables(spark)


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_shipped: set[str] = set()


def ship_package(spark: SparkSession, small_batches: bool = True) -> None:
    """Send this package to the Python workers (once per application).

    With ``small_batches`` rows go to them in batches of at most 1,000 unless the session sets
    another number than Spark's default, so that long texts don't pile up in a worker.
    """
    if small_batches and spark.conf.get(ARROW_ROWS) == "10000":
        spark.conf.set(ARROW_ROWS, "1000")
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="milepost-ship-")) / "milepost_workers.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)
