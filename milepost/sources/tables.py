"""Source tables (S1) and master-dataset snapshots.

S1 reads the eleven source tables, from parquet folders or over JDBC. The query
itself always runs in Spark (so the scans are pruned and filtered by Catalyst);
a JDBC read is always split on a column so no single task pulls a table.

S2-S4 keep the master dataset as parquet snapshots: every run writes
``<root>/run=<timestamp>`` once and then publishes the small file ``<root>/LATEST``
that names it, by an atomic rename; a reader takes the first existing candidate.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession

from .fixtures import SOURCE_TABLES

POINTER = "LATEST"


def read_parquet_tables(spark: SparkSession, root: str, names=SOURCE_TABLES) -> dict[str, DataFrame]:
    """S1 (files): ``<root>/<name>`` parquet folder per table."""
    return {n: spark.read.parquet(f"{root.rstrip('/')}/{n}") for n in names}


def read_jdbc_tables(spark: SparkSession, url: str, properties: dict,
                     partitioning: dict[str, tuple[str, int, int, int]],
                     names=SOURCE_TABLES) -> dict[str, DataFrame]:
    """S1 (database): one JDBC reader per table.

    ``partitioning`` maps every table to (column, lower, upper, num_partitions), so that
    each is read by many tasks in parallel; a table without it is an error.
    """
    missing = [n for n in names if n not in partitioning]
    if missing:
        raise ValueError(f"no partitioning given for {', '.join(missing)}")
    out = {}
    for n in names:
        col, lo, hi, parts = partitioning[n]
        out[n] = spark.read.jdbc(url, n, column=col, lowerBound=lo, upperBound=hi,
                                 numPartitions=parts, properties=properties)
    return out


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def folder_names(spark: SparkSession, root: str) -> list[str]:
    """Names of the folders under ``root``; none where it doesn't exist."""
    fs, p = _fs(spark, root)
    return [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()] if fs.exists(p) else []


def list_runs(spark: SparkSession, root: str) -> list[str]:
    """Timestamped snapshot folders under ``root``, newest first."""
    runs = sorted((n for n in folder_names(spark, root) if n.startswith("run=")), reverse=True)
    return [f"{root.rstrip('/')}/{n}" for n in runs]


def publish(spark: SparkSession, root: str, run: str) -> None:
    """Make ``run`` the latest: write its name beside the pointer and rename over it."""
    jvm, r = spark.sparkContext._jvm, root.rstrip("/")
    fs, pointer = _fs(spark, f"{r}/{POINTER}")
    fresh = jvm.org.apache.hadoop.fs.Path(f"{r}/_{POINTER}.{run}")
    out = fs.create(fresh, True)
    out.write(bytearray(run.encode()))
    out.close()
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(fs.makeQualified(fresh), fs.makeQualified(pointer), how)


def latest_run(spark: SparkSession, root: str) -> str | None:
    """Folder of the published run, or None."""
    r = root.rstrip("/")
    if not path_exists(spark, f"{r}/{POINTER}"):
        return None
    return f"{r}/run={spark.read.text(f'{r}/{POINTER}').first()[0]}"


def write_snapshot(df: DataFrame, root: str, run: str | None = None) -> str:
    """Write a timestamped run and publish it as the latest; returns the run folder."""
    run = run or _dt.datetime.now().strftime("%Y%m%d_%H%M%S")
    path = f"{root.rstrip('/')}/run={run}"
    df.write.mode("overwrite").parquet(path)
    publish(df.sparkSession, root, run)
    return path


def read_snapshot(spark: SparkSession, root: str, with_runs: bool = True,
                  seed_name: str = "seed") -> DataFrame:
    """S2 (training, ``with_runs=True``) / S3 (scoring): first existing snapshot.

    Candidates in order: the published run, the seed snapshot, then (S2 only) the runs,
    newest first.
    """
    published = latest_run(spark, root)
    paths = [published] if published else []
    paths.append(f"{root.rstrip('/')}/{seed_name}")
    paths += list_runs(spark, root) if with_runs else []
    for p in paths:
        if path_exists(spark, p):
            return spark.read.parquet(p)
    raise FileNotFoundError(f"no master dataset snapshot under {root}")
