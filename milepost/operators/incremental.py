"""Incremental refresh of the master dataset, its counts and its statistics.

* master: changed source rows give the affected project ids; only these projects are
  recomputed, from sources narrowed by semi joins, and merged into the stored master by project
  bucket. A bitmap of the affected keys' hashes, small enough to broadcast, goes before every semi
  join, so most rows of other projects are never shuffled; stored rows that it rules out are copied
  from their bucket's files as they are. A run holds the buckets it rewrote; its index names, for every bucket, the run that
  holds it, and is published by the pointer, so untouched buckets are neither read nor
  written and a reader never sees half a refresh.
* counts: a refreshed forecast changes the (stage, day) counts by -1 / +1 rows of the projects
  that changed, instead of a recount.
* statistics: states (n, mean, M2 and log moments, min, max) per partition of the data, combined
  by Chan's formula.
"""

from __future__ import annotations

import datetime as _dt
import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..constants import GAPS, STAGES
from ..session import cut_lineage
from ..sources.tables import folder_names, latest_run, publish
from .forecast import forecast_long
from .master import master_dataset

BUCKETS = 64
# bits of a bitmap of keys: so many a key, within these bounds (128 KB to 16 MB)
BITS_PER_KEY, LEAST_BITS, MOST_BITS = 16, 1 << 20, 1 << 27
# files a bucket; where a refresh finds more, it deals its rows anew
FILES_PER_BUCKET = 32
INDEX = "_index"
_BUCKET = "project_bucket"
# source table -> the column that leads to its project
_DIRECT = ["project_basic", "notification_37A", "la_notification_master", "three_A_master",
           "three_d_master", "nhai_award", "court_case", "three_A_objections"]


# -- bucketed store ---------------------------------------------------------------------------

def _bucket(buckets: int):
    # of the id's text, so that int and bigint ids fall into the same bucket
    return F.pmod(F.xxhash64(F.col("project_id").cast("string")), F.lit(buckets)).cast("int")


def _write_buckets(rows: DataFrame, root: str, held: dict[int, str], touched: list[int], buckets: int,
                   settled: DataFrame | None = None) -> str:
    """Write a run of ``rows`` and of ``settled``, rows that come from bucket files and need no shuffle."""
    spark = rows.sparkSession
    run = f"{_dt.datetime.now():%Y%m%d_%H%M%S}_{uuid.uuid4().hex[:8]}"
    folder = f"{root.rstrip('/')}/run={run}"
    # one shuffle deals the rows by bucket; a bucket that holds most rows stays splittable by size
    dealt = rows.withColumn(_BUCKET, _bucket(buckets)).repartition(F.col(_BUCKET), F.pmod(F.xxhash64("uwid"), F.lit(8)))
    if settled is not None:
        dealt = settled.withColumn(_BUCKET, _bucket(buckets)).unionByName(dealt)
    (dealt.write.partitionBy(_BUCKET).mode("overwrite").parquet(folder))
    written = {int(n.split("=")[1]) for n in folder_names(spark, folder) if n.startswith(f"{_BUCKET}=")}
    index = {b: r for b, r in held.items() if b not in touched} | {b: run for b in written}
    doc = json.dumps({"buckets": buckets, "schema": rows.schema.json(), "held": index})
    spark.createDataFrame([(doc,)], "doc string").coalesce(1).write.text(f"{folder}/{INDEX}")
    publish(spark, root, run)
    return run


def _index(spark: SparkSession, root: str) -> dict:
    folder = latest_run(spark, root)
    if folder is None:
        raise FileNotFoundError(f"no master is published under {root}")
    doc = json.loads(spark.read.text(f"{folder}/{INDEX}").first()[0])
    return doc | {"held": {int(b): r for b, r in doc["held"].items()}}


def write_master(master: DataFrame, root: str, buckets: int = BUCKETS) -> str:
    """Store a whole master dataset by project bucket; returns the run."""
    return _write_buckets(master, root, {}, list(range(buckets)), buckets)


def read_master(spark: SparkSession, root: str, only: list[int] | None = None) -> DataFrame:
    """The published master, or the given buckets of it; other buckets' files are not listed."""
    from pyspark.sql.types import StructType
    doc = _index(spark, root)
    schema = StructType.fromJson(json.loads(doc["schema"]))
    paths = [f"{root.rstrip('/')}/run={r}/{_BUCKET}={b}" for b, r in sorted(doc["held"].items())
             if only is None or b in only]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


# -- affected projects --------------------------------------------------------------------------

def affected_projects(src: dict[str, DataFrame], changes: dict[str, DataFrame]) -> DataFrame:
    """Distinct project ids whose master rows may differ.

    ``src``: the sources as they are now; ``changes``: table -> changed rows, the old and the new
    images of updates, old images of deletions and new ones of insertions. Details lead to
    their projects through the awards and cases of now and those that changed.
    """
    ids = [changes[t].select("project_id") for t in _DIRECT if t in changes]

    def through(detail: str, parent: str, key: str):
        if detail in changes:
            parents = src[parent].select(key, "project_id")
            if parent in changes:
                parents = parents.unionByName(changes[parent].select(key, "project_id"))
            ids.append(parents.join(changes[detail].select(key).distinct(), key, "left_semi").select("project_id"))
    through("nhai_award_det", "nhai_award", "award_id")
    through("court_case_details", "court_case", "case_id")
    if "AllocationWise" in changes:
        refs = changes["AllocationWise"].select(F.col("PROJECTID").alias("pink_book_ref")).distinct()
        ids.append(src["project_basic"].join(refs, "pink_book_ref", "left_semi").select("project_id"))
    if not ids:
        return src["project_basic"].select("project_id").limit(0)
    out = ids[0]
    for i in ids[1:]:
        out = out.unionByName(i)
    return out.where(F.col("project_id").isNotNull()).distinct()


class KeyBits:
    """A bitmap of the hashes of the keys in ``keys`` (one column), written once and broadcast.

    It rules out rows whose key is not among them without a shuffle; the few others that share a hash
    with one are left to an exact join. Its size is bounded: past 8 million keys it rules out fewer.
    """

    def __init__(self, keys: DataFrame):
        (self.column,), self.type = keys.columns, keys.schema[0].dataType
        wanted = max(1, BITS_PER_KEY * keys.count() - 1).bit_length()
        self.bits = min(max(1 << wanted, LEAST_BITS), MOST_BITS)
        slot = self._slot()
        self.maps = cut_lineage(keys.groupBy(F.bitmap_bucket_number(slot).alias("__map"))
                                .agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("__bits")))

    def _slot(self):
        # in the keys' type, as a join compares them
        return F.pmod(F.xxhash64(F.col(self.column).try_cast(self.type)), F.lit(self.bits))

    def marked(self, rows: DataFrame) -> DataFrame:
        """``rows`` plus ``__may``: false where the row's key is not among the keys for certain."""
        at = F.bitmap_bit_position(self._slot())
        byte = F.conv(F.hex(F.substring("__bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        bit = F.floor(byte / F.pow(F.lit(2), at % 8)) % 2
        return (rows.withColumn("__map", F.bitmap_bucket_number(self._slot()))
                .join(F.broadcast(self.maps), "__map", "left")      # a row per 32,768 bits
                .withColumn("__may", F.coalesce(bit == 1, F.lit(False))).drop("__map", "__bits"))

    def possible(self, rows: DataFrame) -> DataFrame:
        return self.marked(rows).where(F.col("__may")).drop("__may")


def narrowed(src: dict[str, DataFrame], ids: DataFrame, bits: KeyBits | None = None) -> dict[str, DataFrame]:
    """The sources with the rows that the projects ``ids`` need."""
    bits = bits or KeyBits(ids)
    out = {t: bits.possible(src[t]).select(*src[t].columns).join(ids, "project_id", "left_semi") for t in _DIRECT}

    def details(detail: str, parent: str, key: str):
        keys = cut_lineage(out[parent].select(key))
        out[detail] = KeyBits(keys).possible(src[detail]).select(*src[detail].columns).join(keys, key, "left_semi")
    details("nhai_award_det", "nhai_award", "award_id")
    details("court_case_details", "court_case", "case_id")
    out["AllocationWise"] = src["AllocationWise"].join(
        out["project_basic"].select(F.col("pink_book_ref").alias("PROJECTID")), "PROJECTID", "left_semi")
    return out


def refresh_master(src: dict[str, DataFrame], changes: dict[str, DataFrame], root: str) -> DataFrame:
    """Bring the stored master up to ``src``; returns the affected project ids."""
    spark = src["project_basic"].sparkSession
    doc = _index(spark, root)
    buckets = doc["buckets"]
    ids = cut_lineage(affected_projects(src, changes))
    touched = sorted(r[0] for r in ids.select(_bucket(buckets)).distinct().collect())  # at most ``buckets``
    if touched:
        bits = KeyBits(ids)
        fresh = master_dataset(narrowed(src, ids, bits))
        held = read_master(spark, root, touched)
        stored = bits.marked(held)
        kept = stored.where(F.col("__may")).drop("__may").join(ids, "project_id", "left_anti")
        settled = stored.where(~F.col("__may")).drop("__may")
        rows = kept.unionByName(fresh)
        if len(held.inputFiles()) > FILES_PER_BUCKET * len(touched):
            rows, settled = rows.unionByName(settled), None
        _write_buckets(rows, root, doc["held"], touched, buckets, settled)
    return ids


# -- signed counts ------------------------------------------------------------------------------

def count_deltas(old: DataFrame, new: DataFrame) -> DataFrame:
    """(stage_idx, stage_date, cnt): what the counts change by when the forecast rows ``old`` give
    way to ``new``; both hold the rows of the changed projects only."""
    signed = lambda fc, s: forecast_long(fc).where(F.col("stage_date").isNotNull()).select(
        "stage_idx", "stage_date", F.lit(s).cast("bigint").alias("cnt"))
    return merged_counts(signed(old, -1), signed(new, 1))


def merged_counts(*counts: DataFrame) -> DataFrame:
    """The sum of (signed) counts; days that nothing is left of are dropped."""
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out.groupBy("stage_idx", "stage_date").agg(F.sum("cnt").alias("cnt")).where(F.col("cnt") != 0)


# -- mergeable statistics -----------------------------------------------------------------------

STATE = ["n", "mean", "m2", "n_log", "mean_log", "m2_log", "low", "high"]


def statistic_states(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by..., kind, idx, name, n, mean, m2, n_log, mean_log, m2_log, low, high) of the six gaps and
    the six stage durations within each partition ``by`` of the training rows."""
    items, running = [], None
    for k, g in enumerate(GAPS):
        items.append(F.struct(F.lit("gap").alias("kind"), F.lit(k).alias("idx"), F.lit(g).alias("name"),
                              F.col(g).cast("double").alias("v")))
        running = F.col(g) if running is None else running + F.col(g)
        items.append(F.struct(F.lit("stage").alias("kind"), F.lit(k + 1).alias("idx"),
                              F.lit(STAGES[k + 1]).alias("name"), running.cast("double").alias("v")))
    long = rows.select(*by, F.inline(F.array(*items))).where(F.col("v").isNotNull())
    ln = F.ln(F.col("v") + 1)
    return long.groupBy(*by, "kind", "idx", "name").agg(
        F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"), (F.var_pop("v") * F.count("v")).alias("m2"),
        F.count(ln).alias("n_log"), F.avg(ln).alias("mean_log"), (F.var_pop(ln) * F.count(ln)).alias("m2_log"),
        F.min("v").alias("low"), F.max("v").alias("high"))


def combined_states(states: DataFrame) -> DataFrame:
    """(kind, idx, name, n, mean, std, min, max, lognorm_mu, lognorm_sigma) of all states together.

    Chan: M2 = sum of M2 + sum of n (mean - common mean)^2, so no digits cancel. The rows here
    are states, not data: a few per partition.
    """
    key = ["kind", "idx", "name"]
    whole = Window.partitionBy(*key)
    n_log = F.coalesce("n_log", F.lit(0))
    common = states.select(
        "*", (F.sum(F.col("n") * F.col("mean")).over(whole) / F.sum("n").over(whole)).alias("all_mean"),
        F.try_divide(F.sum(n_log * F.col("mean_log")).over(whole), F.sum(n_log).over(whole)).alias("all_log"))
    spread = lambda m2, n, mean, every: F.sum(
        F.col(m2) + F.col(n) * (F.col(mean) - F.col(every)) * (F.col(mean) - F.col(every)))
    std = lambda m2, n: F.when(n > 1, F.sqrt(m2 / (n - 1)))
    return common.groupBy(*key).agg(
        F.sum("n").alias("n"), F.first("all_mean").alias("mean"),
        std(spread("m2", "n", "mean", "all_mean"), F.sum("n")).alias("std"),
        F.min("low").alias("min"), F.max("high").alias("max"), F.first("all_log").alias("lognorm_mu"),
        std(spread("m2_log", "n_log", "mean_log", "all_log"), F.sum("n_log")).alias("lognorm_sigma"))
