"""Importance resampling towards a target corpus.

Every run of one to three words falls into one of ``BUCKETS`` buckets; a bucket's gain is the
scaled log ratio of its smoothed shares in the target and in the corpus. A document's weight
is the sum of its runs' gains, looked up in one array of fixed size (80 KB, broadcast). With a
Gumbel term from a hash of the id the highest scores are a draw without replacement in
proportion to the weights.

The cutoff is selected without a sort: every partition reports the median of its remaining
keys, the median of these weighted by the partitions' remaining sizes is the pivot, one count
tells which side holds the cutoff, and at least a quarter of the remaining keys is discarded
each time, until at most ``LAST`` keys are left and the exact cutoff key is read off. Only a
row per partition reaches the driver. A candidate table is written anew when it has shrunk to
a quarter. The winners alone are range-partitioned, sorted and ranked.

Defined results: null and empty texts have no features, weight 0, and are never drawn; a null
id hashes as an empty text and comes after all ids; rows equal in score and id are drawn in
the order of their feature counts and then in any order, each with its own rank; repeated rows
count each; an empty corpus gives no rows, an empty target gives the corpus's own gains. Only
the id and text columns and those named in ``keep`` are read, so other columns can't clash.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import with_rank
from ..session import cut_lineage, ship_package
from . import crc
from .arrays import LOWER, WORD, column_bytes, pieces, spans

BUCKETS = 10_000
LONGEST = 3
MIN_WORDS = 20
PERCENT = 5
SEED = "42"
LAST = 256
NO_ID = 2**63 - 1


def _bucketed(col: pa.Array):
    """Per run length (text number, bucket) of a column's texts, and the words per text."""
    raw, offsets = column_bytes(col)
    raw = LOWER[raw]
    starts, ends, doc = spans(raw, offsets, WORD)
    n_words = np.bincount(doc, minlength=len(col))
    if not len(doc):
        return [], n_words
    return [(d, (c % np.uint32(BUCKETS)).astype(np.int64))
            for d, c in crc.run_crcs(raw, starts, ends, doc, LONGEST)], n_words


def _count(batches):
    total = np.zeros(BUCKETS, dtype=np.int64)
    for piece in pieces(batches, "text"):
        for _, bucket in _bucketed(piece.column(0))[0]:
            total += np.bincount(bucket, minlength=BUCKETS)
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])],
                                     names=["bucket", "n"])


def bucket_counts(texts: DataFrame, text_col: str = "text") -> np.ndarray:
    """How many runs of all texts fall into each bucket; tasks send at most a row per bucket."""
    ship_package(texts.sparkSession)
    counted = (texts.select(F.col(f"`{text_col}`").alias("text")).mapInArrow(_count, "bucket int, n bigint")
               .groupBy("bucket").agg(F.sum("n").alias("n")))
    out = np.zeros(BUCKETS, dtype=np.int64)
    for r in counted.collect():  # at most BUCKETS rows
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + BUCKETS) / ((s + 1)(T + BUCKETS)))) of every bucket."""
    all_s, all_t = float(corpus.sum()) + BUCKETS, float(target.sum()) + BUCKETS
    return np.array([math.floor(1000 * math.log((t + 1.0) * all_s / ((s + 1.0) * all_t)))
                     for s, t in zip(corpus.tolist(), target.tolist())], dtype=np.int64)


def weighted(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text",
             keep: list[str] | None = None) -> DataFrame:
    """(doc_id, keep..., n_words, n_features, weight, score) of every row, texts scored in place."""
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(gain)
    keep = keep or []

    def run(batches):
        gain = shared.value.astype(np.float64)  # sums stay below 2^53, so they are exact
        for piece in pieces(batches, "text"):
            runs, n_words = _bucketed(piece.column(1))
            n = np.zeros(piece.num_rows, dtype=np.int64)
            weight = np.zeros(piece.num_rows)
            for doc, bucket in runs:
                n += np.bincount(doc, minlength=piece.num_rows)
                weight += np.bincount(doc, weights=gain[bucket], minlength=piece.num_rows)
            yield pa.RecordBatch.from_arrays(
                [piece.column(0), *piece.columns[2:], pa.array(n_words.astype(np.int64)), pa.array(n),
                 pa.array(weight.astype(np.int64))],
                names=["doc_id", *[f"k{i}" for i in range(len(keep))], "n_words", "n_features", "weight"])

    kinds = dict(docs.dtypes)
    schema = ", ".join([f"doc_id {kinds[id_col]}", *[f"k{i} {kinds[c]}" for i, c in enumerate(keep)],
                        "n_words bigint, n_features bigint, weight bigint"])
    out = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"),
                      *[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)]).mapInArrow(run, schema)
    text_id = F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text_id, 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0))))
    return out.withColumn("score", F.col("weight") + gumbel)


def _remaining(pivot):
    """Per partition: how many keys lie before, at and after the pivot, and either side's median."""
    def median(a, b):
        if not len(a):
            return None, None
        i = np.lexsort((b, a))[(len(a) - 1) // 2]
        return int(a[i]), int(b[i])

    def run(batches):
        parts = [(x.column(0).to_numpy(), x.column(1).to_numpy()) for x in batches if x.num_rows]
        if not parts:
            return
        a, b = (np.concatenate(c) for c in zip(*parts))
        if pivot is None:
            before, at = np.ones(len(a), dtype=bool), np.zeros(len(a), dtype=bool)
        else:
            before = (a < pivot[0]) | ((a == pivot[0]) & (b < pivot[1]))
            at = (a == pivot[0]) & (b == pivot[1])
        after = ~(before | at)
        row = [int(before.sum()), *median(a[before], b[before]), int(at.sum()),
               int(after.sum()), *median(a[after], b[after])]
        yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in row], names=REPORT)
    return run


REPORT = ["n_before", "a_before", "b_before", "n_at", "n_after", "a_after", "b_after"]


def _weighted_median(found: list[tuple[tuple[int, int], int]]) -> tuple[int, int]:
    """The key at which half of the weight is reached."""
    half, seen = sum(n for _, n in found) / 2, 0
    for key, n in sorted(found):
        seen += n
        if seen >= half:
            return key
    raise ValueError("no key remains")


def cutoff(keys: DataFrame, n: int, last: int = LAST) -> tuple[int, int] | None:
    """The ``n``-th smallest key (a, b) of ``keys``, by medians of partition medians.

    None where there are fewer than ``n`` keys or ``n`` is 0.
    """
    total = keys.count()
    if not 0 < n <= total:
        return None
    held, stored, left, wanted = keys, total, total, n

    def inside(df, low, high):
        if low is not None:
            df = df.filter((F.col("a") > low[0]) | ((F.col("a") == low[0]) & (F.col("b") > low[1])))
        if high is not None:
            df = df.filter((F.col("a") < high[0]) | ((F.col("a") == high[0]) & (F.col("b") < high[1])))
        return df

    low = high = pivot = None
    side = "before"
    while True:
        found = inside(held, low, high).mapInArrow(
            _remaining(pivot), ", ".join(f"{c} bigint" for c in REPORT)).collect()  # a row per partition
        if pivot is not None:
            before, at = sum(r.n_before for r in found), sum(r.n_at for r in found)
            if wanted <= before:
                side, high, left = "before", pivot, before
            elif wanted <= before + at:
                return pivot
            else:
                side, low, wanted = "after", pivot, wanted - before - at
                left = sum(r.n_after for r in found)
        if left <= last:
            rest = sorted((r.a, r.b) for r in inside(held, low, high).collect())  # at most ``last`` keys
            return rest[wanted - 1]
        pivot = _weighted_median([((r[f"a_{side}"], r[f"b_{side}"]), r[f"n_{side}"])
                                  for r in found if r[f"n_{side}"]])
        if 4 * left <= stored:
            held, stored = cut_lineage(inside(held, low, high)), left


def draw(scored: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS,
         last: int = LAST) -> DataFrame:
    """``scored`` plus ``rank``: 1, 2, 3 ... of the drawn rows, null for the others."""
    rows = cut_lineage(scored.withColumn("__a", -F.col("score")).withColumn(
        "__b", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID))))
    able = F.col("n_words") >= min_words
    n = rows.filter(able).count() * percent // 100
    end = cutoff(rows.filter(able).select(F.col("__a").alias("a"), F.col("__b").alias("b")), n, last)
    if end is None:
        return rows.withColumn("rank", F.lit(None).cast("bigint")).drop("__a", "__b")
    within = able & ((F.col("__a") < end[0]) | ((F.col("__a") == end[0]) & (F.col("__b") <= end[1])))
    won = with_rank(rows.filter(within).withColumn("__none", F.col("doc_id").isNull()),
                    ["__a", "__b", "__none", "n_features"]).withColumn("rank", F.col("rank") + 1)
    rank = F.when(F.col("rank") <= n, F.col("rank")).cast("bigint")
    return (rows.filter(~within).withColumn("rank", F.lit(None).cast("bigint"))
            .unionByName(won.withColumn("rank", rank).drop("__none")).drop("__a", "__b"))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, id_col: str = "doc_id",
             text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Every row's features, weight, score and rank; ``keep`` columns come back as k0, k1 ..."""
    gain = gains(bucket_counts(docs, text_col), bucket_counts(target, text_col))
    return draw(weighted(docs, gain, id_col, text_col, keep), percent)


def op12_importance_resampling(spark, sf_dir: str) -> DataFrame:
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"),
                    spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(
        "doc_id", "n_features", "weight", "score", "rank")
