"""Toxicity scores: FTRL-proximal logistic regression over hashed n-grams.

Features of a text: the set of its hashed words, word pairs and skip-grams (two words
with one between), lower-cased. The model is fitted by per-coordinate FTRL-proximal
with L1 on a bounded sample of the labelled rows (``TRAIN_ROWS``), read in a fixed
order by one task; L1 leaves a sparse weight vector of at most 2**HASH_BITS entries,
which is broadcast. Every whole text is scored where it lies; nothing else is shuffled.

Defined results: null and empty texts have no feature and get the bias score; repeated
rows get equal scores; several labels of one document count as toxic if any is; labels
of unknown documents are ignored; without labels every score is 0.5 and predicted 1 by
the contract's rule (score >= 0.5); an empty table gives an empty result. Only doc_id,
text and the labels' doc_id and toxic are read, so other columns can't clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .arrays import LOWER, WORD, column_bytes, combined, mixed, pieces, span_hashes, spans

HASH_BITS = 24
TRAIN_ROWS = 24_000   # expected size of the sample of labelled rows
EPOCHS = 6
STEP, SMOOTH, L1, L2 = 0.5, 1.0, 10.0, 0.1


def features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature) of all words, pairs and skip-grams, repeats included."""
    low = LOWER[raw]
    starts, ends, doc = spans(low, offsets, WORD)
    h = span_hashes(low, starts, ends)
    docs, feats = [doc], [mixed(h)]
    for gap, salt in ((1, 11), (2, 13)):
        if len(h) > gap:
            same = doc[gap:] == doc[:-gap]
            docs.append(doc[gap:][same])
            feats.append(combined(h[:-gap][same], h[gap:][same], salt))
    shift = np.uint64(64 - HASH_BITS)
    return np.concatenate(docs), (np.concatenate(feats) >> shift).astype(np.uint32)


def held_out(doc_id: Column, rest: int = 0) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == rest, F.lit(False))


def _featurize(batches):
    for piece in pieces(batches, "text"):
        raw, offsets = column_bytes(piece.column(2))
        doc, feat = features(raw, offsets)
        key = np.unique((doc.astype(np.uint64) << np.uint64(32)) | feat)
        cut = np.searchsorted(key >> np.uint64(32), np.arange(piece.num_rows + 1))
        feat = (key & np.uint64(0xFFFFFFFF)).astype("<u4")
        yield pa.RecordBatch.from_arrays(
            [piece.column(0), piece.column(1),
             pa.array([feat[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary())],
            names=["ord", "toxic", "feats"])


def _fit(batches):
    """One pass of FTRL-proximal per epoch over the sample, in its fixed order."""
    rows = [(y, np.frombuffer(f, "<u4")) for b in batches
            for y, f in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
    z = np.zeros(1 << HASH_BITS, np.float32)
    n = np.zeros(1 << HASH_BITS, np.float32)
    bias_z = bias_n = 0.0

    def weights(zi, ni):
        w = (np.sign(zi) * L1 - zi) / ((SMOOTH + np.sqrt(ni)) / STEP + L2)
        w[np.abs(zi) <= L1] = 0
        return w

    for _ in range(EPOCHS if rows else 0):
        for y, f in rows:
            w = weights(z[f], n[f])
            bias = -bias_z / ((SMOOTH + np.sqrt(bias_n)) / STEP)
            g = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -30, 30))) - y
            grown = n[f] + g * g
            z[f] += g - (np.sqrt(grown) - np.sqrt(n[f])) / STEP * w
            n[f] = grown
            bias_z += g - (np.sqrt(bias_n + g * g) - np.sqrt(bias_n)) / STEP * bias
            bias_n += g * g
    used = np.flatnonzero(np.abs(z) > L1)
    index = np.append(used, -1).astype(np.int64)
    value = np.append(weights(z[used], n[used]), -bias_z / ((SMOOTH + np.sqrt(bias_n)) / STEP))
    yield pa.RecordBatch.from_arrays([pa.array(index), pa.array(value.astype(np.float64))],
                                     names=["index", "weight"])


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS):
    """(indices, weights, bias) learned from the labelled rows that are not held out."""
    ship_package(docs.sparkSession)
    truth = (labels.filter("doc_id is not null and toxic is not null")
             .filter(~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")))
    share = min(1.0, train_rows / max(1, truth.count()))
    order = F.xxhash64("doc_id", F.lit("ftrl"))
    chosen = (truth.withColumn("ord", order)
              .filter(F.pmod("ord", F.lit(1 << 30)) < int(share * (1 << 30))))
    rows = (docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # <= train_rows ids
            .select("ord", "toxic", "text"))
    model = (rows.mapInArrow(_featurize, "ord bigint, toxic int, feats binary")
             .repartition(1).sortWithinPartitions("ord", "feats")
             .mapInArrow(_fit, "index bigint, weight double").toPandas())
    used = model[model["index"] >= 0].sort_values("index")
    return (used["index"].to_numpy(np.uint32), used["weight"].to_numpy(),
            float(model.loc[model["index"] < 0, "weight"].sum()))


def score(docs: DataFrame, model) -> DataFrame:
    """(doc_id, score): probability that the whole text is toxic."""
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        index, weight, bias = shared.value
        hint = np.zeros(1 << 16, dtype=bool)  # low bits of the weights' indices
        hint[index & 0xFFFF] = True
        for piece in pieces(batches, "text"):
            raw, offsets = column_bytes(piece.column(1))
            doc, feat = features(raw, offsets)
            maybe = np.flatnonzero(hint[feat & 0xFFFF])
            doc, feat = doc[maybe], feat[maybe]
            at = np.searchsorted(index, feat)
            at[at == len(index)] = 0
            hit = index[at] == feat if len(index) else np.zeros(0, dtype=bool)
            key = np.unique(doc[hit].astype(np.int64) * max(1, len(index)) + at[hit])
            total = np.bincount(key // max(1, len(index)), minlength=piece.num_rows,
                                weights=weight[key % max(1, len(index))] if len(index) else None)
            p = 1 / (1 + np.exp(-np.clip(total + bias, -30, 30)))
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(p)], names=["doc_id", "score"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))
