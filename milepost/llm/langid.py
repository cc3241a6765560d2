"""Language identification with a bit-sliced Bloom filter of byte n-grams.

Training counts the 4-byte n-grams of every training text per language (map-side sums,
then one aggregate). A language keeps the n-grams that are frequent in it, both on their
own and against the language where they are most frequent. All languages share one
table: slot s holds a bit mask with one bit per language, an n-gram sets its languages'
bits in HASHES slots, and the AND of these slots returns every language that contains
it. A text's hits per language are popcounts of these masks; the share of false hits
expected from the filter's fill is taken off, and the largest share of hits decides.

The table has 2**SLOT_BITS slots whatever the corpus, 4 bytes per slot for every 32
languages, and is broadcast.

Defined results: null texts and texts without a letter are ``und`` with score 0; rows
without a language, held-out rows and null texts teach nothing; ties go to the first
language by name; a text whose n-grams hit no language gets the language with the most
training n-grams and score 0; with nothing learned every text is ``und``; an empty
table gives an empty result. Only doc_id, text and lang are read (lang for training
rows alone), so other columns can't clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from ..session import cut_lineage, ship_package
from .arrays import LOWER, column_bytes, pieces

GRAM = 4
SLOT_BITS = 21
HASHES = 2
MIN_RATE = 1e-5       # of all n-grams of the language
MIN_RELATIVE = 0.1    # of the n-gram's highest rate in any language
FLUSH = 1 << 20       # distinct (language, n-gram) pairs a task holds before it emits them

_BLANKED = LOWER.copy()
_BLANKED[:0x61] = 0x20
_BLANKED[0x41:0x5B] = LOWER[0x41:0x5B]
_BLANKED[0x7B:0x80] = 0x20


def grams(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, n-gram as 32 bits) of every window of ``GRAM`` bytes with a letter byte.

    ASCII is lower-cased, all ASCII that is no letter becomes a blank, and each text
    stands between blanks, so windows never join two texts.
    """
    lens = np.diff(offsets)
    doc = np.repeat(np.arange(len(lens), dtype=np.int32), lens)
    low = np.full(len(raw) + GRAM * (len(lens) + 1), 0x20, dtype=np.uint8)
    at = np.arange(len(raw), dtype=np.int64) + GRAM * (doc.astype(np.int64) + 1)
    low[at] = _BLANKED[raw]
    owner = np.repeat(np.arange(len(lens), dtype=np.int32), lens + GRAM)
    n = len(low) - GRAM + 1
    g = np.zeros(n, dtype=np.uint32)
    for k in range(GRAM):
        g |= low[k:k + n].astype(np.uint32) << np.uint32(8 * k)
    keep = np.flatnonzero(g != 0x20202020)
    # a window belongs to the text of its first byte that is no blank
    first = keep.copy()
    for _ in range(GRAM - 1):
        first += low[first] == 0x20
    return owner[first], g[keep]


def slots(g: np.ndarray) -> list[np.ndarray]:
    """The Bloom slots of each n-gram."""
    h = g.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return [(h >> np.uint64(64 - SLOT_BITS * (k + 1))) & np.uint64((1 << SLOT_BITS) - 1)
            for k in range(HASHES)]


def _counts(batches):
    """(lang, gram, n) sums of one task, emitted when many have gathered."""
    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def emit():
        for lang, (g, n) in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(g)), pa.array(g.astype(np.int64)), pa.array(n)],
                names=["lang", "gram", "n"])
        held.clear()

    for piece in pieces(batches, "text"):
        langs = piece.column(0).to_pylist()
        names = sorted(set(langs))
        index = np.array([names.index(x) for x in langs], dtype=np.int64)
        doc, g = grams(*column_bytes(piece.column(1)))
        which = index[doc]
        for i, lang in enumerate(names):
            found, n = np.unique(g[which == i], return_counts=True)
            if lang in held:
                both = np.concatenate([held[lang][0], found])
                found, inv = np.unique(both, return_inverse=True)
                n = np.bincount(inv, weights=np.concatenate([held[lang][1], n]).astype(float)).astype(np.int64)
            held[lang] = found, n.astype(np.int64)
        if sum(len(g) for g, _ in held.values()) > FLUSH:
            yield from emit()
    yield from emit()


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(train: DataFrame):
    """Model from (lang, text) rows: names, masks [slot, word], false-hit rates, default."""
    ship_package(train.sparkSession)
    rows = train.filter("lang is not null and text is not null").select("lang", "text")
    counts = cut_lineage(rows.mapInArrow(_counts, "lang string, gram bigint, n bigint")
                         .groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    names = sorted((r.lang, r.total) for r in totals.collect())
    if not names:
        return None
    langs = [x for x, _ in names]
    rate = counts.join(F.broadcast(totals), "lang").withColumn("rate", F.col("n") / F.col("total"))
    top = (rate.filter(F.col("rate") >= MIN_RATE)  # at most 1 / MIN_RATE n-grams a language
           .groupBy("gram").agg(F.collect_list(F.struct("lang", "rate")).alias("r"),
                                F.max("rate").alias("most"))
           .select("gram", F.expr(f"transform(filter(r, x -> x.rate >= {MIN_RELATIVE} * most), "
                                  "x -> x.lang)").alias("langs")))
    words = -(-len(langs) // 32)
    masks = np.zeros((1 << SLOT_BITS, words), dtype=np.uint32)
    kept = top.select("gram", F.explode("langs").alias("lang")).toPandas()
    index = kept["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(np.int64)
    for s in slots(kept["gram"].to_numpy(np.int64).astype(np.uint32)):
        np.bitwise_or.at(masks, (s.astype(np.int64), index // 32),
                         np.uint32(1) << (index % 32).astype(np.uint32))
    fill = [np.mean((masks[:, i // 32] >> np.uint32(i % 32)) & np.uint32(1)) for i in range(len(langs))]
    return langs, masks, np.array(fill) ** HASHES, int(np.argmax([n for _, n in names]))


def _has_letter(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text has a Unicode letter."""
    ascii_letter = ((LOWER[raw] >= 0x61) & (LOWER[raw] <= 0x7A))
    sums = np.concatenate([[0], np.cumsum(ascii_letter)])
    out = sums[offsets[1:]] > sums[offsets[:-1]]
    for i in np.flatnonzero(~out & (offsets[1:] > offsets[:-1])):
        text = raw[offsets[i]:offsets[i + 1]].tobytes().decode("utf-8", "replace")
        out[i] = any(ch.isalpha() for ch in text)
    return out


def predict(raw: np.ndarray, offsets: np.ndarray, model) -> tuple[list[str], np.ndarray]:
    """Language and score (its share of n-grams found, false hits taken off) of each text."""
    n_docs = len(offsets) - 1
    if model is None:
        return ["und"] * n_docs, np.zeros(n_docs)
    langs, masks, false_rate, default = model
    doc, g = grams(raw, offsets)
    total = np.bincount(doc, minlength=n_docs).astype(float)
    found = slots(g)
    share = np.zeros((n_docs, len(langs)))
    for word in range(masks.shape[1]):
        mask = masks[found[0], word]
        for s in found[1:]:
            mask &= masks[s, word]
        for i in range(32 * word, min(len(langs), 32 * word + 32)):
            hits = np.bincount(doc, minlength=n_docs,
                               weights=((mask >> np.uint32(i % 32)) & np.uint32(1)).astype(float))
            true = (hits - total * false_rate[i]) / (1 - false_rate[i])
            share[:, i] = np.clip(true / np.maximum(total, 1), 0, 1)
    best = share.argmax(axis=1)
    score = share[np.arange(n_docs), best]
    best[score == 0] = default
    letters = _has_letter(raw, offsets)
    return ([langs[b] if ok else "und" for b, ok in zip(best, letters)],
            np.where(letters, score, 0.0))


def identify(docs: DataFrame, model) -> DataFrame:
    """``docs`` with the columns lang_pred and score at the end; texts are read whole, in place.

    The columns pass through by position, so a clash of names is no matter.
    """
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)
    at = docs.columns.index("text")
    inner = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])

    def run(batches):
        for piece in pieces(batches, f"c{at}"):
            lang, score = predict(*column_bytes(piece.column(at)), shared.value)
            yield pa.RecordBatch.from_arrays(
                [*piece.columns, pa.array(lang, pa.string()), pa.array(score)],
                names=[*piece.schema.names, "lang_pred", "score"])

    schema = StructType([*inner.schema.fields, StructField("lang_pred", StringType()),
                         StructField("score", DoubleType())])
    return inner.mapInArrow(run, schema).toDF(*docs.columns, "lang_pred", "score")


def model_of(docs: DataFrame):
    return learn(docs.filter(~held_out(F.col("doc_id"))).select("lang", "text"))


def keep_known(docs: DataFrame, model, min_score: float = 0.2) -> DataFrame:
    """The rows of ``docs`` in a known language: not ``und`` and a score of ``min_score``."""
    tagged = identify(docs, model)
    names = [f"c{i}" for i in range(len(docs.columns))]
    return (tagged.toDF(*names, "pred", "score")
            .filter(f"pred <> 'und' and score >= {min_score}").select(*names).toDF(*docs.columns))


def op6_bitmask_langid(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tagged = identify(docs.select("doc_id", "text"), model_of(docs))
    return tagged.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
