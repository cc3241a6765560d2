"""Benchmark decontamination on a stored positional inverted index.

``build_index`` turns the corpus into segments: each row is the complete positional
index of a few hundred documents (sorted term hashes, list heads, positions), written
once as parquet and usable for any later set of test items. A search reads the segments
where they lie. For every phrase it takes the list of the rarest term in the segment,
shifts it to phrase starts, and intersects it with the lists of the other terms, each
shifted by its offset, from rare to frequent. Nothing is grouped by term or phrase, so
no word, passage or copied document can fill one task.

Phrases are collected and broadcast in slices of at most ``SLICE`` (phrase, item)
pairs; each slice is one more pass over the stored index, whatever the benchmark's size.
Terms are 64-bit hashes of whole words.

Defined results: null and empty texts have no words and are clean; items without a word
are no windows; items of fewer words than the window are one window; repeated rows and
repeated doc_ids are judged row by row; empty tables give clean or empty results.
Only doc_id, item_id and text are read, so other columns can't clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, ship_package
from .arrays import LOWER, WORD, column_bytes, pieces, span_hashes, spans

WINDOW = 10
SEGMENT_BYTES = 1 << 20
SLICE = 200_000
_CANDIDATES = 1 << 20  # phrase starts examined at a time
_INDEX = "docs array<{kind}>, first binary, terms binary, heads binary, positions binary"


def _word_hashes(piece: pa.RecordBatch, at: int):
    raw, offsets = column_bytes(piece.column(at))
    low = LOWER[raw]
    starts, ends, doc = spans(low, offsets, WORD)
    return span_hashes(low, starts, ends), doc


def _segments(batches):
    for piece in pieces(batches, "text", SEGMENT_BYTES):
        h, doc = _word_hashes(piece, 1)
        order = np.argsort(h, kind="stable")
        terms, heads = np.unique(h[order], return_index=True)
        first = np.searchsorted(doc, np.arange(piece.num_rows + 1))
        docs = pa.ListArray.from_arrays(pa.array([0, piece.num_rows], pa.int32()), piece.column(0))
        yield pa.RecordBatch.from_arrays(
            [docs, *(pa.array([x.tobytes()], pa.binary()) for x in (
                first.astype("<u4"), terms.astype("<u8"), heads.astype("<u4"), order.astype("<u4")))],
            names=["docs", "first", "terms", "heads", "positions"])


def build_index(docs: DataFrame) -> DataFrame:
    """The stored index of ``docs`` (doc_id, text): one row per segment, with a fixed number."""
    ship_package(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", "text").mapInArrow(_segments, _INDEX.format(kind=kind))
    return cut_lineage(rows.withColumn("segment", F.monotonically_increasing_id()))


class Segment:
    """One row of the index as arrays."""

    def __init__(self, first: bytes, terms: bytes, heads: bytes, positions: bytes):
        self.first = np.frombuffer(first, "<u4").astype(np.int64)
        self.terms = np.frombuffer(terms, "<u8")
        self.positions = np.frombuffer(positions, "<u4")
        self.heads = np.append(np.frombuffer(heads, "<u4"), len(self.positions)).astype(np.int64)
        # (term, position) as one sorted key: membership in any list is one search
        term = np.repeat(np.arange(len(self.terms), dtype=np.uint64), np.diff(self.heads))
        self.keys = (term << np.uint64(32)) | self.positions

    def rank(self, terms: np.ndarray) -> np.ndarray:
        """Number of each term's list, or -1 where the segment lacks the term."""
        if not len(self.terms):
            return np.full(terms.shape, -1, dtype=np.int64)
        at = np.searchsorted(self.terms, terms)
        at[at == len(self.terms)] = 0
        return np.where(self.terms[at] == terms, at, -1)

    def has(self, rank: np.ndarray, position: np.ndarray) -> np.ndarray:
        key = (rank.astype(np.uint64) << np.uint64(32)) | position.astype(np.uint64)
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return (position >= 0) & (self.keys[at] == key)

    def document(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, position, side="right") - 1

    def phrases(self, terms: np.ndarray):
        """(phrase number, start) of all occurrences of equally long phrases [phrase, offset]."""
        rank = self.rank(terms)
        whole = np.flatnonzero((rank >= 0).all(axis=1))
        rank = rank[whole]
        size = np.diff(self.heads)[rank]
        order = np.argsort(size, axis=1, kind="stable")  # offsets from rare to frequent
        rows = np.arange(len(whole))
        rarest = order[:, 0] if len(whole) else np.zeros(0, np.int64)
        counts = size[rows, rarest]
        ends = np.cumsum(counts)
        length, lo = terms.shape[1], 0
        while lo < len(whole):
            taken = ends[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, taken + _CANDIDATES, side="right")))
            n = counts[lo:hi]
            phrase = np.repeat(np.arange(lo, hi), n)
            nth = np.arange(len(phrase)) - np.repeat(np.cumsum(n) - n, n)
            listed = self.heads[rank[phrase, rarest[phrase]]] + nth
            start = self.positions[listed].astype(np.int64) - rarest[phrase]
            for j in range(1, length):
                offset = order[phrase, j]
                ok = self.has(rank[phrase, offset], start + offset)
                phrase, start = phrase[ok], start[ok]
            inside = (start >= 0) & (self.document(start) == self.document(start + length - 1))
            yield whole[phrase[inside]], start[inside]
            lo = hi

    def near(self, terms: np.ndarray, width: int) -> np.ndarray:
        """Starts of spans of at most ``width`` words that hold all of ``terms`` in any order."""
        rank = self.rank(np.unique(terms))
        if not len(rank) or (rank < 0).any():
            return np.zeros(0, np.int64)
        lists = sorted((self.positions[self.heads[r]:self.heads[r + 1]].astype(np.int64) for r in rank),
                       key=len)
        around = lists[0][:, None] - np.arange(width)[None, :]
        starts = np.unique(around[around >= 0])
        begins = np.zeros(len(starts), dtype=bool)
        reach = starts.copy()
        for places in lists:
            at = np.searchsorted(places, starts)
            ok = at < len(places)
            starts, begins, reach, at = starts[ok], begins[ok], reach[ok], at[ok]
            begins |= places[at] == starts
            reach = np.maximum(reach, places[at])
        ok = begins & (reach - starts < width)
        starts, reach = starts[ok], reach[ok]
        return starts[self.document(starts) == self.document(reach)]


def windows(items: DataFrame, length: int = WINDOW) -> DataFrame:
    """(item_id, terms) of the distinct windows of each item; terms are packed hashes."""
    ship_package(items.sparkSession)
    kind = dict(items.dtypes)["item_id"]

    def run(batches):
        for piece in pieces(batches, "text"):
            h, doc = _word_hashes(piece, 1)
            first = np.searchsorted(doc, np.arange(piece.num_rows + 1))
            rows, packed = [], []
            for i, (a, b) in enumerate(zip(first[:-1], first[1:])):
                for s in range(a, max(a + 1, b - length + 1) if b > a else a):
                    rows.append(i)
                    packed.append(h[s:min(b, s + length)].astype("<u8").tobytes())
            yield pa.RecordBatch.from_arrays(
                [piece.column(0).take(pa.array(rows, pa.int64())), pa.array(packed, pa.binary())],
                names=["item_id", "terms"])

    return (items.select("item_id", "text").mapInArrow(run, f"item_id {kind}, terms binary").distinct())


def _hits(index: DataFrame, terms: list[bytes], items: list[str], kind: str) -> DataFrame:
    """One pass of one slice: per document its hit spans and the items found."""
    by_length: dict[int, list[int]] = {}
    for i, t in enumerate(terms):
        by_length.setdefault(len(t) // 8, []).append(i)
    groups = []
    for length, which in by_length.items():
        packed = np.frombuffer(b"".join(terms[i] for i in which), "<u8").reshape(-1, length)
        phrase, inverse = np.unique(packed, axis=0, return_inverse=True)
        inverse = inverse.reshape(-1)
        order = np.argsort(inverse, kind="stable")
        groups.append((phrase, np.searchsorted(inverse[order], np.arange(len(phrase) + 1)),
                       np.array(which)[order]))
    shared = index.sparkSession.sparkContext.broadcast((groups, items))

    def run(batches):
        groups, items = shared.value
        for batch in batches:
            for row in range(batch.num_rows):
                segment, first, terms, heads, positions = (
                    batch.column(i)[row].as_py() for i in (0, 2, 3, 4, 5))
                seg = Segment(first, terms, heads, positions)
                ids = batch.column(1)[row].values
                spans_of: dict[int, dict[int, int]] = {}
                found: dict[int, set[int]] = {}
                for phrases, head, members in groups:
                    length = phrases.shape[1]
                    for phrase, start in seg.phrases(phrases):
                        doc = seg.document(start)
                        at = start - seg.first[doc]
                        for d, s in np.unique(np.stack([doc, at], axis=1), axis=0).tolist():
                            held = spans_of.setdefault(d, {})
                            held[s] = max(held.get(s, 0), s + length)
                        for d, p in np.unique(np.stack([doc, phrase], axis=1), axis=0).tolist():
                            found.setdefault(d, set()).update(members[head[p]:head[p + 1]].tolist())
                n = len(ids)
                out_spans, out_items = [], []
                for d in range(n):
                    merged: list[dict] = []
                    for s, e in sorted(spans_of.get(d, {}).items()):
                        if merged and s <= merged[-1]["upto"]:
                            merged[-1]["upto"] = max(e, merged[-1]["upto"])
                        else:
                            merged.append({"start": s, "upto": e})
                    out_spans.append(merged)
                    out_items.append(sorted({items[i] for i in found.get(d, ())}))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([segment] * n, pa.int64()), pa.array(range(n), pa.int32()), ids,
                     pa.array(np.diff(seg.first)),
                     pa.array(out_spans, pa.list_(pa.struct([("start", pa.int32()), ("upto", pa.int32())]))),
                     pa.array(out_items, pa.list_(pa.string()))],
                    names=["segment", "ord", "doc_id", "n_words", "spans", "items"])

    return index.select("segment", "docs", "first", "terms", "heads", "positions").mapInArrow(
        run, f"segment bigint, ord int, doc_id {kind}, n_words bigint, "
             "spans array<struct<start:int,upto:int>>, items array<string>")


def search(index: DataFrame, phrases: DataFrame, kind: str = "bigint") -> DataFrame:
    """(doc_id, n_words, spans, items) of every document: word spans hit, sorted items found.

    ``phrases``: (item_id, terms) as from ``windows``. Adjoining spans are merged.
    """
    phrases = cut_lineage(phrases)
    slices = max(1, -(-phrases.count() // SLICE))
    passes = None
    for s in range(slices):
        rows = phrases.filter(F.pmod(F.xxhash64("item_id", "terms"), F.lit(slices)) == s).collect()
        part = _hits(index, [bytes(r.terms) for r in rows],
                     [str(r.item_id) for r in rows], kind)
        passes = part if passes is None else passes.unionByName(part)
    merged = passes.groupBy("segment", "ord").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"),
        F.sort_array(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return merged.drop("segment", "ord")


def near_matches(index: DataFrame, phrases: DataFrame, width: int, kind: str = "bigint") -> DataFrame:
    """(item_id, doc_id, start): spans of at most ``width`` words with all terms of a phrase."""
    spark = index.sparkSession
    item_kind = dict(phrases.dtypes)["item_id"]
    phrases = cut_lineage(phrases)
    slices = max(1, -(-phrases.count() // SLICE))
    out = None
    for s in range(slices):
        rows = phrases.filter(F.pmod(F.xxhash64("item_id", "terms"), F.lit(slices)) == s).collect()
        shared = spark.sparkContext.broadcast([(r.item_id, bytes(r.terms)) for r in rows])

        def run(batches, shared=shared):
            for batch in batches:
                for row in range(batch.num_rows):
                    first, terms, heads, positions = (
                        batch.column(i)[row].as_py() for i in range(1, 5))
                    seg = Segment(first, terms, heads, positions)
                    ids = batch.column(0)[row].values
                    for item, packed in shared.value:
                        at = seg.near(np.frombuffer(packed, "<u8"), width)
                        doc = seg.document(at)
                        if not len(at):
                            continue
                        yield pa.RecordBatch.from_pydict(
                            {"item_id": [item] * len(at), "doc_id": ids.take(pa.array(doc)),
                             "start": pa.array(at - seg.first[doc])})

        part = index.select("docs", "first", "terms", "heads", "positions").mapInArrow(
            run, f"item_id {item_kind}, doc_id {kind}, start bigint")
        out = part if out is None else out.unionByName(part)
    return out


def _covered():
    """Words in the union of the spans (sorted by start)."""
    return F.expr("aggregate(spans, struct(0L as n, 0 as upto), (a, s) -> struct("
                  "a.n + greatest(0, s.upto - greatest(s.start, a.upto)) as n, "
                  "greatest(s.upto, a.upto) as upto), a -> a.n)")


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: its words, the words hit by benchmark windows, the items."""
    hits = search(build_index(docs), windows(items, window), dict(docs.dtypes)["doc_id"])
    covered = _covered()
    return hits.select(
        "doc_id", "n_words", covered.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (covered > 0).alias("contaminated"), "spans", "items")


def keep_clean(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` that hold no window of ``items``.

    Rows are told apart by a hash of doc_id and text; repeated rows share it and their verdict.
    """
    key = F.xxhash64("doc_id", "text")
    found = contamination(docs.select(key.alias("doc_id"), "text"), items, window)
    bad = cut_lineage(found.filter("contaminated").select(F.col("doc_id").alias("_k")).distinct())
    names = [f"c{i}" for i in range(len(docs.columns))]
    inner = docs.withColumn("_k", key).toDF(*names, "_k")
    return inner.join(bad, "_k", "left_anti").select(*names).toDF(*docs.columns)


def op4_positional_index(spark, sf_dir: str) -> DataFrame:
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"),
                         spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("spans", "items")
