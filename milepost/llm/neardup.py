"""N-gram Jaccard join: MinHash banding, verification on the full n-gram sets.

Documents are sets of hashed word n-grams. Equal sets are merged to one representative.
Each representative has one key per band of MinHash rows; band and row counts follow from
the similarity threshold and the target recall (``bands_for``). Buckets of equal keys are
never expanded into pairs: each member is tied to the bucket's smallest member, and the
connected components of these ties are the candidate clusters, which hold every candidate
pair. Each cluster's sets are brought together once; a cluster of more than
``BLOCK_NGRAMS`` n-grams is dealt into blocks and every pair of blocks is a task's group,
so no task holds an unbounded cluster. In a group all pairs are compared on their full
sets as bit rows; a document gets its number of links and the group's links are handed on
as a forest, from which the final classes are connected.

Defined results: words are lower-cased runs of letters, digits and bytes above 0x7F; a
text of fewer words than the n-gram length, but not none, is one n-gram; null texts and
texts without words have no links and a class of their own; equal texts and repeated rows
are linked; a class is named by its smallest doc_id (null ids are no names); an empty
table gives an empty result. Only doc_id and text are read, so other columns can't clash.
A link is lost only where all bands miss it: at most 1 - RECALL of the links at the
threshold itself, fewer above.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, ship_package
from .arrays import LOWER, WORD, column_bytes, mixed, pieces, span_hashes, spans

NGRAM = 5
SIMILARITY = (4, 5)     # 0.8 as a fraction, so that the test is exact
RECALL = 0.9999         # of links at the threshold
ROWS = 5                # MinHash rows of a band
BLOCK_NGRAMS = 300_000  # n-grams in a block of a large cluster
_WEIGHTS = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA24BAED4963EE407,
            0x9FB21C651E98DF25]
_U = np.uint64


def bands_for(similarity: float, rows: int, recall: float) -> int:
    """Fewest bands that catch a pair of this similarity with probability ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity ** rows))


def ngram_sets(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of all texts, sorted inside each text, and the n + 1 offsets."""
    low = LOWER[raw]
    starts, ends, doc = spans(low, offsets, WORD)
    h = span_hashes(low, starts, ends)
    n = len(offsets) - 1
    first = np.searchsorted(doc, np.arange(n + 1))
    count = np.diff(first)
    padded = np.concatenate([h, np.zeros(NGRAM, _U)])
    gram = np.zeros(len(h), dtype=_U)
    left = first[1:][doc] - np.arange(len(h))  # words from here to the end of the text
    for k in range(NGRAM):
        gram += np.where(left > k, padded[k:k + len(h)], _U(0)) * _U(_WEIGHTS[k])
    keep = (left >= NGRAM) | ((count[doc] < NGRAM) & (left == count[doc]))
    gram, doc = mixed(gram[keep]), doc[keep]
    order = np.lexsort((gram, doc))
    gram, doc = gram[order], doc[order]
    new = np.ones(len(gram), dtype=bool)
    new[1:] = (gram[1:] != gram[:-1]) | (doc[1:] != doc[:-1])
    gram, doc = gram[new], doc[new]
    return gram, np.searchsorted(doc, np.arange(n + 1))


def band_keys(gram: np.ndarray, offsets: np.ndarray, bands: int) -> np.ndarray:
    """[text, band] keys; texts must have n-grams."""
    rng = np.random.default_rng(20_011)
    keys = np.zeros((len(offsets) - 1, bands), dtype=_U)
    for b in range(bands):
        key = np.full(len(offsets) - 1, b + 1, dtype=_U)
        for _ in range(ROWS):
            a, c = (int(x) for x in rng.integers(1, 1 << 63, 2))
            least = np.minimum.reduceat((gram * _U(2 * a + 1 & (1 << 64) - 1) + _U(c)) >> _U(32), offsets[:-1])
            key = mixed(key * _U(_WEIGHTS[0]) + least)
        keys[:, b] = key
    return keys


def _row_key():
    return F.xxhash64("doc_id", "text")


def sketches(docs: DataFrame, bands: int) -> DataFrame:
    """(k, doc_id, same, n, keys): row key, hash of the n-gram set, its size, band keys."""
    ship_package(docs.sparkSession)

    def run(batches):
        for piece in pieces(batches, "text"):
            gram, offsets = ngram_sets(*column_bytes(piece.column(2)))
            size = np.diff(offsets)
            held = np.flatnonzero(size > 0)
            same = np.zeros(len(size), dtype=_U)
            keys = np.zeros((0, bands), dtype=_U)
            if len(held):
                starts = offsets[:-1][held]
                same[held] = mixed(np.add.reduceat(mixed(gram + _U(1)), starts)) ^ size[held].astype(_U)
                keys = band_keys(gram, np.append(starts, len(gram)), bands)
            per = np.where(size > 0, bands, 0)
            yield pa.RecordBatch.from_arrays(
                [piece.column(0), piece.column(1), pa.array(same.view(np.int64), mask=size == 0),
                 pa.array(size.astype(np.int64)),
                 pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per)]).astype(np.int32)),
                                          pa.array(keys.ravel().view(np.int64)))],
                names=["k", "doc_id", "same", "n", "keys"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select(_row_key().alias("k"), "doc_id", "text").mapInArrow(
        run, f"k bigint, doc_id {kind}, same bigint, n bigint, keys array<bigint>")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the undirected ``edges`` (a, b); a component is its least node.

    Every round each node takes the least label around it, then its label's label; rounds
    end when no label changes. Labels are sums of partial minima, no neighbourhood is
    gathered.
    """
    edges = cut_lineage(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
                        .filter("a <> b").distinct())
    labels = cut_lineage(edges.groupBy(F.col("a").alias("node"))
                         .agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        around = (edges.join(labels.withColumnRenamed("node", "b"), "b")
                  .groupBy(F.col("a").alias("node")).agg(F.min("label").alias("seen")))
        lower = labels.join(around, "node").select(
            "node", F.col("label").alias("old"), F.least("label", "seen").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        lower = cut_lineage(lower.join(up, "label", "left").select(
            "node", "old", F.least("label", F.coalesce("up", "label")).alias("label")))
        changed = lower.filter("label <> old").limit(1).count()
        labels = lower.select("node", "label")
        if not changed:
            return labels.withColumnRenamed("label", "component")


def _compare(rows: list[tuple], inner: bool) -> pa.RecordBatch | None:
    """Links of one group of (rep, copies, block, grams): sums and a forest.

    ``inner``: the pairs inside one block, else only those between two blocks.
    """
    reps = np.array([r[0] for r in rows], dtype=np.int64)
    copies = np.array([r[1] for r in rows], dtype=np.int64)
    block = np.array([r[2] for r in rows])
    if not inner and (block == block[0]).all():  # the other block is empty
        return None
    sizes = np.array([len(r[3]) for r in rows], dtype=np.int64)
    m = len(rows)
    grams = np.concatenate([r[3] for r in rows])
    owner = np.repeat(np.arange(m), sizes)
    value, inverse, df = np.unique(grams, return_inverse=True, return_counts=True)
    shared = df >= 2  # the others are in no intersection
    column = np.cumsum(shared) - 1
    use = shared[inverse]
    width = max(1, -(-int(shared.sum()) // 64))
    # columns of the commonest n-grams first does not matter; rows are bit sets
    bits = np.zeros((m, width), dtype=_U)
    at = column[inverse[use]]
    np.bitwise_or.at(bits, (owner[use], at >> 6), _U(1) << (at & 63).astype(_U))
    order = np.argsort(sizes, kind="stable")
    p, q = SIMILARITY
    links, parent = np.zeros(m, dtype=np.int64), list(range(m))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    ranked = sizes[order]
    for i in range(m):
        x = order[i]
        # larger sets up to size * q / p can still reach the threshold
        upto = int(np.searchsorted(ranked, sizes[x] * q // p, side="right"))
        ys = order[i + 1:upto]
        if not inner:
            ys = ys[block[ys] != block[x]]
        for lo in range(0, len(ys), 4096):
            part = ys[lo:lo + 4096]
            common = np.bitwise_count(bits[part] & bits[x]).sum(axis=1, dtype=np.int64)
            hit = part[(p + q) * common >= p * (sizes[part] + sizes[x])]
            if len(hit):
                links[x] += copies[hit].sum()
                links[hit] += copies[x]
                for y in hit.tolist():
                    a, b = root(x), root(y)
                    if a != b:
                        parent[max(a, b)] = min(a, b)
    linked = np.flatnonzero(links)
    if not len(linked):
        return None
    return pa.RecordBatch.from_arrays(
        [pa.array(reps[linked]), pa.array(links[linked]),
         pa.array(reps[[root(i) for i in linked.tolist()]])], names=["rep", "links", "root"])


def _verify(batches):
    """Rows sorted by group; a group is compared when its last row has come."""
    group, held = None, []
    for batch in batches:
        names = list(zip(*(batch.column(i).to_pylist() for i in range(3))))
        rep, copies, block = (batch.column(i).to_pylist() for i in (3, 4, 5))
        for i, name in enumerate(names):
            if name != group:
                if len(held) > 1 and (out := _compare(held, group[1] == group[2])) is not None:
                    yield out
                group, held = name, []
            held.append((rep[i], copies[i], block[i], np.frombuffer(batch.column(6)[i].as_buffer(), "<u8")))
    if len(held) > 1 and (out := _compare(held, group[1] == group[2])) is not None:
        yield out


def _sets(batches):
    for piece in pieces(batches, "text"):
        gram, offsets = ngram_sets(*column_bytes(piece.column(1)))
        gram = gram.astype("<u8")
        yield pa.RecordBatch.from_arrays(
            [piece.column(0), piece.column(2), piece.column(3), pa.array(np.diff(offsets)),
             pa.array([gram[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:])], pa.binary())],
            names=["rep", "cluster", "copies", "n", "grams"])


def near_duplicates(docs: DataFrame, recall: float = RECALL) -> DataFrame:
    """(k, doc_id, class_id, n_links, n_copies, n_ngrams, first): one row per document.

    ``n_links``: other documents at similarity 0.8 or more, equal sets included.
    ``class_id``: least doc_id of the documents connected by links. ``first`` tells the
    rows of the representative that carries the class's least doc_id.
    """
    p, q = SIMILARITY
    bands = bands_for(p / q, ROWS, recall)
    rows = cut_lineage(sketches(docs, bands))
    # one representative for each distinct set: its least row key stands for it
    reps = cut_lineage(rows.filter("same is not null").groupBy("same").agg(
        F.min("k").alias("rep"), F.count("*").alias("copies"), F.min("doc_id").alias("least"),
        F.first("keys").alias("keys")))
    keyed = reps.select("rep", F.explode("keys").alias("key"))
    buckets = cut_lineage(keyed.groupBy("key").agg(F.min("rep").alias("a"), F.count("*").alias("m"))
                          .filter("m > 1").select("key", "a"))
    ties = keyed.join(buckets, "key").filter("a <> rep").select("a", F.col("rep").alias("b")).distinct()
    clusters = cut_lineage(components(ties).join(reps.select(F.col("rep").alias("node"), "copies"), "node"))

    # the full sets of the candidates, each once
    text = docs.select(_row_key().alias("node"), "text")
    # (one plan at every size: a broadcast that stops at some size would hide the shuffle)
    found = (text.join(clusters.hint("merge"), "node").select("node", "text", "component", "copies")
             .mapInArrow(_sets, "rep bigint, cluster bigint, copies bigint, n bigint, grams binary"))
    found = cut_lineage(found.dropDuplicates(["rep"]))
    total = found.groupBy("cluster").agg(F.sum("n").alias("total"))
    blocks = F.ceil(F.col("total") / BLOCK_NGRAMS).cast("int")
    dealt = (found.join(cut_lineage(total), "cluster").withColumn("blocks", blocks)
             .withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("cluster", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"),
                     "rep", "copies", "block", "grams"))
    links = cut_lineage(dealt.repartition("cluster", "x", "y").sortWithinPartitions("cluster", "x", "y")
                        .mapInArrow(_verify, "rep bigint, links bigint, root bigint"))

    classes = components(links.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    per_rep = (reps.drop("keys")
               .join(classes.withColumnRenamed("node", "rep"), "rep", "left")
               .join(links.groupBy("rep").agg(F.sum("links").alias("links")), "rep", "left")
               .withColumn("component", F.coalesce("component", "rep")))
    per_rep = cut_lineage(per_rep)
    named = per_rep.groupBy("component").agg(F.min("least").alias("class_id"))
    info = cut_lineage(per_rep.join(cut_lineage(named), "component").select(
        "same", "copies", "links", "class_id", "component"))
    return (rows.select("k", "doc_id", "same", F.col("n").alias("n_ngrams"))
            .join(info, "same", "left").select(
                "k", "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"),
                (F.coalesce("links", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).alias("n_links"),
                F.coalesce("copies", F.lit(1)).alias("n_copies"), "n_ngrams", "component"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without all but one document of each class of near duplicates.

    The row with the least (doc_id, row key) of a class stays; of repeated rows one stays.
    Rows without words all stay.
    """
    found = near_duplicates(docs)
    classed = found.filter("component is not null")
    stays = (classed.groupBy("component")
             .agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "k")).alias("best"))
             .select(F.col("best.k").alias("_k")))
    alone = found.filter("component is null").select(F.col("k").alias("_k"))
    keep = cut_lineage(stays.withColumn("_one", F.lit(True))
                       .union(alone.distinct().withColumn("_one", F.lit(False))))
    names = docs.columns
    inner = docs.withColumn("_k", _row_key()).toDF(*[f"c{i}" for i in range(len(names))], "_k")
    joined = inner.join(keep, "_k")
    columns = [f"c{i}" for i in range(len(names))]
    once = joined.filter("_one").dropDuplicates(["_k"]).select(*columns)
    return once.union(joined.filter("not _one").select(*columns)).toDF(*names)


def op10_ngram_join(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "class_id", "n_links", "n_copies", "n_ngrams")
