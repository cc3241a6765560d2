"""Byte-level BPE: ranked merges folded over the byte arrays of distinct words.

Each task takes a bounded piece of whole texts, splits them by the tokenizer's pattern
and encodes every distinct word once. Distinct words of one length form a matrix of byte
tokens; one fold step merges, in each row, the leftmost pair of the lowest rank, looked
up in the broadcast rank map of token pairs (a few hundred thousand entries, fixed by the
vocabulary file). Rows without a pair in the map are finished. The texts' ids are then
gathered from their words'. Decoding concatenates the tokens' byte strings. Nothing is
shuffled, collected or shared between tasks, so size and skew of the corpus don't matter.

Defined results: null and empty texts have no tokens; repeated rows are encoded each by
itself; words of any length are folded whole; an empty table gives an empty result. Only
doc_id and text are read, so other columns can't clash.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .arrays import gathered

PIECE_BYTES = 6 << 20
DECODED_IDS = 1 << 18   # ids decoded at a time, whole texts
ROW_WORDS = 1 << 15     # words of one length folded at a time
LONG = 256              # bytes; longer words are folded one by one
NONE = np.int32(2**31 - 1)


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank from a rank file (base64 token, blank, rank), read on the driver."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}


def unicode_pattern(pattern: str) -> str:
    """The pattern with blanks spelled as the Unicode property that the tokenizers use."""
    return pattern.replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}")


class Vocabulary:
    """Rank map of a byte-level BPE as arrays; ranks are ids."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern = unicode_pattern(pattern)
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.single = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        pairs = {(ranks[t[:k]] << 32) | ranks[t[k:]]: r for t, r in ranks.items()
                 for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks}
        self.pair = np.array(sorted(pairs), dtype=np.int64)
        self.merged = np.array([pairs[k] for k in self.pair.tolist()], dtype=np.int32)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the token that each pair merges into, NONE if there is none."""
        if not len(self.pair):
            return np.full(a.shape, NONE)
        key = (a.astype(np.int64) << 32) | b
        at = np.searchsorted(self.pair, key)
        at[at == len(self.pair)] = 0
        return np.where(self.pair[at] == key, self.merged[at], NONE)

    def fold(self, words: np.ndarray):
        """Yield (rows, ids) for a byte matrix of equally long words, a block per final length."""
        ids = self.single[words]
        rows = np.arange(len(words))
        rank = self.rank(ids[:, :-1], ids[:, 1:])
        while len(rows):
            if ids.shape[1] == 1:
                yield rows, ids
                return
            first = rank.argmin(axis=1)
            lowest = rank[np.arange(len(rows)), first]
            open_ = lowest != NONE
            if not open_.all():
                yield rows[~open_], ids[~open_]
                rows, ids, rank, first, lowest = (x[open_] for x in (rows, ids, rank, first, lowest))
                if not len(rows):
                    return
            at, each = first[:, None], np.arange(len(rows))
            cols = np.arange(ids.shape[1] - 1)
            ids = np.take_along_axis(ids, cols + (cols > at), axis=1)
            ids[each, first] = lowest
            cols = cols[:-1]
            rank = np.take_along_axis(rank, cols + (cols >= at), axis=1)
            left = np.flatnonzero(first > 0)
            rank[left, first[left] - 1] = self.rank(ids[left, first[left] - 1], lowest[left])
            right = np.flatnonzero(first < ids.shape[1] - 1)
            rank[right, first[right]] = self.rank(lowest[right], ids[right, first[right] + 1])

    def fold_long(self, word: bytes) -> np.ndarray:
        """Ids of one long word: every step merges all places of the lowest rank, left to right."""
        ids = self.single[np.frombuffer(word, np.uint8)]
        while len(ids) > 1:
            rank = self.rank(ids[:-1], ids[1:])
            lowest = rank.min()
            if lowest == NONE:
                break
            at = np.flatnonzero(rank == lowest)
            run = np.flatnonzero(np.concatenate([[True], np.diff(at) > 1]))
            nth = np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))
            at = at[nth % 2 == 0]  # overlapping places: the first, third, ...
            ids[at] = lowest
            ids = np.delete(ids, at + 1)
        return ids

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words one after the other, and the n + 1 offsets."""
        known = np.fromiter((self.ranks.get(w, -1) for w in words), np.int64, len(words))
        lens = np.fromiter(map(len, words), np.int64, len(words))
        found: list[tuple[np.ndarray, np.ndarray]] = [
            (np.flatnonzero(known >= 0), known[known >= 0].astype(np.int32)[:, None])]
        order = np.flatnonzero(known < 0)
        order = order[np.argsort(lens[order], kind="stable")]
        lo = 0
        while lo < len(order):
            n = lens[order[lo]]
            if n > LONG:
                found.append((order[lo:lo + 1], self.fold_long(words[order[lo]])[None, :]))
                lo += 1
                continue
            hi = min(lo + ROW_WORDS, int(np.searchsorted(lens[order], n, side="right")))
            block = order[lo:hi]
            matrix = np.frombuffer(b"".join(words[i] for i in block), np.uint8).reshape(-1, n)
            found += [(block[rows], ids) for rows, ids in self.fold(matrix)]
            lo = hi
        counts = np.zeros(len(words), np.int64)
        for rows, ids in found:
            counts[rows] = ids.shape[1]
        offsets = np.concatenate([[0], np.cumsum(counts)])
        out = np.zeros(offsets[-1], np.int32)
        for rows, ids in found:
            out[offsets[rows][:, None] + np.arange(ids.shape[1])] = ids
        return out, offsets

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the n + 1 offsets."""
        split = regex.compile(self.pattern).findall
        parts = [split(t) for t in texts]
        ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        coded = pa.array([w for p in parts for w in p], pa.string()).dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        ids, offsets = self.encode_words([w.encode() for w in coded.dictionary.to_pylist()])
        counts = np.diff(offsets)[code]
        upto = np.concatenate([[0], np.cumsum(counts)])
        at = np.repeat(offsets[code] - upto[:-1], counts) + np.arange(upto[-1])
        return ids[at], upto[ends]


def encode(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, ids array<int>) of every whole text."""
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        for piece in gathered(batches, "text", PIECE_BYTES):
            ids, offsets = shared.value.encode(piece.column(1).fill_null("").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [piece.column(0), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))],
                names=["doc_id", "ids"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode(encoded: DataFrame, vocabulary: Vocabulary, keep_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded binary, and ids if kept): the tokens' bytes put together again."""
    ship_package(encoded.sparkSession)
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        bytes_of = shared.value.bytes_of
        decimal = {i: str(i) for i in bytes_of}
        for batch in batches:
            upto = np.concatenate([[0], np.cumsum(
                batch.column(1).value_lengths().to_numpy(zero_copy_only=False))])
            lo = 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + DECODED_IDS, side="right")) - 1)
                part = batch.slice(lo, hi - lo)
                lo = hi
                ids = part.column(1).to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(x) for x in ids], pa.int64()),
                     pa.array([hashlib.sha256(",".join(map(decimal.__getitem__, x)).encode()).hexdigest() for x in ids]),
                     pa.array([b"".join(map(bytes_of.__getitem__, x)) for x in ids], pa.binary()),
                     *([part.column(1)] if keep_ids else [])],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded", *(["ids"] if keep_ids else [])])

    kind = dict(encoded.dtypes)["doc_id"]
    return encoded.select("doc_id", "ids").mapInArrow(
        run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded binary" + ", ids array<int>" * keep_ids)


def default_vocabulary(name: str = "byte_bpe_multi_50k.tiktoken") -> Vocabulary:
    import public_tokenizers
    return Vocabulary(read_ranks(public_tokenizers.path(name)), public_tokenizers.PATTERN)


def op2_byte_bpe(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    vocabulary = default_vocabulary()
    return decode(encode(docs, vocabulary), vocabulary).select(
        "doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
