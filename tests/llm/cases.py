"""Small documents with every awkward case, and plain versions of the operators."""

from __future__ import annotations

import random
import re
import zlib

from pyspark.sql import Row
from pyspark.sql.types import (DoubleType, IntegerType, LongType, StringType, StructField,
                               StructType)

# extra columns whose names the operators use inside
DOCS = StructType([
    StructField("doc_id", LongType()), StructField("text", StringType()),
    StructField("lang", StringType()), StructField("source", StringType()),
    StructField("n_chars", LongType()), StructField("score", DoubleType()),
    StructField("key", StringType()), StructField("size", IntegerType()),
    StructField("k", StringType()), StructField("_m", StringType()),
    StructField("n", IntegerType()), StructField("segment", StringType())])
LABELS = StructType([StructField("doc_id", LongType()), StructField("quality", IntegerType()),
                     StructField("toxic", IntegerType()), StructField("text", StringType())])
ITEMS = StructType([StructField("item_id", LongType()), StructField("text", StringType()),
                    StructField("terms", StringType())])

EN = "the cat sat on a mat and then it went away from here with some old friends of mine".split()
DE = "der hund und die katze gehen über straßen für schöne äpfel mit großen bäumen heute".split()
BAD = ["nastyword", "rottenword"]


def prose(rng: random.Random, words: list[str], n: int) -> str:
    return " ".join(rng.choice(words) + rng.choice(["", "", ",", "."]) for _ in range(n))


def texts(seed: int = 5, n: int = 240) -> list[tuple]:
    """(doc_id, text, lang, quality, toxic)."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang, words = ("de", DE) if i % 3 == 0 else ("en", EN)
        text = prose(rng, words, rng.randint(12, 80))
        toxic = i % 4 == 1
        if toxic:
            text += " " + " ".join(rng.choice(BAD) for _ in range(4)) + " " + prose(rng, words, 6)
        rows.append((i, text, lang, 1, int(toxic)))
    long = prose(rng, EN, 6000)
    odd = [None, "", " \n\t ", "?! 12 --", "x", "日本語 テキスト", "a b c d", "word " * 30,
           "line one\nline one\n\nline one\nother", long, long + " end", "é" * 700,
           "# $ % & | < > * " * 8, "A B C\x1cD\x85E", "\x00\x01 zero", "😀 smile 😀"]
    rows += [(n + j, t, None if j % 2 else "en", j % 2, None) for j, t in enumerate(odd)]
    rows += [rows[3], rows[3], (n + 100, rows[4][1], "en", 1, 0), (None, "a row without an id but with more than ten words of some sense", "en", None, None),
             (None, "a row without an id but with more than ten words of some sense", "en", None, None)]
    return rows


def documents(spark, rows=None):
    rows = texts() if rows is None else rows
    return spark.createDataFrame(
        [(i, t, lang, "s", None if t is None else len(t), 1.5, "x", i and i % 7, "y", "z", 1, "w")
         for i, t, lang, _, _ in rows], DOCS)


def labels(spark, rows=None):
    rows = texts() if rows is None else rows
    data = [(i, q, t, "clash") for i, _, _, q, t in rows if q is not None]
    data += [(5, None, None, "x"), (None, 1, 1, "x"), (10**12, 1, 1, "x"), (6, 0, 0, "second label")]
    return spark.createDataFrame(data, LABELS)


def rest(doc_id, mod=5) -> int | None:
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % mod


def lowered(text: str | None) -> str:
    return (text or "").translate({i: i + 32 for i in range(65, 91)})


WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile("[^\x20\x09-\x0D]+")


def words(text) -> list[str]:
    return WORD.findall(lowered(text))


def collect(df) -> list[Row]:
    return df.collect()
