"""License scans: TF-IDF cosine to templates, inheritance from the nearest directory.

A file's units are its lines, runs of up to ``RUN_LINES`` neighbouring lines that are mostly template
words (so that the wrapping of a header doesn't matter), and its whole text.
Unit and template vectors are sparse TF-IDF over the words of all templates; the document
frequencies of these words are counted over all files. Words of no template count in a
unit's norm as one rare word each, so prose around a notice lowers its cosine. The best
template of a file's units at ``MIN_COSINE`` or more is its own licence.

A licence file of its directory is one whose whole text is at ``FILE_COSINE`` or more to a
full licence text, or whose name says so and that has an own licence; a mere mention or notice
in another file is not passed on. A file without an own licence takes that of the nearest directory
above it that has one: every distinct directory is joined with its ancestors' licences on
the path once, and the files join their directory's result.

Defined results: null and empty texts have no own licence but may inherit one; a null path
is in no directory and inherits nothing; ties go to the first licence by name; repeated
rows get equal results; an empty table gives an empty result. Only path, text and the named
id column are read, so other columns can't clash. Templates are the licences' usual notices and
the full texts of the short licences; long licences are files by their name only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, ship_package
from .arrays import LOWER, WORD, column_bytes, pieces, span_hashes, spans

MIN_COSINE = 0.7
FILE_COSINE = 0.8
RUN_LINES = 8
FILE_NAMES = r"(?i)(^|/)(licen[cs]e|copying|notice)(\.[a-z]+)?$"

# Licence identifiers and the wording of their notices.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.",
                   "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file "
                   "except in compliance with the License."],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License.",
                     "Redistribution and use in source and binary forms, with or without modification, are "
                     "permitted provided that the following conditions are met:"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.",
                  "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.",
                     "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 "
                     "International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.",
                     "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 "
                     "International License."],
    "CC0-1.0": ["Released under CC0 1.0.", "This work is dedicated to the public domain."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.",
                "This program is free software; you can redistribute it and/or modify it under the terms of "
                "the GNU General Public License as published by the Free Software Foundation; either version 2 "
                "of the License, or (at your option) any later version."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.",
                "This program is free software: you can redistribute it and/or modify it under the terms of "
                "the GNU General Public License as published by the Free Software Foundation, either version 3 "
                "of the License, or (at your option) any later version."],
    "LGPL-3.0": ["Licensed under the GNU Lesser General Public License, version 3.",
                 "This library is free software: you can redistribute it and/or modify it under the terms of "
                 "the GNU Lesser General Public License as published by the Free Software Foundation, either "
                 "version 3 of the License, or (at your option) any later version."],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files (the \"Software\"), to deal in the Software without restriction."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "all-rights-reserved": ["All rights reserved."],
}

_DISCLAIMER = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED "
    "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
    "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY "
    "DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER "
    "CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR "
    "OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
# Full texts of the short licences.
FULL_TEXTS = {
    "BSD-3-Clause":
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met: 1. Redistributions of source code must retain the above copyright "
        "notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must "
        "reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright "
        "holder nor the names of its contributors may be used to endorse or promote products derived from this "
        "software without specific prior written permission. " + _DISCLAIMER,
    "MIT":
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all "
        "copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF "
        "ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR "
        "A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR "
        "ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, "
        "OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
}


def words_of(texts: list[str]):
    """Word hashes of the texts and the number of the text of each."""
    raw, offsets = column_bytes(pa.array(texts, pa.string()))
    low = LOWER[raw]
    starts, ends, doc = spans(low, offsets, WORD)
    return span_hashes(low, starts, ends), doc


class Templates:
    """Template vectors over the sorted hashes of their words."""

    def __init__(self, templates: dict[str, list[str]], full: dict[str, str] = FULL_TEXTS):
        given = [(name, t, False) for name in templates for t in templates[name]]
        given = sorted(given + [(name, t, True) for name, t in full.items()], key=lambda g: g[0])
        self.names = [name for name, _, _ in given]
        self.full = np.array([f for _, _, f in given])
        h, which = words_of([t for _, t, _ in given])
        self.terms, column = np.unique(h, return_inverse=True)
        self.counts = np.zeros((len(self.names), len(self.terms)))
        np.add.at(self.counts, (which, column), 1)

    def column(self, h: np.ndarray) -> np.ndarray:
        """Column of each word, or -1 for a word of no template."""
        at = np.searchsorted(self.terms, h)
        at[at == len(self.terms)] = 0
        return np.where(self.terms[at] == h, at, -1)

    def weighted(self, idf: np.ndarray) -> np.ndarray:
        v = self.counts * idf
        return v / np.linalg.norm(v, axis=1, keepdims=True)


def _cosines(unit: np.ndarray, column: np.ndarray, n: int, idf: np.ndarray, rare: float,
             templates: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best cosine and template of units 0..n-1, given the unit and column of every word."""
    known = column >= 0
    key, tf = np.unique(unit[known] * len(idf) + column[known], return_counts=True)
    row, col = key // len(idf), key % len(idf)
    weight = tf * idf[col]
    square = np.bincount(row, weight * weight, n) + np.bincount(unit[~known], minlength=n) * rare * rare
    norm = np.sqrt(np.maximum(square, 1e-300))
    best, which = np.zeros(n), np.zeros(n, dtype=np.int64)
    for t, vector in enumerate(templates):
        cosine = np.bincount(row, weight * vector[col], n) / norm
        better = cosine > best + 1e-12
        best[better], which[better] = cosine[better], t
    return best, which


def _line_runs(unit: np.ndarray, doc: np.ndarray, column: np.ndarray, number: np.ndarray):
    """Runs of 2 .. ``RUN_LINES`` neighbouring lines of mostly template words.

    ``unit``: each word's line as an index into ``number``, the lines' places. Yields (words, the
    index of the run's first line for each of them) by run length.
    """
    words = np.bincount(unit, minlength=len(number))
    known = np.bincount(unit[column >= 0], minlength=len(number))
    able = (known >= 2) & (2 * known >= words)
    owner = np.zeros(len(number), dtype=np.int64)
    owner[unit] = doc
    follows = np.zeros(len(number), dtype=bool)  # the line after is able and of the same text
    follows[:-1] = able[:-1] & able[1:] & (number[1:] == number[:-1] + 1) & (owner[1:] == owner[:-1])
    runs = able.copy()                           # a run of the length starts here
    for length in range(2, RUN_LINES + 1):
        last = np.arange(len(number)) + length - 2
        runs = runs & (last < len(number)) & follows[np.minimum(last, max(0, len(number) - 1))]
        if not runs.any():
            return
        parts = []
        for back in range(length):
            first = unit - back
            mine = np.flatnonzero((first >= 0) & runs[np.maximum(first, 0)])
            parts.append((mine, first[mine]))
        yield tuple(np.concatenate(p) for p in zip(*parts))


def document_frequencies(files: DataFrame, templates: Templates) -> tuple[int, np.ndarray]:
    """Number of files and, per template word, of the files that hold it."""
    ship_package(files.sparkSession)
    shared = files.sparkSession.sparkContext.broadcast(templates)

    def run(batches):
        t = shared.value
        n, df = 0, np.zeros(len(t.terms), dtype=np.int64)
        for piece in pieces(batches, "text"):
            raw, offsets = column_bytes(piece.column(0))
            low = LOWER[raw]
            starts, ends, doc = spans(low, offsets, WORD)
            column = t.column(span_hashes(low, starts, ends))
            key = np.unique(doc[column >= 0] * len(df) + column[column >= 0])
            df += np.bincount(key % len(df), minlength=len(df))
            n += piece.num_rows
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(-1, len(df)), pa.int32()), pa.array(np.concatenate([[n], df]))],
            names=["column", "df"])

    rows = files.select("text").mapInArrow(run, "column int, df bigint").groupBy("column").agg(
        F.sum("df").alias("df")).collect()  # a row per template word
    df = np.zeros(len(templates.terms), dtype=np.int64)
    n = 0
    for r in rows:
        if r["column"] < 0:
            n = r["df"]
        else:
            df[r["column"]] = r["df"]
    return n, df


def idf_of(n: int, df):
    return np.log((1 + n) / (1 + np.asarray(df, dtype=float))) + 1


def own_licenses(files: DataFrame, id_col: str, templates: dict[str, list[str]] = TEMPLATES) -> DataFrame:
    """(id, path, own, score, whole_license, whole): best licence and cosine of the units; the closest
    full licence text and the cosine of the whole text to it."""
    table = Templates(templates)
    n, df = document_frequencies(files, table)
    idf, rare = idf_of(n, df), float(idf_of(n, 1))
    shared = files.sparkSession.sparkContext.broadcast((table, idf, rare, table.weighted(idf)))
    kinds = dict(files.dtypes)

    def run(batches):
        t, idf, rare, vectors = shared.value
        names = np.array(t.names)
        for piece in pieces(batches, "text"):
            m = piece.num_rows
            raw, offsets = column_bytes(piece.column(2))
            low = LOWER[raw]
            starts, ends, doc = spans(low, offsets, WORD)
            column = t.column(span_hashes(low, starts, ends))
            whole, whole_which = _cosines(doc, column, m, idf, rare, vectors)
            text, text_which = _cosines(doc, column, m, idf, rare, vectors[t.full])
            # a line is told by its text and the line ends before it
            breaks = np.cumsum(raw == 0x0A)
            line = doc + (breaks[starts] if len(raw) else np.zeros(0, np.int64))
            number, unit = np.unique(line, return_inverse=True)
            cosine, which = _cosines(unit, column, len(number), idf, rare, vectors)
            for words, run_first in _line_runs(unit, doc, column, number):
                found, template = _cosines(run_first, column[words], len(number), idf, rare, vectors)
                more = found > cosine + 1e-12
                cosine[more], which[more] = found[more], template[more]
            best, own = whole.copy(), whole_which.copy()
            first = np.concatenate([[True], unit[1:] != unit[:-1]]) if len(unit) else np.zeros(0, bool)
            owner = doc[first]
            order = np.lexsort((which, -cosine, owner))
            top = order[np.concatenate([[True], owner[order][1:] != owner[order][:-1]])] if len(order) else order
            better = top[(cosine[top] > best[owner[top]] + 1e-12)
                         | ((np.abs(cosine[top] - best[owner[top]]) <= 1e-12) & (which[top] < own[owner[top]]))]
            best[owner[better]], own[owner[better]] = cosine[better], which[better]
            hit = best >= MIN_COSINE
            yield pa.RecordBatch.from_arrays(
                [piece.column(0), piece.column(1), pa.array(names[own], pa.string(), mask=~hit),
                 pa.array(best), pa.array(names[t.full][text_which], pa.string(), mask=text <= 0), pa.array(text)],
                names=["id", "path", "own", "score", "whole_license", "whole"])

    return files.select(F.col(id_col).alias("id"), "path", "text").mapInArrow(
        run, f"id {kinds[id_col]}, path string, own string, score double, whole_license string, whole double")


def _directory(path):
    """Directory of a path, '' for the root; NULL stays NULL."""
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(
        F.when(path.isNotNull(), F.lit("")))


def scan(files: DataFrame, id_col: str = "doc_id", templates: dict[str, list[str]] = TEMPLATES) -> DataFrame:
    """(id, license, score, inherited, license_dir) of every row of ``files`` (id, path, text)."""
    rows = cut_lineage(own_licenses(files, id_col, templates).withColumn("dir", _directory(F.col("path"))))
    # one licence per directory: the closest licence file, the first name of equals
    named = F.col("path").rlike(FILE_NAMES) & F.col("own").isNotNull()
    held = (rows.filter(F.col("dir").isNotNull() & (named | (F.col("whole") >= FILE_COSINE)))
            .withColumn("license", F.when(F.col("whole") >= FILE_COSINE, F.col("whole_license"))
                        .otherwise(F.col("own")))
            .withColumn("close", F.when(F.col("whole") >= FILE_COSINE, F.col("whole")).otherwise(F.col("score")))
            .groupBy("dir").agg(F.min(F.struct((-F.col("close")).alias("w"), "license")).alias("b"))
            .select(F.col("dir").alias("license_dir"), F.col("b.license").alias("dir_license"),
                    (-F.col("b.w")).alias("dir_score")))
    above = (rows.filter("own is null and dir is not null").select("dir").distinct()
             .withColumn("parts", F.split("dir", "/"))
             .withColumn("depth", F.explode(F.sequence(F.lit(0), F.size("parts"))))
             .withColumn("license_dir", F.array_join(F.slice("parts", F.lit(1), F.col("depth")), "/")))
    nearest = cut_lineage(above.join(held, "license_dir").groupBy("dir").agg(
        F.max(F.struct("depth", "license_dir", "dir_license", "dir_score")).alias("b")).select(
            "dir", "b.license_dir", "b.dir_license", "b.dir_score"))
    inherits = F.col("own").isNull() & F.col("dir_license").isNotNull()
    return rows.join(nearest, "dir", "left").select(
        F.col("id").alias(id_col), F.coalesce("own", "dir_license").alias("license"),
        F.when(F.col("own").isNotNull(), F.col("score")).otherwise(F.col("dir_score")).alias("score"),
        inherits.alias("inherited"), F.when(inherits, F.col("license_dir")).alias("license_dir"))


def op3_license_scan(spark, sf_dir: str) -> DataFrame:
    """Documents as files: the language and the source are directories, the id the file's name."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = F.concat_ws("/", "lang", "source", F.col("doc_id").cast("string"))
    return scan(docs.select("doc_id", path.alias("path"), "text"))
