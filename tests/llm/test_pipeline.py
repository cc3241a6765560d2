"""The pipeline: every stage on its own input against a plain version of its decision."""

import hashlib

import cases
import corpus_pipeline as C
import pytest

from milepost.llm import bpe, neardup
from milepost.session import cut_lineage

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs]
    for _, f in C.STAGES:
        docs = cut_lineage(f(spark, docs, SF))
        seen.append(docs)
    return seen


def test_stages_keep_columns_and_rows(stages):
    for before, after in zip(stages[:-2], stages[1:-1]):
        assert after.columns == before.columns
        ids = {r.doc_id for r in before.select("doc_id").collect()}
        assert {r.doc_id for r in after.select("doc_id").collect()} <= ids
    assert stages[1].count() >= 0.99 * stages[0].count()  # all texts are in a known language


def test_near_duplicate_stage(stages):
    found = neardup.near_duplicates(stages[2])
    assert stages[3].count() == found.select("class_id").distinct().count()


def test_decontamination_stage(spark, stages):
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = cases.words(r.text)
        windows |= {tuple(w[i:i + 10]) for i in range(max(1, len(w) - 9) if w else 0)}
    assert {len(w) for w in windows} == {10}
    clean = set()
    for r in stages[3].collect():
        w = cases.words(r.text)
        if not any(tuple(w[i:i + 10]) in windows for i in range(len(w) - 9)):
            clean.add(r.doc_id)
    assert {r.doc_id for r in stages[4].collect()} == clean


def test_token_stage_round_trip(stages):
    texts = {r.doc_id: r.text for r in stages[4].collect()}
    bytes_of = bpe.default_vocabulary().bytes_of
    rows = stages[5].collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert b"".join(bytes_of[i] for i in r.ids).decode() == texts[r.doc_id]
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_run_equals_the_stages(spark, stages):
    got = sorted((r.doc_id, r.ids_sha256) for r in C.run(spark, SF).collect())
    assert got == sorted((r.doc_id, r.ids_sha256) for r in stages[5].collect())


def test_awkward_rows(spark, tmp_path):
    rows = cases.texts()
    path = str(tmp_path)
    cases.documents(spark, rows).write.parquet(f"{path}/documents.parquet")
    cases.labels(spark, rows).write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, "no such words anywhere in it", ""), (2, None, "")],
                          cases.ITEMS).write.parquet(f"{path}/benchmark.parquet")
    out = C.run(spark, path).collect()
    ids = [r.doc_id for r in out]
    assert len(out) > 200 and None in ids and ids.count(3) == 1


def test_empty_documents(spark, tmp_path):
    path = str(tmp_path)
    cases.documents(spark, []).write.parquet(f"{path}/documents.parquet")
    cases.labels(spark, []).write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([], cases.ITEMS).write.parquet(f"{path}/benchmark.parquet")
    assert C.run(spark, path).count() == 0
