"""Operators over the whole corpus against plain versions, with every awkward case."""

from collections import Counter, defaultdict

import cases
import numpy as np
import pytest

from milepost.llm import langid, neardup, sharding, toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return cases.documents(spark).cache()


def test_toxicity_finds_the_words(spark, docs):
    rows = cases.texts()
    model = toxicity.fit(docs, cases.labels(spark))
    got = toxicity.score(docs, model).collect()
    truth = {i: t for i, _, _, _, t in rows if t is not None}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.doc_id in truth and cases.rest(r.doc_id) == 0]
    assert all((r.score >= 0.5) == truth[r.doc_id] for r in held)
    again = toxicity.score(docs, toxicity.fit(docs, cases.labels(spark))).collect()
    assert sorted((r.doc_id or -1, r.score) for r in got) == sorted((r.doc_id or -1, r.score) for r in again)


def test_toxicity_ignores_held_out_labels(spark, docs):
    flipped = [(i, t, lang, q, 1 - y if y is not None and cases.rest(i) == 0 else y)
               for i, t, lang, q, y in cases.texts()]
    a, b = toxicity.fit(docs, cases.labels(spark)), toxicity.fit(docs, cases.labels(spark, flipped))
    assert np.array_equal(a[0], b[0]) and np.allclose(a[1], b[1])


def test_toxicity_without_labels_or_rows(spark, docs):
    model = toxicity.fit(docs, cases.labels(spark, []).limit(0))
    assert {r.score for r in toxicity.score(docs, model).collect()} == {0.5}
    assert toxicity.score(cases.documents(spark, []), model).count() == 0


def test_toxicity_held_out_accuracy(spark):
    r = toxicity.op1_toxicity(spark, "/root/testdata/sf0.1")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    held = r.filter("held_out").join(labels, "doc_id").toPandas()
    assert (held.predicted[held.toxic == 0] == 0).mean() > 0.99
    assert (held.predicted[held.toxic == 1] == 1).mean() > 0.6


def test_language_prediction(spark, docs):
    model = langid.model_of(docs)
    got = langid.identify(docs, model)
    assert got.columns == docs.columns + ["lang_pred", "score"]
    by_text = {r.text: (r.lang_pred, r[-1]) for r in got.collect()}
    for none in (None, "", " \n\t ", "?! 12 --"):
        assert by_text[none] == ("und", 0.0)
    assert by_text["😀 smile 😀"][0] in ("de", "en")
    for i, t, lang, _, _ in cases.texts()[:240]:
        assert by_text[t][0] == lang
    assert all(0 <= s <= 1 for _, s in by_text.values())
    kept = langid.keep_known(docs, model)
    assert kept.columns == docs.columns
    assert {r.text for r in kept.collect()}.isdisjoint({None, "", " \n\t ", "?! 12 --"})


def test_language_model_learns_from_training_rows_only(spark, docs):
    wrong = [(i, t, "xx" if cases.rest(i) == 0 else lang, q, y) for i, t, lang, q, y in cases.texts()]
    a, b = langid.model_of(docs), langid.model_of(cases.documents(spark, wrong))
    assert a[0] == b[0] and np.array_equal(a[1], b[1])


def test_language_without_training(spark, docs):
    blank = [(i, t, None, q, y) for i, t, _, q, y in cases.texts()]
    model = langid.model_of(cases.documents(spark, blank))
    assert {r.lang_pred for r in langid.identify(docs, model).collect()} == {"und"}
    assert langid.identify(cases.documents(spark, []), langid.model_of(docs)).count() == 0


def test_bloom_masks_return_all_languages(spark, docs):
    langs, masks, _, _ = langid.model_of(docs)
    counts = {}
    for i, t, lang, _, _ in cases.texts():
        if lang and t is not None and cases.rest(i) != 0:
            raw = np.frombuffer(t.encode(), np.uint8)
            _, g = langid.grams(raw, np.array([0, len(raw)]))
            counts.setdefault(lang, Counter()).update(g.tolist())
    rate = {x: {g: n / sum(c.values()) for g, n in c.items()} for x, c in counts.items()}
    for x in langs:
        for g, r in rate[x].items():
            if r >= langid.MIN_RATE and r >= langid.MIN_RELATIVE * max(rate[y].get(g, 0) for y in langs):
                hit = [masks[int(s[0]), 0] for s in langid.slots(np.array([g], np.uint32))]
                assert all(h >> langs.index(x) & 1 for h in hit)


def test_language_held_out_accuracy(spark):
    r = langid.op6_bitmask_langid(spark, SF).filter("held_out").join(
        spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    assert (r.lang == r.lang_pred).mean() > 0.98


def check_shards(rows, n):
    total = sum(r.size for r in rows)
    shards = defaultdict(list)
    for r in rows:
        shards[r.shard].append(r)
    assert set(shards) <= set(range(n))
    for part in shards.values():
        assert sorted(r.slot for r in part) == list(range(len(part)))
    top = max((r.size for r in rows), default=0)
    for s in range(n):
        assert abs(sum(r.size for r in shards[s]) - total / n) <= top


def test_shards_are_near_equal(spark, docs, monkeypatch):
    import zlib
    monkeypatch.setattr(sharding, "MIN_RANGES", 16)
    rows = sharding.shard(docs).collect()
    check_shards(rows, 8)
    expected = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))
                       for i, t, _, _, _ in cases.texts())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == expected
    assert sharding.shard(cases.documents(spark, [])).count() == 0


def test_hot_text_is_split_and_contiguous(spark):
    rows = [(i, "same text", "en", 1, 0) if i % 3 else (i, f"text {i}", "en", 1, 0) for i in range(3000)]
    got = sharding.shard(cases.documents(spark, rows)).collect()
    check_shards(got, 8)
    # in the order of shard and slot the copies are one run
    got.sort(key=lambda r: (r.shard, r.slot))
    hot = [i for i, r in enumerate(got) if r.doc_id % 3]
    assert hot == list(range(hot[0], hot[0] + len(hot)))


def test_overfull_ranges_are_subdivided(spark, monkeypatch):
    monkeypatch.setattr(sharding, "SAMPLES_PER_RANGE", 1)  # poor splitters at first
    rows = [(i, f"text {i}", "en", 1, 0) for i in range(4000)]
    slim = sharding.records(cases.documents(spark, rows))
    total = slim.agg({"size": "sum"}).first()[0]
    cuts = sharding.splitters(slim, total, 32)
    keys = sorted(r.key for r in slim.collect())
    sizes = Counter(int(np.searchsorted(cuts, k, side="right")) for k in keys)
    assert max(sizes.values()) <= 2.0 * 4000 / 32 * 1.2


def plain_links(rows):
    sets = []
    for _, text in rows:
        w = cases.words(text)
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else None)
    parent, links = list(range(len(rows))), [0] * len(rows)

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if 5 * common >= 4 * (len(sets[a]) + len(sets[b]) - common):
                    links[a] += 1
                    links[b] += 1
                    parent[max(root(a), root(b))] = min(root(a), root(b))
    classes = defaultdict(list)
    for i in range(len(rows)):
        classes[root(i)].append(i)
    out = Counter()
    for members in classes.values():
        ids = [rows[i][0] for i in members if rows[i][0] is not None]
        for i in members:
            out[rows[i][0], min(ids, default=None), links[i]] += 1
    return out


def near_copies():
    import random
    rng = random.Random(3)
    rows = cases.texts(n=60)
    vocabulary = [f"v{i}" for i in range(4000)]
    base = [rng.choice(vocabulary) for _ in range(150)]
    for j in range(70):  # a group of near copies, some too far from each other
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        rows.append((5000 + j, " ".join(w), "en", 1, 0))
    rows += [(6000 + j, "copied whole text of a few more words", "en", 1, 0) for j in range(40)]
    return rows


def test_near_duplicates_lose_no_link(spark, monkeypatch):
    rows = near_copies()
    docs = cases.documents(spark, rows)
    expected = plain_links([(r[0], r[1]) for r in rows])
    for block in (neardup.BLOCK_NGRAMS, 1500):  # one block, and a cluster dealt into many
        monkeypatch.setattr(neardup, "BLOCK_NGRAMS", block)
        got = Counter((r.doc_id, r.class_id, r.n_links) for r in neardup.near_duplicates(docs).collect())
        assert got == expected


@pytest.mark.parametrize("block", [73, 35])
def test_blocks_without_documents_count_no_link_again(spark, monkeypatch, block):
    base = [f"w{i}" for i in range(100)]
    rows = [(j, " ".join(base[:50 + j] + ["new"] + base[50 + j:]), "en", 1, 0) for j in range(6)]
    rows.append((10, rows[0][1], "en", 1, 0))
    monkeypatch.setattr(neardup, "BLOCK_NGRAMS", block)  # 8 and 17 blocks of the 6 sets
    got = Counter((r.doc_id, r.class_id, r.n_links) for r in neardup.near_duplicates(cases.documents(spark, rows)).collect())
    assert got == plain_links([(r[0], r[1]) for r in rows])


def test_one_of_each_class_stays(spark):
    rows = near_copies()
    docs = cases.documents(spark, rows)
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns
    classes = {(c if c is not None else ("none", d)) for d, c, _ in plain_links(
        [(r[0], r[1]) for r in rows if cases.words(r[1])])}
    worded = [r for r in kept.collect() if cases.words(r.text)]
    assert len(worded) == len(classes)
    wordless = sum(not cases.words(r[1]) for r in rows)
    assert kept.count() - len(worded) == wordless
    assert neardup.keep_one(cases.documents(spark, [])).count() == 0


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (9, 8), (8, 7), (20, 21), (21, 20), (5, 5), (30, 1)]
    got = {r.node: r.component for r in neardup.components(
        spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 30: 1, 7: 7, 8: 7, 9: 7, 20: 20, 21: 20}


def test_bands_reach_the_recall():
    for rows in (2, 4, 5, 8):
        b = neardup.bands_for(0.8, rows, 0.9999)
        assert 1 - (1 - 0.8 ** rows) ** b >= 0.9999 > 1 - (1 - 0.8 ** rows) ** (b - 1)
