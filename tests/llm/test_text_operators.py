"""Row-wise operators against plain versions, with every awkward case."""

import hashlib
import math
import re
from collections import Counter

import cases
import numpy as np
import pytest
from pyspark.sql import functions as F

from milepost.llm import bpe, decontam, lmscore, maintext, quality

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return cases.documents(spark).cache()


@pytest.fixture(scope="module")
def tokenizer():
    import tiktoken
    v = bpe.default_vocabulary()
    import public_tokenizers
    return v, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN,
                                mergeable_ranks=v.ranks, special_tokens={})


def test_bpe_equals_the_library_and_decodes(docs, tokenizer):
    v, library = tokenizer
    got = bpe.decode(bpe.encode(docs, v), v, keep_ids=True).collect()
    expected = Counter()
    for r in docs.collect():
        ids = library.encode_ordinary(r.text or "")
        expected[r.doc_id, tuple(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                 (r.text or "").encode()] += 1
    assert Counter((r.doc_id, tuple(r.ids), r.ids_sha256, bytes(r.decoded)) for r in got) == expected


def test_bpe_long_words_fold_like_short_ones(tokenizer):
    v, library = tokenizer
    for word in ["ab" * 300, "a" * 999, "etaoin" * 200 + "x", "   " * 400, "é" * 400]:
        ids, _ = v.encode([word])
        assert ids.tolist() == library.encode_ordinary(word)
        assert v.fold_long(word.encode()).tolist() == library._core_bpe.encode_single_piece(word.encode())


def test_empty_tables(spark, tokenizer):
    v, _ = tokenizer
    none = cases.documents(spark, [])
    assert bpe.decode(bpe.encode(none, v), v).count() == 0
    assert decontam.contamination(none, spark.createDataFrame([], cases.ITEMS)).count() == 0
    assert quality.verdicts(none, cases.labels(spark, [])).count() == 0
    words = lmscore.vocabulary(none)
    assert lmscore.score(none, words, lmscore.fit(words)).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert maintext.extract(pages).count() == 0


def test_quality_measures_and_base(spark, docs):
    got = quality.verdicts(docs, cases.labels(spark)).collect()
    expected = Counter()
    for r in docs.collect():
        text = r.text or ""
        w = cases.SPACED.findall(text)
        windows = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
        twice, hit, seen, dup = Counter(windows), set(), set(), 0
        for i, x in enumerate(windows):
            if twice[x] > 1:
                hit.update(range(i, i + 5))
        for line in text.split("\n"):
            if cases.SPACED.search(line):
                dup += line in seen
                seen.add(line)
        expected[r.doc_id, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit),
                 len(w) < 10 or 100 * len(hit) > 20 * len(w)] += 1
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words,
                    r.base_failed) for r in got) == expected
    assert all(r.kept != r.base_failed for r in got)  # too few labels to prove a cutoff


def test_binomial_tail_is_exact(spark):
    cases_ = [(0, 10, 0.3), (3, 40, 0.2), (20, 4000, 0.01), (1, 500, 0.004), (60, 5000, 0.02), (9, 30, 0.2)]
    for k, n, p in cases_:
        row = spark.createDataFrame([(float(k), float(n))], "k double, n double")
        got = row.select(quality.binomial_tail("k", "n", p)).first()[0]
        exact = 1.0 if k >= n * p else sum(
            math.exp(math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1)
                     + j * math.log(p) + (n - j) * math.log(1 - p)) for j in range(k + 1))
        assert got == pytest.approx(exact, rel=1e-9)
        if k >= 3:  # a cut series stays above the tail
            cut = row.select(quality.binomial_tail("k", "n", p, steps=2)).first()[0]
            assert cut >= exact * (1 - 1e-12)


def test_cutoffs_hold_the_false_rejections(spark):
    rows = [(i, " ".join(f"w{i}x{j}" + "#$%" * (i % 10 == 0 and j % 3 == 0) for j in range(20)),
             "en", 0 if i % 10 == 0 else 1, 0) for i in range(6000)]
    got = quality.verdicts(cases.documents(spark, rows), cases.labels(spark, rows))
    by = {(r.bad, r.kept): r["count"] for r in
          got.selectExpr("doc_id % 10 = 0 as bad", "kept").groupBy("bad", "kept").count().collect()}
    assert by.get((False, False), 0) <= 0.02 * 5400
    assert by.get((True, True), 0) == 0
    # the rule that tells them apart has the laxest cutoff that does
    found = {r["stratum"]: r["cutoffs"] for r in quality.calibrate(
        quality.with_measures(cases.documents(spark, rows).select("doc_id", "text", "lang"))
        .selectExpr("doc_id", "lang as stratum", "_m.*"),
        cases.labels(spark, rows)).collect()}
    ratio = sorted(r[2] / r[1] for r in got.filter("doc_id % 10 = 0").select(
        "doc_id", "word_chars", "n_symbols").collect())[0]
    assert found["en"]["symbols"] == max(c for c in quality.RULES["symbols"][1] if c < ratio)
    kept = quality.keep_good(cases.documents(spark, rows), cases.labels(spark, rows))
    assert kept.columns == cases.documents(spark, rows).columns
    assert kept.count() == sum(v for (_, k), v in by.items() if k)


def plain_contamination(docs, items, length=10):
    windows = {}
    for item, text in items:
        w = cases.words(text)
        for i in range(max(1, len(w) - length + 1) if w else 0):
            windows.setdefault(tuple(w[i:i + length]), set()).add(item)
    out = Counter()
    for doc_id, text in docs:
        w, hit, found = cases.words(text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if x := windows.get(tuple(w[i:i + n])):
                    hit.update(range(i, i + n))
                    found |= x
        names = ",".join(sorted(str(x) for x in found))
        out[doc_id, len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit)] += 1
    return out


def items_of(docs):
    rows = docs.select("doc_id", "text").filter("doc_id < 60").orderBy("doc_id").collect()
    items = [(i, " ".join(cases.words(r.text)[3:22])) for i, r in enumerate(rows[:12])]
    return items + [(50, "the cat"), (51, "nowhere found phrase"), (52, ""), (53, None), (54, "x"),
                    (55, items[0][1]), (55, items[1][1]), (56, "the the the the")]


def test_positional_index_finds_all_windows(spark, docs, monkeypatch):
    items = items_of(docs)
    table = spark.createDataFrame([(i, t, "clash") for i, t in items], cases.ITEMS)
    expected = plain_contamination([(r.doc_id, r.text) for r in docs.collect()], items)
    for size in (decontam.SLICE, 7):  # one pass and many passes give the same
        monkeypatch.setattr(decontam, "SLICE", size)
        got = decontam.contamination(docs, table)
        assert Counter(tuple(r[:6]) for r in got.drop("spans", "items").collect()) == expected
    clean = decontam.keep_clean(docs, table)
    assert clean.columns == docs.columns
    assert clean.count() == sum(v for k, v in expected.items() if not k[5])


def test_proximity_matches(spark, docs):
    items = [(1, "cat mat"), (2, "friends the away"), (3, "nastyword rottenword"), (4, "missing cat")]
    table = spark.createDataFrame([(i, t, "") for i, t in items], cases.ITEMS)
    rows = docs.filter("doc_id is not null").dropDuplicates(["doc_id"])
    got = decontam.near_matches(decontam.build_index(rows), decontam.windows(table), 6)
    expected = Counter()
    for r in rows.collect():
        w = cases.words(r.text)
        for item, text in items:
            need = set(cases.words(text))
            for s in range(len(w)):
                if w[s] in need and need <= set(w[s:s + 6]):
                    expected[item, r.doc_id, s] += 1
    assert Counter(tuple(x) for x in got.collect()) == expected


def test_lm_baseline_is_exact_and_split_changes_nothing(docs):
    tokens = [(r.doc_id, cases.SPACED.findall(cases.lowered(r.text)) + [""]) for r in docs.collect()]
    count = Counter()
    for doc_id, t in tokens:
        if cases.rest(doc_id) != 1:
            count.update(t)
    n, v = sum(count.values()), len(count)
    words = lmscore.vocabulary(docs)
    fitted = lmscore.fit(words)
    expected = sorted(((d or -1), len(t), sum(count[x] > 0 for x in t),
                       round(sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in t), 6))
                      for d, t in tokens)
    scores = []
    for head in (10**6, 5):
        got = lmscore.score(docs, words, fitted, head).collect()
        assert sorted(((r.doc_id or -1), r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == expected
        assert all(r.train_tokens == n and math.isfinite(r.score) and r.score < 0 for r in got)
        scores.append(sorted((r.n_tokens, round(r.score, 6)) for r in got))
    assert scores[0] == scores[1]


def test_lm_is_a_distribution_over_symbols(docs):
    import numpy as np
    from milepost.llm import mixing
    fitted = lmscore.fit(lmscore.vocabulary(docs))
    for prefix in (b"", b"t", b"th", b"the ca", b"x" * 63):
        symbols = np.array([list(prefix) + [b] for b in range(256)], dtype=np.uint8)
        n = len(prefix)
        lens = np.full(256, n + 1)
        cls = np.full(256, 5) if n < mixing.HEAD else None
        p = 10.0 ** fitted.model.log10(symbols, lens, cls, n, n + 1)
        assert p.sum() == pytest.approx(1.0, abs=1e-6)


def test_lm_learns(spark):
    from milepost.llm.lmscore import op5_context_mixing
    r = op5_context_mixing(spark, "/root/testdata/sf0.01").toPandas()
    train = r[~r.held_out]
    assert train.score.sum() > train.base_score.sum()
    held = r[r.held_out]
    assert held.score.sum() / held.n_tokens.sum() > -4.4
    # total bits over the bytes of the text
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").toPandas()
    both = r.merge(docs, on="doc_id")
    size = both.text.fillna("").map(lambda t: len(t.encode()))
    assert (both.n_bytes == size).all()
    bits = -both.score * np.log2(10) / size.where(size > 0)
    assert np.allclose(both.bits_per_byte, bits, equal_nan=True, atol=1e-9) and 1 < bits.median() < 6


def test_lm_words_depend_on_the_words_before(spark):
    """A text in order is likelier than its words shuffled, in training and in held-out texts."""
    import random
    rng = random.Random(3)
    names = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "pe", "ra", "so", "ti") for b in ("ban", "dor", "fel", "gim", "hus")]
    follows = dict(zip(names, rng.sample(names, len(names))))     # each word has one that mostly comes next
    rows = []
    for i in range(300):
        text = [rng.choice(names)]
        for _ in range(60):
            text.append(follows[text[-1]] if rng.random() < 0.9 else rng.choice(names))
        rows.append((i, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    words = lmscore.vocabulary(docs)
    fitted = lmscore.fit(words)
    mixed = spark.createDataFrame([(i, " ".join(rng.sample(t.split(), 61))) for i, t in rows], docs.schema)
    held = lmscore.held_out(F.col("doc_id"))
    a, b = ({r.doc_id: r.score / r.n_tokens for r in lmscore.score(d.where(held), words, fitted).collect()}
            for d in (docs, mixed))
    assert len(a) > 30 and all(a[i] > b[i] + 0.3 for i in a)
    # held-out words cost little more than their choice among 40, as most are known from the word before
    assert sum(a.values()) / len(a) > -0.7


def test_lm_blocks_change_nothing(docs, monkeypatch):
    from milepost.llm import mixing
    words = lmscore.vocabulary(docs)
    fitted = lmscore.fit(words)
    raw = "".join(t or "" for t in (r.text for r in docs.limit(40).collect())).encode()
    raw = np.frombuffer(raw + b" " + b"y" * 300 + b" end", np.uint8)
    low, begin, end, doc, _ = lmscore.tokens(raw, np.array([0, 700, 700, len(raw)]))
    symbols, offsets = lmscore.coded(low, begin, end, doc, 3)
    spelled = [bytes(symbols[a:b]) for a, b in zip(offsets, offsets[1:])]
    assert spelled == [b"".join(w + b" " for w in [*bytes(low[a:b]).split(), b""])
                       for a, b in ((0, 700), (700, 700), (700, len(raw)))]
    whole = fitted.model.scores(mixing.Stream(symbols, offsets))
    monkeypatch.setattr(mixing, "BLOCK", 37)
    assert np.allclose(fitted.model.scores(mixing.Stream(symbols, offsets)), whole, atol=1e-9)
    # a text's score depends on no other text
    last = fitted.model.scores(mixing.Stream(symbols[offsets[2]:], offsets[2:] - offsets[2]))
    assert np.allclose(last, whole[offsets[2]:], atol=1e-9)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head>
<body><nav><ul><li><a href=1>Home</a></li></ul></nav><div class="ad">Buy now</div>
<article><h1>Head &amp; line</h1><p>First  <b>bold</b>ly
said.<p>Second &eacute;&#8212;x &nowhere; text.</p><form>Name <input></form><!-- no --><div class=comments>Nice</div></article>
<aside>Side</aside><footer>Foot</footer></body></html>"""


def test_main_text():
    assert maintext.main_text(PAGE) == "Head & line First boldly said. Second é—x &nowhere; text."
    assert maintext.main_text("") == ""
    assert maintext.main_text("<p>open <b>never closed") == "open never closed"
    assert maintext.main_text("plain 1 < 2 &lt;") == "plain 1 < 2 <"
    # an attribute value that is never closed ends with its tag at the next >
    assert maintext.main_text("<a href='x>broken") == "broken"
    para = "<p>" + "A long sentence with many words in it and no links at all. " * 4 + "</p>"
    page = ("<body><div><a href=1>Home</a> <a href=2>News</a></div><div><h1>Name</h1>" + para * 4
            + "</div><div>" + "".join(f"<a href={i}>Link {i}</a> " for i in range(30)) + "</div></body>")
    got = maintext.main_text(page)
    assert got.startswith("Name A long") and "Link" not in got and "Home" not in got
    deep = "<div>" * 3000 + "deep text" + "</div>" * 3000
    assert maintext.main_text(deep) == "deep text"


def test_main_text_of_pages(spark):
    import html
    pages = spark.read.parquet(f"{SF}/pages.parquet").selectExpr("*", "'c' as text", "1 as n_chars")
    rows = pages.limit(1).selectExpr("page_id", "url", "cast(null as string) html", "text", "n_chars")
    got = {r.page_id: r.text for r in maintext.extract(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        assert got[r.page_id] == " ".join(html.unescape(re.sub(r"<[^>]*>", " ", article)).split())
    assert [r.text for r in maintext.extract(rows).collect()] == [""]


def test_densities_choose_the_main_text(spark):
    import html
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        article = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        want = " ".join(html.unescape(re.sub(r"<[^>]*>", " ", article)).split())
        for name in ("div", "section", "main"):
            page = r.html.replace("<article>", f"<{name}>").replace("</article>", f"</{name}>")
            assert maintext.main_text(page) == want
    para = "<p>" + "Some words of a longer text that goes on. " * 6 + "</p>"
    links = "<div>" + "".join(f"<a href={i}>Link {i}</a> " for i in range(20)) + "</div>"
    for name in ("article", "div"):
        several = "".join(f"<{name}><h2>Name{j}</h2>{para * j}</{name}>" for j in (1, 2, 3))
        got = maintext.main_text(f"<body>{links}<div>{several}</div></body>")
        assert all(f"Name{j}" in got for j in (1, 2, 3)) and "Link" not in got
        page = f"<body><main><{name}><h1>Name</h1>{para * 4}</{name}><div>{links}Unmarked note</div></main></body>"
        got = maintext.main_text(page)
        assert got.startswith("Name Some") and "Unmarked" not in got and "Link" not in got


def test_markers_do_not_take_the_main_text_away():
    para = "<p>" + "Some words of a longer text that goes on. " * 6 + "</p>"
    menu = "<nav><ul>" + "".join(f"<li><a href={i}>Menu {i}</a></li>" for i in range(9)) + "</ul></nav>"
    side = '<div class="sidebar"><p>Side words</p></div><div class="comments"><p>A comment that says a bit.</p></div>'
    text = f"<h1>Name</h1>{para * 3}"
    want = maintext.main_text(f"<body>{menu}<div>{text}</div>{side}<footer>Foot</footer></body>")
    assert want.startswith("Name Some") and not re.search("Menu|Side|comment|Foot", want) and want.count("goes on") == 18
    for opened, closed in (('<div class="layout no-sidebar">', "</div>"), ('<div id="page" class="has-menu">', "</div>"),
                           ('<div class="widget-area content">', "</div>"), ("<form action=/>", "</form>"),
                           ('<div class="skip"><form><div role="alert">', "</div></form></div>"), ("<main hidden>", "</main>")):
        for inner in ("div", "article"):
            body = f"{menu}<{inner}>{text}</{inner}>{side}<footer>Foot</footer>"
            assert maintext.main_text(f"<body>{opened}{body}{closed}</body>") == want
            body = f"{menu}{opened}<{inner}>{text}</{inner}>{closed}{side}<footer>Foot</footer>"
            assert maintext.main_text(f"<body>{body}</body>") == want
    # a block without blocks inside
    assert maintext.main_text(f'<body>{menu}<div class="widget">Plain words, no paragraph.</div></body>') == "Plain words, no paragraph."
    # long comments do not beat a shorter text, and marks inside it are left out
    long = '<div class="comments">' + para * 5 + "</div>"
    assert maintext.main_text(f"<body><div><h1>Name</h1>{para * 3}</div>{long}</body>") == want
    assert maintext.main_text(f'<body><div><h1>Name</h1>{para * 3}<div class="ad">Buy</div></div></body>') == want


@pytest.mark.parametrize("raw", ["<svg><path d=1>", "<math>", "<object data=x>", "<noscript>words", "<template>",
                                 "<iframe src=x>", "<title>Words", "<svg/>", "<svg><svg></svg>words", "<head><title>x</title>"])
def test_unclosed_raw_elements_end_at_the_next_block(raw):
    para = "<p>" + "Some words of a longer text that goes on. " * 6 + "</p>"
    want = maintext.main_text(f"<body><div>{para * 3}</div></body>")
    for later in ("", "<svg></svg><title>x</title><iframe></iframe>"):
        assert want and maintext.main_text(f"{raw}<body><div>{para * 3}</div>{later}</body>") == want
        assert maintext.main_text(f"<body>{raw}<div>{para * 3}{later}</div></body>") == want
    # nested and closed ones go as a whole
    assert maintext.main_text(f"<body><div>{para * 3}<svg><svg></svg><div>words</div></svg></div></body>") == want


def test_unclosed_tags_take_linear_time():
    import time

    from milepost.llm import maintext
    for tag in ("<b>", "<b></i>", "<i><div><b></i>", "<p><b>"):
        took = []
        for n in (20_000, 80_000):
            start = time.time()
            text = maintext.main_text("<html><body><article>" + (tag + "word ") * n)
            took.append(time.time() - start)
            assert text.count("word") == n
        assert took[1] < 12 * max(took[0], 0.05)  # four times the tags; squares would take sixteen times


def test_formulas_are_text():
    from milepost.llm import maintext
    page = ("<html><body><nav><a href='/'>home</a></nav><article><p>" + "Plain words about numbers. " * 8
            + "Here <math><mi>x</mi><mo>=</mo><msup><mn>7</mn><mn>2</mn></msup></math> holds.</p></article></body></html>")
    assert maintext.main_text(page).endswith("Here x=72 holds.")
