"""Structure repair, importance resampling and chat formatting against plain versions."""

import hashlib
import heapq
import math
import random
import re
import zlib
from collections import Counter

import cases
import pytest
from pyspark.sql import functions as F

from milepost.llm import chatfmt, crc, repair, resample
from milepost.llm.arrays import WORD, column_bytes, spans

TURNS = "conv_id bigint, turn bigint, role string, text string, sig string, audit string, copies int"


def odd_turns(n=300, seed=5):
    rng = random.Random(seed)
    rows = [(rng.choice([1, 2, 3, None, 7]), rng.choice([None, 0, 1, 2, 3, 4, 2**62, -5]),
             rng.choice([None, "user", "assistant", "system", "", "tool", "ümlaut"]),
             rng.choice([None, "", " \n\t ", "hi.", "é!", "no end", "x.\n ", "...", "😀?"])) for _ in range(n)]
    rows += [(99, i, "user", "ok.") for i in range(500)]           # one text in many turns
    rows += [(98, 4, "user", "again.")] * 50                       # repeated rows
    rows += [(97, i, ("user", "assistant")[i % 2], "word. " * 3000) for i in range(6)]
    return rows


def turn_table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 3) for r in rows], TURNS)


# -- structure repair ---------------------------------------------------------------------

NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def cheapest(rows):
    """(faults, illegal pairs, cost, audit, repaired turns) by a shortest path over whole states."""
    seen, faults = set(), []
    for r, t in rows:
        kept = t.strip(" \t\n\x0b\f\r")
        faults.append(1 if not kept else 2 if (r, t) in seen else 3 if kept[-1] not in ".!?" else 0)
        seen.add((r, t))
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    heap, done = [(0, "", 0, 0, ())], set()
    while True:
        cost, audit, i, state, out = heapq.heappop(heap)
        if i == len(rows) and state in (0, 3):
            return faults, illegal, cost, audit, list(out)
        if (i, state) in done:
            continue
        done.add((i, state))
        for name in ("user", "assistant"):
            if (state, name[0]) in NEXT:
                heapq.heappush(heap, (cost + 2, audit + "I", i, NEXT[state, name[0]], (*out, (name, ""))))
        if i < len(rows):
            role, text = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, state, out))
            if faults[i] not in (1, 2):
                cut = faults[i] == 3
                if (state, role[:1]) in NEXT:
                    heapq.heappush(heap, (cost + cut, audit + "K", i + 1, NEXT[state, role[:1]], (*out, (role, text))))
                for name in ("user", "assistant"):
                    if (state, name[0]) in NEXT:
                        heapq.heappush(heap, (cost + 2 + cut, audit + "R", i + 1, NEXT[state, name[0]],
                                              (*out, (name, text))))


def plainly_repaired(rows):
    conv = {}
    for c, t, r, x in rows:
        kept = conv.setdefault(c, [])
        r, x = " " if r is None else r, " " if x is None else x
        fate = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if fate == 0:
            continue
        x = "" if fate == 1 else re.sub("[.!?]", "", x) if fate == 2 else x
        kept += [(t, "user" if fate == 4 else r, x)] * (2 if fate == 3 else 1)
    out = {}
    for c, kept in conv.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1],
                                 hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))
        turns = {t for t, _, _ in kept if t is not None}
        faults, illegal, cost, audit, done = cheapest([(r, x) for _, r, x in kept])
        out[c] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(i) for i in (1, 2, 3)),
                  illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{x}" for r, x in done).encode()).hexdigest())
    return out


def test_audits_are_cheapest_and_least():
    rng = random.Random(5)
    for _ in range(4000):
        rows = [(rng.choice(["user", "assistant", "system", "tool", ""]),
                 rng.choice(["a.", "b!", "c", "", "d. ", "e"])) for _ in range(rng.randint(0, 7))]
        faults, illegal, cost, audit, done = cheapest(rows)
        sig = "".join(chr(97 + 4 * ("sua".find(r[:1]) if r and r[0] in "sua" else 3) + f)
                      for (r, _), f in zip(rows, faults))
        path = [repair.END]
        for c in reversed(sig):
            path.append(repair.node_before(c, path[-1]))
        assert (path[-1][0][0], repair.audit_of(path)) == (cost, audit)
        assert repair._illegal(sig) == illegal and repair.repaired_turns(rows, audit) == done


def test_repair_equals_brute_force(spark):
    rows = odd_turns()
    got = repair.repair(repair.damaged(turn_table(spark, rows).repartition(5)))
    assert {r[0]: tuple(r[1:]) for r in got.collect()} == plainly_repaired(rows)


def test_repair_joins_pieces_of_a_long_conversation(spark):
    """A conversation that lies in many ranges has one signature and its turns count once."""
    rows = [(1, i // 2, ("user", "assistant")[i % 2], f"text {i}.") for i in range(3000)]
    rows += [(2, 0, "user", "a."), (2, 1, "assistant", "b.")]
    got = repair.repair(repair.damaged(turn_table(spark, rows).repartition(8))).collect()
    assert {r[0]: tuple(r[1:]) for r in got} == plainly_repaired(rows)


def test_repair_of_nothing(spark):
    empty = turn_table(spark, odd_turns()).limit(0)
    assert repair.repair(repair.damaged(empty)).collect() == []
    dropped = next(i for i in range(100) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    r = repair.repair(repair.damaged(turn_table(spark, [(dropped, 0, "user", "x.")]))).first()
    assert tuple(r) == (dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


# -- importance resampling ----------------------------------------------------------------

def test_run_crcs_equal_zlib():
    rng = random.Random(1)
    import pyarrow as pa
    texts = [" ".join("".join(rng.choice("abcé9") for _ in range(rng.choice([1, 2, 5, 9, 63, 64, 65, 66, 200])))
                      for _ in range(rng.randint(0, 12))) for _ in range(50)]
    texts += ["", None, "x" * 70000 + " b", "日本 語"]
    raw, offsets = column_bytes(pa.array(texts))
    starts, ends, doc = spans(raw, offsets, WORD)
    for n, (where, found) in enumerate(crc.run_crcs(raw, starts, ends, doc, 3), 1):
        want = [(i, zlib.crc32(" ".join(w[j:j + n]).encode())) for i, t in enumerate(texts)
                for w in [(t or "").split()] for j in range(len(w) - n + 1)]
        assert want == list(zip(where.tolist(), found.tolist()))


def plainly_drawn(rows, items, percent):
    def runs(text):
        w = cases.words(text)
        return len(w), [zlib.crc32(" ".join(w[i:i + n]).encode()) % 10000 for n in (1, 2, 3)
                        for i in range(len(w) - n + 1)]
    s, t, docs = Counter(), Counter(), []
    for i, text in rows:
        docs.append((i, *runs(text)))
        s.update(docs[-1][2])
    for text in items:
        t.update(runs(text)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    out = []
    for i, n_words, buckets in docs:
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000))))
                     for b in buckets)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, n_words, len(buckets), weight, weight + math.floor(-1000 * math.log(-math.log((h + .5) / 2**32)))))
    able = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2]))
    won = Counter()
    ranks = {}
    for k, r in enumerate(able[:len(able) * percent // 100]):
        ranks[r, won[r]] = k + 1
        won[r] += 1
    seen, done = Counter(), []
    for r in out:
        done.append((r[0], r[2], r[3], r[4], ranks.get((r, seen[r]))))
        seen[r] += 1
    return done


def _key(r):
    return tuple((v is None, v or 0) for v in r)


@pytest.mark.parametrize("percent", [5, 37])
def test_resampling_equals_a_sort(spark, percent):
    rows = [(i, t) for i, t, *_ in cases.texts()]
    items = [" ".join(cases.EN), "the cat sat nastyword", None, ""]
    target = spark.createDataFrame([(i, t, "x") for i, t in enumerate(items)], cases.ITEMS)
    got = resample.resample(cases.documents(spark).repartition(5), target, percent).select(
        "doc_id", "n_features", "weight", "score", "rank").collect()
    assert sorted(map(tuple, got), key=_key) == sorted(plainly_drawn(rows, items, percent), key=_key)


def test_resampling_keeps_columns_and_takes_empty_tables(spark):
    docs, none = cases.documents(spark), cases.documents(spark, [])
    kept = resample.resample(docs, docs.limit(0), keep=["text", "_m"])
    assert {"k0", "k1"} <= set(kept.columns) and kept.where("k1 = 'z'").count() == docs.count()
    assert resample.resample(none, docs).collect() == []
    few = docs.where("doc_id < 3")                                   # 5 % of three documents is none
    assert [r["rank"] for r in resample.resample(few, docs).collect()] == [None] * few.count()


def test_cutoff_by_medians_is_exact(spark):
    rng = random.Random(3)
    for n, parts in ((4000, 7), (900, 1), (10, 3)):
        keys = [(rng.randint(-50, 50), rng.randint(0, 40)) for _ in range(n)]
        keys += [(0, 0)] * (n // 3)                                  # one key holds a quarter of the rows
        df = spark.createDataFrame(keys, "a bigint, b bigint").repartition(parts)
        for k in (1, len(keys) // 20 or 1, len(keys) // 2, len(keys)):
            assert resample.cutoff(df, k, last=3) == sorted(keys)[k - 1]
    assert resample.cutoff(df, 0) is None and resample.cutoff(df, 10**6) is None


# -- chat formatting ----------------------------------------------------------------------

PARTS = ["<", "|", "s>", "/s>", "[", "INST]", "/INST]", "\\", "\n", "a", "<|end|>", "<SYS>>", "</SYS>>",
         "</s>", "<|turn|>", "<|", "\\n", "é😀"]


@pytest.mark.parametrize("n", [0, 1, 2, 5, 127, 128, 129, 300])
def test_format_round_trip(n):
    rng = random.Random(n)
    for _ in range(40 if n < 6 else 2):
        turns = [("assistant" if rng.random() < .5 else "".join(rng.choices(PARTS, k=rng.randint(0, 3))),
                  "".join(rng.choices(PARTS, k=rng.randint(0, 12)))) for _ in range(n)]
        output, found, loss, rewritten = chatfmt.located(turns, chatfmt.chat_template)
        assert output == chatfmt.chat_template(turns) and rewritten is None and chatfmt.parsed(output) == turns
        assert [output[a:b] for a, b in found] == [chatfmt.chat_template([t]) for t in turns]
        assert [chatfmt.unescaped(output[a:b]) for a, b in loss] == [t for r, t in turns if r == "assistant"]


def test_control_strings_never_stand_in_a_text():
    rng = random.Random(9)
    for _ in range(3000):
        text = "".join(rng.choices(PARTS, k=8))
        out = chatfmt.escaped(text)
        assert chatfmt.unescaped(out) == text
        assert not re.search(r"<\||</?s>|\[/?INST\]|<</?SYS>>", out)


def _forgets(turns):
    """A template that drops all but the last assistant text."""
    last = max((i for i, t in enumerate(turns) if t[0] == "assistant"), default=-1)
    return "<s>" + "".join(f"[{r}]{t if r != 'assistant' or i == last else ''}" for i, (r, t) in enumerate(turns))


def _first_only(turns):
    """Append-only, with a head that only the first turn gets."""
    return "".join(f"{'^' if not i else ''}{r}:{t}\n" for i, (r, t) in enumerate(turns))


def _far_back(turns):
    """Append-only, but a turn shows the first turn's text: windows can't see it."""
    return "".join(f"{r}:{t}({turns[0][1]})\n" for i, (r, t) in enumerate(turns))


def test_templates_are_black_boxes():
    turns = [("user", "a"), ("assistant", "b"), ("user", "c"), ("assistant", "d")]
    output, found, loss, rewritten = chatfmt.located(turns, _forgets)
    assert rewritten == 3 and (found, loss) == ([], []) and output == _forgets(turns)
    assert chatfmt.located(turns[:3], _forgets)[3] is None
    long = [(("user", "assistant")[i % 2], f"text {i}") for i in range(200)]
    for template in (_first_only, _far_back):
        output, found, loss, rewritten = chatfmt.located(long, template)
        assert rewritten is None and output == template(long)
        assert [output[a:b] for a, b in loss] == [t for r, t in long if r == "assistant"]
    assert chatfmt.located(long, _forgets)[3] == 3


def _rewrites_once(turns):
    """Append-only but for the prefix of 150 turns, which shows another head."""
    return ("!" if len(turns) == 150 else "^") + "".join(f"{r}:{t}\n" for r, t in turns)


def test_long_conversations_are_compared_prefix_by_prefix():
    long = [(("user", "assistant")[i % 2], f"text {i}") for i in range(200)]
    assert chatfmt.located(long, _rewrites_once)[3] == 149
    assert chatfmt.located(long[:149], _rewrites_once)[3] is None


def test_format_of_awkward_rows(spark):
    rows = odd_turns(200)
    df = turn_table(spark, rows)
    got = {r.conv_id: r for r in chatfmt.read_back(chatfmt.formatted(df.repartition(6))).collect()}
    conv = {}
    for c, t, r, x in rows:
        conv.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    assert set(got) == set(conv)
    for c, turns in conv.items():
        turns = [(r, x) for *_, r, x in sorted(turns)]
        mask = "".join(x for r, x in turns if r == "assistant")
        assert got[c].n_turns == len(turns) and got[c].loss_chars == len(mask)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest()
        assert got[c].loss_sha256 == hashlib.sha256(mask.encode()).hexdigest()
        assert got[c].formatted_chars == len(chatfmt.chat_template(turns))
    assert chatfmt.formatted(df.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["op11_conversation_repair", "op12_importance_resampling", "op13_chat_format"])
def test_query_equals_its_sql(spark, name):
    import duckdb

    from milepost.llm import registry
    from tools.oracle_check import rows
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    got = registry.queries()[name](spark, sf)
    assert rows(got.toPandas()) == rows(con.execute(registry.oracle_sql()[name]).fetchdf())


def test_probe_conversation(spark):
    row = chatfmt.op13_chat_format(spark, "/root/testdata/sf0.001").where(F.col("conv_id") == -1).first()
    text = "</s>[INST] ok [/INST]"
    assert row.n_turns == 2 and row.loss_chars == len(text)
    assert row.loss_sha256 == hashlib.sha256(text.encode()).hexdigest()
