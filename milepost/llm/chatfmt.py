"""Chat formatting by incremental rendering of a black-box template.

A template is any function from a list of (role, text) turns to one string. The successive
prefixes of a conversation are rendered and consecutive outputs compared: where an output
starts with the one before, the rest of it is the new turn's span; where it doesn't, the
template rewrites history and ``rewritten_at`` names the turn that shows it. A turn's own text
is found inside its span by rendering the same prefix with a marker as the last text: what
stands before and after the marker frames the text. The loss mask holds the assistants' texts.

Every prefix is rendered whole, at every length, so a template that looks back any number of
turns gets its right spans. That costs n^2 / 2 turns for a conversation of n turns;
``chat_template`` keeps the turns that it rendered last, so there a turn costs a lookup.

``chat_template`` marks every turn and puts a backslash into each control string inside a text
or role, one more where there are some already, so that ``parsed`` gives back every turn.

Data flow: rows are shuffled by conversation and sorted by turn; a task reads them as a stream
and holds one conversation at a time, which ends as one formatted string anyway.

Defined results: a null text or role is empty; turns are ordered nulls first, ties by role and
text; repeated rows are turns of their own; a null conv_id is a conversation; an empty table
gives no rows; a template that rewrites history gives its last output, no spans and an empty
mask. Only the four named columns are read, so other columns can't clash.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .arrays import give_back

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

TRAINED = "assistant"
OPEN, CLOSE = "<|turn|>", "<|end|>\n"
# what follows < or [ in a control string of this and other common templates
_TAIL = r"\||/?s>|/?INST\]|</?SYS>>"
_CONTROL = re.compile(rf"([<\[])(\\*)({_TAIL})")
_ESCAPED = re.compile(rf"([<\[])\\(\\*)({_TAIL})")
_ROLE_OUT = {"\\": "\\\\", "\n": "\\n"}
_ROLE_IN = re.compile(r"\\(.)")
_PROBE = "\ue000\ue001\ue000"

PROBE_CONV = -1
PROBE_TURNS = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]


def escaped(text: str) -> str:
    return _CONTROL.sub(r"\1\\\2\3", text) if "<" in text or "[" in text else text


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def _role_out(role: str) -> str:
    return escaped("".join(_ROLE_OUT.get(c, c) for c in role))


def _role_in(role: str) -> str:
    return _ROLE_IN.sub(lambda m: "\n" if m[1] == "n" else m[1], unescaped(role))


@lru_cache(maxsize=4096)
def _turn_out(turn: Turn) -> str:
    return f"{OPEN}{_role_out(turn[0])}\n{escaped(turn[1])}{CLOSE}"


def chat_template(turns: list[Turn]) -> str:
    """``<|turn|>role``, a line end, the text, ``<|end|>``, a line end, for every turn."""
    return "".join(map(_turn_out, turns))


def parsed(output: str) -> list[Turn]:
    """The turns of ``chat_template``'s output."""
    turns = []
    for part in output.split(OPEN)[1:]:
        if not part.endswith(CLOSE):
            raise ValueError("a turn is not closed")
        role, text = part[:-len(CLOSE)].split("\n", 1)
        turns.append((_role_in(role), unescaped(text)))
    return turns


def _frame(render: Template, before: list[Turn], role: str, prefix: str, piece: str):
    """Where the last turn's text lies in its piece, or None."""
    probe = render([*before, (role, _PROBE)])
    at = probe.find(_PROBE, len(prefix))
    if at < 0 or not probe.startswith(prefix):
        return None
    head, tail = probe[len(prefix):at], probe[at + len(_PROBE):]
    if len(piece) < len(head) + len(tail) or not (piece.startswith(head) and piece.endswith(tail)):
        return None
    return len(head), len(piece) - len(tail)


def _pieces(turns: list[Turn], render: Template, trained: str):
    """(piece, frame of a trained text or None) of every turn, by comparing successive prefixes;
    the number of the turn that rewrites, or None."""
    out, before = [], render([])
    for k in range(len(turns)):
        now = render(turns[:k + 1])
        if not now.startswith(before):
            return out, k
        piece, frame = now[len(before):], None
        if turns[k][0] == trained:
            frame = _frame(render, turns[:k], trained, before, piece)
        out.append((piece, frame))
        before = now
    return out, None


def located(turns: list[Turn], render: Template, trained: str = TRAINED):
    """(output, span of every turn, loss spans, number of the rewriting turn or None).

    Spans are (start, end) in code points of the output. A trained turn whose text is not
    found literally between its frame gets no loss span.
    """
    found, bad = _pieces(turns, render, trained)
    if bad is not None:
        return render(turns), [], [], bad
    spans, loss, at = [], [], len(render([]))
    output = [render([])]
    for piece, frame in found:
        spans.append((at, at + len(piece)))
        if frame is not None:
            loss.append((at + frame[0], at + frame[1]))
        output.append(piece)
        at += len(piece)
    return "".join(output), spans, loss, None


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_BATCH_CHARS = 1 << 22


def _rendered(render: Template, trained: str):
    def conversations(batches: Iterator[pa.RecordBatch]):
        conv, turns, seen = None, [], False
        for batch in batches:
            for c, r, t in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if seen and c != conv:
                    yield conv, turns
                    turns = []
                conv, seen = c, True
                turns.append((r, t))
        if seen:
            yield conv, turns

    def run(batches):
        names = ["conv_id", "formatted", "spans", "loss", "rewritten_at"]
        held, size = [], 0

        def batch():
            conv, text, spans, loss, bad = zip(*held)
            as_rows = lambda s: pa.array([[{"start": a, "end": b} for a, b in x] for x in s], _SPANS)
            return pa.RecordBatch.from_arrays(
                [pa.array(conv, pa.int64()), pa.array(text, pa.string()), as_rows(spans),
                 as_rows(loss), pa.array(bad, pa.int64())], names=names)
        for conv, turns in conversations(batches):
            held.append((conv, *located(turns, render, trained)))
            size += len(held[-1][1])
            if size >= _BATCH_CHARS:
                yield batch()
                held, size = [], 0
        if held:
            yield batch()
        give_back()
    return run


FORMATTED = ("conv_id bigint, formatted string, spans array<struct<start:bigint,end:bigint>>, "
             "loss array<struct<start:bigint,end:bigint>>, rewritten_at bigint")


def formatted(turns: DataFrame, render: Template = chat_template, trained: str = TRAINED) -> DataFrame:
    """One row per conversation: its formatted text, the turns' spans and the loss spans."""
    ship_package(turns.sparkSession)
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    rows = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), text("role"), text("text"), "turn")
    return (rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
            .select("conv_id", "role", "text").mapInArrow(_rendered(render, trained), FORMATTED))


def _read_back(batches):
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    for batch in batches:
        rows = []
        for conv, output, loss in zip(*(batch.column(i).to_pylist() for i in range(3))):
            turns = parsed(output)
            digest = hashlib.sha256()
            for role, text in turns:
                digest.update(f"{role}\n{text}\n".encode())
            masked, chars = hashlib.sha256(), 0
            for s in loss:
                text = unescaped(output[s["start"]:s["end"]])
                masked.update(text.encode())
                chars += len(text)
            rows.append((conv, len(turns), digest.hexdigest(), chars, masked.hexdigest(), len(output)))
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.string() if isinstance(c[0], str) else pa.int64()) for c in zip(*rows)],
                names=names)


def read_back(done: DataFrame) -> DataFrame:
    """Digests of the turns and of the masked texts as parsed from ``chat_template``'s output."""
    ship_package(done.sparkSession)
    return done.select("conv_id", "formatted", "loss").mapInArrow(
        _read_back, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, "
        "loss_sha256 string, formatted_chars bigint")


def op13_chat_format(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(PROBE_CONV, i, r, t) for i, (r, t) in enumerate(PROBE_TURNS)],
                                  "conv_id bigint, turn bigint, role string, text string")
    return read_back(formatted(rows.unionByName(probe)))


# The same digests from the tables alone.
OP13_SQL = r"""
WITH t AS (
 SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL SELECT -1, i, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(i, r)),
e AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k,
 regexp_replace(text, '([<\[])(\\*)(\||/?s>|/?INST\]|</?SYS>>)', '\1\\\2\3', 'g') AS out_text,
 regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'),
  '([<\[])(\\*)(\||/?s>|/?INST\]|</?SYS>>)', '\1\\\2\3', 'g') AS out_role FROM t)
SELECT conv_id, count(*) AS n_turns,
 sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
 CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
 sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
 CAST(sum(length(out_text) + length(out_role) + 17) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id"""
