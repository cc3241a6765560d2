"""Repair of conversation structure with an automaton shared by all conversations.

Every row becomes one of 16 symbols (role initial s, u, a or another; fault none, blank,
duplicate or truncated), a conversation its signature. Conversations share endings, so the
distinct signatures are sorted from the end: a walk over them in that order visits the
automaton in which equal suffixes are one node, and each node's cost-to-go, best edit and
audit order are computed once for each of the four grammar states, from the node after it.
An audit is then read off along one path, and conversations meet the audits of their
signature again by a join.

Grammar of the repaired roles' initials: ``(s?(ua)+)?``. States: 0 nothing yet, 1 after s, 2 after
u, 3 after a; 0 and 3 may end. Audits of equal cost are compared without building them: a
row's edits (inserts, then Keep, Rerole or Delete) are never a prefix of one another, and equal
edits are ordered by the rank of the states they lead to. An audit fixes the repaired roles,
since their number tells whether there is a leading system turn.

Data flow: slim rows (turn, digest of role and text, fault) are counted before the shuffle and
range-partitioned by position, so that a conversation that holds a third of all rows is spread
over many tasks; pieces of signatures are put together by conversation, a byte a row, as long
as the audit that is returned. A signature that many conversations share is split into
``SALTS`` parts for the join. Only the last step shuffles texts, once: a digest of all repaired
text is sequential, so each conversation's rows pass one task as a sorted stream, of which
one row is held.

Defined results: nulls of role and text are one space, and so is a null id or turn in the damage key;
rows are ordered by turn, nulls first, ties by role and by digest of the text; repeated rows are
rows; an empty role has no initial of the grammar; a null conv_id is a conversation; an empty
table gives no rows. Only the four named columns are read, so other columns can't clash.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, ship_package
from .arrays import give_back

BLANKS = " \t\n\x0b\f\r"
ROLES = "sua"                       # classes 0, 1, 2; others are 3
NONE, BLANK, DUPLICATE, TRUNCATED = range(4)
KEEP, REROLE, DELETE, INSERT, CUT = 0, 2, 3, 2, 1
NAMES = {"u": "user", "a": "assistant"}
SALTS = 64
# state -> {initial: next state}
GRAMMAR = [{"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}]


def damaged(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): rows after the seeded damage, dropped ones with 0 copies."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.encode(F.concat(space("conv_id"), F.lit(":"), space("turn")), "UTF-8")) % 20
    text = F.when(fate == 1, "").when(fate == 2, F.regexp_replace(space("text"), "[.!?]", "")) \
        .otherwise(space("text"))
    return turns.select("conv_id", "turn", F.when(fate == 4, "user").otherwise(space("role")).alias("role"),
                        text.alias("text"),
                        F.when(fate == 0, 0).when(fate == 3, 2).otherwise(1).cast("bigint").alias("copies"))


def _digest() -> Column:
    return F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))


def _slim(rows: DataFrame) -> DataFrame:
    """Counted rows without texts: (conv_id, turn, role, digest, first, rest, n), the symbols of the
    first of ``n`` equal rows and of the others. A conversation without rows has one with n = 0."""
    kept = F.rtrim(F.col("text"), F.lit(BLANKS))
    gone = F.col("copies") == 0
    fault = F.when(kept == "", BLANK).when(F.right(kept, F.lit(1)).isin(".", "!", "?"), NONE).otherwise(TRUNCATED)
    counted = (rows.select("conv_id", F.when(~gone, F.col("turn")).alias("turn"),
                           F.when(gone, "").otherwise(F.col("role")).alias("role"),
                           F.when(~gone, _digest()).alias("digest"),
                           F.when(gone, 0).otherwise(fault).alias("fault"), "copies")
               .groupBy("conv_id", "turn", "role", "digest")
               .agg(F.min("fault").alias("fault"), F.sum("copies").alias("n")))
    kind = F.position(F.substring("role", 1, 1), F.lit(ROLES)) - 1
    kind = F.when((F.col("role") == "") | (kind < 0), 3).otherwise(kind)
    symbol = lambda f: F.char(F.lit(97) + 4 * F.col("kind") + f)
    order = Window.partitionBy("conv_id", "digest").orderBy("turn")
    # (conv_id, digest) holds equal rows of different turns: all but the first are duplicates
    return (counted.withColumn("fresh", F.row_number().over(order) == 1).withColumn("kind", kind)
            .select("conv_id", "turn", "role", "digest", "n",
                    symbol(F.when((F.col("fault") == BLANK) | F.col("fresh"), F.col("fault"))
                           .otherwise(DUPLICATE)).alias("first"),
                    symbol(F.when(F.col("fault") == BLANK, BLANK).otherwise(DUPLICATE)).alias("rest")))


PIECE = "conv_id bigint, pid int, sig string, turns bigint, low bigint, high bigint"


def _pieces(batches):
    """Signature pieces of a sorted partition: one row per conversation that it holds rows of."""
    def rows():
        for b in batches:
            yield from zip(*(b.column(i).to_pylist() for i in range(6)))

    def flush(out):
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.string(), pa.int64(),
                                                        pa.int64(), pa.int64()))],
            names=["conv_id", "pid", "sig", "turns", "low", "high"])

    out, held, sig = [], None, []
    for conv, pid, turn, first, rest, n in rows():
        if held is None or held[0] != conv:
            if held is not None:
                out.append((*held[:2], "".join(sig), *held[2:]))
                if len(out) >= 10_000:
                    yield flush(out)
                    out = []
            held, sig = [conv, pid, 0, None, None], []
        if n:
            sig.append(first + rest * (n - 1))
            if turn is not None and turn != held[4]:
                held[2] += 1
                held[3] = turn if held[3] is None else held[3]
                held[4] = turn
    if held is not None:
        out.append((*held[:2], "".join(sig), *held[2:]))
    if out:
        yield flush(out)


def signatures(rows: DataFrame) -> DataFrame:
    """(conv_id, sig, gaps) of every conversation."""
    slim = cut_lineage(_slim(rows))
    keys = ["conv_id", "turn", "role", "digest"]
    pieces = (slim.repartitionByRange(*keys).sortWithinPartitions(*keys)
              .select("conv_id", F.spark_partition_id().alias("pid"), "turn", "first", "rest", "n")
              .mapInArrow(_pieces, PIECE))
    whole = pieces.groupBy("conv_id").agg(F.sort_array(F.collect_list(
        F.struct("pid", "sig", "turns", "low", "high"))).alias("p"))
    # a turn number that goes on in the next piece counts once
    distinct = F.expr("aggregate(p, struct(0L as n, cast(null as bigint) as high), (a, x) -> struct("
                      "a.n + x.turns - case when x.low = a.high then 1L else 0L end as n, "
                      "coalesce(x.high, a.high) as high), a -> a.n)")
    wide = lambda f, c: F.expr(f"{f}(transform(p, x -> cast(x.{c} as decimal(20,0))))")
    gaps = (wide("array_max", "high") - wide("array_min", "low") + 1 - distinct).try_cast("bigint")
    return whole.select("conv_id", F.expr("array_join(transform(p, x -> x.sig), '')").alias("sig"),
                        F.coalesce(gaps, F.lit(0)).alias("gaps"))


# -- the automaton -----------------------------------------------------------------------
# A node is, for each grammar state, (cost, edits, next state, rank of the audit among the states).

END = ((0, "", None, 0), (2 * INSERT, "II", None, 2), (INSERT, "I", None, 1), (0, "", None, 0))


def node_before(symbol: str, after: tuple) -> tuple:
    """The node of ``symbol`` followed by the suffix of node ``after``."""
    kind, fault = divmod(ord(symbol) - 97, 4)
    initial = ROLES[kind] if kind < 3 else None
    cut = CUT if fault == TRUNCATED else 0
    best = []
    for state, moves in enumerate(GRAMMAR):
        cost, _, _, rank = after[state]
        options = [(cost + DELETE, "D", rank, state)]
        if fault not in (BLANK, DUPLICATE):
            for letter, to in moves.items():
                cost, _, _, rank = after[to]
                if letter == initial:
                    options.append((cost + KEEP + cut, "K", rank, to))
                if letter in NAMES:
                    options.append((cost + REROLE + cut, "R", rank, to))
        best.append(min(options))
    add = lambda o: (o[0] + INSERT, "I" + o[1], *o[2:])
    two, three = min(best[2], add(best[3])), min(best[3], add(best[2]))
    best = [min(best[0], add(two)), min(best[1], add(two)), two, three]
    order = sorted({o[1:3] for o in best})
    return tuple((cost, edits, to, order.index((edits, rank))) for cost, edits, rank, to in best)


def audit_of(path: list[tuple]) -> str:
    """The best audit along the nodes of a signature, END first."""
    out, state = [], 0
    for node in reversed(path):
        _, edits, to, _ = node[state]
        out.append(edits)
        state = to
    return "".join(out)


def _illegal(sig: str) -> int:
    kinds = [(ord(c) - 97) // 4 for c in sig]
    return sum(pair not in ((0, 1), (1, 2), (2, 1)) for pair in zip(kinds, kinds[1:]))


AUDIT = ("sig string, salts array<int>, blank bigint, duplicate bigint, truncated bigint, illegal bigint, "
         "cost bigint, audit string")


def _walk(batches):
    """Costs and audits of signatures sorted from their ends; shared suffixes are kept on the path."""
    path, last = [END], ""
    for b in batches:
        out = []
        for sig, salts in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            back = sig[::-1]
            shared = len(os.path.commonprefix([last, back]))
            del path[shared + 1:]
            for c in back[shared:]:
                path.append(node_before(c, path[-1]))
            last = back
            faults = [sum(sig.count(chr(97 + 4 * k + f)) for k in range(4)) for f in (BLANK, DUPLICATE, TRUNCATED)]
            out.append((sig, salts, *faults, _illegal(sig), path[-1][0][0], audit_of(path)))
        if out:
            kinds = [pa.string(), pa.list_(pa.int32()), *[pa.int64()] * 5, pa.string()]
            names = [c.split()[0] for c in AUDIT.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)


def audits(found: DataFrame) -> DataFrame:
    """``found`` (conv_id, sig, gaps) with fault counts, cost and audit of each conversation."""
    salted = found.withColumn("salt", F.pmod(F.xxhash64("conv_id"), F.lit(SALTS)).cast("int"))
    distinct = (salted.groupBy("sig", "salt").agg(F.lit(0).alias("one"))
                .groupBy("sig").agg(F.collect_set("salt").alias("salts"))
                .withColumn("back", F.reverse("sig")))
    known = (distinct.repartitionByRange("back").sortWithinPartitions("back").select("sig", "salts")
             .mapInArrow(_walk, AUDIT).withColumn("salt", F.explode("salts")).drop("salts"))
    return salted.join(known, ["sig", "salt"]).drop("sig", "salt")


# -- repaired texts ------------------------------------------------------------------------

def expected_roles(audit: str) -> Iterator[str | None]:
    """The roles of the repaired turns in order; None for a leading system turn, which is kept."""
    n = len(audit) - audit.count("D")
    if n % 2:
        yield None
    for _ in range(n // 2):
        yield "user"
        yield "assistant"


class _Repaired:
    """Running digest of one conversation's repaired turns."""

    def __init__(self, audit: str):
        self.edits, self.roles = iter(audit), expected_roles(audit)
        self.digest, self.between = hashlib.sha256(), b""

    def _put(self, role: str, text: str) -> None:
        self.digest.update(self.between + f"{role}:{text}".encode())
        self.between = b"\n"

    def row(self, role: str, text: str) -> None:
        for edit in self.edits:
            if edit == "D":
                return
            name = next(self.roles)
            if edit == "I":
                self._put(name, "")
                continue
            self._put(role if edit == "K" else name, text)
            return

    def end(self) -> str:
        for _ in self.edits:
            self._put(next(self.roles), "")
        return self.digest.hexdigest()


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
RESULT = ("conv_id bigint, " + ", ".join(f"{c} bigint" for c in COUNTS)
          + ", audit string, repaired_sha256 string")


def _digests(batches):
    """Head rows carry a conversation's results; the rows after it, in order, its turns."""
    names = [c.split()[0] for c in RESULT.split(", ")]
    kinds = [pa.int64()] * 7 + [pa.string()] * 2
    head, state, out = None, None, []
    for b in batches:
        at = {n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)}
        for i, copies in enumerate(at["copies"]):
            if copies is None:
                if head is not None:
                    out.append((*head, state.end()))
                head = [at["conv_id"][i], *(at[c][i] for c in COUNTS), at["audit"][i]]
                state = _Repaired(head[-1])
            else:
                for _ in range(copies):
                    state.row(at["role"][i], at["text"][i])
        if len(out) >= 1000:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
            out = []
    if head is not None:
        out.append((*head, state.end()))
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
    give_back()


def repair(rows: DataFrame) -> DataFrame:
    """Fault counts, cost, audit and digest of the repaired turns of every conversation of ``rows``
    (conv_id, turn, role, text, copies), as ``damaged`` returns them."""
    ship_package(rows.sparkSession)
    rows = rows.withColumn("conv_id", F.col("conv_id").cast("bigint")) \
        .withColumn("turn", F.col("turn").cast("bigint"))
    heads = audits(cut_lineage(signatures(rows)))
    turns = rows.filter("copies > 0").withColumn("digest", _digest())
    both = turns.unionByName(heads, allowMissingColumns=True)
    order = ["conv_id", "copies_known", "turn", "role", "digest"]
    return (both.withColumn("copies_known", F.col("copies").isNotNull())  # a head before its turns
            .repartition("conv_id").sortWithinPartitions(*order)
            .select("conv_id", "copies", "role", "text", *COUNTS, "audit").mapInArrow(_digests, RESULT))


def repaired_turns(turns: list[tuple[str, str]], audit: str) -> list[tuple[str, str]]:
    """The turns that ``audit`` makes of one conversation's (role, text) rows."""
    out, rows = [], iter(turns)
    roles = expected_roles(audit)
    for edit in audit:
        if edit == "I":
            out.append((next(roles), ""))
            continue
        role, text = next(rows)
        if edit != "D":
            name = next(roles)
            out.append((role if edit == "K" else name, text))
    return out


def op11_conversation_repair(spark, sf_dir: str) -> DataFrame:
    return repair(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
