"""Quality rules with risk-controlled thresholds.

Each rule rejects a text whose measure lies above a cutoff of a fixed grid. In a stratum
(language) only cutoffs whose false rejection rate among the good labelled documents is
proven may be used; of these the one that rejects most bad less good documents is, the
laxest of equals, and none where that is not above 0. Proof: with n good documents of which k are rejected, the
exact binomial tail P(Bin(n, a) <= k) must not exceed delta / (number of tests), where
a = ALPHA / number of rules and the tests are all (stratum, rule, cutoff) triples
(Bonferroni). A union bound over the rules then keeps the false rejections of a
stratum within ALPHA with probability 1 - DELTA. Strata with too few labels prove no
cutoff and reject nothing by rule.

Defined results: a null or empty text has no words and fails the base rule (fewer than
10 words); a null language is the stratum ``und``; several labels of one document count
once, as good if any is; labels of unknown documents are ignored; without labels only
the base rules act. Only doc_id, text and lang are read, so other columns can't clash.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

ALPHA = 0.02
DELTA = 0.05
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

# Rule name -> (measure, grid of cutoffs from lax to strict).
RULES = {
    "symbols": ("n_symbols / greatest(word_chars, 1)",
                [0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.08, 0.06, 0.04, 0.03, 0.02, 0.01]),
    "dup_lines": ("n_dup_lines / greatest(n_lines, 1)",
                  [0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1]),
    "repeats": ("n_repeat_words / greatest(n_words, 1)",
                [0.19, 0.18, 0.16, 0.14, 0.12, 0.1, 0.08, 0.06, 0.04]),
    "long_words": ("word_chars / greatest(n_words, 1)",
                   [30.0, 25.0, 20.0, 16.0, 14.0, 12.0, 11.0, 10.0, 9.5, 9.0]),
    "short_words": ("-(word_chars / greatest(n_words, 1))",
                    [-1.5, -2.0, -2.5, -3.0, -3.5]),
}


def with_measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` plus one struct column ``_m`` of measures, all JVM expressions.

    Words in repeated windows: the window hashes are compared by a hash set first;
    only texts with a repeat sort (hash, position) pairs, keep those with an equal
    neighbour and add up the union of the 5-word spans.
    """
    space = r"[\\x20\\x09-\\x0D]"
    rest = [c for c in docs.columns]
    m = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("_d"),
                    F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_t"))
    m = m.withColumn("_w", F.expr(f"filter(split(_t, '{space}+'), x -> x != '')"))
    m = m.withColumn("_l", F.expr(
        f"filter(split(_t, '\\n'), x -> x rlike '[^\\\\x20\\\\x09-\\\\x0D]')"))
    m = m.withColumn("_h", F.expr(
        "case when size(_w) >= 5 then transform(sequence(0, size(_w) - 5), i -> "
        "xxhash64(_w[i], _w[i + 1], _w[i + 2], _w[i + 3], _w[i + 4])) "
        "else cast(array() as array<bigint>) end"))
    m = m.withColumn("_s", F.expr(
        "case when size(array_distinct(_h)) < size(_h) then "
        "sort_array(transform(_h, (h, i) -> struct(h, i))) end"))
    m = m.withColumn("_r", F.expr(
        "sort_array(transform(filter(_s, (x, i) -> x.h <=> get(_s, i - 1).h "
        "or x.h <=> get(_s, i + 1).h), x -> x.i))"))
    # exploding the one struct keeps filters on measures from being pushed into the lambdas
    return m.select(*[F.col("_d")[c].alias(c) for c in rest], F.explode(F.array(F.struct(
        F.expr("cast(size(_w) as bigint)").alias("n_words"),
        F.expr(f"cast(char_length(regexp_replace(_t, '{space}+', '')) as bigint)").alias("word_chars"),
        F.expr("cast(regexp_count(_t, '[#*$%&|<>]') as bigint)").alias("n_symbols"),
        F.expr("cast(size(_l) - size(array_distinct(_l)) as bigint)").alias("n_dup_lines"),
        F.expr("coalesce(aggregate(_r, struct(0L as n, 0 as upto), (a, s) -> struct("
               "a.n + s + 5 - greatest(s, a.upto) as n, s + 5 as upto), a -> a.n), 0L)")
        .alias("n_repeat_words"),
        F.expr("cast(size(_l) as bigint)").alias("n_lines")))).alias("_m"))


def base_failed() -> Column:
    return F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words")


def _ln_gamma(x: str) -> str:
    """ln Gamma(x), x >= 1: Stirling's series after a shift by 8 (error below 1e-11)."""
    z = f"({x} + 8d)"
    shift = " * ".join(f"({x} + {i}d)" for i in range(8))
    return (f"(({z} - 0.5d) * ln({z}) - {z} + 0.9189385332046727d + 1d / (12d * {z}) "
            f"- 1d / (360d * pow({z}, 3)) + 1d / (1260d * pow({z}, 5)) - ln({shift}))")


def binomial_tail(k: str, n: str, p: float, steps: int = 4096) -> Column:
    """P(Bin(n, p) <= k) for k < n p, else 1; sums down from the largest term.

    The ratios of the terms fall, so what lies beyond ``steps`` terms is bounded by a
    geometric series and added: the result is never below the exact tail.
    """
    log_top = (f"{_ln_gamma(f'({n} + 1d)')} - {_ln_gamma(f'({k} + 1d)')} "
               f"- {_ln_gamma(f'({n} - {k} + 1d)')} + {k} * ln({p}d) + ({n} - {k}) * ln(1d - {p}d)")
    ratio = lambda j: f"(({j}) * (1d - {p}d) / (({n} - ({j}) + 1d) * {p}d))"
    series = (f"case when {k} < 1 then 1d else aggregate(sequence(1, cast(least({k}, {steps}) as int)), "
              f"struct(1d as term, 1d as total), (a, i) -> struct("
              f"a.term * {ratio(f'{k} - i + 1d')} as term, "
              f"a.total + a.term * {ratio(f'{k} - i + 1d')} as total), "
              f"a -> a.total + case when {k} > {steps} then a.term * {ratio(f'{k} - {steps}')} "
              f"/ (1d - {ratio(f'{k} - {steps}')}) else 0d end) end")
    return F.expr(f"case when {k} >= {n} * {p}d then 1d else least(1d, exp({log_top}) * {series}) end")


def _passed(value: Column, grid: Column) -> Column:
    """How many cutoffs of the falling or rising ``grid`` lie below ``value``."""
    return F.size(F.filter(grid, lambda c: value > c))


def calibrate(measured: DataFrame, labels: DataFrame, alpha: float = ALPHA,
              delta: float = DELTA) -> DataFrame:
    """(stratum, cutoffs map<rule, double>): the best proven cutoff of each rule.

    ``measured``: doc_id, stratum and the measures. All labelled documents that pass
    the base rules are counted; the counts per (stratum, rule, bin) are partial
    aggregates, so a stratum that holds most rows is not gathered anywhere.
    """
    truth = (labels.filter("doc_id is not null and quality is not null")
             .groupBy("doc_id").agg(F.max("quality").alias("good")))
    held = measured.filter(~base_failed()).join(truth, "doc_id")
    grids = {r: F.lit(g) for r, (_, g) in RULES.items()}
    bins = [F.struct(F.lit(r).alias("rule"),
                     _passed(F.expr(v), grids[r]).alias("bin"))
            for r, (v, _) in RULES.items()]
    counts = (held.select("stratum", "good", F.explode(F.array(*bins)).alias("b"))
              .groupBy("stratum", "b.rule", "b.bin")
              .agg(F.sum(F.when(F.col("good") == 1, 1).otherwise(0)).alias("good"),
                   F.sum(F.when(F.col("good") == 1, 0).otherwise(1)).alias("bad")))
    counts = cut_lineage(counts)
    tests = counts.select("stratum").distinct().count() * sum(len(g) for _, g in RULES.values())
    by = Window.partitionBy("stratum", "rule")
    above = by.orderBy(F.desc("bin"))  # documents whose measure passes at least `bin` cutoffs
    risk = alpha / len(RULES)
    tried = (counts.select("stratum", "rule", "bin",
                           F.sum("good").over(above).cast("double").alias("k"),
                           F.sum("bad").over(above).alias("bad"),
                           F.sum("good").over(by).cast("double").alias("n"))
             .withColumn("p_value", binomial_tail("k", "n", risk)))
    # a measure that passes `bin` cutoffs passes the strictest ones of its grid
    cutoff = F.coalesce(*[F.when(F.col("rule") == r, F.get(g, F.size(g) - F.col("bin")))
                          for r, g in grids.items()])
    proven = (tried.filter((F.col("bin") > 0) & (F.col("p_value") <= delta / max(1, tests)))
              .select("stratum", "rule", F.struct((F.col("bad") - F.col("k")).alias("gain"),
                                                  cutoff.alias("cutoff")).alias("c"))
              .groupBy("stratum", "rule").agg(F.max("c").alias("c"))  # of equal gains the laxest
              .filter("c.gain > 0").select("stratum", "rule", F.col("c.cutoff").alias("cutoff")))
    return proven.groupBy("stratum").agg(
        F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cutoffs"))


def _stratum() -> Column:
    return F.coalesce(F.col("lang"), F.lit("und"))


def _passes() -> Column:
    fired = [F.coalesce(F.expr(v) > F.element_at("cutoffs", r), F.lit(False))
             for r, (v, _) in RULES.items()]
    return ~base_failed() & ~reduce(lambda a, b: a | b, fired)


def verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, base measures, base_failed and kept of every document."""
    measured = cut_lineage(with_measures(docs.select("doc_id", "text", "lang"))
                           .select("doc_id", _stratum().alias("stratum"), "_m.*"))
    cutoffs = cut_lineage(calibrate(measured, labels))
    return measured.join(cutoffs, "stratum", "left").select(
        "doc_id", *BASE, base_failed().alias("base_failed"), _passes().alias("kept"),
        "stratum", "cutoffs")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass the base rules and the calibrated cutoffs."""
    measured = cut_lineage(with_measures(docs.select("doc_id", "text", "lang"))
                           .select("doc_id", _stratum().alias("stratum"), "_m.*"))
    cutoffs = cut_lineage(calibrate(measured, labels)).withColumnRenamed("stratum", "_stratum")
    names = [f"c{i}" for i in range(len(docs.columns))]
    text, lang = (names[docs.columns.index(c)] for c in ("text", "lang"))
    return (with_measures(docs.toDF(*names), text)
            .withColumn("_stratum", F.coalesce(F.col(lang), F.lit("und")))
            .join(cutoffs, "_stratum", "left").select(*names, "_m.*", "cutoffs")
            .filter(_passes()).select(*names).toDF(*docs.columns))


def op8_risk_rules(spark, sf_dir: str) -> DataFrame:
    return verdicts(spark.read.parquet(f"{sf_dir}/documents.parquet"),
                    spark.read.parquet(f"{sf_dir}/labels.parquet")).drop("stratum", "cutoffs")
