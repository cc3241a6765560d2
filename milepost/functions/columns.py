"""Column expressions (all JVM-side, codegen-friendly) for dates, lists and land.

Every function takes and returns ``Column`` objects, so callers compose them in a
single ``select`` and Catalyst keeps the whole feature row in one codegen stage.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StringType, TimestampNTZType, TimestampType

from ..constants import DATE_OUT_FORMAT, DATE_TEXT_FORMAT


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# -- dates (F1, F2, F6, F19, F20) -------------------------------------------

def parse_date(c, dtype=StringType()) -> Column:
    """``dd-mm-yyyy`` text -> date; unparsable text -> NULL.

    Columns already holding a date (or a timestamp) pass through as a date.
    """
    c = col_(c)
    if isinstance(dtype, DateType):
        return c
    if isinstance(dtype, (TimestampType, TimestampNTZType)):
        return c.cast("date")
    return F.try_to_date(c.cast("string"), DATE_TEXT_FORMAT)


def format_date(c) -> Column:
    """date -> ``dd-mm-yyyy``."""
    return F.date_format(col_(c), DATE_OUT_FORMAT)


def gap_days(src, dst) -> Column:
    """whole days from ``src`` to ``dst`` (negative allowed, NULL if either is NULL)."""
    return F.datediff(col_(dst), col_(src)).cast("int")


def strip(c) -> Column:
    """Python ``str.strip()``: remove leading / trailing whitespace of any kind."""
    return F.regexp_replace(col_(c), r"^\s+|\s+$", "")


# -- comma separated lists (F4, F5, F14) ------------------------------------

def first_token_int(c, null_value: int = 0) -> Column:
    """F4 (training rule): first comma token as int; NULL text -> ``null_value``.

    A non-numeric first token gives ``null_value`` as well (the training script
    would stop there).
    """
    c = col_(c)
    tok = strip(F.get(F.split(c, ","), 0)).try_cast("int")
    return F.when(c.isNull(), F.lit(null_value)).otherwise(F.coalesce(tok, F.lit(null_value)))


def token_count(c, null_value: int = 1) -> Column:
    """F5 (training rule): number of comma tokens; NULL text -> ``null_value``."""
    c = col_(c)
    return F.when(c.isNull(), F.lit(null_value)).otherwise(F.size(F.split(c, ",")))


def digit_tokens(c) -> Column:
    """tokens made only of digits after stripping, as ints (NULL text -> empty)."""
    toks = F.transform(F.split(F.coalesce(col_(c), F.lit("")), ","), lambda t: strip(t))
    kept = F.filter(toks, lambda t: t.rlike("^[0-9]+$"))
    return F.transform(kept, lambda t: t.try_cast("bigint"))


def first_digit_token(c, default: int) -> Column:
    """first digit-only token, else ``default``."""
    return F.coalesce(F.get(digit_tokens(c), 0), F.lit(default)).cast("bigint")


def digit_token_count(c) -> Column:
    """number of digit-only tokens (0 when there is none)."""
    return F.size(digit_tokens(c))


# -- land (F8, F9, F15, F17) -------------------------------------------------

def nonzero_or(c, default: float) -> Column:
    """``x or default`` on a number: 0 -> default; NULL (NaN) stays NULL."""
    c = col_(c)
    return F.when(c == 0, F.lit(float(default))).otherwise(c)


def safe_total(total, rule: str) -> Column:
    """Denominator for the land shares.

    ``zero``     0 -> 1 (training on the stored total, scoring of stored projects);
    ``positive`` <= 0 -> 1 (scoring of a request).
    """
    t = col_(total)
    if rule == "positive":
        return F.when(t > 0, t).otherwise(F.lit(1.0))
    return F.when(t == 0, F.lit(1.0)).otherwise(t)


def land_scores(govt, priv, forest, total) -> dict[str, Column]:
    """Difficulty score and the three land shares over ``total``."""
    g, p, f, t = col_(govt), col_(priv), col_(forest), col_(total)
    return {
        "land_difficulty_score": (f * 3 + p * 2 + g * 1) / t,
        "forest_proportion": f / t,
        "private_proportion": p / t,
        "govt_proportion": g / t,
    }


def flag_positive(c) -> Column:
    """``count > 0`` as 0/1 (NULL -> 0)."""
    return F.coalesce((col_(c) > 0).cast("int"), F.lit(0))


def clamp_round(pred, lo, hi) -> Column:
    """Clamp to [lo, hi] and round half to even (Python ``round``)."""
    return F.bround(F.greatest(col_(lo), F.least(col_(hi), col_(pred))), 0)
