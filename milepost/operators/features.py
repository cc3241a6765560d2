"""Feature rows for training, stored-project scoring and request scoring.

One builder, three modes, because the rules differ on purpose:

=================  ==========================  ==========================  =======================
feature            ``train`` (master rows)     ``project`` (active rows)   ``request``
=================  ==========================  ==========================  =======================
state / district   first token, NULL -> 0      digit tokens, default 3/27  digit tokens, 3/27
list sizes         token count, NULL -> 1      digit-token count           digit-token count
land columns       as stored                   0 -> 30 / 60 / 5            as sent
land total         stored total, 0 -> 1        sum of parts, 0 -> 1        sum, <= 0 -> 1
start year/month   of date_37A                 of date_37A                 of the request date
=================  ==========================  ==========================  =======================

``consistent=True`` applies the training rules in every mode.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import (BASE_FEATURES, DEFAULT_PRIMARY_DISTRICT, DEFAULT_PRIMARY_STATE, GAPS,
                         OBJECTION_FEATURES, STAGE_COLS)
from ..functions import columns as C
from ..functions.encoding import encode
from .digitalization import add_digitalization

LAND_DEFAULTS = {"government_land": 30.0, "private_land": 60.0, "forest_area": 5.0}


def with_dates(df: DataFrame, cols=STAGE_COLS) -> DataFrame:
    """make every stage column a date (text is parsed, bad text -> NULL)."""
    types = {f.name: f.dataType for f in df.schema.fields}
    return df.select(*[C.parse_date(c, types[c]).alias(c) if c in cols else F.col(c)
                       for c in df.columns])


def with_gaps(df: DataFrame) -> DataFrame:
    """the six stage gaps in days."""
    return df.select("*", *[C.gap_days(STAGE_COLS[i], STAGE_COLS[i + 1]).alias(g)
                            for i, g in enumerate(GAPS)])


def own_features(df: DataFrame, mode: str, consistent: bool = False) -> DataFrame:
    """Add the features that need no other table: lists, land, counts and start.

    ``df`` is master rows (``train`` / ``project``) or decoded requests
    (``request``: ``start_date`` already resolved, see ``scoring.decode``).
    Keeps the input columns and adds the feature columns.
    """
    rule = "train" if consistent else mode
    d = df
    if mode in ("train", "project"):
        d = with_gaps(with_dates(d))
    if rule == "train":
        lists = {
            "primary_state": C.first_token_int("states", 0).cast("bigint"),
            "primary_district": C.first_token_int("districts", 0).cast("bigint"),
            "num_states": C.token_count("states", 1),
            "num_districts": C.token_count("districts", 1),
        }
    else:
        lists = {
            "primary_state": C.first_digit_token("states", DEFAULT_PRIMARY_STATE),
            "primary_district": C.first_digit_token("districts", DEFAULT_PRIMARY_DISTRICT),
            "num_states": C.digit_token_count("states"),
            "num_districts": C.digit_token_count("districts"),
        }
    d = d.select("*", *[v.alias(k) for k, v in lists.items()])

    # land columns and their total
    if rule == "project":
        land = {k: C.nonzero_or(k, v) for k, v in LAND_DEFAULTS.items()}
    else:
        land = {k: F.col(k).cast("double") for k in LAND_DEFAULTS}
    d = d.select(*[c for c in d.columns if c not in land], *[v.alias(k) for k, v in land.items()])
    parts = F.col("government_land") + F.col("private_land") + F.col("forest_area")
    if rule == "train":  # a request stores no total: it is the sum of its parts
        total = C.safe_total(F.col("total_land").cast("double") if mode != "request" else parts, "zero")
    else:
        total = C.safe_total(parts, "zero" if rule == "project" else "positive")
    shares = C.land_scores("government_land", "private_land", "forest_area", total)

    start = F.col("date_37A") if mode in ("train", "project") else F.col("start_date")
    counts = {c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
              for c in ["court_case_count", "active_court_cases"]}
    return d.select(*[c for c in d.columns if c not in counts],
                    *[v.alias(k) for k, v in counts.items()],
                    C.flag_positive("court_case_count").alias("has_court_cases"),
                    F.year(start).alias("start_year"), F.month(start).alias("start_month"),
                    *[v.alias(k) for k, v in shares.items()])


def build_features(df: DataFrame, mode: str, railway_codes: DataFrame,
                   division_codes: DataFrame, scores: DataFrame,
                   with_objections: bool = False, consistent: bool = False) -> DataFrame:
    """Add all base features to ``df``: ``own_features``, codes and digitalization scores."""
    d = own_features(df, mode, consistent)
    d = encode(d, "railway", railway_codes, "railway_enc")
    d = encode(d, "division", division_codes, "division_enc")
    d = add_digitalization(d, scores)
    if with_objections:
        for c in OBJECTION_FEATURES:
            d = d.withColumn(c, F.coalesce(F.col(c), F.lit(0)).cast("bigint"))
    return d


def feature_names(with_objections: bool = False) -> list[str]:
    return BASE_FEATURES + (OBJECTION_FEATURES if with_objections else [])
