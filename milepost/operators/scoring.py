"""Task 1 on tables: decode requests, forecast every later stage, encode responses.

(S9, F16, F19, P10, P11, P14, S10.) One job scores any number of requests; the
work is row-local apart from the two small dimension joins of the features.
The decoder accepts a batch or a streaming DataFrame.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import (DATE_TEXT_FORMAT, GAPS, OBJECTION_FEATURES, REQUEST_DEFAULTS,
                         STAGE_INDEX, STAGES)
from ..functions.columns import format_date
from .features import build_features
from .forecast import chain
from .models import ModelSet

TEXT_FIELDS = ["railway", "division", "current_stage", "current_date", "states", "districts"]
FLOAT_FIELDS = ["government_land", "private_land", "forest_area"]
INT_FIELDS = ["court_case_count", "active_court_cases"]
REQUEST_FIELDS = TEXT_FIELDS + FLOAT_FIELDS + INT_FIELDS
NOT_AN_OBJECT = "request body is not a JSON object"


def _as_of(as_of) -> Column:
    if as_of is None:
        return F.current_date()
    if isinstance(as_of, str):
        as_of = _dt.date.fromisoformat(as_of)
    return F.lit(as_of)


def decode_requests(df: DataFrame, id_col: str = "request_id", body_col: str | None = None,
                    rename: dict[str, str] | None = None, as_of=None) -> DataFrame:
    """One typed request row per input row.

    ``body_col`` holds a JSON object; otherwise the request fields are columns
    (``rename`` maps field -> column; there a NULL counts as missing). A missing field
    takes its default. A JSON null is the text ``None`` in a text field and an error in a
    number field; a text in a number field must spell a number, in a count field a whole
    one, while a JSON number in a count field is cut to a whole one. A count beyond 64
    bits and a body that is no JSON object are errors. ``error`` names what is wrong, and
    such a row carries defaults, so it never fails the job. A request date that does not
    parse as ``dd-mm-yyyy`` becomes ``as_of`` (today by default).
    """
    rename = rename or {}
    if body_col:
        v = F.try_parse_json(F.col(body_col))
        raw = df.select(F.col(id_col), v.alias("v")).select(
            id_col, F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False)).alias("whole"),
            *[F.try_variant_get("v", f"$.{f}", "string").alias(f"raw_{f}") for f in REQUEST_FIELDS],
            *[F.schema_of_variant(F.try_variant_get("v", f"$.{f}", "variant")).alias(f"kind_{f}")
              for f in REQUEST_FIELDS])
    else:
        kinds = dict(df.dtypes)
        raw = df.select(F.col(id_col), F.lit(True).alias("whole"), *[
            (F.col(rename.get(f, f)).cast("string") if rename.get(f, f) in kinds
             else F.lit(None).cast("string")).alias(f"raw_{f}") for f in REQUEST_FIELDS], *[
            F.when(F.col(rename.get(f, f)).isNotNull(),
                   "STRING" if kinds[rename.get(f, f)] == "string" else "NUMBER").alias(f"kind_{f}")
            if rename.get(f, f) in kinds else F.lit(None).cast("string").alias(f"kind_{f}")
            for f in REQUEST_FIELDS])
    out = [F.col(id_col)]
    errors = [F.when(~F.col("whole"), F.lit(NOT_AN_OBJECT))]
    for f in TEXT_FIELDS:
        out.append(F.when(F.col(f"kind_{f}") == "VOID", F.lit("None")).otherwise(
            F.coalesce(F.col(f"raw_{f}"), F.lit(REQUEST_DEFAULTS[f]))).alias(f))
    for f in FLOAT_FIELDS + INT_FIELDS:
        r, kind = F.trim(F.col(f"raw_{f}")), F.col(f"kind_{f}")
        if f in INT_FIELDS:
            # a text must spell a whole number, a number is cut
            num = F.when(kind == "STRING", F.when(r.rlike("^[+-]?[0-9]+$"), r.try_cast("bigint"))) \
                .otherwise(r.try_cast("double").try_cast("bigint"))
            default = F.lit(int(REQUEST_DEFAULTS[f])).cast("bigint")
        else:
            num, default = r.try_cast("double"), F.lit(float(REQUEST_DEFAULTS[f]))
        errors.append(F.when(kind.isNotNull() & num.isNull(), F.lit(f"bad number in {f}")))
        out.append(F.coalesce(num, default).alias(f))
    out.append(F.concat_ws("; ", *errors).alias("__err"))
    d = raw.select(*out)
    stage_idx = F.coalesce(F.try_element_at(F.create_map(*[x for s, i in STAGE_INDEX.items()
                                                       for x in (F.lit(s), F.lit(i))]),
                                        F.col("current_stage")), F.lit(0))
    return d.select(
        "*", F.when(F.col("__err") == "", F.lit(None)).otherwise(F.col("__err")).alias("error"),
        stage_idx.cast("int").alias("current_idx"),
        F.coalesce(F.try_to_date(F.col("current_date"), DATE_TEXT_FORMAT),
                   _as_of(as_of)).alias("start_date")).drop("__err")


def score_requests(req: DataFrame, models: ModelSet, consistent: bool = False) -> DataFrame:
    """P10: add days_k / date_k1 for every later stage; priors start empty.

    A request carries no objection counts; when the models were trained with them
    they arrive as NULL and take the training medians (the fitted imputation).
    """
    if not models.needs_features:
        return chain(req, models, "current_idx", "start_date")
    feats = build_features(models.spread(req), "request", models.railway_codes, models.division_codes,
                           models.scores, False, consistent)
    if models.with_objections:
        feats = feats.select("*", *[F.lit(None).cast("double").alias(c)
                                    for c in OBJECTION_FEATURES if c not in feats.columns])
    return chain(feats, models, "current_idx", "start_date")


def predictions_long(scored: DataFrame, id_col: str = "request_id") -> DataFrame:
    """One row per predicted stage: days, date and days from the request date."""
    items = [F.struct(F.lit(k + 1).alias("stage_idx"), F.lit(STAGES[k + 1]).alias("stage"),
                      F.col(f"days_{k}").cast("int").alias("predicted_days"),
                      F.col(f"date_{k + 1}").alias("d")) for k in range(len(GAPS))]
    long = scored.where(F.col("error").isNull()) \
        .select(id_col, "start_date", F.inline(F.array(*items))) \
        .where(F.col("d").isNotNull())
    return long.select(id_col, "stage_idx", "stage", "predicted_days",
                       format_date("d").alias("predicted_date"),
                       F.datediff(F.col("d"), F.col("start_date")).alias("gap_from_now"))


def envelope(scored: DataFrame, id_col: str = "request_id") -> DataFrame:
    """The response of each request as columns plus its JSON text.

    A failed request gets ``success = false`` and its error; the job never fails
    on one bad request.
    """
    preds = F.filter(F.array(*[
        F.struct(F.lit(STAGES[k + 1]).alias("stage"),
                 F.col(f"days_{k}").cast("int").alias("predicted_days"),
                 format_date(F.col(f"date_{k + 1}")).alias("predicted_date"),
                 F.datediff(F.col(f"date_{k + 1}"), F.col("start_date")).alias("gap_from_now"))
        for k in range(len(GAPS))]), lambda x: x["predicted_date"].isNotNull())
    ok = F.col("error").isNull()
    good = F.struct(F.lit(True).alias("success"), F.col("current_stage"),
                    format_date("start_date").alias("current_date"),
                    preds.alias("predictions"), F.col("railway"), F.col("division"))
    bad = F.struct(F.lit(False).alias("success"), F.col("error"))
    return scored.select(
        id_col, ok.alias("success"), "error", "current_stage",
        format_date("start_date").alias("current_date"), "railway", "division",
        F.when(ok, F.size(preds)).otherwise(F.lit(0)).alias("n_predictions"),
        F.when(ok, F.to_json(good)).otherwise(F.to_json(bad)).alias("response"))
