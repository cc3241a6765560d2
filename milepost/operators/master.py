"""Master dataset: one wide row per project x allocation.

Plan shape (every per-project aggregate is pre-aggregated before it meets a
join, so a hot project, case or award collapses map-side):

* milestones   one ``groupBy(project_id)`` over a union of the six milestone
               feeds (4 notification tables + award rows carrying their
               per-award payment / mutation minimum) -> 7 ``min`` columns;
* court cases  details pre-aggregated per case (row count, area), surveys as they are;
               both joined to the case rows on ``case_id``;
* objections   one shuffle by project; only projects with very many objections go
               through Catalyst's expansion of the three distinct counts;
* assembly     project rows, still one per project, are left-joined to the three
               aggregates (unique keys on both sides, so no key can be hot);
* allocations  come last, where the rows fan out, in one join: keys with many
               allocations and null keys are salted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import STAGE_COLS
from ..session import bound_tasks

ALLOCATION_COLS = ["uwid", "PROJECTID", "ShortNameofWork", "railway", "division",
                   "exec_agency_rly", "states", "districts", "land_acq_status"]

PROJECT_BASE_COLS = ["project_id", "project_name", "uwid", "pink_book_ref",
                     "allocation_project_id", "ShortNameofWork", "railway", "division",
                     "exec_agency_rly", "states", "districts", "land_acq_status",
                     "government_land", "private_land", "forest_area", "total_land",
                     "land_available", "land_to_be_acquired", "state_id", "status"]

PROJECT_COLS = ["project_id", "project_name", "pink_book_ref", "government_land", "private_land",
                "forest_area", "total_land", "land_available", "land_to_be_acquired", "state_id",
                "status"]
# allocations of one key that a task may hold; keys with more are dealt into parts
HEAVY_ROWS = 100_000
# hashes that projects are counted by before they are counted one by one
COUNT_HASHES = 65_536
# parts that rows without a key are dealt over in a join
NULL_PARTS = 1024

COURT_COLS = ["court_case_count", "active_court_cases", "first_court_case_date",
              "last_court_case_date", "total_disputed_area", "disputed_surveys"]
OBJECTION_COLS = ["objection_count", "active_objections", "first_objection_date",
                  "latest_objection_date", "affected_surveys", "affected_parties"]

MASTER_COLS = (["uwid", "project_id", "project_name", "allocation_project_id",
                "ShortNameofWork", "railway", "division", "exec_agency_rly", "states",
                "districts", "land_acq_status", "government_land", "private_land",
                "forest_area", "total_land", "land_available", "land_to_be_acquired",
                "state_id", "status"] + STAGE_COLS + COURT_COLS + OBJECTION_COLS)


def _is_active(status: Column, collation: str | None) -> Column:
    """``status = 'Active'``; optionally under a server-like collation."""
    if collation:
        return F.collate(status, collation) == F.lit("Active")
    return status == F.lit("Active")


def _count_active(status: Column, weight: Column | None = None,
                  collation: str | None = None) -> Column:
    w = weight if weight is not None else F.lit(1)
    # SUM(CASE WHEN status='Active' THEN 1 ELSE 0 END): a NULL status counts 0.
    return F.when(_is_active(status, collation), w).otherwise(F.lit(0)).cast("bigint")


# -- R1 / R2 ----------------------------------------------------------------

def allocation_base(allocation: DataFrame) -> DataFrame:
    """DISTINCT over the nine allocation columns."""
    return allocation.select(*ALLOCATION_COLS).distinct()


def with_allocations(projects: DataFrame, allocation: DataFrame,
                     heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """R2: every project row left-joined to its (distinct) allocations on ``pink_book_ref``.

    A key with more than ``heavy_rows`` allocations is dealt into that many parts: its
    allocations by a hash of the row, its projects once to every part. All keys go through one
    left join, so ``projects`` is computed once; rows with a null key match nothing and are dealt
    over ``NULL_PARTS`` parts. No row is lost or doubled: a part of a heavy key without
    allocations gives no row, its other parts do.
    """
    ab = allocation_base(allocation).where(F.col("PROJECTID").isNotNull())
    fanned = [c for c in ALLOCATION_COLS if c != "PROJECTID"]
    ab = ab.select(F.col("PROJECTID").alias("allocation_project_id"), *fanned)
    # at most rows / heavy_rows keys, so it is broadcast; both sides reuse one exchange
    heavy = F.broadcast(
        ab.groupBy("allocation_project_id").agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > heavy_rows)
        .select(F.col("allocation_project_id").alias("__key"),
                F.ceil(F.col("n") / heavy_rows).cast("int").alias("__parts")))
    one_of = lambda n: F.pmod(F.xxhash64("project_id"), F.lit(n)).cast("int")
    left = projects.join(heavy, F.col("pink_book_ref") == F.col("__key"), "left") \
        .withColumn("__part", F.explode(F.when(F.col("pink_book_ref").isNull(), F.array(one_of(NULL_PARTS)))
                                        .otherwise(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1))))
    right = ab.join(heavy, F.col("allocation_project_id") == F.col("__key"), "left") \
        .withColumn("__salt", F.pmod(F.xxhash64(*fanned), F.coalesce("__parts", F.lit(1))).cast("int")) \
        .drop("__key", "__parts")
    return left.join(right, (F.col("pink_book_ref") == F.col("allocation_project_id"))
                     & (F.col("__part") == F.col("__salt")), "left") \
        .where(F.col("__parts").isNull() | F.col("__salt").isNotNull()) \
        .drop("__key", "__parts", "__part", "__salt")


def _first_allocation(out: DataFrame, columns: list[str]) -> DataFrame:
    """One row per project: the first allocation by ``uwid, division``."""
    return (out.groupBy("project_id")
            .agg(F.min_by(F.struct(*[c for c in columns if c != "project_id"]),
                          F.struct("uwid", "division")).alias("r"))
            .select("project_id", "r.*").select(*columns))


def project_base(project_basic: DataFrame, allocation: DataFrame,
                 dedupe: bool = False, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """R2: every project row left-joined to its (distinct) allocations.

    One project with n allocation rows yields n rows (kept by default); with
    ``dedupe=True`` the first allocation by ``uwid, division`` is kept.
    """
    out = with_allocations(project_basic.select(*PROJECT_COLS), allocation, heavy_rows) \
        .select(*PROJECT_BASE_COLS)
    return _first_allocation(out, PROJECT_BASE_COLS) if dedupe else out


# -- R3..R9 -----------------------------------------------------------------

def _as_date(c: str) -> Column:
    # CAST(MIN(x) AS DATE): the cast is monotone, so casting first is equal and narrower.
    return F.col(c).cast("date")


def award_dates(nhai_award: DataFrame, nhai_award_det: DataFrame) -> DataFrame:
    """Per award row: approval date and the earliest payment / mutation of its details.

    ``MIN`` over ``award JOIN detail`` per project equals ``MIN`` over awards of the
    per-award minimum, so details collapse to one row per award before the join.
    """
    det = (nhai_award_det.groupBy("award_id")
           .agg(F.min(_as_date("payment_date")).alias("pay_min"),
                F.min(_as_date("mutation_date")).alias("mut_min")))
    return (nhai_award.select("award_id", "project_id", _as_date("approval_date").alias("approval"))
            .join(det, "award_id", "left"))


def milestone_dates(src: dict[str, DataFrame]) -> DataFrame:
    """R3-R9 in one aggregate: first date of each of the seven milestones per project.

    Only projects with at least one non-null milestone date appear.
    """
    feeds = []
    for i, name in enumerate(["notification_37A", "la_notification_master",
                              "three_A_master", "three_d_master"]):
        cols = [F.col("project_id")] + [
            (_as_date("publish_date") if j == i else F.lit(None).cast("date")).alias(STAGE_COLS[j])
            for j in range(7)]
        feeds.append(src[name].select(*cols))
    aw = award_dates(src["nhai_award"], src["nhai_award_det"])
    feeds.append(aw.select(
        "project_id", *[F.lit(None).cast("date").alias(c) for c in STAGE_COLS[:4]],
        F.col("approval").alias(STAGE_COLS[4]), F.col("pay_min").alias(STAGE_COLS[5]),
        F.col("mut_min").alias(STAGE_COLS[6])))
    u = feeds[0]
    for f in feeds[1:]:
        u = u.unionByName(f)
    u = u.where(F.coalesce(*[F.col(c) for c in STAGE_COLS]).isNotNull())
    return u.groupBy("project_id").agg(*[F.min(c).alias(c) for c in STAGE_COLS])


def first_stage_dates_long(src: dict[str, DataFrame]) -> DataFrame:
    """R3-R6 in long form: (project_id, stage, first_date).

    Each feed is a stage of its own, so it is aggregated alone, by project only.
    """
    feeds = []
    for stage, name in [("37A", "notification_37A"), ("7A", "la_notification_master"),
                        ("20A", "three_A_master"), ("20E", "three_d_master")]:
        feeds.append(src[name].where(F.col("publish_date").isNotNull())
                     .groupBy("project_id").agg(F.min(_as_date("publish_date")).alias("first_date"))
                     .select("project_id", F.lit(stage).alias("stage"), "first_date"))
    u = feeds[0]
    for f in feeds[1:]:
        u = u.unionByName(f)
    return u


def award_stage_dates(nhai_award: DataFrame, nhai_award_det: DataFrame) -> DataFrame:
    """date_20F, date_20H, mutation_date per project (one join, three mins)."""
    aw = award_dates(nhai_award, nhai_award_det)
    out = aw.groupBy("project_id").agg(F.min("approval").alias("date_20F"),
                                       F.min("pay_min").alias("date_20H"),
                                       F.min("mut_min").alias("mutation_date"))
    return out.where(F.coalesce("date_20F", "date_20H", "mutation_date").isNotNull())


# -- R10..R13 ---------------------------------------------------------------

def court_case_summary(court_case: DataFrame, details: DataFrame, per_case: bool = False,
                       collation: str | None = None) -> DataFrame:
    """Per project counts, dates, disputed area and surveys.

    ``active_court_cases`` counts joined rows (a case with m detail rows counts m
    times), as the source query does; ``per_case=True`` counts each case row once.

    The case/detail join is never materialised: details collapse to one row per
    case (row count, area) before a left join whose right side is unique, and the
    surveys go through an inner join with the distinct (case, project) pairs (both sides splittable
    by AQE skew handling), so a case holding a large share of the details is no straggler.
    """
    det_case = (details.groupBy("case_id")
                .agg(F.count(F.lit(1)).alias("n_rows"),
                     F.sum(F.coalesce(F.col("area"), F.lit(0.0))).alias("area")))
    cases = court_case.select("case_id", "project_id", "status", "from_date", "to_date") \
        .join(det_case, "case_id", "left")
    weight = None if per_case else F.coalesce(F.col("n_rows"), F.lit(1))
    per_project = cases.groupBy("project_id").agg(
        F.count_distinct("case_id").alias("court_case_count"),
        F.coalesce(F.sum(_count_active(F.col("status"), weight, collation)),
                   F.lit(0)).cast("bigint").alias("active_court_cases"),
        F.min(_as_date("from_date")).alias("first_court_case_date"),
        F.max(_as_date("to_date")).alias("last_court_case_date"),
        F.coalesce(F.sum("area"), F.lit(0.0)).alias("total_disputed_area"))
    # not made distinct first: that is a shuffle of all details, and the count below does it anyway
    pairs = (details.where(F.col("survey_id").isNotNull()).select("case_id", "survey_id")
             .join(court_case.select("case_id", "project_id").distinct(), "case_id", "inner"))
    surveys = pairs.groupBy("project_id").agg(
        F.count_distinct("survey_id").alias("disputed_surveys"))
    return per_project.join(surveys, "project_id", "left").select(
        "project_id", "court_case_count", "active_court_cases", "first_court_case_date",
        "last_court_case_date", "total_disputed_area",
        F.coalesce(F.col("disputed_surveys"), F.lit(0)).cast("bigint").alias("disputed_surveys"))


def _count_hash() -> Column:
    return F.pmod(F.xxhash64("project_id"), F.lit(COUNT_HASHES))


def objection_summary(objections: DataFrame, collation: str | None = None,
                      heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """Per project objection counts and dates.

    An objection is shuffled once, to its project, where a project's distinct values are counted
    after a sort. Projects with more than ``heavy_rows`` objections are dealt by project and value
    instead, four narrow rows an objection, so that none meets in one task.
    """
    rows = objections.select("project_id", "objection_id", "survey_id", "party_id",
                             _count_active(F.col("status"), None, collation).alias("active"),
                             _as_date("objection_date").alias("date"))
    # projects are counted by hash first, a row per hash and task; those of a hash with few objections
    # can't be heavy, so only the others are counted one by one.
    # not written: a master that reads no objection column leaves this out as well
    full = (rows.groupBy(_count_hash().alias("__hash")).agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") > heavy_rows).select("__hash"))
    asked = rows.join(F.broadcast(full), _count_hash() == F.col("__hash"), "left_semi")
    heavy = (asked.groupBy("project_id").agg(F.count(F.lit(1)).alias("n"))
             .where(F.col("n") > heavy_rows).select(F.col("project_id").alias("__hot")))
    # null-safe: objections without a project are a group of their own
    hot = F.broadcast(heavy)
    same = F.col("project_id").eqNullSafe(F.col("__hot"))

    def summary(part: DataFrame, distinct) -> DataFrame:
        return part.groupBy("project_id").agg(
            distinct("objection_id").cast("bigint").alias("objection_count"),
            F.sum("active").alias("active_objections"),
            F.min("date").alias("first_objection_date"), F.max("date").alias("latest_objection_date"),
            distinct("survey_id").cast("bigint").alias("affected_surveys"),
            distinct("party_id").cast("bigint").alias("affected_parties"))
    light = summary(rows.join(hot, same, "left_anti").repartition("project_id"),
                    lambda c: F.size(F.collect_set(c)))
    both = light.unionByName(summary(rows.join(hot, same, "left_semi"), F.count_distinct))
    # one row a project already: the grouping tells Spark so, which drops a join that nothing reads
    return both.groupBy("project_id").agg(*[F.max(c).alias(c) for c in OBJECTION_COLS])


def milestone_rows(src: dict[str, DataFrame]) -> DataFrame:
    """(project_id, the seven dates) of every master row, for work that needs nothing else.

    A project is repeated once per distinct allocation of its ``pink_book_ref`` (once where there
    is none): the allocations are counted by key before they meet the projects, so their
    columns, the court cases and the objections are never read. Rows with a null key are dealt
    over parts, as in ``with_allocations``.
    """
    bound_tasks(src["project_basic"].sparkSession)
    counts = (allocation_base(src["AllocationWise"]).where(F.col("PROJECTID").isNotNull())
              .groupBy("PROJECTID").agg(F.count(F.lit(1)).alias("__n")))
    projects = src["project_basic"].select("project_id", "pink_book_ref") \
        .join(milestone_dates(src), "project_id", "left")
    part = F.when(F.col("pink_book_ref").isNull(), F.pmod(F.xxhash64("project_id"), F.lit(NULL_PARTS))).otherwise(F.lit(0))
    found = projects.withColumn("__part", part).join(
        counts.withColumn("__salt", F.lit(0).cast("bigint")),
        (F.col("pink_book_ref") == F.col("PROJECTID")) & (F.col("__part") == F.col("__salt")), "left")
    return found.select("project_id", *STAGE_COLS, F.explode(F.sequence(
        F.lit(1).cast("bigint"), F.coalesce("__n", F.lit(1)))).alias("__i")).drop("__i")


# -- R14..R16 ---------------------------------------------------------------

def master_dataset(src: dict[str, DataFrame], dedupe: bool = False, per_case: bool = False,
                   collation: str | None = None, ordered: bool = False,
                   heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """The 38-column master dataset.

    ``ordered`` adds the final ``ORDER BY project_id`` (a range shuffle, only
    useful for presentation; downstream stages do not need it).
    """
    bound_tasks(src["project_basic"].sparkSession)
    ms = milestone_dates(src)
    cc = court_case_summary(src["court_case"], src["court_case_details"], per_case, collation)
    ob = objection_summary(src["three_A_objections"], collation)
    projects = src["project_basic"].select(*PROJECT_COLS).join(ms, "project_id", "left") \
        .join(cc, "project_id", "left").join(ob, "project_id", "left")
    j = with_allocations(projects, src["AllocationWise"], heavy_rows)
    if dedupe:
        j = _first_allocation(j, j.columns)
    zero = {c: F.coalesce(F.col(c), F.lit(0)).alias(c) for c in
            ["court_case_count", "active_court_cases", "disputed_surveys", "objection_count",
             "active_objections", "affected_surveys", "affected_parties"]}
    zero["total_disputed_area"] = F.coalesce(F.col("total_disputed_area"),
                                             F.lit(0.0)).alias("total_disputed_area")
    out = j.select(*[zero.get(c, F.col(c)) for c in MASTER_COLS])
    if ordered:
        out = out.orderBy("project_id")
    return out
