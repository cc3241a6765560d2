"""Names and fixed values shared by every stage of the job."""

from __future__ import annotations

# ---------------------------------------------------------------------------
# These must equal the values of the system being re-built, so
# they are stated verbatim and in their natural order.
# ---------------------------------------------------------------------------

# The seven ordered milestones and the master-dataset column holding each date.
STAGES = ["37A", "7A", "20A", "20E", "20F", "20H", "Mutation"]
STAGE_COLS = ["date_37A", "date_7A", "date_20A", "date_20E",
              "date_20F", "date_20H", "mutation_date"]

# The six gaps between consecutive milestones.
GAPS = ["gap_37A_7A", "gap_7A_20A", "gap_20A_20E",
        "gap_20E_20F", "gap_20F_20H", "gap_20H_mut"]

# The twenty base features, in model order.
BASE_FEATURES = [
    "railway_enc", "division_enc",
    "primary_state", "primary_district",
    "num_states", "num_districts",
    "government_land", "private_land", "forest_area",
    "court_case_count", "active_court_cases", "has_court_cases",
    "start_year", "start_month",
    "land_difficulty_score",
    "forest_proportion", "private_proportion", "govt_proportion",
    "digitalization_score", "digitalization_delay",
]

# Optional objection features (used when the master dataset carries them).
OBJECTION_FEATURES = ["objection_count", "active_objections", "affected_parties"]

# Defaults used when a statistic or a request field is missing.
DEFAULT_GAP_MEAN = 90.0
DEFAULT_GAP_MIN = 20.0
DEFAULT_GAP_MAX = 365.0
DEFAULT_DIGITALIZATION = 0.70
REQUEST_DEFAULTS = {
    "railway": "NR", "division": "DLI", "current_stage": "37A", "current_date": "",
    "states": "3", "districts": "27",
    "government_land": 30.0, "private_land": 60.0, "forest_area": 5.0,
    "court_case_count": 0, "active_court_cases": 0,
}
DEFAULT_PRIMARY_STATE = 3
DEFAULT_PRIMARY_DISTRICT = 27
MIN_ROWS_FOR_MODEL = 20
DATE_TEXT_FORMAT = "d-M-yyyy"      # parses dd-mm-yyyy and unpadded d-m-yyyy
DATE_OUT_FORMAT = "dd-MM-yyyy"

# State name -> state code (33 entries).
STATE_NAME_TO_CODE = {
    "Jammu and Kashmir": 1, "Himachal Pradesh": 2, "Punjab": 3,
    "Chandigarh": 4, "Uttarakhand": 5, "Haryana": 6, "Delhi": 7,
    "Rajasthan": 8, "Uttar Pradesh": 9, "Bihar": 10, "Sikkim": 11,
    "Manipur": 14, "Mizoram": 15, "Tripura": 16, "Assam": 18,
    "West Bengal": 19, "Jharkhand": 20, "Odisha": 21, "Chhattisgarh": 22,
    "Madhya Pradesh": 23, "Gujarat": 24, "Maharashtra": 27,
    "Andhra Pradesh": 28, "Karnataka": 29, "Goa": 30, "Lakshadweep": 31,
    "Kerala": 32, "Tamil Nadu": 33, "Puducherry": 34,
    "Andaman and Nicobar Islands": 35, "Telangana": 36, "Ladakh": 37,
    "Dadra and Nagar Haveli and Daman and Diu": 38,
}

# Last known digitalization share per state code (fallback when no live records).
FALLBACK_DIGITALIZATION = {
    1: 0.7054, 2: 1.0, 3: 0.9962, 4: 1.0, 5: 0.9923,
    6: 1.0, 7: 0.2121, 8: 0.9750, 9: 1.0, 10: 1.0,
    11: 0.9620, 12: 0.0, 13: 0.0, 14: 0.8479, 15: 1.0,
    16: 1.0, 17: 0.0, 18: 0.8813, 19: 0.9970, 20: 0.9935,
    21: 0.9988, 22: 0.9801, 23: 0.9963, 24: 1.0, 27: 1.0,
    28: 1.0, 29: 1.0, 30: 1.0, 31: 1.0, 32: 1.0,
    33: 1.0, 34: 1.0, 35: 1.0, 36: 0.7796, 37: 0.2863, 38: 1.0,
}

# Model hyper-parameters of the three candidates, in selection order.
GBT_PARAMS = dict(maxIter=200, stepSize=0.05, maxDepth=4, minInstancesPerNode=5,
                  subsamplingRate=0.8, seed=42)
RF_PARAMS = dict(numTrees=200, maxDepth=6, minInstancesPerNode=5,
                 featureSubsetStrategy="sqrt", seed=42)
RIDGE_ALPHA = 10.0
CV_MAX_FOLDS = 5
CV_ROWS_PER_FOLD = 10
CV_SEED = 42
CANDIDATES = ["GradientBoosting", "RandomForest", "Ridge"]

# ---------------------------------------------------------------------------
# Derived helpers (not fixed values).
# ---------------------------------------------------------------------------
STAGE_INDEX = {s: i for i, s in enumerate(STAGES)}


def prior_gaps(k: int) -> list[str]:
    """Gap k is modelled with all earlier gaps as extra features."""
    return GAPS[:k]
