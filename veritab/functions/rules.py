"""Fixed values that the profiling rules must share with the behaviour being reproduced.

Everything here is a plain constant: keyword lists, thresholds and labels. The rules that use
them live in ``veritab.operators``.
"""

# ---- fixed values: name fragments (matched as lower-case substrings of the column name) ----
ID_NAME_PARTS = ["id", "key", "code", "uuid", "pk", "number", "no"]
DATE_NAME_PARTS = ["date", "time", "timestamp", "created", "updated", "year", "month"]
TARGET_KEYWORDS = [
    "target", "label", "class", "status", "churn", "default", "y", "outcome",
    "purchased", "clicked", "sold", "revenue", "price", "profit", "sales",
]
KPI_KEYWORDS = [
    "revenue", "sales", "profit", "cost", "spend", "churn", "conversion",
    "satisfaction", "nps", "score", "margin", "amount", "total",
]

# ---- fixed values: semantic type names ----
NUMERIC = "Numeric"
CATEGORICAL = "Categorical"
DATETIME = "Datetime"
ID = "ID"
TEXT = "Text"

# ---- fixed values: thresholds ----
ID_MAX_AVG_LEN = 20            # avg string length allowed for an ID
ID_MIN_RATIO = 0.8             # unique ratio above which a key-like name is an ID
ID_MIN_DISTINCT = 5            # ... and more distinct values than this
LOW_CARDINALITY = 15           # <= this many distinct values -> Categorical
TEXT_MIN_AVG_LEN = 30          # avg length above which a unique-ish string is Text
TEXT_MIN_RATIO = 0.5
TOP_K = 5                      # top values per categorical column
CANDIDATE_MAX_MISSING = 50.0   # skip target/KPI candidates above this missing %
NUMERIC_FEATURE_MIN_DISTINCT = 10   # numeric dtype and > this many distinct -> numeric feature
ONE_HOT_MAX_DISTINCT = 15           # categorical feature with <= this many -> one-hot, else ordinal
HIST_BINS = 40
TEST_FRACTION = 0.2
SEED = 42

# ---- fixed values: trust-check thresholds ----
SMALL_SAMPLE_ROWS = 100
MISSING_WARN_PCT = 20.0
MISSING_CRIT_PCT = 50.0
LEAKAGE_ABS_R = 0.95
SUSPICIOUS_SCORE = 0.999
IMBALANCE_CRIT_PCT = 5.0
IMBALANCE_WARN_PCT = 20.0
COLLINEAR_ABS_R = 0.85
OVERFIT_GAP = 0.15
HIGH_CARDINALITY = 30
SILHOUETTE_WEAK = 0.25
SILHOUETTE_STRONG = 0.50
CLUSTER_SMALL_PCT = 5.0
CLUSTER_DOMINANT_PCT = 80.0
HIGH_CONFIDENCE_SCORE = 5

# ---- fixed values: missing-value spellings read as NULL from text files ----
NA_SPELLINGS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# ---- fixed values: timestamp patterns tried (after the ISO cast) by the date-name rule, in order of preference ----
DATE_PATTERNS = [
    "MM/dd/yyyy", "MM/dd/yyyy HH:mm:ss", "M/d/yyyy", "M/d/yyyy H:mm",
    "dd/MM/yyyy", "dd/MM/yyyy HH:mm:ss", "d/M/yyyy", "d/M/yyyy H:mm", "yyyy/MM/dd",
    "yyyy/MM/dd HH:mm:ss", "dd.MM.yyyy", "yyyyMMdd", "MMM d, yyyy", "d MMM yyyy",
    "MMMM d, yyyy", "d MMMM yyyy", "yyyy-MM", "yyyy-MM-dd HH:mm",
]
