"""Column and table profiling: one fused scan for per-column statistics, one shuffle for value counts,
then semantic typing as a ``when`` chain over the small per-column frame."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import rules as R
from ..functions.stats import (
    distinct_counts, exact_percentiles, materialize_small, safe_ratio, top_k_per_key, value_counts,
)
from ..functions.types import (
    JSON_MICROS, is_boolean, is_complex, is_datetime, is_integral, is_numeric, is_string, normalise, qc,
)

STATS_SCHEMA = T.StructType([
    T.StructField("ordinal", T.IntegerType()),
    T.StructField("column_name", T.StringType()),
    T.StructField("data_type", T.StringType()),
    T.StructField("kind", T.StringType()),          # integral / numeric / string / datetime / boolean / other
    T.StructField("n_rows", T.LongType()),
    T.StructField("non_null", T.LongType()),
    T.StructField("num_min", T.DoubleType()),
    T.StructField("num_max", T.DoubleType()),
    T.StructField("mean", T.DoubleType()),
    T.StructField("std", T.DoubleType()),
    T.StructField("dt_min", T.TimestampNTZType()),
    T.StructField("dt_max", T.TimestampNTZType()),
    T.StructField("avg_len", T.DoubleType()),
    T.StructField("unique_count", T.LongType()),
    T.StructField("date_name_parses", T.BooleanType()),
])


def _kind(dt: T.DataType) -> str:
    if is_boolean(dt):
        return "boolean"
    if is_integral(dt):
        return "integral"
    if is_numeric(dt):
        return "numeric"
    if is_string(dt):
        return "string"
    if is_datetime(dt):
        return "datetime"
    return "other"


def name_has_any(name_col, parts: list[str]):
    """Lower-case substring test of a column name against a fixed list (``F.lower(name).contains``)."""
    low = F.lower(name_col)
    cond = F.lit(False)
    for p in parts:
        cond = cond | low.contains(p)
    return cond


#: How a column of texts may be read as times: the ISO cast, or one of the fixed patterns.
ISO = "iso"
DATE_READINGS = [ISO, *R.DATE_PATTERNS]


def read_as(c, reading: str):
    """Text -> timestamp by one reading; NULL where it does not fit."""
    return (c.try_cast("timestamp_ntz") if reading == ISO else F.try_to_timestamp(c, F.lit(reading)).cast("timestamp_ntz"))


def date_name_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields
            if is_string(f.dataType) and any(p in f.name.lower() for p in R.DATE_NAME_PARTS)]


def date_readings(df: DataFrame, cols: list[str]) -> dict[str, str]:
    """The reading of each text column that fits all of its non-null values, the first in the order of DATE_READINGS; columns
    without one are left out. One aggregate counts for every column and reading the values that it parses, so one value
    of 13/02/2024 decides for a whole column between day and month, and a mix of two patterns is no date. (All values: a
    sample would make the answer depend on the order of the files.)"""
    if not cols:
        return {}
    row = df.agg(*[F.struct(F.count(qc(c)).alias("n"), F.array(*[F.count(read_as(qc(c), r)) for r in DATE_READINGS]).alias("ok"))
                   .alias(f"c{i}") for i, c in enumerate(cols)]).first()
    out = {}
    for i, c in enumerate(cols):
        n, ok = row[f"c{i}"]["n"], row[f"c{i}"]["ok"]
        fits = [r for r, k in zip(DATE_READINGS, ok, strict=True) if n and k == n]
        if fits:
            out[c] = fits[0]
    return out


def semantic_type_expr():
    """The first-match-wins rule chain over the per-column stats frame."""
    c = F.col
    is_id_name = name_has_any(c("column_name"), R.ID_NAME_PARTS)
    ratio = F.coalesce(safe_ratio(c("unique_count"), c("n_rows")), F.lit(0.0))
    # an integer column with nulls would be read as float by pandas, so it is not an integer ID
    id_type = ((c("kind") == "integral") & (c("non_null") == c("n_rows"))) | (c("kind") == "string")
    avg_len = F.when(c("kind") == "string", c("avg_len")).otherwise(F.lit(0.0))
    is_id = id_type & (avg_len <= R.ID_MAX_AVG_LEN) & (
        (c("unique_count") == c("n_rows"))
        | (is_id_name & (ratio > R.ID_MIN_RATIO) & (c("unique_count") > R.ID_MIN_DISTINCT))
    )
    return (
        F.when(c("non_null") == 0, F.lit(R.CATEGORICAL))
        .when(is_id, F.lit(R.ID))
        .when(c("kind") == "datetime", F.lit(R.DATETIME))
        .when((c("kind") == "string") & F.coalesce(c("date_name_parses"), F.lit(False)), F.lit(R.DATETIME))
        .when(c("kind") == "boolean", F.lit(R.CATEGORICAL))
        .when(c("unique_count") <= R.LOW_CARDINALITY, F.lit(R.CATEGORICAL))
        .when(c("kind").isin("integral", "numeric"), F.lit(R.NUMERIC))
        .when((c("kind") == "string") & (c("avg_len") > R.TEXT_MIN_AVG_LEN) & (ratio > R.TEXT_MIN_RATIO), F.lit(R.TEXT))
        .otherwise(F.lit(R.CATEGORICAL))
    )


@dataclass
class TableProfile:
    """Profile of one table. ``stats`` is a small per-column frame (one row per column)."""

    data: DataFrame                      # the normalised input (NaN -> NULL)
    stats: DataFrame                     # STATS_SCHEMA + semantic_type, missing_*, unique_ratio
    semantic: dict[str, str] = field(default_factory=dict)
    n_rows: int = 0
    readings: dict[str, str] = field(default_factory=dict)      # how date-named text columns are read as times
    _top: DataFrame | None = None
    _medians: DataFrame | None = None
    _duplicates: int | None = None

    @property
    def columns(self) -> list[str]:
        return self.data.columns

    def columns_of(self, *types: str) -> list[str]:
        return [c for c in self.columns if self.semantic[c] in types]

    # -- lazily computed parts --------------------------------------------------------------
    def top_values(self, k: int = R.TOP_K) -> DataFrame:
        """(ordinal, column_name, rank, value, count, percentage) for Categorical columns."""
        if self._top is None:
            cat = {i: c for i, c in enumerate(self.columns) if self.semantic[c] == R.CATEGORICAL}
            vc = value_counts(self.data, list(cat.values()))
            widest = max([r["unique_count"] for r in self.stats.where(F.col("semantic_type") == R.CATEGORICAL)
                          .select("unique_count").collect()] or [0])
            # about a million distinct values per first-level window partition, whatever the column width
            salts = int(min(1 << 16, max(64, -(-widest // 1_000_000))))
            top = top_k_per_key(vc, "ordinal", [F.col("cnt").desc(), F.col("value").asc()], k, "value", salts=salts)
            nn = self.stats.select("ordinal", "column_name", "non_null")
            self._top = materialize_small(
                top.join(F.broadcast(nn), "ordinal")
                .select("ordinal", "column_name", "rank", "value", F.col("cnt").alias("count"),
                        F.bround(safe_ratio(F.col("cnt"), F.col("non_null")) * 100, 2).alias("percentage"))
            )
        return self._top

    def medians(self) -> DataFrame:
        """(column_name, median) for Numeric columns, exact."""
        if self._medians is None:
            num = self.columns_of(R.NUMERIC)
            spark = self.data.sparkSession
            if not num:
                self._medians = spark.createDataFrame([], "column_name string, median double")
            else:
                med = exact_percentiles(self.data, num, [0.5])
                self._medians = materialize_small(med.select("column_name", F.col("value").alias("median")))
        return self._medians

    def duplicates(self) -> int:
        if self._duplicates is None:
            self._duplicates = duplicate_rows(self.data)
        return self._duplicates


def duplicate_rows(df: DataFrame) -> int:
    """Rows equal to an earlier row over all columns (NULLs equal). Wide or text rows are grouped by a
    SHA-256 digest of their JSON form (with microseconds) so the shuffle carries 64 characters per row."""
    return int(duplicate_rows_frame(df).first()["n_duplicates"])


def duplicate_rows_frame(df: DataFrame) -> DataFrame:
    df = normalise(df)
    heavy = any(is_string(f.dataType) or is_complex(f.dataType) for f in df.schema.fields)
    if heavy:
        digest = F.sha2(F.to_json(F.struct(*[qc(c) for c in df.columns]), JSON_MICROS), 256)
        groups = df.groupBy(digest.alias("_d")).count()
    else:
        groups = df.groupBy(*[qc(c) for c in df.columns]).count()
    return groups.agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("long").alias("n_duplicates"))


def _column_aggregates(df: DataFrame) -> list:
    """One struct per column with everything a single scan can compute."""
    structs = []
    for i, f in enumerate(df.schema.fields):
        c = qc(f.name)
        kind = _kind(f.dataType)
        num = kind in ("integral", "numeric")
        dtm = kind == "datetime"
        structs.append(F.struct(
            F.lit(i).alias("ordinal"),
            F.count(c).alias("non_null"),
            (F.min(c).cast("double") if num else F.lit(None).cast("double")).alias("num_min"),
            (F.max(c).cast("double") if num else F.lit(None).cast("double")).alias("num_max"),
            (F.avg(c).cast("double") if num else F.lit(None).cast("double")).alias("mean"),
            (F.stddev_samp(c).cast("double") if num else F.lit(None).cast("double")).alias("std"),
            (F.min(c).cast("timestamp_ntz") if dtm else F.lit(None).cast("timestamp_ntz")).alias("dt_min"),
            (F.max(c).cast("timestamp_ntz") if dtm else F.lit(None).cast("timestamp_ntz")).alias("dt_max"),
            (F.avg(F.length(c)).cast("double") if kind == "string" else F.lit(None).cast("double")).alias("avg_len"),
        ))
    return structs


def profile_table(df: DataFrame) -> TableProfile:
    """Compute the per-column stats frame and semantic types of ``df``.

    Jobs: (1) one scan with all per-column aggregates, (2) distinct counts (one shuffle, texts as digests),
    (3) the date-name check of eligible string columns only. The per-column result is tiny (one row per
    column) and is rebuilt as a local frame to cut lineage. Values themselves are counted only when top
    values are asked for, and only those of Categorical columns.
    """
    spark: SparkSession = df.sparkSession
    data = normalise(df)
    fields = data.schema.fields
    agg_row = data.agg(F.count(F.lit(1)).alias("n_rows"), F.array(*_column_aggregates(data)).alias("cols")).first()
    n_rows = int(agg_row["n_rows"])
    distinct = {int(r["ordinal"]): int(r["distinct"]) for r in distinct_counts(data).collect()}
    named = date_name_columns(data)
    readings = date_readings(data, named)
    rows = []
    for s in agg_row["cols"]:
        i = int(s["ordinal"])
        f = fields[i]
        rows.append((
            i, f.name, f.dataType.simpleString(), _kind(f.dataType), n_rows, int(s["non_null"]),
            s["num_min"], s["num_max"], s["mean"], s["std"], s["dt_min"], s["dt_max"], s["avg_len"],
            distinct.get(i, 0), f.name in readings if f.name in named else None,
        ))
    stats = spark.createDataFrame(rows, STATS_SCHEMA)
    missing = F.col("n_rows") - F.col("non_null")
    stats = (
        stats.withColumn("semantic_type", semantic_type_expr())
        .withColumn("missing_count", missing)
        .withColumn("missing_percentage", F.bround(F.coalesce(safe_ratio(missing, F.col("n_rows")) * 100, F.lit(0.0)), 2))
        .withColumn("unique_ratio", F.coalesce(safe_ratio(F.col("unique_count"), F.col("n_rows")), F.lit(0.0)))
        .withColumn("is_nullable", missing > 0)
    )
    semantic = {r["column_name"]: r["semantic_type"] for r in stats.select("column_name", "semantic_type").collect()}
    return TableProfile(data=data, stats=stats, semantic=semantic, n_rows=n_rows, readings=readings)


def profile_tables(tables: dict[str, DataFrame], max_workers: int = 4) -> dict[str, TableProfile]:
    """Profile several tables with their Spark jobs submitted concurrently (the scheduler interleaves
    them, so small tables do not wait behind large ones)."""
    from concurrent.futures import ThreadPoolExecutor
    with ThreadPoolExecutor(max_workers=max(1, min(max_workers, len(tables)))) as pool:
        futures = {name: pool.submit(profile_table, df) for name, df in tables.items()}
        return {name: f.result() for name, f in futures.items()}


# --------------------------------------------------------------------------------------------
# user-facing frames
# --------------------------------------------------------------------------------------------

def semantic_types(p: TableProfile) -> DataFrame:
    return p.stats.select("ordinal", "column_name", "data_type", "semantic_type")


def missing_profile(p: TableProfile) -> DataFrame:
    return p.stats.select("ordinal", "column_name", "missing_count", "missing_percentage", "is_nullable")


def unique_profile(p: TableProfile) -> DataFrame:
    return p.stats.select("ordinal", "column_name", "unique_count", "unique_ratio")


def avg_string_length(p: TableProfile) -> DataFrame:
    return p.stats.where(F.col("kind") == "string").select("ordinal", "column_name", "avg_len")


def id_rule(p: TableProfile) -> DataFrame:
    return p.stats.select("ordinal", "column_name", (F.col("semantic_type") == R.ID).alias("is_id"))


def numeric_stats(p: TableProfile) -> DataFrame:
    """min, max, mean, exact median, sample std (0.0 for a single value) of Numeric columns."""
    return (
        p.stats.where((F.col("semantic_type") == R.NUMERIC) & (F.col("non_null") > 0))
        .join(F.broadcast(p.medians()), "column_name", "left")
        .select("ordinal", "column_name", F.col("num_min").alias("min"), F.col("num_max").alias("max"),
                "mean", "median",
                F.when(F.col("non_null") > 1, F.col("std")).otherwise(F.lit(0.0)).alias("std"))
    )


def datetime_stats(p: TableProfile) -> DataFrame:
    """min, max and whole-day range of Datetime columns; text dates are parsed, bad values dropped."""
    dt_cols = p.columns_of(R.DATETIME)
    spark = p.data.sparkSession
    if not dt_cols:
        return spark.createDataFrame([], "ordinal int, column_name string, min timestamp_ntz, max timestamp_ntz, range_days long")
    text_cols = [c for c in dt_cols if is_string(p.data.schema[c].dataType)]
    st = p.stats.where(F.col("semantic_type") == R.DATETIME).select("ordinal", "column_name", "dt_min", "dt_max")
    if text_cols:
        parsed = p.data.agg(*[
            F.struct(F.min(read_as(qc(c), p.readings[c])).alias("lo"), F.max(read_as(qc(c), p.readings[c])).alias("hi")).alias(c)
            for c in text_cols
        ]).first()
        fill = spark.createDataFrame([(c, parsed[c]["lo"], parsed[c]["hi"]) for c in text_cols],
                                     "column_name string, plo timestamp_ntz, phi timestamp_ntz")
        st = (st.join(F.broadcast(fill), "column_name", "left")
              .withColumn("dt_min", F.coalesce("dt_min", "plo")).withColumn("dt_max", F.coalesce("dt_max", "phi"))
              .drop("plo", "phi"))
    micros = F.timestamp_diff("MICROSECOND", F.col("dt_min"), F.col("dt_max"))   # wall-clock, no time zone
    return st.where(F.col("dt_min").isNotNull()).select(
        "ordinal", "column_name", F.col("dt_min").alias("min"), F.col("dt_max").alias("max"),
        F.floor(micros / F.lit(86_400_000_000)).cast("long").alias("range_days"),
    )


def column_profile(p: TableProfile) -> DataFrame:
    """One row per column: name, dtype, semantic type, missing, unique, nullable + type-specific stats
    (numeric stats, top values as array<struct>, datetime range)."""
    num = numeric_stats(p).select("column_name", "min", "max", "median",
                                  F.col("std").alias("std_out"))
    top = (p.top_values().groupBy("column_name")
           .agg(F.sort_array(F.collect_list(F.struct("rank", "value", "count", "percentage"))).alias("tv"))
           .select("column_name", F.transform("tv", lambda s: F.struct(
               s["value"].alias("value"), s["count"].alias("count"), s["percentage"].alias("percentage"))).alias("top_values")))
    dts = datetime_stats(p).select("column_name", F.col("min").alias("dt_min_out"), F.col("max").alias("dt_max_out"), "range_days")
    return (
        p.stats.join(F.broadcast(num), "column_name", "left")
        .join(F.broadcast(top), "column_name", "left")
        .join(F.broadcast(dts), "column_name", "left")
        .select("ordinal", "column_name", "data_type", "semantic_type", "missing_count", "missing_percentage",
                "unique_count", "is_nullable", "min", "max",
                F.when(F.col("semantic_type") == R.NUMERIC, F.col("mean")).alias("mean"), "median",
                F.col("std_out").alias("std"), "top_values",
                F.col("dt_min_out").alias("dt_min"), F.col("dt_max_out").alias("dt_max"), "range_days")
        .orderBy("ordinal")
    )


def table_profile(p: TableProfile) -> DataFrame:
    spark = p.data.sparkSession
    return spark.createDataFrame([(p.n_rows, len(p.columns), p.duplicates())],
                                 "n_rows long, n_cols int, n_duplicates long")


def stats_summary(p: TableProfile) -> DataFrame:
    """One-line text per column as shown in the profile table."""
    cp = column_profile(p)
    tv0 = F.col("top_values")[0]
    text = (
        F.when((F.col("semantic_type") == R.NUMERIC) & F.col("mean").isNotNull(),
               F.format_string("Mean:%.2f | [%.2f,%.2f]", F.col("mean"), F.col("min"), F.col("max")))
        .when((F.col("semantic_type") == R.CATEGORICAL) & (F.size("top_values") > 0),
              F.format_string("Top:'%s' (%d rows)", tv0["value"], tv0["count"]))
        .when((F.col("semantic_type") == R.DATETIME) & F.col("dt_min").isNotNull(),
              F.concat(F.lit("Range:"), F.col("dt_min").cast("string"), F.lit(" → "), F.col("dt_max").cast("string")))
        .otherwise(F.lit(""))
    )
    return cp.select("ordinal", "column_name", "data_type", "semantic_type",
                     F.concat(F.col("missing_percentage").cast("string"), F.lit("%")).alias("missing"),
                     "unique_count", text.alias("summary"))


def completeness(p: TableProfile) -> DataFrame:
    """(cells - null cells) / cells * 100, 0 when the table is empty."""
    return p.stats.agg(
        F.sum("n_rows").cast("long").alias("cells"),
        F.sum("missing_count").cast("long").alias("null_cells"),
    ).select("cells", "null_cells",
             F.coalesce(safe_ratio(F.col("cells") - F.col("null_cells"), F.col("cells")) * 100, F.lit(0.0)).alias("completeness"))


def type_counts(p: TableProfile) -> DataFrame:
    """Numeric / Categorical column counts and fill rate (100 - mean missing %, 100 when no columns)."""
    return p.stats.agg(
        F.sum(F.when(F.col("semantic_type") == R.NUMERIC, 1).otherwise(0)).cast("long").alias("n_numeric"),
        F.sum(F.when(F.col("semantic_type") == R.CATEGORICAL, 1).otherwise(0)).cast("long").alias("n_categorical"),
        F.coalesce(100 - F.avg("missing_percentage"), F.lit(100.0)).alias("fill_rate"),
    )
