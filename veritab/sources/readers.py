"""Readers: pick a format from the extension and load it as a DataFrame with inferred types.

Text formats are read as strings, the usual missing-value spellings become NULL, and each column is
then typed by one aggregate over the whole file (all values integral -> bigint, all numeric -> double,
all true/false -> boolean), the way a pandas reader types a CSV column.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType
from pyspark.sql.utils import AnalysisException

from ..functions import rules as R
from ..functions.types import is_string, qc
from .records import csv_records

EXTENSIONS = {".csv": "csv", ".json": "json", ".parquet": "parquet", ".pq": "parquet"}
UNSUPPORTED = {".xlsx": "excel", ".xls": "excel", ".db": "sqlite", ".sqlite": "sqlite", ".sqlite3": "sqlite"}
TRUE_WORDS = ["True", "TRUE", "true"]
#: One dialect for reading and writing: quotes are doubled, white space belongs to the value.
CSV_OPTIONS = {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
#: Options that leave record boundaries as they are.
SPLIT_OPTIONS = {"header", "sep", "delimiter", "nullvalue", "emptyvalue", "maxcolumns", "maxcharspercolumn"}
FALSE_WORDS = ["False", "FALSE", "false"]


def infer_file_type(path: str) -> str:
    _, ext = os.path.splitext(path.rstrip("/").lower())
    if ext in EXTENSIONS:
        return EXTENSIONS[ext]
    if ext in UNSUPPORTED:
        return UNSUPPORTED[ext]
    raise ValueError(f"no reader is known for the extension {ext!r}; name the file type")


def na_to_null(df: DataFrame) -> DataFrame:
    """Map the missing-value spellings to NULL in string columns."""
    cols = []
    for f in df.schema.fields:
        c = qc(f.name)
        if is_string(f.dataType):
            c = F.when(F.trim(c).isin(R.NA_SPELLINGS) | c.isin(R.NA_SPELLINGS), F.lit(None)).otherwise(c)
        cols.append(c.alias(f.name))
    return df.select(*cols)


def type_text_columns(df: DataFrame) -> DataFrame:
    """Give string columns the narrowest type all their non-null values fit, in one aggregate."""
    strs = [f.name for f in df.schema.fields if is_string(f.dataType)]
    if not strs:
        return df
    aggs = []
    for i, c in enumerate(strs):
        v = F.trim(qc(c))
        aggs += [
            F.count(qc(c)).alias(f"n{i}"),
            F.count(v.try_cast("bigint")).alias(f"i{i}"),
            F.count(v.try_cast("double")).alias(f"d{i}"),
            F.count(F.when(v.isin(TRUE_WORDS + FALSE_WORDS), 1)).alias(f"b{i}"),
        ]
    row = df.agg(*aggs).first()
    out = []
    for f in df.schema.fields:
        c = qc(f.name)
        if f.name in strs:
            i = strs.index(f.name)
            n = row[f"n{i}"]
            v = F.trim(c)
            if n and row[f"i{i}"] == n:
                c = v.try_cast("bigint")
            elif n and row[f"d{i}"] == n:
                c = v.try_cast("double")
            elif n and row[f"b{i}"] == n:
                c = F.when(v.isin(TRUE_WORDS), F.lit(True)).when(v.isin(FALSE_WORDS), F.lit(False))
        out.append(c.alias(f.name))
    return df.select(*out)


def load_csv(spark: SparkSession, path: str, **options) -> DataFrame:
    """CSV with a header row; every column read as text, NA spellings -> NULL, then typed.

    Quoted fields may hold quotes, separators and line breaks, and padding is kept. A file is read by as many tasks as it has
    byte ranges: ``records.csv_records`` finds the record starts. Lines end with a line feed (and carriage return or not);
    with options that change quoting, escaping, encoding or line ends, Spark's reader takes each file in one task.
    """
    opts = {"header": "true", "inferSchema": "false"} | CSV_OPTIONS | {"multiLine": "true"}
    opts.update({k: str(v) for k, v in options.items()})
    whole = spark.read.options(**opts).csv(path)
    if any(k.lower() not in SPLIT_OPTIONS for k in options):
        return type_text_columns(na_to_null(whole))
    sep = next((v for k, v in opts.items() if k.lower() in ("sep", "delimiter")), ",")
    header = next(v for k, v in reversed(opts.items()) if k.lower() == "header").lower() == "true"
    rows = csv_records(spark, path, sep, opts["quote"], header)
    plain = StructType([StructField(f"c{i}", f.dataType) for i, f in enumerate(whole.schema.fields)])
    parsed = rows.select(F.from_csv("text", plain.simpleString()[len("struct<"):-1].replace(":", " "),
                                    {k: v for k, v in opts.items() if k.lower() not in ("header", "inferschema")}).alias("row"))
    raw = parsed.select(*(F.col("row")[f"c{i}"].alias(f.name) for i, f in enumerate(whole.schema.fields)))
    return type_text_columns(na_to_null(raw))


def load_json(spark: SparkSession, path: str, lines: bool | None = None, **options) -> DataFrame:
    """JSON records: JSON Lines, or one array of records per file (``lines=False`` or detected)."""
    if lines is None or lines:
        df = spark.read.options(**options).json(path)
        if lines or [c for c in df.columns if c != "_corrupt_record"]:
            return df
    return spark.read.options(**options).option("multiLine", "true").json(path)


def load_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def load_table(spark: SparkSession, name: str) -> DataFrame:
    """A table or view of the session catalog (the catalog takes the place of a database file)."""
    return spark.table(name)


def list_tables(spark: SparkSession, database: str | None = None) -> DataFrame:
    rows = [(t.name, t.database, t.tableType, bool(t.isTemporary)) for t in spark.catalog.listTables(database)]
    return spark.createDataFrame(rows, "name string, database string, table_type string, is_temporary boolean")


def load_jdbc(spark: SparkSession, url: str, table: str, partition_column: str | None = None,
              lower: int | None = None, upper: int | None = None, num_partitions: int | None = None,
              **properties) -> DataFrame:
    """A database table over JDBC, read in parallel slices when a numeric partition column is given."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    if partition_column:
        reader = (reader.option("partitionColumn", partition_column).option("lowerBound", lower)
                  .option("upperBound", upper).option("numPartitions", num_partitions or 8))
    for k, v in properties.items():
        reader = reader.option(k, v)
    return reader.load()


def load_dataset(spark: SparkSession, path: str, file_type: str | None = None, table_name: str | None = None,
                 **options) -> DataFrame:
    """Load by explicit type or by extension; an unknown explicit type falls back to CSV."""
    if file_type is None:
        file_type = infer_file_type(path)
    if file_type == "csv":
        return load_csv(spark, path, **options)
    if file_type == "json":
        return load_json(spark, path, **options)
    if file_type == "parquet":
        return load_parquet(spark, path)
    if file_type == "table":
        return load_table(spark, table_name or path)
    if file_type in ("excel", "sqlite"):
        raise ValueError(f"{file_type} files are single-machine formats; export to parquet/CSV or use load_jdbc")
    try:
        df = load_csv(spark, path, **options)
        df.schema  # noqa: B018  (forces analysis so a bad path fails here)
        return df
    except AnalysisException as e:
        raise ValueError(f"{path!r} could not be read as CSV, the fallback for the type {file_type!r}: {e}") from e
