"""Spark type predicates used by the rules (physical type -> rule branch)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOATING = (T.FloatType, T.DoubleType)
DATETIME = (T.DateType, T.TimestampType, T.TimestampNTZType)


#: Options under which ``to_json`` keeps microseconds.
JSON_MICROS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def is_integral(dt: T.DataType) -> bool:
    return isinstance(dt, INTEGRAL)


def is_floating(dt: T.DataType) -> bool:
    return isinstance(dt, FLOATING)


def is_numeric(dt: T.DataType) -> bool:
    """Numeric for statistics: integers, floats, decimals. Booleans are not (they are Categorical)."""
    return isinstance(dt, T.NumericType)


def is_numeric_or_bool(dt: T.DataType) -> bool:
    """Numeric for correlation / encoding tests, where booleans count as numbers (cast to double)."""
    return isinstance(dt, (T.NumericType, T.BooleanType))


def is_string(dt: T.DataType) -> bool:
    return isinstance(dt, (T.StringType, T.VarcharType, T.CharType))


def is_datetime(dt: T.DataType) -> bool:
    return isinstance(dt, DATETIME)


def is_boolean(dt: T.DataType) -> bool:
    return isinstance(dt, T.BooleanType)


def is_complex(dt: T.DataType) -> bool:
    return isinstance(dt, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))


def dtypes(df: DataFrame) -> dict[str, T.DataType]:
    return {f.name: f.dataType for f in df.schema.fields}


def qc(name: str):
    """Column by exact name, safe for names with spaces, dots or brackets."""
    return F.col("`" + name.replace("`", "``") + "`")


def as_text(name: str, dt: T.DataType):
    """Stringify a column the way values are shown in profiles (booleans as True/False)."""
    c = qc(name)
    if is_boolean(dt):
        return F.when(c, F.lit("True")).when(~c, F.lit("False"))
    if is_complex(dt):
        if isinstance(dt, T.BinaryType):
            return F.hex(c)
        return F.to_json(c, JSON_MICROS)
    return c.cast("string")


def present(name: str):
    """The column as double with NaN as NULL."""
    x = qc(name).cast("double")
    return F.when(~F.isnan(x), x)


def normalise(df: DataFrame) -> DataFrame:
    """NaN -> NULL and -0.0 -> 0.0 for floating columns, so aggregates skip NaN like pandas does."""
    cols = []
    for f in df.schema.fields:
        c = qc(f.name)
        if is_floating(f.dataType):
            c = F.when(F.isnan(c), F.lit(None).cast(f.dataType)).otherwise(c + F.lit(0.0).cast(f.dataType))
        cols.append(c.alias(f.name))
    return df.select(*cols)
