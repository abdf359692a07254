import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from veritab.functions import rules as R
from veritab.operators import profile as P
from veritab.operators import recommend as REC


def _types(spark, pdf):
    return P.profile_table(spark.createDataFrame(pdf)).semantic


def test_profiler_types(class_150):
    t = P.profile_table(class_150).semantic
    assert t["cust_id"] == "ID"
    assert t["age"] == "Numeric"
    assert t["region"] == "Categorical"
    assert t["occupation"] == "Text"
    assert t["churn"] == "Categorical"


def test_profiler_profile_and_targets(class_150):
    p = P.profile_table(class_150)
    tp = P.table_profile(p).first()
    assert (tp["n_rows"], tp["n_cols"], tp["n_duplicates"]) == (150, 6, 0)
    targets = [r["column"] for r in REC.target_candidates(p).collect()]
    assert "churn" in targets
    # churn: 2 distinct Categorical + keyword -> 6, ranked first
    first = REC.default_target(p).first()
    assert first["column"] == "churn" and first["score"] == 6


def test_cardinality_threshold_15_16(spark):
    base = np.arange(160)
    t = _types(spark, pd.DataFrame({"a15": (base % 15).astype(float), "b16": (base % 16).astype(float)}))
    assert t["a15"] == R.CATEGORICAL
    assert t["b16"] == R.NUMERIC


def test_id_and_date_rules(spark):
    n = 60
    pdf = pd.DataFrame({
        "width": np.arange(n) % 50 + 0.5,                     # contains "id" but is a float: not an ID
        "order_no": [f"X{i}" for i in range(n)],               # unique short strings: ID
        "created_at": [f"2024-01-{(i % 28) + 1:02d}" for i in range(n)],
        "update_year": ["bad"] + [f"2020-0{(i % 9) + 1}-01" for i in range(n - 1)],
        "k": np.arange(n),                                      # unique integers: ID
    })
    t = _types(spark, pdf)
    assert t["width"] == R.NUMERIC
    assert t["order_no"] == R.ID
    assert t["created_at"] == R.DATETIME
    assert t["update_year"] != R.DATETIME
    assert t["k"] == R.ID


def test_all_null_and_constant(spark):
    pdf = pd.DataFrame({"x": [None] * 5, "c": [1.0] * 5, "y": [1.0, 2.0, 3.0, 4.0, 5.0]})
    df = spark.createDataFrame(pdf, "x string, c double, y double")
    p = P.profile_table(df)
    assert p.semantic["x"] == R.CATEGORICAL
    mp = {r["column_name"]: r for r in P.missing_profile(p).collect()}
    assert mp["x"]["missing_percentage"] == 100.0 and mp["x"]["is_nullable"]
    cands = REC.target_candidates(p).collect()
    assert all(r["column"] != "c" for r in cands)     # constant column never recommended


def test_missing_percentage_half_even(spark):
    # 1 missing of 8 = 12.5 -> 12.5; 1 of 800 = 0.125 -> 0.12 (half to even)
    df = spark.createDataFrame([(None if i == 0 else float(i),) for i in range(800)], "v double")
    mp = P.missing_profile(P.profile_table(df)).first()
    assert mp["missing_percentage"] == 0.12


def test_numeric_stats_match_pandas(spark):
    rng = np.random.default_rng(1)
    vals = np.concatenate([rng.normal(0, 1, 1001), np.full(500, 3.0)])     # a hot value
    pdf = pd.DataFrame({"v": vals})
    p = P.profile_table(spark.createDataFrame(pdf))
    r = P.numeric_stats(p).first()
    s = pdf["v"]
    assert abs(r["median"] - s.median()) < 1e-12
    assert abs(r["mean"] - s.mean()) < 1e-9
    assert abs(r["std"] - s.std()) < 1e-9


def test_top_values_ties_and_percentages(spark):
    df = spark.createDataFrame([(v,) for v in ["b", "a", "c", "a", "b", "d", None]], "v string")
    p = P.profile_table(df)
    top = [(r["value"], r["count"], r["percentage"]) for r in p.top_values().orderBy("rank").collect()]
    assert top[:2] == [("a", 2, 33.33), ("b", 2, 33.33)]
    assert top[2] == ("c", 1, 16.67)


def test_duplicates_with_nulls(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "x"), (2, "x"), (2, "x")], "a int, b string")
    assert P.duplicate_rows(df) == 3


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (3.0,)], "v double")
    p = P.profile_table(df)
    r = P.missing_profile(p).first()
    assert r["missing_count"] == 1


def test_repartition_invariance(spark, class_150):
    a = P.column_profile(P.profile_table(class_150)).drop("top_values").collect()
    b = P.column_profile(P.profile_table(class_150.repartition(7))).drop("top_values").collect()
    def near(rows):        # sums differ in the last bits with the order of the rows
        return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows)
    assert near(a) == near(b)


def test_datetime_range_days(spark):
    df = spark.createDataFrame([("2024-01-01 10:00:00",), ("2024-01-03 09:00:00",)], "s string") \
        .select(F.to_timestamp("s").cast("timestamp_ntz").alias("event_time"))
    r = P.datetime_stats(P.profile_table(df)).first()
    assert r["range_days"] == 1     # 1 day 23 hours -> 1 whole day
