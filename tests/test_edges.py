"""Edge fixtures: booleans, unique date strings, integer keys with NULLs, singleton classes, empty and
one-row tables, a single cluster, long text values in top values."""

import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from veritab.functions import rules as R
from veritab.functions.stats import materialize_small, spread, top_k_per_key, value_counts
from veritab.operators import cluster as C
from veritab.operators import eda as E
from veritab.operators import models as MD
from veritab.operators import prep as PR
from veritab.operators import profile as P


def test_boolean_is_categorical_and_numeric_for_correlation(spark):
    rows = [(i % 2 == 0, float(i), float(i % 2)) for i in range(40)]
    df = spark.createDataFrame(rows, "flag boolean, x double, y double")
    p = P.profile_table(df)
    assert p.semantic["flag"] == R.CATEGORICAL
    top = {r["value"] for r in p.top_values().collect() if r["column_name"] == "flag"}
    assert top == {"True", "False"}
    m = {(r["col_i"], r["col_j"]): r["r"] for r in E.correlation_matrix(df, ["flag", "y"]).collect()}
    assert abs(m[("flag", "y")] + 1.0) < 1e-12


def test_unique_short_date_strings_are_ids(spark):
    df = spark.createDataFrame([(f"2024-01-{d:02d}",) for d in range(1, 29)], "signup_date string")
    assert P.profile_table(df).semantic["signup_date"] == R.ID


def test_integer_key_with_and_without_nulls(spark):
    full = spark.createDataFrame([(i,) for i in range(30)], "user_key bigint")
    assert P.profile_table(full).semantic["user_key"] == R.ID
    holes = spark.createDataFrame([(None if i == 0 else i,) for i in range(30)], "user_key bigint")
    assert P.profile_table(holes).semantic["user_key"] == R.NUMERIC


def test_singleton_class_disables_stratification(spark):
    rows = [("a", float(i)) for i in range(20)] + [("b", 99.0)]
    df = spark.createDataFrame(rows, "y string, x double")
    assert not PR.should_stratify(df, "y", "Classification")
    counts = {r["_split"]: r["count"] for r in PR.train_test_split(df).groupBy("_split").count().collect()}
    assert counts == {"train": 16, "test": 5}


def test_zero_and_one_row_tables(spark):
    empty = spark.createDataFrame([], "a double, b string")
    p = P.profile_table(empty)
    assert p.n_rows == 0
    assert all(t == R.CATEGORICAL for t in p.semantic.values())
    assert P.completeness(p).first()["completeness"] == 0.0
    one = spark.createDataFrame([(1.5, "x")], "a double, b string")
    p1 = P.profile_table(one)
    r = {x["column_name"]: x for x in P.column_profile(p1).collect()}
    assert r["b"]["semantic_type"] == R.ID                 # unique short string
    assert P.table_profile(p1).first()["n_duplicates"] == 0


def test_single_cluster_indices_are_zero(spark):
    df = spark.createDataFrame([(float(i), 0) for i in range(10)], "x double, prediction int")
    vec = VectorAssembler(inputCols=["x"], outputCol="features").transform(df)
    m = C.quality_indices(vec)
    assert set(m.values()) == {0.0} and C.SILHOUETTE in m


def test_rows_a_microsecond_apart_are_no_duplicates(spark):
    df = spark.sql("SELECT 'x' AS s, TIMESTAMP_NTZ'2024-01-01 00:00:00.000001' AS t UNION ALL "
                   "SELECT 'x', TIMESTAMP_NTZ'2024-01-01 00:00:00.000002' UNION ALL "
                   "SELECT 'x', TIMESTAMP_NTZ'2024-01-01 00:00:00.000002'")
    assert P.duplicate_rows(df) == 1


def test_top_values_with_control_characters(spark):
    df = spark.createDataFrame([("\u0000a",)] * 3 + [("b",)] * 2 + [("\u0001",)], "v string")
    top = [(r["value"], r["count"]) for r in P.profile_table(df).top_values().orderBy("rank").collect()]
    assert top == [("\u0000a", 3), ("b", 2), ("\u0001", 1)]


def test_date_rule_looks_at_all_values(spark):
    rows = [(f"2024-01-{1 + i % 28:02d}", "2024-02-03" if i < 180 else "soon") for i in range(200)]
    df = spark.createDataFrame(rows * 3, "good_date string, late_date string")
    assert set(P.date_readings(df, ["good_date", "late_date"])) == {"good_date"}


def test_one_reading_for_a_whole_date_column(spark):
    rows = [("13/02/2024", "02/03/2024", "02/03/2024", "2024-01-05", "1/2/2024"), ("02/03/2024", "04/05/2024", "13/02/2024", "01/06/2024", "12/31/2024"),
            ("01/12/2024", None, "02/28/2024", "2024-01-07", "3/4/2024")] * 20
    df = spark.createDataFrame(rows, "day_date string, either_date string, mixed_date string, two_date string, month_date string")
    assert P.date_readings(df, df.columns) == {"day_date": "dd/MM/yyyy", "either_date": "MM/dd/yyyy", "month_date": "M/d/yyyy"}
    stats = {r["column_name"]: (str(r["min"])[:10], str(r["max"])[:10]) for r in P.datetime_stats(P.profile_table(df)).collect()}
    assert stats == {"day_date": ("2024-02-13", "2024-12-01"), "either_date": ("2024-02-03", "2024-04-05"),
                     "month_date": ("2024-01-02", "2024-12-31")}



def test_long_text_top_values_are_resolved(spark):
    long_a = "a" * 3000
    long_b = "b" * 2500
    rows = [(long_a,)] * 5 + [(long_b,)] * 3 + [("short",)] * 4
    df = spark.createDataFrame(rows, "v string")
    p = P.profile_table(df)
    assert p.semantic["v"] == R.CATEGORICAL
    top = [(r["value"], r["count"]) for r in p.top_values().orderBy("rank").collect()]
    assert top == [(long_a, 5), ("short", 4), (long_b, 3)]


def test_top_k_with_few_salts_matches_sort(spark):
    pdf = pd.DataFrame({"k": [i % 3 for i in range(3000)], "v": [str(i % 997) for i in range(3000)]})
    df = spark.createDataFrame(pdf)
    vc = value_counts(df.select("v")).withColumn("ordinal", F.lit(0))
    got = top_k_per_key(vc, "ordinal", [F.col("cnt").desc(), F.col("value").asc()], 5, "value", salts=3)
    exp = pdf["v"].value_counts().reset_index()
    exp.columns = ["v", "c"]
    exp = exp.sort_values(["c", "v"], ascending=[False, True]).head(5)
    assert [r["value"] for r in got.orderBy("rank").collect()] == list(exp["v"])


def test_materialize_small_falls_back_to_checkpoint(spark):
    df = spark.range(50).withColumn("x", F.col("id") * 2)
    small = materialize_small(df, limit=100)
    big = materialize_small(df, limit=10)
    assert small.count() == 50 and big.count() == 50
    assert sorted(r["x"] for r in big.collect()) == list(range(0, 100, 2))


def test_concurrent_profiles_equal_sequential(spark, class_150, reg_150):
    both = P.profile_tables({"c": class_150, "r": reg_150})
    assert both["c"].semantic == P.profile_table(class_150).semantic
    assert both["r"].semantic == P.profile_table(reg_150).semantic


def test_ignored_empty_features_are_reported(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None)], "a double, b string")
    kept, ignored = PR.select_valid_features(df, ["a", "b"])
    assert kept == ["a"] and ignored == ["b"]


def test_split_rows_of_a_large_table_stay_in_their_tasks(spark, monkeypatch):
    """Three classes and 4,000 rows in 8 tasks: the split and the class labels leave rows in more tasks than classes."""
    monkeypatch.setattr(PR, "BUCKET_ROWS", 500)
    df = spark.range(4000).repartition(8).select(F.concat(F.lit("c"), F.col("id") % 3).alias("y"), F.col("id").cast("double").alias("x"))
    data = PR.prepare(df, "y", ["x"], "Classification").data
    tasks = data.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()
    assert len(tasks) >= 8 and max(r["n"] for r in tasks) < 1000
    assert {(r["_split"], r["count"]) for r in data.groupBy("_split").count().collect()} == {("test", 800), ("train", 3200)}


def test_narrowing_of_a_large_split_moves_no_rows(spark, monkeypatch):
    """What each step keeps, one row a class, goes to the rows; dealt by it, all rows would be moved three times."""
    sides = []
    monkeypatch.setattr(PR, "maybe_broadcast", lambda df: sides.append((df.columns[1], df.count())) or F.broadcast(df))
    df = spark.range(4000).select((F.col("id") % 3).cast("string").alias("y"), F.col("id").cast("double").alias("x"))
    want = {r["x"] for r in PR.train_test_split(df, "y", True).where("_split = 'test'").collect()}
    assert not sides
    monkeypatch.setattr(PR, "BUCKET_ROWS", 3999)                 # two buckets, so the counts are narrowed by them too
    got = PR.train_test_split(df, "y", True).groupBy("y", "_split").count().collect()
    assert sides == [("_b", 3), ("_h", 3), ("_task", 3), ("_cut", 3)]
    assert sum(r["count"] for r in got if r["_split"] == "test") == len(want) == 800 and sum(r["count"] for r in got) == 4000


def test_split_rows_of_a_larger_table_are_held_until_the_vectors_are_made(spark, monkeypatch):
    df = spark.range(4000).select((F.col("id") % 2).cast("string").alias("y"), (F.col("id") * 7 % 31).cast("double").alias("x"))
    want = {tuple(r) for r in PR.prepare(df, "y", ["x"], "Classification").vectors().select("_split", "_rid", "label").collect()}
    monkeypatch.setattr(PR, "BUCKET_ROWS", 5000)
    assert PR.prepare(df, "y", ["x"], "Classification").held is None
    monkeypatch.setattr(PR, "BUCKET_ROWS", 3999)
    prep = PR.prepare(df, "y", ["x"], "Classification")
    assert prep.held.storageLevel.useMemory
    assert {(r["_rid"], r["label"]) for r in prep.vectors().collect()} == {x[1:] for x in want} and len(want) == 4000
    MD.train_baselines(prep, [MD.LOGISTIC]).release()
    assert not prep.held.storageLevel.useMemory


def test_rows_of_one_task_among_empty_ones_are_dealt(spark, monkeypatch):
    """A file of one row group that is cut by its bytes: as many tasks as asked for, but all rows are in one of them."""
    monkeypatch.setattr("veritab.functions.stats.TASK_ROWS", 100)
    df = spark.range(1000).repartition(16, F.lit(1))
    dealt = spread(df, 1000, "id")
    most = dealt.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    assert most < 200 and sorted(r["id"] for r in dealt.collect()) == list(range(1000))
    even = spark.range(1000).repartition(16)
    assert spread(even, 1000, "id") is even and spread(df, 100, "id") is df


def test_dealt_rows_fill_the_cores_in_whole_rounds(spark, monkeypatch):
    """Five tasks on four cores take as long as eight, and each is longer."""
    cores = spark.sparkContext.defaultParallelism
    monkeypatch.setattr("veritab.functions.stats.TASK_ROWS", 100)
    monkeypatch.setattr("veritab.functions.stats.FEW_ROWS", 10)
    rows = 100 * cores + 50
    dealt = spread(spark.range(rows).coalesce(1), rows, "id")
    assert dealt.rdd.getNumPartitions() == 2 * cores and dealt.count() == rows
    monkeypatch.setattr("veritab.functions.stats.FEW_ROWS", 60)
    few = spread(spark.range(120).coalesce(1), 120, "id")                  # no more tasks than rows are worth
    assert few.rdd.getNumPartitions() == 2 and few.count() == 120


def test_vectors_of_one_file_are_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr("veritab.functions.stats.TASK_ROWS", 100)
    df = spark.range(1000).coalesce(1).select(F.col("id").cast("double").alias("x"), (F.col("id") * 7 % 31).cast("double").alias("z"))
    vec, _, _ = C.prepare_vectors(df, ["x", "z"])
    rows = vec.select("_rid", F.col("_row.x").alias("x")).collect()
    assert vec.rdd.getNumPartitions() == 10 and sorted(r["x"] for r in rows) == [float(i) for i in range(1000)]
    assert all(r["_rid"] == int(r["x"]) for r in rows)
