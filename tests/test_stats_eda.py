import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from veritab.functions.stats import exact_percentiles, running_totals
from veritab.operators import eda as E


def test_exact_percentiles_against_numpy(spark):
    rng = np.random.default_rng(3)
    g = rng.choice(["a", "b", "c"], 3000, p=[0.6, 0.3, 0.1])
    x = np.round(rng.exponential(5, 3000), 2)
    x[:900] = 1.5                                     # one hot value, a third of the rows
    pdf = pd.DataFrame({"g": g, "x": x})
    df = spark.createDataFrame(pdf)
    out = {(r["g"], r["prob"]): r["value"] for r in exact_percentiles(df, ["x"], [0.1, 0.25, 0.5, 0.75, 0.99], by=["g"]).collect()}
    for (grp, p), v in out.items():
        assert abs(v - np.quantile(pdf.loc[pdf.g == grp, "x"], p)) < 1e-9


def test_exact_percentiles_of_awkward_columns(spark):
    rng = np.random.default_rng(4)
    n = 20_000
    pdf = pd.DataFrame({
        "constant": np.full(n, 7.25), "two": np.where(np.arange(n) % 3 == 0, -1e300, 1e-300), "dense": np.arange(n) ** 1.5,
        "octaves": 2.0 ** rng.uniform(-1070, 1020, n) * rng.choice([-1, 1], n), "near": 1e15 + np.arange(n) % 97 * 0.125,
        "ulps": np.nextafter(1.0, 2.0) + rng.integers(0, 5000, n) * 2.0 ** -52, "zeros": rng.choice([0.0, -0.0, 5e-324, -5e-324], n),
        "ends": rng.choice([-np.inf, 1.7e308, np.inf, 3.0], n), "gaps": np.where(rng.random(n) < 0.3, np.nan, rng.normal(0, 1, n))})
    probs = [0.0, 0.01, 0.25, 0.5, 0.999, 1.0]
    got = {(r["column_name"], r["prob"]): (r["value"], r["n"]) for r in exact_percentiles(
        spark.createDataFrame(pdf).repartition(3), list(pdf.columns), probs).collect()}
    assert len(got) == len(probs) * len(pdf.columns)
    for (c, p), (value, count) in got.items():
        x = np.sort(pdf[c].dropna().to_numpy())
        h = p * (len(x) - 1)
        a, b = x[int(h)], x[min(int(h) + 1, len(x) - 1)]
        assert count == len(x) and value == (a if a == b else a + (b - a) * (h - int(h))), (c, p)


def test_exact_percentiles_of_many_values_against_duckdb(spark, tmp_path):
    import duckdb
    path = str(tmp_path / "many.parquet")
    spark.range(1_000_000).select(F.pmod(F.xxhash64("id"), F.lit(10**12)).cast("double").alias("x"),
                                  (F.col("id") % 3).alias("g")).write.parquet(path)
    sql = f"SELECT g, median(x), quantile_cont(x, 0.25) FROM '{path}/*.parquet' GROUP BY g"
    expected = {g: (m, q) for g, m, q in duckdb.sql(sql).fetchall()}
    got = exact_percentiles(spark.read.parquet(path), ["x"], [0.5, 0.25], by=["g"]).collect()
    assert {(r["g"], r["prob"]): r["value"] for r in got} == {
        (g, p): v for g, pair in expected.items() for p, v in zip((0.5, 0.25), pair, strict=True)}


def test_percentiles_end_within_five_passes_and_order_no_values(spark, monkeypatch):
    from veritab.functions import stats
    passes = []
    real = stats._holders
    monkeypatch.setattr(stats, "_holders", lambda counts, *a: passes.append(counts) or real(counts, *a))
    rng = np.random.default_rng(6)
    x = 1.0 + rng.integers(0, 2**52, 4000) * 2.0 ** -52
    exact_percentiles(spark.createDataFrame(pd.DataFrame({"x": x})), ["x"], [0.5, 0.9]).collect()
    assert 2 <= len(passes) <= 5
    assert all("Window" not in c._jdf.queryExecution().optimizedPlan().toString() for c in passes)


def test_running_totals_match_cumsum(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"s": np.arange(5000, dtype=float), "v": rng.integers(0, 5, 5000), "g": rng.choice(["a", "b", None], 5000)})
    df = spark.createDataFrame(pdf)
    expected = pdf.sort_values("s", ascending=False)
    for range_rows in (10_000, 300):                   # one range, and as many as the rows need
        out = running_totals(df, "s", ["v"], descending=True, range_rows=range_rows).toPandas().sort_values("s", ascending=False)
        assert (out["cum_v"].to_numpy() == expected["v"].cumsum().to_numpy()).all()
        by = running_totals(df, "s", ["v"], partition_by=["g"], range_rows=range_rows).toPandas().sort_values("s")
        cum = pdf.groupby("g", dropna=False)["v"].cumsum()
        assert (by["cum_v"].to_numpy() == cum.to_numpy()).all()


def test_histogram_matches_numpy(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(0, 1, 2000)
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    h = E.histogram(df, "x").orderBy("bin").toPandas()
    counts, edges = np.histogram(x, bins=40)
    assert (h["count"].to_numpy() == counts).all()
    assert np.allclose(h["bin_center"].to_numpy(), 0.5 * (edges[:-1] + edges[1:]))


def test_histogram_constant_column(spark):
    df = spark.createDataFrame([(2.0,)] * 7, "x double")
    h = E.histogram(df, "x").toPandas()
    counts, _ = np.histogram(np.full(7, 2.0), bins=40)
    assert (h.sort_values("bin")["count"].to_numpy() == counts).all()


def test_correlation_guard(spark):
    df = spark.createDataFrame([(1.0, 5.0, 2.0), (2.0, 5.0, 4.1), (3.0, 5.0, None)], "a double, c double, b double")
    m = {(r["col_i"], r["col_j"]): r["r"] for r in E.correlation_matrix(df, ["a", "c", "b"]).collect()}
    assert m[("a", "c")] is None and m[("c", "c")] is None
    assert abs(m[("a", "b")] - 1.0) < 1e-12          # pairwise complete: 2 rows
    assert m[("a", "a")] == 1.0


def test_box_stats(spark):
    rng = np.random.default_rng(11)
    x = np.append(rng.normal(0, 1, 200), [15.0])
    df = spark.createDataFrame(pd.DataFrame({"g": ["k"] * 201, "x": x}))
    r = E.box_stats(df, "x", "g").first()
    q1, q3 = np.quantile(x, [0.25, 0.75])
    assert abs(r["q1"] - q1) < 1e-12 and abs(r["q3"] - q3) < 1e-12
    assert r["n_outliers"] >= 1 and r["whisker_high"] < 15.0


def test_ols_constant_feature(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    r = E.ols_trendline(df, "x", "y").first()
    assert r["slope"] is None


def test_histogram_by_group_zero_fill(spark):
    df = spark.createDataFrame([(float(i), "a" if i < 50 else "b") for i in range(60)], "x double, g string")
    h = E.histogram_by_group(df, "x", "g")
    assert h.count() == 80
    assert h.where(F.col("grp") == "b").agg(F.sum("count")).first()[0] == 10


def test_correlations_of_many_columns_in_one_scan(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(12)
    n, c = 5000, 100
    base = rng.normal(0, 1, (n, 5))
    x = base @ rng.normal(0, 1, (5, c)) + rng.normal(0, 1, (n, c))
    x[:, 1] += 1e9                                     # a large mean
    x[:, 2] = np.arange(n) * 1e6 + x[:, 2]             # a trend, so that blocks differ
    x[rng.random((n, c)) < 0.2] = np.nan
    x[:, 3], x[:, 4] = 5.0, np.nan                     # constant, empty
    pdf = pd.DataFrame(x, columns=[f"c{i}" for i in range(c)])
    path = str(tmp_path / "wide")
    spark.createDataFrame(pdf).repartition(5).write.parquet(path)
    df = spark.read.parquet(path)
    scans = []
    from veritab.functions import blocks
    real = blocks.ship_sources
    monkeypatch.setattr(blocks, "ship_sources", lambda s: scans.append(1) or real(s))
    got = {(r["i"], r["j"]): r["r"] for r in E.correlation_pairs(df, list(pdf.columns), include_diagonal=True).collect()}
    assert len(scans) == 1 and len(got) == c * (c + 1) // 2
    expected = pdf.corr().to_numpy()
    for (i, j), r in got.items():
        if {i, j} & {3, 4}:
            assert r is None
        elif i == j:
            assert r == 1.0
        else:
            assert abs(r - expected[i, j]) < 1e-6, (i, j)


def test_block_statistics_merge_to_the_whole():
    from veritab.functions import blocks
    rng = np.random.default_rng(13)
    x = rng.normal(1e8, 1, (1000, 6))
    x[rng.random(x.shape) < 0.5] = np.nan
    x[:400, 5] = np.nan                                # a block without any value of a column
    whole = blocks.block_statistics(x)
    total = None
    for at in range(0, 1000, 100):
        total = blocks.merged(total, blocks.block_statistics(x[at:at + 100]))
    assert all(np.allclose(total[k], whole[k], rtol=1e-9, atol=1e-6) for k in blocks.NAMES)


def test_block_and_aggregate_correlations_agree(spark, monkeypatch):
    rng = np.random.default_rng(14)
    pdf = pd.DataFrame(rng.normal(0, 1, (300, 4)), columns=list("abcd"))
    pdf.loc[::3, "b"] = np.nan
    pdf["d"] = 2.0
    df = spark.createDataFrame(pdf).select(*[F.nanvl(F.col(c), F.lit(None)).alias(c) for c in "abcd"])
    rows = lambda: {(r["i"], r["j"]): r["r"] for r in E.correlation_pairs(df, list("abcd"), True).collect()}
    one = rows()
    monkeypatch.setattr(E, "PAIR_CHUNK", 0)
    many = rows()
    assert one.keys() == many.keys()
    assert all((a is None and many[k] is None) or abs(a - many[k]) < 1e-12 for k, a in one.items())
    assert all(v is None for v in many.values()) is False and E.correlation_pairs(df.where("false"), list("abcd")).count() == 6


def test_distinct_counts_of_text_files_in_one_scan_and_by_sketch(spark, tmp_path):
    from veritab.functions import stats
    rng = np.random.default_rng(15)
    n = 30_000
    pdf = pd.DataFrame({"id": np.arange(n), "x": rng.integers(0, 9000, n) / 4, "t": rng.choice(["a", "b", None], n),
                        "d": rng.integers(0, 20_000, n).astype(str), "e": [None] * n, "z": rng.choice([0.0, -0.0], n)})
    schema = "id long, x double, t string, d string, e string, z double"
    spark.createDataFrame(pdf, schema).write.parquet(str(tmp_path / "p"))
    columnar = spark.read.parquet(str(tmp_path / "p"))
    columnar.write.csv(str(tmp_path / "c"))
    text = spark.read.schema(schema).csv(str(tmp_path / "c"))
    joined = columnar.join(spark.range(n).withColumnRenamed("id", "k"), F.col("id") == F.col("k")).drop("k")
    assert stats._reads_columns(columnar) and stats._reads_columns(columnar.where("x > 1").select("id", "x"))
    assert not stats._reads_columns(text) and not stats._reads_columns(joined)
    as_dict = lambda df: {r["ordinal"]: r["distinct"] for r in df.collect()}
    expected = {0: n, 1: pdf["x"].nunique(), 2: 2, 3: pdf["d"].nunique(), 5: 1}
    for df in (columnar, text, joined):
        assert as_dict(stats.distinct_counts(df)) == expected
    plan = stats.distinct_counts(text)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan csv") == 1
    near = as_dict(stats.distinct_counts(text, approximate=True))
    assert near.keys() == expected.keys() and all(abs(near[k] - v) <= 0.02 * v for k, v in expected.items())
    halves = [stats.distinct_sketches(text.where(f"id % 2 = {h}")) for h in (0, 1)]
    united = as_dict(stats.sketch_estimates(halves[0].unionByName(halves[1])))
    assert all(abs(united[k] - v) <= 0.02 * v for k, v in expected.items())
    assert as_dict(stats.distinct_counts(text.where("false"))) == {}
