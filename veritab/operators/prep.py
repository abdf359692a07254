"""Feature preparation: projection, target cleaning, the exact 80/20 split, feature kinds, and a fitted
preprocessing ``PipelineModel`` (median imputation + population scaling, one-hot, ordinal codes)."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..session import ensure_checkpoint_dir
from ..functions.stats import dense_index, distinct_counts, exact_percentiles, maybe_broadcast, spread
from ..functions.types import as_text, dtypes, is_boolean, is_floating, is_numeric_or_bool, normalise, present, qc

BUCKET_ROWS = 100_000              # different rows of a bucket of the split, on average


class PrepError(ValueError):
    pass


# --------------------------------------------------------------------------------------------
# projection and predicates
# --------------------------------------------------------------------------------------------

def select_features(df: DataFrame, features: list[str], target: str | None = None) -> DataFrame:
    cols = list(features) + ([target] if target is not None and target not in features else [])
    return df.select(*[qc(c) for c in cols])


def drop_null_target(df: DataFrame, target: str, check: bool = True) -> DataFrame:
    """Rows whose target is present (NaN counts as missing); error when none are left."""
    t = qc(target)
    cond = t.isNotNull()
    if dtypes(df)[target].typeName() in ("double", "float"):
        cond = cond & ~F.isnan(t)
    out = df.where(cond)
    if check and not out.limit(1).collect():
        raise PrepError(f"no row has a value in the target {target!r}, so there is nothing to learn from")
    return out


def _there(df: DataFrame, name: str):
    """The column, NaN as NULL."""
    return F.when(~F.isnan(qc(name)), qc(name)) if is_floating(dtypes(df)[name]) else qc(name)


def valid_features_frame(df: DataFrame, features: list[str]) -> DataFrame:
    """(ordinal, column_name, non_null) for features with at least one non-null value (one scan)."""
    if not features:
        return df.sparkSession.createDataFrame([], "ordinal int, column_name string, non_null long")
    row = df.agg(F.array(*[F.struct(F.lit(i).alias("ordinal"), F.lit(c).alias("column_name"),
                                    F.count(_there(df, c)).alias("non_null")) for i, c in enumerate(features)]).alias("a"))
    return row.select(F.explode("a").alias("s")).select("s.*").where(F.col("non_null") > 0)


def valid_features(df: DataFrame, features: list[str]) -> list[str]:
    keep = {r["column_name"] for r in valid_features_frame(df, features).collect()}
    out = [c for c in features if c in keep]
    if not out:
        raise PrepError("none of the chosen features has a value in any row; choose others")
    return out


def select_valid_features(df: DataFrame, features: list[str]) -> tuple[list[str], list[str]]:
    """(kept, ignored): the features with data, and the entirely empty ones to report to the user."""
    kept = valid_features(df, features)
    return kept, [c for c in features if c not in kept]


def cast_to_string(df: DataFrame, cols: list[str]) -> DataFrame:
    types = dtypes(df)
    return df.select(*[as_text(c, types[c]).alias(c) if c in cols else qc(c) for c in df.columns])


def impute_missing_label(df: DataFrame, cols: list[str], fill: str = "missing") -> DataFrame:
    types = dtypes(df)
    return df.select(*[F.coalesce(as_text(c, types[c]), F.lit(fill)).alias(c) if c in cols else qc(c)
                       for c in df.columns])


def positive_class(classes: list) -> object:
    """The positive class of a binary target: the greater of the two labels."""
    return sorted(classes)[-1]


def bool_label_binarise(df: DataFrame, target: str, positive) -> DataFrame:
    return df.withColumn("label_bin", (qc(target) == F.lit(positive)).cast("int"))


# --------------------------------------------------------------------------------------------
# split
# --------------------------------------------------------------------------------------------

def allocate(counts: DataFrame, n: int, n_draws: int) -> DataFrame:
    """(_g, n, draws): split ``n_draws`` across the classes (_g, n) in proportion: floors, then the remaining draws to
    the largest remainders (ties to the smaller class value)."""
    # whole numbers throughout: a quotient of decimals is rounded, and a share just below a whole number would go up to it
    exact = f"cast(n AS decimal(19,0)) * cast({n_draws} AS decimal(19,0))"
    parts = counts.withColumn("base", F.expr(f"cast(({exact}) div cast({n} AS decimal(19,0)) AS bigint)")).withColumn(
        "rest", F.expr(f"cast(({exact}) % cast({n} AS decimal(19,0)) AS bigint)"))
    left = n_draws - int(parts.agg(F.sum("base")).first()[0] or 0)
    more = parts.orderBy(F.col("rest").desc(), F.col("_g").cast("string").asc_nulls_first()).limit(left).select(
        F.col("_g").alias("_m"), F.lit(1).alias("one"))
    return parts.join(more, F.col("_g").eqNullSafe(F.col("_m")), "left").select(
        "_g", "n", (F.col("base") + F.coalesce("one", F.lit(0))).alias("draws"))


def split_key(df: DataFrame, seed: int = R.SEED) -> DataFrame:
    """Adds ``_h`` (content hash, so the split does not depend on the file layout) and ``_rid`` (scan position, only a
    tie-break among identical rows)."""
    return df.withColumn("_h", F.xxhash64(F.lit(seed), *[qc(c) for c in df.columns])) \
             .withColumn("_rid", F.monotonically_increasing_id())


def _narrowed(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """(_g, key, need): the value of ``key`` that holds each group's wanted rank in the order of ``key``, and the rank
    among the rows with that value. Counts are pre-aggregated; a window sees the counts of one group only."""
    counts = rows.groupBy("_g", key).agg(F.count(F.lit(1)).alias("_c"))
    before = F.sum("_c").over(Window.partitionBy("_g").orderBy(key)) - F.col("_c")
    return (counts.withColumn("_before", before).join(wanted, "_g")
            .where((F.col("need") > F.col("_before")) & (F.col("need") <= F.col("_before") + F.col("_c")))
            .select("_g", key, (F.col("need") - F.col("_before")).alias("need")).checkpoint())


def train_test_split(df: DataFrame, target: str | None = None, stratify: bool = False,
                     test_fraction: float = R.TEST_FRACTION, seed: int = R.SEED) -> DataFrame:
    """Adds ``_split`` in {'train','test'}: test = ceil(fraction * n) rows, per class when stratified (train counts
    allocated first, largest remainder).

    The test rows of a group are its first ones in the order of (bucket, content hash, position); a bucket is a few bits
    of the uniform hash and holds about ``BUCKET_ROWS`` different rows. The last test row is found by narrowing: counts by
    bucket, then by hash within that bucket, then (identical rows) by the task of the position, then its rank there. No
    step ranks more than a bucket or what one task has read, so this one algorithm holds for any size, any number of
    groups and any number of identical rows. The keyed rows are checkpointed first so every pass sees the same positions.
    What narrows and the last test rows go to the rows of a larger table by broadcast: rows dealt by their group would be as
    many tasks as there are classes, and rows dealt by their bucket would all be moved in each step.
    """
    grp = F.coalesce(qc(target).cast("string"), F.lit("")) if stratify else F.lit("")
    ensure_checkpoint_dir(df.sparkSession)
    n = df.count()
    keyed = spread(split_key(df, seed).withColumn("_g", grp), n, "_rid").checkpoint()
    keyed = keyed.withColumn("_b", F.pmod(F.col("_h"), F.lit(max(1, -(-n // BUCKET_ROWS)))))
    n_test = math.ceil(test_fraction * n)
    sizes = keyed.groupBy("_g").agg(F.count(F.lit(1)).alias("n"))
    wanted = allocate(sizes, max(n, 1), n - n_test).select("_g", (F.col("n") - F.col("draws")).alias("need"))
    rows = keyed.select("_g", "_b", "_h", "_rid", F.shiftright("_rid", 33).alias("_task"))
    cut = wanted
    for key in ("_b", "_h", "_task"):
        cut = _narrowed(rows, cut, key)
        held = cut.select("_g", key)
        rows = rows.join(maybe_broadcast(held) if n > BUCKET_ROWS else held, ["_g", key])
        cut = cut.select("_g", "need")
    place = F.row_number().over(Window.partitionBy("_g").orderBy("_rid"))
    last = (rows.withColumn("_place", place).join(cut, "_g").where(F.col("_place") == F.col("need"))
            .select("_g", F.struct("_b", "_h", "_rid").alias("_cut")).checkpoint())
    is_test = F.struct("_b", "_h", "_rid") <= F.col("_cut")
    return (keyed.join(maybe_broadcast(last) if n > BUCKET_ROWS else last, "_g", "left")
            .withColumn("_split", F.when(is_test, F.lit("test")).otherwise(F.lit("train")))
            .drop("_g", "_h", "_b", "_cut"))


def should_stratify(df: DataFrame, target: str, task: str) -> bool:
    if task != "Classification":
        return False
    cc = df.groupBy(qc(target)).count().agg(F.count(F.lit(1)).alias("k"), F.min("count").alias("m")).first()
    return cc["k"] >= 2 and cc["m"] >= 2


# --------------------------------------------------------------------------------------------
# feature kinds and the fitted preprocessing
# --------------------------------------------------------------------------------------------

def feature_kinds(train: DataFrame, features: list[str]) -> DataFrame:
    """(column_name, distinct, kind): numeric dtype with > 10 distinct -> numeric; else categorical,
    one-hot with <= 15 distinct text values (NULL counted as its own value), ordinal above."""
    types = dtypes(train)
    sub = normalise(train.select(*[qc(c) for c in features]))
    vc = distinct_counts(sub)
    nulls = sub.agg(F.array(*[F.struct(F.lit(i).alias("ordinal"), (F.count(F.lit(1)) - F.count(qc(c))).alias("nulls"))
                              for i, c in enumerate(features)]).alias("a")).select(F.explode("a").alias("s")).select("s.*")
    spark = train.sparkSession
    meta = spark.createDataFrame([(i, c, bool(is_numeric_or_bool(types[c]))) for i, c in enumerate(features)],
                                 "ordinal int, column_name string, numeric_dtype boolean")
    d = F.coalesce(F.col("distinct"), F.lit(0))
    text_distinct = d + F.when(F.col("nulls") > 0, 1).otherwise(0)
    return (
        meta.join(vc, "ordinal", "left").join(nulls, "ordinal", "left")
        .select("ordinal", "column_name", d.alias("distinct"), text_distinct.alias("text_distinct"),
                F.when(F.col("numeric_dtype") & (d > R.NUMERIC_FEATURE_MIN_DISTINCT), F.lit("numeric"))
                .when(text_distinct <= R.ONE_HOT_MAX_DISTINCT, F.lit("one_hot"))
                .otherwise(F.lit("ordinal")).alias("kind"))
    )


def _dlit(v: float) -> str:
    return f"CAST('{float(v)!r}' AS DOUBLE)"


def _sql_name(c: str) -> str:
    return "`" + c.replace("`", "``") + "`"


def _text_sql(c: str, boolean: bool) -> str:
    n = _sql_name(c)
    if boolean:
        return f"COALESCE(CASE WHEN {n} THEN 'True' WHEN NOT {n} THEN 'False' END, 'missing')"
    return f"COALESCE(CAST({n} AS STRING), 'missing')"


def numeric_fit(train: DataFrame, cols: list[str]) -> dict[str, tuple[float, float, float]]:
    """Exact median per column, then mean and population std of the median-imputed column."""
    if not cols:
        return {}
    med = {r["column_name"]: r["value"] for r in exact_percentiles(train, cols, [0.5]).collect()}
    imputed = [F.coalesce(present(c), F.lit(med.get(c))) for c in cols]
    row = train.agg(*[F.struct(F.avg(e).alias("m"), F.stddev_pop(e).alias("s")).alias(f"c{i}")
                      for i, e in enumerate(imputed)]).first()
    out = {}
    for i, c in enumerate(cols):
        m, s = row[f"c{i}"]["m"], row[f"c{i}"]["s"]
        out[c] = (med.get(c) or 0.0, m or 0.0, s if s else 1.0)   # zero variance -> scale 1 (column becomes 0)
    return out


def impute_median(df: DataFrame, medians: dict[str, float]) -> DataFrame:
    return df.select(*[F.coalesce(present(c), F.lit(medians[c])).alias(c) if c in medians else qc(c)
                       for c in df.columns])


def standard_scale(df: DataFrame, stats: dict[str, tuple[float, float]]) -> DataFrame:
    """(x - mean) / population std, with the given per-column (mean, std)."""
    return df.select(*[((present(c) - F.lit(stats[c][0])) / F.lit(stats[c][1])).alias(c) if c in stats else qc(c)
                       for c in df.columns])


@dataclass
class Prepared:
    data: DataFrame                  # rows with the target present, ``_split`` and ``label``
    target: str
    task: str
    features: list[str]
    numeric: list[str]
    one_hot: list[str]
    ordinal: list[str]
    model: Preprocessing             # fitted on the train split only; adds ``features``
    feature_names: list[str]
    n_classes: int = 0
    n_train: int = 0
    n_test: int = 0
    held: DataFrame | None = None    # the split rows of a larger table, cached for the passes over them

    def release(self) -> None:
        """Drop the cached rows once the vectors are made."""
        if self.held is not None:
            self.held.unpersist()

    def vectors(self) -> DataFrame:
        return self.model.transform(self.data).select("_split", "_rid", "label", "features")


@dataclass
class Preprocessing:
    """Fitted preprocessing: texts and scaled numbers, codes of many-valued features by a join, then the rest."""
    first: SQLTransformer                 # __num_<i>, __txt_<i>
    codes: dict[int, DataFrame]           # (value, code) for __txt_<i>, in the order of the values
    rest: PipelineModel                   # one-hot columns and the assembled ``features``

    def transform(self, df: DataFrame) -> DataFrame:
        out = self.first.transform(df)
        for i, codes in self.codes.items():
            side = codes.select(F.col("value").alias(f"__value_{i}"), F.col("code").alias(f"__code_{i}"))
            out = (out.join(side, F.col(f"__txt_{i}") == F.col(f"__value_{i}"), "left")
                   .withColumn(f"__ord_{i}", F.coalesce(F.col(f"__code_{i}"), F.lit(-1.0)))
                   .drop(f"__value_{i}", f"__code_{i}"))
        return self.rest.transform(out)

    def save(self, path: str) -> None:
        self.first.write().overwrite().save(f"{path}/first")
        self.rest.write().overwrite().save(f"{path}/rest")
        for i, codes in self.codes.items():
            codes.write.mode("overwrite").parquet(f"{path}/codes/{i}")

    @classmethod
    def load(cls, spark, path: str, coded: list[int]) -> "Preprocessing":
        return cls(SQLTransformer.load(f"{path}/first"),
                   {i: spark.read.parquet(f"{path}/codes/{i}") for i in coded}, PipelineModel.load(f"{path}/rest"))


def ordinal_codes(df: DataFrame, col: str) -> DataFrame:
    """(value, code): the distinct texts of a column and their places 0.0, 1.0, ... in sorted order; never collected."""
    values = df.select(qc(col).alias("value")).where(qc(col).isNotNull()).distinct()
    return dense_index(values, "value").select("value", F.col("place").cast("double").alias("code")).checkpoint()


def ordinal_encode(df: DataFrame, col: str, codes: DataFrame, out: str) -> DataFrame:
    """Adds the code of the column's text; -1 for values without one."""
    side = codes.select(F.col("value").alias("__value"), F.col("code").alias("__code"))
    return (df.join(side, qc(col) == F.col("__value"), "left")
            .withColumn(out, F.coalesce(F.col("__code"), F.lit(-1.0))).drop("__value", "__code"))


def fit_preprocessing(train: DataFrame, features: list[str], kinds: dict[str, str]) -> tuple[Preprocessing, list[str]]:
    """Only features of few values (one-hot) have their labels indexed by MLlib; the others get joined codes."""
    types = dtypes(train)
    numeric = [c for c in features if kinds[c] == "numeric"]
    cats = [c for c in features if kinds[c] != "numeric"]
    one_hot = [i for i, c in enumerate(cats) if kinds[c] == "one_hot"]
    ordinal = [i for i, c in enumerate(cats) if kinds[c] == "ordinal"]
    fit = numeric_fit(train, numeric)
    exprs = [f"(COALESCE(NANVL(CAST({_sql_name(c)} AS DOUBLE), CAST(NULL AS DOUBLE)), {_dlit(fit[c][0])}) "
             f"- {_dlit(fit[c][1])}) / {_dlit(fit[c][2])} AS __num_{i}" for i, c in enumerate(numeric)]
    exprs += [f"{_text_sql(c, is_boolean(types[c]))} AS __txt_{i}" for i, c in enumerate(cats)]
    first = SQLTransformer(statement="SELECT *" + "".join(", " + e for e in exprs) + " FROM __THIS__")
    staged = first.transform(train)
    names = list(numeric)
    assemble = [f"__num_{i}" for i in range(len(numeric))]
    stages = []
    if one_hot:
        idx = StringIndexer(inputCols=[f"__txt_{i}" for i in one_hot], outputCols=[f"__idx_{i}" for i in one_hot],
                            handleInvalid="keep", stringOrderType="alphabetAsc").fit(staged)
        ohe = OneHotEncoder(inputCols=[f"__idx_{i}" for i in one_hot], outputCols=[f"__ohe_{i}" for i in one_hot],
                            dropLast=True).fit(idx.transform(staged))
        stages += [idx, ohe]
        assemble += [f"__ohe_{i}" for i in one_hot]
        for i, labels in zip(one_hot, idx.labelsArray):
            names += [f"{cats[i]}_{v}" for v in labels]
    assemble += [f"__ord_{i}" for i in ordinal]
    names += [cats[i] for i in ordinal]
    stages.append(VectorAssembler(inputCols=assemble, outputCol="features", handleInvalid="keep"))
    codes = {i: ordinal_codes(staged, f"__txt_{i}") for i in ordinal}
    return Preprocessing(first, codes, PipelineModel(stages=stages)), names


def class_index(df: DataFrame, target: str) -> DataFrame:
    """(__cls, label): each class of the target and its place in sorted order."""
    return dense_index(df.select(qc(target).alias("__cls")).distinct(), "__cls").select(
        "__cls", F.col("place").cast("double").alias("label"))


def prepare(df: DataFrame, target: str, features: list[str], task: str, seed: int = R.SEED,
            test_fraction: float = R.TEST_FRACTION) -> Prepared:
    """Drop missing targets, split 80/20 (stratified when possible), keep features with data in the
    train split, decide feature kinds on the train split and fit the preprocessing on it."""
    ensure_checkpoint_dir(df.sparkSession)
    data = drop_null_target(normalise(select_features(df, features, target)), target)
    strat = should_stratify(data, target, task)
    data = train_test_split(data, target, strat, test_fraction, seed)   # narrow over a checkpointed frame
    counts = {r["_split"]: int(r["count"]) for r in data.groupBy("_split").count().collect()}
    held = None
    if sum(counts.values()) > BUCKET_ROWS:
        held = data.persist()                              # a pass over a checkpoint decodes every column of every row
    train = data.where(F.col("_split") == "train")
    feats = valid_features(train, features)
    kinds = {r["column_name"]: r["kind"] for r in feature_kinds(train, feats).collect()}
    model, names = fit_preprocessing(train, feats, kinds)
    n_classes = 0
    if task == "Classification":
        classes = class_index(data, target)
        n_classes = classes.count()
        if sum(counts.values()) > BUCKET_ROWS:
            classes = maybe_broadcast(classes)             # dealt by class, the rows would be as many tasks as classes
        data = data.join(classes, qc(target) == F.col("__cls")).drop("__cls")
    else:
        data = data.withColumn("label", qc(target).cast("double"))
    return Prepared(
        data=data, target=target, task=task, features=feats,
        numeric=[c for c in feats if kinds[c] == "numeric"],
        one_hot=[c for c in feats if kinds[c] == "one_hot"],
        ordinal=[c for c in feats if kinds[c] == "ordinal"],
        model=model, feature_names=names, n_classes=n_classes,
        n_train=counts.get("train", 0), n_test=counts.get("test", 0), held=held,
    )
