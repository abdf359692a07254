"""Operator 5: quality of documents by hierarchical empirical Bayes over sites and paths.

1. Evidence of the text: a logistic regression on a few shares of characters, words and lines, computed with SQL
   functions, and fitted to at most ``SAMPLE`` labelled documents that are not held out.
2. Sites: the source without a scheme, query and fragment is cut at its slashes. The first segment is the site (the host
   of an address, in lower case), all but the last one are the path. Numbers of documents and sums of text probabilities
   are aggregated by path (pre-aggregated before the shuffle, so a hot site is one small row from each
   task) and rolled up to sites and to the whole corpus.
3. Shrinkage: site rates are drawn to the corpus rate and path rates to their site's rate. The strength (pseudo-documents)
   of each level is estimated by moments: the spread of the groups' rates beyond what sampling explains. Sparse sites thus
   fall back to the prior, large ones speak for themselves.
4. A document's posterior log-odds are its text's log-likelihood ratio plus the log-odds of its path's rate without the
   document itself.

Cases: null and empty texts have all shares zero; null sources are one site of their own; without labels of both kinds the
text says nothing and all scores are the prior of 0.5; one site only, or one document a site, gives the global rate;
repeated rows each give a row; null ids stay null and are not learnt from; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held_out, written

SAMPLE = 20_000
SEED = 5
KEEP_AT = 0.5
#: Bounds of a prior's strength in documents.
WEAKEST, STRONGEST = 1.0, 10_000.0
FEATURES = ["f_length", "f_symbols", "f_upper", "f_stops", "f_digits", "f_lines", "f_words", "f_size"]


def site_and_path(source: Column) -> tuple[Column, Column]:
    """The host, or first segment, of a source, and its whole directory with the host; null for null."""
    scheme = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//"
    plain = F.regexp_replace(F.regexp_replace(source, scheme, ""), r"(?s)[?#].*$", "")
    host = F.substring_index(plain, "/", 1)
    site = F.when(source.rlike(scheme), F.lower(host)).otherwise(host)
    folders = F.regexp_replace(F.substring(plain, F.length(host) + 1, F.length(plain)), r"(?s)/[^/]*\z", "")
    return site, F.concat(site, folders)


def features(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """doc_id, site, path and the shares that describe the text of every row."""
    text = F.col("text")

    def share(chars: str, of: Column) -> Column:
        return F.length(F.regexp_replace(text, f"[^{chars}]+", "")) / F.greatest(of, F.lit(1))

    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"),
                       F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"),
                       F.col(f"`{source_col}`").alias("source"))
    site, path = site_and_path(F.col("source"))
    rows = rows.select(
        "doc_id", "text", site.alias("site"), path.alias("path"),
        F.array_remove(F.split(text, r"\s+"), "").alias("words"), F.array_remove(F.split(text, "\n"), "").alias("lines"))
    n, chars = F.size("words"), F.length("text")
    rows = rows.select(
        "doc_id", F.coalesce("site", F.lit("")).alias("site"),
        F.when(F.col("path").isNull(), F.lit("\u0000")).otherwise(F.col("path")).alias("path"),
        F.log1p(n.cast("double")).alias("f_length"), share("#*$%&|<>", n).alias("f_symbols"), share("A-Z", chars).alias("f_upper"),
        share(".!?", n).alias("f_stops"), share("0-9", chars).alias("f_digits"),
        ((F.size("lines") - F.size(F.array_distinct("lines"))) / F.greatest(F.size("lines"), F.lit(1))).alias("f_lines"),
        (F.size(F.array_distinct("words")) / F.greatest(n, F.lit(1))).alias("f_words"),
        (chars / F.greatest(n, F.lit(1))).alias("f_size"))
    return rows.withColumns({f: F.least(F.col(f), F.lit(20.0)) for f in FEATURES})


def text_log_odds(rows: DataFrame, labels: DataFrame, label_col: str) -> tuple[Column, float]:
    """Log-odds of good quality as a Column over the features, and the log-odds of the labelled sample."""
    known = labels.select(F.col("doc_id").cast("bigint").alias("label_id"), F.col(f"`{label_col}`").alias("label"))
    known = known.where(F.col("label_id").isNotNull() & F.col("label").isNotNull() & ~held_out("label_id"))
    known = known.groupBy("label_id").agg(F.min((F.col("label") > 0).cast("double")).alias("label"))
    known = known.orderBy(F.xxhash64(F.lit(SEED), "label_id"), "label_id").limit(SAMPLE)
    sample = written(rows.join(F.broadcast(known), F.col("doc_id") == F.col("label_id")).select("label", *FEATURES), "labelled")
    both = sample.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("good")).first()
    if not both["n"] or not 0 < both["good"] < both["n"]:
        return F.lit(0.0), 0.0
    model = LogisticRegression(featuresCol="x", labelCol="label", regParam=1e-4, maxIter=60).fit(
        VectorAssembler(inputCols=FEATURES, outputCol="x").transform(sample))
    odds = F.lit(float(model.intercept))
    for f, w in zip(FEATURES, model.coefficients, strict=True):
        odds = odds + F.col(f) * F.lit(float(w))
    return odds, math.log(both["good"] / (both["n"] - both["good"]))


def strength(groups: DataFrame, n: str, good: str, towards: Column) -> float:
    """Pseudo-documents of a prior by moments: m (1 - m) / variance between groups - 1, within bounds."""
    m = F.col(good) / F.col(n)
    row = groups.where(F.col(n) > 1).select(
        F.col(n).alias("n"), towards.alias("t"), ((m - towards) ** 2).alias("d")).agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("d")).alias("d"),
        F.sum(F.col("t") * (1 - F.col("t"))).alias("noise"), F.sum(F.col("n") * F.col("t") * (1 - F.col("t"))).alias("s")).first()
    if not row["n"] or not row["s"]:
        return STRONGEST
    between = (row["d"] - row["noise"]) / row["n"]
    spread = row["s"] / row["n"]
    return STRONGEST if between <= 0 else min(STRONGEST, max(WEAKEST, spread / between - 1))


def _odds(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p) - F.log(1 - p)


def site_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 source_col: str = "source", label_col: str = "quality", keep_at: float = KEEP_AT) -> DataFrame:
    """doc_id, held_out, text_score, site_rate, path_rate, score and kept of every row."""
    rows = written(features(docs, id_col, text_col, source_col), "site-features")
    odds, sample_odds = text_log_odds(rows, labels, label_col)
    p = 1 / (1 + F.exp(-F.least(F.greatest(odds, F.lit(-30.0)), F.lit(30.0))))
    rows = rows.select("doc_id", "site", "path", p.alias("p"))
    paths = written(rows.groupBy("site", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("good")), "path-sums")
    sites = written(paths.groupBy("site").agg(F.sum("n").alias("site_n"), F.sum("good").alias("site_good")), "site-sums")
    total = sites.agg(F.sum("site_n").alias("n"), F.sum("site_good").alias("good")).first()
    rate = total["good"] / total["n"] if total["n"] else 0.5
    k_site = strength(sites, "site_n", "site_good", F.lit(rate))
    sites = sites.withColumn("site_rate", (F.col("site_good") + k_site * rate) / (F.col("site_n") + k_site))
    paths = written(paths.join(sites, "site"), "path-rates")
    k_path = strength(paths, "n", "good", F.col("site_rate"))
    joined = rows.join(paths.select("site", "path", "n", "good", "site_rate"), ["site", "path"])
    others = (F.col("good") - F.col("p") + k_path * F.col("site_rate")) / (F.col("n") - 1 + k_path)
    ratio = _odds(F.col("p")) - F.lit(sample_odds)
    score = 1 / (1 + F.exp(-(ratio + _odds(others))))
    return joined.select(
        "doc_id", held_out().alias("held_out"), F.col("p").alias("text_score"), "site_rate",
        ((F.col("good") + k_path * F.col("site_rate")) / (F.col("n") + k_path)).alias("path_rate"), score.alias("score"),
        (score >= keep_at).alias("kept"))
