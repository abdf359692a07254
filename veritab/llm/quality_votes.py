"""Operator 2: quality rules as weak supervision, with DataFrame and SQL functions only.

Each rule looks at signals of a text and votes good (1), bad (-1) or abstains (0). Among the texts that pass the base
rules, expectation-maximisation over the table of vote patterns (its size is bounded by the number of rules, not by the
data) estimates how often each rule is right on good and on bad texts, and the share of good texts. An abstention says
nothing. The posterior probability of being good then replaces the all-must-pass filter. A weak prior
(``PRIOR_WEIGHT`` pseudo-votes a rule and class) says that rules are more often right than wrong; it keeps the two
classes from changing places and gives a result on tiny or empty tables.

All signals are computed per row with array functions, so no group of rows ever meets in one task; the signals are
written to the shared folder once (no texts), and the pattern counts are pre-aggregated before their shuffle.

Cases: a null or empty text has no words and fails the base rules; an empty table gives an empty result; repeated rows
each give a row; a null id stays null; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: Posterior from which a text is kept.
KEEP_AT = 0.5
ITERATIONS = 12
PRIOR_WEIGHT = 20.0
#: Prior share of right votes, and of good texts.
PRIOR_RIGHT = 0.85
PRIOR_GOOD = 0.8
#: Belief to start from: texts that pass all rules, and others.
START = (0.95, 0.1)

WORD_SPLIT = r"[\x20\x09-\x0D]+"
A_WORD = r"[^\x20\x09-\x0D]"
RULES = ["v_length", "v_word_length", "v_symbols", "v_symbol_share", "v_lines", "v_repeats", "v_case", "v_variety"]
SIGNALS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_distinct", "n_upper"]


def _count(text: Column, chars: str) -> Column:
    """Number of characters of the text in the class ``chars``."""
    return F.length(F.regexp_replace(text, f"[^{chars}]+", "")).cast("bigint")


def signals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: str | None = None) -> DataFrame:
    """doc_id, the column ``carry`` if any, and the signals of every row. Windows are compared by 64-bit hash within one text."""
    text = F.col("text")
    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"),
                       F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"), *(c for c in [carry] if c))
    ids = ["doc_id", *(c for c in [carry] if c)]
    # whole texts are read in this projection only; later ones carry numbers
    rows = rows.select(
        *ids,
        (F.length(text) - _count(text, r"\x20\x09-\x0D")).cast("bigint").alias("word_chars"),
        _count(text, "#*$%&|<>").alias("n_symbols"),
        _count(text, "A-Z").alias("n_upper"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(A_WORD)).alias("lines"),
        F.transform(F.array_remove(F.split(text, WORD_SPLIT), ""), lambda w: F.xxhash64(w)).alias("hashes"))
    rows = rows.select(
        *ids, "hashes", "word_chars", "n_symbols", "n_upper",
        F.size("hashes").cast("bigint").alias("n_words"),
        F.size(F.array_distinct("hashes")).cast("bigint").alias("n_distinct"),
        F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"))
    rest = [c for c in rows.columns if c != "hashes"]
    # hashes of 1, 2, 4 and 8 words: each step joins neighbours of the step before
    rows = rows.select(*rest, F.when(F.col("n_words") >= WINDOW, F.col("hashes")).alias("win"))
    for step in (1, 2, 4):
        left = F.size("win") - step
        rows = rows.select(*rest, F.zip_with(F.slice("win", F.lit(1), left), F.slice("win", F.lit(1 + step), left),
                                             lambda a, b: F.xxhash64(a, b)).alias("win"))
    # only texts in which some window repeats sort their windows
    rows = rows.select(*rest, F.when(
        F.size(F.array_distinct("win")) < F.size("win"),
        F.sort_array(F.transform("win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("order"))
    again = F.filter("order", lambda x, k: (x["h"] == F.get("order", k - 1)["h"]) | (x["h"] == F.get("order", k + 1)["h"]))
    starts = F.sort_array(F.transform(again, lambda x: x["i"]))
    covered = F.aggregate(
        starts, F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("total")),
        lambda a, x: F.struct(x.alias("last"), (a["total"] + F.least(F.lit(WINDOW), x - a["last"])).alias("total")),
        lambda a: a["total"])
    return rows.select(*rest, F.coalesce(covered, F.lit(0)).cast("bigint").alias("n_repeat_words")).select(
        *ids, *SIGNALS)


def votes() -> dict[str, Column]:
    """The rules: 1 good, -1 bad, 0 abstains. All abstain from texts without words."""
    n, c = F.col("n_words"), F.col

    def rule(good: Column, bad: Column) -> Column:
        return F.when(n == 0, 0).when(bad, -1).when(good, 1).otherwise(0)

    return {
        "v_length": rule(n >= 50, n < 10),
        "v_word_length": rule(c("word_chars").between(3 * n, 9 * n), (c("word_chars") < 2 * n) | (c("word_chars") > 16 * n)),
        "v_symbols": rule(50 * c("n_symbols") <= n, 5 * c("n_symbols") > n),
        "v_symbol_share": rule(500 * c("n_symbols") <= c("word_chars"), 40 * c("n_symbols") > c("word_chars")),
        "v_lines": rule((c("n_lines") >= 3) & (c("n_dup_lines") == 0), 10 * c("n_dup_lines") > 3 * c("n_lines")),
        "v_repeats": rule(c("n_repeat_words") == 0, 5 * c("n_repeat_words") > n),
        "v_case": rule(20 * c("n_upper") <= c("word_chars"), 10 * c("n_upper") > 4 * c("word_chars")),
        "v_variety": rule(3 * c("n_distinct") >= n, (n >= 20) & (8 * c("n_distinct") < n)),
    }


def posterior(model: dict) -> Column:
    """Probability that the text is good, a Column over the votes."""
    odds = F.lit(math.log(model["good"]) - math.log1p(-model["good"]))
    for r in RULES:
        good, bad = model[r]
        odds = odds + (F.when(F.col(r) == 1, math.log(good / (1 - bad))).when(F.col(r) == -1, math.log((1 - good) / bad))
                       .otherwise(0.0))
    return 1.0 / (1.0 + F.exp(-odds))


def fit(patterns: DataFrame, iterations: int = ITERATIONS) -> dict:
    """Expectation-maximisation over (votes, cnt). Each round is one aggregate with one row as its result.

    It starts from the all-must-pass filter. The model holds the share of good texts, and for each rule its share of right votes on good and on bad texts.
    """
    passes = F.lit(True)
    for r in RULES:
        passes = passes & (F.col(r) >= 0)
    belief = F.when(passes, START[0]).otherwise(START[1])
    for _ in range(iterations):
        p = patterns.select("*", belief.alias("p"))
        good, bad = F.col("p") * F.col("cnt"), (1 - F.col("p")) * F.col("cnt")
        row = p.agg(
            F.sum(good).alias("good"), F.sum(bad).alias("bad"),
            *(F.sum(F.when(F.col(r) == v, w).otherwise(0.0)).alias(f"{r}_{kind}{v}")
              for r in RULES for kind, w in (("good", good), ("bad", bad)) for v in (1, -1))).first()
        n = {k: row[k] or 0.0 for k in row.asDict()}
        model = {"good": (n["good"] + PRIOR_WEIGHT * PRIOR_GOOD) / (n["good"] + n["bad"] + PRIOR_WEIGHT)}
        for r in RULES:
            model[r] = tuple(
                (n[f"{r}_{kind}{right}"] + PRIOR_WEIGHT * PRIOR_RIGHT) / (n[f"{r}_{kind}1"] + n[f"{r}_{kind}-1"] + PRIOR_WEIGHT)
                for kind, right in (("good", 1), ("bad", -1)))
        belief = posterior(model)
    return model


def failed() -> Column:
    """The base rules: too few words, or too many of them in repeated windows."""
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def pattern_model(voted: DataFrame) -> dict:
    """Model fitted to the votes of all rows that pass the base rules."""
    patterns = voted.where(~failed()).groupBy(*RULES).agg(F.count(F.lit(1)).alias("cnt"))
    return fit(written(patterns.coalesce(1), "patterns"))


def judge(voted: DataFrame, model: dict, keep_at: float) -> DataFrame:
    return voted.withColumns({"base_failed": failed(), "quality": posterior(model)}).withColumn(
        "kept", ~F.col("base_failed") & (F.col("quality") >= keep_at))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_at: float = KEEP_AT) -> DataFrame:
    """doc_id, signals, votes, base_failed, quality (posterior) and kept of every row."""
    voted = written(signals(docs, id_col, text_col).withColumns(votes()), "votes")
    return judge(voted, pattern_model(voted), keep_at)


def kept_documents(docs: DataFrame, text_col: str = "text", keep_at: float = KEEP_AT) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns.

    Rows with their votes are written to the shared folder once, so that texts are read once and need no join.
    """
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    rows = rows.select("row", F.col("row").getField(text_col).alias("text"), F.lit(None).cast("bigint").alias("doc_id"))
    voted = written(signals(rows, carry="row").withColumns(votes()), "voted-rows")
    return judge(voted, pattern_model(voted), keep_at).where("kept").select("row.*")
