"""Operator 10: toxic passages by maximum-scoring segment search.

* Token scores: log-odds of a word, or of its beginning, in toxic against clean labelled documents with an informative
  Dirichlet prior, whose mean is the share in the whole corpus (counted over all documents). Documents that hold the word
  are counted, near copies among the labelled documents once, so that neither one repetitive text nor a group of copies
  makes its words telling. Copies have the same words; near copies have a Jaccard similarity of ``SIMILAR`` or more of
  their shingles, worked out for each pair (sketches only say which pairs to look at). The log-odds are drawn towards zero
  by ``ERRORS`` of the errors that the counts are from equal shares (the root of their deviance, which holds for a handful
  of texts as well, where a word of no clean text has no standard error to speak of); the most telling of the word itself and its proper prefixes counts (words are compounds
  in several languages), and a drift is taken off, so that ordinary text scores negative. Words and prefixes are counted
  as they are, first in the labelled documents. Those whose counts there can give other log-odds than zero, whatever the
  corpus holds, are then counted in all documents; all others score zero. So the tables that are broadcast grow with the
  sample of labels, not with the corpus.
* Passages: all maximal scoring segments of a document by the linear-time scan of Ruzzo and Tompa.
* Calibration: for segments of clean text the expected number that score S or more is ``K n exp(-lambda S)`` (Karlin and
  Altschul). lambda follows from the clean word distribution, K from the counts by score of all segments of clean labelled
  documents, in which as in the curve below a text counts as often as it and its near copies occur. A document's evidence
  is the best p-value of its r best segments together (their sum statistic), where r may be as large as the document has
  segments that are evidence by themselves, and a logistic curve fitted to the labelled documents turns it into a score
  from 0 to 1.

Labels are learnt from at most ``SAMPLE`` labelled documents that are not held out, taken in the order of a seeded hash
of the id; only their ids and labels are broadcast (that many rows at most). All other counts cover all documents.

Cases: null and empty texts have no passage and get the score of no evidence; a document with several label rows counts
as toxic if one says so; without toxic or without clean examples all scores fall back to the share of toxic ones;
repeated rows each give a row; null ids are never learnt from; other columns are not read.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alnum_words, held_out, map_slices, ship_package, written

SAMPLE = 20_000
SEED = 10
#: Weight of the prior in texts, errors of shrinkage, drift, and bounds of a token score.
PRIOR_TEXTS, ERRORS, DRIFT, LOWEST, HIGHEST = 200.0, 3.0, 0.3, -2.0, 6.0
#: Smallest shingle hashes that two labelled documents are paired by (one shared is enough), and words of a shingle.
SKETCHES, SHINGLE = 5, 3
#: Similarity of near copies. It is worked out for the pairs that share so many of the smallest hashes of a signature: at
#: a similarity of 0.8, one pair in 2,000 is missed by the sketches and the signature together.
SIMILAR, SIGNATURE, AGREED = 0.8, 64, 38
#: Groups in which pairs are looked at.
PAIR_GROUPS = 256
#: Lengths in bytes of the proper prefixes that are counted besides the word, and steps of a score.
PREFIXES, STEPS = (4, 5, 6, 7, 8, 9, 10), 10
#: Words whose scores a task remembers, and words and prefixes that it sums before it hands them on (memory only).
MEMORY, SUMMED = 400_000, 400_000
#: Scores of a word, and of a segment (higher ones count as the highest), in steps.
SCORE_STEPS, TOP_STEPS = int((HIGHEST - LOWEST) * STEPS) + 1, 1_000
#: Share of the clean segments that K is taken from, and the p-value up to which a passage is reported.
TAIL_SHARE, REPORT_P = 0.5, 0.01
THRESHOLD = 0.3


class Model(NamedTuple):
    drawn: dict[bytes, float]
    lam: float
    log_k: float
    bias: float
    slope: float


class Segment(NamedTuple):
    first_word: int
    past_word: int
    score: float


def parts(word: bytes) -> list[bytes]:
    """The word, marked with a byte that no word holds, and its proper prefixes."""
    return [b"=" + word] + [word[:k] for k in PREFIXES if k < len(word)]


class Numbers(dict):
    """Numbers of each word's parts that have one, worked out when first asked for."""

    def __init__(self, of: dict[bytes, int]):
        super().__init__()
        self.numbers = of

    def __missing__(self, word: bytes) -> list[int]:
        if len(self) > MEMORY:
            self.clear()
        found = self[word] = [self.numbers[p] for p in parts(word) if p in self.numbers]
        return found


class TokenScores(dict):
    """Score of each word, worked out when first asked for."""

    def __init__(self, drawn: dict[bytes, float]):
        super().__init__()
        self.drawn = drawn

    def __missing__(self, word: bytes) -> float:
        if len(self) > MEMORY:
            self.clear()
        odds = [self.drawn.get(p, 0.0) for p in parts(word)]
        best = max(odds)
        score = min(HIGHEST, max(LOWEST, (best if best > 0 else odds[0]) - DRIFT))
        score = self[word] = round(score * STEPS) / STEPS
        return score

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.float64, len(words))


def maximal_segments(scores: np.ndarray) -> list[Segment]:
    """All maximal scoring segments (Ruzzo and Tompa). Only positive places start a candidate."""
    total = np.cumsum(scores, dtype=np.float64)
    at = np.flatnonzero(scores > 0)
    kept: list[list] = []  # [first, past, sum before, sum after, index of the nearest earlier one with a lower start sum]
    for i, after in zip(at.tolist(), total[at].tolist(), strict=True):
        new = [i, i + 1, after - float(scores[i]), after, -1]
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= new[2]:
                j = kept[j][4]
            new[4] = j
            if j < 0 or kept[j][3] >= new[3]:
                kept.append(new)
                break
            new[0], new[2] = kept[j][0], kept[j][2]
            del kept[j:]
    return [Segment(a, b, hi - lo) for a, b, lo, hi, _ in kept]


def errors_off(toxic: np.ndarray, clean: np.ndarray, all_toxic: float, all_clean: float) -> np.ndarray:
    """How many errors the counts are from equal shares of the toxic and the clean texts: the root of their deviance."""
    n = toxic + clean
    with np.errstate(divide="ignore", invalid="ignore"):
        off = [np.where(x > 0, x * np.log(x / n / (total / (all_toxic + all_clean))), 0.0)
               for x, total in ((toxic, all_toxic), (clean, all_clean))]
    return np.sqrt(np.maximum(0.0, 2 * (off[0] + off[1])))


def drawn_odds(everywhere: np.ndarray, toxic: np.ndarray, clean: np.ndarray) -> np.ndarray:
    """Log-odds of words and prefixes, drawn towards zero, from their counts in the corpus, in toxic and in clean documents;
    the first place has the numbers of documents.

    The prior's weight in each class is in proportion to the class, so a word that neither class has scores zero.
    """
    prior = PRIOR_TEXTS * everywhere / max(1.0, everywhere[0]) + 1.0
    both = max(1.0, toxic[0] + clean[0])
    a, b = toxic + prior * toxic[0] / both, clean + prior * clean[0] / both
    with np.errstate(divide="ignore", invalid="ignore"):
        odds = np.log(a / max(1.0, toxic[0])) - np.log(b / max(1.0, clean[0]))
        odds *= np.maximum(0.0, 1 - ERRORS / errors_off(toxic, clean, toxic[0], clean[0]))
    odds = np.nan_to_num(odds, nan=0.0, posinf=0.0, neginf=0.0)
    odds[0] = 0.0
    return odds.astype(np.float32)


def can_score(toxic: np.ndarray, clean: np.ndarray, all_toxic: int, all_clean: int) -> np.ndarray:
    """Where counts in labelled documents give other drawn log-odds than zero, whatever the share in the corpus."""
    if not all_toxic or not all_clean:
        return np.zeros(len(toxic), bool)
    return errors_off(toxic, clean, all_toxic, all_clean) > ERRORS


def karlin_lambda(share: np.ndarray, scores: np.ndarray) -> float:
    """The positive root of sum(share * exp(lambda * score)) = 1; a large value if no score is positive."""
    s, inverse = np.unique(scores.astype(np.float64), return_inverse=True)
    p = np.bincount(inverse, weights=share)
    lo, hi = 0.0, 50.0 / max(1.0, float(np.abs(s).max()))
    if s[-1] <= 0 or float(p @ np.exp(hi * s)) < 1:
        return hi
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if float(p @ np.exp(mid * s)) < 1 else (lo, mid)
    return max(lo, 1e-3)


def evidence(scores: np.ndarray, n_words: int, lam: float, log_k: float) -> float:
    """Minus the log of the best p-value of the r highest segments together, r = 1, 2, ... up to the last segment that is
    evidence by itself; 0 without such segments."""
    own = np.sort(lam * scores - log_k - math.log(max(n_words, 1)))[::-1]
    total = np.cumsum(own[own > 0])
    if not len(total):
        return 0.0
    r = np.arange(1, len(total) + 1)
    faculty = np.concatenate(([0.0], np.cumsum(np.log(r))))  # of 0, 1, ..., r
    return max(0.0, float((total - (r - 1) * np.log(np.maximum(total, 1.0)) + faculty[r] + faculty[r - 1]).max()))


def karlin_log_k(segments: np.ndarray, clean_words: int, lam: float) -> float:
    """log K from the number of segments of clean text by score (in steps): the upper ``TAIL_SHARE`` of them are as many as
    expected."""
    if not clean_words or not segments.sum():
        return math.log(1e-3)
    above = np.cumsum(segments[::-1])[::-1]
    floor = int(np.flatnonzero(above >= TAIL_SHARE * above[0])[-1])
    return math.log(above[floor] / clean_words) + lam * floor / STEPS


def fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Weighted logistic regression on one number, by Newton steps with a small ridge; the slope is not negative.

    A step that does not lower the loss is halved until it does: whole steps swing to and fro where the classes are far
    apart, and would end anywhere."""
    share = (weight @ y + 0.5) / (weight.sum() + 1.0)
    w = np.array([math.log(share / (1 - share)), 0.0])
    if not len(y) or not 0 < y.sum() < len(y):
        return float(w[0]), 0.0
    a = np.stack([np.ones_like(x), x], axis=1)

    def loss(w: np.ndarray) -> float:
        z = a @ w
        return float(weight @ (np.logaddexp(0.0, z) - y * z) + 0.5e-3 * w @ w)

    now = loss(w)
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -500, 500)))
        down = a.T @ (weight * (y - p)) - 1e-3 * w
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2), down)
        size = 1.0
        while (then := loss(w + size * step)) > now - 1e-4 * size * (down @ step) + 1e-12 * now and size > 1e-10:
            size /= 2
        w, now = w + size * step, then
        if np.abs(size * step).max() < 1e-8:
            break
    return (float(w[0]), float(w[1])) if w[1] > 0 else (math.log(share / (1 - share)), 0.0)


def sampled_labels(labels: DataFrame, id_col: str = "doc_id", label_col: str = "toxic", sample: int = SAMPLE) -> DataFrame:
    """(label_id, toxic) of at most ``sample`` labelled documents that are not held out."""
    known = labels.select(F.col(f"`{id_col}`").cast("bigint").alias("label_id"), F.col(f"`{label_col}`").alias("toxic"))
    known = known.where(F.col("label_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out("label_id"))
    known = known.groupBy("label_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    return known.orderBy(F.xxhash64(F.lit(SEED), "label_id"), "label_id").limit(sample)


def shingles(words: list[bytes]) -> np.ndarray:
    """Sorted hashes of the different runs of ``SHINGLE`` words (a shorter text is one)."""
    from xxhash import xxh3_64_intdigest
    n = max(1, len(words) - SHINGLE + 1)
    return np.unique(np.array([xxh3_64_intdigest(b" ".join(words[i:i + SHINGLE])) for i in range(n)], np.uint64))


def signature(h: np.ndarray) -> np.ndarray:
    """The smallest shingle hash under each of ``SIGNATURE`` hash functions; the first ``SKETCHES`` are the sketches."""
    from xxhash import xxh3_64_intdigest
    out = np.empty(SIGNATURE, np.uint64)
    for k in range(SIGNATURE):
        x = (h ^ np.uint64(xxh3_64_intdigest(bytes([k])))) * np.uint64(0x9E3779B97F4A7C15)
        out[k] = (x ^ (x >> np.uint64(32))).min()
    return out


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of different numbers."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def near_copies(texts: list[str | None], signs: np.ndarray) -> list[tuple[int, int]]:
    """(text, earlier text that it is a near copy of). The earlier one is no near copy of one still earlier."""
    known: dict[int, np.ndarray] = {}

    def own(i: int) -> np.ndarray:
        if i not in known:
            known[i] = shingles(alnum_words(texts[i]))
        return known[i]

    kept, kept_signs, found = [], np.empty_like(signs), []
    for i in range(len(texts)):
        agreed = (kept_signs[:len(kept)] == signs[i]).sum(axis=1)
        like = np.flatnonzero(agreed >= AGREED)
        for j in like[np.argsort(-agreed[like], kind="stable")].tolist():
            if similarity(own(i), own(kept[j])) >= SIMILAR:
                found.append((i, kept[j]))
                break
        else:
            kept_signs[len(kept)] = signs[i]
            kept.append(i)
            continue
        known.pop(i, None)
    return found


def linked(texts: DataFrame) -> DataFrame:
    """(toxic, digest, copy_of) of near copies in (toxic, digest, text, signature); copy_of is the smaller digest."""
    keys = texts.select("toxic", "digest", F.posexplode(F.slice("signature", 1, SKETCHES)).alias("k", "key"))
    shared = keys.groupBy("toxic", "k", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    rows = keys.join(shared, ["toxic", "k", "key"]).join(texts.select("toxic", "digest", "text", "signature"), ["toxic", "digest"])
    rows = rows.withColumn("part", F.pmod(F.xxhash64("toxic", "k", "key"), F.lit(PAIR_GROUPS)))

    def pairs(table: pa.Table) -> pa.Table:
        table = table.sort_by([("toxic", "ascending"), ("k", "ascending"), ("key", "ascending"), ("digest", "ascending")])
        names = list(zip(*(table.column(c).to_pylist() for c in ("toxic", "k", "key")), strict=True))
        cuts = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
        out = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            group = table.slice(a, b - a)
            digests = group.column("digest").to_pylist()
            signs = np.array(group.column("signature").to_pylist(), np.int64).reshape(b - a, SIGNATURE).astype(np.uint16)
            out += [(names[a][0], digests[i], digests[j]) for i, j in near_copies(group.column("text").to_pylist(), signs)]
        return pa.table({"toxic": pa.array([x[0] for x in out], pa.int32()), "digest": pa.array([x[1] for x in out], pa.string()),
                         "copy_of": pa.array([x[2] for x in out], pa.string())})

    return rows.groupBy("part").applyInArrow(pairs, "toxic int, digest string, copy_of string")


def examples(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic, weight) of the sampled labels' documents: one text of each group of near copies with the same label,
    with the number of its documents. The links of near copies, two at most for each sampled text and sketch, are
    followed on the driver to the text that stays."""
    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        from xxhash import xxh3_128_hexdigest
        own = [alnum_words(t) for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column("text"), batch.column("toxic"), pa.array([xxh3_128_hexdigest(b" ".join(x)) for x in own], pa.string()),
             pa.array([signature(shingles(x)).view(np.int64).tolist() for x in own], pa.list_(pa.int64()))],
            ["text", "toxic", "digest", "signature"])

    rows = docs.join(F.broadcast(labels), F.col("doc_id") == F.col("label_id")).select("text", "toxic")
    found = map_slices(rows, one, "text string, toxic int, digest string, signature array<bigint>")
    texts = written(found.groupBy("toxic", "digest").agg(
        F.min("text").alias("text"), F.first("signature").alias("signature"), F.count(F.lit(1)).alias("n")), "toxic-examples")
    stays: dict[tuple[int, str], str] = {}
    for r in sorted(linked(texts).distinct().collect()):  # the smallest digest first, so the one it is like is settled
        stays.setdefault((r["toxic"], r["digest"]), stays.get((r["toxic"], r["copy_of"]), r["copy_of"]))
    copies = docs.sparkSession.createDataFrame([(t, d, s) for (t, d), s in stays.items()], "toxic int, digest string, stays string")
    sizes = texts.select("toxic", "digest", "n").join(F.broadcast(copies), ["toxic", "digest"], "left").groupBy(
        "toxic", F.coalesce("stays", "digest").alias("digest")).agg(F.sum("n").alias("weight"))
    return texts.join(sizes, ["toxic", "digest"]).select("text", "toxic", "weight")


def labelled_counts(rows: DataFrame) -> DataFrame:
    """(part, toxic, clean): texts of (text, toxic) with each word or prefix, summed in the tasks first; an empty part
    counts the texts that have a word."""
    ship_package(rows.sparkSession)

    def table(clean, toxic):
        every = list(clean.keys() | toxic.keys())
        for i in range(0, len(every), 100_000):
            some = every[i:i + 100_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(some, pa.binary()), *(pa.array([n.get(p, 0) for p in some], pa.int64()) for n in (toxic, clean))],
                ["part", "toxic", "clean"])

    def run(batches):
        sums = (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(batch.column("text"), batch.column("toxic").to_pylist(), strict=True):
                words = alnum_words(text.as_py())
                if words:
                    sums[1 if toxic else 0].update({b"", *chain.from_iterable(map(parts, set(words)))})
                    if len(sums[0]) + len(sums[1]) > SUMMED:
                        yield from table(*sums)
                        sums = (Counter(), Counter())
        yield from table(*sums)

    found = rows.select("text", "toxic").mapInArrow(run, "part binary, toxic bigint, clean bigint")
    return found.groupBy("part").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def telling(sample: DataFrame) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Words and prefixes of the labelled texts whose log-odds can be other than zero, and in how many toxic and clean texts
    they are; first an empty one that all texts with a word have."""
    found = written(labelled_counts(sample), "labelled-counts")
    total = found.where(F.octet_length("part") == 0).first() or {"toxic": 0, "clean": 0}
    all_toxic, all_clean = total["toxic"], total["clean"]

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(can_score(*(batch.column(c).to_numpy() for c in ("toxic", "clean")), all_toxic, all_clean)))

    chosen = found.where(F.octet_length("part") > 0).mapInArrow(run, found.schema).orderBy("part").toArrow()
    names = [b"", *chosen.column("part").to_pylist()]
    return names, *(np.concatenate([[float(total[c])], chosen.column(c).to_numpy()]) for c in ("toxic", "clean"))


def corpus_counts(docs: DataFrame, names: list[bytes]) -> np.ndarray:
    """Texts of all documents with each of the words and prefixes; the first place counts the texts that have a word."""
    ship_package(docs.sparkSession)
    shared, size = docs.sparkSession.sparkContext.broadcast(names), len(names)

    def run(batches):
        sums, known = np.zeros(size, np.int64), Numbers({p: i for i, p in enumerate(shared.value) if i})
        for batch in batches:
            for text in batch.column("text"):
                words = alnum_words(text.as_py())
                if words:
                    every = {0}
                    every.update(*map(known.__getitem__, set(words)))
                    sums[np.fromiter(every, np.int64, len(every))] += 1
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(sums[at])], ["number", "n"])

    found = docs.select("text").mapInArrow(run, "number int, n bigint").groupBy("number").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size)
    out[found.column("number").to_numpy()] = found.column("n").to_numpy()
    return out


_SCORES: dict[str, TokenScores] = {}


def _scores(key: str, drawn: dict[bytes, float]) -> TokenScores:
    """The word scores of a job, remembered in each process across its tasks."""
    if key not in _SCORES:
        _SCORES.clear()
        _SCORES[key] = TokenScores(drawn)
    return _SCORES[key]


def _segments(text: str | None, scores: TokenScores) -> tuple[np.ndarray, list[Segment]]:
    own = scores.of(alnum_words(text))
    return own, maximal_segments(own)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Model from ``docs`` (doc_id, text) and sampled labels (label_id, toxic)."""
    sample = written(examples(docs, labels), "distinct-examples")
    names, toxic, clean = telling(sample)  # as the rest on the driver, bounded by the sampled texts
    odds = drawn_odds(corpus_counts(docs, names), toxic, clean)
    drawn = {p: x for p, x in zip(names, odds.tolist(), strict=True) if x}
    shared, key = docs.sparkSession.sparkContext.broadcast(drawn), uuid.uuid4().hex

    def clean_text(batch: pa.RecordBatch) -> pa.RecordBatch:
        scores, words, segments = _scores(key, shared.value), np.zeros(SCORE_STEPS, np.int64), np.zeros(TOP_STEPS, np.int64)
        for text, weight in zip(batch.column("text").to_pylist(), batch.column("weight").to_pylist(), strict=True):
            own, found = _segments(text, scores)
            words += weight * np.bincount(np.rint((own - LOWEST) * STEPS).astype(np.int64), minlength=SCORE_STEPS)
            steps = np.rint(np.array([x.score for x in found]) * STEPS).astype(np.int64)
            segments += weight * np.bincount(np.minimum(steps, TOP_STEPS - 1), minlength=TOP_STEPS)
        return pa.RecordBatch.from_arrays([pa.array([x.tolist()], pa.list_(pa.int64())) for x in (words, segments)],
                                          ["words", "segments"])

    counted = map_slices(sample.where("toxic = 0").select("text", "weight"), clean_text, "words array<bigint>, segments array<bigint>")
    words, segments = (_summed(counted.selectExpr(f"posexplode({c}) AS (k, n)"), size)
                       for c, size in (("words", SCORE_STEPS), ("segments", TOP_STEPS)))
    lam = karlin_lambda(words / max(1, words.sum()), np.arange(SCORE_STEPS) / STEPS + LOWEST)
    log_k = karlin_log_k(segments, int(words.sum()), lam)

    def weighed(batch: pa.RecordBatch) -> pa.RecordBatch:
        scores, x = _scores(key, shared.value), []
        for text in batch.column("text").to_pylist():
            own, found = _segments(text, scores)
            x.append(evidence(np.array([s.score for s in found]), len(own), lam, log_k))
        return pa.RecordBatch.from_arrays([batch.column("toxic"), batch.column("weight"), pa.array(x, pa.float64())],
                                          ["toxic", "weight", "x"])

    seen = map_slices(sample.select("text", "toxic", "weight"), weighed, "toxic int, weight bigint, x double").toArrow()
    toxic, weight, x = (seen.column(c).to_numpy().astype(float) for c in ("toxic", "weight", "x"))
    order = np.lexsort((x, weight, toxic))  # sums do not depend on the order in which tasks end
    bias, slope = fit_curve(np.log1p(x[order]), toxic[order], weight[order])
    return Model(drawn, lam, log_k, bias, slope)


def _summed(rows: DataFrame, size: int) -> np.ndarray:
    """Sums of n by k = 0, 1, ..., size - 1."""
    found = rows.groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size, np.int64)
    out[found.column("k").to_numpy()] = found.column("n").to_numpy()
    return out


PASSAGES = "array<struct<first_word:bigint,past_word:bigint,score:double,p_value:double>>"


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted and the significant passages of every row."""
    base = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    model = fit(base, written(sampled_labels(labels), "sampled-labels"))
    shared, key = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex
    kind = pa.list_(pa.struct([("first_word", pa.int64()), ("past_word", pa.int64()), ("score", pa.float64()),
                               ("p_value", pa.float64())]))

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = Model(*shared.value)
        scores = _scores(key, m.drawn)
        out, passages = [], []
        for text in batch.column("text").to_pylist():
            own_scores, found = _segments(text, scores)
            n = len(own_scores)
            z = m.bias + m.slope * math.log1p(evidence(np.array([x.score for x in found]), n, m.lam, m.log_k))
            out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
            own = []
            for s in found:
                p = -math.expm1(-math.exp(min(30.0, m.log_k + math.log(n) - m.lam * s.score)))
                if p <= REPORT_P:
                    own.append({"first_word": s.first_word, "past_word": s.past_word, "score": float(s.score), "p_value": p})
            passages.append(own)
        score = np.array(out, np.float64)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("held_out"), pa.array(score),
             pa.array((score >= THRESHOLD).astype(np.int32)), pa.array(passages, kind)],
            ["doc_id", "held_out", "score", "predicted", "passages"])

    rows = base.withColumn("held_out", held_out())
    return map_slices(rows, one, f"doc_id bigint, held_out boolean, score double, predicted int, passages {PASSAGES}")
