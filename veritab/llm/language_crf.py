"""Operator 4: language of code-switched text by a linear-chain conditional random field.

Words are runs of letters, lower-cased. A word's features are its prefixes and suffixes of one to three letters, its
two- and three-letter n-grams (hashed into ``CELLS`` weights) and which languages' lexicons hold it. Weights and
transitions between the languages of neighbouring words are learnt together by maximising the conditional likelihood
(AdaGrad on forward-backward gradients). Forward-backward then gives each word's posterior; a text's language is the one
with the largest mean posterior, which is the score.

A text's language is recognised (stage ``language_id``) word by word, so that texts of several languages count too: a word
counts with its largest posterior if there is evidence of that language, which is that the training texts of the language
have the word, or its beginning and all of its runs of three letters and the shorter ones at its end. The mean over the
words decides.

The model is fitted on a bounded sample: for each language at most ``SAMPLE`` different texts (copies and repeated rows
are one), in the order of a seeded hash, never held-out ones, and ``SAMPLE_TOTAL`` of all languages. Of a text above
``SAMPLE_BYTES`` a stretch of whole words is taken. Training documents are cut into runs of ``RUN`` words, and two
runs of any languages make a training sequence, so transitions see switches. Lexicons are the ``LEXICON`` most frequent
words of each language in the sample.

Cases: null texts and texts without a letter are ``und`` with score 0, as is everything if there is nothing to learn
from; a single language is predicted for all other texts; ties go to the first language in order; repeated rows each give
a row; if there is nothing to learn from, every text with a letter counts as recognised, as nothing speaks against it; null ids are not learnt from; other columns are not read for predictions.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .charclass import LETTER, class_table, code_points
from .common import held_out, map_slices, written

SAMPLE = 150
#: Texts of all languages together: where there are many languages, each gives fewer; beyond this many languages, those with
#: the most different texts are learnt.
SAMPLE_TOTAL = 6_000
SAMPLE_BYTES = 16_384
#: Letters times languages of a slice (a longer text is a slice of its own).
CELL_BYTES = 4 << 20
SEED = 4
CELLS = 1 << 16
RUN = 24
LEXICON = 1_000
ROUNDS, RATE, RIDGE = 25, 0.3, 1e-6
MIX = np.uint64(0x9E3779B97F4A7C15)


class Words(NamedTuple):
    """Words of a list of texts: letters of all words in a row, with hashed features."""
    first: np.ndarray  # first letter of each word
    of: np.ndarray     # text of each word
    two: np.ndarray    # feature of the n-gram that starts at each letter; cell 0 for none
    three: np.ndarray
    affix: np.ndarray  # [word, 6]
    name: np.ndarray   # hash of each whole word
    gram: np.ndarray   # the three letters from each letter on, fewer at the end of the word


class Model(NamedTuple):
    labels: list[str]
    weights: np.ndarray      # [CELLS, K], row 0 stays zero
    lexicon: np.ndarray      # sorted word hashes
    member: np.ndarray       # [word of the lexicon, K]
    lexicon_weights: np.ndarray  # [K, K]
    transitions: np.ndarray  # [K, K], from - to
    seen: np.ndarray         # bits of the words and letter runs of each language's training texts


def _cell(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x + np.uint64(salt)) * MIX
    x = (x ^ (x >> np.uint64(31))) * MIX
    return ((x >> np.uint64(40)) % np.uint64(CELLS - 1)).astype(np.int32) + 1


def words_of(texts: list[str | None]) -> Words:
    lowered = [(t or "").lower() for t in texts]
    cp, first = code_points(lowered)
    letter = class_table()[cp] == LETTER
    begins = letter.copy()
    begins[1:] &= ~letter[:-1] | first[1:]
    where = np.flatnonzero(letter)
    c = cp[where].astype(np.uint64)
    start = np.flatnonzero(begins[where])
    n, size = len(where), np.diff(np.append(start, len(where)))
    left = np.repeat(start + size, size) - np.arange(n)  # letters from here to the end of the word
    pad = np.concatenate([c, np.zeros(2, np.uint64)])
    a, b, d = c, pad[1:n + 1], pad[2:n + 2]
    shift = np.uint64(21)
    pair, triple = (a << shift) | b, (((a << shift) | b) << shift) | d
    two = np.where(left >= 2, _cell(pair, 1), 0)
    three = np.where(left >= 3, _cell(triple, 2), 0)
    affix = np.zeros((len(start), 6), np.int32)
    last = start + size - 1
    for k, x in enumerate((c, pair, triple)):
        ok = size > k
        affix[ok, k] = _cell(x[start[ok]], 3 + k)
        affix[ok, 3 + k] = _cell(x[last[ok] - k], 6 + k)
    place = np.arange(n) - np.repeat(start, size)
    with np.errstate(over="ignore"):
        power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(63, MIX, np.uint64)]), dtype=np.uint64)
        mixed = (c + np.uint64(0x1234567)) * power[place & 63] + (place >> 6).astype(np.uint64) * MIX
        name = np.add.reduceat(mixed, start) if n else np.zeros(0, np.uint64)
        name = (name ^ (name >> np.uint64(29))) * MIX
    ends = np.cumsum([len(t) for t in lowered])
    of = np.searchsorted(ends, where[start], side="right")
    gram = (a << (shift + shift)) | (np.where(left >= 2, b, 0) << shift) | np.where(left >= 3, d, 0)
    return Words(start, of, two, three, affix, name, gram)


def _entries(x: np.ndarray, label: np.ndarray, salt: int) -> np.ndarray:
    """Hashes of values of a label, of which ``seen`` takes as many bits as it needs."""
    with np.errstate(over="ignore"):
        x = (x + (label.astype(np.uint64) * np.uint64(3) + np.uint64(salt)) * np.uint64(0xD6E8FEB86659FD93)) * MIX
        x = (x ^ (x >> np.uint64(31))) * MIX
    return x >> np.uint64(24)


def _by_letter(w: Words, of_word: np.ndarray) -> np.ndarray:
    return np.repeat(of_word, np.diff(np.append(w.first, len(w.gram))))


def seen_bits(w: Words, label: np.ndarray) -> np.ndarray:
    """Bits of all words, letter runs and beginnings with the labels of their words, 64 at least for each."""
    every = np.unique(np.concatenate([_entries(w.name, label, 0), _entries(w.gram, _by_letter(w, label), 1),
                                      _entries(w.gram[w.first], label, 2)]))
    size = 1 << max(10, (64 * len(every) - 1).bit_length())
    bits = np.zeros(size, bool)
    bits[every & np.uint64(size - 1)] = True
    return np.packbits(bits, bitorder="little")


def evidence(w: Words, label: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Whether the training texts of each word's label have the word, or its beginning and all of its letter runs."""
    def known(x):
        x &= np.uint64(8 * len(seen) - 1)
        return (seen[x >> np.uint64(3)] >> (x & np.uint64(7)).astype(np.uint8)) & 1 == 1

    runs = np.logical_and.reduceat(known(_entries(w.gram, _by_letter(w, label), 1)), w.first)
    return known(_entries(w.name, label, 0)) | runs & known(_entries(w.gram[w.first], label, 2))


def membership(w: Words, lexicon: np.ndarray, member: np.ndarray) -> np.ndarray:
    """[word, K]: which languages' lexicons hold the word."""
    if not len(lexicon) or not len(w.name):
        return np.zeros((len(w.name), member.shape[1]), np.float32)
    i = np.minimum(np.searchsorted(lexicon, w.name), len(lexicon) - 1)
    return member[i] * (lexicon[i] == w.name)[:, None]


def emissions(w: Words, weights: np.ndarray, lexicon_weights: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Score of each label for each word."""
    grams = np.add.reduceat(weights[w.two] + weights[w.three], w.first, axis=0)
    return grams + weights[w.affix].sum(axis=1) + known @ lexicon_weights


class Messages(NamedTuple):
    """Scaled forward and backward messages, with the factors of words and transitions."""
    word: np.ndarray
    step: np.ndarray
    forward: np.ndarray
    backward: np.ndarray

    def posteriors(self) -> np.ndarray:
        p = self.forward * self.backward
        return p / p.sum(axis=1, keepdims=True)

    def transitions(self, second: np.ndarray) -> np.ndarray:
        """Expected number of each transition into the words ``second``."""
        after = self.word[second] * self.backward[second]
        joint = self.forward[second - 1][:, :, None] * self.step[None] * after[:, None, :]
        return (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)


def messages(score: np.ndarray, transitions: np.ndarray, start: np.ndarray, size: np.ndarray) -> Messages:
    """Forward-backward over sequences that lie one after another; all sequences step together."""
    order = np.argsort(-size, kind="stable")
    start, size = start[order], size[order]
    e = np.exp(score - score.max(axis=1, keepdims=True)).astype(np.float64)
    t = np.exp(transitions - transitions.max())
    forward, backward = np.empty_like(e), np.empty_like(e)
    steps = int(size[0]) if len(size) else 0
    active = np.searchsorted(-size, -np.arange(steps), side="left")
    for k in range(steps):
        at = start[:active[k]] + k
        a = e[at] if k == 0 else (forward[at - 1] @ t) * e[at]
        forward[at] = a / a.sum(axis=1, keepdims=True)
    for k in range(steps - 1, -1, -1):
        m = active[k]
        more = active[k + 1] if k + 1 < steps else 0
        at = start[:m] + k
        b = np.ones((m, e.shape[1]))
        if more:
            nxt = at[:more] + 1
            b[:more] = (backward[nxt] * e[nxt]) @ t.T
            b[:more] /= b[:more].sum(axis=1, keepdims=True)
        backward[at] = b
    return Messages(e, t, forward, backward)


def train(texts: list[str], langs: list[str]) -> Model | None:
    """Fit the field to whole texts of one language each."""
    labels = sorted(set(langs))
    k = len(labels)
    w = words_of(texts)
    if not len(w.first):
        return None
    truth = np.array([labels.index(x) for x in langs])[w.of]
    lexicon, member = _lexicon(w.name, truth, k)
    known = membership(w, lexicon, member)
    weights, lex = np.zeros((CELLS, k)), np.zeros((k, k))
    trans = np.zeros((k, k))
    word_of_letter = np.repeat(np.arange(len(w.first)), np.diff(np.append(w.first, len(w.two))))
    # runs of RUN words of one text; a random order of runs, taken in pairs, gives the sequences
    begin = np.flatnonzero(np.append(True, np.diff(w.of) > 0))
    size = np.diff(np.append(begin, len(w.of)))
    runs = [(b + i, min(RUN, n - i)) for b, n in zip(begin.tolist(), size.tolist(), strict=True) for i in range(0, n, RUN)]
    rng = np.random.default_rng(SEED)
    rng.shuffle(runs)
    order = np.concatenate([np.arange(b, b + n) for b, n in runs])
    lengths = np.array([sum(n for _, n in runs[i:i + 2]) for i in range(0, len(runs), 2)])
    starts = np.cumsum(lengths) - lengths
    y = np.eye(k)[truth[order]]
    inner = np.ones(len(order), bool)
    inner[starts] = False
    pairs = np.flatnonzero(inner)
    gold = y[pairs - 1].T @ y[pairs]
    sums = [np.full_like(x, 1e-2) for x in (weights, lex, trans)]
    n_words = len(order)
    for _ in range(ROUNDS):
        score = emissions(w, weights, lex, known)[order]
        m = messages(score, trans, starts, lengths)
        wrong = np.empty((n_words, k))
        wrong[order] = m.posteriors() - y
        per_letter = wrong[word_of_letter]
        g = np.zeros((CELLS, k))
        for j in range(k):
            for cells, values in ((w.two, per_letter[:, j]), (w.three, per_letter[:, j])):
                g[:, j] += np.bincount(cells, weights=values, minlength=CELLS)
            for c in range(6):
                g[:, j] += np.bincount(w.affix[:, c], weights=wrong[:, j], minlength=CELLS)
        grads = (g / n_words + RIDGE * weights, known.T @ wrong / n_words + RIDGE * lex,
                 (m.transitions(pairs) - gold) / n_words + RIDGE * trans)
        for x, grad, s in zip((weights, lex, trans), grads, sums, strict=True):
            s += (grad * 100) ** 2
            x -= RATE * grad * 100 / np.sqrt(s)
        weights[0] = 0.0
    return Model(labels, weights.astype(np.float32), lexicon, member, lex.astype(np.float32), trans,
                 seen_bits(w, truth))


def _lexicon(names: np.ndarray, truth: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent words of each language: sorted hashes, and which languages have them."""
    every: list[np.ndarray] = []
    for j in range(k):
        found, n = np.unique(names[truth == j], return_counts=True)
        every.append(found[np.lexsort((found, -n))[:LEXICON]])
    lexicon = np.unique(np.concatenate(every))
    return lexicon, np.stack([np.isin(lexicon, e) for e in every], axis=1).astype(np.float32)


def posteriors(w: Words, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word and number of words of each text that has one, and the posterior of each label for each word."""
    begin = np.flatnonzero(np.append(True, np.diff(w.of) > 0))
    size = np.diff(np.append(begin, len(w.of)))
    e = emissions(w, model.weights, model.lexicon_weights, membership(w, model.lexicon, model.member))
    return begin, size, messages(e, model.transitions, begin, size).posteriors()


def predict(texts: list[str | None], model: Model) -> tuple[list[str], np.ndarray]:
    """Language and mean posterior of each text."""
    w = words_of(texts)
    score = np.zeros(len(texts))
    langs = ["und"] * len(texts)
    if not len(w.first):
        return langs, score
    begin, size, p = posteriors(w, model)
    mean = np.add.reduceat(p, begin, axis=0) / size[:, None]
    for text, m in zip(w.of[begin].tolist(), mean, strict=True):
        langs[text], score[text] = model.labels[int(m.argmax())], min(1.0, float(m.max()))
    return langs, score


def recognised(texts: list[str | None], model: Model | None) -> np.ndarray:
    """Mean over each text's words of the largest posterior, where there is evidence of that language; 0 without a word."""
    w = words_of(texts)
    score = np.zeros(len(texts))
    if not len(w.first):
        return score
    if model is None:
        score[w.of] = 1.0
        return score
    begin, size, p = posteriors(w, model)
    of_word = p.max(axis=1) * evidence(w, p.argmax(axis=1), model.seen)
    score[w.of[begin]] = np.add.reduceat(of_word, begin) / size
    return score


def training_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(text, lang, rank) of the bounded sample: different texts of each language, chosen by hash from narrow rows; then only
    the chosen texts are read. A longer text gives the words of a stretch of it."""
    base = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"),
                       F.col(f"`{lang_col}`").alias("lang"))
    base = base.where(F.col("id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("id"))
    rank = F.xxhash64(F.lit(SEED), "text")
    # copies and repeated rows are one text; then two levels, the best of each language and part, then of each language,
    # so that no task ranks all texts of one
    narrow = written(base.select("lang", rank.alias("rank")).distinct().withColumn("part", F.pmod("rank", F.lit(64))), "sample-ranks")
    sizes = narrow.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    most = sizes.orderBy(F.col("n").desc(), "lang").limit(SAMPLE_TOTAL)
    each = min(SAMPLE, max(1, SAMPLE_TOTAL // max(most.count(), 1)))
    narrow = narrow.join(F.broadcast(most.select("lang")), "lang")
    for keys in (("lang", "part"), ("lang",)):
        w = Window.partitionBy(*keys).orderBy("rank")
        narrow = narrow.withColumn("place", F.row_number().over(w)).where(F.col("place") <= each).drop("place")
    chosen = written(narrow.select("lang", "rank"), "sampled-rows")
    found = base.withColumn("rank", rank).join(F.broadcast(chosen), ["lang", "rank"])
    return found.select(stretch("text", "rank").alias("text"), "lang", "rank").dropDuplicates(["lang", "rank"])


def stretch(text: str, rank: str) -> Column:
    """The text, or of one above SAMPLE_BYTES the whole words of a stretch of a quarter as many characters (a character has
    four bytes at most) from a place that the hash decides."""
    size = SAMPLE_BYTES // 4
    start = F.pmod(F.shiftrightunsigned(rank, 7), F.greatest(F.length(text).cast("long") - size, F.lit(1))) + 1
    cut = F.substring(F.col(text), start.cast("int"), F.lit(size))
    whole = F.regexp_extract(cut, r"(?s)^\S*\s(.*)\s\S*$", 1)
    return F.when((F.octet_length(text) <= SAMPLE_BYTES) | (F.length(text) <= size), F.col(text)).otherwise(
        F.when(F.trim(whole) != "", whole).otherwise(cut))


def fitted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    rows = sorted(training_rows(docs, id_col, text_col, lang_col).collect(), key=lambda r: (r["lang"], r["rank"]))
    return train([r["text"] for r in rows], [r["lang"] for r in rows]) if rows else None


def slice_bytes(model: Model | None) -> int:
    """Bytes of text that are labelled at once: the work space has a few numbers for each letter and language."""
    return max(64 << 10, CELL_BYTES // max(1, len(model.labels) if model else 1))


def predicted(docs: DataFrame, model: Model | None, text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """lang_pred and score of every row, with the columns ``carry``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("text").to_pylist()
        langs, score = ["und"] * len(texts), np.zeros(len(texts))
        if shared.value is not None:
            langs, score = predict(texts, Model(*shared.value))
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in carry), pa.array(langs, pa.string()), pa.array(score)],
                                          [*carry, "lang_pred", "score"])

    rows = docs.select(*(F.col(c) for c in carry), F.col(f"`{text_col}`").alias("text"))
    schema = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in carry)
    return map_slices(rows, one, schema + "lang_pred string, score double", limit=slice_bytes(model))


def languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row."""
    model = fitted(docs, id_col, text_col, lang_col)
    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), held_out(id_col).alias("held_out"),
                       F.col(f"`{text_col}`").alias("text"))
    return predicted(rows, model, carry=("doc_id", "held_out"))


def known_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                   least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose words are recognised with a mean of at least ``least``, in one language or
    several."""
    fit = fitted(docs, id_col, text_col, lang_col)
    shared = docs.sparkSession.sparkContext.broadcast(fit)

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = None if shared.value is None else Model(*shared.value)
        score = recognised(batch.column("text").to_pylist(), model)
        return pa.RecordBatch.from_arrays([batch.column("row"), pa.array(score)], ["row", "score"])

    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    rows = rows.select("row", F.col("row").getField(text_col).alias("text"))
    found = map_slices(rows, one, f"row {rows.schema['row'].dataType.simpleString()}, score double", limit=slice_bytes(fit))
    return found.where(F.col("score") >= least).where("score > 0").select("row.*")
