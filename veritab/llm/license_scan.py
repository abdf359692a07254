"""Operator 1: licence scan with ordered signature rules.

Each rule of ``license_rules`` is tried only on texts that hold its keyword (the prefilter: one set look-up per text).
Matches become word intervals. A detection is suppressed if its interval lies within that of a detection of higher
priority, or of the same priority and greater length, or the same interval of an earlier rule. What is left gives the
labels; the score is the noisy-or of the detections' confidences, one for each label.

Apart from the rules, fixed base phrases are searched at all places; their labels are never suppressed.

Cases: null and empty texts have no words, no labels and score 0; a null id stays null; repeated rows each give a row;
other columns are not read. Whole texts are scanned; a text is worked on by itself, so hot sources or copies do not
gather anywhere.
"""

from __future__ import annotations

import functools
import re
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import alnum_words, map_slices
from .license_rules import RULES_TEXT

BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Confidence of a detection by priority.
CONFIDENCE = {1: 0.4, 2: 0.8, 3: 0.95}


class Rule(NamedTuple):
    order: int
    label: str
    priority: int
    keyword: bytes
    regex: re.Pattern


class Detection(NamedTuple):
    label: str
    first_word: int
    last_word: int
    priority: int
    order: int


@functools.cache
def rules() -> dict[bytes, list[Rule]]:
    """The rules by keyword."""
    out: dict[bytes, list[Rule]] = {}
    for i, line in enumerate(RULES_TEXT.strip().splitlines()):
        label, priority, keyword, regex = (x.strip() for x in line.split(";"))
        rule = Rule(i, label, int(priority), keyword.encode(), re.compile(rb"(?<= )(?:" + regex.encode() + rb")(?= )"))
        out.setdefault(rule.keyword, []).append(rule)
    return out


def suppressed(found: list[Detection]) -> list[Detection]:
    """Drop detections contained in the interval of a stronger one (one sweep from left to right)."""
    ordered = sorted(set(found), key=lambda d: (d.first_word, -d.last_word, -d.priority, d.order))
    open_, kept = [], []
    for d in ordered:
        open_ = [o for o in open_ if o.last_word >= d.first_word]
        beaten = any(o.last_word >= d.last_word and o.priority >= d.priority for o in open_)
        if not beaten:
            kept.append(d)
            open_.append(d)
    # a container always sorts first: it starts earlier or reaches further, or has the higher priority
    return kept


def base_places(joined: bytes, known: set[bytes]) -> list[tuple[int, str]]:
    """(start word, label) of every place of a base phrase."""
    out = []
    for phrase, label in BASE_PHRASES.items():
        words = phrase.encode().split()
        if all(w in known for w in words):
            needle = b" " + phrase.encode() + b" "
            at = joined.find(needle)
            while at >= 0:
                out.append((at, label))
                at = joined.find(needle, at + 1)
    return _word_numbers(joined, out)


def _word_numbers(joined: bytes, places: list[tuple]) -> list[tuple]:
    """Replace byte offsets of word borders by word numbers, counting the text once."""
    done = words = 0
    out = []
    for at, *rest in sorted(places):
        words += joined.count(b" ", done, at)
        done = at
        out.append((words, *rest))
    return out


def scan(text: str | None) -> tuple[int, list[tuple[int, str]], list[Detection]]:
    """Number of words, base places, and the detections that are left."""
    words = alnum_words(text)
    known = set(words)
    active = sorted((r for k in rules().keys() & known for r in rules()[k]), key=lambda r: r.order)
    has_base = any(all(w in known for w in p.encode().split()) for p in BASE_PHRASES)
    if not active and not has_base:
        return len(words), [], []
    joined = b" " + b" ".join(words) + b" "
    spans = _word_numbers(joined, [(m.start() - 1, joined.count(b" ", m.start(), m.end()), r.label, r.priority, r.order)
                                   for r in active for m in r.regex.finditer(joined)])
    found = [Detection(label, first, first + more, priority, order) for first, more, label, priority, order in spans]
    return len(words), base_places(joined, known), suppressed(found)


DETECTION = "array<struct<label:string,first_word:bigint,last_word:bigint,priority:int>>"


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections."""
    kind = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()),
                               ("priority", pa.int32())]))

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols: list[list] = [[] for _ in range(8)]
        for text in batch.column("text").to_pylist():
            n, base, found = scan(text)
            best: dict[str, int] = {}
            for d in found:
                best[d.label] = max(best.get(d.label, 0), d.priority)
            for _, label in base:
                best.setdefault(label, 2)
            doubt = 1.0
            for _, p in sorted(best.items()):
                doubt *= 1.0 - CONFIDENCE[p]
            row = (n, len(base), min((b[0] for b in base), default=None), max((b[0] for b in base), default=None),
                   ",".join(sorted({b[1] for b in base})), ",".join(sorted(best)), 1.0 - doubt,
                   [d._asdict() for d in found])
            for c, v in zip(cols, row, strict=True):
                c.append(v)
        types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), kind]
        for d in cols[7]:
            for x in d:
                x.pop("order")
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))],
            ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"])

    rows = docs.selectExpr(f"CAST(`{id_col}` AS bigint) AS doc_id", f"`{text_col}` AS text")
    return map_slices(rows, one, "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, "
                                 f"base_labels string, labels string, score double, detections {DETECTION}")
