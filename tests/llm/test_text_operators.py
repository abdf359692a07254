"""Operators 1, 2, 3 and 8 against brute force, and their edge cases."""

import itertools
import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from veritab.llm import decontaminate, license_scan, quality_votes, token_count
from veritab.llm.queries import ORACLE

from .conftest import texts

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACE = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# -- licence scan ----------------------------------------------------------------------------------------------------
def base_brute(text):
    words = ALNUM.findall((text or "").translate(LOWER))
    out = []
    for phrase, label in license_scan.BASE_PHRASES.items():
        p = phrase.split()
        out += [(i, label) for i in range(len(words)) if words[i:i + len(p)] == p]
    return len(words), sorted(out)


def test_rules_are_many_and_hold_their_keywords():
    rules = [r for rs in license_scan.rules().values() for r in rs]
    assert len(rules) > 200 and len({(r.label, r.regex.pattern) for r in rules}) == len(rules)


def samples(tree):
    """Texts that a parsed rule matches: every alternative, optional parts left out and put in."""
    out = [""]
    for op, arg in tree:
        kind = str(op)
        if kind == "LITERAL":
            own = [chr(arg)]
        elif kind == "SUBPATTERN":
            own = samples(arg[3])
        elif kind == "BRANCH":
            own = [x for t in arg[1] for x in samples(t)]
        elif kind == "MAX_REPEAT":
            own = sorted({x * n for x in samples(arg[2]) for n in (arg[0], max(arg[0], 1))})
        else:
            assert kind == "IN", kind
            first, value = arg[0]
            own = [chr(value) if str(first) == "LITERAL" else chr(value[0]) if str(first) == "RANGE" else "z"]
        out = [a + b for a in out for b in own]
    return out


def test_every_match_of_a_license_rule_holds_its_keyword():
    n = 0
    for rule in (r for rs in license_scan.rules().values() for r in rs):
        regex = rule.regex.pattern.decode().removeprefix("(?<= )").removesuffix("(?= )")
        for text in samples(re._parser.parse(regex)):
            n += 1
            assert re.fullmatch(regex, text) and rule.keyword.decode() in text.split(), (rule.label, rule.keyword, text)
    assert n > 700
    for text, label in (("licence ouverte 2 0", "etalab"), ("May you do good and not evil", "sqlite-blessing"), ("0BSD", "bsd-zero")):
        assert label in {d.label for d in license_scan.scan(text)[2]}, text


def test_license_scan_base_places(spark, edge_docs, small):
    for docs, source in ((edge_docs, texts()), (small("documents"), None)):
        source = source or [(r["doc_id"], r["text"]) for r in small("documents").collect()]
        expected = Counter()
        for i, t in source:
            n, places = base_brute(t)
            expected[i, n, len(places), places[0][0] if places else None, max(p for p, _ in places) if places else None,
                     ",".join(sorted({x for _, x in places}))] += 1
        got = Counter(tuple(r)[:6] for r in license_scan.license_scan(docs).collect())
        assert got == expected


def test_license_labels_and_suppression():
    _, base, found = license_scan.scan("Licensed under the Apache License, Version 2.0")
    assert not base and {d.label for d in found} == {"apache-2.0"}      # the bare mention is suppressed
    _, base, found = license_scan.scan("GNU General Public License version 3")
    assert [b[1] for b in base] == ["gpl"] and {d.label for d in found} == {"gpl-3.0"}
    assert license_scan.scan(None) == (0, [], []) and license_scan.scan("") == (0, [], [])


def test_suppression_equals_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        found = {license_scan.Detection(f"l{k}", a := rng.randrange(12), a + rng.randrange(6), rng.randint(1, 3), k)
                 for k in range(rng.randrange(12))}

        def beats(o, d):
            inside = o.first_word <= d.first_word and d.last_word <= o.last_word
            size = lambda x: x.last_word - x.first_word
            return o != d and inside and (o.priority, size(o), -o.order) > (d.priority, size(d), -d.order)

        expected = {d for d in found if not any(beats(o, d) for o in found)}
        assert set(license_scan.suppressed(list(found))) == expected


def test_license_scan_scores(edge_docs, no_docs):
    got = license_scan.license_scan(edge_docs).collect()
    assert all(0 <= r["score"] <= 1 and (r["score"] > 0) == bool(r["labels"]) for r in got) and len(got) == len(texts())
    assert license_scan.license_scan(no_docs).count() == 0


# -- quality rules ---------------------------------------------------------------------------------------------------
def signals_brute(text):
    text = text or ""
    w = SPACE.findall(text)
    seen = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if seen[tuple(w[i:i + 8])] > 1 for j in range(i, i + 8)}
    lines, dup = set(), 0
    for line in text.split("\n"):
        if SPACE.search(line):
            dup += line in lines
            lines.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


@pytest.mark.parametrize("which", ["edge", "table"])
def test_quality_signals(which, edge_docs, small):
    docs = edge_docs if which == "edge" else small("documents")
    source = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = quality_votes.quality_rules(docs).collect()
    cols = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert Counter(tuple(r[c] for c in cols) for r in got) == Counter((i, *signals_brute(t)) for i, t in source)
    for r in got:
        failed = r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]
        assert r["base_failed"] == failed and r["kept"] == (not failed and r["quality"] >= quality_votes.KEEP_AT)


def test_quality_model_equals_plain_em(spark):
    rng = random.Random(2)
    patterns = Counter(tuple(rng.choices((1, -1, 0), (7, 2, 2), k=len(quality_votes.RULES))) for _ in range(400))
    df = spark.createDataFrame([(*p, n) for p, n in patterns.items()], [*quality_votes.RULES, "cnt"])
    got = quality_votes.fit(df, iterations=4)

    def post(p, m):
        odds = math.log(m["good"] / (1 - m["good"]))
        for r, v in zip(quality_votes.RULES, p, strict=True):
            good, bad = m[r]
            odds += math.log(good / (1 - bad)) if v == 1 else math.log((1 - good) / bad) if v == -1 else 0.0
        return 1 / (1 + math.exp(-odds))

    belief = {p: quality_votes.START[0] if min(p) >= 0 else quality_votes.START[1] for p in patterns}
    weight, right = quality_votes.PRIOR_WEIGHT, quality_votes.PRIOR_RIGHT
    for _ in range(4):
        good = sum(belief[p] * n for p, n in patterns.items())
        total = sum(patterns.values())
        m = {"good": (good + weight * quality_votes.PRIOR_GOOD) / (total + weight)}
        for k, r in enumerate(quality_votes.RULES):
            pair = []
            for sign, mass in ((1, lambda p: belief[p]), (-1, lambda p: 1 - belief[p])):
                hit = sum(mass(p) * n for p, n in patterns.items() if p[k] == sign)
                voted = sum(mass(p) * n for p, n in patterns.items() if p[k])
                pair.append((hit + weight * right) / (voted + weight))
            m[r] = tuple(pair)
        belief = {p: post(p, m) for p in patterns}
    assert got["good"] == pytest.approx(m["good"])
    for r in quality_votes.RULES:
        assert got[r] == pytest.approx(m[r])


def test_quality_keeps_clean_and_drops_junk(small):
    got = quality_votes.quality_rules(small("documents", "sf0.01")).select("doc_id", "base_failed", "kept")
    m = got.join(small("labels", "sf0.01"), "doc_id").where("not base_failed").collect()
    clean, junk = [r for r in m if r["quality"] == 1], [r for r in m if r["quality"] == 0]
    assert sum(r["kept"] for r in clean) >= 0.99 * len(clean) and sum(not r["kept"] for r in junk) >= 0.8 * len(junk)


def test_quality_empty_and_clashing(edge_docs, no_docs):
    assert quality_votes.quality_rules(no_docs).count() == 0
    kept = quality_votes.kept_documents(edge_docs)
    assert kept.columns == edge_docs.columns and quality_votes.kept_documents(no_docs).count() == 0
    ids = Counter(r["doc_id"] for r in quality_votes.quality_rules(edge_docs).where("kept").collect())
    assert Counter(r["doc_id"] for r in kept.collect()) == ids


# -- token counts ----------------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def word_tokenizer():
    return Tokenizer.from_file(public_tokenizers.path(token_count.DEFAULT_FILE))


def library(tokenizer, items):
    return [len(e.ids) for e in tokenizer.encode_batch([t or "" for t in items], add_special_tokens=False)]


def test_token_counts(edge_docs, small, word_tokenizer, no_docs):
    for docs in (edge_docs, small("documents")):
        source = [(r["doc_id"], r["text"]) for r in docs.collect()]
        n = library(word_tokenizer, [t for _, t in source])
        expected = Counter((i, len((t or "").encode()), k, k > 2048) for (i, t), k in zip(source, n, strict=True))
        assert Counter(tuple(r) for r in token_count.token_counts(docs).collect()) == expected
    assert token_count.token_counts(no_docs).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.text(alphabet="abestrevlmd' \n.9é<|>", max_size=60)), max_size=6))
def test_token_counts_of_any_text(word_tokenizer, items):
    items = [t.encode("utf-8", "ignore").decode() for t in items]
    m = token_count.machine(public_tokenizers.path(token_count.DEFAULT_FILE))
    assert token_count.count_tokens(items, m).tolist() == library(word_tokenizer, items)


def test_prefix_scan_equals_sequential_run():
    rng = random.Random(4)
    text = "".join(rng.choice("ab1 .'strevl\n") for _ in range(5000))
    cp, first = token_count.code_points([text[:2000], text[2000:2001], text[2001:]])
    got, _ = token_count.pre_token_starts(cp, first)
    sym, state, expected = None, 0, []
    two, three = token_count.contractions(cp, first)
    cls = token_count.class_table()[cp]
    for i in range(len(cp)):
        sym = 4 if two[i] else 5 if three[i] else {0: 3, 1: 1, 2: 2, 3: 0}[int(cls[i])]
        sym += 6 if first[i] else 0
        expected.append(bool(token_count.STARTS[sym, state]))
        state = int(token_count.STEP[sym, state])
    assert got.tolist() == expected


def test_dropping_the_tables_changes_nothing(monkeypatch, word_tokenizer):
    monkeypatch.setattr(token_count, "MAX_STATES", 10)
    m = token_count.MergeMachine(public_tokenizers.path(token_count.DEFAULT_FILE))
    for t in ("internationalization of words", "zzzqqq internationally", "internationalization"):
        assert token_count.count_tokens([t], m).tolist() == library(word_tokenizer, [t])


# -- decontamination -------------------------------------------------------------------------------------------------
def sql_rows(docs, benchmark):
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text").toPandas())
    con.register("benchmark", benchmark.toPandas())
    return sorted((tuple(r) for r in con.sql(ORACLE["op8_decontamination"]).fetchall()), key=repr)


@pytest.fixture(scope="module")
def edge_benchmark(spark):
    return spark.createDataFrame(
        [(1, "c d e f g h i j k l m"), (1, "c d e f g h i j k l m"), (2, "one two"), (3, ""), (4, None), (5, "..."),
         (10, "alpha beta gamma delta alpha beta gamma delta alpha beta gamma"), (7, "omega"), (8, "not in any text at all, is it")],
        "item_id long, text string")


def test_decontamination_equals_sql(edge_docs, edge_benchmark, small):
    docs = small("documents")
    for d, b in ((docs, small("benchmark")), (edge_docs.where("doc_id is not null"), edge_benchmark)):
        got = decontaminate.digest(decontaminate.contaminated(d, b))
        assert sorted((tuple(r) for r in got.collect()), key=repr) == sql_rows(d, b)


def test_decontamination_in_blocks(monkeypatch, edge_docs, edge_benchmark, small):
    whole = {n: rows(decontaminate.digest(decontaminate.contaminated(d, b)))
             for n, d, b in (("edge", edge_docs, edge_benchmark), ("table", small("documents"), small("benchmark")))}
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 1500)
    got = decontaminate.digest(decontaminate.contaminated(small("documents"), small("benchmark")))
    assert rows(got) == whole["table"]
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 12)
    assert rows(decontaminate.digest(decontaminate.contaminated(edge_docs, edge_benchmark))) == whole["edge"]


def test_decontamination_edges(edge_docs, no_docs, edge_benchmark):
    none = edge_benchmark.where("false")
    assert not any(r["contaminated"] for r in decontaminate.digest(decontaminate.contaminated(edge_docs, none)).collect())
    assert decontaminate.contaminated(no_docs, edge_benchmark).count() == 0
    clean = decontaminate.clean_documents(edge_docs, edge_benchmark)
    assert clean.columns == edge_docs.columns
    dirty = [r["doc_id"] for r in decontaminate.digest(decontaminate.contaminated(edge_docs, edge_benchmark)).where(
        "contaminated").collect()]
    assert sorted(dirty) == [5, 5, 7, 8, 9, 9] and clean.count() == len(texts()) - len(dirty)


def _blocks_of(items, window):
    class Rows:
        def select(self, *_):
            return self

        def toLocalIterator(self):
            return iter([{"item": i, "text": t} for i, t in items])
    return list(decontaminate._item_blocks(Rows(), "item_id", "text", window))


def test_long_items_are_cut_into_runs_that_hold_each_window_once(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_WINDOWS", 7)
    items = [("a", " ".join(f"w{i}" for i in range(40))), ("b", "x y"), ("c", "w1 w2 w3 w4"), ("d", None)]
    blocks = _blocks_of(items, 4)
    sizes, seen = [], []
    for block in blocks:
        got = [(item, w[k:k + 4]) for item, text in block for w in [text.split()] if w for k in range(max(1, len(w) - 3))]
        sizes.append(len(got))
        seen += got
    assert max(sizes) <= 7 + 4 and len(blocks) > 4
    want = [(item, w[k:k + 4]) for item, text in items for w in [(text or "").encode().split()] if w
            for k in range(max(1, len(w) - 3))]
    assert sorted(seen) == sorted(want)


@pytest.mark.parametrize("same_hash", [False, True])
def test_window_index_against_brute_force(monkeypatch, same_hash):
    """Random words of few letters: many equal windows and prefixes; with all hashes equal, only the bytes decide."""
    if same_hash:
        monkeypatch.setattr(decontaminate, "word_hashes", lambda words: np.full(len(words), 7, np.uint64))
    rng = np.random.default_rng(8)
    draw = lambda n: [bytes([97 + x]) for x in rng.integers(0, 3, n)]
    items = [(str(i % 5), b" ".join(draw(int(n)))) for i, n in enumerate(rng.integers(0, 9, 12))]
    index = decontaminate.WindowIndex(items, window=5)
    counts = {k: np.zeros(len(t.hashes), np.int64) for k, t in index.tables.items()}
    docs = [draw(int(n)) for n in rng.integers(0, 60, 40)]
    for words in docs:
        index.counted(words, counts)
    index.order_by(counts)
    windows = {(item, tuple(w[k:k + min(5, len(w))])) for item, t in items for w in [t.split()] if w
               for k in range(max(1, len(w) - 4))}
    for words in docs:
        want = {(s, s + len(w), item) for item, w in windows for s in range(len(words) - len(w) + 1)
                if tuple(words[s:s + len(w)]) == w}
        spans, found = index.hits(words)
        assert sorted(spans) == sorted({(a, b) for a, b, _ in want}) and found == {i for *_, i in want}


def test_window_index_memory():
    """A tenth of a block stays within a tenth of 300 MB."""
    import tracemalloc
    rng = np.random.default_rng(2)
    words = [b"%x" % x for x in rng.integers(0, 1 << 24, 50_000).tolist()]
    items = [(str(i), b" ".join(words[x] for x in rng.integers(0, len(words), 120).tolist())) for i in range(1_340)]
    tracemalloc.start()
    index = decontaminate.WindowIndex(items)
    index.order_by({})
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(index.at) > decontaminate.BLOCK_WINDOWS / 11 and peak < 30e6 + 40e6 * (decontaminate.CHUNK / len(index.at))


def test_covered_ranges():
    for spans in itertools.product([(0, 3), (2, 5), (5, 6), (8, 9)], repeat=3):
        got = decontaminate.covered(list(spans))
        assert sorted(p for a, b in got for p in range(a, b)) == sorted({p for a, b in spans for p in range(a, b)})
