"""Operators 12 and 13 against brute force, and their edge cases."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veritab.llm import phrases, shared_search
from veritab.llm.wordruns import BREAK, KeySet, byte_table, chunks, word_runs

from .conftest import LONG

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lower(text):
    return (text or "").translate(UPPER)


# -- words of a column -----------------------------------------------------------------------------------------------
def test_word_runs_split_like_a_pattern():
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab \t.,é😀\n") for _ in range(rng.randrange(30))) for _ in range(200)] + ["", None, "..", "x"]
    kind, low = byte_table(b" \t", b".,\n")
    column = pa.array(["pad", *texts])[1:]
    got = word_runs(column, kind, low)
    found = defaultdict(list)
    for w, r, f in zip(got.words.to_pylist(), got.row.tolist(), got.first.tolist(), strict=True):
        if f:
            found[r].append([])
        found[r][-1].append(w.decode())
    for i, t in enumerate(texts):
        pieces = [re.findall(r"[^ \t]+", p) for p in re.split(r"[.,\n]", t or "")]
        assert found.get(i, []) == [p for p in pieces if p]
    for limit in (1, 7, 50):
        rows, parts = zip(*[(int(r[0]) if len(r) == 1 else r.tolist(), t) for r, t in chunks(column, kind, limit, BREAK)],
                          strict=True)
        assert b"".join(b"".join(p.to_pylist()) for p in parts).decode() == "".join(t or "" for t in texts)


def test_key_set_finds_all_members():
    rng = np.random.default_rng(4)
    keys = rng.integers(0, 2**64, 1000, dtype=np.uint64)
    words = np.zeros(1 << 8, np.uint64)
    for at in (*(keys % 2**14).tolist(), *((keys >> np.uint64(32)) % np.uint64(2**14)).tolist()):
        words[at >> 6] |= np.uint64(1 << (at & 63))
    known = KeySet(words)
    assert known.holds(keys).all() and int(keys[0]) in known
    assert known.holds(rng.integers(0, 2**64, 1000, dtype=np.uint64)).mean() < 0.2


# -- phrases ---------------------------------------------------------------------------------------------------------
def brute_phrases(rows, support, top):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = lang if lang is not None else "und"
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for size in range(1, 5):
                f[lang].update(" ".join(w[s:s + size]) for s in range(len(w) - size + 1))
    out = []
    for lang, counts in f.items():
        cand = {p: c for p, c in counts.items() if " " in p and c >= support}
        scored = []
        for p, a in cand.items():
            w = p.split(" ")
            if any(f" {p} " in f" {q} " and q != p and 100 * b >= 80 * a for q, b in cand.items()):
                continue
            cuts = [(2000000 * a // (counts[" ".join(w[:k])] + counts[" ".join(w[k:])]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            scored.append((-score, -a, p.encode(), counts[" ".join(w[:k])], counts[" ".join(w[k:])]))
        for rank, (s, a, p, le, r) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), -a, le, r, n[lang], -s))
    return sorted(out)


def phrase_rows(df, support=30, top=2000, **kw):
    return sorted(tuple(r) for r in phrases.collocations(df, support, top, **kw).collect())


@pytest.mark.parametrize("support, top", [(30, 2000), (5, 40)])
def test_phrases_equal_brute_force(spark, support, top):
    rng = random.Random(support)
    words = ["a", "b", "É", "c-d", " ", "x_y", "😀"]
    rows = []
    for i in range(900):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t ", ", ", ".", "\n", "!"]) for _ in range(rng.randrange(60)))
        rows.append((i if i % 7 else None, rng.choice(["en", "en", "en", "de", None, "und"]), text if i % 11 else None))
    rows += [(1, "en", "Hot Pair " * 300)] * 3 + [(2, "fr", "")]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(5)
    got = phrase_rows(df, support, top)
    assert got == brute_phrases([(r[1], r[2]) for r in rows], support, top) and len(got) > 15


def test_phrases_in_small_slices_and_few_bits(spark, monkeypatch):
    """The result does not change when texts are cut between pieces and when the bit maps let every stranger through."""
    rng = random.Random(8)
    rows = [(i, "en", " ".join(rng.choice("a b c, d. e".split(" ")) for _ in range(400))) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(2)
    expected = brute_phrases([(r[1], r[2]) for r in rows], 30, 2000)
    assert phrase_rows(df) == expected
    monkeypatch.setattr(phrases, "SHARDS", 3)
    monkeypatch.setattr(phrases, "RANK_ROWS", 10)
    assert phrase_rows(df) == expected


def test_local_mining_is_what_admits_phrases(spark):
    """Only runs that reach the local support of a shard are candidates; every frequent one is among them."""
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choices("abcdefghijkl", range(1, 13), k=100))) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, text string").select(
        F.lit("en").alias("lang"), "text", (F.col("id") % phrases.SHARDS).cast("int").alias("shard"),
        (F.col("id") % phrases.SHARDS).alias("grp"))
    words = phrases.local_counts(df, (1,), None, 3).cache()
    sizes = words.groupBy("grp").agg(F.sum("c").alias("shard_n")).select(F.lit("en").alias("lang"), "*", F.lit(6000).alias("n"))
    least = phrases.local_supports(sizes, 30)
    assert sorted(least) == list(range(phrases.SHARDS)) and {a for a, _ in least.values()} <= {7, 8}
    assert {s for _, s in least.values()} == {sum(a - 1 for a, _ in least.values())}
    every = phrases.local_counts(df, (2,), phrases.key_set(words.select(F.col("at").alias("key"))), 3)
    often = phrases.local_counts(df, (2,), phrases.key_set(words.select(F.col("at").alias("key"))), 3, least)
    known = phrases.candidates_of(often, 30)
    real = Counter(p for _, t in rows for p in map(" ".join, zip(t.split(), t.split()[1:], strict=False)))
    assert sum(c >= 30 for c in real.values()) <= known.count() <= often.select("key").distinct().count() < len(real)
    assert often.count() < every.count() and every.agg(F.sum("c")).first()[0] == sum(real.values())
    counts = phrases.global_counts(df, phrases.key_set(known), 30)
    assert counts.count() == 0                         # words are no candidates here, so no pair starts with one


def test_phrase_scores_are_exact_for_huge_counts(spark):
    big = 4_611_686_018_427_387_905
    counts = spark.createDataFrame([("en", 1, "x", big), ("en", 1, "y", big - 3), ("en", 2, "x y", big - 7)],
                                   "lang string, n int, phrase string, f long")
    got = phrases.scored(counts).first()
    assert got["score"] == 2_000_000 * (big - 7) // (2 * big - 3)


def test_phrases_on_edges(edge_docs, no_docs):
    rows = [(r["lang"], r["text"]) for r in edge_docs.collect()]
    assert phrase_rows(edge_docs) == brute_phrases(rows, 30, 2000) != []
    assert phrase_rows(no_docs) == []


# -- search ----------------------------------------------------------------------------------------------------------
def brute_search(docs, items, k=10):
    pattern = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    terms = [re.findall(pattern, lower(t)) for _, t in docs]
    n_docs, total = sum(bool(t) for t in terms), sum(map(len, terms))
    df = Counter(t for d in terms for t in set(d))
    wanted = defaultdict(set)
    for item, text in items:
        wanted[item] |= set(re.findall(pattern, lower(text)))
    out = []
    for item, mine in wanted.items():
        rows = []
        for (doc, _), d in zip(docs, terms, strict=True):
            tf, score = Counter(d), 0
            m = 10 + (90 * len(d) * n_docs) // total if total else 0
            for t in mine & set(d):
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                score += w * (1000000000 * tf[t] // (1000 * tf[t] + 8 * m))
            if score > 0:
                rows.append((-score, doc is None, doc or 0))
        out += [(item, rank, None if null else doc, -s) for rank, (s, null, doc) in enumerate(sorted(rows)[:k], 1)]
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def search_rows(docs, items, **kw):
    got = [tuple(r) for r in shared_search.search(docs, items, **kw).collect()]
    return sorted(got, key=lambda r: (r[0] is None, r[0] or 0, r[1]))


@pytest.mark.parametrize("block_terms", [200_000, 20])
def test_search_equals_brute_force(spark, monkeypatch, block_terms):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(40)] + ["É", "the", "The", "日本"]
    say = lambda n: " ".join(rng.choice(words) for _ in range(rng.randrange(n)))
    docs = [(i if i % 9 else None, say(50) if i % 13 else None) for i in range(150)]
    docs += docs[:20] + [(500, "The " * 900), (501, "")] + [(600 - i, "w1 w2 copy") for i in range(30)]
    items = [(i, say(25)) for i in range(30)] + [(3, "w7 É"), (None, "w1 w2"), (None, "w3"), (77, None), (78, "absent")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    it = spark.createDataFrame(items, "item_id long, text string")
    got = search_rows(df, it, block_terms=block_terms)
    assert got == brute_search(docs, items) and len(got) > 200
    monkeypatch.setattr(shared_search, "CELLS", 300)   # runs of a few documents each
    assert search_rows(df, it, block_terms=block_terms) == got


def test_search_on_edges(spark, edge_docs, no_docs):
    items = spark.createDataFrame([("one", "One two THREE", "x"), ("long", LONG, "x"), (None, None, "x"), ("x", "", "x")],
                                  "item_id string, text string, score string")
    rows = [(r["doc_id"], r["text"]) for r in edge_docs.collect()]
    got = sorted(tuple(r) for r in shared_search.search(edge_docs, items).collect())
    assert got == sorted(brute_search(rows, [("one", "One two THREE"), ("long", LONG)])) and got
    assert shared_search.search(no_docs, items).count() == 0
    none = shared_search.search(edge_docs, items.where("false"))
    assert none.count() == 0 and none.columns == ["item_id", "rank", "doc_id", "score"]


def test_shared_sets_cover_every_term_once_and_are_shared():
    rng = random.Random(2)
    sets = [set(rng.sample(range(60), rng.randrange(1, 30))) for _ in range(40)] + [set(range(20))] * 5
    classes, pairs, nodes = shared_search.shared_sets(sets)
    below = {n: list(c) for n, c in enumerate(classes)}
    for n, (a, b) in enumerate(pairs, len(classes)):
        below[n] = below[a] + below[b]
    for mine, wanted in zip(nodes, sets, strict=True):
        held = [t for n in mine for t in below[n]]
        assert len(held) == len(wanted) and set(held) == wanted
    steps = len(pairs) + sum(map(len, nodes))
    assert steps < 0.75 * sum(map(len, sets)) and all(len(nodes[-1]) == len(x) for x in nodes[-5:])


def test_scores_come_from_the_shared_nodes(spark, monkeypatch):
    """Without the level that adds up shared nodes, scores are lost: the DAG is what scores items."""
    items = spark.createDataFrame([(i, f"a b c d only{i}") for i in range(4)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b c d"), (2, "only1 x"), (3, "y z")], "doc_id long, text string")
    whole = search_rows(docs, items)
    real = shared_search.shared_sets

    def cut(sets):
        classes, pairs, nodes = real(sets)
        shared = {n for n in range(len(classes) + len(pairs)) if sum(n in x for x in nodes) > 1}
        return classes, pairs, [[n for n in x if n not in shared] for x in nodes]
    monkeypatch.setattr(shared_search, "shared_sets", cut)
    assert len(search_rows(docs, items)) < len(whole)
