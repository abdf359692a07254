"""Operators 4, 5 and 10: their exact parts against brute force, held-out accuracy, and edge cases."""

import itertools
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from veritab.llm import language_crf, site_bayes, toxicity

from .conftest import texts


def held_out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 4 == 2


def auc(pairs):
    good, bad = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))


# -- language --------------------------------------------------------------------------------------------------------
def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(1)
    score, trans = rng.normal(size=(9, 3)), rng.normal(size=(3, 3))
    start, size = np.array([0, 4, 5]), np.array([4, 1, 4])
    m = language_crf.messages(score, trans, start, size)
    pairs = np.array([1, 2, 3, 6, 7, 8])
    expected, moves = np.zeros((9, 3)), np.zeros((3, 3))
    for s, n in zip(start, size, strict=True):
        total, part, walk = 0.0, np.zeros((n, 3)), np.zeros((3, 3))
        for path in itertools.product(range(3), repeat=int(n)):
            w = math.exp(sum(score[s + k, y] for k, y in enumerate(path)) + sum(trans[a, b] for a, b in itertools.pairwise(path)))
            total += w
            for k, y in enumerate(path):
                part[k, y] += w
            for a, b in itertools.pairwise(path):
                walk[a, b] += w
        expected[s:s + n], moves = part / total, moves + walk / total
    assert np.allclose(m.posteriors(), expected) and np.allclose(m.transitions(pairs), moves)


def test_languages_of_held_out_documents(small):
    docs = small("documents", "sf0.01")
    got = {r["doc_id"]: r for r in language_crf.languages(docs).collect()}
    right = [got[r["doc_id"]]["lang_pred"] == r["lang"] for r in docs.collect() if held_out(r["doc_id"]) and r["lang"]]
    assert len(got) == docs.count() and sum(right) >= 0.97 * len(right)
    assert all(r["held_out"] == held_out(i) and 0 <= r["score"] <= 1 for i, r in got.items())


def test_code_switched_words(small):
    rows = [r for r in small("documents", "sf0.01").collect() if r["lang"] and 300 < len(r["text"]) < 4000]
    train = rows[::2]
    m = language_crf.train([r["text"] for r in train], [r["lang"] for r in train])
    a, b = (next(r for r in rows[1::2] if r["lang"] == x) for x in ("en", "fr"))
    w = language_crf.words_of([a["text"][:300] + " " + b["text"][:300]])
    e = language_crf.emissions(w, m.weights, m.lexicon_weights, language_crf.membership(w, m.lexicon, m.member))
    best = language_crf.messages(e, m.transitions, np.array([0]), np.array([len(e)])).posteriors().argmax(axis=1)
    half = len(best) // 2
    assert np.mean(best[:half - 4] == m.labels.index("en")) > 0.8 and np.mean(best[half + 4:] == m.labels.index("fr")) > 0.8


def test_texts_of_several_languages_are_recognised(small, spark):
    rows = [r for r in small("documents", "sf0.01").collect() if r["lang"] and r["text"] and 300 < len(r["text"]) < 4000]
    of = {x: [r["text"].split() for r in rows if r["lang"] == x] for x in ("en", "fr", "de", "es")}
    rng = random.Random(2)
    planted = [" ".join(" ".join(rng.choice(of[x])[:50]) for x in rng.sample(sorted(of), k)) for k in (2, 3, 4) for _ in range(30)]
    junk = [" ".join("".join(rng.choice("qxzjkwvhpd") for _ in range(rng.randint(5, 9))) for _ in range(80)) for _ in range(20)]
    junk += ["Это предложение написано на другом языке и никто его не учил " * 3]
    every = [(i, r["text"], r["lang"]) for i, r in enumerate(rows)]
    every += [(10_000 + i, t, None) for i, t in enumerate(planted)] + [(20_000 + i, t, None) for i, t in enumerate(junk)]
    docs = spark.createDataFrame(every, "doc_id long, text string, lang string")
    kept = {r["doc_id"] for r in language_crf.known_language(docs).collect()}
    assert {10_000 + i for i in range(len(planted))} <= kept and not any(i >= 20_000 for i in kept)
    assert len([i for i in kept if i < 10_000]) >= 0.99 * len(rows)
    one = language_crf.known_language(docs.withColumn("lang", F.expr("if(lang = 'en', lang, null)"))).collect()
    kept = {r["doc_id"] for r in one}
    share = {x: np.mean([i in kept for i, r in enumerate(rows) if r["lang"] == x]) for x in of}
    assert share["en"] >= 0.99 and max(share[x] for x in ("fr", "de", "es")) < 0.5 and not any(i >= 20_000 for i in kept)
    unlabelled = language_crf.known_language(docs.withColumn("lang", F.lit(None).cast("string")))
    assert unlabelled.count() == docs.count()


def test_language_edges(edge_docs, no_docs, spark):
    got = language_crf.languages(edge_docs).collect()
    assert len(got) == len(texts())
    for r in got:
        text = dict((i, t) for i, t in texts() if i is not None).get(r["doc_id"])
        if r["doc_id"] is not None:
            assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in text or ""))
    assert language_crf.languages(no_docs).count() == 0
    unlabelled = edge_docs.withColumn("lang", F.lit(None).cast("string"))
    assert {(r["lang_pred"], r["score"]) for r in language_crf.languages(unlabelled).collect()} == {("und", 0.0)}
    kept = language_crf.known_language(edge_docs)
    assert kept.columns == edge_docs.columns and kept.where("text is null").count() == 0


# -- sites -----------------------------------------------------------------------------------------------------------
def test_site_quality_separates_held_out_documents(small):
    got = {r["doc_id"]: r for r in site_bayes.site_quality(small("documents", "sf0.01"), small("labels", "sf0.01")).collect()}
    labels = [(got[r["doc_id"]]["score"], r["quality"]) for r in small("labels", "sf0.01").collect() if held_out(r["doc_id"])]
    assert len(got) == 1000 and auc(labels) > 0.9


def test_site_rates_are_shrunk(spark):
    rows = [(i, "plain words of a text " * 5 if i % 4 else "### $$$ *** ", f"h{i % 2}/a{i % 3}/x") for i in range(120)]
    rows += [(500, "plain words of a text " * 5, "rare/one"), (501, "### $$$", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    labels = spark.createDataFrame([(i, 1 if i % 4 else 0) for i in range(120)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in site_bayes.site_quality(docs, labels).collect()}
    assert len(got) == len(rows)
    mean = sum(r["text_score"] for r in got.values()) / len(got)
    raw = {s: [got[i]["text_score"] for i, _, x in rows if x and x.split("/")[0] == s] for s in ("h0", "h1", "rare")}
    for i, site in ((0, "h0"), (1, "h1"), (500, "rare")):
        own = sum(raw[site]) / len(raw[site])
        assert min(own, mean) - 1e-9 <= got[i]["site_rate"] <= max(own, mean) + 1e-9
    pull = lambda i, s: abs(got[i]["site_rate"] - sum(raw[s]) / len(raw[s])) / abs(mean - sum(raw[s]) / len(raw[s]))
    assert pull(500, "rare") > pull(0, "h0") and got[500]["kept"] and not got[501]["kept"]


def test_sites_and_paths_of_addresses(spark):
    expected = {
        "https://Host.org/a/b/c.html": ("host.org", "host.org/a/b"), "http://host.org/a/b/": ("host.org", "host.org/a/b"),
        "//host.org/a/b?x=/y/z": ("host.org", "host.org/a"), "https://host.org": ("host.org", "host.org"),
        "https://host.org/#/a/b": ("host.org", "host.org"), "https://host.org/a/b/c/d/e": ("host.org", "host.org/a/b/c/d"),
        "src0": ("src0", "src0"), "h0/a1/x": ("h0", "h0/a1"), "": ("", ""), None: (None, None)}
    rows = spark.createDataFrame([(s,) for s in expected], "source string")
    got = {r[0]: (r[1], r[2]) for r in rows.select("source", *site_bayes.site_and_path(F.col("source"))).collect()}
    assert got == expected


def test_hosts_have_rates_of_their_own(spark):
    good, bad = "plain words of a text " * 5, "### $$$ *** "
    rows = [(i, bad if (i % 2 if i % 10 else not i % 2) else good, f"https://h{i % 2}.org/a/b{i % 4}/c{i}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    labels = spark.createDataFrame([(i, int(t == good)) for i, t, _ in rows], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in site_bayes.site_quality(docs, labels).collect()}
    assert len(got) == 400 and got[2]["site_rate"] > 0.7 > 0.3 > got[1]["site_rate"]


def test_site_quality_edges(edge_docs, no_docs, edge_labels):
    got = site_bayes.site_quality(edge_docs, edge_labels).collect()
    assert len(got) == len(texts()) and all(0 <= r["score"] <= 1 for r in got)
    assert {r["score"] for r in site_bayes.site_quality(edge_docs, edge_labels.where("false")).collect()} == {0.5}
    assert site_bayes.site_quality(no_docs, edge_labels).count() == 0


# -- toxicity --------------------------------------------------------------------------------------------------------
def segments_brute(x):
    """Recursive definition: the best segment, then those left and right of it (positive ones)."""
    best = max(((sum(x[a:b]), -(b - a), -a, a, b) for a in range(len(x)) for b in range(a + 1, len(x) + 1)), default=None)
    if best is None or best[0] <= 1e-12:
        return []
    a, b = best[3:]
    left, right = segments_brute(x[:a]), segments_brute(x[b:])
    return [*left, (a, b), *[(c + b, d + b) for c, d in right]]


def test_maximal_segments():
    rng = random.Random(9)
    for _ in range(400):
        x = [rng.choice((-2.0, -1.0, -0.5, 0.75, 1.25, 3.5)) + rng.random() / 100 for _ in range(rng.randint(0, 12))]
        got = [(s.first_word, s.past_word) for s in toxicity.maximal_segments(np.array(x))]
        assert got == segments_brute(x)


def test_karlin_lambda():
    share, score = np.array([0.7, 0.2, 0.1]), np.array([-1.0, 0.5, 2.0])
    lam = toxicity.karlin_lambda(share, score)
    assert float(share @ np.exp(lam * score)) == pytest.approx(1.0, abs=1e-6) and lam > 0
    assert toxicity.karlin_lambda(np.array([1.0]), np.array([-1.0])) > 0


def evidence_brute(scores, n, lam, log_k):
    own = [x for x in sorted((lam * s - log_k - math.log(n) for s in scores), reverse=True) if x > 0]
    return max((t - (r - 1) * math.log(max(t, 1.0)) + math.log(math.factorial(r)) + math.log(math.factorial(r - 1))
                for r in range(1, len(own) + 1) for t in [sum(own[:r])]), default=0.0)


def test_evidence_of_all_segments():
    rng = np.random.default_rng(3)
    for n in (0, 1, 3, 12, 40):
        scores = rng.exponential(4.0, n)
        assert toxicity.evidence(scores, 50, 0.9, -1.0) == pytest.approx(max(0.0, evidence_brute(scores, 50, 0.9, -1.0)))
    strong = [toxicity.evidence(np.full(n, 9.0), 1000, 0.9, -1.0) for n in (1, 8, 50)]
    assert 0 < strong[0] < strong[1] < strong[2]


def test_k_from_the_upper_half_of_the_segments():
    rng = np.random.default_rng(5)
    found = np.minimum(rng.geometric(0.05, 301), toxicity.TOP_STEPS - 1)
    counts = np.bincount(found, minlength=toxicity.TOP_STEPS)
    floor = max(s for s in found.tolist() if (found >= s).sum() >= toxicity.TAIL_SHARE * len(found))
    expected = math.log((found >= floor).sum() / 9_000) + 0.4 * floor / toxicity.STEPS
    assert toxicity.karlin_log_k(counts, 9_000, 0.4) == pytest.approx(expected)
    assert toxicity.karlin_log_k(counts * 0, 9_000, 0.4) == toxicity.karlin_log_k(counts, 0, 0.4) == math.log(1e-3)


def every_lambda(steps, times):
    """The root for counts of scores; the bound of the search is that of all scores a word can have."""
    share = np.zeros(toxicity.SCORE_STEPS)
    for s, n in zip(steps, times, strict=True):
        share[int(round(s - toxicity.LOWEST * toxicity.STEPS))] = n / times.sum()
    return toxicity.karlin_lambda(share, np.arange(toxicity.SCORE_STEPS) / toxicity.STEPS + toxicity.LOWEST)


def test_the_calibration_by_brute_force(small):
    """lambda, K and the curve from all segments of the examples, one after another."""
    docs = small("documents", "sf0.01").select("doc_id", "text")
    labels = toxicity.sampled_labels(small("labels", "sf0.01"))
    model = toxicity.fit(docs, labels)
    scores = toxicity.TokenScores(model.drawn)
    rows = [(r["toxic"], r["weight"], scores.of(toxicity.alnum_words(r["text"]))) for r in toxicity.examples(docs, labels).collect()]
    clean = [(w, own) for y, w, own in rows if not y]
    values = np.concatenate([np.repeat(own, w) for w, own in clean])
    steps, times = np.unique(np.rint(values * toxicity.STEPS), return_counts=True)
    assert model.lam == pytest.approx(every_lambda(steps, times))
    found = sorted((round(s.score * toxicity.STEPS) / toxicity.STEPS for w, own in clean
                    for s in toxicity.maximal_segments(own) for _ in range(w)), reverse=True)
    if found:
        floor = max(s for s in found if sum(x >= s for x in found) >= toxicity.TAIL_SHARE * len(found))
        above = sum(x >= floor for x in found)
        assert model.log_k == pytest.approx(math.log(above / len(values)) + model.lam * floor)
    else:
        assert model.log_k == math.log(1e-3)
    x = [evidence_brute([s.score for s in toxicity.maximal_segments(own)], max(1, len(own)), model.lam, model.log_k)
         for _, _, own in rows]
    bias, slope = toxicity.fit_curve(np.log1p(np.maximum(0, x)), np.array([float(y) for y, *_ in rows]),
                                     np.array([float(w) for _, w, _ in rows]))
    assert (model.bias, model.slope) == pytest.approx((bias, slope), rel=1e-4)


@pytest.mark.parametrize(("toxic", "clean", "first"), [(152, 1633, 4.85), (223, 2840, 3.53), (284, 1950, 4.69)])
def test_toxic_curve_of_classes_far_apart(toxic, clean, first):
    """Whole Newton steps swing to and fro here and end with all scores near zero."""
    x = np.concatenate([np.linspace(first, first + 1.5, toxic), np.zeros(clean - clean // 20), np.linspace(0, 0.9 * first, clean // 20)])
    y = np.concatenate([np.ones(toxic), np.zeros(clean)])
    weight = np.ones(len(x))
    bias, slope = toxicity.fit_curve(x, y, weight)
    p = 1 / (1 + np.exp(-(bias + slope * x)))
    assert (p[y > 0] >= 0.3).all() and (p[y == 0] < 0.3).all()
    a = np.stack([np.ones_like(x), x], axis=1)
    assert np.abs(a.T @ (p - y) + 1e-3 * np.array([bias, slope])).max() < 1e-3     # the gradient at the optimum


def test_toxic_documents(small):
    docs, labels = small("documents", "sf0.1"), small("labels", "sf0.1")
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs, labels).collect()}
    pairs = [(got[r["doc_id"]]["score"], r["toxic"]) for r in labels.collect() if held_out(r["doc_id"])]
    assert len(got) == docs.count() and auc(pairs) > 0.93
    caught = [s >= 0.3 for s, y in pairs if y]
    spared = [s < 0.3 for s, y in pairs if not y]
    assert sum(caught) >= 0.85 * len(caught) and sum(spared) >= 0.95 * len(spared)
    assert all(r["predicted"] == (r["score"] >= 0.3) and r["held_out"] == held_out(i) for i, r in got.items())


def test_few_labels_rank_held_out_documents(spark):
    """Nine toxic of 90 texts to learn from, four of ten bad words in each: held-out ones are told apart all the same."""
    rng = random.Random(8)
    bad = [f"{c}{c}{c}{c}vile" for c in "abcdefghij"]
    plain = [f"{a}{b}plain" for a in "abcdefghijklmnop" for b in "qrstuvwxyz"]
    ids = [i for i in range(400) if not held_out(i)][:90] + [i for i in range(400) if held_out(i)][:80]
    rows = [(i, int(n % 10 == 0)) for n, i in enumerate(ids)]
    docs = spark.createDataFrame([(i, " ".join(rng.sample(plain, 60) + (rng.sample(bad, 4) if y else []))) for i, y in rows],
                                 "doc_id long, text string")
    got = toxicity.toxicity(docs, spark.createDataFrame(rows, "doc_id long, toxic int")).collect()
    toxic = dict(rows)
    pairs = [(r["score"], toxic[r["doc_id"]]) for r in got if r["held_out"]]
    assert len(pairs) == 80 and auc(pairs) > 0.85


def test_scores_of_words_are_exact(small):
    docs = small("documents", "sf0.01").select("doc_id", "text")
    labels = toxicity.sampled_labels(small("labels", "sf0.01"))
    model = toxicity.fit(docs, labels)
    sample = [(r["text"], r["toxic"]) for r in toxicity.examples(docs, labels).collect()]
    counts = [{}, {}, {}]
    for rows, kinds in ((((r["text"], None) for r in docs.collect()), (0,)), (sample, (1, 2))):
        for text, y in rows:
            own = {p for w in toxicity.alnum_words(text) for p in [b"=" + w, *(w[:k] for k in range(4, 11) if k < len(w))]}
            for p in own | ({b""} if own else set()):
                n = counts[kinds[0] if y is None else 1 if y else 2]
                n[p] = n.get(p, 0) + 1
    names = [b"", *sorted(counts[0].keys() - {b""})]
    odds = toxicity.drawn_odds(*(np.array([n.get(p, 0) for p in names], float) for n in counts))
    assert model.drawn == {p: x for p, x in zip(names, odds.tolist(), strict=True) if x} and len(model.drawn) > 20


def test_words_never_learnt_score_nothing(spark):
    rng = random.Random(3)
    plain = [f"plain{k}" for k in range(300)]
    bad = ["".join(rng.choice("abcdefgh") for _ in range(12)) for _ in range(10)]
    rows = [(i, " ".join(rng.sample(plain, 40) + (bad if i % 3 == 0 else []))) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows], "label_id long, toxic int")
    scores = toxicity.TokenScores(toxicity.fit(docs, labels).drawn)
    assert all(scores[w.encode()] > 1 for w in bad)
    strangers = [f"{rng.randrange(10**15):015d}".encode() for _ in range(100_000)]
    assert {scores[w] for w in strangers} == {round(-toxicity.DRIFT * toxicity.STEPS) / toxicity.STEPS}


def test_only_near_copies_are_merged(spark):
    rng = random.Random(4)

    def words(n):
        return [f"w{rng.randrange(10**6)}" for _ in range(n)]

    passage, base = words(60), words(200)
    alike = [" ".join(base[:100 + k] + [f"other{k}"] + base[101 + k:]) for k in range(20)]  # similarity 0.94 to each other
    shared = [" ".join(words(60) + passage + words(60)) for _ in range(60)]                 # 0.2, one passage
    apart = [" ".join(base[:100] + words(100))]                                             # 0.3 to the alike ones
    rows = [(t, 1) for t in [*alike, *shared, *apart, *["copy of one text"] * 9, "Copy of ONE text!"]] + [("copy of one text", 0)]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)], "label_id long, toxic int")
    got = toxicity.examples(docs, labels).collect()
    weights = {r["text"]: r["weight"] for r in got if r["toxic"]}
    assert set(shared) | set(apart) <= set(weights) and all(weights[t] == 1 for t in shared + apart)
    assert [weights[t] for t in alike if t in weights] == [20] and len(weights) == 63
    assert sorted(r["weight"] for r in got if r["text"].lower().startswith("copy of")) == [1, 10]
    assert sum(r["weight"] for r in got) == len(rows)


def test_merged_examples_of_documents(small):
    docs = small("documents", "sf0.01").select("doc_id", "text")
    labels = toxicity.sampled_labels(small("labels", "sf0.01"))
    got = toxicity.examples(docs, labels).collect()
    rows = docs.join(labels, docs["doc_id"] == labels["label_id"]).collect()
    sets = [(toxicity.shingles(toxicity.alnum_words(r["text"])), r["toxic"]) for r in rows]
    kept = [(toxicity.shingles(toxicity.alnum_words(r["text"])), r["toxic"]) for r in got]
    assert sum(r["weight"] for r in got) == len(rows) > len(got) > 0.5 * len(rows)
    for h, y in sets:  # all pairs: each document is like one that was kept, or linked to it through one that is
        assert any(y == z and toxicity.similarity(h, g) >= 0.6 for g, z in kept)
    assert not any(y == z and toxicity.similarity(h, g) >= 0.9 for (h, y), (g, z) in itertools.combinations(kept, 2))


def test_toxicity_edges(edge_docs, no_docs, edge_labels):
    got = toxicity.toxicity(edge_docs, edge_labels).collect()
    assert len(got) == len(texts()) and all(0 <= r["score"] <= 1 for r in got)
    for labels in (edge_labels.where("false"), edge_labels.where("toxic = 0")):
        scores = {r["score"] for r in toxicity.toxicity(edge_docs, labels).collect()}
        assert len(scores) == 1
    assert toxicity.toxicity(no_docs, edge_labels).count() == 0


def _invented(rng, letters, n):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(3, 8))) for _ in range(n))


def test_a_language_of_long_texts_only_is_learnt(spark):
    rng = random.Random(21)
    rows = [(i, "aa", _invented(rng, "abcde", 40)) for i in range(60)]
    rows += [(100 + i, "zz", _invented(rng, "vwxyz", 3500)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(3)
    sample = language_crf.training_rows(docs).collect()
    texts = {r[2] for r in rows}
    assert {r["lang"] for r in sample} == {"aa", "zz"}
    for r in sample:
        assert len(r["text"].encode()) <= language_crf.SAMPLE_BYTES
        assert any(f" {r['text']} " in f" {t} " for t in texts)          # whole words of one text
    got = {r["doc_id"]: r["lang_pred"] for r in language_crf.languages(docs).collect()}
    assert all(got[i] == lang for i, lang, _ in rows)


def test_repeated_rows_do_not_shrink_the_sample(spark):
    rng = random.Random(22)
    rows = [(4 * i + 1, "aa", _invented(rng, "abcde", 10)) for i in range(300)]
    one = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    many = one
    for k in range(1, 5):
        many = many.unionByName(one.withColumn("doc_id", F.col("doc_id") + 100_000 * k))
    many = many.unionByName(many)
    expected = {r["text"] for r in language_crf.training_rows(one).collect()}
    got = [r["text"] for r in language_crf.training_rows(many).collect()]
    assert len(got) == len(set(got)) == language_crf.SAMPLE and len(expected) == language_crf.SAMPLE


def test_the_sample_of_all_languages_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(language_crf, "SAMPLE_TOTAL", 12)
    rng = random.Random(23)
    rows = [(i, f"l{i % 5}", _invented(rng, "abcdefgh", 10)) for i in range(300)]
    rows += [(1000 + i, f"m{i}", _invented(rng, "abc", 10)) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    langs = [r["lang"] for r in language_crf.training_rows(docs).collect()]
    assert len(langs) == 12 and {f"l{k}" for k in range(5)} <= set(langs)
    assert len(language_crf.training_rows(docs.where("lang < 'm'")).collect()) == 10     # two of each of five


SOURCES = [("https://Host.A/x/y/z.html?q=1/2", "host.a", "host.a/x/y"), ("host.b/dir/p", "host.b", "host.b/dir"),
           ("host.b/dir/q", "host.b", "host.b/dir"), ("host.b/other/q", "host.b", "host.b/other"), ("src", "src", "src"),
           ("//host.a/x/k#part", "host.a", "host.a/x"), (None, "", "\0")]


def _strength(groups):
    """Pseudo-documents by moments of [(documents, sum of probabilities, rate they are drawn to)]."""
    groups = [(n, good / n, t) for n, good, t in groups if n > 1]
    total = sum(n for n, _, _ in groups)
    spread = sum(n * t * (1 - t) for n, _, t in groups)
    if not total or not spread:
        return site_bayes.STRONGEST
    between = (sum(n * (m - t) ** 2 for n, m, t in groups) - sum(t * (1 - t) for _, _, t in groups)) / total
    if between <= 0:
        return site_bayes.STRONGEST
    return min(site_bayes.STRONGEST, max(site_bayes.WEAKEST, spread / total / between - 1))


def test_site_rates_strengths_and_scores_against_brute_force(small):
    """From the text scores on: rates of sites and paths, both strengths, and each score without the document itself."""
    pick = F.lit(None).cast("string")
    for k, (source, _, _) in enumerate(SOURCES):
        pick = F.when(F.pmod(F.xxhash64("doc_id"), F.lit(len(SOURCES))) == k, F.lit(source).cast("string")).otherwise(pick)
    docs = small("documents", "sf0.01").withColumn("source", pick).cache()
    labels = small("labels", "sf0.01")
    place = {s: (site, path) for s, site, path in SOURCES}
    where = {r["doc_id"]: place[r["source"]] for r in docs.collect()}
    got = {r["doc_id"]: r for r in site_bayes.site_quality(docs, labels).collect()}
    assert got.keys() == where.keys()
    sites, paths = {}, {}
    for i, r in got.items():
        for table, key in ((sites, where[i][0]), (paths, where[i])):
            n, good = table.get(key, (0, 0.0))
            table[key] = n + 1, good + r["text_score"]
    n, good = len(got), sum(r["text_score"] for r in got.values())
    rate = good / n
    k_site = _strength([(a, b, rate) for a, b in sites.values()])
    site_rate = {s: (b + k_site * rate) / (a + k_site) for s, (a, b) in sites.items()}
    k_path = _strength([(a, b, site_rate[s]) for (s, _), (a, b) in paths.items()])
    known = {}
    for r in labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").collect():
        if not held_out(r["doc_id"]):
            known[r["doc_id"]] = min(known.get(r["doc_id"], 1), int(r["quality"] > 0))
    known = [v for i, v in known.items() if i in got]
    sample = math.log(sum(known) / (len(known) - sum(known)))
    odds = lambda p: math.log(min(max(p, 1e-6), 1 - 1e-6)) - math.log(1 - min(max(p, 1e-6), 1 - 1e-6))
    for i, r in got.items():
        site, path = where[i]
        a, b = paths[site, path]
        t, p = site_rate[site], r["text_score"]
        score = 1 / (1 + math.exp(-(odds(p) - sample + odds((b - p + k_path * t) / (a - 1 + k_path)))))
        assert math.isclose(r["site_rate"], t, rel_tol=1e-9)
        assert math.isclose(r["path_rate"], (b + k_path * t) / (a + k_path), rel_tol=1e-9)
        assert math.isclose(r["score"], score, rel_tol=1e-9) and r["kept"] == (r["score"] >= site_bayes.KEEP_AT)
