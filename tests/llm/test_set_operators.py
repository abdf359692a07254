"""Operators 6, 7 and 9 against brute force, and their edge cases."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from veritab.llm import external_shuffle, packing, simhash_pivots

from .conftest import texts
from .test_text_operators import LOWER, SPACE


# -- external shuffle ------------------------------------------------------------------------------------------------
def test_fisher_yates_is_a_uniform_permutation():
    rng = np.random.default_rng(1)
    seen = Counter(tuple(external_shuffle.fisher_yates(3, rng).tolist()) for _ in range(6000))
    assert len(seen) == 6 and min(seen.values()) > 850
    assert external_shuffle.fisher_yates(0, rng).tolist() == [] and external_shuffle.fisher_yates(1, rng).tolist() == [0]


@pytest.mark.parametrize("which", ["edge", "table"])
def test_external_shuffle_law(which, edge_docs, small):
    docs = edge_docs if which == "edge" else small("documents")
    source = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = external_shuffle.digest(external_shuffle.external_shuffle(docs, bucket_bytes=40_000)).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in source)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert sorted(slots) == list(range(16)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert {(r["law"], r["grown_shard"]) for r in got} == {("rows", None)}


def test_external_shuffle_repeats_and_empties(small, no_docs, tmp_path, spark):
    a, b = (sorted(tuple(r) for r in external_shuffle.digest(external_shuffle.external_shuffle(small("documents"))).collect())
            for _ in range(2))
    assert a == b
    assert external_shuffle.external_shuffle(no_docs).count() == 0
    external_shuffle.write_shards(external_shuffle.external_shuffle(small("documents"), shards=3), str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert sorted(r["text"] or "" for r in back.collect()) == sorted(r["text"] or "" for r in small("documents").collect())


@pytest.mark.parametrize("n", [1, 15, 16, 17, 1_000, 10_000_001, 32_000_000])
def test_shards_of_many_places(spark, n):
    shard, slot = external_shuffle.shard_and_slot("id", n, 16)
    got = spark.range(n).select("id", shard.alias("shard"), slot.alias("slot")).groupBy("shard").agg(
        F.count("*").alias("n"), F.min("id").alias("first"), F.max("id").alias("last"), F.min("slot").alias("least"),
        F.max("slot").alias("most"), F.countDistinct(F.col("id") - F.col("slot")).alias("starts")).collect()
    first = [-(-s * n // 16) for s in range(17)]
    expected = {(s, first[s + 1] - first[s], first[s], first[s + 1] - 1, 0, first[s + 1] - first[s] - 1, 1)
                for s in range(16) if first[s] < first[s + 1]}
    assert {tuple(r) for r in got} == expected


def test_shards_of_very_many_places(spark):
    n = 10**15 + 7
    first = [-(-s * n // 16) for s in range(17)]
    edges = [(x,) for s in range(17) for x in (first[s] - 1, first[s], first[s] + 1) if 0 <= x < n]
    shard, slot = external_shuffle.shard_and_slot("at", n, 16)
    for at, s, k in spark.createDataFrame(edges, "at long").select("at", shard, slot).collect():
        assert first[s] <= at < first[s + 1] and k == at - first[s]


# -- packing ---------------------------------------------------------------------------------------------------------
def fewest(items, capacity):
    """The optimum by search over bins."""
    items = sorted(items, reverse=True)
    best = len(items)

    def put(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(items):
            best = len(rooms)
            return
        for i in {r: i for i, r in enumerate(rooms) if r >= items[k]}.values():
            put(k + 1, [*rooms[:i], rooms[i] - items[k], *rooms[i + 1:]])
        put(k + 1, [*rooms, capacity - items[k]])

    put(0, [])
    return best


def test_reduction_keeps_the_optimum():
    rng = random.Random(5)
    fixed_some = 0
    for _ in range(250):
        items = [rng.randint(rng.choice((1, 4, 9)), 20) for _ in range(rng.randint(1, 10))]
        fixed, left = packing.reduced(dict(Counter(items)), 20)
        rest = [x for x, n in left.items() for _ in range(n)]
        used = Counter(x for p, n in fixed.items() for x in p for _ in range(n))
        assert used + Counter(rest) == Counter(items) and all(sum(p) <= 20 for p in fixed)
        assert sum(fixed.values()) + (fewest(rest, 20) if rest else 0) == fewest(items, 20)
        fixed_some += bool(fixed)
    assert fixed_some > 100


def test_plan_uses_everything_once():
    rng = random.Random(6)
    for _ in range(100):
        counts = {rng.randint(1, 100): rng.randint(1, 40) for _ in range(rng.randint(1, 30))}
        patterns = packing.plan(counts, 100)
        assert all(sum(p) <= 100 for p, _ in patterns)
        assert Counter(x for p, n in patterns for x in p for _ in range(n)) == Counter(counts)
        total = sum(k * n for k, n in counts.items())
        assert sum(n for _, n in patterns) <= max(-(-total // 100) + 1, 1.3 * total / 100 + sum(n for k, n in counts.items() if k > 50))


@pytest.fixture(scope="module")
def byte_tokenizer():
    return Tokenizer.from_file(public_tokenizers.path(packing.DEFAULT_FILE))


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [0]


def test_encoder_equals_the_library(byte_tokenizer):
    rng = random.Random(7)
    items = [t for _, t in texts()] + [
        "".join(rng.choice("abcstrevlLm'' \n \t!?.09éß日😀_ <|endoftext|>") for _ in range(rng.randint(1, 60)))
        for _ in range(800)] + ["<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext|>"]
    got = packing.encoder(public_tokenizers.path(packing.DEFAULT_FILE)).encode(items)
    assert [g.tolist() for g in got] == [ids_of(byte_tokenizer, t) for t in items]


@pytest.mark.parametrize("which", ["edge", "table"])
def test_packing(which, edge_docs, small, byte_tokenizer):
    docs = edge_docs if which == "edge" else small("documents")
    expected = Counter()
    for r in docs.collect():
        ids, at, k = ids_of(byte_tokenizer, r["text"]), 0, 0
        while at < len(ids):
            size = (len(ids) - at) % 2048 or 2048
            expected[r["doc_id"], k, at, size, zlib.crc32(np.array(ids[at:at + size], "<u4").tobytes())] += 1
            at, k = at + size, k + 1
    got = packing.packed(docs).collect()
    assert Counter(tuple(r)[:5] for r in got) == expected
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in bins.values():
        places.sort()
        assert [o for o, _ in places] == [sum(n for _, n in places[:k]) for k in range(len(places))]
        assert sum(n for _, n in places) <= 2048
    assert len(bins) <= -(-sum(r["length"] for r in got) // 2048) + 3


def test_packing_nothing(no_docs):
    assert packing.packed(no_docs).count() == 0


# -- simhash ---------------------------------------------------------------------------------------------------------
def fingerprint_brute(text):
    words = SPACE.findall((text or "").translate(LOWER))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum((2 * n > len(shingles)) << b for b, n in enumerate(ones))


def classes_brute(values):
    """Smallest index of each value's component."""
    parent = list(range(len(values)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, x in enumerate(values):
        for j in range(i):
            if (x ^ values[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def test_near_duplicates(edge_docs, small, no_docs):
    for docs in (edge_docs.where("doc_id is not null"), small("documents")):
        source = [(r["doc_id"], r["text"]) for r in docs.collect()]
        values = [fingerprint_brute(t) for _, t in source]
        least = defaultdict(list)
        for root, (i, _) in zip(classes_brute(values), source, strict=True):
            least[root].append(i)
        expected = Counter((i, f"{v:016x}", min(least[root])) for (i, _), v, root in zip(
            source, values, classes_brute(values), strict=True))
        assert Counter(tuple(r) for r in simhash_pivots.near_duplicates(docs).collect()) == expected
    assert simhash_pivots.near_duplicates(no_docs).count() == 0


@pytest.mark.parametrize("limit", [2, 24])
def test_links_lose_no_component(spark, monkeypatch, limit):
    monkeypatch.setattr(simhash_pivots, "PAIR_LIMIT", limit)
    rng = random.Random(8)
    values = []
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(rng.choice((1, 5, 40))):
            values.append(x)
            for _ in range(rng.randint(0, 3)):
                x ^= 1 << rng.randrange(64)
    values += [0, 1, 3, 1 << 63, (1 << 63) | 1]
    values = sorted(set(values))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    fps = spark.createDataFrame([(i, f) for i, f in enumerate(signed)], "doc_id long, fp long")
    got = {r["fp"]: r["component_id"] for r in simhash_pivots.class_ids(fps).collect()}
    assert [got[f] for f in signed] == classes_brute(values)


def test_one_of_each(edge_docs, no_docs, small):
    kept = simhash_pivots.one_of_each(edge_docs)
    assert kept.columns == edge_docs.columns
    ids = Counter(r["doc_id"] for r in kept.collect())
    assert max(ids.values()) == 1 and ids[5] == ids[9] == 1 and ids[2] == 1 and 3 not in ids and 4 not in ids
    assert simhash_pivots.one_of_each(no_docs).count() == 0
    docs = small("documents")
    best = {r["component_id"] for r in simhash_pivots.near_duplicates(docs).collect()}
    assert {r["doc_id"] for r in simhash_pivots.one_of_each(docs).collect()} == best
