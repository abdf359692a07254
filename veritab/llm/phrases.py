"""Operator 12: collocations by SON partitioning: mine shards, then count globally.

Texts are cut into pieces at ``.,;:!?`` and line ends; a phrase is a run of 2 to 4 words of a piece. Everything is per
language.

1. The documents are dealt into ``SHARDS`` shards by a hash of id and text. A shard is no task: any number of tasks count
   their part of it, and the counts are added up by hash of the run. Each shard is mined completely, level by level (words,
   pairs, longer runs): a run is counted where the shard holds all its words, then all its pairs, often enough. The local
   support is the global one times the shard's share of the words: ``count * words(language) >= support * words(shard,
   language)``. A phrase that is frequent in the language reaches this in at least one shard.
2. The locally frequent phrases of all shards are united. A phrase whose counts where it is frequent, and one less than the
   local support everywhere else, do not add up to the support is left out. What is left are candidates only, so 64-bit
   hashes of them are enough, and they go to the tasks as bit maps of at most ``MOST_BITS`` bits (32 MB): a stranger that
   hits the map by chance is counted like a candidate and changes nothing.
3. A second pass over the texts counts the words and phrases of every candidate exactly, by their strings.
4. Scores, the removal of phrases covered by longer ones and the ranking are joins and windows over the frequent phrases;
   products are decimals of 38 places.

Counts are pre-aggregated in each slice, so a word or phrase of any frequency is one small row a slice.

Memory: a task works on slices of ``SLICE`` bytes; longer texts are cut between pieces (a piece longer than a slice is one
slice of its own). Counts are added up in partitions that stand for ``PART_BYTES`` of text, by hash, so at most one row for
each of their words. Recovery: counts of each level are written to the shared folder.

Cases: null and empty texts have no words; a null language is ``und`` and is one with the language of that name; repeated
rows count as often as they come; equal scores go by count, then by phrase in byte order; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ship_package, written
from .wordruns import BREAK, KeySet, byte_table, chunks, mix, word_runs

SUPPORT = 30
LONGEST = 4
SHARDS = 4
TOP = 2000
COVERED = (80, 100)
#: Text bytes of a slice.
SLICE = 4 << 20
#: Text bytes whose counts meet in one partition.
PART_BYTES = 24 << 20
#: Counts of words that a task gathers before it hands them on.
GATHER = 1 << 19
#: Counts of phrases, which are strings, that a task gathers before it hands them on.
GATHER_PHRASES = 1 << 18
#: Languages (and shards) whose local support goes to the tasks; in any others every run is a candidate.
MOST_GROUPS = 500_000
#: The number of a group is a multiple of this, from its language, plus its shard.
GROUP_STEP = 64
#: Largest bit map of candidates, 8 bits a candidate below that.
MOST_BITS = 1 << 28
KIND, LOWER = byte_table(b" \t", b".,;:!?\n\x0b\x0c\r")
_STEP = np.uint64(0xD6E8FEB86659FD93)
#: Rows of the ranking that one window task orders at the first level.
RANK_ROWS = 500_000


def key_set(keys: DataFrame, column: str = "key") -> KeySet:
    """The bit map of a column of 64-bit keys: bits are united in Spark, the driver gets at most MOST_BITS / 64 numbers."""
    n = keys.count()
    bits = 1 << 16
    while bits < 8 * n and bits < MOST_BITS:
        bits *= 2
    places = keys.select(F.explode(F.array(F.col(column), F.shiftrightunsigned(F.col(column), 32))).alias("p")).select(
        F.col("p").bitwiseAND(F.lit(bits - 1)).alias("p"))
    one = F.expr("shiftleft(1L, cast(p & 63 AS int))")
    packed = places.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(one).alias("b")).toArrow()
    words = np.zeros(bits // 64, np.uint64)
    words[packed.column("w").to_numpy()] = packed.column("b").to_numpy().view(np.uint64)
    return KeySet(words)


class Runs:
    """The runs of words of one slice: ``keys(n)`` are the hashes of all runs of n words in a piece, at the place of their
    first word, with the language mixed in."""

    def __init__(self, texts: pa.Array, langs: np.ndarray, lang_names: list[str]):
        got = word_runs(texts, KIND, LOWER)
        self.row, self.n = got.row, len(got.words)
        codes = got.words.dictionary_encode()
        self.words = codes.dictionary
        self.ids = codes.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, self.words.to_pylist()), np.uint64, len(self.words))
        salt = np.array([xxhash.xxh64_intdigest(x, 1) for x in lang_names], np.uint64)
        with np.errstate(over="ignore"):
            self.levels = [mix(hashes[self.ids] + salt[langs[self.row]]) if self.n else np.zeros(0, np.uint64)]
        self.room = self._room(got.first)

    def _room(self, first: np.ndarray) -> np.ndarray:
        """Words from each one to the end of its piece, itself included."""
        if not self.n:
            return np.zeros(0, np.int64)
        ends = np.append(np.flatnonzero(first)[1:], self.n)
        return ends[np.cumsum(first) - 1] - np.arange(self.n)

    def keys(self, n: int) -> np.ndarray:
        """Keys of the runs of n words from every place (meaningless where the piece ends before)."""
        while len(self.levels) < n:
            tail = np.zeros(self.n, np.uint64)
            tail[:max(0, self.n - len(self.levels))] = self.levels[0][len(self.levels):]
            with np.errstate(over="ignore"):
                self.levels.append(mix(self.levels[-1] * _STEP + tail))
        return self.levels[n - 1]

    def places(self, n: int) -> np.ndarray:
        return np.flatnonzero(self.room >= n)

    def all_of(self, good: np.ndarray, n: int, width: int) -> np.ndarray:
        """Places of runs of n words all of whose runs of ``width`` words are marked in ``good``."""
        at = self.places(n)
        for step in range(n - width + 1):
            at = at[good[at + step]]
        return at


def _rows(batch: pa.RecordBatch):
    """(runs, language number of each row, their batch rows, names of the languages) of the bounded slices of a batch."""
    codes = batch.column("lang").dictionary_encode()
    names, langs = codes.dictionary.to_pylist(), codes.indices.to_numpy(zero_copy_only=False)
    for rows, texts in chunks(batch.column("text"), KIND, SLICE, BREAK):
        runs = Runs(texts, langs[rows], names)
        if runs.n:
            yield runs, langs[rows], rows, names


def shard_keys(keys: np.ndarray, shards: np.ndarray, back: bool = False) -> np.ndarray:
    """Keys with the shard mixed in, or taken out again."""
    with np.errstate(over="ignore"):
        step = (shards.astype(np.uint64) + np.uint64(1)) * np.uint64(0x2545F4914F6CDD1D)
        return keys - step if back else keys + step


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of the keys by value, and where in it each distinct key starts."""
    order = np.argsort(keys)
    held = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = held[1:] != held[:-1]
    return order, np.flatnonzero(new)


def added(at: np.ndarray, group: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, ...]:
    """The distinct keys, their groups, and the sums of their counts."""
    order, start = distinct(at)
    total = np.add.reduceat(c[order], start) if len(start) else c
    one = order[start]
    return at[one], group[one], total


def local_counts(docs: DataFrame, sizes: tuple[int, ...], known: KeySet | None, parts: int,
                 least: dict[int, tuple[int, int]] | None = None) -> DataFrame:
    """at, key, grp, c, over, slack: counts of the runs of the given sizes in each shard (``at``: key and shard; ``grp``:
    language and shard). ``known`` holds the keys ``at`` of the shard's frequent runs of one word (for pairs) or two words
    (for longer runs). With ``least``, the local support of the groups and what all shards of the language may hold
    unseen (``slack``), only locally frequent runs are left, and ``over`` is what they hold beyond that."""
    sc = docs.sparkSession.sparkContext
    share = sc.broadcast((known.words if known else None, least))
    names = ["at", "grp", "c"]

    def rows(at, group, c):
        return pa.RecordBatch.from_arrays([pa.array(at.view(np.int64)), pa.array(group), pa.array(c)], names=names)

    def count(batches):
        known = share.value[0]
        known = None if known is None else KeySet(known)
        width = min(sizes) - 1 if known else 0
        held, size = [], 0
        for batch in batches:
            shards, groups = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "grp"))
            for runs, _, at_rows, _ in _rows(batch):
                row = at_rows[runs.row]
                good = known.holds(shard_keys(runs.keys(width), shards[row])) if known else None
                for n in sizes:
                    at = runs.all_of(good, n, width) if known else runs.places(n)
                    keys = shard_keys(runs.keys(n)[at], shards[row[at]])
                    order, start = distinct(keys)
                    one = order[start]
                    found = keys[one], groups[row[at[one]]], np.diff(start, append=len(keys))
                    if known:
                        yield rows(*found)
                    else:
                        held.append(found)
                        size += len(one)
                if size > GATHER:
                    yield rows(*added(*(np.concatenate(x) for x in zip(*held, strict=True))))
                    held, size = [], 0
        if held:
            yield rows(*added(*(np.concatenate(x) for x in zip(*held, strict=True))))

    def add(batches):
        least = share.value[1]
        got = [[b.column(c).to_numpy(zero_copy_only=False) for c in names] for b in batches if b.num_rows]
        if not got:
            return
        at, group, c = added(*(np.concatenate(x) for x in zip(*got, strict=True)))
        del got
        over, slack = c, np.zeros(len(c), np.int64)
        if least is not None:
            groups, place = np.unique(group, return_inverse=True)
            bounds = np.array([least.get(g, (1, 1 << 60)) for g in groups.tolist()], np.int64).reshape(-1, 2)
            over, slack = c - bounds[place, 0] + 1, bounds[place, 1]
            at, group, c, over, slack = (x[over > 0] for x in (at, group, c, over, slack))
        key = shard_keys(at.view(np.uint64), group % GROUP_STEP, back=True).view(np.int64)
        yield pa.RecordBatch.from_arrays(list(map(pa.array, (at, key, group, c, over, slack))),
                                         names=["at", "key", "grp", "c", "over", "slack"])
    counted = docs.mapInArrow(count, "at long, grp long, c long").repartition(parts, "at")
    return counted.mapInArrow(add, "at long, key long, grp long, c long, over long, slack long")


def candidates_of(counts: DataFrame, support: int) -> DataFrame:
    """key, at: the locally frequent runs whose counts may add up to the support, and the keys of their shards."""
    return counts.groupBy("key").agg(
        (F.sum("over") + F.max("slack")).alias("most"), F.collect_set("at").alias("at")).where(F.col("most") >= support).drop("most")


def global_counts(docs: DataFrame, candidates: KeySet, support: int) -> DataFrame:
    """lang, n, phrase, f: the exact number of every word and phrase that occurs ``support`` times or more."""
    share = docs.sparkSession.sparkContext.broadcast(candidates.words)

    def gathered(parts):
        return pa.concat_tables(parts).group_by(["lang", "phrase"]).aggregate([("f", "sum")]).rename_columns(
            ["lang", "phrase", "f"]).to_batches(max_chunksize=100_000)

    def run(batches):
        known, held = KeySet(share.value), []
        for batch in batches:
            for runs, langs, _, names in _rows(batch):
                if sum(map(len, held)) > GATHER_PHRASES:
                    yield from gathered(held)
                    held = []
                here = langs[runs.row].astype(np.int64)
                ids, wide = runs.ids, max(len(runs.words), 1)
                code, words = here * wide + ids, runs.words.cast(pa.large_string())
                for n in range(1, LONGEST + 1):
                    at = runs.places(n)
                    at = at[(code[at] >= 0) & known.holds(runs.keys(n)[at])]
                    order, start = distinct(code[at])
                    where, c = at[order[start]], np.diff(start, append=len(at))
                    place = np.zeros(len(at), np.int64)
                    place[order] = np.repeat(np.arange(len(start)), c)
                    parts = [words.take(pa.array(ids[where + i])) for i in range(n)]
                    phrase = pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string())) if n > 1 else parts[0]
                    lang = pa.DictionaryArray.from_arrays(pa.array(here[where], pa.int32()), pa.array(names, pa.string()))
                    held.append(pa.table({"lang": lang.cast(pa.string()), "phrase": phrase.cast(pa.string()), "f": c}))
                    # the exact number of a longer run: that of the run without its last word, and that word. A frequent
                    # run starts with a frequent one, so all others go without a number
                    on = runs.room[at] > n
                    code = np.full(runs.n, -1, np.int64)
                    code[at[on]] = place[on] * wide + ids[at[on] + n]
        if held:
            yield from gathered(held)
    counts = docs.mapInArrow(run, "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
    return counts.where(F.col("f") >= support).select("lang", F.size(F.split("phrase", " ")).alias("n"), "phrase", "f")


def frequent(docs: DataFrame, support: int = SUPPORT, id_col: str = "doc_id", text_col: str = "text",
             lang_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """(lang, n, phrase, f) of every frequent word and phrase, and (lang, n) with the number of words of a language."""
    ship_package(docs.sparkSession)
    text, lang = F.coalesce(F.col(f"`{text_col}`"), F.lit("")), F.coalesce(F.col(f"`{lang_col}`"), F.lit("und"))
    rows = docs.select(lang.alias("lang"), text.alias("text"), F.pmod(
        F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")), F.lit(SHARDS)).cast("int").alias("shard"))
    rows = rows.withColumn("grp", F.xxhash64("lang").bitwiseAND(F.lit(-GROUP_STEP)) + F.col("shard"))
    named = rows.groupBy("lang", "shard", "grp").agg(F.sum(F.octet_length("text")).alias("bytes"))
    named = written(named, "phrase-groups")
    parts = max(1, -(-(named.agg(F.sum("bytes")).first()[0] or 0) // PART_BYTES))
    words = written(local_counts(rows, (1,), None, parts), "phrase-words")
    sizes = written(named.join(words.groupBy("grp").agg(F.sum("c").alias("shard_n")), "grp"), "phrase-sizes")
    langs = sizes.groupBy("lang").agg(F.sum("shard_n").alias("n"))
    least = local_supports(sizes.join(langs, "lang"), support)
    bounds = docs.sparkSession.createDataFrame([(g, a, b) for g, (a, b) in least.items()], "grp long, least long, slack long")
    words = words.select("at", "key", "grp", "c").join(F.broadcast(bounds), "grp", "left").select(
        "at", "key", (F.col("c") - F.coalesce("least", F.lit(1)) + 1).alias("over"),
        F.coalesce("slack", F.lit(1 << 60)).alias("slack")).where("over > 0")
    found = written(candidates_of(words, support), "phrase-level1")
    levels = [found]
    for sizes in ((2,), tuple(range(3, LONGEST + 1))):
        known = key_set(found.select(F.explode("at").alias("key")))
        found = written(candidates_of(local_counts(rows, sizes, known, parts, least), support), f"phrase-level{sizes[0]}")
        levels.append(found)
    known = key_set(functools.reduce(DataFrame.unionByName, levels).select("key"))
    return written(global_counts(rows, known, support), "phrase-counts"), langs


def local_supports(sizes: DataFrame, support: int) -> dict[int, tuple[int, int]]:
    """grp: (least count in the shard, the sum over the language's shards of one less than that), largest groups first."""
    least = F.expr(f"(cast(shard_n AS decimal(19,0)) * {support} + n - 1) div n")
    bounds = sizes.select("lang", "grp", "shard_n", least.cast("long").alias("least"))
    slack = bounds.groupBy("lang").agg(F.sum(F.col("least") - 1).alias("slack"))
    rows = bounds.join(slack, "lang").orderBy(F.col("shard_n").desc(), "grp").limit(MOST_GROUPS).collect()
    return {r["grp"]: (r["least"], r["slack"]) for r in rows}


def _whole(c: str) -> Column:
    return F.col(c).cast("decimal(19,0)")


def scored(counts: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, score of the frequent phrases of two words or more: their lowest-scoring cut."""
    cand = counts.where("n >= 2").select("lang", "phrase", F.col("f").alias("a"), "n", F.split("phrase", " ").alias("w"))
    cuts = cand.select("lang", "phrase", "a", "n", "w", F.explode(F.sequence(F.lit(1), F.col("n") - 1)).alias("k")).select(
        "lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("left"),
        F.array_join(F.slice("w", F.col("k") + 1, F.col("n") - F.col("k")), " ").alias("right"))
    for side, name in (("left", "l"), ("right", "r")):
        part = counts.select("lang", F.col("phrase").alias(side), F.col("f").alias(name))
        cuts = cuts.join(part, ["lang", side])
    cuts = cuts.select("*", _whole("a").alias("da"), (_whole("l") + _whole("r")).alias("parts"))
    score = F.expr("cast((da * 2000000BD) div parts AS bigint)")
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("best"))
    return best.select("lang", "phrase", "a", "best.l", "best.r", "best.score")


def covered(counts: DataFrame) -> DataFrame:
    """lang, phrase, longer: the largest count of a longer frequent phrase that holds the phrase."""
    long = counts.where("n >= 3").select("lang", "n", "f", F.split("phrase", " ").alias("w"))
    runs = long.select("lang", "n", "f", "w", F.explode(F.sequence(F.lit(2), F.col("n") - 1)).alias("size")).select(
        "lang", "f", "w", "size", F.explode(F.sequence(F.lit(1), F.col("n") - F.col("size") + 1)).alias("at"))
    return runs.groupBy("lang", F.array_join(F.slice("w", F.col("at"), F.col("size")), " ").alias("phrase")).agg(
        F.max("f").alias("longer"))


def ranked(scores: DataFrame, top: int) -> DataFrame:
    """The first ``top`` rows of each language with their rank, ordered in two levels."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    salts = max(1, -(-scores.count() // RANK_ROWS))
    first = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(salts))).orderBy(*order)
    some = scores.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= top)
    last = Window.partitionBy("lang").orderBy(*order)
    return some.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= top)


def collocations(docs: DataFrame, support: int = SUPPORT, top: int = TOP, id_col: str = "doc_id", text_col: str = "text",
                 lang_col: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best phrases of each language."""
    counts, langs = frequent(docs, support, id_col, text_col, lang_col)
    part, whole = COVERED
    left = scored(counts).join(covered(counts), ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (_whole("longer") * whole < _whole("a") * part)).drop("longer")
    rows = ranked(written(left, "phrase-scores"), top)
    return rows.join(langs, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
