"""The registered queries of the operators, with their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (decontaminate, external_shuffle, language_crf, license_scan, packing, personal_data, phrases, quality_votes,
               shared_search, simhash_pivots, site_bayes, token_count, toxicity)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@register("op1_license_scan")
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(table(spark, sf_dir, "documents")).drop("detections")


@register("op2_quality_rules")
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_votes.quality_rules(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


@register("op3_token_counts")
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(table(spark, sf_dir, "documents"))


@register("op8_decontamination", """
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words
  FROM documents),
item AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words
  FROM benchmark),
win AS (
  SELECT DISTINCT item, least(len(words), 10) AS n,
         array_to_string(list_slice(words, s, s + least(len(words), 10) - 1), ' ') AS win
  FROM (SELECT item, words, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS s FROM item WHERE len(words) > 0)),
place AS (
  SELECT r, n, s, array_to_string(list_slice(words, s, s + n - 1), ' ') AS win
  FROM (SELECT r, words, n, unnest(range(1, len(words) - n + 2)) AS s
        FROM doc, (SELECT DISTINCT n FROM win) WHERE len(words) >= n)),
hit AS (SELECT r, place.n, s, item FROM place JOIN win ON place.n = win.n AND place.win = win.win),
hits AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM hit) GROUP BY r),
items AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hits USING (r) LEFT JOIN items USING (r)
""")
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontaminate.digest(found)


@register("op9_simhash_pivots")
def op9_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_pivots.near_duplicates(table(spark, sf_dir, "documents"))


@register("op6_external_shuffle")
def op6_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return external_shuffle.digest(external_shuffle.external_shuffle(table(spark, sf_dir, "documents")))


@register("op7_packing")
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


@register("op4_language_crf")
def op4_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_crf.languages(table(spark, sf_dir, "documents"))


@register("op10_toxicity")
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return toxicity.toxicity(docs, labels).drop("passages")


@register("op5_site_bayes")
def op5_site_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_bayes.site_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register("op11_personal_data")
def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.digest(personal_data.personal_data(table(spark, sf_dir, "documents")))


@register("op12_collocations", r"""
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM piece),
total AS (SELECT lang, sum(len(w)) AS n FROM words GROUP BY lang),
run AS (
  SELECT lang, size, array_to_string(list_slice(w, s, s + size - 1), ' ') AS phrase
  FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS s
        FROM words, (SELECT unnest([1, 2, 3, 4]) AS size) WHERE len(w) >= size)),
freq AS (SELECT lang, size, phrase, count(*) AS f FROM run GROUP BY ALL HAVING count(*) >= 30),
cand AS (SELECT lang, size, phrase, f, string_split(phrase, ' ') AS w FROM freq WHERE size >= 2),
cut AS (
  SELECT cand.lang, cand.phrase, cand.f AS a, k, x.f AS l, y.f AS r,
         (CAST(2000000 AS HUGEINT) * cand.f) // (x.f + y.f) AS score
  FROM (SELECT *, unnest(range(1, size)) AS k FROM cand) AS cand
  JOIN freq AS x ON x.lang = cand.lang AND x.phrase = array_to_string(list_slice(cand.w, 1, k), ' ')
  JOIN freq AS y ON y.lang = cand.lang AND y.phrase = array_to_string(list_slice(cand.w, k + 1, cand.size), ' ')),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_run AS (
  SELECT lang, f, array_to_string(list_slice(w, s, s + size2 - 1), ' ') AS phrase
  FROM (SELECT lang, f, w, size2, unnest(range(1, size - size2 + 2)) AS s
        FROM (SELECT *, unnest(range(2, size)) AS size2 FROM cand WHERE size >= 3))),
longer AS (SELECT lang, phrase, max(f) AS f FROM inner_run GROUP BY ALL),
kept AS (
  SELECT best.* FROM best LEFT JOIN longer ON longer.lang = best.lang AND longer.phrase = best.phrase
  WHERE longer.f IS NULL OR CAST(100 AS HUGEINT) * longer.f < CAST(80 AS HUGEINT) * best.a),
place AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
SELECT place.lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM place JOIN total ON total.lang = place.lang WHERE rank <= 2000
""")
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


@register("op13_lexical_search", r"""
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents),
item AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
corpus AS (SELECT count(*) AS n_docs, CAST(sum(len(words)) AS BIGINT) AS n_terms FROM doc WHERE len(words) > 0),
posting AS (
  SELECT r, doc_id, n, term, count(*) AS tf
  FROM (SELECT r, doc_id, CAST(len(words) AS BIGINT) AS n, unnest(words) AS term FROM doc)
  WHERE term IN (SELECT term FROM item) GROUP BY ALL),
weight AS (
  SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM posting GROUP BY term), corpus),
part AS (
  SELECT r, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * n_docs) // n_terms))) AS v
  FROM posting JOIN weight USING (term), corpus),
score AS (
  SELECT item_id, r, doc_id, CAST(sum(v) AS BIGINT) AS score FROM item JOIN part USING (term) GROUP BY ALL),
place AS (
  SELECT item_id, doc_id, score,
         row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id ASC NULLS LAST) AS rank
  FROM score WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM place WHERE rank <= 10
""")
def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
