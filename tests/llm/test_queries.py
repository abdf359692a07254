"""The registered queries: names, columns and types that they promise."""

import __spark_entry__

PROMISED = {
    "op1_license_scan": "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, "
                        "labels string, score double",
    "op2_quality_rules": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
                         "n_repeat_words bigint, base_failed boolean, kept boolean",
    "op3_token_counts": "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean",
    "op4_language_crf": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op5_site_bayes": "doc_id bigint, held_out boolean, score double, kept boolean",
    "op6_external_shuffle": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op7_packing": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    "op8_decontamination": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
    "op9_simhash_pivots": "doc_id bigint, fingerprint string, component_id bigint",
    "op10_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op11_personal_data": "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, "
                          "spans string",
    "op12_collocations": "lang string, rank bigint, phrase string, a bigint, l bigint, r bigint, n bigint, score bigint",
    "op13_lexical_search": "item_id bigint, rank int, doc_id bigint, score bigint",
}


def test_queries_keep_their_promise(spark):
    queries = __spark_entry__.queries()
    assert set(PROMISED) | {"pipeline"} <= set(queries) and "op8_decontamination" in __spark_entry__.oracle_sql()
    for name, columns in PROMISED.items():
        out = queries[name](spark, "/root/testdata/sf0.001")
        kinds = dict(out.dtypes)
        assert {c.split()[0]: c.split()[1] for c in columns.split(", ")}.items() <= kinds.items(), name
