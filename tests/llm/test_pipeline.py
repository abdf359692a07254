"""The pipeline's stages, one after another, against their operators and brute force."""

import corpus_pipeline
from veritab.llm import decontaminate, packing, quality_votes, simhash_pivots
from veritab.llm.common import remove, scratch, written


def test_stages(spark, small):
    sf_dir = "/root/testdata/sf0.001"
    docs = small("documents")
    columns, kept = docs.columns, [docs.count()]
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "language_id", "near_dedup", "decontamination", "best_fit_packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = written(stage(spark, before, sf_dir), name)
        assert docs.columns == columns and docs.schema == before.schema
        assert docs.exceptAll(before).count() == 0
        if name == "quality_rules":
            expected = {r["doc_id"] for r in quality_votes.quality_rules(before).where("kept").collect()}
        elif name == "language_id":
            expected = {r["doc_id"] for r in before.collect()}       # all of these have a language
        elif name == "near_dedup":
            expected = {r["component_id"] for r in simhash_pivots.near_duplicates(before).collect()}
        else:
            found = decontaminate.digest(decontaminate.contaminated(before, small("benchmark")))
            expected = {r["doc_id"] for r in found.where("not contaminated").collect()}
        assert {r["doc_id"] for r in docs.collect()} == expected
        kept.append(docs.count())
    assert kept[0] > kept[1] >= kept[2] >= kept[3] > kept[4]
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    own = sorted(tuple(r)[:5] for r in packing.pieces_of(docs).collect())
    assert sorted(tuple(r)[:5] for r in pieces.collect()) == own
    again = corpus_pipeline.run(spark, sf_dir)
    assert sorted(tuple(r) for r in again.collect()) == sorted(tuple(r) for r in pieces.collect())


def test_stages_on_edges(spark, edge_docs, no_docs):
    for docs in (edge_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, "/root/testdata/sf0.001")
            assert out.columns == docs.columns and out.count() <= docs.count()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, "/root/testdata/sf0.001").count() >= docs.count()


def test_scratch_is_removed(spark, small):
    with scratch() as made:
        first = written(small("documents").select("doc_id"), "first")
        second = written(first.where("doc_id % 2 = 0"), "second")
        with scratch() as inner:
            written(second, "third")
    assert len(made) == 2 and len(inner) == 1
    n = second.count()
    remove(spark, made[:1] + inner)
    assert second.count() == n and spark.read.parquet(made[1]).count() == n
    folder = spark._jvm.org.apache.hadoop.fs.Path(made[0])
    assert not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)
