import os

import corpus_pipeline
from riskspan.llm import common, crf, decontam, near_dedup, packing, secrets

SF = "/root/testdata/sf0.001"


def test_stages_act_on_what_is_left(spark):
    """Each stage equals its operator on the documents that its predecessor kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = [r["doc_id"] for r in crf.score(docs, crf.training_labels(spark, SF)).where("score >= 0.5").collect()]
    one = corpus_pipeline.quality_classifier(spark, docs, SF)
    assert one.columns == columns and sorted(r["doc_id"] for r in one.collect()) == sorted(kept) and 0 < len(kept) < docs.count()
    two = corpus_pipeline.near_duplicates(spark, one, SF)
    firsts = [r["doc_id"] for r in near_dedup.near_duplicates(one, corpus_pipeline.SIMILAR).where("kept").collect()]
    assert two.columns == columns and sorted(r["doc_id"] for r in two.collect()) == sorted(firsts)
    three = corpus_pipeline.decontamination(spark, two, SF)
    clean = decontam.decontaminate(two, spark.read.parquet(f"{SF}/benchmark.parquet"), ["doc_id"]).where("not contaminated")
    assert three.columns == columns and sorted(r["doc_id"] for r in three.collect()) == sorted(r["doc_id"] for r in clean.collect())
    four = corpus_pipeline.secret_scans(spark, three, SF)
    assert four.columns == columns and four.count() == three.count()
    before = {r["doc_id"]: r["text"] for r in three.collect()}
    spans = {r["doc_id"]: r for r in secrets.scan(three).collect()}
    for r in four.collect():
        found = any(spans[r["doc_id"]][k] for k in secrets.KINDS)
        assert ("[SECRET]" in r["text"]) if found else r["text"] == before[r["doc_id"]]
    five = corpus_pipeline.best_fit_packing(spark, four, SF)
    assert five.columns == packing.pack(four, corpus_pipeline.public_tokenizers.path("word_bpe_49k.json")).columns
    assert {r["doc_id"] for r in five.collect()} == set(before)


def test_written_stages_replace_the_tables_before_them(spark):
    """run() leaves the last written stage and what the pieces are computed from; the rest is deleted, all on request."""
    begun = common.tables_written()
    pieces = corpus_pipeline.run(spark, SF)
    left = common._written[begun:]
    assert all(p.rsplit("/", 1)[1].startswith(("stage-3", "pieces")) for p in left), left
    n = pieces.count()
    assert n and pieces.select("doc_id").distinct().count() <= spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(os.path.isdir(p) for p in left)
    common.drop_tables(spark, begun)
    assert common.tables_written() == begun and not any(os.path.isdir(p) for p in left)
