"""The corpus pipeline on the smallest tables."""

import corpus_pipeline
from noticeboard.llm import decontamination

DATA = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_clean_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    before, ids = docs, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, before, DATA)
        out.write.parquet(f"{tmp_path}/{k}")
        after = spark.read.parquet(f"{tmp_path}/{k}")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert after.columns == docs.columns, name
        assert after.select(docs.columns).exceptAll(before).count() == 0, name
        ids.append({r.doc_id for r in after.select("doc_id").collect()})
        before = after
    assert ids[0] >= ids[1] >= ids[2] >= ids[3] == ids[4] and len(ids[4]) > 100
    texts = [r.text for r in before.collect()]
    assert len(set(texts)) == len(texts)
    assert decontamination.contaminated(before, spark.read.parquet(f"{DATA}/benchmark.parquet")).count() == 0
    assert sorted(r.mix_position for r in before.collect()) == list(range(len(texts)))


def test_run_equals_the_stages(spark):
    out = corpus_pipeline.run(spark, DATA)
    assert out.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"] and out.count() == out.select("doc_id").distinct().count()
