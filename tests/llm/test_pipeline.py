"""The corpus pipeline: each stage keeps the columns, and what it drops is what its operator says."""

import corpus_pipeline
from varileaf.llm import jaccard, langid

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    seen = [docs.cache()]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(stage(spark, seen[-1], SF).cache())
    for df in seen[1:-1]:
        assert df.columns == columns
    told = {r.doc_id for r in langid.predict(docs, langid.fit(docs)).where("lang_pred <> 'und' and score >= 0.5").collect()}
    assert {r.doc_id for r in seen[1].collect()} == told
    heads = {r.doc_id for r in jaccard.join(seen[1]).where("doc_id = component_id").collect()}
    assert sorted(r.doc_id for r in seen[2].collect()) == sorted(heads)
    assert all(r.text.strip() for r in seen[3].collect())
    assert {r.doc_id for r in seen[5].collect()} == {r.doc_id for r in seen[4].collect()}


def test_empty(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
