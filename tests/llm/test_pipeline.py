import corpus_pipeline
from gridloom.llm.session import materialize


def test_stages_on_the_smallest_tables(spark, sample):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "jaccard_join", "decontamination", "packing"]
    texts = {i: t for i, t, _ in sample}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf), name)
        after = {r.doc_id for r in docs.select("doc_id").collect()}
        assert docs.columns == columns and after <= before and docs.count() == len(after)
        if name == "exact_dedup":
            assert len({texts[i] for i in after}) == len(after) == len({texts[i] for i in before})
        before = after
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == before
    whole = corpus_pipeline.run(spark, sf)
    key = lambda df: sorted(tuple(r)[:5] for r in df.collect())
    assert key(whole) == key(packed)
