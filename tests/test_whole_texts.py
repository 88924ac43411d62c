from ragmill.plans import evaluation, evidence

SF = "/root/testdata/sf0.001"


def test_merged_evidence_has_whole_texts(spark):
    texts = {str(r.doc_id): r.text.strip(" ") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = evidence.evidence_merge(spark, SF).collect()
    assert any(len(r.text) > 700 for r in got)
    assert all(r.text.startswith(texts[r.chunk_id]) for r in got if texts[r.chunk_id])
    assert all(len(r.text) <= 1200 + r.merged_chunk_ids.count(",") + 1 for r in got if r.merged_chunk_ids)


def test_contexts_are_all_whole_hits(spark):
    want = {}
    for r in sorted(evaluation.hits(spark, SF).select("case_id", "rank", "text").collect(), key=lambda r: r["rank"]):
        want.setdefault(r.case_id, []).append(r.text)
    got = evaluation.predictions(spark, SF).collect()
    assert got and all(r.contexts == want.get(r.case_id, []) for r in got)
