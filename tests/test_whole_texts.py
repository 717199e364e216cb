"""Queries read whole texts, not their heads."""

from tidemark import catalog


def test_classified_documents_reads_the_whole_text(spark, tmp_path):
    rows = [(4, "Engineer " * 5_000 + "This is a remote position."), (10, "Engineer " * 10)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.is_remote for r in catalog.queries()["classified_documents"](spark, str(tmp_path)).collect()}
    assert got == {4: True, 10: False}
