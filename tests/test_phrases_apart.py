"""The phrases that decide are read by themselves, whatever the document between them ends with."""

from tidemark import catalog


def test_last_words_do_not_join_the_phrase_after_them(spark, tmp_path):
    ends = ["it erhe without", "oust no", "was not able to", "unable to thes ernd", "thhe will not ant", "with\n", "heble.", ""]
    rows = [(8 + 12 * k, end) for k, end in enumerate(ends)] + [(9 + 12 * k, end) for k, end in enumerate(ends)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.mode, r.is_remote, r.visa) for r in catalog.queries()["classified_documents"](spark, str(tmp_path)).collect()}
    assert got == {k: ("onsite", False, "yes") if k % 12 == 8 else ("hybrid", False, "no") for k, _ in rows}
