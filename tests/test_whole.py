"""Queries that must see the whole of their tables, on tables of their own."""

from stackroom.plans import catalog


def test_neighbours_of_more_hits_than_any_limit(spark, tmp_path):
    n = 1_000_000
    spark.range(n).selectExpr("id doc_id", "'a' text", "'en' lang", "'s' source", "1L n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    want = {h + o for h in range(0, n, 97) for o in (-1, 1) if 0 <= h + o < n and (h + o) // 10 == h // 10}
    got = [r["doc_id"] for r in catalog.QUERIES["c05_neighbours"](spark, str(tmp_path)).collect()]
    assert len(got) == len(want) and set(got) == want


def test_support_of_paragraphs_beyond_the_third(spark, tmp_path):
    spark.createDataFrame([(1, "\n".join(["one two three"] * 4 + ["other"]), "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["pos"]: r["ok"] for r in catalog.QUERIES["h46_text_supports"](spark, str(tmp_path)).collect()}
    assert got == {1: True, 2: True, 3: True, 4: False}
