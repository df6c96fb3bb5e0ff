"""Keywords of whole documents: what travels is words, not places of words."""

from scholarlake.plans import retrieval as R
from tests.shuffles import shuffled_rows


def test_words_of_a_document_travel_once(spark, tmp_path):
    texts = ["planned plans " * 250 + f"note{i % 7}" for i in range(100)] + ["日本 plans 語語 rated notes plan", "", None]
    spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got, rows = shuffled_rows(spark, lambda: {r.doc_id: r[1:] for r in R.f1_keyword_tokens(spark, str(tmp_path)).collect()})
    assert got[5] == (501, 2, "plan plan plan plan plan") and got[101] == got[102] == (0, 0, "")
    assert got[100] == (6, 5, "plan rate note plan 日本") and len(got) == 103
    assert rows < 10_000  # of 50,000 words
