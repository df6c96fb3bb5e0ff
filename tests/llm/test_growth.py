"""Rows that the corpus operators shuffle, where a plain join would multiply them."""

from scholarlake.llm import pii
from tests.shuffles import shuffled_rows


def test_words_of_a_shared_domain_meet_only_their_texts(spark):
    told = [(i, f"mail user{i}@corp.example " + " ".join(f"word{chr(97 + j // 400)}{chr(97 + j // 20 % 20)}{chr(97 + j % 20)}" for j in range(i * 10, i * 10 + 100))) for i in range(200)]
    docs = spark.createDataFrame(told + [(i, f"plain text {i}") for i in range(200, 1000)], "doc_id long, text string")
    found, rows = shuffled_rows(spark, lambda: {r.doc_id: len(r.terms) for r in pii.find(docs).collect()})
    assert sum(found.values()) > 15_000
    # a row for each word of each text, several times over, were 47,252
    assert rows < 15_000
