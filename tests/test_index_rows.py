"""Entry points of chunks: what each says, in which order, and how many."""

from scholarlake.operators.index_rows import index_rows

CHUNK = "chunk_id string, content string, chunk_type string, section_path string, section_title string, page_number string, asset_caption string, asset_summary string, preview string, table_text string, card string, summary string, questions array<string>"


def test_rows_of_chunks(spark):
    long = "word " * 60
    rows = [
        ("a", " Plain text. ", None, None, "Intro", "3", None, None, None, None, None, "plain  TEXT.", ["Q1?", "q1?", "", None, "Q2?", "Q3?", "Q4?"]),
        ("b", "cells", "TABLE", "Results > X", None, None, "Table 1", " table  1", None, "a|b", None, "It shows.", ["Q1?", "Q2?", "Q3?"]),
        ("c", None, "text", None, None, None, None, None, None, None, None, None, None),
        ("d", long, "text", "S", None, None, None, None, None, None, "card", None, []),
    ]
    got = {}
    for r in index_rows(spark.createDataFrame(rows, CHUNK)).collect():
        got.setdefault(r.chunk_id, []).append((r.index_id, r.text, r.weight))
    assert got["a"] == [("a:body:1", "Plain text.", 1.0), ("a:section_anchor:1", "Section: Intro\nPage: 3\nSummary: Plain text.", 0.45), ("a:question:1", "Q1?", 0.82), ("a:question:2", "Q2?", 0.82), ("a:question:3", "Q3?", 0.82)]
    body = "Table 1\na|b\ncells"
    assert [x[:2] for x in got["b"]] == [("b:body:1", body), ("b:section_anchor:1", "Section: Results > X\nSummary: table  1"), ("b:table_or_figure:1", body), ("b:summary:1", "It shows."), ("b:question:1", "Q1?"), ("b:question:2", "Q2?")]
    assert [x[:2] for x in got["c"]] == [("c:body:1", ""), ("c:section_anchor:1", "Chunk: c")]
    assert got["d"][1][1] == "Section: S\nSummary: card"
    short = index_rows(spark.createDataFrame([("d", long, "text", None, None, None, None, None, None, None, None, None, None)], CHUNK), most=2).collect()
    assert len(short) == 2 and len(short[1].text) <= 189 and short[1].text.endswith("word")
