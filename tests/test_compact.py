"""Blocks shortened by role and kind, with the mark between head and tail."""

from scholarlake.operators import compact as K


def test_blocks(spark):
    rows = [("a" * 13_000, "anchor_evidence", "text"), ("b " * 1000, "sibling_context", "text"), ("c" * 480, "other", "text"), ("c" * 481, "other", "text"), (" d  \n e ", None, None), (None, "section_context", "text"), ("t" * 1000, "anchor_evidence", "table")]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, t string, role string, kind string")
    got = {r.k: r.c for r in df.select("k", K.compacted(df.t, df.role, df.kind).alias("c")).collect()}
    assert got[0].text == "a" * 7800 + K.MARK + "a" * (3 * (4000 - 2600 - 8)) and (got[0].strategy, got[0].loss) == ("anchor_head_tail", "low") and got[0].tokens <= 4010
    assert got[1].text == ("b " * 525).rstrip() and got[1].strategy == "sibling_head"
    assert got[2].strategy is None and got[2].tokens == 160 and got[3].text == "c" * 480 and got[3].loss == "high"
    assert got[4].text == "d\n e" and got[5].text == "" and got[5].strategy is None
    assert got[6].text == "t" * 660 and got[6].strategy == "plain_table_preview"
