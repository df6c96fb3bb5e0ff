"""Sections of figures and tables: labels as they are written, and places against all pairs."""

import random

from scholarlake.operators import assets as A
from tests.shuffles import shuffled_rows

SECTION = "paper long, section long, first_page long, last_page long, heading_order long, text string"
ASSET = "asset long, paper long, kind string, caption string, page long, order long"


def test_labels(spark):
    text = "Table 3 and tab.4, TABLE 12b; Fig. 2 (a), figure 7 c, stable 9, Table 5(a), 表 6, Figures 8"
    rows = A.mentions(spark.createDataFrame([(1, 0, 1, 2, 0, text), (1, 1, 1, 2, 0, None)], SECTION)).collect()
    assert {(r.kind, r.label) for r in rows} == {("table", "3"), ("table", "4"), ("table", "12b"), ("table", "5a"), ("table", "6"), ("figure", "2a"), ("figure", "7"), ("figure", "7c")}


def test_first_mention_comes_before_the_place(spark):
    sections = spark.createDataFrame([(1, 0, 1, 3, 0, "no"), (1, 1, 4, 6, 10, "see Table 2"), (1, 2, 7, 9, 20, "table 2 again, Figure 2"), (2, 0, 1, 1, 0, "Table 2")], SECTION)
    assets = spark.createDataFrame([(10, 1, "table", "Table 2: x", 9, 0), (11, 1, "picture", "Table 2", 2, 0), (12, 1, "other", "fig 2 and table 2", 8, 0), (13, 3, "table", "Table 2", 1, 0), (14, 2, "table", None, 30, 0)], ASSET)
    got = {r.asset: (r.section, r.relation, r.page_gap, r.confidence, r.embeds) for r in A.sections_of(assets, sections).collect()}
    assert got == {10: (1, "caption_reference", 3, 0.86, True), 11: (0, "inside", 1, 0.7, True), 12: (1, "caption_reference", 2, 0.88, True), 14: (0, "before", 29, 0.42, False)}


def test_places_are_those_of_all_pairs(spark):
    rnd = random.Random(9)
    sections = []
    for paper in range(12):
        for k in range(rnd.randrange(1, 9)):
            first = rnd.randrange(1, 60)
            sections.append((paper, k, first, first + rnd.choice([0, 0, 1, 3, 20]), rnd.randrange(50), ""))
    assets = [(i, rnd.randrange(13), "table", "", rnd.randrange(0, 70), rnd.randrange(50)) for i in range(300)]

    def place(asset):
        _, paper, _, _, page, order = asset
        best = []
        for p, k, a, b, h, _ in sections:
            if p == paper:
                tier, gap = (0, page - a) if a <= page <= b else (1, page - b) if b < page else (2, a - page)
                best.append((tier, gap, abs(order - h), k))
        return min(best, default=None)

    found = A.by_page(spark.createDataFrame(assets, ASSET), spark.createDataFrame(sections, SECTION)).collect()
    got = {r.asset: (("inside", "before", "after").index(r.relation), r.page_gap, r.order_gap, r.section) for r in found}
    assert got == {a[0]: p for a in assets if (p := place(a))} and len(found) == len(got)


def test_pages_are_placed_once_for_all_assets(spark):
    sections = spark.createDataFrame([(p, k, 5 * k + 3, 5 * k + 4, 10 * k, "") for p in range(3) for k in range(4)], SECTION)
    assets = spark.range(30_000).selectExpr("id asset", "id % 3 paper", "'table' kind", "'' caption", "id % 30 page", "id % 50 order").select("asset", "paper", "kind", "caption", "page", "order")
    near = A.places(assets, sections)
    assert near.select("paper", "page").distinct().count() == 30 == near.count()
    assert {(r.page, r.relation, r.gap, r.section) for r in near.filter("paper = 0").collect()} == {(0, "after", 3, 0), (3, "inside", 0, 0), (6, "before", 2, 0), (9, "inside", 1, 1), (12, "before", 3, 1), (15, "before", 1, 2), (18, "inside", 0, 3), (21, "before", 2, 3), (24, "before", 5, 3), (27, "before", 8, 3)}
    got, rows = shuffled_rows(spark, lambda: A.by_page(assets, sections).count())
    # assets and their best sections, not assets among the bounds of their papers
    assert got == 30_000 and rows < 75_000
