"""The section that a figure or table belongs to: where its label is first mentioned, else where its page lies.

Mentions are an inverted index of labels, so an asset meets the sections that name it by equality. Pages are an interval join:
a section is entered under the blocks of pages that it covers, a page looks in its block. What no section covers takes the
last section that ends before it, or the first that begins after it, by running values of a paper's bounds. Each page of a
paper is placed once, for all assets on it, and no asset meets all sections of its paper.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Pages of a block, and the confidence from which on an asset's text goes with its section.
BLOCK, SURE = 8, 0.70
NAMES = {"table": r"(?:table|tab\.?|表)", "figure": r"(?:figure|fig\.?|图)"}


def _labels(text: Column, kind: str) -> Column:
    """The labels of a kind in a text, lower case, without blanks and brackets: 3, 3a; `3 a` may be either."""
    start = rf"(?i)(?<![A-Za-z]){NAMES[kind]}\s*"
    plain = F.regexp_extract_all(text, F.lit(start + r"([0-9]+)(?![0-9A-Za-z]|\s*\([A-Za-z]\))"), F.lit(1))
    parts = F.regexp_extract_all(text, F.lit(start + r"([0-9]+\s*(?:[A-Za-z]|\([A-Za-z]\)))(?![0-9A-Za-z])"), F.lit(1))
    return F.array_distinct(F.transform(F.concat(plain, parts), lambda x: F.lower(F.regexp_replace(x, r"[^0-9A-Za-z]", ""))))


def _of_kind(text: Column, kind: str) -> Column:
    return F.transform(_labels(text, kind), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("label")))


def mentions(sections: DataFrame, text: str = "text") -> DataFrame:
    """(paper, section, kind, label): each label once for a section that names it."""
    found = F.flatten(F.array(*[_of_kind(F.col(text), k) for k in NAMES]))
    return sections.select("paper", "section", F.explode(found).alias("m")).select("paper", "section", "m.*").distinct()


def labelled(assets: DataFrame) -> DataFrame:
    """(paper, asset, page, kind, label): the labels in an asset's caption, of its own kind; an asset of another kind has those of both."""
    of = lambda k: _of_kind(F.coalesce("caption", F.lit("")), k)
    both = F.when(F.col("kind") == "picture", of("figure")).when(F.col("kind") == "table", of("table")).otherwise(F.concat(of("figure"), of("table")))
    return assets.select("paper", "asset", "page", F.explode(both).alias("m")).select("paper", "asset", "page", "m.*")


def _gap(page: Column, first: Column, last: Column) -> Column:
    return F.when((page <= 0) | page.between(first, last), 0).when(last < page, page - last).otherwise(first - page)


def by_mention(assets: DataFrame, sections: DataFrame) -> DataFrame:
    """(asset, section, relation, page_gap, order_gap, n): the first section that names an asset's label, and how many do."""
    hits = labelled(assets).join(mentions(sections), ["paper", "kind", "label"])
    first = hits.groupBy("asset", "paper").agg(F.min("section").alias("section"), F.count_distinct("section").alias("n"), F.first("page").alias("page"))
    bounds = sections.select("paper", "section", "first_page", "last_page")
    gap = _gap(F.col("page"), F.col("first_page"), F.col("last_page"))
    return first.join(bounds, ["paper", "section"]).select("asset", "section", F.lit("caption_reference").alias("relation"), gap.cast("long").alias("page_gap"), F.lit(0).cast("long").alias("order_gap"), "n")


def places(pages: DataFrame, sections: DataFrame) -> DataFrame:
    """(paper, page, relation, gap, section, heading_order): the sections around each (paper, page) that begin last, else those nearest before, else after."""
    s = sections.select(F.col("paper").alias("_p"), "section", F.col("first_page").cast("long").alias("first_page"), F.col("last_page").cast("long").alias("last_page"), "heading_order")
    pages = pages.select("paper", "page").distinct()
    block = lambda c: F.floor(c / BLOCK)
    covered = s.withColumn("_b", F.explode(F.sequence(block(F.col("first_page")), block(F.greatest("first_page", "last_page")))))
    inside = pages.join(covered, (F.col("paper") == F.col("_p")) & (block(F.col("page")) == F.col("_b")) & F.col("page").between(F.col("first_page"), F.col("last_page")))
    begins = inside.groupBy("paper", "page").agg(F.max("first_page").alias("inside"))
    # the nearest bound on each side of a page, from bounds and pages of a paper in one order; each side by a running value, which costs a row once
    none = F.lit(None).cast("long")
    at = lambda c: F.col(c).cast("long").alias("at")
    rows = s.select(F.col("_p").alias("paper"), none.alias("page"), at("last_page"), F.col("last_page").alias("last"), none.alias("first")).distinct()
    rows = rows.unionByName(s.select(F.col("_p").alias("paper"), none.alias("page"), at("first_page"), none.alias("last"), F.col("first_page").alias("first")).distinct())
    rows = rows.unionByName(pages.select("paper", "page", at("page"), none.alias("last"), none.alias("first")))
    up, down = (Window.partitionBy("paper").orderBy(o).rangeBetween(Window.unboundedPreceding, -1) for o in (F.col("at").asc(), F.col("at").desc()))
    around = rows.withColumn("before", F.max("last").over(up)).withColumn("after", F.min("first").over(down)).filter("page is not null").select("paper", "page", "before", "after")
    near = around.join(begins, ["paper", "page"], "left")
    which = F.when(F.col("inside").isNotNull(), "inside").when(F.col("before").isNotNull(), "before").when(F.col("after").isNotNull(), "after")
    near = near.select("paper", F.col("page").alias("_page"), which.alias("relation"), F.coalesce("inside", "before", "after").alias("bound"))
    # a section is entered under its first page, for pages inside and after, and under its last
    ends = s.select("_p", F.explode(F.array(*[F.struct(F.lit(r).alias("_r"), F.col(c).alias("_at")) for r, c in (("inside", "first_page"), ("before", "last_page"), ("after", "first_page"))])).alias("_e"), "section", "heading_order", "last_page")
    found = near.join(ends, (F.col("paper") == F.col("_p")) & (F.col("relation") == F.col("_e._r")) & (F.col("bound") == F.col("_e._at")) & ((F.col("relation") != "inside") | (F.col("last_page") >= F.col("_page"))))
    return found.select("paper", F.col("_page").alias("page"), "relation", F.abs(F.col("_page") - F.col("bound")).alias("gap"), "section", "heading_order")


def by_page(assets: DataFrame, sections: DataFrame) -> DataFrame:
    """(asset, section, relation, page_gap, order_gap, n): the section around an asset's page that begins last, else the nearest before, else after; equal ones by how far the heading's order is, then the first.

    Pages are placed once, however many assets lie on them; an asset then meets the sections that are equally near.
    """
    a = assets.select("paper", "asset", "page", "order")
    near = a.join(places(a.filter("paper is not null and page is not null"), sections), ["paper", "page"])
    far = F.abs(F.col("order") - F.col("heading_order"))
    best = near.groupBy("asset").agg(F.min(F.struct("gap", far.alias("far"), "section", "relation")).alias("b"))
    return best.select("asset", "b.section", "b.relation", F.col("b.gap").cast("long").alias("page_gap"), F.col("b.far").cast("long").alias("order_gap"), F.lit(0).cast("long").alias("n"))


def confidence(relation: Column, page_gap: Column, order_gap: Column, n: Column) -> Column:
    """How sure a match is: a mention nearly so, less if others mention it too or it lies pages away; a place by how near it is."""
    named = F.greatest(F.lit(0.75), F.least(F.lit(0.98), 0.94 - F.least(F.lit(0.12), page_gap * 0.02) - F.when(n > 1, 0.02).otherwise(0.0)))
    near = page_gap <= 1
    base = F.when((relation == "inside") & (page_gap == 0), 0.76).when(relation == "inside", 0.70).when(relation == "before", F.when(near, 0.58).otherwise(0.42)).otherwise(F.when(near, 0.42).otherwise(0.28))
    placed = F.greatest(F.lit(0.0), F.least(F.lit(0.95), base - F.least(F.lit(0.18), order_gap * 0.003)))
    return F.round(F.when(relation == "caption_reference", named).otherwise(placed), 3)


def sections_of(assets: DataFrame, sections: DataFrame) -> DataFrame:
    """(asset, section, relation, page_gap, confidence, embeds) of each asset whose paper has sections.

    `assets`: asset (distinct), paper, kind (picture, table or another), caption, page, order; `sections`: paper, section (its
    place, distinct within a paper), first_page, last_page, heading_order, text.
    """
    named = by_mention(assets, sections)
    rest = by_page(assets.join(named.select("asset"), "asset", "left_anti"), sections)
    rows = named.unionByName(rest)
    return rows.select("asset", "section", "relation", "page_gap", confidence(F.col("relation"), F.col("page_gap"), F.col("order_gap"), F.col("n")).alias("confidence")).withColumn("embeds", F.col("confidence") >= SURE)
