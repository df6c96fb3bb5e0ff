"""Retrieval rules over columns: section tags, bonuses, votes, memory scores, budgets and query views."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scholarlake.functions.text import section_tags

# They decide results and are part of what a query means.
SECTION_TAGS = {
    "abstract": ["abstract"],
    "introduction": ["introduction", "background"],
    "method": ["method", "methods", "approach", "framework", "architecture", "model"],
    "experiment": ["experiment", "experiments", "evaluation", "results"],
    "ablation": ["ablation"],
    "conclusion": ["conclusion", "summary", "discussion", "future work"],
    "appendix": ["appendix"],
    "prompt": ["prompt", "instruction"],
    "figure": ["figure", "fig."],
    "table": ["table"],
    "references": ["references", "bibliography"],
}
NOISY_TAGS = ("appendix", "prompt", "figure", "table", "references")
OVERVIEW_INTENTS = ("contribution", "paper_overview")
SECTION_BONUS, ASSET_BONUS, NOISY_PENALTY, ABSTRACT_BONUS, CONCLUSION_BONUS = 0.045, 0.05, 0.02, 0.03, 0.02
#: Expansion by intent: share of anchors, actions, windows of siblings and sections, most chunks of a section, page, assets and anchor, summary sections only.
POLICIES = {
    "method_flow": (0.15, ("self", "section_header", "sibling", "section_neighbors", "parent_section"), 2, 2, 5, None, None, 8, False),
    "experiment_setup": (0.15, ("self", "section_neighbors", "page_neighbors", "asset_related", "sibling"), 1, 2, 5, 5, 2, 8, False),
    "result_analysis": (0.20, ("self", "asset_related", "cited_asset_context", "section_neighbors", "sibling", "page_neighbors"), 1, 2, 5, 4, 4, 9, False),
    "figure_table": (0.10, ("self", "asset_related", "cited_asset_context", "page_neighbors", "section_neighbors"), 1, 1, 3, 5, 5, 9, False),
    "paper_overview": (0.10, ("self", "section_header", "section_neighbors"), 0, 1, 3, None, None, 5, True),
    "limitation": (0.10, ("self", "section_header", "section_neighbors", "page_neighbors"), 0, 2, 4, 3, None, 6, True),
    "default": (0.15, ("self", "sibling", "section_neighbors", "asset_related"), 1, 1, 3, None, 2, 6, False),
}


def tags_of(content: Column) -> Column:
    """The section tags of a chunk, from the normal form of its first 900 characters."""
    return section_tags(F.regexp_replace(content, r"\s+", " "), SECTION_TAGS)


def structural_bonus(tags: Column, preferred: Column, intent: Column, chunk_type: Column) -> Column:
    """A small bonus for where a chunk stands, kept in -.05 to .12.

    Preferred sections count for it and noisy ones against it; a figure or a table is not noise to a question about
    one. Overviews like abstracts and conclusions. Null arrays are empty.
    """
    tags, preferred = F.array_distinct(F.coalesce(tags, F.array().cast("array<string>"))), F.coalesce(preferred, F.array().cast("array<string>"))
    asset = F.lower(F.trim(chunk_type)).isin("figure", "table") & (intent == "figure_table")
    noisy = F.array_intersect(tags, F.array(*map(F.lit, NOISY_TAGS)))
    noisy = F.when(asset, F.array_except(noisy, F.array(F.lit("figure"), F.lit("table")))).otherwise(noisy)
    overview = intent.isin(*OVERVIEW_INTENTS)
    one = lambda test, value: F.when(test, value).otherwise(0.0)
    bonus = F.size(F.array_intersect(tags, preferred)) * SECTION_BONUS + one(asset, ASSET_BONUS) - F.size(noisy) * NOISY_PENALTY
    bonus = bonus + one(overview & F.array_contains(tags, "abstract"), ABSTRACT_BONUS) + one(overview & F.array_contains(tags, "conclusion"), CONCLUSION_BONUS)
    return F.greatest(F.lit(-0.05), F.least(F.lit(0.12), bonus))


def vote_multiplier(route: Column, has_cells: Column, operation: Column, decision: Column, confidence: Column) -> Column:
    """How much a vote of the table route counts: 1 + min(.3, .22 of its confidence), and .08 for a computed extreme or difference, .03 for one left to the reader."""
    more = F.when((decision == "compute") & operation.isin("max", "min", "difference"), 0.08).when(decision == "defer_to_llm", 0.03).otherwise(0.0)
    counts = (route == "table_structured") & F.coalesce(has_cells, F.lit(False))
    return F.when(counts, 1.0 + F.least(F.lit(0.3), F.coalesce(confidence, F.lit(0.0)) * 0.22) + more).otherwise(1.0)


def memory_score(recent_turn: Column, strength: Column, candidate_ids: Column, chunk_ids: Column, keywords: Column, chunk_text: Column, bonus: Column) -> Column:
    """Score of a remembered chunk, 1.4 at most: .25, a recent turn .28, strength of the reference up to .24, an equal id .34, shared keywords (of the first 10) up to .28, and a positive structural bonus."""
    filled = lambda ids: F.filter(ids, lambda i: i != "")
    same = F.coalesce(F.arrays_overlap(filled(candidate_ids), filled(chunk_ids)), F.lit(False))
    ten, low = F.slice(keywords, 1, 10), F.lower(chunk_text)
    shared = F.size(F.filter(ten, lambda k: F.contains(low, F.lower(F.trim(k)))))
    overlap = F.when(F.size(ten) > 0, F.least(F.lit(0.28), shared / F.size(ten) * 0.28)).otherwise(0.0)
    score = F.when(recent_turn, 0.28).otherwise(0.0) + 0.25 + F.least(F.lit(0.24), F.coalesce(strength, F.lit(0.0)) * 0.24) + F.when(same, 0.34).otherwise(0.0)
    return F.least(F.lit(1.4), score + overlap + F.greatest(F.lit(0.0), bonus))


def policies(spark: SparkSession) -> DataFrame:
    """The seven policies as a table: a row each, so it may be sent to all tasks."""
    schema = "policy string, anchor_ratio double, actions array<string>, sibling_window long, section_window long, section_limit long, page_limit long, asset_limit long, per_anchor_limit long, summary_only boolean"
    return spark.createDataFrame([(name, *p) for name, p in POLICIES.items()], schema)


def policy_of(intent: Column) -> Column:
    """The policy of an intent; unknown ones have the default."""
    return F.when(intent.isin(*POLICIES), intent).otherwise(F.lit("default"))


def deduped_views(views: Column, least: float = 0.88) -> Column:
    """The views of one query, in order, without those that say what a kept one says: as tokens equal, or alike to at least `least` (shared over all)."""
    tokens = lambda v: F.array_distinct(F.regexp_extract_all(F.lower(v), F.lit("[a-z0-9]+"), F.lit(0)))
    alike = lambda a, b: F.size(F.array_intersect(a, b)) >= least * F.size(F.array_union(a, b))
    some = F.filter(F.transform(views, lambda v: F.struct(v.alias("view"), tokens(v).alias("tokens"))), lambda x: F.size(x["tokens"]) > 0)
    none = F.filter(some, lambda x: F.lit(False))
    kept = F.aggregate(some, none, lambda acc, x: F.when(F.exists(acc, lambda k: alike(k["tokens"], x["tokens"])), acc).otherwise(F.concat(acc, F.array(x))))
    return F.transform(kept, lambda x: x["view"])


def query_match(text: Column, title: Column, abstract: Column, categories: Column, terms: Sequence[str], title_query: Sequence[str] = (), abstract_query: Sequence[str] = (), asked: Sequence[str] = (), recalled: Column | None = None) -> Column:
    """How well a candidate answers a search, 0 to 1.

    .55 of the share of the query's terms in all its text (or of the recall score, if that is greater), .2 of the title's terms
    in the title, .15 of the abstract's in the abstract, .1 of the asked categories, and .1 and .05 where the whole title or
    abstract query stands in a row. Terms count as whole words of lower-cased text.
    """
    has = lambda where, t: F.when(where.rlike(rf"(^|[^a-z0-9]){t}([^a-z0-9]|$)"), 1.0).otherwise(0.0)
    share = lambda where, ts: sum((has(where, t) for t in ts[1:]), has(where, ts[0])) / len(ts) if ts else F.lit(0.0)
    best = share(text, terms)
    if recalled is not None:
        best = F.greatest(best, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(recalled, F.lit(0.0)))))
    wanted = F.array(*[F.lit(c.lower()) for c in asked]) if asked else None
    of_categories = F.size(F.array_intersect(F.transform(categories, F.lower), wanted)) / len(set(asked)) if asked else F.lit(0.0)
    score = best * 0.55 + share(title, title_query) * 0.2 + share(abstract, abstract_query) * 0.15 + of_categories * 0.1
    for where, ts, bonus in ((title, title_query, 0.1), (abstract, abstract_query, 0.05)):
        if ts:
            score = score + has(where, " ".join(ts)) * bonus
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))
