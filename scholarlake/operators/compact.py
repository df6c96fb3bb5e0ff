"""Blocks of a prompt shortened by rule: how many tokens a block may keep, and which of them, follows from what it is."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters of a token, for texts that no tokenizer has counted.
CHARS = 3
# Tokens that a block of each role keeps, what of it, and how much is lost by that; figures and tables by their kind.
ROLES = {
    "anchor_evidence": (4000, "anchor_head_tail", "low"),
    "memory_context": (4000, "anchor_head_tail", "low"),
    "sibling_context": (350, "sibling_head", "medium"),
    "section_context": (250, "section_head", "medium"),
    "parent_context": (250, "section_head", "medium"),
}
OTHER = (160, "fallback_preview", "high")
KINDS = {"table": (220, "plain_table_preview", "medium"), "figure_evidence": (220, "caption_summary_preview", "medium")}
#: The share of the tokens that the head gets where the tail is kept too, and tokens that the mark between them takes.
HEAD, MARK_TOKENS = 0.65, 8
MARK = "\n...[middle omitted by rule compaction]...\n"


def tokens(text: Column) -> Column:
    """An estimate of a text's tokens."""
    return F.ceil(F.length(text) / CHARS).cast("long")


def trimmed(text: Column) -> Column:
    """A text without white space at its ends and at the ends of its lines."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+\n", "\n"), r"^\s+|\s+$", "")


def head(text: Column, most: Column) -> Column:
    return F.when(tokens(text) <= most, text).otherwise(F.regexp_replace(F.substring(text, F.lit(1), (most * CHARS).cast("int")), r"\s+$", ""))


def tail(text: Column, most: Column) -> Column:
    n = (most * CHARS).cast("int")
    return F.when(tokens(text) <= most, text).otherwise(F.regexp_replace(F.substring(text, F.length(text) - n + 1, n), r"^\s+", ""))


def compacted(text: Column, role: Column, kind: Column) -> Column:
    """struct<text, strategy, loss, tokens>: a block by its kind (figures and tables) or its role; strategy and loss are null for a block that keeps its text.

    Anchors and remembered evidence keep head and tail, all others their head. Null texts are empty.
    """

    def of(i: int) -> Column:
        out = None
        for name, rule in KINDS.items():
            out = F.when(kind == name, F.lit(rule[i])) if out is None else out.when(kind == name, F.lit(rule[i]))
        for name, rule in ROLES.items():
            out = out.when(role == name, F.lit(rule[i]))
        return out.otherwise(F.lit(OTHER[i]))

    t, most = trimmed(text), of(0)
    first = F.floor(most * HEAD)
    both = F.concat(head(t, first), F.lit(MARK), tail(t, most - first - MARK_TOKENS))
    long = tokens(t) > most
    cut = F.when(of(1) == "anchor_head_tail", both).otherwise(head(t, most))
    kept = F.when(long, cut).otherwise(t)
    return F.struct(kept.alias("text"), F.when(long, of(1)).alias("strategy"), F.when(long, of(2)).alias("loss"), tokens(kept).alias("tokens"))
