"""Entry points of a chunk: rows of text that it is found by, each with a kind, a weight and the routes that may use it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Weights and routes of the kinds, rows and questions of a chunk at most, characters of an anchor's summary.
WEIGHTS = {"body": 1.0, "section_anchor": 0.45, "summary": 0.78, "question": 0.82, "table_or_figure": 1.12}
_ALL = ("vector_original", "vector_rewrite", "vector_hyde", "keyword")
ROUTES = {"body": _ALL, "section_anchor": ("keyword",), "summary": _ALL, "question": _ALL, "table_or_figure": (*_ALL, "table_structured")}
MOST, MOST_QUESTIONS, ANCHOR_CHARS = 6, 3, 180


def _clean(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))


def _folded(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def _distinct(parts: Column) -> Column:
    """Texts that are not empty, of those that differ in case and white space only the first."""
    seen = F.transform(parts, _folded)
    return F.filter(parts, lambda x, i: (_folded(x) != "") & (F.array_position(seen, _folded(x)) == i + 1))


def _short(text: Column, most: int) -> Column:
    """A text in one line, cut at the last space before `most` characters."""
    line = F.trim(F.regexp_replace(text, r"\s+", " "))
    cut = F.substring(line, 1, most)
    whole = F.trim(F.regexp_replace(cut, r" [^ ]*$", ""))
    return F.when(F.length(line) <= most, line).otherwise(F.when(whole != "", whole).otherwise(F.trim(cut)))


def index_rows(chunks: DataFrame, most: int = MOST, questions: int = MOST_QUESTIONS) -> DataFrame:
    """(index_id, chunk_id, kind, ordinal, text, weight, routes): body, section anchor, for figures and tables their fields, a summary and questions, the first `most`.

    `chunks`: chunk_id, content, chunk_type, section_path, section_title, page_number, asset_caption, asset_summary, preview, table_text,
    card, and what was written about a chunk: summary, questions (array). A figure's or table's body is all its fields, each once. A summary that
    says what the body says adds nothing; so do empty and repeated questions. Null fields are empty.
    """
    asset = F.lower(F.coalesce(F.nullif(_clean("chunk_type"), F.lit("")), F.lit("text"))).isin("figure", "table")
    fields = F.array(*[_clean(c) for c in ("asset_caption", "asset_summary", "preview", "table_text", "content")])
    rows = chunks.select("*", asset.alias("_asset"), F.array_join(_distinct(fields), "\n").alias("_fields"))
    rows = rows.withColumn("_body", F.when(F.col("_asset"), F.col("_fields")).otherwise(_clean("content")))
    summary = F.coalesce(F.nullif(_clean("card"), F.lit("")), F.nullif(_clean("asset_summary"), F.lit("")), _short(F.when(F.col("_fields") != "", F.col("_fields")).otherwise(_clean("content")), ANCHOR_CHARS))
    rows = rows.withColumn("_line", summary)
    path = F.coalesce(F.nullif(_clean("section_path"), F.lit("")), _clean("section_title"))
    said = lambda name, c: F.when(c != "", F.concat(F.lit(f"{name}: "), c))
    alone = F.when((F.col("_line") == "") & (path == ""), F.concat(F.lit("Chunk: "), F.col("chunk_id")))
    anchor = F.array_join(F.array_compact(F.array(said("Section", path), said("Page", _clean("page_number")), said("Summary", F.col("_line")), alone)), "\n")
    entry = lambda kind, n, text: F.struct(F.lit(kind).alias("kind"), n.cast("int").alias("ordinal"), text.alias("text"))
    one = F.lit(1)
    asked = F.slice(_distinct(F.coalesce(F.transform("questions", F.trim), F.array().cast("array<string>"))), 1, questions)
    head = F.array_compact(F.array(entry("body", one, F.col("_body")), entry("section_anchor", one, anchor), F.when(F.col("_asset") & (F.col("_body") != ""), entry("table_or_figure", one, F.col("_body"))), F.when((_clean("summary") != "") & (_folded(_clean("summary")) != _folded(F.col("_body"))), entry("summary", one, _clean("summary")))))
    every = F.slice(F.concat(head, F.transform(asked, lambda q, i: entry("question", i + 1, q))), 1, max(2, most))
    rows = rows.select("chunk_id", F.explode(every).alias("e")).select("chunk_id", "e.*")
    weight = F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv])
    routes = F.create_map(*[x for k, r in ROUTES.items() for x in (F.lit(k), F.array(*map(F.lit, r)))])
    return rows.select(F.concat_ws(":", "chunk_id", "kind", F.col("ordinal").cast("string")).alias("index_id"), "chunk_id", "kind", "ordinal", "text", weight[F.col("kind")].alias("weight"), routes[F.col("kind")].alias("routes"))
