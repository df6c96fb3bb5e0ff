"""The metadata mirror: filters, upserts, side tables and scans of harvested records."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def allowed(papers: DataFrame, categories: Sequence[str]) -> DataFrame:
    """Records of which any category is wanted."""
    return papers.filter(F.arrays_overlap("categories", F.array(*map(F.lit, categories))))


def accounted(records: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Records with the reason of the first rule that rejects them, or 'written'."""
    reason = F.lit("written")
    for name, test in reversed(rules.items()):
        reason = F.when(test, name).otherwise(reason)
    return records.withColumn("reason", reason)


def upserted(batches: Sequence[DataFrame], key: str) -> DataFrame:
    """All batches as one table; of a key the last batch wins. One shuffle, the newest row chosen map-side."""
    rows = reduce(DataFrame.unionByName, [b.withColumn("_seq", F.lit(i)) for i, b in enumerate(batches)])
    names = [c for c in batches[0].columns if c != key]
    return rows.groupBy(key).agg(F.max(F.struct("_seq", *names)).alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in names])


def bridge(papers: DataFrame) -> DataFrame:
    """(paper_id, category, is_primary): a row per category."""
    rows = papers.select("paper_id", "primary_category", F.explode(F.array_distinct("categories")).alias("category"))
    return rows.select("paper_id", "category", (F.col("category") == F.col("primary_category")).cast("int").alias("is_primary"))


def all_text(*parts: str | Column) -> Column:
    """The parts that are neither null nor empty, by spaces."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.concat_ws(" ", *[F.when(c != "", c) for c in cols])


def normal_categories(raw: Column, primary: Column) -> Column:
    """Categories split at white space and commas, with the primary one appended where it is missing."""
    found = F.filter(F.split(raw, r"[\s,]+"), lambda c: c != "")
    return F.when(F.array_contains(found, primary) | primary.isNull(), found).otherwise(F.array_append(found, primary))


def recent_pool(papers: DataFrame, primary: Sequence[str], bridged: Sequence[str], since: str, n: int) -> DataFrame:
    """The newest papers since a date whose primary or any category is wanted."""
    wanted = F.col("primary_category").isin(list(primary)) | F.arrays_overlap("categories", F.array(*map(F.lit, bridged)))
    return papers.filter((F.col("created") >= since) & wanted).select("paper_id", "created").orderBy(F.desc("created"), F.desc("paper_id")).limit(max(n, 1))


def newest_page(papers: DataFrame, since: str, after: tuple[str, int], n: int) -> DataFrame:
    """The next page, newest first, after a (created, paper_id) key."""
    day, last = after
    rest = (F.col("created") < day) | ((F.col("created") == day) & (F.col("paper_id") < last))
    return papers.filter((F.col("created") >= since) & rest).select("paper_id", "created").orderBy(F.desc("created"), F.desc("paper_id")).limit(n)


def full_text(pages: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """(key, full_text): trimmed texts that are not empty, in order, by blank lines."""
    rows = pages.select(key, order, F.trim(text).alias("_t")).filter("_t <> ''")
    joined = F.array_join(F.transform(F.array_sort("_p"), lambda p: p["_t"]), "\n\n")
    return pages.select(key).distinct().join(rows.groupBy(key).agg(F.collect_list(F.struct(order, "_t")).alias("_p")), key, "left").select(key, joined.alias("full_text"))


def inserted(store: DataFrame, batch: DataFrame, key: str, order: str) -> DataFrame:
    """The store and the rows of the batch whose key it lacks; of a key that repeats in the batch the first."""
    names = [c for c in store.columns if c != key]
    first = batch.groupBy(key).agg(F.min(F.struct(order, *names)).alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in names])
    return store.unionByName(first.join(store.select(key), key, "left_anti"))


def retained(rows: DataFrame, keep: DataFrame, cutoff: str) -> DataFrame:
    """Rows but those with a date before the cutoff whose id is not to be kept."""
    old = (F.col("created") != "") & (F.col("created") < cutoff)
    gone = rows.filter(old).select("paper_id").join(keep, "paper_id", "left_anti")
    return rows.join(gone, "paper_id", "left_anti")


def compared(a: DataFrame, b: DataFrame, key: str, value: str, tolerance: float) -> DataFrame:
    """(key, state) of all keys of both: same, changed, missing (from b) or extra."""
    both = a.select(key, F.col(value).alias("_a")).join(b.select(F.col(key).alias("_k"), F.col(value).alias("_b")), F.col(key) == F.col("_k"), "full")
    state = F.when(F.col("_k").isNull(), "missing").when(F.col(key).isNull(), "extra").when(F.abs(F.col("_a") - F.col("_b")) > tolerance, "changed").otherwise("same")
    return both.select(F.coalesce(key, "_k").alias(key), state.alias("state"))
