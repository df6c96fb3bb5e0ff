"""Retrieval and answer metrics, their aggregates and comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def retrieval_metrics(relevant: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """(case_id, recall, hit, mrr) of each case of `relevant` (case_id, id); `candidates` are (case_id, id, rank).

    A candidate that comes several times counts at its best rank. Cases without labels are not in the result: null,
    not zero. mrr uses the original rank, beyond k too.
    """
    best = candidates.groupBy("case_id", "id").agg(F.min("rank").alias("rank"))
    both = relevant.select("case_id", "id").distinct().join(best, ["case_id", "id"], "left")
    g = both.groupBy("case_id").agg(F.count("*").alias("n"), F.count(F.when(F.col("rank") <= k, 1)).alias("found"), F.min("rank").alias("first"))
    return g.select("case_id", (F.col("found") / F.col("n")).alias("recall"), (F.col("found") > 0).cast("double").alias("hit"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"))


def scored_metrics(relevant: DataFrame, scored: DataFrame, k: int) -> DataFrame:
    """What `retrieval_metrics` says of candidates (case_id, id, score), ranked by score and id, once each, without ranking whole cases.

    Of each case only the best k are ranked. The first relevant one's rank is how many come before it, which is counted
    map-side, so a case may have any number of candidates.
    """
    at = F.struct("score", (-F.col("id")).alias("_i"))
    top = scored.withColumn("rank", F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("score"), F.asc("id")))).filter(F.col("rank") <= k)
    mine = relevant.select("case_id", "id").distinct()
    found = mine.join(top.select("case_id", "id"), ["case_id", "id"], "left_semi").groupBy("case_id").agg(F.count("*").alias("found"))
    first = scored.join(mine, ["case_id", "id"], "left_semi").groupBy("case_id").agg(F.max(at).alias("_best"))
    before = scored.join(first, "case_id").groupBy("case_id").agg((F.count(F.when(at > F.col("_best"), 1)) + 1).alias("first"))
    g = mine.groupBy("case_id").agg(F.count("*").alias("n")).join(found, "case_id", "left").join(before, "case_id", "left").withColumn("found", F.coalesce("found", F.lit(0)))
    return g.select("case_id", (F.col("found") / F.col("n")).alias("recall"), (F.col("found") > 0).cast("double").alias("hit"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"))


def metric_mean(value: Column, failed: Column) -> Column:
    """The mean of a metric in which failed runs count as 0 and unscored ones not at all."""
    return F.avg(F.coalesce(value, F.when(failed, 0.0)))


def repeats(value: Column) -> list[Column]:
    """Median, sample deviation (0 for one value), extremes and missing of a repeated measure."""
    return [F.round(F.median(value), 6).alias("median"), F.round(F.coalesce(F.stddev_samp(value), F.lit(0.0)), 6).alias("std"), F.min(value).alias("least"), F.max(value).alias("most"), F.count(F.when(value.isNull(), 1)).alias("missing")]


def difference(now: DataFrame, before: DataFrame, key: str, value: str, flag: float = -0.05) -> DataFrame:
    """(key, delta, red): changes of the keys that both have; red below `flag`."""
    b = before.select(F.col(key).alias("_k"), F.col(value).alias("_b"))
    delta = F.round(F.col(value) - F.col("_b"), 6)
    return now.join(b, F.col(key) == F.col("_k")).select(key, delta.alias("delta"), (delta < flag).alias("red"))


def cited(text: Column) -> Column:
    """Distinct source numbers that an answer cites as [S1], in order of first mention."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"\[S(\d+)\]"), F.lit(1)), lambda x: x.cast("int")))


def without_invalid(text: Column, most: int) -> Column:
    """A text without the citations of sources beyond `most` (of up to three digits)."""
    valid = "|".join(str(i) for i in range(1, most + 1))
    return F.regexp_replace(text, rf"\[S(?!(?:{valid})\])\d+\]", "")
