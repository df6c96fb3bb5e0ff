"""Analytical queries of the operational stores: sessions, preferences, jobs, events and limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newest_per(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of each key in this order. Window limits are pushed before the shuffle."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_n = 1").drop("_n")


def first_n_per(rows: DataFrame, key: str, n: int, *order: Column) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("long")).filter(F.col("rank") <= n)


def sessions(messages: DataFrame) -> DataFrame:
    """(conv_id, n_messages, first_turn, last_turn, title): the title is the first user message."""
    return messages.groupBy("conv_id").agg(F.count("*").alias("n_messages"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.min_by(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "user", F.col("turn"))).alias("title"))


def strong_preferences(events: DataFrame) -> DataFrame:
    """(user_id, item, preference) by the last purchase (liked) or error (disliked) of each user and item: they exclude each other."""
    acts = events.filter(F.col("event_type").isin("purchase", "error")).select("user_id", F.col("k").alias("item"), "event_type", "epoch", "event_id")
    last = acts.groupBy("user_id", "item").agg(F.max_by("event_type", F.struct("epoch", "event_id")).alias("last"), F.max("epoch").alias("at"))
    return last.select("user_id", "item", F.when(F.col("last") == "purchase", "liked").otherwise("disliked").alias("preference"), "at")


def unique_in_order(lists: Column) -> Column:
    """Values of an array without repeats of the same normal form (lower case, trimmed), the first of each kept in order."""
    norm = F.transform(lists, lambda x: F.lower(F.trim(x)))
    return F.filter(lists, lambda x, i: F.array_position(norm, F.lower(F.trim(x))) == i + 1)


def window_counts(events: DataFrame, seconds: int) -> DataFrame:
    """Events of each user numbered within fixed windows."""
    start = F.col("epoch") - F.pmod("epoch", F.lit(seconds))
    order = Window.partitionBy("user_id", "window_start").orderBy("epoch", "event_id")
    return events.withColumn("window_start", start).withColumn("nth", F.row_number().over(order).cast("long"))


#: Refusals in a minute beyond which an address is blocked, and for how many seconds.
ABUSE = {"auth_failures": 20, "rate_violations": 30}
BLOCK_SECONDS = 900


def blocks(refusals: DataFrame, limits: dict[str, int] = ABUSE, seconds: int = BLOCK_SECONDS) -> DataFrame:
    """(user_id, from_epoch, until_epoch): blocks after more refusals of a kind in a minute than its limit; those within a block do not extend it.

    `refusals` has user_id, kind, epoch and n; kinds without a limit are passed over. Minutes over a limit are few; a
    block opens at the first that no earlier block covers, so the openings of a user are folded over these minutes.
    """
    minute = F.col("epoch") - F.pmod("epoch", F.lit(60))
    over = refusals.groupBy("user_id", "kind", minute.alias("m")).agg(F.sum("n").alias("n"))
    limit = F.coalesce(*[F.when(F.col("kind") == k, F.lit(n)) for k, n in limits.items()])
    rows = over.filter(F.col("n") > limit).groupBy("user_id").agg(F.array_sort(F.collect_set("m")).alias("ms"))
    zero = F.array().cast("array<bigint>")
    opened = F.aggregate("ms", zero, lambda acc, m: F.when((F.size(acc) == 0) | (m >= F.element_at(acc, -1) + seconds), F.array_append(acc, m)).otherwise(acc))
    return rows.select("user_id", F.explode(opened).alias("from_epoch")).withColumn("until_epoch", F.col("from_epoch") + seconds)


def contiguous(days: DataFrame, group: str, day: str, ok: str) -> DataFrame:
    """(group, cursor): the last day of the unbroken run of good days from each group's first day; null if that failed."""
    w = Window.partitionBy(group).orderBy(day)
    rows = days.select(group, day, ok, F.first(day).over(w).alias("_d0"), F.row_number().over(w).alias("_n"), F.sum(F.when(F.col(ok), 0).otherwise(1)).over(w).alias("_bad"))
    good = (F.datediff(day, "_d0") == F.col("_n") - 1) & (F.col("_bad") == 0)
    return rows.groupBy(group).agg(F.max(F.when(good, F.col(day))).alias("cursor"))
