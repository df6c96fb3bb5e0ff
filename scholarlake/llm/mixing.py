"""Mixing sources to target weights by subset-sum budget fitting.

Each source has a budget of words. Whole passes over the source use most of it; the rest is fitted: documents are
counted by length, every length gives the same share of its documents, and what then remains goes to a
bounded-knapsack dynamic program over the lengths. Which documents of a length are taken depends on a seeded hash
only: of each length those of the least hashes, so the choice is one limit a length. The driver sees nothing that
grows with the documents.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholarlake.llm.common import n_words, saved

#: Words that are left to the dynamic program, in turn, until its sum is exact.
FREE = (1 << 16, 1 << 20, 1 << 24)
#: Sums that a dynamic program may hold, of 4 bytes each: up to half as many words a whole budget is searched, whatever its documents.
MOST_SUMS = 1 << 25
#: Parts of a (source, length) group, and parts of such a part, so that no group is ranked in one task.
BUCKETS = 64


def targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) from (source, source_size): shares of `share` times all words.

    Sources by code point, null last, have `weights`, repeating. A target stops at `most` times its source's
    size and the excess is shared again by weight until none is above. Sources are ranked by ranges, and each
    round of sharing is one sum, so there may be as many sources as documents.
    """
    last = F.col("source").isNull().cast("int")
    dealt = saved(sizes.select("source", "source_size").repartitionByRange(last, "source").withColumn("_part", F.spark_partition_id()), "mix-sources")
    before, at = {}, 0
    for r in dealt.groupBy("_part").agg(F.count("*").alias("n")).orderBy("_part").collect():  # a row a partition
        before[r["_part"]], at = at, at + r["n"]
    if not before:
        return sizes.select("source", "source_size", F.lit(0.0).alias("target"))
    offset = F.get(F.array(*[F.lit(before.get(i, 0)) for i in range(max(before) + 1)]), F.col("_part"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(F.col("source").isNull().cast("int"), "source")) - 1 + offset
    w = F.get(F.array(*[F.lit(float(x)) for x in weights]), (place % len(weights)).cast("int"))
    rows = saved(dealt.select("source", "source_size", w.alias("_w"), (F.lit(float(most)) * F.col("source_size")).alias("_cap")), "mix-weights")
    left, level = float(share) * (rows.agg(F.sum("source_size")).first()[0] or 0), 0.0
    over = F.lit(False)
    while True:  # the level a unit of weight gets; it only rises, as sources above their cap leave
        sums = rows.agg(F.sum(F.when(over, F.col("_cap"))).alias("cap"), F.sum(F.when(~over, F.col("_w"))).alias("w")).first()
        if not sums["w"]:
            break
        new = (left - (sums["cap"] or 0.0)) / sums["w"]
        if new <= level:
            break
        level = new
        over = F.col("_w") * level > F.col("_cap")
    return rows.select("source", "source_size", F.when(over, F.col("_cap")).otherwise(F.col("_w") * level).alias("target"))


def spread(lengths: np.ndarray, counts: np.ndarray, words: int) -> np.ndarray:
    """How many documents of each length (ascending) make up about `words` words, the same share of every length, never more.

    From the longest down; what a length is short of its share goes on to the next one.
    """
    take, total, asked, got = np.zeros(len(lengths), np.int64), int((lengths * counts).sum()), 0, 0
    for i in range(len(lengths) - 1, -1, -1):
        length, n = int(lengths[i]), int(counts[i])
        asked += n * length
        take[i] = min(n, max(0, (asked * words // total - got) // length))
        got += int(take[i]) * length
    return take


def knapsack(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray | None:
    """A bounded knapsack: how many documents of each length have the sum nearest to `budget`, on either side. None: too many sums.

    The table holds for each sum the first item that reached it. Items are 1, 2, 4, ... documents of a length, the
    longest first: any number of a length is a sum of these.
    """
    most = budget + min(budget, int(lengths.max()))  # no documents at all are as near as twice the budget
    if most > MOST_SUMS:
        return None
    first, items = np.full(most + 1, -1, np.int32), [(0, 0)]
    first[0] = 0
    for i in range(len(lengths) - 1, -1, -1):
        length = int(lengths[i])
        left, n = min(int(counts[i]), most // length), 1
        while left > 0 and first[budget] < 0:
            n = min(n, left)
            reached = np.flatnonzero((first[n * length :] < 0) & (first[: most + 1 - n * length] >= 0)) + n * length
            first[reached] = len(items)
            items.append((i, n))
            left, n = left - n, n * 2
        if first[budget] >= 0:
            break
    sums = np.flatnonzero(first >= 0)
    at = int(sums[np.argmin(np.abs(sums - budget))])
    take = np.zeros(len(lengths), np.int64)
    while at:
        i, n = items[first[at]]
        take[i] += n
        at -= n * int(lengths[i])
    return take


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length (ascending, positive) to take so that their words come as near to `budget` as can be, on either side.

    The same share of every length is taken for all but some words of the budget (FREE), and the dynamic program
    chooses among the documents that are left. If its sum is not exact, the program gets more words, and at last
    the whole budget. A result is exact, or the nearest that there is of a budget up to MOST_SUMS / 2 words, or else
    the nearest that these programs met.
    """
    total, budget = int((lengths * counts).sum()), int(budget)
    if budget >= total:
        return counts.copy()
    if budget <= 0:
        return np.zeros(len(lengths), np.int64)
    best, least = None, None
    for free in (*[f for f in FREE if f < budget], budget):
        share = spread(lengths, counts, budget - free)
        rest = budget - int((lengths * share).sum())
        take = knapsack(lengths, counts - share, rest)
        take = share if take is None else share + take
        gap = abs(budget - int((lengths * take).sum()))
        if least is None or gap < least:
            best, least = take, gap
        if gap < int(np.gcd.reduce(lengths)) / 2:
            break
    return best


def _rows(docs: DataFrame, seed: int, key: str, text: str, source: str) -> DataFrame:
    rows = docs.select(F.col(key).alias("key"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_key"))
    return rows.withColumn("draw", _draw(seed))


def _draw(seed: int) -> Column:
    """63 random bits that follow from a row's key and text."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), "key", "text_key"), 1)


def limits(rows: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> tuple[DataFrame, DataFrame]:
    """(goals, cuts) of the rows of a mix.

    goals: (source, source_size, target, passes), passes being whole passes over the source. cuts: a row per length of
    which some documents are taken once more: (source, size, upto, ties), those up to the limit `upto`, a struct
    (draw, key, text_key), null for all of them. `ties` of the equal rows at the limit are taken, null for all.
    """
    by_length = saved(rows.groupBy("source", "size").agg(F.count("*").alias("n")), "mix-lengths")
    goals = targets(by_length.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, share, most)
    goals = saved(goals.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-9)).otherwise(0).cast("long")), "mix-targets")
    parts = by_length.filter("size > 0").alias("a").join(goals.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source"))).select("a.source", "size", "n", F.round(F.col("target") - F.col("passes") * F.col("source_size")).cast("long").alias("rest"))

    def fitted(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size")
        n = pdf["n"].to_numpy(np.int64)
        take = fit(pdf["size"].to_numpy(np.int64), n, int(pdf["rest"].iloc[0]))
        return pdf[["source", "size"]].assign(take=take, every=take == n)

    take = saved(parts.groupBy("source").applyInPandas(fitted, "source string, size long, take long, every boolean").filter("`take` > 0"), "mix-take")
    return goals, saved(_cuts(rows, take), "mix-cuts")


def _cuts(rows: DataFrame, take: DataFrame) -> DataFrame:
    """The limits of `limits` for (source, size, take, every): the first `take` rows of a group in order of their draws.

    Draws fall into parts, and these into parts again. Of each only the counts are added up, and only the rows of the
    one part in which the count is reached are ranked.
    """
    part = lambda shift: F.shiftrightunsigned("draw", shift).bitwiseAND(F.lit(BUCKETS - 1)).cast("int")
    rows = rows.select("source", "size", "draw", "key", "text_key").withColumn("p1", part(57)).withColumn("p2", part(51))
    some = take.filter("not every").select(F.col("source").alias("_s"), F.col("size").alias("_z"), F.col("take").alias("left"))
    same = lambda a, b: a["source"].eqNullSafe(b["_s"]) & (a["size"] == b["_z"])
    cells = saved(rows.groupBy("source", "size", "p1", "p2").agg(F.count("*").alias("n")), "mix-cells")

    def reached(counts: DataFrame, name: str, left: DataFrame) -> DataFrame:
        """Of each group the part in which `left` is reached, and what is left of it there."""
        c = counts.join(left, same(counts, left)).drop("_s", "_z")
        before = F.coalesce(F.sum("n").over(Window.partitionBy("source", "size").orderBy(name).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        c = c.withColumn("_before", before).filter((F.col("_before") < F.col("left")) & (F.col("_before") + F.col("n") >= F.col("left")))
        return c.withColumn("left", F.col("left") - F.col("_before")).drop("_before", "n")

    one = reached(cells.groupBy("source", "size", "p1").agg(F.sum("n").alias("n")), "p1", some)
    one = one.select(F.col("source").alias("_s"), F.col("size").alias("_z"), F.col("p1").alias("_p1"), "left")
    two = reached(cells.join(one.drop("left"), same(cells, one) & (cells["p1"] == one["_p1"])).drop("_s", "_z", "_p1"), "p2", one.drop("_p1"))
    two = two.select(F.col("source").alias("_s"), F.col("size").alias("_z"), F.col("p1").alias("_p1"), F.col("p2").alias("_p2"), "left")
    inside = rows.join(two, same(rows, two) & (rows["p1"] == two["_p1"]) & (rows["p2"] == two["_p2"])).drop("_s", "_z")
    at = F.struct("draw", "key", "text_key")
    inside = inside.withColumn("at", at).withColumn("rank", F.row_number().over(Window.partitionBy("source", "size").orderBy("at")))
    reach = inside.groupBy("source", "size").agg(F.max(F.when(F.col("rank") <= F.col("left"), F.col("at"))).alias("upto"))
    reach = reach.select(F.col("source").alias("_s"), F.col("size").alias("_z"), "upto")
    equal = inside.join(reach, same(inside, reach)).filter(F.col("at") == F.col("upto")).groupBy("source", "size", "upto").agg(F.sum((F.col("rank") <= F.col("left")).cast("long")).alias("ties"), F.count("*").alias("_n"))
    upto = equal.select("source", "size", "upto", F.when(F.col("ties") < F.col("_n"), F.col("ties")).alias("ties"))
    none = F.lit(None)
    whole = take.filter("every").select("source", "size", none.cast(upto.schema["upto"].dataType).alias("upto"), none.cast("long").alias("ties"))
    return upto.unionByName(whole)


def _copies(rows: DataFrame, goals: DataFrame, cuts: DataFrame, whole: Column) -> DataFrame:
    """`rows` (of which `whole` tells two apart that have the same key and text) with source_size, target and copies. The tables of sources and lengths are joined as Spark sees fit by their sizes."""
    g = goals.select(F.col("source").alias("_gs"), "source_size", "target", "passes")
    c = cuts.select(F.col("source").alias("_cs"), F.col("size").alias("_cz"), F.lit(True).alias("_cut"), "upto", "ties")
    out = rows.join(g, F.col("source").eqNullSafe(F.col("_gs")), "left").join(c, F.col("source").eqNullSafe(F.col("_cs")) & (F.col("size") == F.col("_cz")), "left").drop("_gs", "_cs", "_cz")
    at = F.struct("draw", "key", "text_key")
    out = out.withColumn("_tie", F.coalesce((at == F.col("upto")) & F.col("ties").isNotNull(), F.lit(False)))
    extra = F.when(F.col("_cut") & (F.col("upto").isNull() | (at <= F.col("upto"))), 1).otherwise(0)
    plain = out.filter(~F.col("_tie")).withColumn("_extra", extra)
    # equal draws of which only some are taken, in order of the whole row; rows that are equal in all count as one row and its number
    tied = out.filter("_tie").withColumn("_whole", whole)
    names = [c for c in tied.columns if c not in ("source", "size", "_whole")]
    tied = tied.groupBy("source", "size", "_whole").agg(F.first(F.struct(*names)).alias("_r"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("source", "size").orderBy("_whole").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tied = tied.withColumn("_before", before).select("source", "size", "_r.*", "_before", F.explode(F.sequence(F.lit(1).cast("long"), "_n")).alias("_nth"))
    tied = tied.withColumn("_extra", F.when(F.col("_before") + F.col("_nth") <= F.col("ties"), 1).otherwise(0)).select(*plain.columns)
    copies = F.when(F.col("size") > 0, F.col("passes") + F.col("_extra")).otherwise(0).cast("long")
    return plain.unionByName(tied).withColumn("copies", copies).drop("passes", "upto", "ties", "_cut", "_tie", "_extra")


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 17, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """How often each row is taken: (key, source, size, text_key, source_size, target, copies).

    Size is the number of words; `copies` (a long, at most `most`) times size is what the mix takes of a row. A
    source's taken words are its target, but for what no set of its documents can make: see `fit`. Texts that
    are null or have no words, and all rows of a source without words, are taken 0 times. Null sources are one
    source, the last. Rows of the same key rank by their text's hash; repeated rows are rows of their own, and
    which of several equal ones is taken does not show.
    """
    rows = saved(_rows(docs, seed, key, text, source), "mix-rows")
    return _copies(rows, *limits(rows, weights, share, most), F.lit("")).drop("draw")


def taken(mixed: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken of what `mix` gives."""
    return mixed.select(F.col("key").alias("doc_id"), "size", F.col("source_size").cast("long"), "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def apply_mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 17, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """`docs` with every row repeated as often as `mix` takes it; rows taken 0 times go, and all columns stay.

    Rows are judged where they lie, against their source's goal and their length's limit, so texts are not shuffled
    unless those tables outgrow Spark's limit for sending them. Of rows of the same key, text and source, of which only some are
    taken, those of the least hashes of the whole row are: how the rows lie does not matter.
    """
    names = docs.columns
    slim = saved(_rows(docs, seed, key, text, source), "mix-rows")
    goals, cuts = limits(slim, weights, share, most)
    whole = docs.select(F.struct(*[docs[c] for c in names]).alias("_row"))
    at = lambda c: F.col("_row").getField(c)
    rows = whole.select("_row", at(key).alias("key"), at(source).alias("source"), n_words(at(text)).alias("size"), F.xxhash64(F.coalesce(at(text), F.lit(""))).alias("text_key"))
    rows = rows.withColumn("draw", _draw(seed))
    found = _copies(rows, goals, cuts, F.sha2(F.to_json("_row"), 256)).filter("copies > 0")
    return found.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("_copy")).select(*[at(c).alias(c) for c in names])
