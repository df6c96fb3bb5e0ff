"""The research profile: signals to topic scores, zones, review and merging."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholarlake.operators.likeness import Sets
from scholarlake.operators.retrieval import ranked, six_places
from scholarlake.sources.published import saved

LONG_HALF_LIFE, RECENT_HALF_LIFE = 120.0, 14.0
MIN_CONSISTENCY, MIN_SPAN, MIN_RECENT, MIN_RECENT_PAPERS, RECENT_DAYS, PAPER_SCALE = 0.5, 7.0, 0.6, 2, 30.0, 3.0
LIMITS = {"focus": 12, "exclude": 10, "recent": 10}


def decay(age_days: Column, half_life: float) -> Column:
    return F.pow(F.lit(0.5), age_days / half_life)


def strongest(signals: DataFrame) -> DataFrame:
    """Signals with `strongest`: of a paper, action and polarity within a topic only the surest one counts, the first of equals."""
    w = Window.partitionBy("user_id", "topic", "paper", "action", "polarity").orderBy(F.desc("confidence"), "event_id")
    return signals.withColumn("strongest", F.row_number().over(w) == 1)


def topic_scores(signals: DataFrame) -> DataFrame:
    """A row per user and topic: decayed evidence for and against, net, consistency, confidence, rank score, papers and span."""
    rows = strongest(signals)
    value = lambda weight, half_life: F.when(F.col("strongest"), F.col(weight) * F.col("confidence") * decay(F.col("age_days"), half_life)).otherwise(0.0)
    rows = rows.withColumns({"lv": value("long_weight", LONG_HALF_LIFE), "rv": value("recent_weight", RECENT_HALF_LIFE)})
    pos, neg = F.col("polarity") > 0, F.col("polarity") < 0
    total = lambda test, v: F.coalesce(F.sum(F.when(test, F.col(v))), F.lit(0.0))
    liked = pos & (F.col("lv") > 0)
    g = rows.groupBy("user_id", "topic").agg(
        total(pos, "lv").alias("lp"), total(neg, "lv").alias("ln"), total(pos, "rv").alias("rp"), total(neg, "rv").alias("rn"),
        F.count_distinct(F.when(liked, F.col("paper"))).alias("liked"), F.count_distinct(F.when(neg & (F.col("lv") > 0), F.col("paper"))).alias("disliked"),
        F.count_distinct(F.when(pos & (F.col("rv") > 0) & (F.col("action") != "view") & (F.col("age_days") <= RECENT_DAYS), F.col("paper"))).alias("recent"),
        F.coalesce((F.max(F.when(liked, F.col("epoch"))) - F.min(F.when(liked, F.col("epoch")))) / 86400.0, F.lit(0.0)).alias("span"), F.min(F.col("action") == "view").alias("only_read"),
    )
    both, net = F.col("lp") + F.col("ln"), F.col("lp") - F.col("ln")
    consistency = F.when(both > 0, F.abs(net) / both).otherwise(0.0)
    papers = F.when(net >= 0, F.col("liked")).otherwise(F.col("disliked"))
    confidence = consistency * (1 - F.exp(-papers / PAPER_SCALE))
    r = lambda c, name, n=4: F.round(c, n).alias(name)
    return g.select("user_id", "topic", r(F.col("lp"), "long_pos"), r(F.col("ln"), "long_neg"), r(net, "net"), r(F.col("rp") - F.col("rn"), "recent_net"), r(consistency, "consistency"), r(confidence, "confidence"), r(F.abs(net) * confidence, "rank_score"), "liked", "disliked", "recent", r(F.col("span"), "span_days", 2), "only_read")


def zones(scores: DataFrame) -> DataFrame:
    """(user_id, topic, zone, place, kept): lasting focus, exclusions and recent interest; those beyond a zone's limit are marked as not kept."""
    sure = F.col("consistency") >= MIN_CONSISTENCY
    zone = F.when((F.col("net") > 0) & sure & (F.col("liked") >= 1) & (F.col("span_days") >= MIN_SPAN), "focus").when((F.col("net") < 0) & sure & (F.col("disliked") >= 1), "exclude")
    evidence = F.col("long_pos") + F.col("long_neg")
    recent = (F.col("recent_net") >= MIN_RECENT) & ~F.col("only_read") & ~((evidence > 0) & ~sure) & (F.col("recent") >= MIN_RECENT_PAPERS)
    rows = scores.withColumn("zone", zone)
    in_zone = F.when(F.col("zone").isNotNull(), F.struct(F.col("zone").alias("zone"), F.col("rank_score").alias("by")))
    is_recent = F.when(recent & (F.coalesce("zone", F.lit("")) != "exclude"), F.struct(F.lit("recent").alias("zone"), F.col("recent_net").alias("by")))
    placed = rows.select("user_id", "topic", F.explode(F.array_compact(F.array(in_zone, is_recent))).alias("z")).select("user_id", "topic", "z.zone", "z.by")
    placed = placed.withColumn("place", F.row_number().over(Window.partitionBy("user_id", "zone").orderBy(F.desc("by"), "topic")).cast("long"))
    limit = reduce(lambda out, kv: F.when(F.col("zone") == kv[0], kv[1]).otherwise(out), LIMITS.items(), F.lit(0))
    return placed.select("user_id", "topic", "zone", "place", (F.col("place") <= limit).alias("kept"))


def review(scores: DataFrame) -> DataFrame:
    """(user_id, topics, warnings, quality, approved)."""
    g = scores.groupBy("user_id").agg(F.count("*").alias("topics"), F.count(F.when(F.col("consistency") < MIN_CONSISTENCY, 1)).alias("warnings"), F.sum("liked").alias("signals"))
    q = 0.5 + F.least(F.lit(0.35), 0.05 * F.col("signals")) - F.least(F.lit(0.3), 0.06 * F.col("warnings"))
    g = g.withColumn("quality", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), q)), 4))
    return g.select("user_id", "topics", "warnings", "quality", (F.col("quality") >= 0.45).alias("approved"))


def merged(sources: Sequence[DataFrame], key: Sequence[str]) -> DataFrame:
    """The row of each key from the first source that has it."""
    rows = reduce(DataFrame.unionByName, [s.withColumn("_p", F.lit(i)) for i, s in enumerate(sources)])
    names = [c for c in sources[0].columns if c not in key]
    return rows.groupBy(*key).agg(F.min(F.struct("_p", *names)).alias("_r")).select(*key, *[F.col(f"_r.{c}").alias(c) for c in names])


#: Topics that are sent to all tasks at once.
MOST_TOPICS = 1 << 16


def similar_topics(topics: DataFrame, concepts: DataFrame, least: float = 0.55) -> DataFrame:
    """(item_id, doc_id, similarity): the other concept most like each topic, by shared over all tokens, if at least `least`.

    `topics` is a stated set. It is counted, and sent to all tasks in parts; concepts pass it and a task keeps the best of each topic, so no
    pair is shuffled. Of concepts with the same tokens only the first two are compared, since one of them may be the topic itself.
    """
    words = lambda c: F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))))
    t = saved(topics.filter("item_id is not null").select("item_id", words(F.col("text")).alias("t")).filter(F.size("t") > 0), "topics")
    c = concepts.filter("doc_id is not null").select("doc_id", words(F.col("text")).alias("b")).filter(F.size("b") > 0)
    c = ranked(c, ["b"], F.asc("doc_id"), n=2).select("doc_id", F.col("b").alias("t"))
    parts = max(1, -(-t.count() // MOST_TOPICS))
    place = F.pmod(F.xxhash64("item_id"), F.lit(parts))
    schema = f"item_id {dict(t.dtypes)['item_id']}, doc_id {dict(c.dtypes)['doc_id']}, similarity double"

    def part(rows: DataFrame) -> DataFrame:
        sent = rows.toArrow()

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = Nearest(sent, least) if sent.num_rows else None
            for batch in batches if best else ():
                best.meet(batch)
            if best:
                yield best.found()

        return c.mapInArrow(each, schema)

    best = reduce(DataFrame.unionByName, [part(t if parts == 1 else t.filter(place == i)) for i in range(parts)])
    best = best.groupBy("item_id").agg(F.max(F.struct("similarity", (-F.col("doc_id")).alias("d"))).alias("b"))
    return best.select("item_id", (-F.col("b.d")).alias("doc_id"), F.col("b.similarity").alias("similarity"))


class Nearest:
    """The concept most like each topic of (item_id, t) among those that it has met."""

    def __init__(self, topics: pa.Table, least: float):
        self.least, self.kinds, self.item = least, topics.schema.field("item_id").type, topics.column("item_id").to_numpy()
        self.sets = Sets(topics.column("t").combine_chunks(), least)
        self.best, self.doc = np.zeros(len(self.item)), np.zeros(len(self.item), np.int64)

    def meet(self, concepts: pa.RecordBatch) -> None:
        """Compares concepts (doc_id, t)."""
        doc = concepts.column("doc_id").to_numpy()
        can = lambda c, t, most: (most >= np.maximum(self.best[t], self.least) - 2e-6) & (self.item[t] != doc[c])
        for c, t, like in self.sets.pairs(concepts.column("t"), can):
            like = six_places(like)
            order = np.lexsort((doc[c], -like, t))
            order = order[like[order] >= self.least]
            order = order[np.flatnonzero(np.diff(t[order], prepend=-1))]
            like, c, t = like[order], c[order], t[order]
            better = (like > self.best[t]) | ((like == self.best[t]) & (doc[c] < self.doc[t]))
            self.best[t[better]], self.doc[t[better]] = like[better], doc[c[better]]

    def found(self) -> pa.RecordBatch:
        """(item_id, doc_id, similarity) of the topics that have met a concept like them."""
        some = np.flatnonzero(self.best > 0)
        return pa.RecordBatch.from_arrays([pa.array(self.item[some], self.kinds), pa.array(self.doc[some]), pa.array(self.best[some])], names=["item_id", "doc_id", "similarity"])
