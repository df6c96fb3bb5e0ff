"""Recommendation: recall, scoring with negative feedback, adjustments and diversification."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholarlake.operators.retrieval import cosine, ranked
from scholarlake.sources.published import saved

SEMANTIC, CATEGORY, RECENCY = 0.65, 0.08, 0.05
#: Negative feedback: from this similarity on, how near to the positive one, weight, cap, and examples for full confidence.
THRESHOLD, MARGIN, WEIGHT, CAP, EXAMPLES = 0.64, 0.10, 0.15, 0.22, 6


def mean_vector(vectors: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, mean, n): the mean of each group's vectors, element by element, summed map-side."""
    rows = vectors.select(group, F.posexplode(vector).alias("i", "x")).groupBy(group, "i").agg(F.avg("x").alias("m"), F.count("*").alias("n"))
    return rows.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda p: p["m"]).alias("mean"), F.max("n").alias("n"))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))


def normalised(v: Column) -> Column:
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v)


#: Centroids that are sent to all tasks at once; more are dealt in parts.
MOST_CENTROIDS = 4096


def _against(vectors: DataFrame, centroids: DataFrame, pick: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What `pick` keeps of vectors beside centroids (cluster, mean, _cn), one part of the counted centroids after the other."""
    sent = centroids.select("cluster", "mean", norm(F.col("mean")).alias("_cn"), F.lit(1).alias("_one"))
    parts = max(1, -(-sent.count() // MOST_CENTROIDS))
    rows = vectors.withColumn("_one", F.lit(1))
    place = F.pmod(F.xxhash64("cluster"), F.lit(parts))
    return reduce(DataFrame.unionByName, [pick(rows.join(F.broadcast(sent if parts == 1 else sent.filter(place == i)), "_one")) for i in range(parts)])


def best_match(candidates: DataFrame, centroids: DataFrame, key: str, vector: str, name: str) -> DataFrame:
    """(key, name_cluster, name_similarity): the centroid most like each candidate, of (cluster, mean)."""
    s = F.round(cosine(F.col(vector), F.col("mean"), norm(F.col(vector)) * F.col("_cn")), 6)
    best = _against(candidates, centroids, lambda rows: rows.select(key, s.alias("s"), "cluster").groupBy(key).agg(F.max(F.struct("s", (-F.col("cluster")).alias("c"))).alias("b")))
    best = best.groupBy(key).agg(F.max("b").alias("b"))
    return best.select(key, (-F.col("b.c")).alias(f"{name}_cluster"), F.col("b.s").alias(f"{name}_similarity"))


def nearest_of(vectors: DataFrame, centroids: DataFrame, per_cluster: int) -> DataFrame:
    """(cluster, vec_id, s): the vectors nearest to every cluster, of all vectors."""
    s = F.round(cosine(F.col("v"), F.col("mean"), F.col("norm") * F.col("_cn")), 6)
    rows = _against(vectors, centroids, lambda rows: rows.select("vec_id", "cluster", s.alias("s")))  # a cluster is in one part
    return ranked(rows, ["cluster"], F.desc("s"), F.asc("vec_id"), n=per_cluster).select("cluster", "vec_id", "s")


def recall(vectors: DataFrame, centroids: DataFrame, per_cluster: int) -> DataFrame:
    """(vec_id, best_cluster, similarity, n_clusters): the nearest of every cluster, merged by paper."""
    top = nearest_of(vectors, centroids, per_cluster)
    g = top.groupBy("vec_id").agg(F.max(F.struct("s", (-F.col("cluster")).alias("c"))).alias("b"), F.count("*").alias("n_clusters"))
    return g.select("vec_id", (-F.col("b.c")).alias("best_cluster"), F.col("b.s").alias("similarity"), "n_clusters")


def candidates(users: DataFrame, liked: DataFrame, vectors: DataFrame, centroids: DataFrame, per_cluster: int, newest: int) -> DataFrame:
    """(user_id, vec_id): the nearest vectors to each cluster that a user has liked an item of; for a user without one the newest.

    `users` (user_id), `liked` (user_id, vec_id), `vectors` (vec_id, label, v, norm), `centroids` (cluster, mean).
    """
    interest = _interest(liked, vectors)
    found = interest.join(nearest_of(vectors, centroids, per_cluster), "cluster").select("user_id", "vec_id").distinct()
    last = _newest(vectors, newest).withColumn("_one", F.lit(1))
    lone = users.select("user_id").distinct().join(interest.select("user_id").distinct(), "user_id", "left_anti").withColumn("_one", F.lit(1))
    return found.unionByName(lone.join(F.broadcast(last), "_one").select("user_id", "vec_id"))


def _interest(liked: DataFrame, vectors: DataFrame) -> DataFrame:
    return liked.join(vectors.select("vec_id", F.col("label").alias("cluster")), "vec_id").select("user_id", "cluster").distinct()


def _newest(vectors: DataFrame, n: int) -> DataFrame:
    return vectors.select("vec_id").orderBy(F.desc("vec_id")).limit(n)


def candidate_groups(users: DataFrame, liked: DataFrame, vectors: DataFrame, centroids: DataFrame, per_cluster: int, newest: int) -> tuple[DataFrame, DataFrame]:
    """(user_id, groups) and (vec_id, groups): a vector is one of a user's `candidates` if both have a group in common. A group is a cluster, or "newest".

    So what is recalled is a row a user and a row a vector, and no row a pair.
    """
    name = F.col("cluster").cast("string")
    interest = _interest(liked, vectors).filter("cluster is not null").groupBy("user_id").agg(F.collect_set(name).alias("groups"))
    of_users = users.select("user_id").distinct().join(interest, "user_id", "left").withColumn("groups", F.coalesce("groups", F.array(F.lit("newest"))))
    near = nearest_of(vectors, centroids, per_cluster).select("vec_id", name.alias("g")).unionByName(_newest(vectors, newest).select("vec_id", F.lit("newest").alias("g")))
    return of_users, near.groupBy("vec_id").agg(F.collect_set("g").alias("groups"))


def recency(days: Column) -> Column:
    return 1.0 / (1.0 + F.greatest(days, F.lit(0)) / 365.0)


def penalty(positive: Column, negative: Column, examples: Column) -> Column:
    """What negative feedback takes off: how far over the threshold, and how near to the positive similarity, by confidence, up to a cap."""
    over = (negative - THRESHOLD) / (1 - THRESHOLD) * WEIGHT
    edge = positive - MARGIN
    near = F.when(negative > edge, (negative - edge) / MARGIN * WEIGHT).otherwise(0.0)
    sure = F.least(F.lit(1.0), examples / EXAMPLES)
    return F.when(negative > THRESHOLD, F.least(F.lit(CAP), (over + near) * sure)).otherwise(0.0)


def base_score(semantic: Column, category: Column, fresh: Column, minus: Column) -> Column:
    return SEMANTIC * semantic + CATEGORY * category + RECENCY * fresh - minus


def choose(score: np.ndarray, key: np.ndarray, cluster: np.ndarray, vector: np.ndarray, n: int, relevance: float = 0.75, semantic: float = 0.7) -> list[int]:
    """Greedy choice for one user, places in order: the best of each cluster first, then the best mix of relevance and distance from what is chosen."""
    rank = np.lexsort((key, -score))
    s, cluster, m = score[rank], cluster[rank], vector[rank]
    rel = np.ones(len(s)) if np.ptp(s) == 0 else (s - s.min()) / np.ptp(s)
    size = np.linalg.norm(m, axis=1, keepdims=True)
    m = np.divide(m, size, out=np.zeros_like(m), where=size > 0)
    kinds, of = np.unique(cluster, return_inverse=True)
    seen, times, order, like = set(), np.zeros(len(kinds)), [], np.zeros(len(s))

    def take(i: int) -> None:
        nonlocal like
        order.append(i)
        like = np.maximum(like, np.clip(m @ m[i], 0, 1))
        times[of[i]] += 1

    for i in range(len(s)):
        if len(order) >= n or len(seen) == len(kinds):
            break
        if of[i] not in seen:
            seen.add(of[i])
            take(i)
    while len(order) < min(n, len(s)):
        mix = relevance * rel + (1 - relevance) * (semantic * (1 - like) + (1 - semantic) * (1 - np.minimum(times / 3, 1.0)[of]))
        mix[order] = -np.inf
        take(int(np.argmax(np.round(mix, 9))))
    return rank[order].tolist()


def _pick(rows: pd.DataFrame, n: int, relevance: float, semantic: float) -> pd.DataFrame:
    order = choose(rows["score"].to_numpy(float), rows["vec_id"].to_numpy(), rows["cluster"].to_numpy(), np.stack(rows["v"].to_numpy()).astype(float), n, relevance, semantic)
    return rows.iloc[order][["user_id", "vec_id", "cluster", "score"]].assign(selection_rank=range(1, len(order) + 1))


def diversify(candidates: DataFrame, vectors: DataFrame, n: int, relevance: float = 0.75, semantic: float = 0.7) -> DataFrame:
    """(user_id, vec_id, cluster, score, selection_rank): a varied choice from all of each user's candidates (user_id, vec_id, cluster, score).

    Recall bounds the candidates of a user: so many for each cluster. They are dealt by user without their vectors (vec_id, v); those that
    are candidates at all join them afterwards, sent to all tasks if they are as few as recall makes them.
    """
    kinds = dict(candidates.dtypes)
    rows = saved(candidates.select("user_id", "vec_id", "cluster", "score"), "candidates")
    held = vectors.select("vec_id", "v").join(rows.select("vec_id").distinct(), "vec_id", "left_semi")
    dealt = rows.repartition("user_id").sortWithinPartitions("user_id")
    both = dealt.join(F.broadcast(held) if held.count() <= MOST_CENTROIDS else held, "vec_id")
    return both.groupBy("user_id").applyInPandas(lambda g: _pick(g, n, relevance, semantic), f"user_id {kinds['user_id']}, vec_id {kinds['vec_id']}, cluster {kinds['cluster']}, score double, selection_rank long")
