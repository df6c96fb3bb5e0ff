"""Interest vectors and negative profiles: what users like and dislike, as vectors.

All of it is keyed by user: means are summed over vectors that are streamed in the order of users, and a user's examples and clusters are few by
rule, so the set that a candidate is compared with is one bounded row beside it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from scholarlake.operators.recommend import norm, normalised
from scholarlake.operators.retrieval import MOST_QUERIES, Vectors, cosine, ranked, six_places

#: Papers that a clustering and a cluster need, clusters that are kept, and examples of what is disliked.
LEAST, LEAST_OF_CLUSTER, MOST_CLUSTERS, MOST_EXAMPLES = 4, 2, 4, 20


#: Vectors that are added up at once.
ADDED = 1024


def unit_means(rows: DataFrame, *group: str) -> DataFrame:
    """(*group, n, vector): the mean of unit vectors `u`, of length one again. Null elements, and vectors that are null or empty, count nothing.

    Rows are sorted by their group and streamed: a task keeps the sum of one group, however many vectors a group or a task has.
    """
    dealt = rows.select(*group, "u").repartition(*group).sortWithinPartitions(*group)
    schema = StructType([*[StructField(g, dealt.schema[g].dataType) for g in group], StructField("n", LongType()), StructField("_v", ArrayType(DoubleType()))])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, last = None, None
        for batch in batches:
            kinds = kinds or [batch.schema.field(g).type for g in group]
            for at in range(0, batch.num_rows, ADDED):
                done = []
                for found in _sums(batch.slice(at, ADDED), group):
                    if last is not None and last[0] == found[0]:
                        last = found[0], last[1] + found[1], _padded(last[2], found[2]), _padded(last[3], found[3])
                    else:
                        done += [last] if last is not None else []
                        last = found
                if done:
                    yield _averages(done, group, kinds)
        if last is not None:
            yield _averages([last], group, kinds)

    return dealt.mapInArrow(each, schema).select(*group, "n", normalised(F.col("_v")).alias("vector"))


def _padded(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sum of two arrays, the shorter one continued by zeros."""
    long, short = (a, b) if len(a) >= len(b) else (b, a)
    out = long.copy()
    out[: len(short)] += short
    return out


def _sums(part: pa.RecordBatch, group: Sequence[str]) -> Iterator[tuple[tuple, int, np.ndarray, np.ndarray]]:
    """(group, vectors, sum, numbers that were added for each element) of each run of rows of a group."""
    sizes = pc.fill_null(pc.list_value_length(part.column("u")), 0).to_numpy(zero_copy_only=False)
    part, sizes = part.filter(pa.array(sizes > 0)), sizes[sizes > 0]
    if not len(sizes):
        return
    flat = pc.list_flatten(part.column("u"))
    where = np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    value, there = np.zeros((len(sizes), sizes.max())), np.zeros((len(sizes), sizes.max()), np.int64)
    value[where] = pc.fill_null(flat, 0.0).to_numpy(zero_copy_only=False)
    there[where] = flat.is_valid().to_numpy(zero_copy_only=False)
    codes = np.stack([part.column(g).dictionary_encode(null_encoding="encode").indices.to_numpy() for g in group])
    first = np.flatnonzero(np.r_[True, (codes[:, 1:] != codes[:, :-1]).any(0)])
    keys = zip(*[part.column(g).take(pa.array(first)).to_pylist() for g in group], strict=True)
    width = np.maximum.reduceat(sizes, first)
    runs = np.diff(np.r_[first, len(sizes)])
    for key, n, w, total, added in zip(keys, runs, width, np.add.reduceat(value, first, axis=0), np.add.reduceat(there, first, axis=0), strict=True):
        yield key, int(n), total[:w], added[:w]


def _averages(sums: list[tuple], group: Sequence[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    means = [[t / n if n else None for t, n in zip(total.tolist(), added.tolist(), strict=True)] for _, _, total, added in sums]
    keys = [pa.array([k[i] for k, *_ in sums], kind) for i, kind in enumerate(kinds)]
    return pa.RecordBatch.from_arrays([*keys, pa.array([n for _, n, _, _ in sums], pa.int64()), pa.array(means, pa.list_(pa.float64()))], names=[*group, "n", "_v"])


def clusters(members: DataFrame, least: int = LEAST, most: int = MOST_CLUSTERS) -> DataFrame:
    """(user_id, number, cluster, n, vector): the largest clusters of each user that has enough papers, by size and then the least paper.

    `members` is (user_id, vec_id, u, cluster): a paper once a user, its unit vector, and the cluster that a clustering put it in, null or
    negative for none.
    """
    sizes = members.groupBy("user_id").agg(F.count("*").alias("_n")).filter(F.col("_n") >= max(2, least)).select(F.col("user_id").alias("_u"))
    kept = members.filter("cluster >= 0").join(sizes, F.col("user_id") == F.col("_u"), "left_semi")
    first = kept.groupBy("user_id", "cluster").agg(F.min("vec_id").alias("first"), F.count("*").alias("size")).filter(F.col("size") >= LEAST_OF_CLUSTER)
    numbered = ranked(first, ["user_id"], F.desc("size"), F.asc("first"), n=most, name="number").select("user_id", (F.col("number") - 1).alias("number"), "cluster")
    return unit_means(kept.join(numbered, ["user_id", "cluster"]), "user_id", "number", "cluster")


def interest(members: DataFrame, least: int = LEAST, most: int = MOST_CLUSTERS) -> DataFrame:
    """(user_id, kind, number, n, vector): of each user the mean of all papers, the clusters, and the mean of those that are in none.

    `members` as in `clusters`. A user with fewer papers than a clustering needs has the mean only; a paper alone in its cluster is in none.
    """
    found = clusters(members, least, most)
    enough = members.groupBy("user_id").agg(F.count("*").alias("_n")).filter(F.col("_n") >= max(2, least)).select(F.col("user_id").alias("_u"))
    sizes = members.groupBy("user_id", "cluster").agg(F.count("*").alias("_n")).select(F.col("user_id").alias("_a"), F.col("cluster").alias("_b"), "_n")
    loose = members.join(sizes, (F.col("user_id") == F.col("_a")) & F.col("cluster").eqNullSafe(F.col("_b"))).filter((F.col("_n") < LEAST_OF_CLUSTER) | F.coalesce(F.col("cluster") < 0, F.lit(True)))
    loose = loose.join(enough, F.col("user_id") == F.col("_u"), "left_semi").select("user_id", "u")
    rows = unit_means(members, "user_id").select("user_id", F.lit("mean").alias("kind"), F.lit(0).cast("long").alias("number"), "n", "vector")
    rows = rows.unionByName(found.select("user_id", F.lit("cluster").alias("kind"), F.col("number").cast("long").alias("number"), "n", "vector"))
    return rows.unionByName(unit_means(loose, "user_id").select("user_id", F.lit("weak").alias("kind"), F.lit(0).cast("long").alias("number"), "n", "vector"))


def negative_profiles(disliked: DataFrame, members: DataFrame, least: int = LEAST, most: int = MOST_CLUSTERS, examples: int = MOST_EXAMPLES) -> DataFrame:
    """(user_id, mode, total_disliked, usable_disliked, clusters, examples): clusters and examples as arrays of vectors, few by rule.

    `disliked` is (user_id, vec_id), all papers that a user dislikes; `members` those of them with a vector (user_id, vec_id, u,
    cluster, latest). Examples are the latest. Modes: clusters; cluster_fallback_examples if there were enough papers but no
    cluster; examples; none.
    """
    counts = disliked.groupBy("user_id").agg(F.count_distinct("vec_id").alias("total_disliked"))
    usable = members.groupBy(F.col("user_id").alias("_u")).agg(F.count("*").alias("usable_disliked"))
    last = ranked(members, ["user_id"], F.desc("latest"), F.asc("vec_id"), n=examples, name="_r")
    last = last.groupBy(F.col("user_id").alias("_e")).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "u"))), lambda x: x["u"]).alias("examples"))
    found = clusters(members, least, most)
    found = found.groupBy(F.col("user_id").alias("_c")).agg(F.transform(F.array_sort(F.collect_list(F.struct("number", "vector"))), lambda x: x["vector"]).alias("clusters"))
    rows = counts.join(usable, F.col("user_id") == F.col("_u"), "left").join(last, F.col("user_id") == F.col("_e"), "left").join(found, F.col("user_id") == F.col("_c"), "left")
    n = F.coalesce("usable_disliked", F.lit(0).cast("long"))
    mode = F.when(F.col("clusters").isNotNull(), "clusters").when(n >= max(2, least), "cluster_fallback_examples").when(F.col("examples").isNotNull(), "examples").otherwise("none")
    none = F.array().cast("array<array<double>>")
    return rows.select("user_id", mode.alias("mode"), "total_disliked", n.alias("usable_disliked"), F.coalesce("clusters", none).alias("clusters"), F.coalesce("examples", none).alias("examples"))


def negative_similarity(vector: Column, clusters: Column, examples: Column, provided: Column, legacy: Column) -> tuple[Column, Column]:
    """(similarity, source): the greatest cosine to a user's negative clusters; without any to the examples; without a profile to the mean of what is disliked."""

    def best(vectors: Column) -> Column:
        return F.array_max(F.transform(vectors, lambda x: F.round(cosine(vector, x, norm(vector) * norm(x)), 6)))

    mean = F.round(cosine(vector, legacy, norm(vector) * norm(legacy)), 6)
    has = lambda a: F.coalesce(F.size(a) > 0, F.lit(False))
    by_mean = ~F.coalesce(provided, F.lit(False)) & legacy.isNotNull()
    like = F.when(has(clusters), best(clusters)).when(has(examples), best(examples)).when(by_mean, mean).otherwise(0.0)
    return like, F.when(has(clusters), "negative_cluster").when(has(examples), "negative_example").when(by_mean, "legacy_disliked_vector").otherwise("none")


def negative_similarities(users: DataFrame, asked: DataFrame) -> DataFrame:
    """(user_id, vec_id, similarity, source) of all users and a stated set of vectors (vec_id, v): the greatest cosine to a user's negative clusters;
    without any to the examples; without a profile to the mean of what is disliked.

    `users` has user_id, clusters, examples, provided and legacy. The vectors are counted, and sent to all tasks in parts; a task multiplies
    a few users' vectors with all of a part. Only what is within reach of a rounding is summed in order, so results stay the same to the last place.
    """
    has = lambda a: F.coalesce(F.size(a) > 0, F.lit(False))
    by_mean = ~F.coalesce(F.col("provided"), F.lit(False)) & F.col("legacy").isNotNull()
    use = F.when(has("clusters"), F.col("clusters")).when(has("examples"), F.col("examples")).when(by_mean, F.array("legacy"))
    source = F.when(has("clusters"), "negative_cluster").when(has("examples"), "negative_example").when(by_mean, "legacy_disliked_vector").otherwise("none")
    rows = users.select("user_id", use.alias("use"), source.alias("source"))
    # few rows with much to do each: a stated number of partitions
    rows = rows.repartition(int(users.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("user_id"))
    parts = max(1, -(-asked.count() // MOST_QUERIES))
    place = F.pmod(F.xxhash64("vec_id"), F.lit(parts))
    return reduce(DataFrame.unionByName, [_beside(rows, asked if parts == 1 else asked.filter(place == i)) for i in range(parts)])


#: Users whose vectors are multiplied at once, and how near to a rounding a product of matrices may be trusted.
USERS, REACH = 32, 1e-4


def _beside(users: DataFrame, asked: DataFrame) -> DataFrame:
    sent = asked.select("vec_id", "v").toArrow()
    schema = f"user_id {dict(users.dtypes)['user_id']}, vec_id {dict(asked.dtypes)['vec_id']}, similarity double, source string"

    def vectors(ids: pa.Array, column: pa.Array) -> Vectors:
        out = Vectors(ids, column, pa.array(np.zeros(len(ids))))
        for at, m in out.of.values():
            out.norms[at] = np.sqrt(_in_order(m, m))
        return out

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = vectors(sent.column("vec_id").combine_chunks(), sent.column("v").combine_chunks())
        ids = sent.column("vec_id").combine_chunks()
        for batch in batches:
            for first in range(0, batch.num_rows, USERS):
                part = batch.slice(first, USERS)
                sizes = pc.fill_null(pc.list_value_length(part.column("use")), 0).to_numpy(zero_copy_only=False)
                flat = part.column("use").flatten()
                like = _greatest(q, vectors(pa.array(np.arange(len(flat))), flat), sizes)
                n = len(ids)
                who = pa.array(np.repeat(np.arange(part.num_rows), n))
                yield pa.RecordBatch.from_arrays([part.column("user_id").take(who), ids.take(pa.array(np.tile(np.arange(n), part.num_rows))), pa.array(like.reshape(-1)), part.column("source").take(who)], names=["user_id", "vec_id", "similarity", "source"])

    return users.mapInArrow(each, schema)


def _in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of products of rows, element after element: the order decides the last places."""
    total = np.zeros(len(a))
    for d in range(a.shape[1]):
        total += a[:, d] * b[:, d]
    return total


def _greatest(q: Vectors, v: Vectors, sizes: np.ndarray) -> np.ndarray:
    """(users, queries): the greatest cosine of each query and a user's `sizes` vectors, cut to 0..1 and rounded to 6 places; 0 without any."""
    cosine = np.zeros((len(v.ids), len(q.ids)))
    for size in q.of.keys() & v.of.keys():
        (i, a), (j, b) = v.of[size], q.of[size]
        norms = np.outer(v.norms[i], q.norms[j])
        cosine[np.ix_(i, j)] = np.divide(a @ b.T, norms, out=np.zeros_like(norms), where=norms > 0)
    out, some = np.zeros((len(sizes), len(q.ids))), np.flatnonzero(sizes)
    starts = np.r_[0, np.cumsum(sizes)]
    if len(some):
        out[some] = np.fmin(np.maximum(np.maximum.reduceat(cosine, starts[some], axis=0), 0.0), 1.0)
    scaled = out * 1e6
    for who, k in zip(*np.nonzero(np.abs(scaled - np.floor(scaled) - 0.5) < REACH), strict=True):
        exact = 0.0
        for x in range(starts[who], starts[who + 1]):
            for size in q.of.keys() & v.of.keys():
                (i, a), (j, b) = v.of[size], q.of[size]
                at, of = np.flatnonzero(i == x), np.flatnonzero(j == k)
                norms = v.norms[x] * q.norms[k]
                if len(at) and len(of) and norms > 0:
                    exact = max(exact, min(float(_in_order(b[of], a[at])[0]) / norms, 1.0))
        out[who, k] = exact
    return six_places(out.reshape(-1)).reshape(out.shape)
