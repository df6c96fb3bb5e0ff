"""Keyword and vector retrieval, fusion and context expansion over chunk tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from decimal import ROUND_HALF_UP, Decimal
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K1, B = 1.5, 0.75
RRF_K = 60


def postings(docs: DataFrame, key: str, tokens: Column) -> DataFrame:
    """(token, key, tf, length): a row per document and token; the length is that of the whole token list."""
    rows = docs.select(key, tokens.alias("_t")).select(key, F.size("_t").cast("long").alias("length"), F.explode("_t").alias("token"))
    return rows.groupBy("token", key, "length").agg(F.count("*").alias("tf"))


def weighted_postings(docs: DataFrame, key: str, fields: dict[str, tuple[Column, float]]) -> DataFrame:
    """Postings of several fields: tf is the sum of the fields' counts by weight, length the rounded weighted length, 1 at least."""
    lengths = [F.size(t) * w for t, w in fields.values()]
    length = F.greatest(F.bround(sum(lengths[1:], lengths[0])), F.lit(1.0)).cast("long")
    rows = docs.select(key, length.alias("length"), F.explode(F.concat(*[_weighed(t, w) for t, w in fields.values()])).alias("p"))
    return rows.groupBy(F.col("p.token").alias("token"), key, "length").agg(F.sum("p.weight").alias("tf"))


def _weighed(tokens: Column, weight: float) -> Column:
    return F.transform(tokens, lambda t: F.struct(t.alias("token"), F.lit(float(weight)).alias("weight")))


def collection_stats(docs: DataFrame, tokens: Column) -> DataFrame:
    """(n_docs, avg_length) of the documents that have tokens or not."""
    return docs.select(F.size(tokens).alias("n")).agg(F.count("*").alias("n_docs"), F.avg("n").alias("avg_length"))


def ranked(rows: DataFrame, group: Sequence[str], *order: Column, n: int | None = None, name: str = "rank") -> DataFrame:
    out = rows.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("long"))
    return out if n is None else out.filter(F.col(name) <= n)


def min_max(rows: DataFrame, group: Sequence[str], column: str, to: str = "normal") -> DataFrame:
    """A column scaled to 0..1 within a group; 1 if all are equal."""
    w = Window.partitionBy(*group)
    low, high = F.min(column).over(w), F.max(column).over(w)
    return rows.withColumn(to, F.when(high == low, 1.0).otherwise((F.col(column) - low) / (high - low)))


def fuse(routes: DataFrame, weights: dict[str, float], key: str, k: int = RRF_K, multiplier: Column | None = None) -> DataFrame:
    """(query_id, key, score, n_routes): weighted reciprocal ranks, summed over the routes."""
    weight = F.coalesce(*[F.when(F.col("route") == r, F.lit(w)) for r, w in weights.items()], F.lit(1.0))
    vote = weight / (F.lit(k) + F.col("rank")) * (F.lit(1.0) if multiplier is None else multiplier)
    return routes.groupBy("query_id", key).agg(F.sum(vote).alias("score"), F.count_distinct("route").alias("n_routes"))


def cosine(a: Column, b: Column, norms: Column) -> Column:
    """Cosine cut to 0..1; 0 where lengths differ or a norm is 0. `norms` is the product of both norms."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return F.when((F.size(a) == F.size(b)) & (norms > 0), F.least(F.lit(1.0), F.greatest(F.lit(0.0), dot / norms))).otherwise(F.lit(0.0))


#: Query vectors that are sent to all tasks at once.
MOST_QUERIES = 4096


def nearest(queries: DataFrame, vectors: DataFrame, n: int, but_self: bool = True) -> DataFrame:
    """(query_id, vec_id, similarity, rank): exact nearest vectors of each query vector.

    `queries` is a stated set of query vectors (query_id, q, q_norm). It is counted, and sent to all tasks in parts of at most
    about MOST_QUERIES; a task multiplies blocks of vectors with a part and keeps its best n before anything is shuffled.
    """
    parts = max(1, -(-queries.count() // MOST_QUERIES))
    place = F.pmod(F.xxhash64("query_id"), F.lit(parts))
    return reduce(DataFrame.unionByName, [_nearest(queries if parts == 1 else queries.filter(place == i), vectors, n, but_self) for i in range(parts)])


#: Vectors that are multiplied at once, and how far a product of matrices and ranks of 6 places may lie apart.
BLOCK, SLACK = 1024, 2e-6


def _nearest(queries: DataFrame, vectors: DataFrame, n: int, but_self: bool) -> DataFrame:
    sent = queries.select("query_id", "q", "q_norm").toArrow()
    kinds = dict(vectors.dtypes) | dict(queries.dtypes)
    schema = f"query_id {kinds['query_id']}, vec_id {kinds['vec_id']}, similarity double"

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, best = Vectors(sent.column("query_id").combine_chunks(), sent.column("q").combine_chunks(), sent.column("q_norm").combine_chunks()), None
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                found = _near(asked, Vectors(part.column("vec_id"), part.column("v"), part.column("norm")), n, but_self, best)
                best = found if best is None else _first(np.concatenate([best[0], found[0]]), np.concatenate([best[1], found[1]]), np.concatenate([best[2], found[2]]), n)
        if best is not None and len(best[0]):
            yield pa.RecordBatch.from_arrays([pa.array(asked.ids[best[0]]), pa.array(best[1]), pa.array(best[2])], names=["query_id", "vec_id", "similarity"])

    # a table of vectors may be one file, and its pairs are many: a stated number of partitions
    dealt = vectors.select("vec_id", "v", "norm").repartition(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), "vec_id")
    return ranked(dealt.mapInArrow(each, schema), ["query_id"], F.desc("similarity"), F.asc("vec_id"), n=n)


class Vectors:
    """Vectors of Arrow columns by their lengths. One that is null or has null elements is like none."""

    def __init__(self, ids: pa.Array, vectors: pa.Array, norms: pa.Array):
        self.ids = ids.to_numpy(zero_copy_only=False)
        self.norms = np.nan_to_num(norms.to_numpy(zero_copy_only=False).astype(float), nan=0.0)
        sizes = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False)
        self.row, self.of = np.zeros(len(ids), np.int64), {}
        for size in np.unique(sizes[sizes > 0]).tolist():
            at = np.flatnonzero(sizes == size)
            flat = pc.list_flatten(vectors.take(pa.array(at)))
            keep = flat.is_valid().to_numpy(zero_copy_only=False).reshape(-1, size).all(1)
            self.row[at[keep]] = np.arange(int(keep.sum()))
            self.of[size] = at[keep], flat.to_numpy(zero_copy_only=False).astype(float).reshape(-1, size)[keep]


def _near(asked: Vectors, block: Vectors, n: int, but_self: bool, best: tuple | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the query, vec_id, similarity) of the pairs of a block that can be among the best n of a query."""
    like, size_of = np.zeros((len(asked.ids), len(block.ids))), {}
    for size in asked.of.keys() & block.of.keys():
        (i, q), (j, v) = asked.of[size], block.of[size]
        norms = np.outer(asked.norms[i], block.norms[j])
        like[np.ix_(i, j)] = np.divide(q @ v.T, norms, out=np.zeros_like(norms), where=norms > 0)
        size_of[size] = i, j
    like = np.fmin(np.maximum(like, 0.0), 1.0)
    if but_self:
        like[asked.ids[:, None] == block.ids[None, :]] = -np.inf
    least = np.partition(like, len(block.ids) - n, axis=1)[:, len(block.ids) - n] if n < len(block.ids) else np.full(len(asked.ids), -1.0)
    if best is not None:
        # whoever has n already needs no more than what reaches the last of them
        full = np.bincount(best[0], minlength=len(asked.ids)) >= n
        last = np.full(len(asked.ids), np.inf)
        np.minimum.at(last, best[0], best[2])
        least = np.where(full, np.maximum(least, last), least)
    i, j = np.nonzero(like >= np.maximum(least - SLACK, -1.0)[:, None])
    dot = np.zeros(len(i))
    for size, (of_q, of_v) in size_of.items():
        both = np.isin(i, of_q) & np.isin(j, of_v)
        q, v = asked.of[size][1][asked.row[i[both]]], block.of[size][1][block.row[j[both]]]
        total = np.zeros(len(q))
        for d in range(size):  # the order in which a sum is taken decides its last places
            total += q[:, d] * v[:, d]
        dot[both] = total
    norms = asked.norms[i] * block.norms[j]
    exact = np.fmin(np.maximum(np.divide(dot, norms, out=np.zeros_like(dot), where=norms > 0), 0.0), 1.0)
    return _first(i, block.ids[j], six_places(exact), n)


def six_places(x: np.ndarray) -> np.ndarray:
    """Rounded to 6 places, halves up, as decimals are."""
    return rounded(x, 6)


def rounded(x: np.ndarray, places: int) -> np.ndarray:
    """Rounded to so many places, halves away from 0, as decimals are. What lies near a half is rounded as it is written, equal values once."""
    unit = 10.0**places
    scaled = x * unit
    low = np.floor(scaled)
    out = np.floor(scaled + 0.5) / unit
    near = np.abs(scaled - low - 0.5) < 1e-4
    if near.any():
        values, which = np.unique(x[near], return_inverse=True)
        step = Decimal(1).scaleb(-places)
        out[near] = np.array([float(Decimal(repr(float(v))).quantize(step, ROUND_HALF_UP)) for v in values])[which.reshape(-1)]
    return out


def _first(query: np.ndarray, vec: np.ndarray, like: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((vec, -like, query))
    query, vec, like = query[order], vec[order], like[order]
    first = np.flatnonzero(np.r_[len(query) > 0, query[1:] != query[:-1]])
    kept = np.arange(len(query)) - np.repeat(first, np.diff(np.r_[first, len(query)])) < n
    return query[kept], vec[kept], like[kept]


def hits_to_chunks(hits: DataFrame, chunk: str, kind: str, score: str) -> DataFrame:
    """Hits of several entry points of a chunk as one row: the best score with a bonus for different kinds, and its 3 best kinds."""
    bonus = F.least(F.lit(0.01), 0.005 * (F.count_distinct(kind) - 1))
    best3 = F.slice(F.sort_array(F.collect_set(F.struct(F.col(score).alias("s"), F.col(kind).alias("k"))), asc=False), 1, 3)
    return hits.groupBy(chunk).agg((F.max(score) + bonus).alias("score"), F.max_by(kind, F.struct(score, kind)).alias("best_kind"), F.array_join(F.transform(best3, lambda x: x["k"]), ",").alias("matched"))


RELATION = {"self": 0.35, "cited_asset_context": 0.30, "asset_related": 0.26, "section_header": 0.22, "sibling": 0.21, "section_neighbors": 0.18, "parent_section": 0.15, "page_neighbors": 0.13}


def lookup(column: Column, values: dict[str, float], default: float) -> Column:
    """A constant for each value of a column."""
    out = F.lit(default)
    for k, v in values.items():
        out = F.when(column == k, F.lit(v)).otherwise(out)
    return out


def expansion_score(anchor_score: Column, relation: Column, distance: Column, bonuses: Column, original_hit: Column) -> Column:
    """.55 of the anchor's score and the relation's weight, less .05 a step up to .25, with bonuses; not below 0, rounded to 6 places."""
    base = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(anchor_score, F.lit(0.5))))
    score = base * 0.55 + lookup(relation, RELATION, 0.10) - F.least(F.abs(distance) * 0.05, F.lit(0.25)) + bonuses
    score = score + F.when(original_hit, 0.10).otherwise(0.0) + F.when(relation == "self", 0.12).otherwise(0.0)
    return F.round(F.greatest(F.lit(0.0), score), 6)


def pool(candidates: DataFrame) -> DataFrame:
    """(chunk, score, n_anchors, relations): candidates of all anchors as one pool, with .08 for each further anchor up to .24."""
    g = candidates.groupBy("chunk").agg(F.max("score").alias("_m"), F.collect_set(F.struct("anchor", "relation")).alias("_s"))
    anchors = F.size(F.array_distinct(F.transform("_s", lambda x: x["anchor"])))
    relations = F.array_join(F.array_sort(F.array_distinct(F.transform("_s", lambda x: x["relation"]))), ",")
    return g.select("chunk", F.round(F.col("_m") + F.least(F.lit(0.24), 0.08 * (anchors - 1)), 6).alias("score"), anchors.cast("long").alias("n_anchors"), relations.alias("relations"))

