"""Vectors of users: means, clusters and what is in none, and the chain of negative similarity."""

import math

import pytest
from pyspark.sql import functions as F

from scholarlake.operators import interest as N
from tests.shuffles import shuffled_rows


def unit(*v):
    n = math.sqrt(sum(x * x for x in v))
    return [x / n for x in v]


@pytest.fixture(scope="module")
def members(spark):
    rows = [(1, k, unit(1, k / 10), 7, k) for k in range(3)] + [(1, 9, unit(-1, 1), 8, 9), (1, 10, unit(0, 1), None, 10)]
    rows += [(2, 1, unit(1, 0), 7, 1), (2, 2, unit(0, 1), 7, 2)]
    rows += [(3, k, unit(1, k), k, k) for k in range(5)]
    rows += [(4, 10 * c + k, unit(c, 1), c, k) for c in range(6) for k in range(2 + (c == 5))]
    return spark.createDataFrame(rows, "user_id long, vec_id long, u array<double>, cluster long, latest long")


def test_interest_vectors(members):
    got = {(r.user_id, r.kind, r.number): (r.n, r.vector) for r in N.interest(members).collect()}
    assert {k[:2] for k in got} == {(1, "mean"), (1, "cluster"), (1, "weak"), (2, "mean"), (3, "mean"), (3, "weak"), (4, "mean"), (4, "cluster")}
    assert got[1, "cluster", 0][0] == 3 and got[1, "weak", 0][0] == 2 and got[2, "mean", 0] == (2, pytest.approx(unit(1, 1)))
    # four of six clusters: the largest, then those of the least papers
    assert [got[4, "cluster", k][1] for k in range(4)] == [pytest.approx(unit(*v)) for v in ((5, 1), (0, 1), (1, 1), (2, 1))]
    assert got[1, "weak", 0][1] == pytest.approx(unit(*(a + b for a, b in zip(unit(-1, 1), unit(0, 1), strict=True))))


def test_negative_profiles(spark, members):
    every = members.select("user_id", "vec_id").unionByName(spark.createDataFrame([(1, 999), (5, 1)], "user_id long, vec_id long"))
    got = {r.user_id: r for r in N.negative_profiles(every, members, examples=2).collect()}
    assert {u: r.mode for u, r in got.items()} == {1: "clusters", 2: "examples", 3: "cluster_fallback_examples", 4: "clusters", 5: "none"}
    assert (got[1].total_disliked, got[1].usable_disliked, len(got[1].clusters)) == (6, 5, 1) and got[5].examples == []
    assert got[3].examples == [pytest.approx(unit(1, 4)), pytest.approx(unit(1, 3))]


def test_chain_of_similarity(spark):
    a, b, c = unit(1, 0), unit(1, 1), unit(0, 1)
    rows = [(1, [a, b], [c], True, c), (2, [], [b, c], True, c), (3, [], [], True, c), (4, None, None, None, b), (5, None, None, None, None)]
    df = spark.createDataFrame(rows, "id int, clusters array<array<double>>, examples array<array<double>>, provided boolean, legacy array<double>").withColumn("v", F.array(F.lit(1.0), F.lit(0.0)))
    like, source = N.negative_similarity(*map(F.col, ("v", "clusters", "examples", "provided", "legacy")))
    got = {r.id: (r.s, r.w) for r in df.select("id", like.alias("s"), source.alias("w")).collect()}
    half = round(math.sqrt(0.5), 6)
    assert got == {1: (1.0, "negative_cluster"), 2: (half, "negative_example"), 3: (0.0, "none"), 4: (half, "legacy_disliked_vector"), 5: (0.0, "none")}


def test_means_of_streamed_groups(spark):
    rows = [(k % 3, k % 2, [1.0 * k, None, 2.0]) for k in range(3000)] + [(7, 0, [1.0, 2.0]), (7, 0, [3.0]), (7, 0, None), (8, 0, []), (None, 0, [2.0]), (None, 0, [2.0])]
    df = spark.createDataFrame(rows, "user_id long, number int, u array<double>")
    got, shuffled = shuffled_rows(spark, lambda: N.unit_means(df, "user_id", "number").collect())
    want = {(a, b): [k for k in range(3000) if k % 3 == a and k % 2 == b] for a in range(3) for b in range(2)}
    means = {g: [sum(ks) / len(ks), None, 2.0] for g, ks in want.items()} | {(7, 0): [2.0, 2.0], (None, 0): [2.0]}
    plain = spark.createDataFrame([(*g, v) for g, v in means.items()], "user_id long, number int, v array<double>").select("user_id", "number", N.normalised(F.col("v")).alias("v")).collect()
    assert {(r.user_id, r.number): r.vector and pytest.approx(r.vector) for r in got} == {(r.user_id, r.number): r.v for r in plain}
    assert {(r.user_id, r.number): r.n for r in got} == {g: len(ks) for g, ks in want.items()} | {(7, 0): 2, (None, 0): 2}
    # a row a vector, not a row an element
    assert shuffled <= len(rows)
