"""Similarity to what users dislike, of all users and a stated set of vectors."""

import random
import time

from pyspark.sql import functions as F

from scholarlake.operators import interest as N

SHAPE = "user_id long, clusters array<array<double>>, examples array<array<double>>, provided boolean, legacy array<double>"


def _vector(rnd, size=64):
    return [rnd.gauss(0, 1) for _ in range(size)]


def test_users_beside_vectors_as_one_by_one(spark):
    rnd = random.Random(3)
    odd = [None, [], [0.0] * 64, [1.0, None], [1.0, 2.0]]
    users = [(i, [_vector(rnd) for _ in range(i % 3)] + odd[: i % 5] if i % 4 else None, [rnd.choice([*odd, _vector(rnd)]) for _ in range(i % 6)], [True, False, None][i % 3], _vector(rnd) if i % 2 else None) for i in range(90)]
    users = spark.createDataFrame(users, SHAPE)
    asked = spark.createDataFrame([(i, _vector(rnd)) for i in range(40)] + [(100 + i, v) for i, v in enumerate(odd)], "vec_id long, v array<double>")
    like, source = N.negative_similarity(*map(F.col, ("v", "clusters", "examples", "provided", "legacy")))
    want = users.crossJoin(asked).select("user_id", "vec_id", F.coalesce(like, F.lit(0.0)).alias("similarity"), source.alias("source")).collect()
    got = N.negative_similarities(users, asked).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_many_pairs_take_seconds(spark):
    rnd = random.Random(4)
    users = spark.createDataFrame([(i, None, [_vector(rnd) for _ in range(20)], True, None) for i in range(200)], SHAPE)
    asked = spark.createDataFrame([(i, _vector(rnd)) for i in range(2000)], "vec_id long, v array<double>")
    began = time.perf_counter()
    assert N.negative_similarities(users, asked).filter("similarity >= 0").count() == 400_000
    assert time.perf_counter() - began < 30
