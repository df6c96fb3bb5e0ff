"""Ranks and running sums over ranges, and centroids in parts, against plain Python."""

import random

from pyspark.sql import functions as F

from scholarlake.operators import recommend
from scholarlake.operators.ranges import ranked_whole, running_before


def test_running_sums_of_a_large_group(spark):
    rnd = random.Random(4)
    rows = [(rnd.choice(["a", "a", "a", "b", None, ""]), k, rnd.choice([None, 1, 5, -2])) for k in range(500)]
    df = spark.createDataFrame(rows, "g string, k long, n int").repartition(7)
    before, want = {}, {}
    for g, k, n in rows:
        want[k] = before.get(g, 0)
        before[g] = want[k] + (n or 0)
    assert {r.k: r.s for r in running_before(df, ["g"], [F.col("k")], F.col("n"), "s").collect()} == want
    places = {r.k: r.rank for r in ranked_whole(df, ["g"], [F.desc("k")]).collect()}
    assert places == {k: sum(1 for h, j, _ in rows if h == g and j >= k) for g, k, _ in rows}
    assert ranked_whole(df.limit(0), ["g"], [F.desc("k")]).count() == 0


def test_centroids_in_parts(spark, monkeypatch):
    rnd = random.Random(7)
    v = [(k, [rnd.uniform(-1, 1) for _ in range(4)]) for k in range(40)]
    c = [(k, [rnd.uniform(-1, 1) for _ in range(4)]) for k in range(25)]
    vectors = spark.createDataFrame(v, "vec_id long, v array<double>").withColumn("norm", recommend.norm(F.col("v")))
    centroids = spark.createDataFrame(c, "cluster long, mean array<double>")
    found = []
    for most in (4096, 4):
        monkeypatch.setattr(recommend, "MOST_CENTROIDS", most)
        best = sorted(map(tuple, recommend.best_match(vectors, centroids, "vec_id", "v", "x").collect()))
        found.append((best, sorted(map(tuple, recommend.nearest_of(vectors, centroids, 3).collect()))))
    assert found[0] == found[1] and len(found[0][0]) == 40 and len(found[0][1]) == 75
