"""Interest vectors, negative profiles and the similarity to them, over purchases (liked) and errors (disliked)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholarlake.operators import interest as N
from scholarlake.operators.recommend import normalised
from scholarlake.plans.registry import query
from scholarlake.sources.tables import EVENTS_SQL, VECTORS_SQL, events, vectors


def _members(kind: str, name: str) -> str:
    """CTEs of the papers that users have marked by events of a kind, with unit vectors, clusters by label, their sizes and numbers."""
    return f"""{name}m AS (SELECT user_id, k AS vec_id, max(epoch) AS latest FROM ev WHERE event_type = '{kind}' AND k IS NOT NULL GROUP BY 1, 2),
{name}v AS (SELECT user_id, vec_id, latest, label, CASE WHEN norm > 0 THEN list_transform(v, lambda x: x / norm) ELSE v END AS u FROM {name}m JOIN vec USING (vec_id)), {name}n AS (SELECT user_id, count(*) AS papers FROM {name}v GROUP BY user_id),
{name}g AS (SELECT user_id, label, count(*) AS size, min(vec_id) AS first FROM {name}v JOIN {name}n USING (user_id) WHERE papers >= 4 GROUP BY 1, 2),
{name}k AS (SELECT user_id, label, row_number() OVER (PARTITION BY user_id ORDER BY size DESC, first) - 1 AS number FROM {name}g WHERE size >= 2 QUALIFY number < 4)"""


def _mean(rows: str, group: str) -> str:
    """The unit mean of vectors u of a table expression, as a table expression (group, n, v)."""
    return f"(SELECT {group}, n, list_transform(m, lambda x: x / greatest(sqrt(list_sum(list_transform(m, lambda y: y * y))), 1e-300)) AS v FROM (SELECT {group}, max(c) AS n, list(x ORDER BY i) AS m FROM (SELECT {group}, i, avg(x) AS x, count(*) AS c FROM (SELECT {group}, unnest(u) AS x, generate_subscripts(u, 1) AS i FROM {rows}) GROUP BY ALL) GROUP BY {group}))"


_BASE = f"{EVENTS_SQL}, {VECTORS_SQL}, {_members('purchase', 'l')}, {_members('error', 'd')}"


def _marked(spark: SparkSession, sf_dir: str, kind: str) -> tuple[DataFrame, DataFrame]:
    """(all marked papers of users, those with vectors)."""
    every = events(spark, sf_dir).filter((F.col("event_type") == kind) & F.col("k").isNotNull()).groupBy("user_id", F.col("k").alias("vec_id")).agg(F.max("epoch").alias("latest"))
    return every, every.join(vectors(spark, sf_dir).select("vec_id", normalised(F.col("v")).alias("u"), F.col("label").alias("cluster")), "vec_id")


@query(f"""WITH {_BASE}, iv AS (SELECT user_id, 'mean' AS kind, 0 AS number, n, v FROM {_mean('lv', 'user_id')} UNION ALL SELECT user_id, 'cluster', number, n, v FROM {_mean('(SELECT * FROM lv JOIN lk USING (user_id, label))', 'user_id, number')}
UNION ALL SELECT user_id, 'weak', 0, n, v FROM {_mean('(SELECT * FROM lv JOIN lg USING (user_id, label) WHERE size < 2)', 'user_id')}),
st AS (SELECT user_id, max(epoch) FILTER (event_type = 'signup') AS built, max(epoch) FILTER (event_type IN ('purchase', 'error')) AS latest FROM ev GROUP BY user_id)
SELECT user_id, kind, CAST(number AS BIGINT) AS number, n, round(v[1], 6) AS first, round(v[64], 6) AS last, round(list_sum(v), 5) AS total, CASE WHEN user_id IN (SELECT user_id FROM lk) THEN 'cluster' ELSE 'mean' END AS mode, coalesce(built < latest, false) AS stale FROM iv JOIN st USING (user_id)""")
def p5_vector_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, liked = _marked(spark, sf_dir, "purchase")
    found = N.interest(liked)
    mode = found.groupBy(F.col("user_id").alias("_u")).agg(F.when(F.max((F.col("kind") == "cluster").cast("int")) == 1, "cluster").otherwise("mean").alias("mode"))
    at = lambda kinds: F.max(F.when(F.col("event_type").isin(kinds), F.col("epoch")))
    times = events(spark, sf_dir).groupBy(F.col("user_id").alias("_t")).agg(F.coalesce(at(["signup"]) < at(["purchase", "error"]), F.lit(False)).alias("stale"))
    rows = found.join(mode, F.col("user_id") == F.col("_u")).join(times, F.col("user_id") == F.col("_t"))
    total = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x)
    return rows.select("user_id", "kind", "number", "n", F.round(F.get("vector", 0), 6).alias("first"), F.round(F.get("vector", 63), 6).alias("last"), F.round(total, 5).alias("total"), "mode", "stale")


_NEGATIVE = """np AS (SELECT user_id, count(*) AS total_disliked FROM dm GROUP BY user_id), ck AS (SELECT user_id, count(*) AS clusters FROM dk GROUP BY user_id),
nm AS (SELECT user_id, total_disliked, coalesce(papers, 0) AS usable_disliked, coalesce(clusters, 0) AS clusters, least(coalesce(papers, 0), 20) AS examples,
  CASE WHEN clusters > 0 THEN 'clusters' WHEN papers >= 4 THEN 'cluster_fallback_examples' WHEN papers > 0 THEN 'examples' ELSE 'none' END AS mode FROM np LEFT JOIN dn USING (user_id) LEFT JOIN ck USING (user_id))"""


@query(f"WITH {_BASE}, {_NEGATIVE} SELECT user_id, mode, total_disliked, usable_disliked, clusters, examples FROM nm")
def p6_negative_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = N.negative_profiles(*_marked(spark, sf_dir, "error"))
    return p.select("user_id", "mode", "total_disliked", "usable_disliked", F.size("clusters").cast("long").alias("clusters"), F.size("examples").cast("long").alias("examples"))


#: Users whose number 10 divides have no profile, only the mean of what they dislike.
@query(f"""WITH {_BASE}, {_NEGATIVE}, cm AS {_mean('(SELECT * FROM dv JOIN dk USING (user_id, label))', 'user_id, number')}, le AS {_mean('dv', 'user_id')}, ex AS (SELECT user_id, u AS v FROM dv QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY latest DESC, vec_id) <= 20),
ne AS (SELECT user_id, 'negative_cluster' AS source, v FROM cm WHERE user_id % 10 <> 0 UNION ALL SELECT user_id, 'negative_example', v FROM ex WHERE user_id % 10 <> 0 AND user_id NOT IN (SELECT user_id FROM dk) UNION ALL SELECT user_id, 'legacy_disliked_vector', v FROM le WHERE user_id % 10 = 0),
ca AS (SELECT user_id, vec_id, v AS cv, norm FROM (SELECT DISTINCT user_id FROM ev WHERE user_id IS NOT NULL), vec WHERE vec_id % 100 = 0),
si AS (SELECT user_id, vec_id, source, max(round(greatest(0.0, least(1.0, list_sum(list_transform(list_zip(cv, v), lambda p: p[1] * p[2])) / (norm * sqrt(list_sum(list_transform(v, lambda x: x * x)))))), 6)) AS s FROM ca JOIN ne USING (user_id) GROUP BY ALL)
SELECT user_id, vec_id, coalesce(s, 0.0) AS similarity, coalesce(source, 'none') AS source FROM ca LEFT JOIN si USING (user_id, vec_id)""")
def f17_negative_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    every, disliked = _marked(spark, sf_dir, "error")
    profiles = N.negative_profiles(every, disliked).filter("user_id % 10 <> 0").select(F.col("user_id").alias("_p"), "clusters", "examples", F.lit(True).alias("provided"))
    legacy = N.unit_means(disliked.filter("user_id % 10 = 0"), "user_id").select(F.col("user_id").alias("_l"), F.col("vector").alias("legacy"))
    users = events(spark, sf_dir).select("user_id").filter("user_id is not null").distinct()
    users = users.join(profiles, F.col("user_id") == F.col("_p"), "left").join(legacy, F.col("user_id") == F.col("_l"), "left")
    # a stated set of candidates: vectors whose number 100 divides
    return N.negative_similarities(users, vectors(spark, sf_dir).filter("vec_id % 100 = 0").select("vec_id", "v"))
