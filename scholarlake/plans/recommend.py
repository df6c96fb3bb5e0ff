"""Recommendation and research-profile queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scholarlake.functions import text as T
from scholarlake.operators import profile as P
from scholarlake.operators import recommend as R
from scholarlake.operators import retrieval
from scholarlake.operators import rules as RL
from scholarlake.plans.registry import query
from scholarlake.sources.tables import EVENTS_SQL, PAPERS_SQL, VECTORS_SQL, events, papers, table, vectors

_DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda p: p[1] * p[2]))"
_MEANS = f"""{VECTORS_SQL}, me AS (SELECT label AS cluster, list(m ORDER BY i) AS mean, max(n) AS n FROM (SELECT label, i, avg(x) AS m, count(*) AS n FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM vec) GROUP BY 1, 2) GROUP BY label),
cen AS (SELECT cluster, mean, n, sqrt({_DOT.format(a='mean', b='mean')}) AS cn FROM me)"""
_SIM = "round(greatest(0.0, least(1.0, " + _DOT.format(a="v", b="mean") + " / (norm * cn))), 6)"


def _centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.mean_vector(vectors(spark, sf_dir), "label", "v").select(F.col("label").alias("cluster"), "mean", "n")


@query(f"WITH {_MEANS} SELECT cluster, n, round(cn, 6) AS norm, round(mean[1] / cn, 6) AS first, round(mean[64] / cn, 6) AS last FROM cen")
def a12_mean_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _centroids(spark, sf_dir).withColumn("u", R.normalised(F.col("mean")))
    return c.select("cluster", "n", F.round(R.norm(F.col("mean")), 6).alias("norm"), F.round(F.get("u", 0), 6).alias("first"), F.round(F.get("u", 63), 6).alias("last"))


@query(f"WITH {VECTORS_SQL}, c AS (SELECT label, count(*) AS n FROM vec GROUP BY label HAVING count(*) >= 2) SELECT label AS cluster, n, row_number() OVER (ORDER BY n DESC, label) AS cluster_rank FROM c QUALIFY row_number() OVER (ORDER BY n DESC, label) <= 6")
def a13_cluster_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = vectors(spark, sf_dir).groupBy(F.col("label").alias("cluster")).agg(F.count("*").alias("n")).filter("n >= 2")
    return c.withColumn("cluster_rank", F.row_number().over(Window.orderBy(F.desc("n"), "cluster")).cast("long")).filter("cluster_rank <= 6")


@query(f"""WITH {_MEANS}, s AS (SELECT vec_id, cluster, {_SIM} AS s FROM vec, cen), t AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY s DESC, vec_id) AS r FROM s)
SELECT vec_id, arg_max(cluster, s * 1000 - cluster * 1e-9) AS best_cluster, max(s) AS similarity, count(*) AS n_clusters FROM t WHERE r <= 20 GROUP BY vec_id""")
def w6_cluster_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.recall(vectors(spark, sf_dir), _centroids(spark, sf_dir), 20)


@query(f"WITH {_MEANS}, s AS (SELECT vec_id, cluster, {_SIM} AS s FROM vec, cen) SELECT vec_id, arg_max(cluster, s * 1000 - cluster * 1e-9) AS interest_cluster, max(s) AS interest_similarity FROM s GROUP BY vec_id")
def j9_best_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.best_match(vectors(spark, sf_dir), _centroids(spark, sf_dir), "vec_id", "v", "interest")


@query(f"WITH {PAPERS_SQL} SELECT paper_id, round(1.0 / (1.0 + greatest(datediff('day', CAST(created AS DATE), DATE '2024-08-01'), 0) / 365.0), 6) AS recency FROM papers")
def w11_recency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return papers(spark, sf_dir).select("paper_id", F.round(R.recency(F.datediff(F.lit("2024-08-01").cast("date"), F.to_date("created"))), 6).alias("recency"))


_LIKED = f"{EVENTS_SQL}, fr AS (SELECT category, count(*) AS f FROM (SELECT unnest([source, lang]) AS category FROM ev JOIN documents ON doc_id = k WHERE event_type = 'purchase') GROUP BY category)"


def _category_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = papers(spark, sf_dir).select("paper_id", "categories")
    liked = events(spark, sf_dir).filter("event_type = 'purchase'").groupBy("k").agg(F.count("*").alias("n"))
    f = p.join(liked, F.col("paper_id") == F.col("k")).select(F.explode("categories").alias("category"), "n").groupBy("category").agg(F.sum("n").alias("f"))
    f = f.withColumn("total", F.sum("f").over(Window.partitionBy(F.lit(0))))
    hit = p.select("paper_id", F.explode("categories").alias("category")).join(f, "category").groupBy("paper_id").agg(F.least(F.lit(1.0), F.sum("f") / F.max("total")).alias("category_score"))
    return p.select("paper_id").join(hit, "paper_id", "left").select("paper_id", F.coalesce("category_score", F.lit(0.0)).alias("category_score"))


@query(f"WITH {_LIKED} SELECT doc_id AS paper_id, round(coalesce(least(1.0, (SELECT sum(f) FROM fr WHERE category IN (source, lang)) / (SELECT sum(f) FROM fr)), 0.0), 6) AS category_score FROM documents")
def f15_category_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _category_scores(spark, sf_dir).withColumn("category_score", F.round("category_score", 6))


_SPLIT = f"""{_MEANS}, pos AS (SELECT vec_id, max(CASE WHEN cluster < 5 THEN s END) AS p, max(CASE WHEN cluster >= 5 THEN s END) AS n FROM (SELECT vec_id, cluster, {_SIM} AS s FROM vec, cen) GROUP BY vec_id)"""
_PENALTY = "CASE WHEN n > 0.64 THEN least(0.22, ((n - 0.64) / 0.36 * 0.15 + CASE WHEN n > p - 0.1 THEN (n - (p - 0.1)) / 0.1 * 0.15 ELSE 0 END) * least(1.0, 4 / 6.0)) ELSE 0.0 END"


def _two_sides(spark: SparkSession, sf_dir: str, of: DataFrame | None = None) -> DataFrame:
    """Of all vectors, or of those of `of` (vec_id)."""
    c, v = _centroids(spark, sf_dir), vectors(spark, sf_dir)
    v = v if of is None else v.join(of.select("vec_id").distinct(), "vec_id", "left_semi")
    liked = R.best_match(v, c.filter("cluster < 5"), "vec_id", "v", "liked")
    disliked = R.best_match(v, c.filter("cluster >= 5"), "vec_id", "v", "disliked")
    return liked.join(disliked, "vec_id")


@query(f"WITH {_SPLIT} SELECT vec_id, p AS liked, n AS disliked, CAST(round({_PENALTY}, 5) AS DOUBLE) AS penalty FROM pos")
def f17_f18_negative_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _two_sides(spark, sf_dir)
    return t.select("vec_id", F.col("liked_similarity").alias("liked"), F.col("disliked_similarity").alias("disliked"), F.round(R.penalty(F.col("liked_similarity"), F.col("disliked_similarity"), F.lit(4)), 5).alias("penalty"))


_BASE = f"""{_SPLIT}, {PAPERS_SQL}, sc AS (SELECT vec_id, 0.65 * p + 0.08 * CASE WHEN primary_category IN ('src1', 'src2') THEN 0.5 ELSE 0 END + 0.05 / (1.0 + greatest(datediff('day', CAST(created AS DATE), DATE '2024-08-01'), 0) / 365.0) - {_PENALTY} AS score, n FROM pos JOIN papers ON paper_id = vec_id)"""


def _base(spark: SparkSession, sf_dir: str, of: DataFrame | None = None) -> DataFrame:
    t = _two_sides(spark, sf_dir, of).join(papers(spark, sf_dir).select(F.col("paper_id").alias("vec_id"), "primary_category", "created"), "vec_id")
    fresh = R.recency(F.datediff(F.lit("2024-08-01").cast("date"), F.to_date("created")))
    category = F.when(F.col("primary_category").isin("src1", "src2"), 0.5).otherwise(0.0)
    minus = R.penalty(F.col("liked_similarity"), F.col("disliked_similarity"), F.lit(4))
    return t.select("vec_id", R.base_score(F.col("liked_similarity"), category, fresh, minus).alias("score"), F.col("disliked_similarity").alias("disliked"))


@query(f"WITH {_BASE} SELECT vec_id, CAST(round(score, 5) AS DOUBLE) AS score, n >= 0.9 AS filtered FROM sc")
def f16_p2_base_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _base(spark, sf_dir).select("vec_id", F.round("score", 5).alias("score"), (F.col("disliked") >= 0.9).alias("filtered"))


_HAS = "CAST(regexp_matches({0}, '(^|[^a-z0-9]){1}([^a-z0-9]|$)') AS INT)"
_share = lambda where, ts: "(" + " + ".join(_HAS.format(where, t) for t in ts) + f") / {len(ts)}.0"


@query(f"""WITH {PAPERS_SQL}, t AS (SELECT paper_id, lower(title) AS title, lower(abstract) AS abstract, categories, lower(title || ' ' || abstract || ' ' || array_to_string(categories, ' ')) AS x, (paper_id % 10) / 8.0 AS recalled FROM papers)
SELECT paper_id, CAST(round(least(1.0, greatest({_share("x", ("the", "und", "en"))}, least(1.0, recalled)) * 0.55 + {_share("title", ("of", "the"))} * 0.2 + {_share("abstract", ("in", "de"))} * 0.15
 + len(list_intersect(categories, ['src1', 'en', 'src5'])) / 3.0 * 0.1 + {_HAS.format("title", "of the")} * 0.1 + {_HAS.format("abstract", "in de")} * 0.05), 6) AS DOUBLE) AS match FROM t""")
def f14_query_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = papers(spark, sf_dir)
    text = F.lower(F.concat_ws(" ", "title", "abstract", F.array_join("categories", " ")))
    match = RL.query_match(text, F.lower("title"), F.lower("abstract"), F.col("categories"), ["the", "und", "en"], ["of", "the"], ["in", "de"], ["src1", "en", "src5"], (F.col("paper_id") % 10) / 8.0)
    return p.select("paper_id", F.round(match, 6).alias("match"))


#: Papers recalled for each of a user's interest clusters (the reference's recall limit), and the newest for a user without one (P1).
_RECALLED, _NEWEST = 30, 5


def _recall(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, int, int]:
    """What `candidates` and `candidate_groups` take."""
    e = events(spark, sf_dir)
    liked = e.filter("event_type = 'purchase'").select("user_id", F.col("k").alias("vec_id")).distinct()
    return e.select("user_id"), liked, vectors(spark, sf_dir), _centroids(spark, sf_dir), _RECALLED, _NEWEST


@query()
def w10_diversified(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    scored = _base(spark, sf_dir).join(v.select("vec_id", F.col("label").alias("cluster")), "vec_id").withColumn("score", F.round("score", 5))
    both = R.candidates(*_recall(spark, sf_dir)).join(scored, "vec_id").select("user_id", "vec_id", "cluster", "score")
    return R.diversify(both, v, 10)


@query(f"""WITH {EVENTS_SQL}, u AS (SELECT DISTINCT user_id FROM ev), r AS (SELECT user_id, k AS item, 'cluster' AS origin FROM ev WHERE event_type = 'purchase'), p AS (SELECT doc_id AS item FROM documents ORDER BY doc_id DESC LIMIT 5)
SELECT user_id, origin, count(DISTINCT item) AS n FROM (SELECT * FROM r UNION ALL SELECT user_id, item, 'recent' FROM u, p WHERE user_id NOT IN (SELECT user_id FROM r)) GROUP BY 1, 2""")
def p1_recall_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    r = e.filter("event_type = 'purchase'").select("user_id", F.col("k").alias("item"), F.lit("cluster").alias("origin"))
    newest = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item")).orderBy(F.desc("item")).limit(5).agg(F.collect_list("item").alias("items")).withColumn("_one", F.lit(1))
    lone = e.select("user_id").distinct().join(r.select("user_id").distinct(), "user_id", "left_anti").withColumn("_one", F.lit(1))
    recent = lone.join(F.broadcast(newest), "_one").select("user_id", F.explode("items").alias("item"), F.lit("recent").alias("origin"))
    return r.unionByName(recent).groupBy("user_id", "origin").agg(F.count_distinct("item").alias("n"))


# profile


_SIGNALS = f"""{EVENTS_SQL}, sg AS (SELECT event_id, user_id, 'topic' || CAST(k % 10 AS VARCHAR) AS topic, k AS paper, event_type AS action, CASE event_type WHEN 'error' THEN -1 ELSE 1 END AS polarity, 0.5 + (event_id % 5) * 0.1 AS confidence,
  CASE event_type WHEN 'purchase' THEN 3.0 WHEN 'error' THEN 2.4 ELSE 0.0 END AS lw, CASE event_type WHEN 'purchase' THEN 1.7 WHEN 'click' THEN 2.2 WHEN 'view' THEN 0.18 WHEN 'error' THEN 1.2 ELSE 0 END AS rw, (1706745600 - epoch) / 86400.0 AS age, epoch FROM ev WHERE event_type <> 'signup'),
sm AS (SELECT *, row_number() OVER (PARTITION BY user_id, topic, paper, action, polarity ORDER BY confidence DESC, event_id) = 1 AS strongest FROM sg)"""
_SCORED = f"""{_SIGNALS}, va AS (SELECT *, CASE WHEN strongest THEN lw * confidence * power(0.5, age / 120.0) ELSE 0 END AS lv, CASE WHEN strongest THEN rw * confidence * power(0.5, age / 14.0) ELSE 0 END AS rv FROM sm),
tg AS (SELECT user_id, topic, coalesce(sum(lv) FILTER (polarity > 0), 0) AS lp, coalesce(sum(lv) FILTER (polarity < 0), 0) AS ln, coalesce(sum(rv) FILTER (polarity > 0), 0) AS rp, coalesce(sum(rv) FILTER (polarity < 0), 0) AS rn,
  count(DISTINCT paper) FILTER (polarity > 0 AND lv > 0) AS liked, count(DISTINCT paper) FILTER (polarity < 0 AND lv > 0) AS disliked, count(DISTINCT paper) FILTER (polarity > 0 AND rv > 0 AND action <> 'view' AND age <= 30) AS recent,
  coalesce((max(epoch) FILTER (polarity > 0 AND lv > 0) - min(epoch) FILTER (polarity > 0 AND lv > 0)) / 86400.0, 0) AS span, bool_and(action = 'view') AS only_read FROM va GROUP BY 1, 2),
ts AS (SELECT *, round(lp - ln, 4) AS net, round(rp - rn, 4) AS recent_net, round(CASE WHEN lp + ln > 0 THEN abs(lp - ln) / (lp + ln) ELSE 0 END, 4) AS consistency, round(lp, 4) AS long_pos, round(ln, 4) AS long_neg,
  round(CASE WHEN lp + ln > 0 THEN abs(lp - ln) / (lp + ln) ELSE 0 END * (1 - exp(-(CASE WHEN lp >= ln THEN liked ELSE disliked END) / 3.0)), 4) AS confidence,
  round(abs(lp - ln) * CASE WHEN lp + ln > 0 THEN abs(lp - ln) / (lp + ln) ELSE 0 END * (1 - exp(-(CASE WHEN lp >= ln THEN liked ELSE disliked END) / 3.0)), 4) AS rank_score, round(span, 2) AS span_days FROM tg)"""


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).filter("event_type <> 'signup'")
    value = lambda m: retrieval.lookup(F.col("event_type"), m, 0.0)
    return e.select(
        "event_id", "user_id", F.concat(F.lit("topic"), (F.col("k") % 10).cast("string")).alias("topic"), F.col("k").alias("paper"), F.col("event_type").alias("action"), F.when(F.col("event_type") == "error", -1).otherwise(1).alias("polarity"),
        (0.5 + (F.col("event_id") % 5) * 0.1).alias("confidence"), value({"purchase": 3.0, "error": 2.4}).alias("long_weight"), value({"purchase": 1.7, "click": 2.2, "view": 0.18, "error": 1.2}).alias("recent_weight"),
        ((F.lit(1706745600) - F.col("epoch")) / 86400.0).alias("age_days"), "epoch",
    )


@query(f"WITH {_SIGNALS} SELECT event_id FROM sm WHERE strongest")
def a16_strongest_member(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.strongest(_signals(spark, sf_dir)).filter("strongest").select("event_id")


@query(f"WITH {_SCORED} SELECT user_id, topic, CAST(long_pos AS DOUBLE) AS long_pos, CAST(long_neg AS DOUBLE) AS long_neg, net, recent_net, consistency, confidence, rank_score, liked, disliked, recent, CAST(span_days AS DOUBLE) AS span_days FROM ts")
def a15_topic_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.topic_scores(_signals(spark, sf_dir)).drop("only_read")


@query(f"""WITH {_SCORED}, z AS (SELECT *, CASE WHEN net > 0 AND consistency >= 0.5 AND liked >= 1 AND span_days >= 7 THEN 'focus' WHEN net < 0 AND consistency >= 0.5 AND disliked >= 1 THEN 'exclude' END AS zone,
  recent_net >= 0.6 AND NOT only_read AND NOT (long_pos + long_neg > 0 AND consistency < 0.5) AND recent >= 2 AS is_recent FROM ts),
p AS (SELECT user_id, topic, zone, row_number() OVER (PARTITION BY user_id, zone ORDER BY rank_score DESC, topic) AS place FROM z WHERE zone IS NOT NULL UNION ALL SELECT user_id, topic, 'recent', row_number() OVER (PARTITION BY user_id ORDER BY recent_net DESC, topic) FROM z WHERE is_recent AND zone IS DISTINCT FROM 'exclude')
SELECT user_id, topic, zone, place, place <= CASE zone WHEN 'focus' THEN 12 ELSE 10 END AS kept FROM p""")
def w9_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.zones(P.topic_scores(_signals(spark, sf_dir)))


@query(f"WITH {EVENTS_SQL} SELECT user_id, event_type AS action, k AS paper, round(sum(power(0.5, (1706745600 - epoch) / 86400.0 / 14.0)), 4) AS decayed FROM ev GROUP BY 1, 2, 3")
def f22_half_life(spark: SparkSession, sf_dir: str) -> DataFrame:
    age = (F.lit(1706745600) - F.col("epoch")) / 86400.0
    return events(spark, sf_dir).groupBy("user_id", F.col("event_type").alias("action"), F.col("k").alias("paper")).agg(F.round(F.sum(P.decay(age, 14.0)), 4).alias("decayed"))


@query(f"WITH {EVENTS_SQL}, c AS (SELECT unnest([source, lang]) AS category, user_id, CASE event_type WHEN 'purchase' THEN 3.0 WHEN 'click' THEN 1.0 ELSE 0.5 END AS w FROM ev JOIN documents ON doc_id = k WHERE event_type IN ('purchase', 'click', 'view')), s AS (SELECT user_id, category, sum(w) AS weight FROM c GROUP BY 1, 2) SELECT user_id, category, CAST(weight AS DOUBLE) AS weight FROM s QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY weight DESC, category) <= 5")
def a20_category_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).filter(F.col("event_type").isin("purchase", "click", "view")).select("user_id", "k", retrieval.lookup(F.col("event_type"), {"purchase": 3.0, "click": 1.0}, 0.5).alias("w"))
    e = e.groupBy("user_id", "k").agg(F.sum("w").alias("w"))
    c = papers(spark, sf_dir).select("paper_id", "categories").join(e, F.col("paper_id") == F.col("k")).select("user_id", F.explode("categories").alias("category"), "w")
    return retrieval.ranked(c.groupBy("user_id", "category").agg(F.sum("w").alias("weight")), ["user_id"], F.desc("weight"), F.asc("category"), n=5).drop("rank")


@query(f"WITH {_SCORED}, r AS (SELECT va.user_id, paper, sum(rank_score) AS s FROM (SELECT DISTINCT user_id, topic, paper FROM va) va JOIN ts USING (user_id, topic) GROUP BY 1, 2) SELECT user_id, paper, round(s, 4) AS score FROM r QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY round(s, 4) DESC, paper) <= 3")
def a21_representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _signals(spark, sf_dir)
    scores = P.topic_scores(s).select("user_id", "topic", "rank_score")
    r = s.select("user_id", "topic", "paper").distinct().join(scores, ["user_id", "topic"]).groupBy("user_id", "paper").agg(F.round(F.sum("rank_score"), 4).alias("score"))
    return retrieval.ranked(r, ["user_id"], F.desc("score"), F.asc("paper"), n=3).drop("rank")


@query(f"""WITH {_SCORED}, u AS (SELECT user_id, count(*) AS topics, count(*) FILTER (consistency < 0.5) AS warnings, sum(liked) AS signals FROM ts GROUP BY user_id)
SELECT user_id, topics, warnings, CAST(round(greatest(0, least(1, 0.5 + least(0.35, 0.05 * signals) - least(0.3, 0.06 * warnings))), 4) AS DOUBLE) AS quality, round(greatest(0, least(1, 0.5 + least(0.35, 0.05 * signals) - least(0.3, 0.06 * warnings))), 4) >= 0.45 AS approved FROM u""")
def p12_profile_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.review(P.topic_scores(_signals(spark, sf_dir)))


@query(f"WITH {EVENTS_SQL} SELECT user_id, k AS paper, event_type AS action, max(epoch) AS latest, min(event_id) AS first_event FROM ev GROUP BY 1, 2, 3")
def p9_paper_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy("user_id", F.col("k").alias("paper"), F.col("event_type").alias("action")).agg(F.max("epoch").alias("latest"), F.min("event_id").alias("first_event"))


@query(f"WITH {EVENTS_SQL}, l AS (SELECT user_id, max(epoch) AS built FROM ev WHERE event_type = 'signup' GROUP BY user_id) SELECT ev.user_id, count(*) AS todo FROM ev LEFT JOIN l USING (user_id) WHERE event_type <> 'signup' AND (built IS NULL OR epoch > built) GROUP BY 1")
def p8_build_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    built = e.filter("event_type = 'signup'").groupBy("user_id").agg(F.max("epoch").alias("built"))
    return e.filter("event_type <> 'signup'").join(built, "user_id", "left").filter("built is null or epoch > built").groupBy("user_id").agg(F.count("*").alias("todo"))


@query(f"""WITH {_SCORED}, s AS (SELECT user_id, topic, CASE WHEN user_id % 7 = CAST(right(topic, 1) AS INT) THEN 0 WHEN user_id % 5 = CAST(right(topic, 1) AS INT) THEN 1 WHEN user_id % 3 = CAST(right(topic, 1) AS INT) THEN 2 ELSE 3 END AS p FROM ts WHERE net > 0)
SELECT user_id, topic, CASE p WHEN 1 THEN 'focus' WHEN 2 THEN 'exclude' ELSE 'generated' END AS origin FROM s WHERE p > 0""")
def p13_effective_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = P.topic_scores(_signals(spark, sf_dir)).filter("net > 0").select("user_id", "topic")
    digit = F.substring("topic", -1, 1).cast("int")
    manual = lambda m, name: g.filter(F.col("user_id") % m == digit).select("user_id", "topic", F.lit(name).alias("origin"))
    return P.merged([manual(7, "hidden"), manual(5, "focus"), manual(3, "exclude"), g.withColumn("origin", F.lit("generated"))], ["user_id", "topic"]).filter("origin <> 'hidden'")


@query(r"""WITH t AS (SELECT conv_id, turn, list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: x NOT IN (""" + ", ".join(f"'{w}'" for w in T.STOPWORDS) + r""")) AS ks FROM conversations),
s AS (SELECT conv_id, turn, list_transform(ks, lambda x: CASE WHEN length(x) > 4 AND x LIKE '%ies' THEN left(x, length(x) - 3) || 'y' WHEN length(x) > 3 AND x LIKE '%s' AND x NOT LIKE '%ss' THEN left(x, length(x) - 1) ELSE x END) AS ks FROM t)
SELECT conv_id, turn, array_to_string(list_sort(list_distinct(ks)), ' ') AS key FROM s""")
def f23_topic_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.topic_key(F.col("text")).alias("key"))


@query(rf"""WITH {PAPERS_SQL}, w AS (SELECT paper_id, list_distinct(regexp_extract_all(lower(title), '[a-z0-9]+')) AS t FROM papers), h AS (SELECT * FROM w WHERE paper_id % 100 = 0 AND len(t) > 0),
s AS (SELECT h.paper_id AS item_id, w.paper_id AS doc_id, round(len(list_intersect(h.t, w.t)) / len(list_distinct(list_concat(h.t, w.t))), 6) AS s FROM h, w WHERE h.paper_id <> w.paper_id) SELECT item_id, doc_id, s AS similarity FROM s WHERE s >= 0.55 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY s DESC, doc_id) = 1""")
def j11_topic_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = papers(spark, sf_dir)
    return P.similar_topics(p.filter("paper_id % 100 = 0").select(F.col("paper_id").alias("item_id"), F.col("title").alias("text")), p.select(F.col("paper_id").alias("doc_id"), F.col("title").alias("text")), 0.55)
