"""Users beside a stated set of papers: scored in blocks, as the expressions of a pair say."""

import random

from pyspark.sql import functions as F

from scholarlake.operators import adjust as A
from scholarlake.operators import recommend as N
from scholarlake.operators import retrieval as R
from scholarlake.plans import adjust as plans
from scholarlake.plans.recommend import _recall


def _sides(spark):
    rnd = random.Random(11)
    some = lambda of, most: rnd.choice([None, rnd.sample(of, rnd.randint(0, most))])
    words, numbers = list("abcdefgh"), list(range(12))
    users = [(u if u else None, some(words[:4], 3), some(words[4:], 3), some(words, 4), some(list(range(0, 40, 2)), 9), some(numbers, 4), some(numbers, 3), some(numbers, 12), some(words, 2)) for u in range(50)]
    users = spark.createDataFrame(users, "user_id long, liked array<string>, disliked array<string>, preferred array<string>, read array<long>, positive array<int>, negative array<int>, recent array<int>, constraints array<string>")
    users = users.withColumn("asked", F.when(F.coalesce("positive", "negative", "recent").isNotNull(), F.array_distinct(F.flatten(F.array_compact(F.array("positive", "negative", "recent"))))))
    users = users.withColumn("strict", F.when(F.col("constraints").isNotNull(), True))
    papers = [(p, p % 7 / 7 if p % 5 else None, p % 11 / 11, some([(w, round(rnd.random(), 4)) for w in words], 5), some(words, 3), some(numbers, 8)) for p in range(40)]
    papers = spark.createDataFrame(papers, "paper_id long, query_match double, personal double, matches array<struct<topic:string,match:double>>, categories array<string>, terms array<int>")
    return users, papers.withColumn("held_by", F.col("categories"))


def _of(rows, *columns):
    return {(r.user_id, r.paper_id): tuple(x if isinstance(x, bool) else round(x, 6) for x in (r[c] for c in columns)) for r in rows.collect()}


def test_pairs_are_what_expressions_say(spark, monkeypatch):
    users, papers = _sides(spark)
    plain = A.with_request(A.with_profile(users.crossJoin(papers))).cache()
    for most in (7, 4096):
        monkeypatch.setattr(A, "MOST_PAPERS", most)
        monkeypatch.setattr(A, "PAIRS", 60)
        columns = "profile_score", "profile_penalty"
        assert _of(A.profile_pairs(users, papers), *columns) == _of(plain, *columns)
        columns = "request_score", "request_penalty", "excluded"
        assert _of(A.request_pairs(users, papers), *columns) == _of(plain, *columns)
        final = F.round(F.coalesce("query_match", F.lit(0.0)) * 0.6 + F.col("personal") * 0.3 + F.col("profile_score") - F.col("profile_penalty") + F.col("request_score") - F.col("request_penalty"), 5)
        first = lambda rows: {tuple(r) for r in R.ranked(rows, ["user_id"], F.desc("final"), F.asc("paper_id"), n=5).select("user_id", "paper_id", "final", "rank").collect()}
        known = papers.withColumn("query_match", F.coalesce("query_match", F.lit(0.0)))
        assert first(A.best_pairs(users, known, 5)) == first(plain.filter("not excluded").withColumn("final", final))


def test_no_papers_and_no_users(spark):
    users, papers = _sides(spark)
    assert A.profile_pairs(users, papers.limit(0)).count() == 0 and A.request_pairs(users.limit(0), papers).count() == 0


def test_no_pair_is_joined(spark, sf_dir):
    for query in (plans.f19_profile_adjustment, plans.f20_context_adjustment, plans.f21_search_rerank):
        plan = query(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan, query.__name__


def test_rounded_as_decimals(spark):
    import numpy as np

    rnd = random.Random(2)
    x = [rnd.choice((-1, 1)) * (rnd.randint(0, 10**7) + rnd.choice((0.5, 0.25, rnd.random()))) / 1e5 for _ in range(4000)]
    want = [r.x for r in spark.createDataFrame([(k, v) for k, v in enumerate(x)], "k int, x double").select("k", F.round("x", 5).alias("x")).orderBy("k").collect()]
    assert R.rounded(np.array(x), 5).tolist() == want


def test_groups_are_the_candidates(spark, sf_dir):
    recall = _recall(spark, sf_dir)
    users, found = N.candidate_groups(*recall)
    got = users.select("user_id", F.explode("groups").alias("g")).join(found.select("vec_id", F.explode("groups").alias("g")), "g").select("user_id", "vec_id").distinct()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, N.candidates(*recall).collect())) != []


def test_choices_beside_the_papers(spark, monkeypatch):
    users, papers = _sides(spark)
    rnd = random.Random(5)
    groups = {p: rnd.sample(["1", "2", "newest"], rnd.randint(1, 2)) for p in range(40)}
    more = spark.createDataFrame([(p, g, rnd.random(), p % 4, [rnd.uniform(-1, 1) for _ in range(6)]) for p, g in groups.items()], "paper_id long, groups array<string>, score double, cluster long, v array<double>")
    users = users.filter("user_id is not null").withColumn("groups", F.when(F.col("user_id") % 3 == 0, F.array(F.lit("newest"))).when(F.col("user_id") % 3 == 1, F.array(F.lit("1"), F.lit("2"))).otherwise(F.array(F.lit("4"))))
    papers = papers.join(more, "paper_id").cache()
    both = users.withColumnRenamed("groups", "asked_groups").crossJoin(papers).filter(F.arrays_overlap("groups", "asked_groups"))
    both = A.with_request(A.with_profile(both)).filter("not excluded")
    plain = both.select("user_id", F.col("paper_id").alias("vec_id"), "cluster", F.round(F.col("score") + (F.col("profile_score") - F.col("profile_penalty") + F.col("request_score") - F.col("request_penalty")), 5).alias("score"))
    want = sorted(map(tuple, N.diversify(plain, papers.select(F.col("paper_id").alias("vec_id"), "v"), 6).collect()))
    assert len(want) > 100
    for most in (4096, 15):
        monkeypatch.setattr(A, "MOST_PAPERS", most)
        assert sorted(map(tuple, A.recommended(users, papers, 6).select("user_id", "vec_id", "cluster", "score", "selection_rank").collect())) == want


def test_candidates_are_not_dealt(spark, sf_dir):
    plan = plans.p4_contextual_recommendation(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "InPandas" not in plan and "Join" not in plan  # all that is joined is a row a user or a row a paper, and written
