import random

from pyspark.sql import functions as F

from scholarlake.functions import text as T
from scholarlake.operators import chunks, greedy, mirror, recommend, retrieval
from scholarlake.operators import stores as S
from scholarlake.sources import harvest
from scholarlake.streaming import incremental


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def test_fusion_does_not_depend_on_order(spark):
    data = [(1, d, r, k) for k, ds in (("a", [3, 1, 2]), ("b", [2, 3, 9])) for r, d in enumerate(ds, 1)]
    fused = lambda rows: {tuple(x) for x in retrieval.fuse(spark.createDataFrame(rows, "query_id int, doc int, rank int, route string"), {"a": 1.0, "b": 0.5}, "doc").withColumn("score", F.round("score", 9)).collect()}
    again = data[:]
    random.Random(1).shuffle(again)
    assert fused(data) == fused(again)
    assert {r[1]: r[2] for r in fused(data)}[3] == round(1 / 61 + 0.5 / 62, 9)


def test_min_max_of_equals_is_one(spark):
    rows = retrieval.min_max(spark.createDataFrame([(1, 2.0), (1, 2.0), (2, 0.0), (2, 4.0)], "g int, x double"), ["g"], "x").collect()
    assert sorted((r.g, r.normal) for r in rows) == [(1, 1.0), (1, 1.0), (2, 0.0), (2, 1.0)]


def test_cosine_of_different_lengths_is_zero(spark):
    a, b = F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0))
    assert one(spark, retrieval.cosine(a, b, F.lit(1.0))) == 0.0


def test_upsert_last_batch_wins(spark):
    b = lambda *r: spark.createDataFrame(list(r), "id int, x string")
    assert sorted(map(tuple, mirror.upserted([b((1, "a"), (2, "a")), b((1, "b"))], "id").collect())) == [(1, "b"), (2, "a")]


def test_blocks_are_not_extended(spark):
    rows = [(1, "auth_failures", t, 3) for t in (0, 10, 300, 310, 900, 905, 2000)] + [(1, "rate_violations", 2005, 6), (2, "auth_failures", 0, 4), (2, "rate_violations", 30, 5), (2, "other", 0, 99), (3, "rate_violations", 61, 7)]
    e = spark.createDataFrame(rows, "user_id long, kind string, epoch long, n long")
    got = sorted((r.user_id, r.from_epoch, r.until_epoch) for r in S.blocks(e, {"auth_failures": 4, "rate_violations": 5}).collect())
    # minute 300 lies in the first block, minutes 2000 count each kind by itself
    assert got == [(1, 0, 900), (1, 900, 1800), (1, 1980, 2880), (3, 60, 960)]


def test_utf8_cut_keeps_whole_characters(spark):
    assert one(spark, T.utf8_cut(F.lit("aé日😀"), 6)) == "aé日"
    assert one(spark, T.utf8_cut(F.lit("aé日😀"), 7)) == "aé日"
    assert one(spark, T.utf8_cut(F.lit("aé日😀"), 10)) == "aé日😀"


def test_skipped_items_cost_nothing(spark):
    rows = [("g", 1, 3.0, 0.9, 1, True, 90), ("g", 2, 2.0, 0.8, 1, False, 50), ("g", 3, 1.0, 0.7, 1, False, 10)]
    df = spark.createDataFrame(rows, "g string, k int, priority double, score double, n_anchors int, is_anchor boolean, size int")
    assert {r.k: r.decision for r in greedy.select_with_budget(df, "g", "k", 5, 100).collect()} == {1: "anchor", 2: "over_budget", 3: "fill"}


def test_all_candidates_take_part(spark):
    big = [("g", i, 9.0, 0.9, 1, False, 50) for i in range(1000)]
    rows = [*big, ("g", 1000, 1.0, 0.1, 2, False, 10), ("g", 1001, 0.5, 0.1, 1, True, 10), ("h", 1, 1.0, 1.0, 1, False, 5)]
    df = spark.createDataFrame(rows, "g string, k int, priority double, score double, n_anchors int, is_anchor boolean, size int")
    got = {(r.g, r.k): r.decision for r in greedy.select_with_budget(df, "g", "k", 5, 30).collect()}
    assert got == {("g", i): "over_budget" for i in range(1000)} | {("g", 1000): "shared", ("g", 1001): "anchor", ("h", 1): "fill"}


def test_all_topics_join_their_best_leader(spark):
    rng = random.Random(2)
    topics = [(f"t{i:04}", rng.sample([f"w{j}" for j in range(60)], rng.randint(1, 4)), rng.randint(1, 50)) for i in range(700)]
    leaders, want = [], {}
    for label, tokens, _ in sorted(topics, key=lambda t: (-t[2], t[0])):
        like = [(len(set(tokens) & u) / len(set(tokens) | u), -i) for i, (_, u) in enumerate(leaders)]
        best = max(like, default=(0.0, 0))
        if best[0] >= 0.3:
            want[label] = leaders[-best[1]][0]
        else:
            leaders.append((label, set(tokens)))
            want[label] = label
    df = spark.createDataFrame([("a", *t) for t in topics], "role string, label string, tokens array<string>, weight int")
    assert {r.label: r.leader for r in greedy.leader_clusters(df, "role", 0.3).collect()} == want


def test_density_clusters_keep_all_rows(spark):
    rows = [(1, i, [1.0, 0.0] if i % 2 else [0.0, 1.0]) for i in range(2300)] + [(1, 5000, [-1.0, -1.0])]
    got = {r.k: r.cluster for r in greedy.density_clusters(spark.createDataFrame(rows, "g int, k int, v array<double>"), "g", "k", "v").collect()}
    assert got == {i: i % 2 for i in range(2300)} | {5000: -1}


def test_split_overlaps_and_covers(spark):
    text = "word " * 100
    df = spark.createDataFrame([(1, text)], "id int, t string").lateralJoin(greedy.SplitOverlong(F.col("t").outer(), F.lit(120), F.lit(20), F.lit(30)))
    parts = sorted((r.start, r.chunk) for r in df.collect())
    assert all(len(c) <= 120 for _, c in parts) and all(b[0] < a[0] + len(a[1]) for a, b in zip(parts, parts[1:]))  # noqa: B905
    assert all(text[s : s + len(c)] == c for s, c in parts) and parts[-1][0] + len(parts[-1][1]) == len(text)


def test_heading_stack(spark):
    rows = [(1, 0, "# A", 1), (1, 1, "x", 0), (1, 2, "## B", 2), (1, 3, "y", 0), (1, 4, "# C", 1), (1, 5, "z", 0)]
    df = greedy.heading_paths(spark.createDataFrame(rows, "d int, pos int, line string, level int"), "d")
    assert [r.path for r in df.orderBy("pos").collect()] == ["A", "A", "A > B", "A > B", "C", "C"]


def test_mean_and_penalty(spark):
    v = spark.createDataFrame([(1, [1.0, 3.0]), (1, [3.0, 5.0])], "g int, v array<double>")
    assert recommend.mean_vector(v, "g", "v").first()["mean"] == [2.0, 4.0]
    assert one(spark, recommend.penalty(F.lit(0.9), F.lit(0.6), F.lit(6))) == 0.0
    assert one(spark, recommend.penalty(F.lit(0.5), F.lit(0.9), F.lit(6))) == 0.22


def test_candidates_are_the_nearest_of_all(spark):
    rng = random.Random(3)
    rows = [(i, i % 3, [float(i % 3 == j) + rng.random() / 3 for j in range(3)]) for i in range(300)]
    v = spark.createDataFrame(rows, "vec_id long, label int, v array<double>").withColumn("norm", recommend.norm(F.col("v")))
    means = {c: [sum(r[2][j] for r in rows if r[1] == c) / 100 for j in range(3)] for c in range(3)}
    centroids = spark.createDataFrame(list(means.items()), "cluster int, mean array<double>")
    size = lambda a: sum(x * x for x in a) ** 0.5
    like = lambda a, b: round(sum(x * y for x, y in zip(a, b, strict=True)) / size(a) / size(b), 6)
    top = lambda c: {r[0] for r in sorted(rows, key=lambda r: (-like(r[2], means[c]), r[0]))[:10]}
    users = spark.createDataFrame([(1,), (2,), (3,)], "user_id long")
    liked = spark.createDataFrame([(1, 4), (2, 0), (2, 5)], "user_id long, vec_id long")
    got = {}
    for r in recommend.candidates(users, liked, v, centroids, 10, 5).collect():
        got.setdefault(r.user_id, []).append(r.vec_id)
    assert {u: sorted(x) for u, x in got.items()} == {1: sorted(top(1)), 2: sorted(top(0) | top(2)), 3: [295, 296, 297, 298, 299]}


def test_evidence_of_a_hot_group_is_streamed(spark):
    rng = random.Random(4)
    rows = [("hot" if i % 9 else "b", rng.randrange(80), i, rng.randint(1, 60)) for i in range(20_000)]
    want = set()
    for g in ("hot", "b"):
        seen, left = [], 900
        for _, k, _, size in sorted((r for r in rows if r[0] == g), key=lambda r: (r[2], r[1])):
            if k not in seen and len(seen) < 40 and size <= left:
                seen.append(k)
                left -= size
        want |= {(g, k, i) for i, k in enumerate(seen, 1)}
    out = greedy.merge_evidence(spark.createDataFrame(rows, "source string, key int, arrived int, size int"), "source", 40, 900)
    assert {tuple(r) for r in out.collect()} == want
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().toString()


def test_chunks_of_a_hot_user_are_read_in_order(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, 7, 1_700_000_000 + rng.randrange(50) * 600, rng.choice(["view", "click", "purchase"])) for i in range(900)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, epoch long, event_type string").withColumn("ts", F.timestamp_seconds("epoch")).drop("epoch")
    df.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    used, want = {}, {}
    for i, _, at, _ in sorted(rows, key=lambda r: (r[2], r[0])):
        used[at // 3600] = used.get(at // 3600, 0) + 1
        want[i] = used[at // 3600] <= 2
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, "50")
    try:
        got = {r.event_id: r.allowed for r in incremental.drained(incremental.rate_limited(incremental.event_stream(spark, str(tmp_path)), 2, 3600)).collect()}
    finally:
        spark.conf.set(key, old)
    assert got == want


def test_units_dedupe_is_idempotent(spark):
    d = spark.createDataFrame([(1, "A b\na  B\nc\nc")], "id int, text string")
    once = chunks.deduped_units(d, "id", F.split("text", "\n"))
    assert sorted((r.pos, r.line) for r in once.collect()) == [(0, "A b"), (2, "c")]


def test_ids_and_errors_of_harvested_pages(spark):
    page = '<OAI-PMH><error code="badResumptionToken">gone</error></OAI-PMH>'
    r = harvest.parsed_pages(spark.createDataFrame([(page,)], "xml string")).first()
    assert (r.error_code, r.token, r.records) == ("badResumptionToken", None, None)
    assert one(spark, harvest.normal_id(F.lit("https://host.org/abs/2401.00001v3"))) == "2401.00001"


def test_published_build(spark, tmp_path):
    root = "file://" + str(tmp_path)
    harvest.publish(spark.range(3), root, "idx", 1, [("ids", F.col("id") >= 0)])
    harvest.publish(spark.range(5), root, "idx", 2)
    assert harvest.active(spark, root, "idx").count() == 5


def test_records_come_back_by_day(spark, tmp_path):
    schema = "case_id string, score double, day string"
    harvest.write_records(spark.createDataFrame([("a", 0.5, "2024-01-01"), ("b", None, "2024-01-02")], schema), str(tmp_path), "day")
    harvest.write_records(spark.createDataFrame([("c", 1.0, "2024-01-02")], schema), str(tmp_path), "day")
    got = {(r.case_id, r.score, str(r.day)) for r in harvest.read_records(spark, str(tmp_path), schema).collect()}
    assert got == {("a", 0.5, "2024-01-01"), ("b", None, "2024-01-02"), ("c", 1.0, "2024-01-02")}
    assert (tmp_path / "day=2024-01-02").exists()


def test_nearest_of_ragged_equal_and_empty_vectors(spark):
    """Blocks against all pairs, one after the other: copies tie by id, other lengths and norms of 0 are like nothing; nothing but the best of a task is dealt."""
    import random

    from scholarlake.operators import retrieval as R

    r = random.Random(7)
    rows = [(i, [r.uniform(-1, 1) for _ in range(8)] if i % 5 else [0.5] * 8) for i in range(3000)] + [(3000, [0.0] * 8), (3001, [1.0]), (3002, []), (3003, None)]
    v = spark.createDataFrame(rows, "vec_id long, v array<double>").coalesce(1).selectExpr("*", "sqrt(aggregate(v, 0D, (a, x) -> a + x * x)) as norm")
    q = v.filter("vec_id in (0, 1, 2, 3000, 3001, 3002, 3003)").selectExpr("vec_id as query_id", "v as q", "norm as q_norm")
    got = R.nearest(q, v, 4)
    pairs = v.crossJoin(q).filter("query_id <> vec_id").select("query_id", "vec_id", F.round(R.cosine(F.col("q"), F.col("v"), F.col("q_norm") * F.col("norm")), 6).alias("similarity"))
    want = R.ranked(pairs, ["query_id"], F.desc("similarity"), F.asc("vec_id"), n=4)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert "NestedLoopJoin" not in got._jdf.queryExecution().executedPlan().toString()


def test_topics_like_many_copies(spark):
    """Copies of a title meet once: what joins titles has a row a different one, and the first other copy counts."""
    from scholarlake.operators import profile as P

    c = spark.range(400).selectExpr("id as doc_id", "if(id % 2 = 0, 'Graph models', concat('models of ', id)) as text")
    t = c.filter("doc_id in (0, 2, 4)").selectExpr("doc_id as item_id", "text")
    df = P.similar_topics(t, c)
    assert sorted(map(tuple, df.collect())) == [(0, 2, 1.0), (2, 0, 1.0), (4, 0, 1.0)]
    # of the copies of a title two are left before titles meet
    assert "WindowGroupLimit [b#" in df._jdf.queryExecution().optimizedPlan().toString()
