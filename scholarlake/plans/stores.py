"""Queries over the operational stores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scholarlake.operators import assets as A
from scholarlake.operators import stores as S
from scholarlake.plans.registry import query
from scholarlake.sources.tables import EVENTS_SQL, PAPERS_SQL, events, papers, table

# joins


@query("""SELECT c_custkey, o_orderkey, CAST(o_totalprice AS DOUBLE) AS price, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'F'""")
def j1_inner_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select("o_custkey", "o_orderkey", F.col("o_totalprice").cast("double").alias("price"))
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "o_orderkey", "price", "n_name")


@query("""SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n_builds, (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1) AS latest,
  (SELECT o_orderstatus FROM orders WHERE o_custkey = c_custkey ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1) AS status FROM customer""")
def j2_latest_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.max(F.struct("o_orderdate", "o_orderkey", "o_orderstatus")).alias("r"))
    c = table(spark, sf_dir, "customer").select("c_custkey")
    return c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_builds"), F.col("r.o_orderkey").alias("latest"), F.col("r.o_orderstatus").alias("status"))


@query("SELECT s_suppkey, s_nationkey FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity > 49)")
def j3_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").filter("l_quantity > 49").select("l_suppkey")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    return s.join(li, F.col("s_suppkey") == F.col("l_suppkey"), "left_semi")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def j4_missing_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return table(spark, sf_dir, "documents").select("doc_id").join(v, "doc_id", "left_anti")


@query("""WITH c AS (SELECT doc_id, 0 AS p FROM labels WHERE quality = 1 UNION ALL SELECT doc_id, 1 FROM documents WHERE lang = 'de' UNION ALL SELECT doc_id, 2 FROM documents WHERE source = 'src2')
SELECT doc_id, CAST(min(p) AS BIGINT) AS source FROM c WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY doc_id""")
def j5_unseen_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    parts = [lab.filter("quality = 1"), d.filter("lang = 'de'"), d.filter("source = 'src2'")]
    rows = None
    for i, p in enumerate(parts):
        part = p.select("doc_id", F.lit(i).cast("long").alias("source"))
        rows = part if rows is None else rows.unionByName(part)
    seen = lab.filter("toxic = 1").select("doc_id")
    return rows.groupBy("doc_id").agg(F.min("source").alias("source")).join(seen, "doc_id", "left_anti")


@query("""WITH m AS (SELECT c.conv_id, turn, role, length(text) AS n FROM conversations c WHERE conv_id IN (SELECT conv_id FROM conversations WHERE role = 'system')),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM m) SELECT conv_id, turn, role, CAST(n AS BIGINT) AS n FROM r WHERE k <= 3""")
def j6_recent_owned_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.length("text").cast("long").alias("n"))
    owned = c.filter("role = 'system'").select("conv_id").distinct()
    return S.first_n_per(c.join(owned, "conv_id", "left_semi"), "conv_id", 3, F.desc("turn")).drop("rank")


@query("""SELECT o_orderpriority, count(DISTINCT o_orderkey) AS n_orders, count(l_orderkey) AS n_lines, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS returned FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1""")
def j7_lifecycle_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("r"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority").join(li, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return o.groupBy("o_orderpriority").agg(F.count("*").alias("n_orders"), F.sum(F.coalesce("n", F.lit(0))).cast("long").alias("n_lines"), F.sum(F.coalesce("r", F.lit(0))).cast("long").alias("returned"))


@query("""SELECT a.o_orderkey AS run, b.o_orderkey AS continuation FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND b.o_orderdate = a.o_orderdate AND b.o_orderkey > a.o_orderkey WHERE a.o_orderstatus = 'O'
UNION ALL SELECT o_orderkey, NULL FROM orders WHERE o_orderstatus = 'P'""")
def j8_continuations(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus")
    b = o.select(F.col("o_orderkey").alias("continuation"), F.col("o_custkey").alias("c"), F.col("o_orderdate").alias("d"))
    a = o.filter("o_orderstatus = 'O'").join(b, (F.col("o_custkey") == F.col("c")) & (F.col("o_orderdate") == F.col("d")) & (F.col("continuation") > F.col("o_orderkey")))
    open_ = o.filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("run"), F.lit(None).cast("long").alias("continuation"))
    return a.select(F.col("o_orderkey").alias("run"), "continuation").unionByName(open_)


@query("""WITH s AS (SELECT vec_id AS id, 'vector' AS src, 0 AS p FROM embeddings UNION ALL SELECT doc_id, 'recent', 1 FROM documents WHERE lang = 'en' UNION ALL SELECT doc_id, 'labelled', 2 FROM labels)
SELECT src, count(*) AS n FROM (SELECT id, arg_min(src, p) AS src FROM s GROUP BY id) GROUP BY src""")
def j14_source_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = lambda df, key, src, p: df.select(F.col(key).alias("id"), F.lit(src).alias("src"), F.lit(p).alias("p"))
    rows = named(table(spark, sf_dir, "embeddings"), "vec_id", "vector", 0).union(named(table(spark, sf_dir, "documents").filter("lang = 'en'"), "doc_id", "recent", 1)).union(named(table(spark, sf_dir, "labels"), "doc_id", "labelled", 2))
    return rows.groupBy("id").agg(F.min_by("src", "p").alias("src")).groupBy("src").agg(F.count("*").alias("n"))


#: Documents as sections of papers, twenty each, that mention a label now and then; orders as assets of them.
_SECTIONS = r"""se AS (SELECT doc_id // 20 AS paper, doc_id % 20 AS section, doc_id % 20 * 3 + doc_id % 3 AS first_page, doc_id % 20 * 3 + doc_id % 3 + least(n_chars // 3000, 4) AS last_page, doc_id % 20 * 10 AS heading_order,
  text || CASE doc_id % 4 WHEN 0 THEN ' See TABLE ' || (doc_id // 4 % 12) || '.' WHEN 1 THEN ' As fig. ' || (doc_id // 4 % 12) || ' shows' ELSE '' END AS text FROM documents),
ast AS (SELECT o_orderkey AS asset, o_orderkey % 50 AS paper, o_orderkey % 2 = 0 AS is_table, o_custkey % 75 AS page, o_orderkey % 230 AS ord, CASE WHEN o_custkey % 3 > 0 THEN CAST(o_custkey % 29 AS VARCHAR) END AS label FROM orders),
me AS (SELECT DISTINCT paper, section, true AS is_table, unnest(regexp_extract_all(lower(text), '(?:^|[^a-z])(?:table|tab\.?)\s*([0-9]+)(?:[^0-9a-z]|$)', 1)) AS label FROM se UNION ALL SELECT DISTINCT paper, section, false, unnest(regexp_extract_all(lower(text), '(?:^|[^a-z])(?:figure|fig\.?)\s*([0-9]+)(?:[^0-9a-z]|$)', 1)) FROM se),
na AS (SELECT asset, paper, any_value(page) AS page, min(section) AS section, count(DISTINCT section) AS n FROM ast JOIN me USING (paper, is_table, label) GROUP BY 1, 2),
nr AS (SELECT asset, section, 'caption_reference' AS relation, CASE WHEN page <= 0 OR page BETWEEN first_page AND last_page THEN 0 WHEN last_page < page THEN page - last_page ELSE first_page - page END AS gap, 0 AS far, n FROM na JOIN se USING (paper, section)),
pr AS (SELECT asset, section, CASE WHEN page BETWEEN first_page AND last_page THEN 'inside' WHEN last_page < page THEN 'before' ELSE 'after' END AS relation, CASE WHEN page BETWEEN first_page AND last_page THEN page - first_page WHEN last_page < page THEN page - last_page ELSE first_page - page END AS gap, abs(ord - heading_order) AS far, 0 AS n
  FROM ast JOIN se USING (paper) WHERE asset NOT IN (SELECT asset FROM na) QUALIFY row_number() OVER (PARTITION BY asset ORDER BY CASE WHEN page BETWEEN first_page AND last_page THEN 0 WHEN last_page < page THEN 1 ELSE 2 END, gap, far, section) = 1),
cf AS (SELECT asset, section, relation, gap, round(CASE WHEN relation = 'caption_reference' THEN greatest(0.75, least(0.98, 0.94 - least(0.12, gap * 0.02) - CASE WHEN n > 1 THEN 0.02 ELSE 0 END))
  ELSE greatest(0, least(0.95, CASE WHEN relation = 'inside' AND gap = 0 THEN 0.76 WHEN relation = 'inside' THEN 0.70 WHEN relation = 'before' THEN CASE WHEN gap <= 1 THEN 0.58 ELSE 0.42 END WHEN gap <= 1 THEN 0.42 ELSE 0.28 END - least(0.18, far * 0.003))) END, 3) AS c FROM (SELECT * FROM nr UNION ALL SELECT * FROM pr))"""


@query(f"WITH {_SECTIONS} SELECT asset, CAST(section AS BIGINT) AS section, relation, CAST(gap AS BIGINT) AS page_gap, CAST(c AS DOUBLE) AS confidence, CAST(c AS DOUBLE) >= 0.7 AS embeds FROM cf")
def j15_asset_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, n = F.col("doc_id"), F.floor(F.col("doc_id") / 4) % 12
    first = i % 20 * 3 + i % 3
    mention = F.when(i % 4 == 0, F.concat(F.lit(" See TABLE "), n.cast("string"), F.lit("."))).when(i % 4 == 1, F.concat(F.lit(" As fig. "), n.cast("string"), F.lit(" shows"))).otherwise("")
    sections = table(spark, sf_dir, "documents").select(F.floor(i / 20).alias("paper"), (i % 20).alias("section"), first.alias("first_page"), (first + F.least(F.floor(F.col("n_chars") / 3000), F.lit(4))).alias("last_page"), (i % 20 * 10).alias("heading_order"), F.concat("text", mention).alias("text"))
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    name = F.when(k % 2 == 0, "Table").otherwise("Figure")
    caption = F.when(c % 3 > 0, F.concat(name, F.lit(" "), (c % 29).cast("string"), F.lit(": what it shows"))).otherwise("without a number")
    assets = table(spark, sf_dir, "orders").select(k.alias("asset"), (k % 50).alias("paper"), F.when(k % 2 == 0, "table").otherwise("picture").alias("kind"), caption.alias("caption"), (c % 75).alias("page"), (k % 230).alias("order"))
    return A.sections_of(assets, sections)


# aggregates


@query("""SELECT conv_id, count(*) AS n_messages, min(turn) AS first_turn, max(turn) AS last_turn, arg_min(text, turn) FILTER (role = 'user') AS title FROM conversations GROUP BY conv_id""")
def a1_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.sessions(table(spark, sf_dir, "conversations"))


@query(f"""WITH {EVENTS_SQL} SELECT category, count(*) AS n FROM (SELECT unnest([source, lang]) AS category FROM ev JOIN documents ON doc_id = k WHERE event_type = 'purchase') GROUP BY category""")
def a2_liked_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    liked = events(spark, sf_dir).filter("event_type = 'purchase'").groupBy("k").agg(F.count("*").alias("n"))
    p = papers(spark, sf_dir).select("paper_id", "categories")
    return p.join(liked, F.col("paper_id") == F.col("k")).select(F.explode("categories").alias("category"), "n").groupBy("category").agg(F.sum("n").cast("long").alias("n"))


@query(f"""WITH {EVENTS_SQL} SELECT user_id, count(DISTINCT k) AS n_labelled FROM ev WHERE event_type IN ('purchase', 'error') GROUP BY user_id""")
def a3_labelled_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    both = e.filter("event_type = 'purchase'").select("user_id", "k").union(e.filter("event_type = 'error'").select("user_id", "k")).distinct()
    return both.groupBy("user_id").agg(F.count("k").alias("n_labelled"))


@query(f"""WITH {EVENTS_SQL} SELECT user_id, max(epoch) AS latest FROM ev WHERE event_type <> 'signup' GROUP BY user_id""")
def a4_latest_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    rows = None
    for kind in ("view", "click", "purchase", "error"):
        part = e.filter(F.col("event_type") == kind).select("user_id", "epoch")
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("user_id").agg(F.max("epoch").alias("latest"))


@query(f"""WITH {EVENTS_SQL} SELECT user_id, count(*) FILTER (value > 50) AS dirty, count(*) FILTER (event_type = 'view') AS views, round(sum(value), 4) AS total FROM ev GROUP BY user_id""")
def a5_dirty_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy("user_id").agg(F.count(F.when(F.col("value") > 50, 1)).alias("dirty"), F.count(F.when(F.col("event_type") == "view", 1)).alias("views"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT count(DISTINCT d.doc_id) AS papers, count(DISTINCT e.vec_id) AS embedded, count(DISTINCT l.doc_id) AS labelled FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id")
def a6_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.lit("p").alias("t"))
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit("e").alias("t"))
    lab = table(spark, sf_dir, "labels").select("doc_id", F.lit("l").alias("t"))
    by = rows.union(e).union(lab).groupBy("doc_id").agg(F.max(F.col("t") == "p").alias("p"), F.max(F.col("t") == "e").alias("e"), F.max(F.col("t") == "l").alias("l")).filter("p")
    return by.agg(F.count("*").alias("papers"), F.count(F.when(F.col("e"), 1)).alias("embedded"), F.count(F.when(F.col("l"), 1)).alias("labelled"))


@query("""SELECT l_linestatus, CAST(sum(l_quantity) AS DOUBLE) AS tokens, round(sum(l_extendedprice * (1 - l_discount)), 2) AS cost, count(*) AS calls FROM lineitem GROUP BY l_linestatus""")
def a24_usage_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_linestatus").agg(F.sum("l_quantity").cast("double").alias("tokens"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("cost"), F.count("*").alias("calls"))


@query("""SELECT role, count(*) AS n, CAST(min(n) AS BIGINT) AS least, CAST(quantile_disc(n, 0.5) AS BIGINT) AS p50, CAST(quantile_disc(n, 0.9) AS BIGINT) AS p90, CAST(max(n) AS BIGINT) AS most, round(avg(n), 6) AS mean,
 count(*) FILTER (n < 200) AS h0, count(*) FILTER (n >= 200 AND n < 800) AS h1, count(*) FILTER (n >= 800) AS h2 FROM (SELECT role, length(text) AS n FROM conversations) GROUP BY role""")
def a11_length_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("role", F.length("text").cast("long").alias("n"))
    bucket = F.when(F.col("n") < 200, 0).when(F.col("n") < 800, 1).otherwise(2)
    return c.groupBy("role").agg(
        F.count("*").alias("n"), F.min("n").alias("least"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY n)").cast("long").alias("p50"), F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY n)").cast("long").alias("p90"),
        F.max("n").alias("most"), F.round(F.avg("n"), 6).alias("mean"), *[F.count(F.when(bucket == i, 1)).alias(f"h{i}") for i in range(3)],
    )


# sorts, limits and sets


@query("SELECT p_partkey, p_size, round(p_retailprice, 2) AS price FROM part ORDER BY p_size DESC, p_retailprice, p_partkey LIMIT 100")
def o1_mixed_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", "p_size", F.round("p_retailprice", 2).alias("price")).orderBy(F.desc("p_size"), "price", "p_partkey").limit(100)


@query("SELECT o_orderkey, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS total FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 40")
def o2_page_with_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select("o_orderkey", "o_orderdate")
    total = o.agg(F.count("*").alias("total")).withColumn("_one", F.lit(1))
    page = o.orderBy(F.desc("o_orderdate"), "o_orderkey").offset(40).limit(20).withColumn("_one", F.lit(1))
    return page.join(F.broadcast(total), "_one").select("o_orderkey", "total")


@query("""SELECT status, count(*) AS n FROM (SELECT CASE WHEN o_orderstatus = 'P' THEN 'running' WHEN o_orderstatus = 'F' AND o_totalprice > 200000 THEN 'failed' WHEN o_orderstatus = 'F' THEN 'active' ELSE 'pending' END AS status FROM orders WHERE o_orderpriority LIKE '%-%') GROUP BY status""")
def o3_status_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "P", "running").when((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 200000), "failed").when(F.col("o_orderstatus") == "F", "active").otherwise("pending")
    return table(spark, sf_dir, "orders").filter(F.col("o_orderpriority").like("%-%")).groupBy(status.alias("status")).agg(F.count("*").alias("n"))


@query("SELECT doc_id FROM labels WHERE quality = 1 UNION SELECT doc_id FROM documents WHERE lang = 'fr'")
def o4_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id").union(table(spark, sf_dir, "documents").filter("lang = 'fr'").select("doc_id")).distinct()


@query("SELECT doc_id, 'label' AS origin FROM labels UNION ALL SELECT doc_id, 'text' FROM documents WHERE lang = 'fr'")
def o5_union_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select("doc_id", F.lit("label").alias("origin")).unionByName(table(spark, sf_dir, "documents").filter("lang = 'fr'").select("doc_id", F.lit("text").alias("origin")))


@query("SELECT doc_id FROM documents EXCEPT SELECT vec_id FROM embeddings WHERE label IN (0, 1, 2, 3)")
def o6_unclustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").filter("label in (0, 1, 2, 3)").select(F.col("vec_id").alias("doc_id"))
    return table(spark, sf_dir, "documents").select("doc_id").join(v, "doc_id", "left_anti").distinct()


@query(r"""WITH w AS (SELECT conv_id, turn, regexp_split_to_array(text, '\s+') AS ws FROM conversations)
SELECT conv_id, turn, array_to_string(list_filter(ws, lambda x, i: list_position(list_transform(ws, lambda y: lower(trim(y))), lower(trim(x))) = i), ' ') AS uniq FROM w""")
def o7_unique_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.split("text", r"\s+").alias("ws"))
    return c.select("conv_id", "turn", F.array_join(S.unique_in_order(F.col("ws")), " ").alias("uniq"))


# windows over stores


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations) WHERE k <= 2 ORDER BY conv_id, turn")
def w12_last_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return S.first_n_per(c, "conv_id", 2, F.desc("turn")).drop("rank").orderBy("conv_id", "turn")


@query("SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def w13_latest_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey", "o_orderstatus")).alias("r"))
    return o.select("o_custkey", "r.o_orderkey", "r.o_orderstatus")


# limits, quotas, leases


@query(f"""WITH {EVENTS_SQL}, n AS (SELECT user_id, epoch - epoch % 3600 AS w, row_number() OVER (PARTITION BY user_id, epoch - epoch % 3600 ORDER BY epoch, event_id) AS nth FROM ev)
SELECT user_id, w AS window_start, count(*) FILTER (nth <= 2) AS allowed, count(*) FILTER (nth > 2) AS rejected FROM n GROUP BY 1, 2""")
def t4_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = S.window_counts(events(spark, sf_dir), 3600)
    return n.groupBy("user_id", "window_start").agg(F.count(F.when(F.col("nth") <= 2, 1)).alias("allowed"), F.count(F.when(F.col("nth") > 2, 1)).alias("rejected"))


@query(f"""WITH {EVENTS_SQL}, c AS (SELECT event_id, user_id, sum(1 + k % 3) OVER (PARTITION BY user_id, epoch // 86400 ORDER BY epoch, event_id) AS used FROM ev)
SELECT event_id, CAST(used AS BIGINT) AS used, used <= 5 AS within FROM c""")
def t5_daily_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id", F.floor(F.col("epoch") / 86400)).orderBy("epoch", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    e = events(spark, sf_dir).select("event_id", F.sum(F.lit(1) + F.col("k") % 3).over(w).cast("long").alias("used"))
    return e.withColumn("within", F.col("used") <= 5)


#: Refused logins and refused requests: every event of type error or view stands for a burst of as many refusals as its value's whole number.
_BURSTS = f"""{EVENTS_SQL}, rf AS (SELECT user_id, CASE event_type WHEN 'error' THEN 'auth_failures' ELSE 'rate_violations' END AS kind, epoch, CAST(floor(value) AS BIGINT) AS n FROM ev WHERE event_type IN ('error', 'view')),
o AS (SELECT user_id, epoch - epoch % 60 AS m FROM rf GROUP BY user_id, kind, epoch - epoch % 60 HAVING sum(n) > CASE kind WHEN 'auth_failures' THEN 20 ELSE 30 END)"""


@query(f"""WITH RECURSIVE {_BURSTS},
b AS (SELECT user_id, min(m) AS f FROM o GROUP BY user_id UNION ALL SELECT b.user_id, (SELECT min(m) FROM o WHERE o.user_id = b.user_id AND m >= b.f + 900) FROM b WHERE b.f IS NOT NULL AND EXISTS (SELECT 1 FROM o WHERE o.user_id = b.user_id AND m >= b.f + 900))
SELECT user_id, f AS from_epoch, f + 900 AS until_epoch FROM b""")
def t6_abuse_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).filter(F.col("event_type").isin("error", "view"))
    return S.blocks(e.select("user_id", F.when(F.col("event_type") == "error", "auth_failures").otherwise("rate_violations").alias("kind"), "epoch", F.floor("value").cast("long").alias("n")))


@query(f"""WITH {EVENTS_SQL} SELECT user_id, event_type, min(event_id) AS event_id, arg_max(value, epoch * 10000000 + event_id) AS value, count(*) AS times FROM ev WHERE k > 0 GROUP BY 1, 2""")
def t7_event_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).filter("k > 0").groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"), F.max_by("value", F.struct("epoch", "event_id")).alias("value"), F.count("*").alias("times"))


@query(f"""WITH {EVENTS_SQL} SELECT user_id, count(*) AS live, count(*) FILTER (epoch + 604800 <= 1706745600) AS expired FROM ev WHERE event_type IN ('view', 'click') GROUP BY user_id""")
def t8_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).filter(F.col("event_type").isin("view", "click"))
    return e.groupBy("user_id").agg(F.count("*").alias("live"), F.count(F.when(F.col("epoch") + 604800 <= 1706745600, 1)).alias("expired"))


@query(f"""WITH {EVENTS_SQL}, d AS (SELECT event_type, CAST(make_timestamp(epoch * 1000000) AS DATE) AS day, bool_and(value < 99.9) AS ok FROM ev GROUP BY 1, 2),
n AS (SELECT *, day - min(day) OVER (PARTITION BY event_type) AS gap, row_number() OVER (PARTITION BY event_type ORDER BY day) - 1 AS k, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY event_type ORDER BY day) AS bad FROM d)
SELECT event_type, strftime(max(day) FILTER (gap = k AND bad = 0), '%Y-%m-%d') AS cursor FROM n GROUP BY event_type""")
def t1_contiguous_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = events(spark, sf_dir).groupBy("event_type", F.to_date("ts").alias("day")).agg(F.min(F.col("value") < 99.9).alias("ok"))
    return S.contiguous(d, "event_type", "day", "ok").select("event_type", F.date_format("cursor", "yyyy-MM-dd").alias("cursor"))


@query("""WITH j AS (SELECT o_orderkey AS job, o_orderstatus AS s, CAST(datediff('day', o_orderdate, DATE '1998-01-01') AS BIGINT) AS idle, CAST(o_orderkey % 5 AS BIGINT) AS attempts FROM orders)
SELECT job, CASE WHEN s <> 'O' THEN 'kept' WHEN idle <= 30 THEN 'leased' WHEN attempts < 3 THEN 'retrying' ELSE 'failed' END AS next_state FROM j""")
def t3_expired_leases(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job"), F.col("o_orderstatus").alias("s"), F.datediff(F.lit("1998-01-01").cast("date"), F.to_date("o_orderdate")).alias("idle"), (F.col("o_orderkey") % 5).alias("attempts"))
    return j.select("job", F.when(F.col("s") != "O", "kept").when(F.col("idle") <= 30, "leased").when(F.col("attempts") < 3, "retrying").otherwise("failed").alias("next_state"))


@query(f"""WITH {EVENTS_SQL}, e AS (SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY epoch, event_id) AS before FROM ev)
SELECT coalesce(before, 'start') AS before, event_type AS after, count(*) AS n FROM e GROUP BY 1, 2""")
def t9_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("epoch", "event_id")
    return events(spark, sf_dir).select(F.coalesce(F.lag("event_type").over(w), F.lit("start")).alias("before"), F.col("event_type").alias("after")).groupBy("before", "after").agg(F.count("*").alias("n"))


@query(f"""WITH {EVENTS_SQL}, a AS (SELECT user_id, k AS item, event_type, epoch, event_id FROM ev WHERE event_type IN ('purchase', 'error'))
SELECT user_id, item, CASE WHEN arg_max(event_type, epoch * 10000000 + event_id) = 'purchase' THEN 'liked' ELSE 'disliked' END AS preference, max(epoch) AS at FROM a GROUP BY 1, 2""")
def p15_mutual_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.strong_preferences(events(spark, sf_dir))


@query(f"""WITH {PAPERS_SQL} SELECT doc_id AS id, created FROM labels JOIN papers ON paper_id = doc_id WHERE quality = 1 ORDER BY created DESC, id LIMIT 60""")
def j1_newest_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = table(spark, sf_dir, "labels").filter("quality = 1").select(F.col("doc_id").alias("id"))
    p = papers(spark, sf_dir).select(F.col("paper_id").alias("id"), "created")
    return lab.join(p, "id").orderBy(F.desc("created"), "id").limit(60)
