"""Boolean metadata search and the tables behind it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scholarlake.functions import text as T
from scholarlake.operators import boolean_query as bq
from scholarlake.operators import mirror
from scholarlake.plans.registry import query
from scholarlake.sources.tables import PAPERS_SQL, papers, table

_MARKS = f"'{T.MARKED}', '{T.PLAIN}'"
_TOKENS = (
    rf"regexp_extract_all(translate(lower(title), {_MARKS}), '[\p{{L}}\p{{N}}]+') AS t, "
    rf"regexp_extract_all(translate(lower(abstract), {_MARKS}), '[\p{{L}}\p{{N}}]+') AS a, "
    rf"regexp_extract_all(translate(lower(array_to_string(authors, ', ')), {_MARKS}), '[\p{{L}}\p{{N}}]+') AS u, "
    rf"regexp_extract_all(translate(lower(array_to_string(categories, ', ')), {_MARKS}), '[\p{{L}}\p{{N}}]+') AS g"
)
INDEXED_SQL = f"{PAPERS_SQL}, idx0 AS (SELECT *, {_TOKENS} FROM papers), idx AS (SELECT *, list_concat(list_concat(t, u), a) AS al, ' ' || array_to_string(list_concat(list_concat(t, u), a), ' ') || ' ' AS joined FROM idx0)"


def _relevance(hit: str) -> str:
    return " + ".join(f"{w} * CAST({hit.format(c)} AS INT)" for c, w in (("t", 8), ("a", 5), ("g", 3), ("u", 1)))


def _page(where: str, score: str, order: str, limit: str, pool: str = "") -> str:
    return f"""WITH {INDEXED_SQL}, hits AS (SELECT paper_id, created, CAST({score} AS BIGINT) AS score FROM idx WHERE {where})
SELECT paper_id, created, score, (SELECT count(*) FROM hits) AS total FROM {pool or 'hits'} ORDER BY {order} {limit}"""


@query(_page("list_contains(al, 'the') AND NOT list_contains(al, 'of')", _relevance("list_contains({}, 'the')"), "created DESC, paper_id DESC", "LIMIT 20"))
def q1_boolean_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bq.search(papers(spark, sf_dir), "all:the ANDNOT all:of", n=20)


@query(_page("contains(joined, ' of the ')", _relevance("contains(' ' || array_to_string({}, ' ') || ' ', ' of the ')"), "score DESC, created DESC, paper_id DESC", "LIMIT 25 OFFSET 5", "(SELECT * FROM hits ORDER BY created DESC, paper_id DESC LIMIT 500)"))
def q11_relevance_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bq.search(papers(spark, sf_dir), 'all:"of the"', sort="relevance", start=5, n=25)


@query(_page("list_contains(t, 'the') AND (list_contains(categories, 'src1') OR list_contains(categories, 'de'))", "10", "created DESC, paper_id DESC", "LIMIT 30"))
def q6_or_binds_tighter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bq.search(papers(spark, sf_dir), "ti:the AND cat:src1 OR cat:de", n=30)


@query(_page("CAST(created AS TIMESTAMP) BETWEEN TIMESTAMP '2024-02-01 00:00:00' AND TIMESTAMP '2024-03-01 12:00:00' AND list_contains(a, 'de')", "10", "created DESC, paper_id DESC", "LIMIT 50"))
def q4_submitted_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bq.search(papers(spark, sf_dir), "submittedDate:[202402010000 TO 202403011200] AND abs:de", n=50)


@query(_page("paper_id = 17 OR list_contains(categories, 'src3')", "0", "created DESC, paper_id DESC", "LIMIT 15"))
def q8_id_or_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bq.search(papers(spark, sf_dir), "id:17 OR cat:src3", n=15)


@query(_page("list_contains(al, 'r') AND list_contains(al, 'seau')", _relevance("(list_contains({0}, 'r') AND list_contains({0}, 'seau'))"), "created DESC, paper_id DESC", "LIMIT 10"))
def q7_query_splits_at_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bq.search(papers(spark, sf_dir), "réseau", n=10)


@query(_page("contains(' ' || array_to_string(u, ' ') || ' ', ' noel etienne ') AND (list_contains(u, 'src2') OR list_contains(u, 'de'))", "20", "created DESC, paper_id DESC", "LIMIT 40"))
def q5_author_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bq.search(papers(spark, sf_dir), 'author:"noel etienne" AND (au:src2 OR authors:de)', n=40)


@query(_page("list_contains(al, 'src3') OR list_contains(al, 'en')", f"greatest({_relevance("list_contains({}, 'src3')")}, {_relevance("list_contains({}, 'en')")})", "score DESC, created DESC, paper_id DESC", "LIMIT 60", "(SELECT * FROM hits ORDER BY created DESC, paper_id DESC LIMIT 500)"))
def q12_relevance_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bq.search(papers(spark, sf_dir), "src3 OR en", sort="relevance", n=60)


@query(f"""WITH {INDEXED_SQL}, m AS (SELECT *, CAST(created AS TIMESTAMP) AS since, list_contains(al, 'the') AS x, list_contains(al, 'er') AS y FROM idx), c AS (
  SELECT 'base' AS name, count(*) FILTER (x AND y AND since BETWEEN TIMESTAMP '2024-12-01' AND TIMESTAMP '2024-12-31 23:59:00') AS n FROM m
  UNION ALL SELECT 'days_90', count(*) FILTER (x AND y AND since BETWEEN TIMESTAMP '2024-10-02' AND TIMESTAMP '2024-12-31 23:59:00') FROM m
  UNION ALL SELECT 'days_365', count(*) FILTER (x AND y AND since BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-12-31 23:59:00') FROM m
  UNION ALL SELECT 'drop_the', count(*) FILTER (y) FROM m UNION ALL SELECT 'drop_er', count(*) FILTER (x) FROM m UNION ALL SELECT 'any', count(*) FILTER (x OR y) FROM m),
w AS (SELECT * FROM c WHERE name <> 'base' AND n > (SELECT n FROM c WHERE name = 'base'))
SELECT name, n FROM w WHERE name NOT LIKE 'drop%' UNION ALL SELECT * FROM (SELECT name, n FROM w WHERE name LIKE 'drop%' ORDER BY n DESC, name LIMIT 2)""")
def q19_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = bq.widened("all:the AND all:er", 30, "20241231")
    return bq.suggestions(papers(spark, sf_dir), days.pop("days_30"), days | bq.relaxations("all:the AND all:er", ["the", "er"], {}))


@query(f"""WITH {INDEXED_SQL} SELECT * FROM (
  SELECT 'base' AS name, count(*) FILTER (list_contains(al, 'the') AND list_contains(al, 'er')) AS n FROM idx
  UNION ALL SELECT 'expand_er', count(*) FILTER (list_contains(al, 'the') AND contains(joined, ' of the ')) FROM idx
  UNION ALL SELECT 'drop_the', count(*) FILTER (list_contains(al, 'er')) FROM idx
  UNION ALL SELECT 'drop_er', count(*) FILTER (list_contains(al, 'the')) FROM idx
  UNION ALL SELECT 'any', count(*) FILTER (list_contains(al, 'the') OR list_contains(al, 'er')) FROM idx)""")
def q19_relaxation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = bq.relaxations("all:the AND all:er", ["the", "er"], {"er": "of the"})
    return bq.count_many(papers(spark, sf_dir), forms)


@query(f"""WITH {INDEXED_SQL}, lv AS (SELECT paper_id, CASE WHEN contains(joined, ' zz zz ') THEN 0 WHEN contains(joined, ' of the ') AND list_contains(categories, 'en') THEN 1 WHEN list_contains(al, 'the') THEN 2 END AS level FROM idx)
SELECT paper_id, CAST(level AS BIGINT) AS level FROM lv WHERE level = (SELECT min(level) FROM lv)""")
def q20_search_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bq.first_level(papers(spark, sf_dir), ['"zz zz"', '"of the" AND cat:en', "the"])


@query(f"""WITH {INDEXED_SQL} SELECT count(*) AS n FROM idx WHERE (list_contains(t, 'the') OR contains(' ' || array_to_string(a, ' ') || ' ', ' in the ')) AND (list_contains(categories, 'en') OR list_contains(categories, 'fr'))
  AND CAST(created AS TIMESTAMP) BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-06-30 23:59:00'""")
def q17_structured_builder(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = bq.build_query([("", "ti", "the"), ("OR", "abs", "in the")], ["en", "fr"], True, ("20240110", "20240630"))
    return bq.count_many(papers(spark, sf_dir), {"n": text}).select("n")


@query(f"""WITH {PAPERS_SQL} SELECT paper_id, created FROM papers WHERE created >= '2024-05-01' AND (primary_category IN ('src1', 'src2') OR len(list_filter(categories, lambda c: c IN ('de'))) > 0)
ORDER BY created DESC, paper_id DESC LIMIT 40""")
def q16_recent_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mirror.recent_pool(papers(spark, sf_dir), ["src1", "src2"], ["de"], since="2024-05-01", n=40)


@query(f"""WITH {PAPERS_SQL}, q AS (SELECT paper_id, lower(title) AS t FROM papers)
SELECT paper_id, CASE WHEN regexp_matches(t, '(^|[^a-z0-9])the([^a-z0-9]|$)') THEN 'token' WHEN contains(t, 'the') THEN 'substring' ELSE 'none' END AS match FROM q""")
def q13_token_or_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = F.lower("title")
    return papers(spark, sf_dir).select("paper_id", F.when(low.rlike(r"(^|[^a-z0-9])the([^a-z0-9]|$)"), "token").when(low.contains("the"), "substring").otherwise("none").alias("match"))


@query(r"""SELECT conv_id, turn, CAST(nullif(regexp_extract(lower(text), '(\d+) (?:days?|tage)', 1), '') AS BIGINT) AS days_ago, CAST(length(regexp_extract(text, '[A-Z][a-z]+', 0)) AS BIGINT) AS first_name_length FROM conversations""")
def q21_spec_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    days = F.regexp_extract(F.lower("text"), r"(\d+) (?:days?|tage)", 1)
    return c.select("conv_id", "turn", F.when(days != "", days).cast("long").alias("days_ago"), F.length(F.regexp_extract("text", "[A-Z][a-z]+", 0)).cast("long").alias("first_name_length"))


# scans, upserts and side tables


@query("""SELECT doc_id FROM documents WHERE source IN ('src1', 'src4', 'src7') OR lang IN ('es')""")
def s3_allowed_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mirror.allowed(papers(spark, sf_dir), ["src1", "src4", "src7", "es"]).select(F.col("paper_id").alias("doc_id"))


@query("""SELECT CASE WHEN text IS NULL OR text = '' THEN 'no_metadata' WHEN length(text) < 200 THEN 'too_short' WHEN source NOT IN ('src0','src1','src2','src3','src4','src5') THEN 'filtered' ELSE 'written' END AS reason,
  count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY 1""")
def s4_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    rules = {"no_metadata": F.col("text").isNull() | (F.col("text") == ""), "too_short": F.length("text") < 200, "filtered": ~F.col("source").isin([f"src{i}" for i in range(6)])}
    return mirror.accounted(d, rules).groupBy("reason").agg(F.count("*").alias("n"), F.sum(F.length("text")).cast("long").alias("chars"))


@query("""WITH b AS (SELECT doc_id AS id, n_chars, 0 AS seq FROM documents UNION ALL SELECT doc_id, n_chars + 1, 1 FROM documents WHERE lang = 'en' UNION ALL SELECT doc_id, n_chars + 2, 2 FROM documents WHERE source = 'src1')
SELECT id, n_chars FROM b QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1""")
def s5_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    batch = lambda rows, more: rows.select(F.col("doc_id").alias("id"), (F.col("n_chars") + more).alias("n_chars"))
    return mirror.upserted([batch(d, 0), batch(d.filter("lang = 'en'"), 1), batch(d.filter("source = 'src1'"), 2)], "id")


@query(f"""WITH {PAPERS_SQL}, b AS (SELECT paper_id, unnest(categories) AS category, primary_category FROM papers)
SELECT category, count(*) AS n, count(*) FILTER (category = primary_category) AS n_primary FROM b GROUP BY category""")
def s7_category_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mirror.bridge(papers(spark, sf_dir)).groupBy("category").agg(F.count("*").alias("n"), F.sum("is_primary").cast("long").alias("n_primary"))


@query("""SELECT doc_id, concat_ws(' ', nullif(lang, ''), nullif(source, ''), CASE WHEN doc_id % 2 = 0 THEN 'even' END) AS all_text FROM documents""")
def s7_all_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", mirror.all_text("lang", "source", F.when(F.col("doc_id") % 2 == 0, "even")).alias("all_text"))


@query(r"""WITH n AS (SELECT doc_id, list_filter(regexp_split_to_array(source || ', ' || lang || '  ' || source, '[\s,]+'), lambda x: x <> '') AS c, CASE WHEN doc_id % 2 = 0 THEN 'extra' ELSE source END AS p FROM documents)
SELECT doc_id, array_to_string(CASE WHEN list_contains(c, p) THEN c ELSE list_append(c, p) END, ' ') AS categories FROM n""")
def s8_normal_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    raw = F.concat("source", F.lit(", "), "lang", F.lit("  "), "source")
    return d.select("doc_id", F.array_join(mirror.normal_categories(raw, F.when(F.col("doc_id") % 2 == 0, "extra").otherwise(F.col("source"))), " ").alias("categories"))


@query(f"""WITH {PAPERS_SQL} SELECT paper_id, created FROM papers WHERE created >= '2024-03-01' AND (created, paper_id) < ('2024-09-01', 100) ORDER BY created DESC, paper_id DESC LIMIT 100""")
def s10_keyset_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mirror.newest_page(papers(spark, sf_dir), "2024-03-01", ("2024-09-01", 100), 100)


@query("SELECT doc_id, n_chars FROM documents WHERE doc_id > 25 ORDER BY doc_id LIMIT 50")
def s11_keyset_ascending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "n_chars").filter("doc_id > 25").orderBy("doc_id").limit(50)


@query("SELECT doc_id, source, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def s12_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars").join(wanted, "doc_id", "left_semi")


@query("""SELECT doc_id, source FROM documents WHERE '["' || source || '", "' || lang || '"]' LIKE '%src1%'""")
def s13_category_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.filter(F.to_json(F.array("source", "lang")).like("%src1%")).select("doc_id", "source")


@query(f"WITH {PAPERS_SQL} SELECT paper_id, created FROM papers ORDER BY created DESC, paper_id")
def s14_by_published(spark: SparkSession, sf_dir: str) -> DataFrame:
    return papers(spark, sf_dir).select("paper_id", "created").orderBy(F.desc("created"), "paper_id")


@query(r"""SELECT page_id, regexp_extract(url, '^(https?)://', 1) AS scheme, regexp_extract(url, '^https?://([^/]+)', 1) AS host, trim(regexp_replace(regexp_extract(html, '<title[^>]*>([^<]*)</title>', 1), '\s+', ' ', 'g')) AS title FROM pages""")
def s16_feed_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    title = F.regexp_extract("html", "<title[^>]*>([^<]*)</title>", 1)
    return p.select("page_id", F.regexp_extract("url", "^(https?)://", 1).alias("scheme"), F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), F.trim(F.regexp_replace(title, r"\s+", " ")).alias("title"))


@query("""SELECT conv_id, string_agg(trim(text), chr(10) || chr(10) ORDER BY turn) FILTER (trim(text) <> '') AS full_text FROM conversations GROUP BY conv_id""")
def s18_full_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return mirror.full_text(c, "conv_id", "turn", "text")


@query("""SELECT vec_id, label FROM (SELECT vec_id, CAST(label AS BIGINT) AS label FROM embeddings WHERE label <> 3 UNION ALL SELECT vec_id, -1 FROM embeddings WHERE label = 3)""")
def s21_insert_skipping_existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("long").alias("label"))
    store = v.filter("label <> 3")
    first = v.select("vec_id", F.lit(-1).cast("long").alias("label"), F.lit(0).alias("seq"))
    again = v.select("vec_id", F.lit(-2).cast("long").alias("label"), F.lit(1).alias("seq"))
    return mirror.inserted(store, first.unionByName(again), "vec_id", "seq")


@query("SELECT DISTINCT vec_id FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def s22_existing_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "documents").filter("lang = 'en'").select(F.col("doc_id").alias("vec_id"))
    return table(spark, sf_dir, "embeddings").select("vec_id").join(ids, "vec_id", "left_semi").distinct()


@query(f"""WITH {PAPERS_SQL} SELECT paper_id FROM papers WHERE NOT (created <> '' AND created < '2024-04-01' AND paper_id NOT IN (SELECT doc_id FROM labels))""")
def s23_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("paper_id"))
    return mirror.retained(papers(spark, sf_dir).select("paper_id", "created"), keep, "2024-04-01").select("paper_id")


@query("""WITH a AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS s FROM embeddings), b AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) + CASE WHEN label = 2 THEN 0.001 ELSE 0 END AS s FROM embeddings WHERE label <> 6)
SELECT CASE WHEN b.vec_id IS NULL THEN 'missing' WHEN abs(a.s - b.s) > 1e-5 THEN 'changed' ELSE 'same' END AS state, count(*) AS n FROM a FULL JOIN b USING (vec_id) GROUP BY 1""")
def s25_export_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.get("embedding", 0).cast("double").alias("s"), "label")
    a = v.select("vec_id", "s")
    b = v.filter("label <> 6").select("vec_id", (F.col("s") + F.when(F.col("label") == 2, 0.001).otherwise(0)).alias("s"))
    return mirror.compared(a, b, "vec_id", "s", 1e-5).groupBy("state").agg(F.count("*").alias("n"))
