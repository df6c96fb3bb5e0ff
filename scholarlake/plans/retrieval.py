"""Keyword, vector and fused retrieval; chunking and context expansion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholarlake.functions import text as T
from scholarlake.functions.stem import stem_known, stems, vocabulary
from scholarlake.operators import chunks as C
from scholarlake.operators import index_rows as IR
from scholarlake.operators import ranges as G
from scholarlake.operators import retrieval as R
from scholarlake.operators import rules as RL
from scholarlake.operators import sparse_index as SI
from scholarlake.plans.registry import query
from scholarlake.plans.stem_sql import stems_sql
from scholarlake.sources import published as P
from scholarlake.sources.tables import VECTORS_SQL, table, vectors

_RUNS = "|".join(f"{c}{{5}}" for c in "abcdefghijklmnopqrstuvwxyz0123456789_-")
_KEYWORDS = r"list_filter(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9_-]+|[\x{4e00}-\x{9fff}]{2,}'), lambda t: NOT regexp_matches(t, '^[0-9_-]+$') AND NOT regexp_matches(t, '" + _RUNS + "'))"
#: Stated questions as words; the second word of question 4 stands twice in it.
_ASKED = [(1, "the"), (1, "and"), (2, "der"), (2, "und"), (3, "de"), (3, "que"), (3, "er"), (4, "tioned"), (4, "reing"), (4, "tiones"), (5, "inged"), (5, "mente")]
#: Words whose stems count more early in a text.
_EARLY_WORDS = ("der", "que", "tioning")
_POSTS = f"""tok AS (SELECT doc_id, {_KEYWORDS} AS t FROM documents), st AS (SELECT count(*) AS n_docs, avg(len(t)) AS avg_length FROM tok), raw AS (SELECT doc_id, len(t) AS length, unnest(t) AS token FROM tok), asked AS (SELECT CAST(q AS BIGINT) AS query_id, token FROM (VALUES {", ".join(f"({q}, '{t}')" for q, t in _ASKED)}) v(q, token)),
voc AS (SELECT token FROM raw UNION SELECT token FROM asked UNION SELECT unnest({list(_EARLY_WORDS)})), {stems_sql("voc")}, po AS (SELECT stem AS token, doc_id, length, count(*) AS tf FROM raw JOIN sm USING (token) GROUP BY ALL)"""
_BM25 = f"""{_POSTS}, terms AS (SELECT query_id, stem AS token, count(*) AS qtf FROM asked JOIN sm USING (token) GROUP BY 1, 2), dfs AS (SELECT token, count(*) AS df FROM po WHERE token IN (SELECT token FROM terms) GROUP BY token),
bm AS (SELECT query_id, doc_id, sum(qtf * ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / avg_length)) + CASE WHEN token IN (SELECT stem FROM sm WHERE token IN {_EARLY_WORDS}) AND contains(lower(substring(text, 1, 300)), token) THEN 0.2 ELSE 0 END) AS score FROM po JOIN dfs USING (token) JOIN terms USING (token) JOIN documents USING (doc_id), st GROUP BY 1, 2)"""


def _asked(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_ASKED, "query_id long, token string")


def keyword_index(spark: SparkSession, sf_dir: str) -> SI.KeywordIndex:
    """The published index of a table of documents as it is now; built if there is none of just these files."""
    log = P.Log(spark, f"{P.shared_dir(spark)}/published", f"keywords{SI.LAYOUT}-{P.fingerprint(spark, f'{sf_dir}/documents.parquet')}")
    found = SI.opened(spark, log)
    if found is None:
        found = SI.build(table(spark, sf_dir, "documents"), log, boosted=stems(spark, _EARLY_WORDS))
    return found


def _bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyword_index(spark, sf_dir).scores(_asked(spark)).withColumnRenamed("key", "doc_id")


def _best(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    return keyword_index(spark, sf_dir).best(_asked(spark), n).withColumnRenamed("key", "doc_id")


_CJK_LAST = r"list_concat(list_filter(t, lambda x: NOT regexp_matches(x, '^[\x{4e00}-\x{9fff}]')), list_filter(t, lambda x: regexp_matches(x, '^[\x{4e00}-\x{9fff}]')))"


@query(f"""WITH tok AS (SELECT doc_id, {_KEYWORDS} AS t FROM documents), o AS (SELECT doc_id, {_CJK_LAST} AS t FROM tok), raw AS (SELECT doc_id, unnest(t) AS token, unnest(range(len(t))) AS i FROM o), {stems_sql("raw")}
SELECT doc_id, count(stem) AS n, count(DISTINCT stem) AS n_distinct, coalesce(string_agg(stem, ' ' ORDER BY i) FILTER (i < 5), '') AS first_five FROM documents LEFT JOIN (SELECT doc_id, i, stem FROM raw JOIN sm USING (token)) USING (doc_id) GROUP BY doc_id""")
def f1_keyword_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", T.keyword_tokens(F.col("text")).alias("t"), F.col("text").rlike(f"[{T.CJK}]").alias("cjk"))
    # a word of a document once or twice with its number, and its first five words with their places, which no word has before it
    latin = F.filter("t", lambda x: ~x.rlike(f"^[{T.CJK}]"))
    latin_first = F.concat(latin, F.filter("t", lambda x: x.rlike(f"^[{T.CJK}]")))
    first = F.when(F.col("cjk"), F.slice(latin_first, 1, 5)).otherwise(F.slice("t", 1, 5))
    placed = F.transform(first, lambda x, i: F.concat(i.cast("string"), F.lit(" "), x))
    rows = SI.batch_counts(d.select("doc_id", F.explode_outer(F.concat("t", placed)).alias("w")), "doc_id", "w")
    rows = P.saved(rows.select("doc_id", F.substring_index("w", " ", -1).alias("token"), F.when(F.col("w").contains(" "), F.substring_index("w", " ", 1).cast("int")).alias("pos"), "tf"), "words")
    words = P.saved(vocabulary(rows), "vocabulary")
    stemmed = stem_known(rows.filter("pos is null").drop("pos"), words).repartition("doc_id")
    counts = stemmed.groupBy("doc_id", "stem").agg(F.sum(F.when(F.col("stem").isNotNull(), F.col("tf")).otherwise(0)).alias("n")).groupBy("doc_id").agg(F.sum("n").alias("n"), F.count("stem").alias("n_distinct"))
    first = stem_known(rows.filter("pos is not null"), words).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "stem"))), lambda x: x["stem"]), " ").alias("first_five"))
    return counts.join(first, "doc_id", "left").select("doc_id", "n", "n_distinct", F.coalesce("first_five", F.lit("")).alias("first_five"))


_STOP = ", ".join(f"'{w}'" for w in T.QUESTION_WORDS)


@query(f"""WITH tok AS (SELECT conv_id, turn, {_KEYWORDS} AS t FROM conversations), o AS (SELECT conv_id, turn, {_CJK_LAST} AS t FROM tok), raw AS (SELECT conv_id, turn, unnest(t) AS token, unnest(range(len(t))) AS i FROM o),
voc AS (SELECT token FROM raw UNION SELECT unnest([{_STOP}])), {stems_sql("voc")}, w AS (SELECT conv_id, turn, stem, min(i) AS i, stem NOT IN ({_STOP}) AND stem NOT IN (SELECT stem FROM sm WHERE token IN ({_STOP})) AS kept FROM raw JOIN sm USING (token) GROUP BY ALL),
u AS (SELECT * FROM (SELECT *, bool_or(kept) OVER (PARTITION BY conv_id, turn) AS any_kept FROM w) WHERE kept OR NOT any_kept QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) <= 8)
SELECT conv_id, turn, coalesce(string_agg(stem, ' ' ORDER BY i), '') AS keywords FROM conversations LEFT JOIN u USING (conv_id, turn) GROUP BY conv_id, turn""")
def f2_query_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return SI.query_keywords(c, "text", ["conv_id", "turn"]).select("conv_id", "turn", F.array_join("keywords", " ").alias("keywords"))


@query(r"SELECT conv_id, turn, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS normal, CASE WHEN regexp_matches(text, '[\x{4e00}-\x{9fff}]') AND regexp_matches(text, '[A-Za-z]') THEN 'mixed' WHEN regexp_matches(text, '[\x{4e00}-\x{9fff}]') THEN 'zh' WHEN regexp_matches(text, '[A-Za-z]') THEN 'en' ELSE 'unknown' END AS language FROM conversations")
def f3_normal_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.normal(F.col("text")).alias("normal"), T.language(F.col("text")).alias("language"))


#: Chunks with headings: each document below a heading of its number, as sections of a paper have them.
_HEADINGS = ("Abstract", "1 Introduction", "2 Method and model", "3 Experiments", "4 Ablation", "5 Conclusion", "A Appendix", "Prompt", "Figure 3", "Table 2", "References", "Notes")
_INTENTS = ("method_flow", "figure_table", "paper_overview", "contribution", "limitation", "result_analysis", "other")
_PREFERRED = (("method",), ("figure", "table", "experiment"), ("abstract", "conclusion"), (), ("conclusion",))
_sql_list = lambda items: "[" + ", ".join(f"'{x}'" for x in items) + "]"
_TAGGED = f"""hd AS (SELECT doc_id, n_chars, text, ({_sql_list(_HEADINGS)})[CAST(doc_id % {len(_HEADINGS)} AS INT) + 1] || chr(10) || text AS content, ({_sql_list(_INTENTS)})[CAST(doc_id % {len(_INTENTS)} AS INT) + 1] AS intent,
  ([{", ".join(_sql_list(x) if x else "CAST([] AS VARCHAR[])" for x in _PREFERRED)}])[CAST(doc_id % {len(_PREFERRED)} AS INT) + 1] AS preferred, (['text', 'figure', 'table'])[CAST(doc_id % 3 AS INT) + 1] AS chunk_type FROM documents),
h9 AS (SELECT *, lower(regexp_replace(substring(regexp_replace(content, '\\s+', ' ', 'g'), 1, 900), '\\s+', ' ', 'g')) AS h FROM hd),
tg AS (SELECT *, list_filter([{", ".join("CASE WHEN " + " OR ".join(f"contains(h, '{w}')" for w in ws) + f" THEN '{t}' END" for t, ws in RL.SECTION_TAGS.items())}], lambda x: x IS NOT NULL) AS tags FROM h9),
ny AS (SELECT *, list_intersect(tags, {_sql_list(RL.NOISY_TAGS)}) AS noisy0, chunk_type IN ('figure', 'table') AND intent = 'figure_table' AS asset, intent IN {RL.OVERVIEW_INTENTS} AS overview FROM tg),
bo AS (SELECT *, greatest(-0.05, least(0.12, 0.045 * len(list_intersect(tags, preferred)) + CASE WHEN asset THEN 0.05 ELSE 0 END - 0.02 * len(CASE WHEN asset THEN list_filter(noisy0, lambda x: x NOT IN ('figure', 'table')) ELSE noisy0 END)
  + CASE WHEN overview AND list_contains(tags, 'abstract') THEN 0.03 ELSE 0 END + CASE WHEN overview AND list_contains(tags, 'conclusion') THEN 0.02 ELSE 0 END)) AS bonus FROM ny)"""


def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, content, intent, preferred, chunk_type, tags, bonus) of chunks with headings."""
    pick = lambda items: F.get(F.array(*items), (F.col("doc_id") % len(items)).cast("int"))
    words = lambda ws: F.array(*map(F.lit, ws)).cast("array<string>")
    d = table(spark, sf_dir, "documents")
    d = d.select("doc_id", "n_chars", "text", F.concat(pick([F.lit(x) for x in _HEADINGS]), F.lit("\n"), "text").alias("content"), pick([F.lit(x) for x in _INTENTS]).alias("intent"), pick([words(x) for x in _PREFERRED]).alias("preferred"), pick([F.lit(x) for x in ("text", "figure", "table")]).alias("chunk_type"))
    d = d.withColumn("tags", RL.tags_of(F.col("content")))
    return d.withColumn("bonus", RL.structural_bonus(F.col("tags"), F.col("preferred"), F.col("intent"), F.col("chunk_type")))


@query(f"WITH {_TAGGED} SELECT doc_id, array_to_string(tags, ',') AS tags FROM tg")
def f5_section_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tagged(spark, sf_dir).select("doc_id", F.array_join("tags", ",").alias("tags"))


@query(f"WITH {_TAGGED} SELECT doc_id, CAST(round(bonus, 6) AS DOUBLE) AS bonus FROM bo")
def f6_structural_bonus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tagged(spark, sf_dir).select("doc_id", F.round("bonus", 6).alias("bonus"))


@query(f"""WITH {_TAGGED}, m AS (SELECT *, doc_id % 4 = 0 AS recent, (doc_id % 11) / 10.0 AS strength, CASE WHEN doc_id % 5 = 0 THEN 'c' || CAST(doc_id AS VARCHAR) ELSE '' END AS given, list_slice(regexp_extract_all(lower(text), '[a-z]+'), 3, 14) || ['zzz'] AS keywords FROM bo)
SELECT doc_id, CAST(round(least(1.4, 0.25 + CASE WHEN recent THEN 0.28 ELSE 0 END + least(0.24, strength * 0.24) + CASE WHEN given <> '' THEN 0.34 ELSE 0 END
  + least(0.28, len(list_filter(list_slice(keywords, 1, 10), lambda k: contains(lower(content), k))) / len(list_slice(keywords, 1, 10)) * 0.28) + greatest(0, bonus)), 6) AS DOUBLE) AS memory_score FROM m""")
def f27_memory_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    own = F.concat(F.lit("c"), i.cast("string"))
    keywords = F.concat(F.slice(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)), 3, 12), F.array(F.lit("zzz")))
    score = RL.memory_score(i % 4 == 0, (i % 11) / 10.0, F.array(F.when(i % 5 == 0, own).otherwise(""), F.lit("")), F.array(own, F.lit("")), F.col("keywords"), F.col("content"), F.col("bonus"))
    return _tagged(spark, sf_dir).withColumn("keywords", keywords).select("doc_id", F.round(score, 6).alias("memory_score"))


@query(f"WITH {_BM25} SELECT query_id, doc_id, round(score, 6) AS score FROM bm")
def f7_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bm25(spark, sf_dir).withColumn("score", F.round("score", 6))


@query(f"""WITH f AS (SELECT doc_id, split_part(text, chr(10), 1) AS title, text FROM documents), tk AS (SELECT doc_id, {_KEYWORDS.replace('lower(text)', 'lower(title)')} AS a, {_KEYWORDS} AS b FROM f),
p AS (SELECT doc_id, unnest(a) AS token, 2.5 AS w FROM tk UNION ALL SELECT doc_id, unnest(b), 1.0 FROM tk)
SELECT doc_id, token, CAST(sum(w) AS DOUBLE) AS tf, CAST(greatest(round_even(any_value(l), 0), 1) AS BIGINT) AS length FROM p JOIN (SELECT doc_id, len(a) * 2.5 + len(b) AS l FROM tk) USING (doc_id) GROUP BY 1, 2""")
def f8_weighted_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", T.keyword_tokens(F.substring_index("text", "\n", 1)).alias("a"), T.keyword_tokens(F.col("text")).alias("b"))
    return R.weighted_postings(d, "doc_id", {"title": (F.col("a"), 2.5), "body": (F.col("b"), 1.0)}).select("doc_id", "token", "tf", "length")


@query(r"""SELECT doc_id, length(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g')) < 3 OR contains(text, chr(65533)) OR length(regexp_replace(text, '[\p{L}\p{N}\s]', '', 'g')) / greatest(length(regexp_replace(text, '\s', '', 'g')), 1) > 0.28
 OR length(regexp_replace(text, '[^0-9]', '', 'g')) / greatest(length(regexp_replace(text, '\s', '', 'g')), 1) > 0.45 AS noisy FROM documents""")
def f11_noisy_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.noisy(F.col("text")).alias("noisy"))


@query("SELECT doc_id, CAST(ceil(length(text) / 3.0) AS BIGINT) AS tokens FROM documents")
def f34_token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.ceil(F.length("text") / 3.0).cast("long").alias("tokens"))


@query(f"WITH {_POSTS} SELECT token, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM po GROUP BY token")
def a7_document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyword_index(spark, sf_dir).dictionary().groupBy(F.col("stem").alias("token")).agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


@query(f"WITH {_POSTS} SELECT n_docs, round(avg_length, 6) AS avg_length, (SELECT count(*) FROM po) AS postings, (SELECT count(DISTINCT token) FROM po) AS vocabulary FROM st")
def c9_index_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = keyword_index(spark, sf_dir)
    words = index.dictionary().groupBy("stem").agg(F.sum("df").alias("df"))
    return words.agg(F.lit(index.n_docs).cast("long").alias("n_docs"), F.round(F.lit(index.average), 6).alias("avg_length"), F.sum("df").alias("postings"), F.count("*").alias("vocabulary"))


@query(f"WITH {_BM25}, r AS (SELECT query_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM bm) SELECT *, CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0 ELSE round((score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w), 6) END AS normal FROM r WHERE rank <= 10 WINDOW w AS (PARTITION BY query_id)")
def r1_keyword_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.min_max(_best(spark, sf_dir, 10), ["query_id"], "score").withColumn("normal", F.round("normal", 6)).select("query_id", "doc_id", "score", "rank", "normal")


_COS = "greatest(0.0, least(1.0, list_sum(list_transform(list_zip(q.v, x.v), lambda p: p[1] * p[2])) / (q.norm * x.norm)))"
_NEAR = f"{VECTORS_SQL}, nn AS (SELECT q.vec_id AS query_id, x.vec_id, round({_COS}, 6) AS similarity FROM vec q, vec x WHERE q.vec_id % 100 = 0 AND q.vec_id <> x.vec_id), nr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM nn)"


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), F.col("norm").alias("q_norm"))


@query(f"WITH {_NEAR} SELECT query_id, vec_id, similarity, rank FROM nr WHERE rank <= 10")
def w7_exact_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.nearest(_queries(spark, sf_dir), vectors(spark, sf_dir), 10)


@query(f"""WITH {_NEAR}, h AS (SELECT nr.query_id, label AS chunk, 'k' || CAST(vec_id % 4 AS VARCHAR) AS kind, similarity FROM nr JOIN vec USING (vec_id) WHERE rank <= 30)
SELECT query_id, chunk, round(max(similarity) + least(0.01, 0.005 * (count(DISTINCT kind) - 1)), 6) AS score, CAST(count(*) AS BIGINT) AS n_hits FROM h GROUP BY 1, 2""")
def w8_hits_to_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    near = R.nearest(_queries(spark, sf_dir), v.drop("label"), 30).join(v.select("vec_id", F.col("label").alias("chunk")), "vec_id").withColumn("kind", F.concat(F.lit("k"), (F.col("vec_id") % 4).cast("string")))
    bonus = F.least(F.lit(0.01), 0.005 * (F.count_distinct("kind") - 1))
    return near.groupBy("query_id", "chunk").agg(F.round(F.max("similarity") + bonus, 6).alias("score"), F.count("*").alias("n_hits"))


#: What a question is searched by: as it stands, rewritten, and by an answer imagined for it; here their vectors are made from that of the question.
_ROUTES = ("vector_original", "vector_rewrite", "vector_hyde")
_VOTES = {"vector_original": 1.0, "vector_rewrite": 0.9, "vector_hyde": 0.75, "keyword": 0.8}
_VIEWS = f"""{VECTORS_SQL}, vw AS (SELECT q.vec_id // 100 AS query_id, r.i, CASE r.i WHEN 0 THEN q.v WHEN 1 THEN list_transform(list_zip(q.v, list_reverse(q.v)), lambda p: p[1] * 0.9 + p[2] * 0.1) ELSE list_transform(list_zip(q.v, n.v), lambda p: (p[1] + p[2]) * 0.5) END AS v
  FROM vec q JOIN vec n ON n.vec_id = q.vec_id + 1, (VALUES (0), (1), (2)) r(i) WHERE q.vec_id % 100 = 0 AND q.vec_id > 0),
vq AS (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM vw), vs AS (SELECT q.query_id, q.i, x.vec_id, round({_COS}, 6) AS similarity FROM vq q, vec x),
vr AS (SELECT query_id, ({list(_ROUTES)})[i + 1] AS route, vec_id, similarity, row_number() OVER (PARTITION BY query_id, i ORDER BY similarity DESC, vec_id) AS rank FROM vs QUALIFY rank <= 30)"""


def _vector_routes(spark: SparkSession, sf_dir: str, last: int | None = None) -> DataFrame:
    """(query_id, route, vec_id, similarity, rank): the 30 nearest vectors of the three views of each question, in one scan; with `last` of the questions up to that number."""
    v = vectors(spark, sf_dir)
    asked = v.filter("vec_id % 100 = 0 and vec_id > 0")
    q = (asked if last is None else asked.filter(F.col("vec_id") <= last * 100)).select((F.col("vec_id") / 100).cast("long").alias("question"), "vec_id", "v")
    q = q.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("n")), "vec_id")
    views = [F.col("v"), F.zip_with("v", F.reverse("v"), lambda a, b: a * 0.9 + b * 0.1), F.zip_with("v", "n", lambda a, b: (a + b) * 0.5)]
    q = q.select("question", F.posexplode(F.array(*views)).alias("i", "q"))
    q = q.select((F.col("question") * len(_ROUTES) + F.col("i")).alias("query_id"), "q", F.sqrt(F.aggregate("q", F.lit(0.0), lambda a, x: a + x * x)).alias("q_norm"))
    near = R.nearest(q, v, 30, but_self=False)
    route = F.get(F.array(*map(F.lit, _ROUTES)), (F.col("query_id") % len(_ROUTES)).cast("int"))
    return near.select(F.floor(F.col("query_id") / len(_ROUTES)).cast("long").alias("query_id"), route.alias("route"), "vec_id", "similarity", "rank")


@query(f"WITH {_VIEWS} SELECT query_id, route, vec_id, similarity, rank FROM vr")
def r2_vector_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vector_routes(spark, sf_dir)


@query(f"""WITH {_VIEWS}, {_BM25}, kr AS (SELECT query_id, 'keyword' AS route, doc_id AS chunk, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM bm QUALIFY rank <= 30),
al AS (SELECT query_id, route, vec_id AS chunk, rank FROM vr WHERE query_id <= 3 UNION ALL SELECT * FROM kr), fu AS (SELECT query_id, chunk, round(sum(CASE route {" ".join(f"WHEN '{r}' THEN {w}" for r, w in _VOTES.items())} END / (60 + rank)), 9) AS score, count(DISTINCT route) AS n_routes FROM al GROUP BY 1, 2)
SELECT query_id, chunk, CAST(score AS DOUBLE) AS score, n_routes, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk) AS rank FROM fu QUALIFY rank <= 15""")
def r2_fused_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _best(spark, sf_dir, 30)
    routes = _vector_routes(spark, sf_dir, 3).select("query_id", "route", F.col("vec_id").alias("chunk"), "rank")
    routes = routes.unionByName(words.select("query_id", F.lit("keyword").alias("route"), F.col("doc_id").alias("chunk"), "rank"))
    fused = R.fuse(routes, _VOTES, "chunk").withColumn("score", F.round("score", 9))
    return R.ranked(fused, ["query_id"], F.desc("score"), F.asc("chunk"), n=15).select("query_id", "chunk", "score", "n_routes", "rank")


@query("""WITH h AS (SELECT l_suppkey AS chunk, 'm' || CAST(l_partkey % 7 AS VARCHAR) AS kind, round(l_discount + l_tax, 6) AS s FROM lineitem), b AS (SELECT chunk, kind, s, row_number() OVER (PARTITION BY chunk ORDER BY s DESC, kind DESC) AS r FROM (SELECT DISTINCT * FROM h))
SELECT chunk, round(any_value(t.best) + least(0.01, 0.005 * (any_value(t.kinds) - 1)), 6) AS score, max(kind) FILTER (r = 1) AS best_kind, string_agg(kind, ',' ORDER BY r) FILTER (r <= 3) AS matched FROM b JOIN (SELECT chunk, max(s) AS best, count(DISTINCT kind) AS kinds FROM h GROUP BY chunk) t USING (chunk) GROUP BY chunk""")
def a8_hit_aggregation(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("chunk"), F.concat(F.lit("m"), (F.col("l_partkey") % 7).cast("string")).alias("kind"), F.round(F.col("l_discount") + F.col("l_tax"), 6).alias("s"))
    return R.hits_to_chunks(h, "chunk", "kind", "s").withColumn("score", F.round("score", 6))


@query("SELECT l_suppkey AS chunk, round(sum(l_discount), 6) AS votes, round(max(l_tax), 6) AS best, count(*) AS n FROM lineitem GROUP BY 1")
def a9_vote_aggregation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("chunk")).agg(F.round(F.sum("l_discount"), 6).alias("votes"), F.round(F.max("l_tax"), 6).alias("best"), F.count("*").alias("n"))


@query("SELECT coalesce(nullif(source, ''), 'unknown') AS section, coalesce(lang, 'body') AS chunk_type, count(*) AS n FROM documents GROUP BY 1, 2")
def a10_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.groupBy(F.coalesce(F.nullif(F.col("source"), F.lit("")), F.lit("unknown")).alias("section"), F.coalesce("lang", F.lit("body")).alias("chunk_type")).agg(F.count("*").alias("n"))


@query(f"""WITH tok AS (SELECT conv_id, turn, {_KEYWORDS} AS t FROM conversations WHERE role = 'user'), o AS (SELECT conv_id, turn, {_CJK_LAST} AS t FROM tok), raw AS (SELECT conv_id, turn, unnest(t) AS token, unnest(range(len(t))) AS i FROM o), {stems_sql("raw")},
k AS (SELECT conv_id, stem AS token, count(*) AS n, min({{'turn': turn, 'i': i}}) AS first FROM raw JOIN sm USING (token) GROUP BY 1, 2) SELECT conv_id, token, n, row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, first) AS place FROM k QUALIFY place <= 12""")
def a22_query_keyword_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", "turn", "text")
    return SI.keyword_counts(asked, "text", "conv_id", ["turn"])


_FUSED = f"""{_BM25}, kr AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank, 'keyword' AS route FROM bm),
rr AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY n_chars DESC, doc_id) AS rank, 'table' AS route FROM (SELECT DISTINCT query_id, doc_id FROM bm) JOIN documents USING (doc_id)),
al AS (SELECT * FROM kr WHERE rank <= 30 UNION ALL SELECT * FROM rr WHERE rank <= 30)"""


def _routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    bm = _bm25(spark, sf_dir)
    chars = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    a = _best(spark, sf_dir, 30).select("query_id", "doc_id", "rank", F.lit("keyword").alias("route"))
    b = R.ranked(bm.join(chars, "doc_id"), ["query_id"], F.desc("n_chars"), F.asc("doc_id"), n=30).select("query_id", "doc_id", "rank", F.lit("table").alias("route"))
    return a.unionByName(b)


@query(f"WITH {_FUSED} SELECT query_id, doc_id, round(sum(CASE route WHEN 'keyword' THEN 0.8 ELSE 1.0 END / (60 + rank)), 9) AS score, count(DISTINCT route) AS n_routes FROM al GROUP BY 1, 2")
def w1_weighted_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.fuse(_routes(spark, sf_dir), {"keyword": 0.8, "table": 1.0}, "doc_id").withColumn("score", F.round("score", 9))


@query(f"WITH {_FUSED} SELECT query_id, doc_id, round(sum(CASE route WHEN 'keyword' THEN 1.22 ELSE least(0.3, 0.65 / 2) END / (12 + rank)), 9) AS score FROM al GROUP BY 1, 2")
def w2_view_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.fuse(_routes(spark, sf_dir), {"keyword": 1.22, "table": min(0.3, 0.65 / 2)}, "doc_id", k=12).select("query_id", "doc_id", F.round("score", 9).alias("score"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN max(l_quantity) OVER w = min(l_quantity) OVER w THEN 1.0 ELSE round((l_quantity - min(l_quantity) OVER w) / (max(l_quantity) OVER w - min(l_quantity) OVER w), 6) END AS normal FROM lineitem WINDOW w AS (PARTITION BY l_orderkey)")
def w3_min_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("q"))
    return R.min_max(li, ["l_orderkey"], "q").select("l_orderkey", "l_linenumber", F.round("normal", 6).alias("normal"))


@query(f"WITH {_FUSED} SELECT query_id, doc_id, CAST(min(rank) AS BIGINT) AS rank, arg_min(route, rank * 2 + CASE route WHEN 'keyword' THEN 0 ELSE 1 END) AS route, string_agg(DISTINCT route, ',' ORDER BY route) AS matched FROM al GROUP BY 1, 2")
def w4_route_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _routes(spark, sf_dir).groupBy("query_id", "doc_id").agg(F.min("rank").alias("rank"), F.min_by("route", F.struct("rank", "route")).alias("route"), F.array_join(F.array_sort(F.collect_set("route")), ",").alias("matched"))


@query(f"WITH {_FUSED}, b AS (SELECT query_id, doc_id, max(1.0 / rank) AS best FROM al GROUP BY 1, 2) SELECT query_id, doc_id, round(best, 6) AS best, row_number() OVER (PARTITION BY query_id ORDER BY best DESC, doc_id) AS rank FROM b")
def w5_rewrite_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = _routes(spark, sf_dir).groupBy("query_id", "doc_id").agg(F.max(1.0 / F.col("rank")).alias("best"))
    return R.ranked(best, ["query_id"], F.desc("best"), F.asc("doc_id")).withColumn("best", F.round("best", 6))


@query(f"WITH {_FUSED} SELECT query_id, doc_id, route, rank FROM al QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY CASE route WHEN 'keyword' THEN 0 ELSE 1 END, rank) <= 40")
def w14_raw_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.ranked(_routes(spark, sf_dir), ["query_id"], F.when(F.col("route") == "keyword", 0).otherwise(1).asc(), F.asc("rank"), n=40, name="_k").drop("_k")


@query("""WITH s AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS fused FROM documents), r AS (SELECT s.*, CASE WHEN doc_id % 3 <> 0 THEN (doc_id * 7 % 100) / 100.0 END AS given FROM s)
SELECT source, doc_id, CASE WHEN fused <= 5 THEN CAST(coalesce(given, 0) AS DOUBLE) END AS score, row_number() OVER (PARTITION BY source ORDER BY (fused <= 5) DESC, CASE WHEN fused <= 5 THEN coalesce(given, 0) END DESC NULLS LAST, fused) AS rank FROM r""")
def r8_rerank_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = G.ranked_whole(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), ["source"], [F.desc("n_chars"), F.asc("doc_id")], "fused")
    given = F.when(F.col("doc_id") % 3 != 0, (F.col("doc_id") * 7 % 100) / 100.0)
    score = F.when(F.col("fused") <= 5, F.coalesce(given, F.lit(0.0)))
    # only the scored window changes its order: what comes after keeps its place
    top = R.ranked(s.filter("fused <= 5").withColumn("score", score), ["source"], F.desc("score"), F.asc("fused")).select("source", "doc_id", "score", "rank")
    return top.unionByName(s.filter("fused > 5").select("source", "doc_id", F.lit(None).cast("double").alias("score"), F.col("fused").alias("rank")))


# chunks


@query(r"""WITH w AS (SELECT doc_id, regexp_split_to_array(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ') AS ws FROM documents), p AS (SELECT doc_id, ws, unnest(range(0, len(ws), 120)) AS off FROM w)
SELECT doc_id, CAST(off // 120 AS BIGINT) AS part, array_to_string(list_slice(ws, off + 1, off + 120), ' ') AS chunk FROM p""")
def c1_word_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.word_chunks(table(spark, sf_dir, "documents"), "doc_id", "text", 120)


@query("""WITH p AS (SELECT doc_id, n_chars, unnest(range(0, greatest(CAST(ceil(n_chars / 8000.0) AS BIGINT), 1))) AS i FROM documents) SELECT doc_id, i + 1 AS part, count(*) OVER (PARTITION BY doc_id) AS parts, CASE WHEN count(*) OVER (PARTITION BY doc_id) > 1 THEN 'part ' || CAST(i + 1 AS VARCHAR) || '/' || CAST(count(*) OVER (PARTITION BY doc_id) AS VARCHAR) ELSE '' END AS label FROM p""")
def c3_part_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.greatest(F.ceil(F.col("n_chars") / 8000.0).cast("long"), F.lit(1).cast("long"))
    rows = table(spark, sf_dir, "documents").select("doc_id", n.alias("parts")).select("doc_id", F.explode(F.sequence(F.lit(1).cast("long"), "parts")).alias("part"), "parts")
    return rows.withColumn("label", F.when(F.col("parts") > 1, F.concat(F.lit("part "), F.col("part").cast("string"), F.lit("/"), F.col("parts").cast("string"))).otherwise(""))


@query(r"""WITH u AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents), n AS (SELECT *, trim(regexp_replace(lower(line), '\s+', ' ', 'g')) AS norm FROM u)
SELECT doc_id, pos - 1 AS pos, line FROM n QUALIFY row_number() OVER (PARTITION BY doc_id, norm ORDER BY pos) = 1""")
def c6_unit_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.deduped_units(table(spark, sf_dir, "documents"), "doc_id", F.split("text", "\n"))


_ENTRIES = r"""ch AS (SELECT 'c' || doc_id AS chunk_id, coalesce(text, '') AS content, doc_id % 3 = 0 AS asset, CASE WHEN doc_id % 3 = 0 THEN 'Table ' || doc_id % 9 ELSE '' END AS caption, CASE WHEN doc_id % 6 = 0 THEN ' TABLE  ' || doc_id % 9 ELSE '' END AS summary0, CASE WHEN doc_id % 4 > 0 THEN lang || ' > ' || source ELSE '' END AS path,
  CASE WHEN doc_id % 5 > 0 THEN CAST(doc_id % 50 AS VARCHAR) ELSE '' END AS page, CASE WHEN doc_id % 7 = 0 THEN 'About ' || source WHEN doc_id % 7 = 1 THEN coalesce(text, '') ELSE '' END AS summary, CASE WHEN doc_id % 2 = 0 THEN ['Why ' || source || '?', ' why  ' || source || '? ', '', 'How?', 'When?', 'Who?'] ELSE [] END AS questions FROM documents),
fo AS (SELECT *, trim(content, ' ') AS body0, trim(CASE WHEN asset THEN CASE WHEN summary0 <> '' OR caption <> '' THEN caption || CASE WHEN trim(content, ' ') <> '' AND lower(trim(regexp_replace(content, '\s+', ' ', 'g'))) <> lower(caption) THEN chr(10) || trim(content, ' ') ELSE '' END ELSE trim(content, ' ') END ELSE trim(content, ' ') END, '') AS body FROM ch),
ln AS (SELECT *, trim(regexp_replace(body, '\s+', ' ', 'g')) AS flat FROM fo),
sh AS (SELECT *, CASE WHEN trim(summary0) <> '' THEN trim(summary0) WHEN length(flat) <= 180 THEN flat WHEN trim(regexp_replace(left(flat, 180), ' [^ ]*$', '')) <> '' THEN trim(regexp_replace(left(flat, 180), ' [^ ]*$', '')) ELSE trim(left(flat, 180)) END AS line FROM ln),
an AS (SELECT *, concat_ws(chr(10), CASE WHEN path <> '' THEN 'Section: ' || path END, CASE WHEN page <> '' THEN 'Page: ' || page END, CASE WHEN line <> '' THEN 'Summary: ' || line END, CASE WHEN line = '' AND path = '' THEN 'Chunk: ' || chunk_id END) AS anchor, list_distinct(list_filter(list_transform(questions, lambda q: trim(regexp_replace(q, '\s+', ' ', 'g'))), lambda q: q <> '')) AS qs FROM sh),
qn AS (SELECT chunk_id, q, row_number() OVER (PARTITION BY chunk_id ORDER BY i) AS n FROM (SELECT chunk_id, trim(q) AS q, i FROM (SELECT chunk_id, unnest(questions) AS q, generate_subscripts(questions, 1) AS i FROM an) WHERE trim(q) <> '' QUALIFY row_number() OVER (PARTITION BY chunk_id, lower(trim(regexp_replace(q, '\s+', ' ', 'g'))) ORDER BY i) = 1)),
al AS (SELECT chunk_id, 0 AS o, 'body' AS kind, 1 AS ordinal, body AS text FROM an UNION ALL SELECT chunk_id, 1, 'section_anchor', 1, anchor FROM an UNION ALL SELECT chunk_id, 2, 'table_or_figure', 1, body FROM an WHERE asset AND body <> ''
  UNION ALL SELECT chunk_id, 3, 'summary', 1, trim(summary) FROM an WHERE trim(summary) <> '' AND lower(trim(regexp_replace(summary, '\s+', ' ', 'g'))) <> lower(flat) UNION ALL SELECT chunk_id, 3 + n, 'question', n, q FROM qn WHERE n <= 3)"""


@query(f"""WITH {_ENTRIES} SELECT chunk_id || ':' || kind || ':' || ordinal AS index_id, chunk_id, kind, CAST(ordinal AS INTEGER) AS ordinal, md5(text) AS text_md5, CAST(CASE kind {" ".join(f"WHEN '{k}' THEN {v}" for k, v in IR.WEIGHTS.items())} END AS DOUBLE) AS weight,
CASE kind {" ".join(f"WHEN '{k}' THEN '{','.join(r)}'" for k, r in IR.ROUTES.items())} END AS routes FROM al QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY o) <= 6""")
def c7_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, text, none = F.col("doc_id"), lambda c: c.cast("string"), F.lit("")
    questions = F.array(F.concat(F.lit("Why "), "source", F.lit("?")), F.concat(F.lit(" why  "), "source", F.lit("? ")), none, F.lit("How?"), F.lit("When?"), F.lit("Who?"))
    chunks = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("c"), text(i)).alias("chunk_id"),
        F.col("text").alias("content"),
        F.when(i % 3 == 0, "Table").alias("chunk_type"),
        F.when(i % 4 > 0, F.concat("lang", F.lit(" > "), "source")).alias("section_path"),
        none.alias("section_title"),
        F.when(i % 5 > 0, text(i % 50)).alias("page_number"),
        F.when(i % 3 == 0, F.concat(F.lit("Table "), text(i % 9))).alias("asset_caption"),
        F.when(i % 6 == 0, F.concat(F.lit(" TABLE  "), text(i % 9))).alias("asset_summary"),
        none.alias("preview"),
        none.alias("table_text"),
        none.alias("card"),
        F.when(i % 7 == 0, F.concat(F.lit("About "), "source")).when(i % 7 == 1, F.col("text")).alias("summary"),
        F.when(i % 2 == 0, questions).alias("questions"),
    )
    rows = IR.index_rows(chunks)
    return rows.select("index_id", "chunk_id", "kind", "ordinal", F.md5("text").alias("text_md5"), "weight", F.array_join("routes", ",").alias("routes"))


@query("""WITH r AS (SELECT doc_id, CASE WHEN n_chars > 900 THEN ['keyword', 'vector', 'table'] WHEN n_chars > 300 THEN ['keyword', 'vector'] ELSE ['vector'] END AS routes FROM documents) SELECT doc_id FROM r WHERE list_has_any(routes, ['keyword', 'table'])""")
def c8_enabled_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    routes = F.when(F.col("n_chars") > 900, F.array(*map(F.lit, ("keyword", "vector", "table")))).when(F.col("n_chars") > 300, F.array(F.lit("keyword"), F.lit("vector"))).otherwise(F.array(F.lit("vector")))
    return table(spark, sf_dir, "documents").filter(F.arrays_overlap(routes, F.array(F.lit("keyword"), F.lit("table")))).select("doc_id")


@query("SELECT l_orderkey AS chunk, min(l_linenumber) AS entry, count(*) AS n_entries FROM lineitem GROUP BY 1")
def c11_one_row_per_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("chunk")).agg(F.min("l_linenumber").alias("entry"), F.count("*").alias("n_entries"))


# context expansion: lines of an order are chunks of a paper, shipmodes its sections, part keys its pages

_AROUND = {"sibling_window": 1, "section_window": 2, "section_limit": 3, "page_window": 1, "page_limit": 4, "asset_limit": 2}
_PATHS = """pc AS (SELECT l_orderkey AS paper, l_linenumber AS ord, 'S' || CAST(l_partkey % 3 AS VARCHAR) || CASE WHEN l_suppkey % 2 = 0 THEN ' > T' || CAST(l_partkey % 2 AS VARCHAR) ELSE '' END AS section, CAST(l_partkey % 6 AS BIGINT) AS page, CAST(l_suppkey % 3 AS BIGINT) AS parent,
  CASE WHEN l_returnflag = 'R' THEN 'table' ELSE 'body' END AS kind, 'table ' || CAST(l_partkey % 4 AS VARCHAR) AS label, l_partkey % 3 = 0 AS is_anchor, CASE WHEN l_linenumber % 2 = 1 THEN 'table ' || CAST(l_suppkey % 4 AS VARCHAR) END AS cites FROM (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_returnflag) = 1)),
pn AS (SELECT *, row_number() OVER (PARTITION BY paper, section ORDER BY ord) AS place, trim(regexp_extract(section, '^(.*)>[^>]*$', 1)) AS up FROM pc), pp AS (SELECT a.paper, a.ord AS anchor, c.ord, a.section AS a_section, a.up, c.section, c.place, c.kind, c.label, a.cites, a.parent = c.parent AS same_parent, a.page AS a_page, c.page, abs(a.ord - c.ord) AS step, abs(a.page - c.page) AS far FROM pn a JOIN pn c USING (paper) WHERE a.is_anchor),
pr AS (SELECT paper, anchor, ord, 'self' AS relation, 0 AS distance, 1 AS n FROM pp WHERE ord = anchor
  UNION ALL SELECT paper, anchor, ord, 'sibling', step, 1 FROM pp WHERE same_parent AND ord <> anchor AND step <= 1
  UNION ALL SELECT paper, anchor, ord, 'section_neighbors', step, row_number() OVER (PARTITION BY paper, anchor ORDER BY step, ord) - 0 FROM pp WHERE section = a_section AND ord <> anchor AND step <= 2
  UNION ALL SELECT paper, anchor, ord, 'section_header', step, 1 FROM pp WHERE section = a_section AND place <= 2
  UNION ALL SELECT paper, anchor, ord, 'parent_section', step, 1 FROM pp WHERE section = up AND place <= 3
  UNION ALL SELECT paper, anchor, ord, 'page_neighbors', far, row_number() OVER (PARTITION BY paper, anchor ORDER BY page, ord) - 1 FROM pp WHERE far <= 1 AND ord <> anchor
  UNION ALL SELECT paper, anchor, ord, 'asset_related', step, row_number() OVER (PARTITION BY paper, anchor ORDER BY ord) + 1 FROM pp WHERE kind = 'table' AND ord <> anchor AND (section = a_section OR far <= 1)
  UNION ALL SELECT paper, anchor, ord, 'cited_asset_context', far, row_number() OVER (PARTITION BY paper, anchor ORDER BY ord) + 1 FROM pp WHERE kind = 'table' AND label = cites)"""


def _around(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the policy adds to each anchor."""
    # papers are dealt before their repeated lines are put together, so they are shuffled once
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag").repartition("l_orderkey")
    li = li.groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct("l_partkey", "l_suppkey", "l_returnflag")).alias("r"))
    part, supp = F.col("r.l_partkey"), F.col("r.l_suppkey")
    section = F.concat(F.lit("S"), (part % 3).cast("string"), F.when(supp % 2 == 0, F.concat(F.lit(" > T"), (part % 2).cast("string"))).otherwise(""))
    table_of = lambda n: F.concat(F.lit("table "), (n % 4).cast("string"))
    cites = F.when(part % 3 == 0, F.array_compact(F.array(F.when(F.col("l_linenumber") % 2 == 1, table_of(supp)))))
    chunks = li.select(F.col("l_orderkey").alias("paper"), F.col("l_linenumber").alias("ord"), section.alias("section"), (part % 6).alias("page"), (supp % 3).alias("parent"), F.when(F.col("r.l_returnflag") == "R", "table").otherwise("body").alias("kind"), table_of(part).alias("label"), cites.alias("cites"))
    return C.around(chunks, _AROUND, dealt=True)


@query(f"WITH {_PATHS} SELECT paper, anchor, ord, relation, CAST(distance AS BIGINT) AS distance FROM pr WHERE n <= 3")
def x2_x8_policy_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _around(spark, sf_dir).drop("kind")


_CANDS = f"""{_PATHS}, sc AS (SELECT paper, anchor, ord, kind, relation, distance, round(greatest(0, least(1, 0.3 + 0.1 * anchor) * 0.55 + CASE relation {" ".join(f"WHEN '{k}' THEN {v}" for k, v in R.RELATION.items())} ELSE 0.10 END
  - least(distance * 0.05, 0.25) + CASE kind WHEN 'table' THEN 0.12 ELSE 0 END + CASE WHEN ord % 2 = 0 THEN 0.10 ELSE 0 END + CASE relation WHEN 'self' THEN 0.12 ELSE 0 END), 6) AS score FROM pr JOIN (SELECT paper, ord, kind FROM pc) USING (paper, ord) WHERE n <= 3)"""


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    bonus = F.when(F.col("kind") == "table", 0.12).otherwise(0.0)
    return _around(spark, sf_dir).withColumn("score", R.expansion_score(0.3 + 0.1 * F.col("anchor"), F.col("relation"), F.col("distance"), bonus, F.col("ord") % 2 == 0))


@query(f"WITH {_CANDS} SELECT paper, anchor, ord, relation, CAST(distance AS BIGINT) AS distance, CAST(score AS DOUBLE) AS score FROM sc")
def x1_x9_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates(spark, sf_dir).select("paper", "anchor", "ord", "relation", F.col("distance").cast("long").alias("distance"), "score")


@query(f"WITH {_CANDS} SELECT paper, ord, CAST(round(max(score) + least(0.24, 0.08 * (count(DISTINCT anchor) - 1)), 6) AS DOUBLE) AS score, count(DISTINCT anchor) AS n_anchors, string_agg(DISTINCT relation, ',' ORDER BY relation) AS relations FROM sc GROUP BY 1, 2")
def x10_candidate_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _candidates(spark, sf_dir).withColumn("chunk", F.struct("paper", "ord"))
    return R.pool(rows).select("chunk.paper", "chunk.ord", "score", "n_anchors", "relations")


@query(f"""WITH {_CANDS}, pl AS (SELECT paper, ord, max(kind) AS kind, max(score) + least(0.24, 0.08 * (count(DISTINCT anchor) - 1)) AS s, count(DISTINCT anchor) AS na, bool_or(relation = 'self') AS own FROM sc GROUP BY 1, 2),
b AS (SELECT paper, ord, CAST(round(s + CASE WHEN own THEN 0.42 WHEN kind = 'table' THEN 0.3 ELSE 0.1 END + least((na - 1) * 0.08, 0.24) + CASE WHEN ord % 2 = 0 THEN 0.08 ELSE 0 END, 6) AS DOUBLE) AS budget_score, CASE WHEN own THEN 5 ELSE 0 END + CASE WHEN na > 1 THEN 2 ELSE 0 END + CASE WHEN ord % 2 = 0 THEN 1 ELSE 0 END AS priority FROM pl)
SELECT paper, ord, budget_score, CAST(priority AS DOUBLE) AS priority, row_number() OVER (PARTITION BY paper ORDER BY priority DESC, budget_score DESC, ord) AS place FROM b""")
def x11_budget_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _candidates(spark, sf_dir).groupBy("paper", "ord").agg(F.max("kind").alias("kind"), F.max("score").alias("m"), F.count_distinct("anchor").alias("na"), F.max(F.col("relation") == "self").alias("own"))
    role = F.when(F.col("own"), 0.42).when(F.col("kind") == "table", 0.3).otherwise(0.1)
    more = F.least((F.col("na") - 1) * 0.08, F.lit(0.24))
    hit = F.col("ord") % 2 == 0
    g = g.withColumn("budget_score", F.round(F.col("m") + more + role + more + F.when(hit, 0.08).otherwise(0.0), 6))
    g = g.withColumn("priority", F.when(F.col("own"), 5.0).otherwise(0.0) + F.when(F.col("na") > 1, 2.0).otherwise(0.0) + F.when(hit, 1.0).otherwise(0.0))
    return R.ranked(g, ["paper"], F.desc("priority"), F.desc("budget_score"), F.asc("ord"), name="place").select("paper", "ord", "budget_score", "priority", "place")


@query("""WITH n AS (SELECT source, count(*) AS chunks FROM documents GROUP BY source), p AS (SELECT source, chunks, CASE WHEN chunks % 2 = 0 THEN 0.25 ELSE 0.18 END AS ratio FROM n), l AS (SELECT *, least(30, greatest(4, CAST(round_even(chunks * ratio * 0.5, 0) AS BIGINT))) AS anchor_limit FROM p)
SELECT source, chunks, CAST(anchor_limit AS BIGINT) AS anchor_limit, CAST(greatest(CAST(floor(chunks * (1.0 - 0.3)) AS BIGINT), anchor_limit) AS BIGINT) AS reject_after FROM l""")
def x18_anchor_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("chunks"))
    ratio = F.when(F.col("chunks") % 2 == 0, 0.25).otherwise(0.18)
    limit = F.least(F.lit(30), F.greatest(F.lit(4), F.bround(F.col("chunks") * ratio * 0.5).cast("long"))).cast("long")
    n = n.withColumn("anchor_limit", limit)
    return n.withColumn("reject_after", F.greatest(F.floor(F.col("chunks") * (1.0 - 0.3)).cast("long"), F.col("anchor_limit")))
