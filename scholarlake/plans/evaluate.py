"""Evaluation, table evidence, and text functions of answers and records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholarlake.functions import text as T
from scholarlake.operators import evaluate as E
from scholarlake.operators import stores as S
from scholarlake.operators import rules as RL
from scholarlake.operators import tables as TB
from scholarlake.plans.registry import query
from scholarlake.sources.tables import EVENTS_SQL, events, table

# retrieval metrics: of the documents of a source, the good ones are relevant and the longest are retrieved

_CASES = """rel AS (SELECT source AS case_id, doc_id AS id FROM documents JOIN labels USING (doc_id) WHERE quality = 1), cand AS (SELECT source AS case_id, doc_id AS id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents),
ev0 AS (SELECT rel.case_id, count(*) AS n, count(*) FILTER (rank <= 10) AS found, min(rank) AS first FROM rel LEFT JOIN cand USING (case_id, id) GROUP BY 1), ms AS (SELECT case_id, found / n AS recall, CAST(found > 0 AS DOUBLE) AS hit, coalesce(1.0 / first, 0.0) AS mrr FROM ev0)"""


def _metrics(spark: SparkSession, sf_dir: str, order: str = "desc") -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("case_id"), F.col("doc_id").alias("id"), "n_chars")
    good = table(spark, sf_dir, "labels").filter("quality = 1").select(F.col("doc_id").alias("id"))
    score = F.col("n_chars") if order == "desc" else -F.col("n_chars")
    return E.scored_metrics(d.join(good, "id").select("case_id", "id"), d.select("case_id", "id", score.alias("score")), 10)


@query(f"WITH {_CASES} SELECT case_id, round(recall, 6) AS recall, hit, CAST(round(mrr, 6) AS DOUBLE) AS mrr FROM ms")
def e1_e2_retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _metrics(spark, sf_dir)
    return m.select("case_id", F.round("recall", 6).alias("recall"), "hit", F.round("mrr", 6).alias("mrr"))


@query(f"WITH {_CASES} SELECT right(case_id, 1) AS bucket, round(avg(CASE WHEN case_id = 'src3' THEN 0.0 ELSE recall END), 6) AS recall, CAST(round(avg(mrr), 6) AS DOUBLE) AS mrr, count(*) AS n FROM ms GROUP BY 1")
def a17_a18_bucketed_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = F.col("case_id") == "src3"
    m = _metrics(spark, sf_dir).withColumn("recall", F.when(~failed, F.col("recall")))
    return m.groupBy(F.substring("case_id", -1, 1).alias("bucket")).agg(F.round(E.metric_mean(F.col("recall"), failed), 6).alias("recall"), F.round(F.avg("mrr"), 6).alias("mrr"), F.count("*").alias("n"))


@query("SELECT label, round(median(x), 6) AS median, round(coalesce(stddev_samp(x), 0), 6) AS std, min(x) AS least, max(x) AS most, count(*) FILTER (x IS NULL) AS missing FROM (SELECT CAST(label AS BIGINT) AS label, CASE WHEN vec_id % 9 <> 0 THEN CAST(embedding[3] AS DOUBLE) END AS x FROM embeddings) GROUP BY label")
def a19_repeat_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("label"), F.when(F.col("vec_id") % 9 != 0, F.get("embedding", 2).cast("double")).alias("x"))
    return v.groupBy("label").agg(*E.repeats(F.col("x")))


@query(f"WITH {_CASES}, b AS (SELECT case_id, recall FROM (SELECT rel.case_id, count(*) FILTER (r2 <= 10) / count(*) AS recall FROM rel LEFT JOIN (SELECT source AS case_id, doc_id AS id, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS r2 FROM documents) USING (case_id, id) GROUP BY 1)) SELECT case_id, round(ms.recall - b.recall, 6) AS delta, round(ms.recall - b.recall, 6) < -0.05 AS red FROM ms JOIN b USING (case_id)")
def e7_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.difference(_metrics(spark, sf_dir), _metrics(spark, sf_dir, "asc"), "case_id", "recall")


@query("SELECT o_orderkey, bool_and(l_returnflag <> 'R') AS faithful, count(*) AS claims FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def e3_citation_fidelity(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min(F.col("l_returnflag") != "R").alias("faithful"), F.count("*").alias("claims"))
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    return o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "faithful", "claims")


@query("SELECT quality, toxic, count(*) AS n, CASE WHEN quality = 1 AND toxic = 0 THEN 1.0 WHEN quality = 0 AND toxic = 1 THEN 0.0 ELSE 0.5 END::DOUBLE AS accuracy FROM labels GROUP BY 1, 2")
def e4_three_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), 1.0).when((F.col("quality") == 0) & (F.col("toxic") == 1), 0.0).otherwise(0.5)
    return table(spark, sf_dir, "labels").groupBy("quality", "toxic").agg(F.count("*").alias("n")).withColumn("accuracy", state)


@query(f"WITH {EVENTS_SQL} SELECT user_id, round(arg_max(value, epoch * 10000000 + event_id) - arg_min(value, epoch * 10000000 + event_id), 6) AS gain, arg_max(value, epoch * 10000000 + event_id) < arg_min(value, epoch * 10000000 + event_id) - 5 AS harmful FROM ev GROUP BY user_id")
def e5_e6_repair_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.struct("epoch", "event_id")
    g = events(spark, sf_dir).groupBy("user_id").agg(F.max_by("value", at).alias("last"), F.min_by("value", at).alias("first"))
    return g.select("user_id", F.round(F.col("last") - F.col("first"), 6).alias("gain"), (F.col("last") < F.col("first") - 5).alias("harmful"))


@query("SELECT conv_id, round(avg(length(text)), 6) AS mean_length, round(count(*) FILTER (length(text) < 150) / count(*), 6) AS noise FROM conversations GROUP BY conv_id")
def e8_quality_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("text")
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.round(F.avg(n), 6).alias("mean_length"), F.round(F.count(F.when(n < 150, 1)) / F.count("*"), 6).alias("noise"))


# tables: lines of an order are a table, its numbers the columns

_CELLS = "cl AS (SELECT * FROM (SELECT l_orderkey AS table_id, l_linenumber AS row_label, max(l_quantity) AS quantity, max(l_extendedprice) AS price, max(l_tax) AS tax FROM lineitem GROUP BY 1, 2) UNPIVOT (value FOR column_ IN (quantity, price, tax)))"


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    rows = li.groupBy(F.col("l_orderkey").alias("table_id"), F.col("l_linenumber").alias("row_label")).agg(F.max("l_quantity").alias("quantity"), F.max("l_extendedprice").alias("price"), F.max("l_tax").alias("tax"))
    return TB.cells(rows, ["table_id", "row_label"], ["quantity", "price", "tax"])


@query(f"WITH {_CELLS} SELECT table_id, row_label, column_ AS column, value FROM cl")
def c12_table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, sf_dir)


@query(f"WITH {_CELLS} SELECT table_id, column_ AS column, arg_max(row_label, value * 1000 - row_label * 1e-4) AS max_row, max(value) AS max_value, arg_min(row_label, value * 1000 + row_label * 1e-4) AS min_row, min(value) AS min_value FROM cl GROUP BY 1, 2")
def r4_extreme_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TB.extremes(_cells(spark, sf_dir), ["table_id", "column"])


@query(f"WITH {_CELLS} SELECT a.table_id, a.column_ AS column, round(b.value - a.value, 6) AS difference FROM cl a JOIN cl b ON a.table_id = b.table_id AND a.column_ = b.column_ WHERE a.row_label = 1 AND b.row_label = 2")
def r5_difference_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TB.differences(_cells(spark, sf_dir), 1, 2)


@query(f"WITH {_CELLS} SELECT table_id, row_label, value FROM cl WHERE column_ = 'price' AND row_label IN (1, 3) AND value > 20000")
def r6_lookup_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, sf_dir).filter("column = 'price' and row_label in (1, 3) and value > 20000").select("table_id", "row_label", "value")


@query(r"""WITH w AS (SELECT DISTINCT unnest(regexp_split_to_array(text, '\s+')) AS raw FROM documents), t AS (SELECT raw, regexp_extract(regexp_replace(raw, '(\d),(\d\d\d)', '\1\2', 'g'), '-?\d+(?:\.\d+)?', 0) AS n FROM w),
u AS (SELECT raw, TRY_CAST(nullif(n, '') AS DOUBLE) AS value, CASE WHEN contains(raw, '%') THEN '%' WHEN contains(raw, 'ms') THEN 'ms' WHEN contains(raw, 'kg') THEN 'kg' WHEN contains(raw, 'GB') THEN 'GB' WHEN contains(raw, 'dB') THEN 'dB' ELSE '' END AS unit FROM t)
SELECT raw, value, unit, CAST(CASE WHEN value IS NULL THEN 0.0 WHEN regexp_replace(raw, '[-+\d.,%\s]', '', 'g') = '' THEN 0.95 WHEN unit <> '' THEN 0.85 ELSE 0.6 END AS DOUBLE) AS confidence FROM u""")
def f28_cell_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "documents").select(F.explode(F.split("text", r"\s+")).alias("raw")).distinct()
    value, unit, confidence = TB.cell_value(F.col("raw"))
    return w.select("raw", value.alias("value"), unit.alias("unit"), confidence.alias("confidence"))


@query("""WITH t AS (SELECT l_orderkey AS table_id, count(*) AS rows_, sum(l_quantity) AS q, max(l_discount) AS d FROM lineitem GROUP BY 1), s AS (SELECT table_id, CAST(round(CASE WHEN table_id % 11 = 0 THEN 1.1 ELSE 0 END + least(0.45, (q % 10) / 10 * 0.6) + least(0.28, (q % 4) / 4 * 0.35) + least(0.8, (table_id % 5) * 0.26) + least(0.55, rows_ * 0.2) + CASE WHEN table_id % 3 = 0 THEN 0.25 ELSE 0 END + CASE WHEN table_id % 4 = 0 THEN 0.18 ELSE 0 END + least(0.85, d * 9), 4) AS DOUBLE) AS score FROM t)
SELECT table_id, score, row_number() OVER (ORDER BY score DESC, table_id) AS rank FROM (SELECT * FROM s ORDER BY table_id LIMIT 8) WHERE score >= 0.22""")
def r3_table_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    t = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("table_id")).agg(F.count("*").alias("rows_"), F.sum("l_quantity").alias("q"), F.max("l_discount").alias("d"))
    i = F.col("table_id")
    score = TB.table_score(i % 11 == 0, F.col("q") % 10 / 10, F.col("q") % 4 / 4, i % 5, F.col("rows_"), i % 3 == 0, i % 4 == 0, F.col("d") * 10)
    first8 = t.select("table_id", score.alias("score")).orderBy("table_id").limit(8)  # the first tables, not the best
    return first8.filter("score >= 0.22").withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "table_id")).cast("long"))


# functions of answers and records


@query(r"""WITH a AS (SELECT conv_id, turn, text || ' [S' || CAST(turn AS VARCHAR) || '] and [S2] then [S' || CAST(conv_id % 12 AS VARCHAR) || '] [S2]' AS t FROM conversations)
SELECT conv_id, turn, array_to_string(list_transform(list_filter(regexp_extract_all(t, '\[S(\d+)\]', 1), lambda x, i: list_position(regexp_extract_all(t, '\[S(\d+)\]', 1), x) = i), lambda x: x), ',') AS cited, len(list_filter(list_distinct(regexp_extract_all(t, '\[S(\d+)\]', 1)), lambda x: CAST(x AS INT) NOT BETWEEN 1 AND 5))::BIGINT AS invalid,
 CAST(length(regexp_replace(regexp_replace(t, '\[S([1-5])\]', '[s\1]', 'g'), '\[S\d+\]', '', 'g')) AS BIGINT) AS stripped_chars FROM a""")
def f30_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    t = F.concat("text", F.lit(" [S"), F.col("turn").cast("string"), F.lit("] and [S2] then [S"), (F.col("conv_id") % 12).cast("string"), F.lit("] [S2]"))
    c = c.select("conv_id", "turn", t.alias("t"))
    invalid = F.size(F.filter(E.cited(F.col("t")), lambda x: ~x.between(1, 5))).cast("long")
    return c.select("conv_id", "turn", F.array_join(E.cited(F.col("t")), ",").alias("cited"), invalid.alias("invalid"), F.length(E.without_invalid(F.col("t"), 5)).cast("long").alias("stripped_chars"))


@query("SELECT doc_id, coalesce(nullif(CASE WHEN doc_id % 3 = 0 THEN source ELSE '' END, ''), nullif(CASE WHEN doc_id % 3 = 1 THEN lang ELSE '' END, ''), left(sha256(text), 16)) AS identity FROM documents")
def f31_candidate_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = lambda m, c: F.when(F.col("doc_id") % 3 == m, F.nullif(F.col(c), F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(first(0, "source"), first(1, "lang"), F.substring(F.sha2("text", 256), 1, 16)).alias("identity"))


@query(r"SELECT page_id, regexp_replace(regexp_replace(lower(trim(url)), '^https?://(www\.)?', ''), 'v\d+$', '') AS id, CAST(length(trim(regexp_replace(html, '\s+', ' ', 'g'))) AS BIGINT) AS chars FROM pages")
def f32_normal_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", F.regexp_replace(F.regexp_replace(F.lower(F.trim("url")), r"^https?://(www\.)?", ""), r"v\d+$", "").alias("id"), F.length(F.trim(F.regexp_replace("html", r"\s+", " "))).cast("long").alias("chars"))


@query(r"""WITH n AS (SELECT conv_id, ' ' || trim(regexp_replace(lower(string_agg(text, ' ' ORDER BY turn) FILTER (role = 'assistant')), '[^\p{L}\p{N}]+', ' ', 'g')) || ' ' AS t FROM conversations GROUP BY conv_id)
SELECT conv_id, CAST(round((CAST(contains(t, ' the ') AS INT) + CAST(contains(t, ' of the ') AS INT) + CAST(contains(t, ' der ') AS INT)) / 3.0, 6) AS DOUBLE) AS coverage FROM n WHERE t IS NOT NULL""")
def f29_key_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "conversations").filter("role = 'assistant'").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("m"))
    said = F.array_join(F.transform("m", lambda x: x["text"]), " ")
    t = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(said), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))
    hits = sum((F.when(F.col("t").contains(f" {p} "), 1).otherwise(0) for p in ("the", "of the", "der")), F.lit(0))
    return a.select("conv_id", t.alias("t")).select("conv_id", F.round(hits / 3.0, 6).alias("coverage"))


@query("""WITH v AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag IN ('A', 'R') THEN 'table_structured' ELSE 'keyword' END AS route, l_quantity > 5 AS cells, (['max', 'min', 'difference', 'lookup'])[CAST(l_partkey % 4 AS INT) + 1] AS op, (['compute', 'defer_to_llm', 'none'])[CAST(l_suppkey % 3 AS INT) + 1] AS decision, CASE WHEN l_linenumber = 3 THEN NULL ELSE l_discount * 20 END AS confidence FROM lineitem)
SELECT l_orderkey, l_linenumber, CAST(round(CASE WHEN route = 'table_structured' AND cells THEN 1 + least(0.3, coalesce(confidence, 0) * 0.22) + CASE WHEN decision = 'compute' AND op IN ('max', 'min', 'difference') THEN 0.08 WHEN decision = 'defer_to_llm' THEN 0.03 ELSE 0 END ELSE 1 END, 6) AS DOUBLE) AS multiplier FROM v""")
def f33_vote_multiplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda items, at: F.get(F.array(*map(F.lit, items)), (F.col(at) % len(items)).cast("int"))
    route = F.when(F.col("l_returnflag").isin("A", "R"), "table_structured").otherwise("keyword")
    confidence = F.when(F.col("l_linenumber") != 3, F.col("l_discount") * 20)
    m = RL.vote_multiplier(route, F.col("l_quantity") > 5, pick(("max", "min", "difference", "lookup"), "l_partkey"), pick(("compute", "defer_to_llm", "none"), "l_suppkey"), confidence)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(m, 6).alias("multiplier"))


@query("""WITH t AS (SELECT doc_id, text AS t FROM documents), n AS (SELECT doc_id, t, (SELECT max(k) FROM range(0, 201) r(k) WHERE k <= length(t) AND strlen(substring(t, 1, k)) <= 200) AS k FROM t) SELECT doc_id, substring(t, 1, k) AS cut FROM n""")
def f36_utf8_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.utf8_cut(F.col("text"), 200).alias("cut"))


@query(f"WITH {EVENTS_SQL} SELECT event_id, CASE event_type WHEN 'purchase' THEN 'liked' WHEN 'error' THEN 'disliked' WHEN 'view' THEN 'read' WHEN 'click' THEN 'qa_asked' ELSE event_type END AS action, CASE event_type WHEN 'purchase' THEN 3.0 WHEN 'error' THEN 2.4 WHEN 'click' THEN 2.2 WHEN 'view' THEN 0.18 ELSE 0.0 END::DOUBLE AS strength FROM ev")
def f37_event_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.create_map(*[F.lit(x) for kv in {"purchase": "liked", "error": "disliked", "view": "read", "click": "qa_asked"}.items() for x in kv])
    weights = F.create_map(*[F.lit(x) for kv in {"purchase": 3.0, "error": 2.4, "click": 2.2, "view": 0.18}.items() for x in kv])
    e = F.col("event_type")
    return events(spark, sf_dir).select("event_id", F.coalesce(F.try_element_at(names, e), e).alias("action"), F.coalesce(F.try_element_at(weights, e), F.lit(0.0)).alias("strength"))


_VIEW = "list_distinct(regexp_extract_all(lower({}), '[a-z0-9]+'))"


@query(f"""WITH v AS (SELECT conv_id, [split_part(a, chr(10), 1), 'The: ' || split_part(a, chr(10), 1) || '!', split_part(a, chr(10), 1) || ' again', list_reduce(['x'] || list_slice(string_split(a, ' '), 1, 12), lambda p, q: p || ' ' || q), '--'] AS vs FROM (SELECT conv_id, min(coalesce(text, '')) FILTER (turn <= 1) AS a FROM conversations GROUP BY conv_id) WHERE a IS NOT NULL),
w AS (SELECT conv_id, list_filter(vs, lambda v: len({_VIEW.format('v')}) > 0) AS vs FROM v)
SELECT conv_id, array_to_string(CASE WHEN len(vs) = 0 THEN vs ELSE list_reduce(list_transform(vs, lambda v: [v]), lambda acc, x: CASE WHEN len(list_filter(acc, lambda k: len(list_intersect({_VIEW.format('k')}, {_VIEW.format('x[1]')})) >= 0.88 * len(list_distinct(list_concat({_VIEW.format('k')}, {_VIEW.format('x[1]')}))))) > 0 THEN acc ELSE list_concat(acc, x) END) END, '|') AS kept FROM w""")
def f12_view_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.min(F.when(F.col("turn") <= 1, F.coalesce("text", F.lit("")))).alias("a")).filter("a is not null")
    first = F.substring_index("a", "\n", 1)
    views = F.array(first, F.concat(F.lit("The: "), first, F.lit("!")), F.concat(first, F.lit(" again")), F.array_join(F.concat(F.array(F.lit("x")), F.slice(F.split("a", " "), 1, 12)), " "), F.lit("--"))
    return c.select("conv_id", F.array_join(RL.deduped_views(views), "|").alias("kept"))
