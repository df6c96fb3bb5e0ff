"""Harvest, index builds and the remaining profile and context queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholarlake.operators import compact as K
from scholarlake.operators import retrieval as R
from scholarlake.operators import rules as RL
from scholarlake.operators.ranges import ranked_whole
from scholarlake.plans.registry import query
from scholarlake.sources import harvest as H
from scholarlake.sources import published as P
from scholarlake.sources import rebuild as B
from scholarlake.sources.tables import EVENTS_SQL, PAPERS_SQL, events, papers, table


def _xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of harvested XML made of documents: a page per source."""
    d = table(spark, sf_dir, "documents")
    esc = lambda c: F.regexp_replace(F.regexp_replace(c, "&", "&amp;"), "<", "&lt;")
    record = F.concat(F.lit("<record><header><identifier>oai:host:"), F.col("doc_id").cast("string"), F.lit("v2</identifier><datestamp>2024-01-01</datestamp></header><metadata><o:title>"), esc(F.substring_index("text", "\n", 1)), F.lit("</o:title><abstract>x</abstract><categories>"), F.col("source"), F.lit(" "), F.col("lang"), F.lit("</categories></metadata></record>"))
    # a page has the records of 50 ids of a source, whatever the source's size
    g = d.groupBy("source", F.floor(F.col("doc_id") / 50).alias("page")).agg(F.array_join(F.array_sort(F.collect_list(record)), "").alias("rs"))
    return g.select("source", "page", F.concat(F.lit("<OAI-PMH><ListRecords>"), "rs", F.lit("<resumptionToken>next-"), "source", F.lit("-"), F.col("page").cast("string"), F.lit("</resumptionToken></ListRecords></OAI-PMH>")).alias("xml"))


@query(r"SELECT CAST(doc_id AS VARCHAR) AS identifier, trim(regexp_replace(split_part(text, chr(10), 1), '\s+', ' ', 'g')) AS title, source || ' ' || lang AS categories FROM documents")
def s1_xml_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.records(H.parsed_pages(_xml(spark, sf_dir))).select("identifier", "title", F.array_join("categories", " ").alias("categories"))


@query("SELECT source, 'next-' || source || '-' || CAST(doc_id // 50 AS VARCHAR) AS token, CAST(NULL AS VARCHAR) AS error_code, count(*) AS n FROM documents GROUP BY source, doc_id // 50")
def s2_harvest_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.parsed_pages(_xml(spark, sf_dir)).select("source", "token", "error_code", F.size("records").cast("long").alias("n"))


@query("SELECT CAST(count(*) AS BIGINT) AS n, min(doc_id) AS first, max(doc_id) AS last FROM documents")
def s9_batched_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = f"rebuild-{uuid.uuid4().hex}"
    log = P.Log(spark, f"{P.shared_dir(spark)}/published", name)
    ids = table(spark, sf_dir, "documents").select("doc_id")
    B.rebuild(ids, "doc_id", log, lambda batch, i: batch.write.mode("overwrite").parquet(f"{log.root}/rows/batch={i}"), "query", size=max(1000, -(-ids.count() // 8)))
    return spark.read.schema("doc_id long, batch int").parquet(f"{log.root}/rows").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))


@query("SELECT collection, file, CAST(floor(coalesce(sum(n) OVER (PARTITION BY collection ORDER BY file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 200) AS BIGINT) AS grp FROM (SELECT o_orderstatus AS collection, o_custkey AS file, count(*) AS n FROM orders GROUP BY 1, 2)")
def s24_compaction_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("collection"), F.col("o_custkey").alias("file")).agg(F.count("*").alias("n"))
    return H.compaction_plan(f, 200)


@query("SELECT item_id AS case_id, CAST(length(text) AS BIGINT) AS n FROM benchmark")
def s27_golden_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.golden_cases(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("case_id"), F.length("text").cast("long").alias("n")))


@query(f"WITH {PAPERS_SQL}, b AS (SELECT paper_id, primary_category, created FROM papers UNION ALL SELECT paper_id, 'moved', created FROM papers WHERE list_contains(categories, 'de')) SELECT primary_category, count(*) AS n FROM (SELECT paper_id, max(CASE primary_category WHEN 'moved' THEN 1 ELSE 0 END) AS m, min(primary_category) FILTER (primary_category <> 'moved') AS p FROM b GROUP BY paper_id) t(paper_id, m, p0), LATERAL (SELECT CASE WHEN m = 1 THEN 'moved' ELSE p0 END AS primary_category) GROUP BY 1")
def s6_side_index_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scholarlake.operators import mirror

    p = papers(spark, sf_dir).select("paper_id", "primary_category", "categories")
    moved = p.filter(F.array_contains("categories", "de")).withColumn("primary_category", F.lit("moved"))
    return mirror.upserted([p, moved], "paper_id").groupBy("primary_category").agg(F.count("*").alias("n"))


@query("SELECT o_custkey AS paper, arg_max(o_orderkey, o_orderkey) FILTER (o_orderstatus = 'F') AS active, count(*) FILTER (o_orderstatus = 'F') - CASE WHEN count(*) FILTER (o_orderstatus = 'F') > 0 THEN 1 ELSE 0 END AS retired, count(*) FILTER (o_orderstatus <> 'F') AS unfinished FROM orders GROUP BY 1")
def c13_build_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = F.count(F.when(F.col("o_orderstatus") == "F", 1))
    g = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("paper")).agg(F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey"))).alias("active"), good.alias("g"), F.count(F.when(F.col("o_orderstatus") != "F", 1)).alias("unfinished"))
    return g.select("paper", "active", F.greatest(F.col("g") - 1, F.lit(0)).cast("long").alias("retired"), "unfinished")


@query(f"WITH {EVENTS_SQL} SELECT user_id, k, min(event_id) AS event_id, arg_max(event_type, epoch * 10000000 + event_id) AS event_type, bool_or(true) AS profile_dirty FROM ev GROUP BY 1, 2")
def p7_event_upsert_keeps_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy("user_id", "k").agg(F.min("event_id").alias("event_id"), F.max_by("event_type", F.struct("epoch", "event_id")).alias("event_type")).withColumn("profile_dirty", F.lit(True))


@query(f"WITH {EVENTS_SQL}, g AS (SELECT doc_id FROM labels WHERE quality = 1) SELECT user_id, source AS label, CAST(round(sum(CASE event_type WHEN 'purchase' THEN 3.0 WHEN 'error' THEN -2.4 ELSE 0.18 END), 4) AS DOUBLE) AS signal FROM ev JOIN documents ON doc_id = k WHERE k IN (SELECT doc_id FROM g) GROUP BY 1, 2")
def p10_concept_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    gate = table(spark, sf_dir, "labels").filter("quality = 1").select(F.col("doc_id").alias("k"))
    weight = F.when(F.col("event_type") == "purchase", 3.0).when(F.col("event_type") == "error", -2.4).otherwise(0.18)
    e = events(spark, sf_dir).select("user_id", "k", weight.alias("w")).join(gate, "k", "left_semi")
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("k"), F.col("source").alias("label"))
    return e.join(d, "k").groupBy("user_id", "label").agg(F.round(F.sum("w"), 4).alias("signal"))


@query("""SELECT doc_id, field, label, CAST(c AS DOUBLE) AS confidence FROM (SELECT doc_id, 'topic' AS field, source AS label, 0.9 AS c FROM documents UNION ALL SELECT doc_id, 'method', lang, 0.75 FROM documents UNION ALL SELECT doc_id, 'size', CASE WHEN n_chars > 1000 THEN 'long' END, 0.6 FROM documents) WHERE label IS NOT NULL""")
def p11_card_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("topic"), F.col("lang").alias("method"), F.when(F.col("n_chars") > 1000, "long").alias("size"))
    rows = d.unpivot(["doc_id"], ["topic", "method", "size"], "field", "label").filter("label is not null")
    return rows.withColumn("confidence", R.lookup(F.col("field"), {"topic": 0.9, "method": 0.75}, 0.6))


@query(f"WITH {EVENTS_SQL} SELECT user_id, event_id AS snapshot, row_number() OVER (PARTITION BY user_id ORDER BY epoch DESC, event_id DESC) AS place, row_number() OVER (PARTITION BY user_id ORDER BY epoch DESC, event_id DESC) = 1 AS active FROM ev WHERE event_type = 'click' QUALIFY place <= 5")
def p14_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).filter("event_type = 'click'").select("user_id", F.col("event_id").alias("snapshot"), "epoch")
    rows = R.ranked(e, ["user_id"], F.desc("epoch"), F.desc("snapshot"), n=5, name="place")
    return rows.select("user_id", "snapshot", "place", (F.col("place") == 1).alias("active"))


@query(f"WITH {EVENTS_SQL}, s AS (SELECT user_id, event_type, count(*) AS n, count(DISTINCT k) AS papers FROM ev GROUP BY 1, 2) SELECT user_id, CAST(sum(n) AS BIGINT) AS events, CAST(sum(papers) AS BIGINT) AS papers, count(*) AS kinds, max(n) FILTER (event_type = 'purchase') AS purchases FROM s GROUP BY user_id")
def a23_evidence_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = events(spark, sf_dir).groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.count_distinct("k").alias("papers"))
    return s.groupBy("user_id").agg(F.sum("n").cast("long").alias("events"), F.sum("papers").cast("long").alias("papers"), F.count("*").alias("kinds"), F.max(F.when(F.col("event_type") == "purchase", F.col("n"))).alias("purchases"))


@query("""WITH a AS (SELECT doc_id, source, CAST(round((doc_id * 13 % 89) / 89.0, 6) AS DOUBLE) AS base, contains(text, 'the') AS pos, contains(text, 'und') AS neg FROM documents)
SELECT doc_id, CAST(round(base + CASE WHEN pos THEN 0.05 ELSE 0 END - CASE WHEN neg THEN 0.15 ELSE 0 END, 6) AS DOUBLE) AS final, row_number() OVER (PARTITION BY source ORDER BY round(base + CASE WHEN pos THEN 0.05 ELSE 0 END - CASE WHEN neg THEN 0.15 ELSE 0 END, 6) DESC, doc_id) AS rank FROM a WHERE NOT (neg AND NOT pos)""")
def p3_adjusted_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.round((F.col("doc_id") * 13 % 89) / 89.0, 6).alias("base"), F.col("text").contains("the").alias("pos"), F.col("text").contains("und").alias("neg"))
    d = d.filter(~(F.col("neg") & ~F.col("pos"))).withColumn("final", F.round(F.col("base") + F.when(F.col("pos"), 0.05).otherwise(0.0) - F.when(F.col("neg"), 0.15).otherwise(0.0), 6))
    return ranked_whole(d, ["source"], [F.desc("final"), F.asc("doc_id")]).select("doc_id", "final", "rank")


@query("SELECT l_orderkey AS case_id, l_suppkey AS id, CAST(min(l_linenumber) AS BIGINT) AS rank FROM lineitem GROUP BY 1, 2")
def w15_best_evidence_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("case_id"), F.col("l_suppkey").alias("id")).agg(F.min("l_linenumber").cast("long").alias("rank"))


_POLICY_SQL = "pol(policy, anchor_ratio, actions, section_limit, per_anchor_limit, summary_only) AS (VALUES " + ", ".join(f"('{k}', {p[0]}, '{','.join(p[1])}', {p[4]}, {p[7]}, {p[8]})" for k, p in RL.POLICIES.items()) + ")"
_ASKED_INTENTS = (*RL.POLICIES, "contribution", "other")


@query(f"""WITH {_POLICY_SQL}, i AS (SELECT doc_id, ([{", ".join(f"'{x}'" for x in _ASKED_INTENTS)}])[CAST(doc_id % {len(_ASKED_INTENTS)} AS INT) + 1] AS intent FROM documents), q AS (SELECT doc_id, CASE WHEN intent IN (SELECT policy FROM pol) THEN intent ELSE 'default' END AS policy FROM i)
SELECT doc_id, policy, CAST(anchor_ratio AS DOUBLE) AS anchor_ratio, actions, CAST(section_limit AS BIGINT) AS section_limit, CAST(per_anchor_limit AS BIGINT) AS per_anchor_limit, summary_only FROM q JOIN pol USING (policy)""")
def x13_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    intent = F.get(F.array(*map(F.lit, _ASKED_INTENTS)), (F.col("doc_id") % len(_ASKED_INTENTS)).cast("int"))
    d = table(spark, sf_dir, "documents").select("doc_id", RL.policy_of(intent).alias("policy"))
    return d.join(F.broadcast(RL.policies(spark)), "policy").select("doc_id", "policy", "anchor_ratio", F.array_join("actions", ",").alias("actions"), "section_limit", "per_anchor_limit", "summary_only")


_BLOCK_ROLES = ("anchor_evidence", "sibling_context", "section_context", "memory_context", "parent_context", "other")
_MOST = "CASE " + " ".join(f"WHEN kind = '{k}' THEN {r[0]}" for k, r in K.KINDS.items()) + " " + " ".join(f"WHEN role = '{k}' THEN {r[0]}" for k, r in K.ROLES.items()) + f" ELSE {K.OTHER[0]} END"
_HOW = _MOST.replace(f"ELSE {K.OTHER[0]}", f"ELSE '{K.OTHER[1]}'")
for _rules in (K.KINDS, K.ROLES):
    for _name, _rule in _rules.items():
        _HOW = _HOW.replace(f"= '{_name}' THEN {_rule[0]}", f"= '{_name}' THEN '{_rule[1]}'")


@query(rf"""WITH b AS (SELECT doc_id, ({list(_BLOCK_ROLES)})[CAST(doc_id % 6 AS INT) + 1] AS role, CASE doc_id % 11 WHEN 0 THEN 'table' WHEN 1 THEN 'figure_evidence' ELSE 'text' END AS kind, regexp_replace(regexp_replace(coalesce(text, ''), '\s+
', chr(10), 'g'), '^\s+|\s+$', '', 'g') AS t FROM documents),
m AS (SELECT *, {_MOST} AS most, {_HOW} AS how, ceil(length(t) / 3.0) AS n FROM b), f AS (SELECT *, CAST(floor(most * 0.65) AS BIGINT) AS first FROM m),
k AS (SELECT doc_id, CASE WHEN n > most THEN how END AS strategy, CASE WHEN n <= most THEN t WHEN how = 'anchor_head_tail' THEN regexp_replace(left(t, first * 3), '\s+$', '') || chr(10) || '...[middle omitted by rule compaction]...' || chr(10) || regexp_replace(right(t, (most - first - 8) * 3), '^\s+', '')
  ELSE regexp_replace(left(t, most * 3), '\s+$', '') END AS kept FROM f) SELECT doc_id, strategy, md5(kept) AS text_md5, CAST(ceil(length(kept) / 3.0) AS BIGINT) AS tokens FROM k""")
def x15_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    role = F.get(F.array(*map(F.lit, _BLOCK_ROLES)), (i % 6).cast("int"))
    kind = F.when(i % 11 == 0, "table").when(i % 11 == 1, "figure_evidence").otherwise("text")
    d = table(spark, sf_dir, "documents").select("doc_id", K.compacted(F.col("text"), role, kind).alias("c"))
    return d.select("doc_id", "c.strategy", F.md5("c.text").alias("text_md5"), "c.tokens")


@query("SELECT conv_id, count(*) AS n_sources, string_agg('S' || CAST(turn + 1 AS VARCHAR) || ':' || role, '|' ORDER BY turn) AS pack, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY conv_id")
def x17_context_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.struct("turn", F.concat(F.lit("S"), (F.col("turn") + 1).cast("string"), F.lit(":"), F.col("role")).alias("s"))
    g = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n_sources"), F.array_sort(F.collect_list(item)).alias("p"), F.sum(F.length("text")).cast("long").alias("chars"))
    return g.select("conv_id", "n_sources", F.array_join(F.transform("p", lambda x: x["s"]), "|").alias("pack"), "chars")

