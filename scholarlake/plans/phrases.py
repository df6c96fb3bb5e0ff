"""Intents of questions, kinds and topics of labels, and weights of fields, by tables of rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholarlake.operators import phrases as PH
from scholarlake.plans.registry import query
from scholarlake.sources.tables import table

#: Beginnings of questions and labels; each turn has one of them before its own text.
_QUESTIONS = ("What does Fig. 3 say?", "How do they compare with the baseline?", "总结这篇论文", "Is there evidence for it?", "Which dataset", "the training pipeline", "", "What is a Hyperparameter", "results and overall performance score", "limitations?")
_LABELS = ("Retrieval-Augmented  Generation", "ragtime", "RAGs", "the rank of", "cs.CL", "2401.01234v2", "https://x.org", "models", "Multi‐Agent_Systems", "code generation / ablation", "A survey of benchmarks with agents", "storage coverage", "math.CO", "episodic memories", "Episodic Memory", "and rank", "QA", "hep-th/9901001")
_sql = lambda items: "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in items) + "]"
_QUESTION_SQL = f"qs AS (SELECT conv_id, turn, ({_sql(_QUESTIONS)})[CAST((conv_id + turn) % {len(_QUESTIONS)} AS INT) + 1] || ' ' || coalesce(text, '') AS q, lower(trim(regexp_replace(({_sql(_QUESTIONS)})[CAST((conv_id + turn) % {len(_QUESTIONS)} AS INT) + 1] || ' ' || coalesce(text, ''), '\\s+', ' ', 'g'))) AS n FROM conversations)"
_any = lambda column, phrases: "(" + " OR ".join(f"contains({column}, '{p}')" for p in phrases) + ")"
_INTENT_SQL = f"""{_QUESTION_SQL}, mi AS (SELECT *, CASE {" ".join(f"WHEN {_any('n', ps)} THEN '{k}'" for k, ps in PH.INTENTS.items())} ELSE 'other' END AS main FROM qs),
su AS (SELECT *, list_slice(list_filter([{", ".join(f"CASE WHEN {_any('n', ps)} THEN '{k}' END" for k, ps in PH.SUB_INTENTS.items())}], lambda x: x IS NOT NULL), 1, 3) AS found FROM mi),
ss AS (SELECT conv_id, turn, main, CASE WHEN len(found) > 0 THEN found WHEN main IN ('paper_overview', 'contribution', 'comparison', 'result_analysis') THEN ['paper_overview'] WHEN main = 'figure_table' THEN ['table_lookup'] ELSE ['evidence_seeking'] END AS subs FROM su)"""


def _pick(items: tuple[str, ...]) -> F.Column:
    return F.get(F.array(*map(F.lit, items)), ((F.col("conv_id") + F.col("turn")) % len(items)).cast("int"))


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.concat(_pick(_QUESTIONS), F.lit(" "), F.coalesce("text", F.lit("")))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", q.alias("q"))
    rows = rows.withColumn("main", PH.main_intent(F.col("q")))
    return rows.withColumn("subs", PH.sub_intents(F.col("q"), F.col("main")))


def _weight_sql(i: int, route: str) -> str:
    by = " ".join(f"WHEN '{k}' THEN {w[i]}" for k, w in PH.ROUTE_WEIGHTS.items())
    times = "".join(f" * CASE WHEN list_contains(subs, '{s}') THEN {f[route]} ELSE 1 END" for s, f in PH.SUB_FACTORS.items() if route in f)
    return f"round(CAST(CASE main {by} END AS DOUBLE){times.replace(' THEN ', ' THEN CAST(').replace(' ELSE', ' AS DOUBLE) ELSE')}, 3) AS {route}"


@query(f"WITH {_INTENT_SQL} SELECT conv_id, turn, main, array_to_string(subs, ',') AS subs, {', '.join(_weight_sql(i, r) for i, r in enumerate(PH.ROUTES))} FROM ss")
def f35_intent_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _questions(spark, sf_dir).select("conv_id", "turn", "main", F.array_join("subs", ",").alias("subs"), *PH.route_weights(F.col("main"), F.col("subs")))


_LABEL_SQL = f"lb AS (SELECT conv_id, turn, trim(regexp_replace(({_sql(_LABELS)})[CAST((conv_id + turn) % {len(_LABELS)} AS INT) + 1] || CASE WHEN turn % 3 = 2 THEN ' ' || left(coalesce(text, ''), 20) ELSE '' END, '\\s+', ' ', 'g')) AS t FROM conversations)"


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.concat(_pick(_LABELS), F.when(F.col("turn") % 3 == 2, F.concat(F.lit(" "), F.left(F.coalesce("text", F.lit("")), F.lit(20)))).otherwise(""))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", t.alias("label"))


_STOP = "(" + ", ".join(f"'{w}'" for w in PH.LABEL_STOPWORDS) + ")"


@query(rf"""WITH {_LABEL_SQL}, w AS (SELECT *, list_filter(string_split(t, ' '), lambda x: x <> '') AS ws, list_transform(regexp_extract_all(t, '[A-Za-z][A-Za-z0-9+-]*'), lambda x: lower(x)) AS tk FROM lb)
SELECT conv_id, turn, CASE WHEN t = '' THEN 'empty' WHEN regexp_matches(t, '(?i)https?://|www\.') THEN 'url' WHEN regexp_matches(t, '^(?:\d{{4}}\.\d{{4,5}}(?:v\d+)?|[a-z-]+(?:\.[A-Z]{{2}})?/\d{{7}}(?:v\d+)?)$') THEN 'id'
 WHEN (regexp_matches(t, '^[a-z-]+(?:\.[A-Z]{{2}})?$') AND contains(t, '.')) OR starts_with(lower(t), 'cs.') THEN 'category'
 WHEN length(t) > 60 OR len(ws) > 6 OR (len(ws) >= 4 AND len(list_intersect(list_transform(ws, lambda x: lower(regexp_replace(x, '^[.,:;!?()\[\]{{}}]+|[.,:;!?()\[\]{{}}]+$', '', 'g'))), {_sql(PH.TITLE_JOINERS)})) > 0) OR regexp_matches(t, '[:?!]| -- | - ') THEN 'title'
 WHEN lower(t) IN {PH.LOW_INFORMATION} THEN 'low_information' WHEN len(tk) >= 2 AND (tk[1] IN {_STOP} OR tk[-1] IN {_STOP} OR (len(tk) >= 4 AND len(list_filter(tk, lambda x: x IN {_STOP})) >= 2)) THEN 'ngram' END AS kind FROM w""")
def f24_label_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labels(spark, sf_dir).select("conv_id", "turn", PH.label_kind(F.col("label")).alias("kind"))


@query(rf"""WITH {_LABEL_SQL}, n AS (SELECT conv_id, turn, trim(regexp_replace(regexp_replace(translate(lower(t), '_/', '  '), '[-\x{{2010}}-\x{{2015}}]+', '-', 'g'), '\s+', ' ', 'g')) AS n FROM lb)
SELECT conv_id, turn, CASE {" ".join(f"WHEN regexp_matches(n, '(^|[^a-z0-9])({'|'.join(ps)})(s|es)?([^a-z0-9]|$)') THEN '{k}'" for k, ps in PH.TOPICS.items())} END AS topic FROM n""")
def f25_rule_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labels(spark, sf_dir).select("conv_id", "turn", PH.topic(F.col("label")).alias("topic"))


def _field_sql(name: str, w: float) -> str:
    asked = {"asset_caption": 1.15, "asset_aux": 0.72}.get(name, w)
    other = min(w, {"asset_caption": 0.12, "asset_aux": 0.05}.get(name, w))
    low = min(other, {"body": 0.38, "section_title": 0.35, "section_path": 0.25, "asset_caption": 0.08, "asset_aux": 0.03}.get(name, other))
    return f"round(CAST(CASE WHEN main = 'figure_table' THEN {asked} WHEN kind IN ('figure', 'table') THEN {low} ELSE {other} END AS DOUBLE) * own, 6) AS {name}"


@query(f"""WITH {_INTENT_SQL}, fw AS (SELECT conv_id, turn, main, (['text', 'table', 'figure'])[CAST(conv_id % 3 AS INT) + 1] AS kind, CAST(([1.0, 0.5, 0.9, 1.0])[CAST(turn % 4 AS INT) + 1] AS DOUBLE) AS own FROM ss)
SELECT conv_id, turn, main, {', '.join(_field_sql(n, w) for n, w in PH.FIELD_WEIGHTS.items())} FROM fw""")
def f9_field_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda items, at: F.get(F.array(*map(F.lit, items)), (F.col(at) % len(items)).cast("int"))
    weights = PH.field_weights(F.col("main"), pick(("text", " Table", "figure"), "conv_id"), pick((1.0, 0.5, 0.9, 0.0), "turn"))
    return _questions(spark, sf_dir).select("conv_id", "turn", "main", *weights)
