"""The registered queries of the corpus operators, and the SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholarlake.llm import chat, fim, imatch, licenses, mixing, near_dup, pieces, pii, quality, secrets, token_counts, toxicity, variants
from scholarlake.llm.common import table


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    control = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", control), (-1, 1, "assistant", control)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_conversations(turns.unionByName(own)))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, sf_dir, "documents")))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_digest(table(spark, sf_dir, "documents"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.find(table(spark, sf_dir, "documents")))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(mixing.mix(table(spark, sf_dir, "documents")))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.recount(table(spark, sf_dir, "documents"))


def op8_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.filter(toxicity.crc_part(F.col("doc_id")) != 2))
    scored = model.score(docs)
    return scored.select("doc_id", F.coalesce(toxicity.crc_part(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op10_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.compare(table(spark, sf_dir, "documents"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digest(table(spark, sf_dir, "documents"))


def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.scan(table(spark, sf_dir, "documents")))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(variants.words(table(spark, sf_dir, "documents")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


_ESCAPED = r"regexp_replace({}, '(<)(\\*)(<SYS>>|</SYS>>|/?s>)|(\[)(\\*)(/?INST\]|ROLE\]|/?TEXT\])', '\1\4\2\5\\\3\6', 'g')"

SQL = {
    "op1_chat_formatting": rf"""
WITH turns AS (
  SELECT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), checked AS (
  SELECT *, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text), '') AS before FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length({_ESCAPED.format("text")}) + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7
      ELSE 19 + length({_ESCAPED.format("role")}) END) AS BIGINT) AS formatted_chars,
  bool_and(CASE before WHEN '' THEN role IN ('system', 'user') WHEN 'system' THEN role = 'user' WHEN 'user' THEN role = 'assistant'
      WHEN 'assistant' THEN role = 'user' ELSE false END) AS valid
FROM checked GROUP BY conv_id""",
}



def _spans_sql() -> str:
    """The matches of all rules with their places: pieces between matches and the matches add up to them."""
    parts = []
    for k, r in enumerate(secrets.RULES):
        p = r.pattern.replace("'", "''")
        counted = f"regexp_extract_all(text, '{p}', {r.group})"
        parts.append(f"""SELECT doc_id, {k} AS kind, '{r.kind}' AS name, start, start + length(hit) AS stop FROM (
    SELECT doc_id, m[i] AS hit, c[i] AS counted, list_sum(list_transform(list_slice(p, 1, i), lambda x: length(x))) + coalesce(list_sum(list_transform(list_slice(m, 1, i - 1), lambda x: length(x))), 0) AS start
    FROM (SELECT doc_id, m, c, p, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{p}') AS m, {counted} AS c, regexp_split_to_array(text, '{p}') AS p FROM t WHERE regexp_matches(text, '{p}')))
  ) WHERE length(counted) >= {r.least}""")
    return " UNION ALL ".join(parts)


def _joined(where: str) -> str:
    return f"coalesce(string_agg(name || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, kind) FILTER ({where}), '')"


SQL["op4_secrets"] = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), s AS ({_spans_sql()})
SELECT t.doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
  sha256({_joined("kind < 3")}) AS base_sha256, {_joined("kind >= 0")} AS spans, count(*) FILTER (kind >= 3) AS n_more
FROM t LEFT JOIN s ON s.doc_id = t.doc_id GROUP BY t.doc_id"""

SQL["op8_near_dup"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), sh AS (
  SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(list_transform(range(1, greatest(len(ws) - 4, 1) + 1), lambda i: array_to_string(list_slice(ws, i, i + 4), ' '))) AS s FROM w WHERE len(ws) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id), pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT x, y FROM pairs JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 85 * (a.n + b.n - k)
), reach AS (SELECT x AS doc_id, x AS via FROM links UNION SELECT r.doc_id, l.y FROM reach r JOIN links l ON l.x = r.via), c AS (SELECT doc_id, min(via) AS least FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(c.least, d.doc_id)) AS component_id, least(d.doc_id, coalesce(c.least, d.doc_id)) = d.doc_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id"""

SQL["op11_fill_in_middle"] = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT *, list_transform(regexp_extract_all(x, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+'), lambda w: length(w)) AS sizes, [CAST('0x' || h[8 * i + 1 : 8 * i + 8] AS BIGINT) FOR i IN range(4)] AS d FROM t),
n AS (SELECT *, CAST(len(sizes) AS BIGINT) AS n, x = '' OR d[3] % 100 >= 50 OR regexp_matches(x, '<[PSM]>') AS plain FROM u),
c AS (SELECT *, coalesce(list_sum(sizes[1 : least(d[1] % (n + 1), d[2] % (n + 1))]), 0) AS a, coalesce(list_sum(sizes[1 : greatest(d[1] % (n + 1), d[2] % (n + 1))]), 0) AS b FROM n),
p AS (SELECT *, substring(x, 1, CAST(a AS BIGINT)) AS pre, substring(x, CAST(a AS BIGINT) + 1, CAST(b - a AS BIGINT)) AS mid, substring(x, CAST(b AS BIGINT) + 1) AS suf FROM c)
SELECT doc_id, n, CASE WHEN plain THEN 'plain' WHEN d[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form, CASE WHEN NOT plain THEN CAST(a AS BIGINT) END AS prefix_chars, CASE WHEN NOT plain THEN CAST(b - a AS BIGINT) END AS middle_chars,
  sha256(CASE WHEN plain THEN x WHEN d[4] % 100 < 80 THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE '<P>' || pre || '<S>' || suf || '<M>' || mid END) AS output_sha256, sha256(x) AS restored_sha256 FROM p"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_chat_formatting, op2_pii, op3_sentencepiece, op4_secrets, op5_mixing, op6_quality, op7_token_counts, op8_near_dup, op9_toxicity, op10_imatch, op11_fill_in_middle, op12_licenses, op13_spelling_variants, pipeline)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
