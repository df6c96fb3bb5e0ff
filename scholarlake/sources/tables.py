"""The Parquet tables, and the views of them that the operators work on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as papers: the first line is the title, the rest the abstract; source and language are the categories and name the authors.

    created is an ISO date string; dates are compared as strings, as harvested records have them.
    """
    d = table(spark, sf_dir, "documents")
    title = F.substring_index("text", "\n", 1)
    return d.select(
        F.col("doc_id").alias("paper_id"),
        title.alias("title"),
        F.col("text").substr(F.length(title) + 2, F.length("text")).alias("abstract"),
        F.array(F.concat(F.lit("Ada "), "source"), F.concat(F.lit("Noël Étienne "), "lang")).alias("authors"),
        F.array("source", "lang").alias("categories"),
        F.col("source").alias("primary_category"),
        F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("doc_id", F.lit(365)).cast("int")), "yyyy-MM-dd").alias("created"),
        F.length("text").cast("long").alias("n_chars"),
    )


#: The same view in DuckDB's SQL.
PAPERS_SQL = r"""papers AS (
  SELECT doc_id AS paper_id, split_part(text, chr(10), 1) AS title,
    substring(text, length(split_part(text, chr(10), 1)) + 2) AS abstract,
    ['Ada ' || source, 'Noël Étienne ' || lang] AS authors, [source, lang] AS categories, source AS primary_category,
    strftime(DATE '2024-01-01' + CAST(doc_id % 365 AS INTEGER), '%Y-%m-%d') AS created,
    CAST(length(text) AS BIGINT) AS n_chars
  FROM documents)"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log with a UTC timestamp, its day and the number in props."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("long").alias("k"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("epoch"))


EVENTS_SQL = r"""ev AS (
  SELECT event_id, ts, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
    CAST(floor(epoch(ts)) AS BIGINT) AS epoch FROM events)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as doubles with their norm, for arithmetic that two engines agree on."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), F.col("label").cast("long").alias("label"))
    return v.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))


VECTORS_SQL = r"""vec AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, CAST(label AS BIGINT) AS label,
    sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))) AS norm FROM embeddings)"""
