"""Streaming queries, run over all there is, each beside its batch form in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholarlake.operators.budgets import admitted
from scholarlake.plans.registry import query
from scholarlake.sources.tables import EVENTS_SQL, events
from scholarlake.streaming import incremental as I  # noqa: E741


@query(f"WITH {EVENTS_SQL} SELECT epoch - epoch % 86400 AS window_start, event_type, count(*) AS n FROM ev GROUP BY 1, 2")
def t1_stream_daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.drained(I.windowed_counts(I.event_stream(spark, sf_dir)), "complete")


@query(f"WITH {EVENTS_SQL} SELECT event_id, user_id FROM ev")
def t7_stream_deduplicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = I.event_stream(spark, sf_dir)
    twice = e.select("event_id", "user_id", "ts", F.explode(F.array(F.lit(0), F.lit(1)))).drop("col")
    return I.drained(I.deduplicated(twice, ["event_id"])).select("event_id", "user_id")


@query(f"WITH {EVENTS_SQL} SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id, epoch // 3600 ORDER BY epoch, event_id) <= 2 AS allowed FROM ev")
def t4_stream_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.drained(I.rate_limited(I.event_stream(spark, sf_dir), 2, 3600))


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as requests against four rules: two of a user, one of an address, one of a kind of request."""
    rules = [("user", "user_id", 3, 86_400), ("user", "user_id", 2, 3600), ("address", "k", 40, 86_400), ("kind", "event_type", 60, 86_400)]
    rows = events(spark, sf_dir).select(F.col("event_id").alias("request"), "epoch", F.explode(F.array(*[F.struct(F.lit(a).alias("label"), F.col(c).cast("string").alias("identifier"), F.lit(n).alias("amount"), F.lit(t).alias("seconds")) for a, c, n, t in rules])).alias("b"))
    return rows.select("request", "epoch", "b.*").filter("identifier is not null")


@query()
def t4_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return admitted(_requests(spark, sf_dir))


@query()
def t3_stream_leases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.drained(I.leases(I.event_stream(spark, sf_dir), 7200))


@query(f"WITH {EVENTS_SQL} SELECT event_id, user_id FROM ev WHERE user_id NOT IN (SELECT doc_id FROM labels) ORDER BY epoch DESC, event_id DESC LIMIT 200")
def t2_stream_catch_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = I.event_stream(spark, sf_dir).select("event_id", "user_id", "ts")
    done = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("user_id"))
    place = I.checkpoints(spark)

    def put(df: DataFrame, i: int) -> None:
        I.caught_up(df, done, "user_id", 200).write.mode("overwrite").parquet(f"{place}/rows/batch={i}")  # a batch that is run again replaces only itself

    e.writeStream.foreachBatch(put).option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{place}/rows").select("event_id", "user_id")
