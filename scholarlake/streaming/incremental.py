"""Incremental ingest, deduplication, limits and leases as streams.

Each function takes a streaming (or batch) DataFrame and gives one; `drained` runs a stream over what is there and
returns its rows, for tests and for catching up. State is keyed and expires by watermark: a counter when its window has
passed, a lease when it has run out.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from scholarlake.sources.published import shared_dir


def event_stream(spark: SparkSession, folder: str, name: str = "events") -> DataFrame:
    """The event table as a stream; its timestamps have no zone, so they are read as UTC before a watermark."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    # a file source reads folders: the pattern takes the one file or the folder's parts
    rows = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(f"{folder}/{name}.parquet*")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def checkpoints(spark: SparkSession) -> str:
    """A folder for a stream's checkpoint below spark.checkpoint.dir; where that is unset, a local session gets a temporary one and a cluster has to name it."""
    base = shared_dir(spark)
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"


def drained(stream: DataFrame, mode: str = "append", each: Callable[[DataFrame, int], None] | None = None) -> DataFrame:
    """Runs a stream over all that is there now, to a table in the shared folder, and reads it."""
    spark = stream.sparkSession
    place = checkpoints(spark)
    if mode == "append" and each is None:
        q = stream.writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
    else:
        # complete and update modes: a batch replaces what a sink without updates holds
        put = each or (lambda df, i: df.write.mode("overwrite").parquet(f"{place}/out"))
        q = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{place}/out")


def windowed_counts(events: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(window_start, event_type, n): counts of fixed windows, late events within the watermark included."""
    g = events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return g.select(F.unix_timestamp("w.start").alias("window_start"), "event_type", "n")


def deduplicated(events: DataFrame, key: list[str], late: str = "1 hour") -> DataFrame:
    """The first arrival of each key within the watermark; fits repeats that are equal."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(key)


def in_time(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A key's rows of a batch in order of time, as one frame: Arrow hands them over in chunks, each in any order."""
    if chunks := list(pdfs):
        yield pd.concat(chunks, ignore_index=True).sort_values(["epoch", "event_id"])


def rate_limited(events: DataFrame, per_window: int, seconds: int, late: str = "1 hour") -> DataFrame:
    """(user_id, event_id, allowed): at most so many events of a user in each fixed window; state is one counter per user."""

    def decide(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        window, used = state.get if state.exists else (-1, 0)
        for pdf in in_time(pdfs):
            allowed = []
            for at in pdf["epoch"]:
                w = int(at) // seconds
                used = used + 1 if w == window else 1
                window = w
                allowed.append(used <= per_window)
            yield pd.DataFrame({"user_id": pdf["user_id"], "event_id": pdf["event_id"], "allowed": allowed})
        state.update((window, used))
        state.setTimeoutTimestamp(max((window + 1) * seconds * 1000, state.getCurrentWatermarkMs() + 1))

    rows = events.withWatermark("ts", late).select("ts", "user_id", "event_id", F.unix_timestamp("ts").alias("epoch"))
    return rows.groupBy("user_id").applyInPandasWithState(decide, "user_id long, event_id long, allowed boolean", "window long, used long", "append", GroupStateTimeout.EventTimeTimeout)


def leases(events: DataFrame, seconds: int, late: str = "1 hour") -> DataFrame:
    """(user_id, event_id, outcome): a view claims a lease, a click renews it, a purchase ends it; an old one expires when the next event comes."""

    def turn(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        (until,) = state.get if state.exists else (-1,)
        for pdf in in_time(pdfs):
            out = []
            for kind, at in zip(pdf["event_type"], pdf["epoch"], strict=True):
                held = at < until
                if kind == "view":
                    out.append("busy" if held else "claimed")
                    until = until if held else at + seconds
                elif kind == "click":
                    out.append("renewed" if held else "lost")
                    until = at + seconds if held else until
                else:
                    out.append("done" if held else "ignored")
                    until = -1 if held else until
            yield pd.DataFrame({"user_id": pdf["user_id"], "event_id": pdf["event_id"], "outcome": out})
        if until < 0:
            state.remove()
            return
        state.update((int(until),))
        state.setTimeoutTimestamp(max(int(until) * 1000, state.getCurrentWatermarkMs() + 1))

    rows = events.filter(F.col("event_type").isin("view", "click", "purchase")).withWatermark("ts", late).select("ts", "user_id", "event_id", "event_type", F.unix_timestamp("ts").alias("epoch"))
    return rows.groupBy("user_id").applyInPandasWithState(turn, "user_id long, event_id long, outcome string", "until long", "append", GroupStateTimeout.EventTimeTimeout)


def caught_up(batch: DataFrame, done: DataFrame, key: str, most: int) -> DataFrame:
    """Of a micro-batch the newest `most` rows whose key is not done yet; for foreachBatch."""
    return batch.join(done, key, "left_anti").orderBy(F.desc("ts"), F.desc("event_id")).limit(most)
