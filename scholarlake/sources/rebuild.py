"""A rebuild in batches of keys that can stop at any batch and go on there, by one owner at a time.

The batches are ranges of keys, written to a table once. The state (owner, time of its last sign, next batch) is a version of a
log: each step is a compare and swap, so an owner that was taken for dead and replaced is told at its next step, and
what it wrote is written over by the same batch of the new owner.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholarlake.sources.published import Conflict, Log

#: Rows of a batch, and seconds without a sign after which an owner counts as lost.
BATCH, STALE = 1000, 15 * 60


class Busy(RuntimeError):
    """Another owner is at work."""


def cuts(rows: DataFrame, key: str, size: int) -> DataFrame:
    """(batch, low, high, n): ranges of keys of about `size` rows, in order; null keys are in none. Rows of one key are in one range."""
    n = max(1, -(-rows.filter(F.col(key).isNotNull()).count() // size))
    dealt = rows.filter(F.col(key).isNotNull()).select(key).repartitionByRange(n, key).withColumn("_p", F.spark_partition_id())
    return dealt.groupBy(F.col("_p").alias("batch")).agg(F.min(key).alias("low"), F.max(key).alias("high"), F.count("*").alias("n"))


def rebuild(rows: DataFrame, key: str, log: Log, write: Callable[[DataFrame, int], None], owner: str, size: int = BATCH, stale: float = STALE, clock: Callable[[], float] = time.time) -> list[int]:
    """Writes all rows with a key, batch after batch, and gives the batches that this call wrote, by their place in order of keys.

    `write` gets the rows of a batch and its place; it has to replace what an earlier try left there. A rebuild that another
    owner began less than `stale` seconds ago is refused (Busy); an older one, or one's own, goes on where it stood. A rebuild
    that is done begins anew.
    """
    spark = rows.sparkSession
    state, version = log.state(), (log.versions() or [0])[-1]
    now = clock()
    if state and state["status"] == "running":
        if state["owner"] != owner and now - state["at"] < stale:
            raise Busy(f"{state['owner']} is at work at batch {state['next']}")
        state = state | {"owner": owner, "at": now}
    else:
        folder = f"{log.root}/cuts-{uuid.uuid4().hex}"
        cuts(rows, key, size).write.parquet(folder)
        state = {"owner": owner, "at": now, "status": "running", "next": 0, "cuts": folder, "batches": spark.read.parquet(folder).count()}

    def step(new: dict) -> dict:
        nonlocal version
        try:
            version = log.commit({k: v for k, v in new.items() if k != "version"}, version)
        except Conflict as e:
            raise Busy("another owner has taken over") from e
        return new

    state, done = step(state), []
    table = spark.read.parquet(state["cuts"]) if state["batches"] else None
    while state["next"] < state["batches"]:
        # one row of a table of bounds, however many there are
        place = state["next"]
        bounds = table.filter(F.col("batch") >= (state.get("after", -1) + 1)).orderBy("batch").first()
        write(rows.filter(F.col(key).between(bounds["low"], bounds["high"])), place)
        done.append(place)
        state = step(state | {"next": place + 1, "after": bounds["batch"], "at": clock()})
    step(state | {"status": "done", "at": clock()})
    return done
