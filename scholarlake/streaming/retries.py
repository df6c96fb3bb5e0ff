"""Catching up with what fails: each item waits after a failure, longer each time, and is left alone for the day after three.

State is kept per item: a number and when it ends. Timers of event time end a wait or a day, and then the state is gone;
items that succeed leave none. What is due goes to the next round, newest first, so many at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from scholarlake.streaming.incremental import in_time

#: Seconds of the first wait and the longest, failures until an item is left alone, and items of a round.
FIRST_WAIT, LONGEST_WAIT, MOST_FAILURES, ROUND = 60, 1800, 3, 1000
DAY = 86_400
RESULT = "item string, at long, state string, failures int, until long"


def wait(failures: int) -> int:
    return min(LONGEST_WAIT, FIRST_WAIT * 2 ** max(0, failures - 1))


class Retries(StatefulProcessor):
    """Of attempts (item, event_id, epoch, ok): what becomes of each item. done, waiting (until), skipped (until the next day); and due when a timer ends either.

    A failure that comes while an item waits counts as one more. Failures of a day that is over count no more.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.count = handle.getValueState("count", "failures int, until long, day long")

    def _forget(self) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.count.clear()

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        out = []
        now = timerValues.getCurrentWatermarkInMs()
        for chunk in in_time(rows):
            for at, ok in zip(chunk["epoch"], chunk["ok"], strict=True):
                at = int(at)
                if ok:
                    self._forget()
                    out.append((key[0], at, "done", 0, None))
                    continue
                failures, _, day = self.count.get() if self.count.exists() else (0, 0, at // DAY)
                failures = failures + 1 if day == at // DAY else 1
                skipped = failures >= MOST_FAILURES
                until = (at // DAY + 1) * DAY if skipped else at + wait(failures)
                self._forget()
                self.count.update((failures, until, at // DAY))
                self.handle.registerTimer(max(until * 1000, now + 1))
                out.append((key[0], at, "skipped" if skipped else "waiting", failures, until))
        if out:
            yield pd.DataFrame(out, columns=["item", "at", "state", "failures", "until"]).astype({"until": "Int64"})

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        failures, until, _ = self.count.get()
        if failures >= MOST_FAILURES:
            self.count.clear()  # the day is over; a wait that is over keeps its number, for the next failure waits longer
        else:
            # kept for the rest of the day at most
            end = (until // DAY + 1) * DAY
            if until < end and expiredTimerInfo.getExpiryTimeInMs() < end * 1000:
                self.handle.registerTimer(end * 1000)
            if expiredTimerInfo.getExpiryTimeInMs() >= end * 1000:
                self.count.clear()
                return
        yield pd.DataFrame([(key[0], int(until), "due", failures, None)], columns=["item", "at", "state", "failures", "until"]).astype({"until": "Int64"})

    def close(self) -> None:
        pass


def retried(attempts: DataFrame, late: str = "10 minutes") -> DataFrame:
    """The stream of RESULT rows for a stream of attempts (item, event_id, ts, ok)."""
    rows = attempts.withWatermark("ts", late).select("ts", F.col("item").cast("string").alias("item"), "event_id", F.unix_timestamp("ts").alias("epoch"), "ok")
    return rows.groupBy("item").transformWithStateInPandas(Retries(), RESULT, "Append", "EventTime")


def latest(results: DataFrame) -> DataFrame:
    """Of RESULT rows the last of each item: what a table of states holds after a batch."""
    w = Window.partitionBy("item").orderBy(F.desc("at"), F.desc("failures"), "state")
    return results.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def next_round(missing: DataFrame, states: DataFrame, now: int, most: int = ROUND) -> DataFrame:
    """The items of the next round: of `missing` (item, ts) those that neither wait nor are left alone at `now`, newest first, `most` at most."""
    held = states.filter(F.col("state").isin("waiting", "skipped") & (F.col("until") > now)).select("item")
    return missing.join(held, "item", "left_anti").orderBy(F.desc("ts"), "item").limit(most)
