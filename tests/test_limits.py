"""Budgets that admit together, and retries with timers, against plain Python."""

import random
from collections import defaultdict

import pytest

from scholarlake.operators.budgets import admitted
from scholarlake.plans import streams
from scholarlake.streaming import incremental as I
from scholarlake.streaming import retries as R


def plain_budgets(rows):
    of = defaultdict(set)
    for r, epoch, *budget in rows:
        of[epoch, r].add(tuple(budget))
    used, out = defaultdict(int), {}
    for (epoch, r), budgets in sorted(of.items()):
        keys = [((label, str(who), amount, seconds, epoch // seconds), amount, label) for label, who, amount, seconds in budgets]
        full = sorted(label for k, amount, label in keys if used[k] >= amount)
        if not full:
            for k, _, _ in keys:
                used[k] += 1
        out[r] = (not full, full[0] if full else None)
    return out


SCHEMA = "request long, epoch long, label string, identifier long, amount int, seconds int"


def test_budgets_are_those_of_plain_python(spark):
    rnd = random.Random(3)
    rows = []
    for r in range(400):
        epoch, user, address = rnd.randrange(200), rnd.randrange(12), rnd.randrange(5)
        rows += [(r, epoch, "user", user, 3, 60), (r, epoch, "user", user, 2, 10), (r, epoch, "ip", address, 9, 60)]
        if r % 3 == 0:
            rows += [(r, epoch, "route", 0, 25, 100)] * 2
    got = {r.request: (r.allowed, r.refused_by) for r in admitted(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = plain_budgets(rows)
    assert got == want and 50 < sum(a for a, _ in want.values()) < 350


def test_refused_requests_cost_nothing(spark):
    # the second request is refused by its address, so the third still fits into the user's budget
    rows = [(1, 0, "ip", 1, 1, 60), (1, 0, "user", 1, 2, 60), (2, 1, "ip", 1, 1, 60), (2, 1, "user", 1, 2, 60), (3, 2, "ip", 2, 1, 60), (3, 2, "user", 1, 2, 60), (4, 3, "user", 1, 0, 60)]
    got = {r.request: (r.allowed, r.refused_by) for r in admitted(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: (True, None), 2: (False, "ip"), 3: (True, None), 4: (False, "user")}
    assert admitted(spark.createDataFrame([], SCHEMA)).count() == 0


def test_budgets_of_all_events(spark, sf_dir):
    rows = [tuple(r) for r in streams._requests(spark, sf_dir).select("request", "epoch", "label", "identifier", "amount", "seconds").collect()]
    got = {r.request: (r.allowed, r.refused_by) for r in streams.t4_budgets(spark, sf_dir).collect()}
    assert got == plain_budgets(rows)


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(name, before)


def test_retries_over_batches(spark, rocks, tmp_path):
    from datetime import datetime, timezone

    def at(seconds):
        return datetime.fromtimestamp(1_700_006_400 + seconds, timezone.utc)  # a midnight

    batches = [
        [("a", 1, at(0), False), ("b", 2, at(0), False), ("c", 3, at(5), True), ("e", 13, at(3), False), ("e", 11, at(1), False), ("e", 12, at(2), False)],
        [("a", 4, at(100), False), ("b", 5, at(90), True)],
        [("a", 6, at(400), False), ("d", 7, at(4000), False)],
        [("a", 8, at(90_000), False), ("x", 9, at(90_000), True)],
        [("x", 10, at(200_000), True)],
    ]
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "item string, event_id long, ts timestamp, ok boolean"
    seen = []
    for k, rows in enumerate(batches):  # the stream is stopped after each batch and goes on with what it keeps
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        stream = R.retried(spark.readStream.schema(schema).parquet(folder), "0 seconds")
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
        now = {(r.item, r.at - 1_700_006_400, r.state, r.failures, None if r.until is None else r.until - 1_700_006_400) for r in spark.read.parquet(out).collect()}
        seen.append(now - set().union(*seen) if seen else now)
    found = set().union(*seen)
    assert {("a", 0, "waiting", 1, 60), ("b", 0, "waiting", 1, 60), ("c", 5, "done", 0, None)} <= found
    assert {("a", 100, "waiting", 2, 220), ("b", 90, "done", 0, None), ("a", 400, "skipped", 3, 86_400)} <= found
    # the timers: d's wait of a minute is over, e's day too; on another day a failure is a first one again
    assert ("d", 4060, "due", 1, None) in found and ("e", 3, "skipped", 3, 86_400) in found and ("e", 86_400, "due", 3, None) in found and ("a", 90_000, "waiting", 1, 90_060) in found
    assert ("b", 60, "due", 1, None) not in found  # it succeeded before its timer
    store = spark.read.format("statestore").option("stateVarName", "count").load(str(tmp_path / "state"))
    assert {r.key.item for r in store.collect()} <= {"a"}  # what is over is gone


def test_next_round(spark):
    missing = spark.createDataFrame([(f"i{k}", k) for k in range(6)], "item string, ts long")
    states = spark.createDataFrame([("i5", 1, "waiting", 1, 100), ("i4", 1, "waiting", 1, 10), ("i3", 1, "skipped", 3, 999), ("i2", 1, "due", 1, None)], R.RESULT)
    assert [r.item for r in R.next_round(missing, states, 50, most=3).collect()] == ["i4", "i2", "i1"]
    assert [R.wait(k) for k in range(1, 8)] == [60, 120, 240, 480, 960, 1800, 1800]
