"""A rebuild that stops and goes on, and owners that do not get in each other's way."""

import pytest

from scholarlake.sources.published import Log
from scholarlake.sources.rebuild import Busy, cuts, rebuild


@pytest.fixture
def place(spark, tmp_path):
    rows = spark.createDataFrame([(k // 2 * 3, f"t{k}") for k in range(95)] + [(None, "no key")], "id long, text string")
    return rows, Log(spark, str(tmp_path), "rebuild"), str(tmp_path / "rows")


def writer(folder, stop_at=None):
    def write(batch, i):
        if i == stop_at:
            batch.limit(1).write.mode("overwrite").parquet(f"{folder}/batch={i}")  # half a batch is left behind
            raise KeyboardInterrupt
        batch.write.mode("overwrite").parquet(f"{folder}/batch={i}")

    return write


def whole(spark, rows, folder):
    return sorted((r.id, r.text) for r in spark.read.parquet(folder).collect()) == sorted((r.id, r.text) for r in rows.filter("id is not null").collect())


def test_batches_are_ranges(spark, place):
    rows, _, _ = place
    got = sorted(tuple(r) for r in cuts(rows, "id", 10).collect())
    assert sum(g[3] for g in got) == 95 and all(a[2] < b[1] for a, b in zip(got, got[1:], strict=False)) and len(got) > 5


def test_stops_and_goes_on(spark, place):
    rows, log, folder = place
    with pytest.raises(KeyboardInterrupt):
        rebuild(rows, "id", log, writer(folder, 3), "one", size=10)
    assert log.state()["next"] == 3
    done = rebuild(rows, "id", log, writer(folder), "one", size=10)
    assert done[0] == 3 and whole(spark, rows, folder) and log.state()["status"] == "done"
    assert rebuild(rows, "id", log, writer(folder), "two", size=10)[0] == 0


def test_one_owner_at_a_time(spark, place):
    rows, log, folder = place
    with pytest.raises(KeyboardInterrupt):
        rebuild(rows, "id", log, writer(folder, 2), "one", size=20, clock=lambda: 1000.0)
    with pytest.raises(Busy, match="one is at work at batch 2"):
        rebuild(rows, "id", log, writer(folder), "two", size=20, clock=lambda: 1000.0 + 899)
    # after a quarter of an hour the second takes over while the first, not dead after all, is in the middle of a batch
    inner = writer(folder)

    def late(batch, i):
        inner(batch, i)
        if i == 3:
            rebuild(rows, "id", log, inner, "two", size=20, clock=lambda: 5000.0)

    with pytest.raises(Busy, match="taken over"):
        rebuild(rows, "id", log, late, "one", size=20, clock=lambda: 1000.0)
    assert log.state()["owner"] == "two" and log.state()["status"] == "done" and whole(spark, rows, folder)


def test_nothing_to_rebuild(spark, place):
    rows, log, folder = place
    assert rebuild(rows.limit(0), "id", log, writer(folder), "one") == [] and log.state()["status"] == "done"
