"""What a job shuffles: rows that all its stages write."""

import uuid


def shuffled_rows(spark, job):
    """(what the job gives, rows that its stages wrote for others to read)."""
    sc, group = spark.sparkContext, uuid.uuid4().hex
    sc.setJobGroup(group, "counted")
    try:
        out = job()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    tracker, store = sc.statusTracker(), sc._jsc.sc().statusStore()
    stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
    return out, sum(store.lastStageAttempt(s).shuffleWriteRecords() for s in stages)
