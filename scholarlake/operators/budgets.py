"""Requests that several budgets must admit together: all of them count, or none.

Whether a request is admitted depends on the earlier requests of each of its counters, and so on theirs. No request is
looked at out of its counters: each round every counter adds up, in order, what it has admitted for certain and what it
may have admitted. A request that fits even if all undecided earlier ones were admitted is admitted; one that a counter
refuses for certain is refused. The earliest undecided request of any set of counters that share requests is always
decided, and mostly nearly all of them are.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scholarlake.sources.published import shared_dir


def _saved(df: DataFrame, name: str) -> DataFrame:
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def admitted(requests: DataFrame, request: str = "request") -> DataFrame:
    """(request, allowed, refused_by): requests in order of time against fixed windows of all their budgets.

    `requests` is a row per request and budget: request, epoch, label, identifier, amount, seconds. A counter is a label, an
    identifier, a rule (amount in seconds) and its window; requests of one second follow in order of their numbers. A refused
    request counts in no budget; refused_by is the least label of those that were used up, null if allowed. A request of no budget has no row;
    repeated rows count once.
    """
    rows = requests.select(F.col(request).alias("r"), "epoch", "label", F.col("identifier").cast("string").alias("identifier"), F.col("amount").cast("long").alias("amount"), F.col("seconds").cast("long").alias("seconds")).distinct()
    counter = F.xxhash64("label", "identifier", "amount", "seconds", F.floor(F.col("epoch") / F.col("seconds")))
    every = _saved(rows.withColumn("counter", counter), "budget-rows")
    rows = every.withColumn("state", F.lit("open"))
    order = Window.partitionBy("counter").orderBy("epoch", "r").rowsBetween(Window.unboundedPreceding, -1)
    n = lambda test: F.coalesce(F.sum(F.when(test, 1).otherwise(0)).over(order), F.lit(0))
    decided = None
    while True:
        seen = rows.withColumn("sure", n(F.col("state") == "yes")).withColumn("maybe", n(F.col("state") != "no"))
        of = seen.filter("state = 'open'").groupBy("r").agg(F.max((F.col("sure") >= F.col("amount")).cast("int")).alias("refused"), F.max((F.col("maybe") >= F.col("amount")).cast("int")).alias("doubtful"))
        new = of.select(F.col("r").alias("_r"), F.when(F.col("refused") == 1, "no").when(F.col("doubtful") == 0, "yes").alias("new")).filter("new is not null")
        new = _saved(new, "budget-decisions")
        if new.isEmpty():
            break
        decided = new if decided is None else decided.unionByName(new)
        # counters without an open request are done with
        rows = rows.join(new, F.col("r") == F.col("_r"), "left").withColumn("state", F.coalesce("new", "state")).drop("_r", "new")
        live = rows.groupBy("counter").agg(F.max((F.col("state") == "open").cast("int")).alias("live")).filter("live = 1").select(F.col("counter").alias("_k"))
        rows = _saved(rows.join(live, F.col("counter") == F.col("_k"), "left_semi"), "budget-rows")
    if decided is None:
        return requests.select(F.col(request), F.lit(True).alias("allowed"), F.lit(None).cast("string").alias("refused_by")).limit(0)
    # what was used up when each request came, now that all is known
    known = every.join(decided, F.col("r") == F.col("_r")).withColumn("used", n(F.col("new") == "yes"))
    by = F.min(F.when(F.col("used") >= F.col("amount"), F.col("label")))
    return known.groupBy(F.col("r").alias(request)).agg((F.max("new") == "yes").alias("allowed"), by.alias("refused_by"))
