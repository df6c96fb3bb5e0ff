"""Helpers shared by the corpus operators."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every operator here: space, tab, \n, \v, \f, \r, as in bytes.split().
WS = r"\x20\x09-\x0D"
WORD = rf"[^{WS}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset, a local session gets a temporary one; a cluster has to name it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="scholarlake-checkpoints-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Tables written since each open `temporaries` began, innermost last.
_OPEN: list[list[str]] = []


def saved(df: DataFrame, name: str, lasting: bool = False) -> DataFrame:
    """`df` written as Parquet to the shared folder and read again: cuts lineage and outlives any executor.

    The table stays until the end of the `temporaries` that it was written in, or for good if it is `lasting`.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _OPEN and not lasting:
        _OPEN[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def temporaries(spark: SparkSession) -> Iterator[None]:
    """Tables that `saved` writes within are deleted at the end: whatever is to outlive them has to be written by then."""
    _OPEN.append([])
    try:
        yield
    finally:
        hadoop = spark.sparkContext._jsc.hadoopConfiguration()
        for path in _OPEN.pop():
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(hadoop).delete(where, True)


def map_arrow(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """mapInArrow with a function of one record batch; None adds nothing."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := f(batch)) is not None and out.num_rows:
                yield out
        pa.default_memory_pool().release_unused()  # a worker lives on and serves other stages

    return df.mapInArrow(each, schema)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The texts of a batch; null is empty."""
    return [t or "" for t in batch.column(name).to_pylist()]


def slices(texts: list[str], chars: int = 500_000) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `chars` characters in all (a longer text stands alone), to bound memory."""
    start = total = 0
    for i, t in enumerate(texts):
        if i > start and total + len(t) > chars:
            yield start, i
            start, total = i, 0
        total += len(t)
    if start < len(texts):
        yield start, len(texts)


def batch_slices(batch: pa.RecordBatch, column: int, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about `most` bytes of a text column (a longer text stands alone), without a copy."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(int(np.searchsorted(ends, before + most, "right")), start + 1)
        yield batch.slice(start, stop - start)
        start = stop


def n_words(text: Column) -> Column:
    """Number of words of a text as long; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def tokenizer_path(name: str) -> str:
    """A public vocabulary's file; the folder is SCHOLARLAKE_TOKENIZERS or where the public_tokenizers package lies."""
    if folder := os.environ.get("SCHOLARLAKE_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def constant(numbers: list[int]) -> Column:
    """A constant array of longs; as one text it is folded to a literal at once."""
    return F.split(F.lit(",".join(map(str, numbers))), ",").cast("array<bigint>")


def key_filter(keys: DataFrame, key: str, least_bits: int = 12, most_bits: int = 22) -> Callable[[Column], Column]:
    """A test of whether a key may be among these: a bit for each hash, 8 bits a key, half a megabyte at most.

    A filter that is too full says yes too often, never no too often.
    """
    power = min(max((8 * keys.count()).bit_length(), least_bits), most_bits)
    slot = lambda k: F.shiftrightunsigned(F.xxhash64(k), 64 - power)
    bit = lambda k: slot(k).bitwiseAND(F.lit(63)).cast("int")
    # a row per 64 bits, so their number is bounded too
    found = keys.groupBy(F.shiftright(slot(F.col(key)), 6).cast("int").alias("word")).agg(F.bit_or(F.get(constant([1 << b if b < 63 else -(1 << 63) for b in range(64)]), bit(F.col(key)))).alias("bits")).collect()
    words = [0] * (1 << (power - 6))
    for r in found:
        words[r["word"]] = r["bits"]
    table = constant(words)
    return lambda k: F.getbit(F.get(table, F.shiftright(slot(k), 6).cast("int")), bit(k)) == 1


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is evaluated once, however often the body's own lambdas read it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(numbers: Column, combine: Callable[[Column, Column], Column], zero: Column) -> Column:
    """Of an array the combination of all elements up to each (a running sum or maximum), in log2(n) passes over it.

    An aggregate that appends to an array copies it each time; here pass k combines each element with the one 2^k before.
    """

    def step(acc: Column, k: Column) -> Column:
        by = F.pow(F.lit(2), k).cast("int")
        return F.zip_with(acc, F.concat(F.array_repeat(zero, by), F.slice(acc, F.lit(1), F.size(acc) - by)), combine)

    passes = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(numbers), F.lit(2)))).cast("int") - 1)
    return F.when(F.size(numbers) > 1, F.aggregate(passes, numbers, step)).otherwise(numbers)
