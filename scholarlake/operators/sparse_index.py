"""A published keyword index: postings by stem, and BM25 that reads only what it needs of them.

Postings lie in partitions by a hash of their stem, sorted by stem and impact, and a row holds those of a stem and band as
lists. The impact of a posting is what BM25 gives it before the inverse document frequency, in one of BANDS bands; the
dictionary says for each stem and band how many postings there are. So the best n of a query have a lower bound that follows from the dictionary alone, and bands that
cannot reach it together with all other terms' best are not read.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from scholarlake.functions.keywords import keyword_places
from scholarlake.functions.stem import stem_of, stems, with_stem
from scholarlake.functions.text import CJK, QUESTION_WORDS, keyword_tokens
from scholarlake.operators.retrieval import K1, B, ranked
from scholarlake.operators.streamed import starts, whole
from scholarlake.sources.published import Log

LAYOUT, BUCKETS, BANDS = 2, 32, 64
#: Postings of a bucket that one task writes, about, and most in one row.
ROWS, LONGEST = 1_000_000, 65536
#: Bytes of texts whose tokens are counted together, about.
SEGMENT = 16_000_000
#: Fixed value: stems that count more if they stand in the first characters of a text.
BOOSTED = ("method", "dataset", "baselin", "ablat", "limit")
BOOST, HEAD = 0.2, 300


def query_keywords(rows: DataFrame, text: str, keys: Sequence[str], most: int = 8, stopwords: Sequence[str] = QUESTION_WORDS) -> DataFrame:
    """(*keys, keywords): the different stems of each row's text in order, Latin ones before CJK runs, without stopwords (nor their stems), `most` at most.

    If nothing else is left, the stopwords count. Rows have distinct keys; null texts and texts without a token have no keywords.
    """
    drop = sorted({*stopwords, *(w for w in stems(rows.sparkSession, stopwords))})
    found = _in_order(stemmed(rows.withColumn("_t", keyword_tokens(F.col(text))), "_t", *keys), keys)
    words = found.groupBy(*keys, "stem").agg(F.min("at").alias("at")).withColumn("kept", F.col("stem").isNotNull() & ~F.col("stem").isin(drop))
    any_kept = F.max("kept").over(Window.partitionBy(*keys))
    words = words.withColumn("_use", F.col("kept") | ~any_kept)
    words = words.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_use"), "at"))).filter(F.col("_r") <= most)
    listed = F.array_sort(F.collect_list(F.when(F.col("_use") & F.col("stem").isNotNull(), F.struct("at", "stem"))))
    return words.groupBy(*keys).agg(F.transform(listed, lambda x: x["stem"]).alias("keywords"))


def keyword_counts(rows: DataFrame, text: str, group: str, order: Sequence[str], most: int = 12) -> DataFrame:
    """(group, token, n, place): the most frequent stems of all texts of a group, equal ones as they first occur, `most` at most."""
    found = _in_order(stemmed(rows.withColumn("_t", keyword_tokens(F.col(text))), "_t", group, *order), (group, *order)).filter("stem is not null")
    counts = found.groupBy(group, F.col("stem").alias("token")).agg(F.count("*").alias("n"), F.min(F.struct(*order, "at")).alias("first"))
    return ranked(counts, [group], F.desc("n"), F.asc("first"), n=most, name="place").select(group, "token", "n", "place")


def _in_order(tokens: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(*keys, stem, at): at orders the tokens of a text, those of CJK signs last."""
    return tokens.select(*keys, "stem", F.struct(F.coalesce(F.col("token").rlike(f"^[{CJK}]"), F.lit(False)).alias("cjk"), "pos").alias("at"))


def bucket(stem: Column) -> Column:
    return F.pmod(F.xxhash64(stem), F.lit(BUCKETS)).cast("int")


def stemmed(rows: DataFrame, tokens: str, *keep: str) -> DataFrame:
    """(*keep, pos, token, stem): a row per token, and one with a null token for rows without any."""
    return with_stem(rows.select(*keep, F.posexplode_outer(tokens).alias("pos", "token")))


def counted(docs: DataFrame, key: str, text: str, boosted: Sequence[str] = BOOSTED) -> DataFrame:
    """(token, stem, segment, n_docs, n_tokens, keys, numbers): a row per token and some documents that lie together, a segment, with those that have it.

    `numbers` packs (length, marks, tf) of each key: the length is the number of tokens; marks has a bit for each boosted stem that
    stands in the first characters. A row with an empty token has the numbers of documents and tokens of a segment instead. Null
    texts are empty. Nothing is shuffled.
    """
    head = F.lower(F.substring(text, 1, HEAD))
    marks = F.lit(0)
    for i, t in enumerate(boosted):
        marks = marks + F.when(head.contains(t), 1 << i).otherwise(0)
    rows = docs.select(F.col(key).alias("key"), F.concat(F.coalesce(F.lower(text), F.lit("")), F.lit("\n")).alias("text"), F.coalesce(marks, F.lit(0)).alias("marks"))
    kind = dict(rows.dtypes)["key"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in segments(batch):
                yield _counted(part)

    found = rows.mapInArrow(each, f"token string, segment long, n_docs long, n_tokens long, keys array<{kind}>, numbers binary")
    return found.withColumn("stem", stem_of(F.col("token")))


def segments(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about SEGMENT bytes of text, a longer text alone."""
    ends, at = np.cumsum(pc.binary_length(batch.column("text")).to_numpy()), 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SEGMENT, side="right")))
        yield batch.slice(at, to - at)
        at = to


def _counted(part: pa.RecordBatch) -> pa.RecordBatch:
    words, word, text = keyword_places(part.column("text"))
    docs = part.num_rows
    pair, tf = np.unique(word * docs + text, return_counts=True)
    word, place = pair // docs, pair % docs
    length = np.bincount(text, minlength=docs)
    cut = np.append(np.flatnonzero(np.diff(word, prepend=-1)), len(word))
    numbers = np.stack([length[place], part.column("marks").to_numpy()[place], tf], axis=1).astype(np.int32)
    cut = np.append(0, cut)  # the first row has no documents of its own
    token = pa.concat_arrays([pa.array([""]), words.take(pa.array(word[cut[1:-1]]))])
    n = len(token)
    of_first = np.arange(n) == 0
    return pa.RecordBatch.from_arrays(
        [
            token,
            pa.array(np.full(n, zlib.crc32(str(part.column("key")[0]).encode()))),
            pa.array(np.where(of_first, docs, 0)),
            pa.array(np.where(of_first, len(text), 0)),
            pa.ListArray.from_arrays(pa.array(cut, pa.int32()), part.column("key").take(pa.array(place))),
            pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((cut * 12).astype(np.int32)), pa.py_buffer(numbers)]),
        ],
        names=["token", "segment", "n_docs", "n_tokens", "keys", "numbers"],
    )


def batch_counts(rows: DataFrame, key: str, token: str) -> DataFrame:
    """`rows` with `tf`: those of a batch that have the same key and token as one, with their number. Nothing is shuffled.

    A key's rows lie together, so they are in one batch or two, and sums over a key and token are right; the other columns follow from these two.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            who, what = (batch.column(c).dictionary_encode(null_encoding="encode") for c in (key, token))
            pair = who.indices.to_numpy().astype(np.int64) * len(what.dictionary) + what.indices.to_numpy()
            _, first, n = np.unique(pair, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([*batch.take(pa.array(first)).columns, pa.array(n)], names=[*batch.schema.names, "tf"])

    return rows.mapInArrow(each, StructType([*rows.schema, StructField("tf", LongType())]))


def postings(counts: DataFrame, average: float, boosted: Sequence[str] = BOOSTED, parts: int = 1, tasks: int | None = None) -> DataFrame:
    """(bucket, stem, band, df, cf, best, early, keys, lengths, earlies, tfs) of what `counted` gives: tokens of one stem put together.

    Rows are dealt once, by bucket and a part of the segments, so that a stem that every document has lies in `parts` tasks. There they are
    sorted by stem and put together as they pass.
    """
    bit = F.coalesce(*[F.when(F.col("stem") == t, F.lit(1 << i)) for i, t in enumerate(boosted)], F.lit(0))
    rows = counts.select("stem", bucket(F.col("stem")).alias("bucket"), F.pmod(F.xxhash64("segment"), F.lit(parts)).cast("int").alias("part"), bit.alias("bit"), "keys", "numbers")
    dealt = rows.repartition("bucket", "part") if tasks is None else rows.repartition(tasks, "bucket", "part")
    kind = dict(rows.dtypes)["keys"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole(batches, "part", "stem"):
            yield _together(batch, average)

    return dealt.sortWithinPartitions("bucket", "part", "stem").mapInArrow(each, f"bucket int, stem string, band int, df long, cf long, best double, early boolean, keys {kind}, lengths array<int>, earlies array<boolean>, tfs array<int>")


def _together(rows: pa.RecordBatch, average: float) -> pa.RecordBatch:
    """Sorted rows of whole stems as a row per stem and band, LONGEST postings at most."""
    column = dict(zip(rows.schema.names, rows.columns, strict=True))
    first, bit = starts(rows, "part", "stem"), column["bit"].to_numpy()
    sizes = pc.list_value_length(column["keys"]).to_numpy()
    of, at = np.repeat(np.cumsum(first) - 1, sizes), np.flatnonzero(first)
    keys, length, marks, tf = pc.list_flatten(column["keys"]), *_unpacked(column["numbers"]).T
    key, early = pc.rank(keys, tiebreaker="dense").to_numpy().astype(np.int64), (marks & np.repeat(bit, sizes)) > 0
    # tokens of one stem in a document become one posting
    order = np.lexsort((length, key, of))
    of, key, length, early = of[order], key[order], length[order], early[order]
    one = np.flatnonzero((np.diff(of, prepend=-1) != 0) | (np.diff(key, prepend=-1) != 0) | (np.diff(length, prepend=-1) != 0))
    tf, early = np.add.reduceat(tf[order].astype(np.int64), one), np.logical_or.reduceat(early, one)
    of, length, place = of[one], length[one], order[one]
    strength = impact(tf, np.maximum(length, 1), max(average, 1.0))
    band = np.minimum(np.floor(strength / ((K1 + 1) / BANDS)), BANDS - 1).astype(np.int64)
    block = of * BANDS + (BANDS - 1 - band)
    order = np.argsort(block, kind="stable")
    block, length, early, tf, strength, place = block[order], length[order], early[order], tf[order], strength[order], place[order]
    cut = np.flatnonzero(np.diff(block, prepend=-1))
    nth = np.arange(len(block)) - np.repeat(cut, np.diff(np.append(cut, len(block))))
    cut = np.flatnonzero(nth % LONGEST == 0)
    of, ends = block[cut] // BANDS, pa.array(np.append(cut, len(block)), pa.int32())
    listed = (keys.take(pa.array(place)), pa.array(length, pa.int32()), pa.array(early), pa.array(tf, pa.int32()))
    summed = (np.diff(np.append(cut, len(block))), np.add.reduceat(tf, cut), np.maximum.reduceat(strength, cut), np.logical_or.reduceat(early, cut))
    whose = pa.array(at[of])
    return pa.RecordBatch.from_arrays(
        [column["bucket"].take(whose), column["stem"].take(whose), pa.array(BANDS - 1 - block[cut] % BANDS, pa.int32()), *map(pa.array, summed), *(pa.ListArray.from_arrays(ends, x) for x in listed)],
        names=["bucket", "stem", "band", "df", "cf", "best", "early", "keys", "lengths", "earlies", "tfs"],
    )


def _unpacked(numbers: pa.BinaryArray) -> np.ndarray:
    """Triples of packed numbers, a row each."""
    at = np.frombuffer(numbers.buffers()[1], np.int32)[numbers.offset : numbers.offset + len(numbers) + 1]
    return np.frombuffer(numbers.buffers()[2] or b"", np.int32)[at[0] // 4 : at[-1] // 4].reshape(-1, 3)


def impact(tf: Column | np.ndarray, length: Column | np.ndarray, average: Column | float) -> Column | np.ndarray:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))


class KeywordIndex:
    """The active build of an index."""

    def __init__(self, spark: SparkSession, state: dict):
        self.spark, self.state = spark, state
        self.n_docs, self.average = state["n_docs"], state["average"]

    def dictionary(self) -> DataFrame:
        """(stem, band, df, cf, best, early): postings of a stem in a band, its occurrences there, the greatest impact, whether any is early."""
        return self.spark.read.schema("stem string, band int, df long, cf long, best double, early boolean, bucket int").parquet(f"{self.state['folder']}/dictionary")

    def blocks(self) -> DataFrame:
        """(stem, band, df, cf, best, early, keys, lengths, earlies, tfs, bucket): postings of a stem and band as lists, in one row or more."""
        lists = f"keys array<{self.state['key_type']}>, lengths array<int>, earlies array<boolean>, tfs array<int>"
        return self.spark.read.schema(f"stem string, band int, df long, cf long, best double, early boolean, {lists}, bucket int").parquet(f"{self.state['folder']}/postings")

    def postings(self) -> DataFrame:
        """(stem, key, length, early, tf, band, bucket), sorted by stem and band from above within a bucket."""
        rows = self.blocks().select("stem", "band", "bucket", F.inline(F.arrays_zip("keys", "lengths", "earlies", "tfs")).alias("key", "length", "early", "tf"))
        return rows.select("stem", "key", F.col("length").cast("long").alias("length"), "early", F.col("tf").cast("long").alias("tf"), "band", "bucket")

    def _asked(self, terms: DataFrame, n: int | None = None) -> list[tuple]:
        """(query_id, stem, bucket, qtf, idf, least_band) of the terms of a stated set of queries that any document has.

        The least band is 0, or with `n` the least that a document of the query's best n may have a posting in. All of it
        follows from the dictionary's rows of these stems, BANDS each at most.
        """
        rows = terms.select("query_id", "token").filter("token is not null").collect()
        counts = Counter(zip([r["query_id"] for r in rows], stems(self.spark, [r["token"] for r in rows]), strict=True))
        names = sorted({s for _, s in counts if s})
        place = dict(self.spark.createDataFrame([(s,) for s in names], "stem string").select("stem", bucket(F.col("stem"))).collect()) if names else {}
        bands: dict[str, list] = defaultdict(list)
        for r in self.dictionary().filter(F.col("bucket").isin(sorted(set(place.values()))) & F.col("stem").isin(names)).orderBy("stem", F.desc("band")).collect() if names else ():
            bands[r["stem"]].append(r)
        df = {s: sum(r["df"] for r in of) for s, of in bands.items()}
        asked = [(q, s, place[s], qtf, math.log(1 + (self.n_docs - df[s] + 0.5) / (df[s] + 0.5))) for (q, s), qtf in sorted(counts.items()) if s in df]
        if n is None:
            return [(*a, 0) for a in asked]
        upper = {(q, s): [(r["band"], qtf * idf * r["best"] + BOOST * r["early"], r["df"]) for r in bands[s]] for q, s, _, qtf, idf in asked}
        total: dict[object, float] = defaultdict(float)
        floor: dict[object, float] = defaultdict(float)
        for q, s, _, qtf, idf in asked:
            total[q] += max(u for _, u, _ in upper[q, s])
            held = 0
            for band, _, of_band in upper[q, s]:
                # n documents at least reach the lower end of the band in which the n-th posting of a term lies
                if (held := held + of_band) >= n:
                    floor[q] = max(floor[q], qtf * idf * band * (K1 + 1) / BANDS)
                    break
        out = []
        for q, s, where, qtf, idf in asked:
            others = total[q] - max(u for _, u, _ in upper[q, s])
            # ranks compare scores of 6 places: what is less by that much may still be equal
            kept = [band for band, u, _ in upper[q, s] if u + others + 2e-6 >= floor[q]]
            if kept:
                out.append((q, s, where, qtf, idf, min(kept)))
        return out

    def _score(self, asked: list[tuple], query_id: str) -> DataFrame:
        sent = self.spark.createDataFrame(asked, f"query_id {query_id}, _q string, _b int, qtf int, idf double, least_band int")
        found = self.postings().filter(F.col("bucket").isin(sorted({a[2] for a in asked})) & F.col("stem").isin(sorted({a[1] for a in asked})) & (F.col("band") >= min((a[5] for a in asked), default=0)))
        found = found.join(F.broadcast(sent.drop("_b")), (F.col("stem") == F.col("_q")) & (F.col("band") >= F.col("least_band")))  # a row a query term
        part = F.col("qtf") * F.col("idf") * impact(F.col("tf"), F.greatest(F.col("length"), F.lit(1)), float(max(self.average, 1.0))) + F.when(F.col("early"), BOOST).otherwise(0.0)
        return found.groupBy("query_id", "key").agg(F.sum(part).alias("score"))

    def scores(self, terms: DataFrame) -> DataFrame:
        """(query_id, key, score) of all documents that hold any term of (query_id, token), a stated set of queries: only their stems' partitions are read.

        A token that occurs twice in a query counts twice; terms that no document has, and null ones, count nothing.
        """
        return self._score(self._asked(terms), dict(terms.dtypes)["query_id"])

    def best(self, terms: DataFrame, n: int) -> DataFrame:
        """(query_id, key, score, rank): the best n documents of each query, ties by key; scores are rounded to 6 places, as ranks compare them.

        Bands that cannot hold one of them are not read.
        """
        scored = self._score(self._asked(terms, n), dict(terms.dtypes)["query_id"]).withColumn("score", F.round("score", 6))
        return ranked(scored, ["query_id"], F.desc("score"), F.asc("key"), n=n)


def build(docs: DataFrame, log: Log, key: str = "doc_id", text: str = "text", boosted: Sequence[str] = BOOSTED) -> KeywordIndex:
    """Writes and publishes the index of a table of documents, whose keys are distinct. An empty table has an empty index."""
    spark, kind = docs.sparkSession, dict(docs.dtypes)[key]

    def write(folder: str) -> dict:
        counted(docs, key, text, boosted).write.parquet(f"{folder}/counted")
        counts = spark.read.parquet(f"{folder}/counted")
        sizes = counts.agg(F.sum("n_docs"), F.sum("n_tokens"), F.sum(F.size("keys").cast("long"))).first()
        n_docs, tokens, pairs = (int(n or 0) for n in sizes)
        average = tokens / n_docs if n_docs else 0.0
        parts = max(1, -(-pairs // (BUCKETS * ROWS)))
        postings(counts.filter("token <> ''"), average, boosted, parts, 4 * BUCKETS * parts if pairs > ROWS else None).write.partitionBy("bucket").parquet(f"{folder}/postings")
        known = KeywordIndex(spark, {"folder": folder, "key_type": kind, "n_docs": n_docs, "average": average}).blocks().repartition("bucket")
        known = known.groupBy("bucket", "stem", "band").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"), F.max("best").alias("best"), F.max("early").alias("early"))
        known.sortWithinPartitions("bucket", "stem", F.desc("band")).write.partitionBy("bucket").parquet(f"{folder}/dictionary")
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/counted")
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        return {"n_docs": n_docs, "average": average, "tokens": tokens, "boosted": list(boosted), "key_type": kind}

    def check(folder: str, state: dict) -> str | None:
        known = spark.read.parquet(f"{folder}/dictionary").agg(F.sum("df").alias("n"), F.sum("cf").alias("tokens")).first() if state["n_docs"] else None
        held = spark.read.parquet(f"{folder}/postings").agg(F.sum(F.size("tfs").cast("long"))).first()[0] if known and known["n"] else 0
        if known and known["n"] and (known["n"] != held or known["tokens"] != state["tokens"]):
            return f"{held} postings and {known['tokens']} tokens, not {known['n']} and {state['tokens']}"
        return None

    return KeywordIndex(spark, log.publish(write, LAYOUT, check))


def opened(spark: SparkSession, log: Log) -> KeywordIndex | None:
    """The active index; None if nothing is published, an error if its layout is another one."""
    state = log.active(LAYOUT)
    return KeywordIndex(spark, state) if state else None
