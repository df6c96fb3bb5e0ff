"""The published keyword index: what it reads, what it skips, and who may write it."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scholarlake.functions.keywords import keyword_places
from scholarlake.functions.stem import stem_known, vocabulary
from scholarlake.functions.text import keyword_tokens
from scholarlake.operators import sparse_index as SI
from scholarlake.operators.streamed import whole
from scholarlake.sources import published as P
from tests.plain_stem import stem
from tests.shuffles import shuffled_rows


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    rnd = random.Random(8)
    words = ["report", "reports", "reported", "method", "methods", "dataset", "planned", "plans", "rare", "x1", "日本語"]
    texts = [" ".join(rnd.choices(words, weights=[9, 7, 5, 3, 3, 2, 2, 2, 1, 1, 1], k=rnd.choice([3, 20, 200]))) for _ in range(400)]
    rows = [*enumerate(texts), (900, None), (901, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return rows, SI.build(docs, P.Log(spark, str(tmp_path_factory.mktemp("index")), "words"))


def plain_scores(rows, queries):
    docs = {i: [stem(w) for w in (t or "").split()] for i, t in rows}
    average = sum(map(len, docs.values())) / len(docs)
    df = Counter(s for d in docs.values() for s in set(d))
    out = {}
    for q, asked in queries.items():
        for i, d in docs.items():
            for s, qtf in Counter(map(stem, asked)).items():
                if tf := d.count(s):
                    idf = math.log(1 + (len(docs) - df[s] + 0.5) / (df[s] + 0.5))
                    early = s in SI.BOOSTED and s in (dict(rows)[i] or "").lower()[:300]
                    out[q, i] = out.get((q, i), 0) + qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(d) / average)) + 0.2 * early
    return out


QUERIES = {1: ["reports", "rare"], 2: ["method", "methods", "datasets", "日本語"], 3: ["x1"], 4: ["nowhere"], 5: ["reporting", "planned", "rare", "x1"]}


@pytest.fixture(scope="module")
def terms(spark):
    return spark.createDataFrame([(q, t) for q, ts in QUERIES.items() for t in ts] + [(6, None)], "query_id long, token string")


def test_scores_are_those_of_the_whole_scan(built, terms):
    rows, index = built
    got = {(r.query_id, r.key): r.score for r in index.scores(terms).collect()}
    want = plain_scores(rows, QUERIES)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


@pytest.mark.parametrize("n", [1, 3, 10, 1000])
def test_best_skips_nothing_that_counts(built, terms, n):
    rows, index = built
    want = plain_scores(rows, QUERIES)
    ranked = [(q, i, k + 1) for q in QUERIES for k, (_, i) in enumerate(sorted((-round(s, 6), i) for (p, i), s in want.items() if p == q)[:n])]
    assert sorted((r.query_id, r.key, r.rank) for r in index.best(terms, n).collect()) == sorted(ranked)


def test_only_asked_partitions_and_bands_are_read(built, terms):
    _, index = built
    plan = index.best(terms.filter("query_id = 1"), 3)._jdf.queryExecution().toString()
    assert "PartitionFilters: [bucket" in plan and "GreaterThanOrEqual(band" in plan
    asked = index._asked(terms.filter("query_id = 5"), 2)
    assert max(a[5] for a in asked) > 0  # some band of some term is out of reach


def test_who_may_read_and_write(spark, built, tmp_path):
    log = P.Log(spark, str(tmp_path), "small")
    assert SI.opened(spark, log) is None
    docs = spark.createDataFrame([(1, "one two")], "doc_id long, text string")
    first = SI.build(docs, log)
    second = SI.build(docs.limit(0), log)
    assert SI.opened(spark, log).n_docs == 0 and log.versions() == [1, 2] and log.retired()[0]["folder"] == first.state["folder"]
    assert second.scores(spark.createDataFrame([(1, "one")], "query_id long, token string")).count() == 0
    with pytest.raises(P.Conflict):
        log.commit({}, 1)
    log.commit({"layout": SI.LAYOUT + 1}, 2)
    with pytest.raises(ValueError, match="layout"):
        SI.opened(spark, log)
    with pytest.raises(ValueError, match="broken"):
        log.publish(lambda folder: {}, 1, lambda folder, state: "broken")
    assert log.versions() == [1, 2, 3]


def test_fingerprint_follows_the_files(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.range(3).write.parquet(path)
    one = P.fingerprint(spark, path)
    assert one == P.fingerprint(spark, path)
    spark.range(4).write.mode("overwrite").parquet(path)
    assert one != P.fingerprint(spark, path)


def test_keywords_of_questions(spark):
    rows = spark.createDataFrame([(1, "What does the paper say of datasets, 日本語 and DATASETS in tables?"), (2, "what is the"), (3, None), (4, "a b 总结")], "id long, text string")
    got = {r.id: r.keywords for r in SI.query_keywords(rows, "text", ["id"]).collect()}
    assert got == {1: ["say", "dataset", "tabl", "日本語"], 2: ["what", "is", "the"], 3: [], 4: ["总结"]}
    counts = SI.keyword_counts(rows.withColumn("g", F.lit(7)), "text", "g", ["id"], most=3).collect()
    assert [(r.token, r.n) for r in sorted(counts, key=lambda r: r.place)] == [("what", 2), ("the", 2), ("dataset", 2)]


def test_a_build_shuffles_postings_once(spark, tmp_path):
    rnd = random.Random(5)
    texts = [" ".join(f"{c}{rnd.randrange(40)}" for c in rnd.choices(["word", "plan", "note", "rate"], k=60)) for _ in range(300)]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    index, rows = shuffled_rows(spark, lambda: SI.build(docs, P.Log(spark, str(tmp_path), "once")))
    n = sum(len(set(t.split())) for t in texts)
    assert index.postings().count() == n
    # beside them only the words and the dictionary; each of four shuffles of all postings came to n rows before
    assert rows < 2 * n


def test_stems_of_frequent_words_and_the_rest(spark, tmp_path):
    words = ["plans"] * 40 + ["planned"] * 30 + ["notes"] * 3 + ["rated", "x" * 80, None]
    rows = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "id long, token string")
    vocabulary(rows).write.parquet(str(tmp_path / "v"))
    for most in (0, 1, 2, 100):
        got = {r.id: r.stem for r in stem_known(rows, spark.read.parquet(str(tmp_path / "v")), most=most).collect()}
        assert got == {i: w and stem(w) for i, w in enumerate(words)}


def test_counts_of_a_document_cut_by_batches(spark, tmp_path):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        docs = spark.createDataFrame([(1, "plan plans note " * 9), (2, None), (3, "note")], "doc_id long, text string")
        index = SI.build(docs, P.Log(spark, str(tmp_path), "cut"))
        assert {(r.stem, r.key): (r.tf, r.length) for r in index.postings().collect()} == {("plan", 1): (18, 27), ("note", 1): (9, 27), ("note", 3): (1, 1)}
        assert (index.n_docs, index.state["tokens"]) == (3, 28)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_build_moves_words_of_many_documents_as_one_row(spark, tmp_path):
    rnd = random.Random(6)
    texts = [" ".join(rnd.choices([f"{c}{c}word{i}" for c in "abcd" for i in range(10)], k=60)) for _ in range(400)]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").coalesce(2)
    index, rows = shuffled_rows(spark, lambda: SI.build(docs, P.Log(spark, str(tmp_path), "lists")))
    n = sum(len(set(t.split())) for t in texts)
    assert index.postings().count() == n and index.blocks().count() < n / 4
    assert rows < n / 4  # a row for each posting before


def test_words_of_bytes_are_those_of_the_expression(spark):
    rnd = random.Random(7)
    odd = ["ab", "a", "-", "_", "9", "42", "x1", "1-2_3", "aaaaa", "baaaaac", "-----ab", "日本語", "日", "語語語語語", "一", "龥龥", "é", "ê", "İ", "K", " ", "\n", "\ufffd", "𝄞", "䷿䷿", "ꀀꀀ", "--a-b--", "AbC", "\x00", "ß"]
    texts = ["".join(rnd.choices(odd, k=rnd.randrange(30))) for _ in range(500)] + [None, "", "日本", "ab" * 3000, "_" * 3000 + "ab"]
    rows = spark.createDataFrame([*enumerate(texts)], "i int, text string").select("i", keyword_tokens(F.col("text")).alias("t"), F.concat(F.coalesce(F.lower("text"), F.lit("")), F.lit("\n")).alias("low")).orderBy("i").collect()
    for k in (0, 17):  # of a slice as well
        words, word, text = keyword_places(pa.array([r.low for r in rows]).slice(k))
        got = Counter((int(j) + k, words[int(w)].as_py()) for w, j in zip(word, text))
        assert got == Counter((r.i, t) for r in rows[k:] for t in r.t or ())
    assert len(got) > 1000


def test_postings_put_together_across_batches_and_rows(spark, monkeypatch):
    monkeypatch.setattr(SI, "LONGEST", 3)
    table = pa.table({"key": [f"k{i}" for i in range(40)], "text": ["plan plans " + "note " * (i % 5) + "\n" for i in range(40)], "marks": pa.array([i % 2 for i in range(40)], pa.int32())})
    counts = [SI._counted(b) for b in table.to_batches(max_chunksize=7)]
    rows = []
    for c in counts:
        of = [(stem(t), n, k, b) for t, n, k, b in zip(*(c.column(x).to_pylist() for x in ("token", "n_docs", "keys", "numbers"))) if t]
        rows += [(s, k, b) for s, _, k, b in of]
        assert c.column("n_docs")[0].as_py() == c.column("n_docs").to_numpy().sum() and c.column("token")[0].as_py() == ""
    rows.sort(key=lambda r: r[0])
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([0] * len(rows), pa.int32()), pa.array([0] * len(rows), pa.int32()), pa.array([int(r[0] == "note") for r in rows], pa.int32()), pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows], pa.binary())], names=["stem", "bucket", "part", "bit", "keys", "numbers"])
    out = [r for b in whole(iter([batch.slice(0, 9), batch.slice(9)]), "part", "stem") for r in SI._together(b, 4.0).to_pylist()]
    got = {(r["stem"], k): (n, e, t) for r in out for k, n, e, t in zip(r["keys"], r["lengths"], r["earlies"], r["tfs"])}
    want = {("plan", f"k{i}"): (2 + i % 5, False, 2) for i in range(40)} | {("note", f"k{i}"): (2 + i % 5, i % 2 == 1, i % 5) for i in range(40) if i % 5}
    assert got == want and sum(r["df"] for r in out) == len(want) and max(r["df"] for r in out) == 3
    for r in out:
        strength = SI.impact(np.array(r["tfs"]), np.array(r["lengths"]), 4.0)
        assert r["best"] == strength.max() and set((strength * SI.BANDS / 2.5).astype(int)) == {r["band"]} and r["cf"] == sum(r["tfs"]) and r["early"] == any(r["earlies"])
