"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

The features are densities of a lexicon, how near its words stand to the second person, capitals, punctuation and
disguised spellings. The lexicon has a public seed and the words that a bounded sample of labelled rows shows to
mark toxic texts. The labelled texts fall into folds; the features that the trees and the calibration learn from use for each fold
the lexicon of the other folds, so a text never meets words that it marked itself. Trees learn from one part of
the labelled rows, the calibration from another.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholarlake.llm.common import map_arrow, saved, texts_of

#: Common English insults; the corpus adds its own.
SEED = frozenset("idiot moron stupid pathetic worthless disgusting trash clown loser dumb ugly shut hate kill scum fool jerk filth garbage coward liar vermin".split())
SECOND = frozenset("you your yours yourself u ur du dich dir dein deine sie ihr tu te toi ton ta vous votre usted tú ti su".split())
#: The bound of the labelled rows that are learned from, and their words' least number of toxic texts.
MOST_LABELLED = 20_000
LEAST_TEXTS = 4
#: Folds of the labelled texts, by hash of the text, so that copies share one.
FOLDS = 5
FEATURES = ("hits", "hit_share", "distinct_hits", "seed_hits", "strongest", "total_weight", "nearest_you", "you_share", "capitals", "exclaims", "punctuation", "symbols", "disguised", "disguised_hits", "log_words")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LEET = str.maketrans("013457@$!|", "oieastasil")


def terms(text: str) -> list[str]:
    """The words of a text, lower case, without marks at their ends."""
    return [w.strip(".,;:!?()[]{}\"'*#%$&|<>-_").lower() for w in text.split()]


def plain(word: str) -> str:
    """A word as it reads with its disguise off: look-alike signs as letters, marks within it gone, runs of a letter as one."""
    w = re.sub(r"[^\w]|_", "", word.lower().translate(_LEET))
    return re.sub(r"(.)\1{2,}", r"\1", w)


def measure(text: str, weights: dict[str, float]) -> tuple[float, ...]:
    """A number for each of FEATURES; all 0 for a text without words."""
    raw = text.split()
    n = len(raw)
    if not n:
        return (0.0,) * len(FEATURES)
    hits, you, disguised, disguised_hits, seeds, strongest, total = [], [], 0, 0, 0, 0.0, 0.0
    for i, (word, w) in enumerate(zip(raw, terms(text), strict=True)):
        if w in SECOND:
            you.append(i)
        found = w if w in weights else ""
        if not found and not w.isalpha() and w:
            p = plain(w)
            if p != w and any(c.isalpha() for c in w):
                disguised += 1
                if p in weights:
                    found, disguised_hits = p, disguised_hits + 1
        if found:
            hits.append((i, found))
            seeds += found in SEED
            strongest, total = max(strongest, weights[found]), total + weights[found]
    near = 0.0
    if hits and you:
        j = 0
        for i, _ in hits:
            while j + 1 < len(you) and abs(you[j + 1] - i) <= abs(you[j] - i):
                j += 1
            near = max(near, 1 / (1 + abs(you[j] - i)))
    letters = sum(map(str.isalpha, text)) or 1
    upper = sum(map(str.isupper, text))
    marks = sum(text.count(c) for c in ".,;:!?")
    signs = sum(text.count(c) for c in "#*$%&|<>@")
    return (float(len(hits)), len(hits) / n, float(len({w for _, w in hits})), float(seeds), strongest, total, near, len(you) / n, upper / letters, text.count("!") / n, marks / n, signs / n, disguised / n, float(disguised_hits), math.log1p(n))


def word_counts(sample: DataFrame, folds: int = FOLDS) -> DataFrame:
    """(word, a0.., b0..): in how many toxic (a) and other (b) texts of each fold a word is, of (text, toxic, fold) rows."""

    def words(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        out: Counter = Counter()
        for t, y, f in zip(texts_of(batch), batch.column("toxic").to_pylist(), batch.column("fold").to_pylist(), strict=True):
            for w in {w for w in terms(t) if len(w) > 2 and w.isalpha()}:
                out[w, y, f] += 1
        columns = list(zip(*out, strict=True)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int32()), pa.array(list(out.values()), pa.int64())], names=["word", "toxic", "fold", "n"])

    counts = map_arrow(sample.select("text", "toxic", "fold"), words, "word string, toxic int, fold int, n long")
    of = lambda y, f: F.sum(F.when((F.col("toxic") == y) & (F.col("fold") == f), F.col("n")).otherwise(0))
    return counts.groupBy("word").agg(*[of(1, f).alias(f"a{f}") for f in range(folds)], *[of(0, f).alias(f"b{f}") for f in range(folds)])


def learn_lexicon(counts: DataFrame, totals: dict[tuple[int, int], int], but: int | None = None, folds: int = FOLDS, least_texts: int = LEAST_TEXTS, most: int = 400) -> dict[str, float]:
    """Words and their weights from `word_counts` of all folds `but` one: smoothed log odds of being in a toxic text, of `most` at most.

    `totals` has the texts by (toxic, fold). Words count once for each text, and only if they mark toxic ones
    clearly. Without texts of both kinds only the seed is known.
    """
    used = [f for f in range(folds) if f != but]
    n1, n0 = (sum(totals.get((y, f), 0) for f in used) for y in (1, 0))
    if not n1 or not n0:
        return dict.fromkeys(SEED, 1.0)
    a, b = (sum((F.col(f"{x}{f}") for f in used), F.lit(0)) for x in "ab")
    odds = F.log(((a + 0.5) / (n1 + 1)) / ((b + 0.5) / (n0 + 1)))
    # the lower end of the odds: a word of few texts has to be clearer
    sure = odds - 1.64 * F.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
    rows = counts.filter(a >= least_texts).select("word", sure.alias("odds")).filter("odds > 1.0").orderBy(F.desc("odds"), "word").limit(most).collect()
    return {**dict.fromkeys(SEED, 1.0), **{r["word"]: float(r["odds"]) for r in rows}}


def featurise(docs: DataFrame, weights: list[dict[str, float]], carry: tuple[str, ...] = ("doc_id",), fold: str | None = None) -> DataFrame:
    """(carry, FEATURES) of every whole text, by the first of the lexicons or by that of its `fold`; null texts are empty."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        folds = batch.column(fold).to_pylist() if fold else [0] * batch.num_rows
        rows = [measure(t, weights[f]) for t, f in zip(texts_of(batch), folds, strict=True)]
        return pa.RecordBatch.from_arrays([*map(batch.column, carry), *[pa.array(c, pa.float64()) for c in zip(*rows, strict=True)]], names=[*carry, *FEATURES])

    kinds = dict(docs.dtypes)
    return map_arrow(docs.select(*dict.fromkeys((*carry, "text", *([fold] if fold else [])))), each, ", ".join([*(f"`{c}` {kinds[c]}" for c in carry), *(f"{f} double" for f in FEATURES)]))


class Toxicity:
    """The fitted model: lexicon weights, trees and calibration."""

    def __init__(self, weights: dict[str, float], trees: GBTClassificationModel | None, calibration: IsotonicRegressionModel | None, rate: float):
        self.weights, self.trees, self.calibration, self.rate = weights, trees, calibration, rate

    def score(self, docs: DataFrame, key: str = "doc_id") -> DataFrame:
        """(key, score) of every whole text. A text without words has the features of none; repeated rows score alike."""
        rows = featurise(docs, [self.weights], (key,))
        if self.trees is None:
            return rows.select(key, F.lit(self.rate).alias("score"))
        rows = self.trees.transform(VectorAssembler(inputCols=list(FEATURES), outputCol="_x").transform(rows))
        rows = rows.withColumn("_p", vector_to_array("probability")[1])
        if self.calibration is None:
            return rows.select(key, F.col("_p").alias("score"))
        return self.calibration.transform(rows).select(key, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("_cal"))).alias("score"))


def crc_part(key: Column) -> Column:
    """crc32 of the key's text, mod 4."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(4))


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED, rounds: int = 20, depth: int = 3, seed: int = 5) -> Toxicity:
    """Fits on the texts of `docs` (doc_id, text) that `labels` (doc_id, toxic) marks, on `most` labels at most: those of the least hashes.

    Null labels, ids and texts are left out. A fifth of the texts, by hash, is for the calibration. With labels of
    one kind or none the score is their rate (0 without any).
    """
    chosen = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter("toxic in (0, 1) and doc_id is not null")
    chosen = saved(chosen.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id", "toxic").limit(most), "toxicity-labels")
    # `most` rows of two numbers: small enough to send to all
    rows = docs.select("doc_id", "text").filter("text is not null").join(F.broadcast(chosen), "doc_id")
    part = F.pmod(F.xxhash64("text", F.lit(seed + 1)), F.lit(2 * FOLDS)).cast("int")
    rows = saved(rows.withColumn("part", part).withColumn("fold", F.pmod("part", F.lit(FOLDS)).cast("int")), "toxicity-labelled")
    totals = {(r["toxic"], r["fold"]): r["n"] for r in rows.groupBy("toxic", "fold").agg(F.count("*").alias("n")).collect()}
    n, n1 = sum(totals.values()), sum(v for (y, _), v in totals.items() if y)
    counts = saved(word_counts(rows), "toxicity-words")
    weights = learn_lexicon(counts, totals)
    if n1 in (0, n):
        return Toxicity(weights, None, None, n1 / n if n else 0.0)
    others = [learn_lexicon(counts, totals, f) for f in range(FOLDS)]
    known = featurise(rows, others, ("toxic", "part"), "fold").withColumn("label", F.col("toxic").cast("double"))
    known = VectorAssembler(inputCols=list(FEATURES), outputCol="_x").transform(saved(known.coalesce(4), "toxicity-known")).cache()
    last = 2 * FOLDS - 2
    trees = GBTClassifier(featuresCol="_x", labelCol="label", maxIter=rounds, maxDepth=depth, minInstancesPerNode=5, stepSize=0.2, subsamplingRate=0.8, seed=seed, cacheNodeIds=False).fit(known.filter(F.col("part") < last))
    held = trees.transform(known.filter(F.col("part") >= last)).withColumn("_p", vector_to_array("probability")[1])
    calibration = None
    if held.groupBy("label").count().count() == 2:
        calibration = IsotonicRegression(featuresCol="_p", labelCol="label", predictionCol="_cal").fit(held.select("_p", "label"))
    known.unpersist()
    return Toxicity(weights, trees, calibration, n1 / n)


def crc32_of(key: int) -> int:
    """crc_part for one key, for tests."""
    return zlib.crc32(str(key).encode()) % 4
