"""Quality rules by tokeniser fertility, with the usual counts of words, symbols and repetition.

A public vocabulary reads every text, and says how many characters a token has, which share of the tokens are bytes
without a piece of their own, and how varied the tokens of a stretch are. What is usual differs by language and
script, so each pair of them has its bands: they lie around the median of all its different texts, as wide as the
texts between the median and the ninth decile are spread, and a text outside them is rejected. Junk lowers the entropy and
seldom raises it, so the upper half tells how far clean text spreads. Where few texts of a pair are known, its bands
lean on those that are usual for the script.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholarlake.llm.common import saved, slices, texts_of, tokenizer_path
from scholarlake.llm.pieces import MODEL, pieces

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\v\f\r"
WINDOW = 8
#: Tokens of a block of the entropy: a stretch of fixed length, so that entropy does not depend on the length of the text.
BLOCK = 64


@dataclass(frozen=True)
class Band:
    """Characters per token, the greatest share of byte-fallback tokens, and the least normalised token entropy of a block."""

    fewest_chars: float
    most_chars: float
    most_bytes: float
    least_entropy: float


#: What is usual by script: the one that most letters of a text are of.
BANDS: Mapping[str, Band] = {
    "latin": Band(1.5, 7.0, 0.15, 0.70),
    "greek": Band(0.5, 5.0, 0.60, 0.60),
    "cyrillic": Band(0.7, 6.0, 0.60, 0.60),
    "semitic": Band(0.4, 5.0, 0.80, 0.55),
    "indic": Band(0.3, 4.0, 0.95, 0.50),
    "east_asian": Band(0.2, 3.0, 0.95, 0.50),
    "other": Band(0.2, 5.0, 0.95, 0.50),
}
#: First and last code points of the scripts' letters.
SCRIPTS = (("latin", 0x41, 0x24F), ("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F), ("semitic", 0x590, 0x77F), ("indic", 0x900, 0xDFF), ("east_asian", 0x1100, 0x11FF), ("latin", 0x1E00, 0x1EFF), ("greek", 0x1F00, 0x1FFF), ("east_asian", 0x3040, 0x9FFF), ("east_asian", 0xAC00, 0xD7AF))


@dataclass(frozen=True)
class Width:
    """How wide the bands are about the median, in spreads (median to ninth decile) of all different texts of a language and script."""

    entropy: float = 2.5
    chars: float = 8.0
    byte_share: float = 8.0
    #: The least spread of each, so that a corpus of texts all alike does not reject itself.
    least_entropy: float = 0.008
    least_chars: float = 0.05
    least_bytes: float = 0.01
    #: The script's band counts as this many texts.
    doubt: float = 20.0


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens", "chars_per_token", "byte_share", "token_entropy", "script", "base_failed")
SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, chars_per_token double, byte_share double, token_entropy double, script string, base_failed boolean"


def repeated_words(words: list[list[bytes]]) -> np.ndarray:
    """Of each text, the words that lie in a window of 8 that its text has twice or more."""
    lengths = np.array([len(w) for w in words], np.int64)
    out = np.zeros(len(words), np.int64)
    total = int(lengths.sum())
    if total < WINDOW:
        return out
    # windows of equal words have equal 64-bit hashes within this process
    flat = np.fromiter((hash(w) for ws in words for w in ws), np.int64, total).view(np.uint64)
    doc = np.repeat(np.arange(len(words)), lengths)
    odd, n = np.uint64(0x9E3779B97F4A7C15), total - WINDOW + 1
    h = doc[:n].astype(np.uint64) * odd
    for j in range(WINDOW):
        h = (h ^ flat[j : j + n]) * odd
        h ^= h >> np.uint64(31)
    inside = np.flatnonzero(doc[:n] == doc[WINDOW - 1 :])
    h = h[inside]
    ordered = np.sort(h)
    same = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(same):
        return out
    same = np.unique(same)
    at = np.minimum(np.searchsorted(same, h), len(same) - 1)
    twice = inside[same[at] == h]
    edge = np.zeros(total + 1, np.int64)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + WINDOW, -1)
    return np.bincount(doc[np.cumsum(edge[:-1]) > 0], minlength=len(words)).astype(np.int64)


def block_entropies(texts: list[np.ndarray]) -> np.ndarray:
    """Of each text's tokens the entropy by its greatest possible value: the mean, by length, over the blocks of at most BLOCK tokens, all about as long, that make up the whole text.

    A text of one token or none has 1.
    """
    n = np.array([len(t) for t in texts], np.int64)
    if not n.sum():
        return np.ones(len(texts))
    k = -(-n // BLOCK)
    doc = np.repeat(np.arange(len(texts)), k)
    nth = np.arange(len(doc)) - np.repeat(np.r_[0, np.cumsum(k)[:-1]], k)
    low, high = nth * n[doc] // k[doc], (nth + 1) * n[doc] // k[doc]
    start, size = low + np.r_[0, np.cumsum(n)[:-1]][doc], high - low
    # a block is a row of a matrix, filled up with -1; sorted, equal tokens are runs
    at = np.arange(BLOCK)
    inside = at < size[:, None]
    ids = np.concatenate(texts).astype(np.int32)
    rows = np.where(inside, ids[np.minimum(start[:, None] + at, len(ids) - 1)], -1)
    rows.sort(1)
    begins = np.flatnonzero(np.c_[np.ones(len(rows), bool), rows[:, 1:] != rows[:, :-1]])
    count, of = np.diff(np.r_[begins, rows.size]), begins // BLOCK
    real = rows.ravel()[begins] >= 0
    count, of = count[real], of[real]
    share = count / size[of]
    entropy = np.bincount(of, -share * np.log(share), minlength=len(size))
    value = np.divide(entropy, np.log(np.maximum(size, 2)), out=np.ones(len(size)), where=size > 1)
    total = np.bincount(doc, value * size, minlength=len(texts))
    return np.divide(total, n, out=np.ones(len(texts)), where=n > 1)


def script_of(text: str) -> str:
    """The script that most letters of a text are of; other without letters."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(code) or text.isascii():
        return "latin" if any(map(str.isalpha, text)) else "other"
    votes: dict[str, int] = {}
    for name, low, high in SCRIPTS:
        votes[name] = votes.get(name, 0) + int(((code >= low) & (code <= high)).sum())
    votes["latin"] -= sum(map(text.count, "[\\]^_`{|}~\x7f"))
    best = max(votes, key=votes.get)
    return best if votes[best] else "other"


def measure(texts: list[str], model: str = MODEL) -> list[tuple]:
    """A tuple of MEASURES for each text."""
    bpe, out = pieces(tokenizer_path(model)), []
    encoded = bpe.encode_all(texts)
    for start, end in slices(texts):
        data = [t.encode("utf-8", "replace") for t in texts[start:end]]
        words = [d.split() for d in data]
        repeats = repeated_words(words)
        ids = [bpe.ids_of(next(encoded)) for _ in data]
        entropy = block_entropies(ids)
        for k, (b, ws) in enumerate(zip(data, words, strict=True)):
            t = texts[start + k]
            lines = [x for x in b.split(b"\n") if x.strip()]
            n, n_repeat, n_tokens, f = len(ws), int(repeats[k]), len(ids[k]), bpe.first_byte
            raw = int(((ids[k] >= f) & (ids[k] < f + 256) & (ids[k] != f + 10)).sum()) / max(n_tokens, 1)
            chars = len(t) - (len(b) - len(b.translate(None, SPACES)))
            failed = n < 20 or 100 * n_repeat > 30 * n
            out.append((n, chars, len(b) - len(b.translate(None, SYMBOLS)), len(lines) - len(set(lines)), n_repeat, n_tokens, len(t) / max(n_tokens, 1), raw, float(entropy[k]) if n_tokens else 0.0, script_of(t), failed))
    return out


_TYPES = (pa.int64(),) * 6 + (pa.float64(),) * 3 + (pa.string(), pa.bool_())


def _measured(rows: DataFrame, name: str, texts: Callable[[pa.RecordBatch], list[str]]) -> DataFrame:
    """`rows`, but a column `text`, with MEASURES as a struct of this name; written, as the bands need all rows first."""
    kinds = [pa.field(m, t) for m, t in zip(MEASURES, _TYPES, strict=True)]
    names = [c for c in rows.columns if c != "text"]

    def each(batches):
        for batch in batches:
            if batch.num_rows:
                found = [pa.array(c, t) for c, t in zip(zip(*measure(texts(batch)), strict=True), _TYPES, strict=True)]
                yield pa.RecordBatch.from_arrays([*map(batch.column, names), pa.StructArray.from_arrays(found, fields=kinds)], names=[*names, name])
        pa.default_memory_pool().release_unused()

    schema = rows.select(*names, F.lit(None).cast(f"struct<{SCHEMA}>").alias(name)).schema
    return saved(rows.mapInArrow(each, schema), "quality-measured")


def bands(measured: DataFrame, width: Width = Width(), usual: Mapping[str, Band] = BANDS) -> DataFrame:
    """The bands of each language and script: (lang, script, n, fewest_chars, most_chars, most_bytes, least_entropy).

    `measured` has lang (null or not), script, base_failed, n_tokens and the three measures, of all texts. Those
    that pass the base rules count, texts of the same measures once, so many copies of one text do not move a band.
    """
    rows = measured.filter("not base_failed").select("lang", "script", "n_tokens", "chars_per_token", "byte_share", "token_entropy").distinct()
    tenths = lambda c: F.percentile_approx(c, F.array(F.lit(0.5), F.lit(0.9)), 1000).alias(c)
    found = rows.groupBy("lang", "script").agg(F.count("*").alias("n"), *[tenths(c) for c in ("chars_per_token", "byte_share", "token_entropy")])
    middle = lambda c: F.get(c, 0)
    spread = lambda c, least: F.greatest(F.get(c, 1) - F.get(c, 0), F.lit(least))

    def leaning(value: Column, field: str) -> Column:
        own = F.lit(getattr(usual["other"], field))
        for script, band in usual.items():
            own = F.when(F.col("script") == script, F.lit(getattr(band, field))).otherwise(own)
        return ((value * F.col("n") + own * width.doubt) / (F.col("n") + width.doubt)).alias(field)

    chars, raw, entropy = spread("chars_per_token", width.least_chars), spread("byte_share", width.least_bytes), spread("token_entropy", width.least_entropy)
    return found.select(
        "lang",
        "script",
        "n",
        leaning(middle("chars_per_token") - width.chars * chars, "fewest_chars"),
        leaning(middle("chars_per_token") + width.chars * chars, "most_chars"),
        leaning(middle("byte_share") + width.byte_share * raw, "most_bytes"),
        leaning(middle("token_entropy") - width.entropy * entropy, "least_entropy"),
    )


def _judged(measured: DataFrame, name: str, lang: Column, width: Width) -> DataFrame:
    """`measured` with a column _kept."""
    m = F.col(name)
    flat = measured.select(lang.alias("lang"), *[m[c].alias(c) for c in ("script", "base_failed", "n_tokens", "chars_per_token", "byte_share", "token_entropy")])
    b = saved(bands(flat, width), "quality-bands")
    b = b.select(*[F.col(c).alias(f"_b_{c}") for c in b.columns])
    rows = measured.join(b, lang.eqNullSafe(F.col("_b_lang")) & (m["script"] == F.col("_b_script")), "left")
    inside = m["chars_per_token"].between(F.col("_b_fewest_chars"), F.col("_b_most_chars")) & (m["byte_share"] <= F.col("_b_most_bytes")) & (m["token_entropy"] >= F.col("_b_least_entropy"))
    kept = ~m["base_failed"] & F.coalesce(inside, F.lit(False))
    return rows.select(*measured.columns, kept.alias("_kept"))


def assess(docs: DataFrame, width: Width = Width(), key: str = "doc_id") -> DataFrame:
    """(key, MEASURES, kept) of every whole text.

    Null and empty texts have no words and fail the base rules. A null language is one of its own; without a column
    `lang` all are null. Repeated rows are measured each; other columns are not carried. Bands are those of this table.
    """
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = _measured(docs.select(F.col(key).alias("_key"), lang.alias("lang"), "text"), "_m", texts_of)
    found = _judged(rows, "_m", F.col("lang"), width)
    return found.select(F.col("_key").alias(key), *[F.col("_m")[c].alias(c) for c in MEASURES], F.col("_kept").alias("kept"))


def keep(docs: DataFrame, width: Width = Width()) -> DataFrame:
    """The rows of `docs` that pass, with all their columns and none added: judged as by `assess`."""
    names = docs.columns
    lang = F.col("_row")["lang"].cast("string") if "lang" in names else F.lit(None).cast("string")
    rows = docs.select(F.struct(*[docs[c] for c in names]).alias("_row"))
    texts = lambda batch: [t or "" for t in batch.column("_row").field("text").to_pylist()]
    found = _judged(_measured(rows, "_m", texts), "_m", lang, width).filter("_kept")
    return found.select(*[F.col("_row").getField(c).alias(c) for c in names])
