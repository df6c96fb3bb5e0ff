"""Licence scans: fuzzy search for short notices.

A text is read as its words, one space apart. A notice that may differ in k places is split into k + 1 pieces: of any
text within k edits of it, at least one piece stands as it is. An automaton over the pieces of all notices finds
these seeds in one pass; each says where the notice would begin, and there a bounded-error expression decides, finds
the nearest reading and counts its edits. What lies between is never looked at.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Sequence
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholarlake.llm.common import batch_slices, map_arrow, texts_of

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Bytes that are part of no word become spaces; all bytes of other letters than ASCII's are kept.
_SPACED = bytes(b if b > 127 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


@dataclass(frozen=True)
class Notice:
    """Words in lower case, one space apart. Up to `errors` characters differ, none of the first `exact` ones. A notice that is `base` also has all its exact places listed."""

    label: str
    text: str
    errors: int
    exact: int = 0
    base: bool = False

    def pieces(self) -> list[tuple[int, str]]:
        """(offset, piece): errors + 1 pieces of about the same length."""
        cuts = [i * len(self.text) // (self.errors + 1) for i in range(self.errors + 2)]
        return [(a, self.text[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


#: Names of licences, and how the notices that they ask for begin, from the licences themselves.
NOTICES = (
    Notice("mit", "mit license", 1, exact=3, base=True),
    Notice("apache", "apache license", 1, base=True),
    Notice("gpl", "general public license", 2, base=True),
    Notice("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", 6),
    Notice("apache", "you may not use this file except in compliance with the license", 5),
    Notice("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu", 6),
    Notice("lgpl", "lesser general public license", 2),
    Notice("agpl", "affero general public license", 2),
    Notice("bsd", "bsd license", 1, exact=3),
    Notice("bsd", "redistribution and use in source and binary forms with or without modification are permitted", 6),
    Notice("mpl", "mozilla public license", 2),
    Notice("epl", "eclipse public license", 2),
    Notice("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee", 6),
    Notice("cc", "creative commons attribution", 2),
    Notice("cc", "licensed under cc by", 1),
    Notice("unlicense", "this is free and unencumbered software released into the public domain", 5),
)


class Searcher:
    """The automaton and the expressions of some notices."""

    def __init__(self, notices: Sequence[Notice]):
        self.notices = tuple(notices)
        seeds: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for i, n in enumerate(self.notices):
            if not n.exact <= len(n.text) or n.errors >= len(n.text):
                raise ValueError(f"{n} allows more errors than it has characters")
            for offset, piece in n.pieces():
                seeds[piece].append((i, offset + len(piece) - 1))
        self.seeds = ahocorasick.Automaton()
        for piece, where in seeds.items():
            self.seeds.add_word(piece, where)
        self.seeds.make_automaton()
        self.near = [regex.compile(rf"(?b)(?<=\ ){regex.escape(n.text[: n.exact])}(?:{regex.escape(n.text[n.exact :])}){{e<={n.errors}}}(?=\ )") for n in self.notices]
        self._verify = lru_cache(1 << 14)(self._nearest)  # windows are as short as notices, and repeat where texts do

    def _nearest(self, i: int, window: str) -> tuple[int, int, int] | None:
        m = self.near[i].search(window)
        return (m.start(), m.end(), sum(m.fuzzy_counts)) if m else None

    def find(self, spaced: str) -> list[tuple[int, int, int, int]]:
        """(start, end, notice, errors) in a text of words with a space before, between and after them, in order.

        All exact places of each notice, and of places that overlap one another only the nearest.
        """
        begins: dict[int, set[int]] = defaultdict(set)
        for end, where in self.seeds.iter(spaced):
            for i, last in where:
                begins[i].add(end - last)
        out = []
        for i, places in begins.items():
            n = self.notices[i]
            found = []
            group: list[int] = []
            for at in [*sorted(places), None]:
                if group and (at is None or at - group[0] > 2 * n.errors):
                    found += self._places(spaced, i, group)
                    group = []
                group.append(at)
            kept: list[tuple[int, int, int, int]] = []
            for f in sorted(found):
                if kept and f[0] < kept[-1][1]:  # of two that overlap the nearer one, the first of equal ones
                    if f[3] < kept[-1][3]:
                        kept[-1] = f
                else:
                    kept.append(f)
            out += kept
        return sorted(out)

    def _places(self, spaced: str, i: int, begins: list[int]) -> list[tuple[int, int, int, int]]:
        n = self.notices[i]
        size = len(n.text)
        exact = [at for at in begins if at > 0 and spaced[at - 1] == " " and spaced.startswith(n.text + " ", at)]
        if exact:
            return [(at, at + size, i, 0) for at in exact]
        low, high = max(begins[0] - n.errors - 1, 0), min(begins[-1] + size + n.errors + 1, len(spaced))
        m = self._verify(i, spaced[low:high])
        return [(low + m[0], low + m[1], i, m[2])] if m else []


@lru_cache(4)
def searcher(notices: tuple[Notice, ...]) -> Searcher:
    return Searcher(notices)


def spaced_words(text: str) -> tuple[str, int]:
    """A text as its words in lower case (only A-Z is changed) with a space before, between and after them, and their number."""
    words = text.encode("utf-8", "surrogatepass").lower().translate(_SPACED).split()
    return " " + b" ".join(words).decode("utf-8", "surrogatepass") + " " if words else " ", len(words)


def places(text: str, search: Searcher) -> tuple[int, list[dict]]:
    """The number of words of a text, and what is found in it: notice, word (from 0), start and end in code points of the text, errors."""
    spaced, n_words = spaced_words(text)
    found = search.find(spaced)
    if not found:
        return n_words, []
    at = [(m.start(), m.end()) for m in WORD.finditer(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))]
    out, seen, word = [], 0, -1
    for start, end, i, errors in found:
        word += spaced.count(" ", seen, start)
        seen = start
        last = word + spaced.count(" ", start, end)
        out.append({"notice": i, "word": word, "start": at[word][0], "end": at[last][1], "errors": errors})
    return n_words, out


FOUND = "array<struct<notice:int,word:long,start:long,end:long,errors:int>>"


def scan(docs: DataFrame, notices: Sequence[Notice] = NOTICES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, found): the notices in every whole text, in order, `found` being FOUND.

    A place counts if it begins and ends with words and is within the notice's edits; of overlapping places of one
    notice the nearest. Null and empty texts have none; repeated rows come out each; other columns are not carried.
    """
    notices = tuple(notices)
    one = pa.struct([("notice", pa.int32()), ("word", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("errors", pa.int32())])

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        search, words, found = searcher(notices), [], []
        for part in batch_slices(batch, 1):
            for t in texts_of(part):
                n, f = places(t, search)
                words.append(n)
                found.append(f)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), pa.array(found, pa.list_(one))], names=["k", "n_words", "found"])

    rows = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("text"))
    return map_arrow(rows, each, f"k {dict(docs.dtypes)[key]}, n_words long, found {FOUND}").withColumnRenamed("k", key)


def digest(found: DataFrame, notices: Sequence[Notice] = NOTICES, key: str = "doc_id") -> DataFrame:
    """Of what `scan` gives: key, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    The score is the greatest likeness to a notice, 1 less the share of its characters that differ; 0 where none is found.
    """
    of = lambda values, x: F.get(F.array(*map(F.lit, values)), x["notice"])
    base = F.filter("found", lambda x: of([n.base for n in notices], x) & (x["errors"] == 0))
    said = lambda xs: F.array_join(F.array_sort(F.array_distinct(F.transform(xs, lambda x: of([n.label for n in notices], x)))), ",")
    likeness = F.transform("found", lambda x: 1 - x["errors"] / of([float(len(n.text)) for n in notices], x))
    span = lambda x: F.concat_ws(":", of([n.label for n in notices], x), x["start"].cast("string"), x["end"].cast("string"), x["errors"].cast("string"))
    rows = found.withColumn("_base", base)
    return rows.select(
        key,
        "n_words",
        F.size("_base").cast("long").alias("n_base"),
        F.array_min(F.transform("_base", lambda x: x["word"])).alias("first_word"),
        F.array_max(F.transform("_base", lambda x: x["word"])).alias("last_word"),
        said(F.col("_base")).alias("base_labels"),
        said(F.col("found")).alias("labels"),
        F.coalesce(F.array_max(likeness), F.lit(0.0)).alias("score"),
        F.array_join(F.transform("found", span), ",").alias("spans"),
    )
