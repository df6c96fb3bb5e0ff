"""Spelling variants: words one edit apart, by merging tries of what an edit leaves.

Of two words that differ by one inserted, deleted or replaced character, either the first half of the shorter one
stands in both, or its second half does. So words meet in groups of the words that share such a half, and a group that is
still large is halved again where it is free. Within a group the free parts form a trie. At each of its nodes the
largest subtree stays where it is, and the lighter ones are merged into it with one character skipped or replaced: a
word is merged at most log2(n) times. Where merged ends coincide, two words are one edit apart.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholarlake.llm.common import saved

RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of a group that one task holds at once; larger groups are halved again.
MOST = 50_000


def words(docs: DataFrame, key: str = "doc_id", text: str = "text", least_chars: int = 6, least_n: int = 5, slip: int | None = 199) -> DataFrame:
    """(word, n): runs of letters of all whole texts, A-Z as a-z, that have enough characters and occur often enough.

    Where `slip` divides the crc32 of `<key>:<run>`, the run loses the character at that number modulo its length; None
    leaves all runs as they are. Null texts have no runs, a null key is written as nothing, repeated rows count each.
    """
    run = F.explode(F.regexp_extract_all(F.translate(F.col(text), UPPER, LOWER), F.lit(RUN), F.lit(0)))
    rows = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("k"), run.alias("word")) if slip else docs.select(run.alias("word"))
    if slip:
        # a run of a document has the same hash each time, so it is counted before it is hashed and shuffled
        h = F.crc32(F.concat("k", F.lit(":"), "word").cast("binary"))
        at = F.pmod(h, F.length("word")).cast("int")
        cut = F.concat(F.substring(F.col("word"), F.lit(1), at), F.substring(F.col("word"), at + 2, F.length("word")))
        rows = rows.select(F.when(F.pmod(h, F.lit(slip)) == 0, cut).otherwise(F.col("word")).alias("word"))
    return rows.filter(F.length("word") >= least_chars).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_n)


def _members(rows: DataFrame) -> DataFrame:
    """Words in the two halves of each class: a class is the length of the shorter word of a pair, so a word is in that of its own length and in the one below.

    A row has its class and how many characters at its beginning and end are shared: those are the group's key.
    """
    sizes = F.explode(F.array(F.length("word"), F.length("word") - 1))
    rows = rows.select("word", "n", sizes.alias("size")).filter("size >= 1")
    return _halved(rows.withColumns({"before": F.lit(0), "after": F.lit(0)}))


def _halved(rows: DataFrame) -> DataFrame:
    """Each row twice: with the first half of what is free shared too, and with the second."""
    free = F.col("size") - F.col("before") - F.col("after")
    half = F.floor(free / 2).cast("int")
    sides = F.array(F.struct((F.col("before") + half).alias("before"), F.col("after")), F.struct(F.col("before"), (F.col("after") + free - half).alias("after")))
    return rows.select("word", "n", "size", F.explode(sides).alias("s")).select("word", "n", "size", "s.before", "s.after")


def _keyed(rows: DataFrame) -> DataFrame:
    head = F.substring(F.col("word"), F.lit(1), F.col("before"))
    tail = F.substring(F.col("word"), F.length("word") - F.col("after") + 1, F.col("after"))
    return rows.withColumn("group", F.xxhash64("size", "before", head, "after", tail))


def groups(vocabulary: DataFrame, most: int = MOST) -> DataFrame:
    """(group, word, n, size, before, after): words in groups such that all pairs one edit apart share a group, none of over `most` words.

    Groups are counted; of those that are too large the words are dealt anew by one more half. With two free characters
    or fewer a group has as many words as an alphabet's square at most, and stays. A group is known by a hash: groups that
    share one are told apart where they are read.
    """
    rows = _keyed(_members(vocabulary))
    done = None
    while True:
        rows = saved(rows, "variant-groups")
        hot = rows.groupBy("group").agg(F.count("*").alias("_n"), F.max(F.col("size") - F.col("before") - F.col("after")).alias("_free")).filter((F.col("_n") > most) & (F.col("_free") > 2))
        hot = saved(hot.select(F.col("group").alias("_g")), "variant-large")
        if hot.isEmpty():
            return rows if done is None else done.unionByName(rows)
        small = rows.join(hot, F.col("group") == F.col("_g"), "left_anti")
        done = small if done is None else done.unionByName(small)
        large = rows.join(hot, F.col("group") == F.col("_g"), "left_semi")
        rows = _keyed(_halved(large.filter(F.col("size") - F.col("before") - F.col("after") > 2)))


def _shared(a: str, b: str) -> int:
    """Characters at the beginning that two strings share."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def nodes(ordered: list[str]) -> Iterator[tuple[int, list[int]]]:
    """(depth, bounds) of each branching node of the trie of sorted strings, deepest first: its subtrees are the ranges between its bounds.

    A string that ends at a node is a subtree of its own.
    """
    open_: list[tuple[int, list[int]]] = []
    for k in range(1, len(ordered) + 1):
        depth = _shared(ordered[k - 1], ordered[k]) if k < len(ordered) else -1
        left = k - 1
        while open_ and open_[-1][0] > depth:
            at, starts = open_.pop()
            yield at, [*starts, k]
            left = starts[0]
        if depth >= 0:
            if open_ and open_[-1][0] == depth:
                open_[-1][1].append(k)
            else:
                open_.append((depth, [left, k]))


def one_edit_pairs(free: list[str]) -> set[tuple[str, str]]:
    """All pairs (a < b) of distinct strings that are one edit apart, by merging the light subtrees of their trie."""
    ordered = sorted(set(free))
    known, pairs = set(ordered), set()

    def meet(a: str, b: str) -> None:
        pairs.add((a, b) if a < b else (b, a))

    for depth, bounds in nodes(ordered):
        ranges = list(zip(bounds, bounds[1:], strict=False))
        heavy = max((r for r in ranges if len(ordered[r[0]]) > depth), key=lambda r: r[1] - r[0])
        stays = ordered[heavy[0]][depth]
        ends: dict[str, list[str]] = defaultdict(list)
        for r in ranges:
            if r == heavy:
                continue
            for i in range(*r):
                w = ordered[i]
                head, rest = w[:depth], w[depth + 1 :]
                if len(w) > depth:
                    # replaced: by the heavy subtree's character, and by that of any other light one
                    if (x := head + stays + rest) in known:
                        meet(w, x)
                    for x in ends[rest]:
                        meet(w, x)
                    ends[rest].append(w)
                    # skipped
                    if (x := head + rest) in known:
                        meet(w, x)
                # skipped in a word of the heavy subtree
                if (x := head + stays + w[depth:]) in known:
                    meet(w, x)
    return pairs


def near_pairs(grouped: DataFrame) -> DataFrame:
    """(word, near, n): of each word the words one edit away and how often they occur, each pair both ways, maybe more than once.

    A task reads its groups one after the other and holds one of them.
    """

    def pairs(rows: list[tuple]) -> list[tuple[str, str, int]]:
        of: dict[tuple, dict[str, tuple[str, int]]] = defaultdict(dict)
        for w, n, size, before, after in rows:  # groups of one hash apart
            of[size, before, after, w[:before], w[len(w) - after :]][w[before : len(w) - after]] = (w, n)
        out = []
        for (size, *_), free in of.items():
            for a, b in one_edit_pairs(list(free)) if len(free) > 1 else ():
                (x, n), (y, m) = free[a], free[b]
                if min(len(x), len(y)) == size:  # two longer words meet in the class of their own length
                    out += [(x, y, m), (y, x, n)]
        return out

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, out = None, [], []

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64())], names=["word", "near", "n"])

        for b in batches:
            for g, *row in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if g != now:
                    out += pairs(rows)
                    now, rows = g, []
                    if len(out) > 20_000:
                        yield batch()
                        out = []
                rows.append(tuple(row))
        out += pairs(rows)
        if out:
            yield batch()
        pa.default_memory_pool().release_unused()

    dealt = grouped.repartition("group").sortWithinPartitions("group").select("group", "word", "n", "size", "before", "after")
    return dealt.mapInArrow(each, "word string, near string, n long")


def variants(vocabulary: DataFrame, ratio: int = 5, most: int = MOST) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of (word, n), whose words are distinct.

    n_near is the number of words one edit away; the form is the most frequent of these (of equal ones the first by code
    points), if it occurs at least `ratio` times as often, else null; the root is where the forms lead to, the word itself if it has none. Words of one
    character have no shorter neighbour. Null words are left out; no words give no rows.
    """
    vocabulary = saved(vocabulary.filter("word is not null and word <> ''"), "variant-words")
    near = near_pairs(groups(vocabulary, most)).distinct()
    best = F.min(F.struct((-F.col("n")).alias("less"), "near"))
    near = saved(near.groupBy(F.col("word").alias("_w")).agg(F.count("*").alias("n_near"), best.alias("best")), "variant-near")
    near = near.select("_w", "n_near", F.struct(F.col("best.near").alias("near"), (-F.col("best.less")).alias("n")).alias("best"))
    rows = vocabulary.join(near, F.col("word") == F.col("_w"), "left")
    counts = F.col("best.n") >= ratio * F.col("n")
    rows = saved(rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(counts, F.col("best.near")).alias("form"), F.when(counts, F.col("best.n")).alias("form_n")), "variant-forms")
    # a form is `ratio` times as frequent as its word, so there are few steps to a root, and each round doubles them
    steps = saved(rows.filter("form is not null").select("word", F.col("form").alias("root")), "variant-roots")
    while True:
        further = steps.select(F.col("word").alias("_via"), F.col("root").alias("_far"))
        steps = saved(steps.join(further, F.col("root") == F.col("_via"), "left").select("word", F.coalesce("_far", "root").alias("root"), F.col("_far").isNotNull().alias("moved")), "variant-roots")
        if steps.filter("moved").isEmpty():
            break
        steps = steps.select("word", "root")
    steps = steps.select(F.col("word").alias("_w"), "root")
    return rows.join(steps, F.col("word") == F.col("_w"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

