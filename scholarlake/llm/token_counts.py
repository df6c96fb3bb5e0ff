"""Edit-aware token counts.

A document keeps a segment tree over its pre-tokens: leaves hold runs of pre-tokens, inner nodes the characters
and tokens below them. `grow` makes a table of trees, of each its text and the characters and tokens of its leaves. An edit
goes down the tree to the leaves that it touches, splits only these into pre-tokens again, takes some context before it,
encodes from there until a new boundary falls on an old one, and updates the sums on the way up. What the edit does not touch
is never split or encoded again, in whichever job the edit comes: `apply_edits` takes a table of trees and one of edits and
gives the table of trees after them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholarlake.llm.common import map_arrow, saved, texts_of, tokenizer_path

RANKS = "byte_bpe_50k.tiktoken"
#: Characters that a pre-token's end can depend on, and more: the longest contraction and a space's lookahead.
CONTEXT = 8
#: Pre-tokens of a leaf.
LEAF = 64
REMEMBERED = 100_000


class Known(dict):
    """Tokens of the pre-tokens met so far; the others are encoded when asked for."""

    def __init__(self, encode: Callable[[str], list[int]]):
        super().__init__()
        self.encode = encode

    def __missing__(self, pretoken: str) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        n = len(self.encode(pretoken))
        if len(pretoken) < 100:
            self[pretoken] = n
        return n


class Counter:
    """Tokens of single pre-tokens, and the split into pre-tokens."""

    def __init__(self, path: str):
        import base64

        import public_tokenizers
        import regex
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("counts", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.known = Known(self.encoding.encode_ordinary)

    def counted(self, pretokens: list[str]) -> list[tuple[str, int]]:
        return list(zip(pretokens, map(self.known.__getitem__, pretokens), strict=True))

    def split(self, text: str) -> list[str]:
        return self.pattern.findall(text)


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


class Leaves:
    """The leaves of a tree: lists of (pre-token, tokens). A stored leaf is split and counted when it is first asked for."""

    def __init__(self, c: Counter, leaves: list[list[tuple[str, int]] | tuple[str, int, int]]):
        self.c, self.leaves = c, leaves

    def __len__(self) -> int:
        return len(self.leaves)

    def __getitem__(self, i: int) -> list[tuple[str, int]]:
        leaf = self.leaves[i]
        if isinstance(leaf, tuple):
            text, start, end = leaf
            # a leaf begins and ends at boundaries of pre-tokens; what ends there was decided by what follows
            pre, at = [], start
            for m in self.c.pattern.finditer(text, start, min(end + CONTEXT, len(text))):
                if at >= end:
                    break
                pre.append(m[0])
                at = m.end()
            leaf = self.leaves[i] = self.c.counted(pre)
        return leaf

    def text(self, i: int) -> str:
        leaf = self.leaves[i]
        return leaf[0][leaf[1] : leaf[2]] if isinstance(leaf, tuple) else "".join([p for p, _ in leaf])

    def empty(self, i: int) -> bool:
        leaf = self.leaves[i]
        return leaf[1] == leaf[2] if isinstance(leaf, tuple) else not leaf


class Tree:
    """A segment tree over the pre-tokens of one text; `stored` has the characters and tokens of its leaves from an earlier job."""

    def __init__(self, text: str, c: Counter, stored: tuple[list[int], list[int]] | None = None):
        self.c, self.read = c, 0
        if stored is None:
            pairs = c.counted(c.split(text))
            leaves = [pairs[i : i + LEAF] for i in range(0, len(pairs), LEAF)] or [[]]
            sums = [(sum([len(p) for p, _ in leaf]), sum([n for _, n in leaf])) for leaf in leaves]
        else:
            sums, at, leaves = list(zip(*stored, strict=True)), 0, []
            for n, _ in sums:
                leaves.append((text, at, at + n))
                at += n
        self._plant(leaves, sums)

    def _plant(self, leaves: list, sums: list[tuple[int, int]]) -> None:
        self.leaves = Leaves(self.c, leaves)
        self.size = 1 << (len(leaves) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.size), [0] * (2 * self.size)
        for i, (chars, tokens) in enumerate(sums):
            self.chars[self.size + i], self.tokens[self.size + i] = chars, tokens
        for i in range(self.size - 1, 0, -1):
            self._sum(i)

    def sums(self) -> tuple[list[int], list[int]]:
        """The characters and tokens of the leaves, as they are stored."""
        n = len(self.leaves)
        return self.chars[self.size : self.size + n], self.tokens[self.size : self.size + n]

    def _sum(self, i: int) -> None:
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def n_chars(self) -> int:
        return self.chars[1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    def _leaf_at(self, at: int) -> tuple[int, int]:
        """The leaf that holds a character (the last one, if none does) and the characters before it."""
        i, before = 1, 0
        while i < self.size:
            i *= 2
            if at >= before + self.chars[i] and (self.chars[i + 1] or not self.chars[i]):
                before += self.chars[i]
                i += 1
        return min(i - self.size, len(self.leaves) - 1), before

    def edit(self, start: int, end: int, new: str) -> None:
        """Puts `new` in place of the characters from start to end."""
        start = min(max(start, 0), self.n_chars)
        end = min(max(end, start), self.n_chars)
        first, before = self._leaf_at(max(0, start - CONTEXT))
        # the first pre-token that the edit can change, and so the place where the split starts again
        k, at = 0, before
        while k < len(self.leaves[first]) and at + len(self.leaves[first][k][0]) <= start - CONTEXT:
            at += len(self.leaves[first][k][0])
            k += 1
        head = self.leaves[first][:k]
        # old pre-tokens from there on, read only as far as needed
        last, j = first, k
        old: list[tuple[str, int]] = []
        seen = at

        def more() -> bool:
            nonlocal last, j, seen
            while j >= len(self.leaves[last]):
                if last + 1 >= len(self.leaves):
                    return False
                last, j = last + 1, 0
            old.append(self.leaves[last][j])
            seen += len(self.leaves[last][j][0])
            j += 1
            return True

        while seen < end and more():
            pass
        shift = len(new) - (end - start)
        n_more = 4
        while True:  # try with a little context after the edit, and with twice as much if no boundary meets
            for _ in range(n_more):
                if not more():
                    break
            n_more *= 2
            ended = j >= len(self.leaves[last]) and all(map(self.leaves.empty, range(last + 1, len(self.leaves))))
            part = "".join([p for p, _ in old])
            text = part[: start - at] + new + part[end - at :]
            self.read += len(text)
            pre = self.c.split(text)
            if ended:
                fresh = pre
                break
            # old boundaries after the edit, as places in the new text
            bounds, place = {}, at
            for n, (p, _) in enumerate(old):
                if place >= end:
                    bounds[place - at + shift] = n
                place += len(p)
            place, found = 0, None
            for n, p in enumerate(pre):
                if place in bounds and place >= start - at + len(new) and len(text) - place > CONTEXT:
                    found = n, bounds[place]
                    break
                place += len(p)
            if found:
                fresh, rest = pre[: found[0]], old[found[1] :]
                # give back what was read beyond the meeting place
                self._replace(first, head + self.c.counted(fresh) + rest, last, self.leaves[last][j:])
                return
        self._replace(first, head + self.c.counted(fresh), last, self.leaves[last][j:])

    def _replace(self, first: int, content: list[tuple[str, int]], last: int, tail: list[tuple[str, int]]) -> None:
        """Leaves first to last hold `content` and then `tail`; their sums and those above change.

        Where that makes leaves of over 2 * LEAF pre-tokens there are more leaves from now on, and where it leaves none
        for some, fewer: only then are the sums above all leaves made anew.
        """
        content = content + tail
        n, want = last - first + 1, max(1, -(-len(content) // LEAF))
        if len(content) > 2 * LEAF * n or want < n:
            parts = [content[i * LEAF : (i + 1) * LEAF] for i in range(want)]
            chars, tokens = self.sums()
            chars[first : last + 1] = [sum([len(p) for p, _ in x]) for x in parts]
            tokens[first : last + 1] = [sum([k for _, k in x]) for x in parts]
            leaves = self.leaves.leaves
            leaves[first : last + 1] = parts
            self._plant(leaves, list(zip(chars, tokens, strict=True)))
            return
        share = -(-len(content) // n)
        for i in range(n):
            part = self.leaves.leaves[first + i] = content[i * share : (i + 1) * share]
            at = self.size + first + i
            self.chars[at], self.tokens[at] = sum([len(p) for p, _ in part]), sum([k for _, k in part])
        level = {(self.size + first + i) // 2 for i in range(n)}
        while level and 0 not in level:
            for i in level:
                self._sum(i)
            level = {i // 2 for i in level}

    def text(self) -> str:
        return "".join(map(self.leaves.text, range(len(self.leaves))))


Edit = tuple[int, int, str]


def usual_edits(n_chars: int) -> list[Edit]:
    """The edits that the registered query makes in every text: a word put in, a sentence cut out, a stretch put in
    other words and a line at the end, at places that follow from the length. Each counts in the text as it then is."""
    a, b, c = n_chars // 4, n_chars // 2, 3 * n_chars // 4
    return [(c, c + 12, " it's 2024,  isn't it?\n"), (b, b + 40, ""), (a, a, " inserted words"), (n_chars, n_chars, "\n  the end.")]


_TREE = "text string, leaf_chars array<int>, leaf_tokens array<int>, n_tokens long"
_TREE_TYPES = {"text": pa.string(), "leaf_chars": pa.list_(pa.int32()), "leaf_tokens": pa.list_(pa.int32()), "n_tokens": pa.int64()}


def grow(docs: DataFrame, ranks: str = RANKS, key: str = "doc_id") -> DataFrame:
    """The table of trees: (key, text, leaf_chars, leaf_tokens, n_tokens). Null texts are empty; repeated rows have a tree each."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        c, texts = counter(tokenizer_path(ranks)), texts_of(batch)
        trees = [Tree(t, c) for t in texts]
        sums = [t.sums() for t in trees]
        return _trees(batch.column(key), key, texts, sums, [t.n_tokens for t in trees])

    return map_arrow(docs.select(key, "text"), each, f"`{key}` {dict(docs.dtypes)[key]}, {_TREE}")


def _trees(keys: pa.Array, key: str, texts: list[str], sums: list[tuple[list[int], list[int]]], n: list[int]) -> pa.RecordBatch:
    columns = [texts, [s[0] for s in sums], [s[1] for s in sums], n]
    return pa.RecordBatch.from_arrays([keys, *[pa.array(x, t) for x, t in zip(columns, _TREE_TYPES.values(), strict=True)]], names=[key, *_TREE_TYPES])


def apply_edits(trees: DataFrame, edits: DataFrame, ranks: str = RANKS, key: str = "doc_id") -> DataFrame:
    """The table of trees after edits (key, seq, start, end, new), and what they read: (key, text, leaf_chars, leaf_tokens, n_tokens, read_chars).

    The edits of a key are applied in order of seq, to every tree of that key; each counts in the text as it then is, and
    places past the end are at the end. Null places are 0, null new texts are empty, and edits of a null or unknown key do nothing.
    Trees without edits come back as they are, with read_chars 0. The edits of one key are one task's.
    """
    one = F.struct("seq", F.coalesce("start", F.lit(0)).cast("long").alias("start"), F.coalesce("end", F.lit(0)).cast("long").alias("end"), F.coalesce("new", F.lit("")).alias("new"))
    grouped = edits.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.sort_array(F.collect_list(one)).alias("_edits"))
    rows = trees.join(grouped, F.col(key) == F.col("_k"), "left").select(key, *_TREE_TYPES, F.transform("_edits", lambda e: F.struct(e["start"], e["end"], e["new"])).alias("_edits"))
    return map_arrow(rows, lambda batch: _edited(batch, key, ranks, [x or () for x in batch.column("_edits").to_pylist()]), f"`{key}` {dict(trees.dtypes)[key]}, {_TREE}, read_chars long")


def _edited(batch: pa.RecordBatch, key: str, ranks: str, edits: list[Iterable[dict | Edit]]) -> pa.RecordBatch:
    c, texts, sums, n, read = counter(tokenizer_path(ranks)), [], [], [], []
    for t, chars, tokens, some in zip(texts_of(batch), batch.column("leaf_chars").to_pylist(), batch.column("leaf_tokens").to_pylist(), edits, strict=True):
        tree = Tree(t, c, (chars, tokens))
        for e in some:
            tree.edit(*(e.values() if isinstance(e, dict) else e))
        texts.append(tree.text())
        sums.append(tree.sums())
        n.append(tree.n_tokens)
        read.append(tree.read)
    out = _trees(batch.column(key), key, texts, sums, n)
    return out.append_column("read_chars", pa.array(read, pa.int64()))


def recount(docs: DataFrame, edits: Callable[[int], Iterable[Edit]] = usual_edits, ranks: str = RANKS, key: str = "doc_id") -> DataFrame:
    """Token counts before and after edits: (key, n_chars, n_tokens, edited_chars, edited_tokens, read_chars).

    `edits` gives the edits (start, end, new text) of a text by its length, applied one after another to the stored trees;
    places past the end are at the end. read_chars is what the edits had to read again. Null texts are empty; repeated rows
    are counted each; other columns are not carried.
    """
    trees = saved(grow(docs, ranks, key), "token-trees")

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        done = _edited(batch, key, ranks, [edits(len(t)) for t in texts_of(batch)])
        chars = lambda b: pa.array([sum(x) for x in b.column("leaf_chars").to_pylist()], pa.int64())
        names = ["n_chars", "n_tokens", "edited_chars", "edited_tokens", "read_chars"]
        return pa.RecordBatch.from_arrays([batch.column(key), chars(batch), batch.column("n_tokens"), chars(done), done.column("n_tokens"), done.column("read_chars")], names=[key, *names])

    return map_arrow(trees, each, f"`{key}` {dict(docs.dtypes)[key]}, n_chars long, n_tokens long, edited_chars long, edited_tokens long, read_chars long")
