"""SentencePiece encoding and decoding by vectorised merge rounds.

A text is cut where no piece of the vocabulary can reach across: before every space mark and before every
line feed. The distinct words of a batch lie in one flat symbol array. A round looks up the rank of every
adjacent pair, takes the smallest rank of each word (a segmented minimum), merges its leftmost occurrences at
once and compacts the arrays, until no word has a pair that is a piece. A round stops, within a word, after the
first merge that creates a pair of the same or a better rank: the library's queue would take that one first.
Runs of spaces are worked out from their length.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from scholarlake.llm.common import map_arrow, slices, texts_of, tokenizer_path

MARK = "▁"
MODEL = "piece_bpe_32k.model"
#: The rank of a pair that is no piece.
NONE = np.iinfo(np.int32).max
#: Words merged together: their arrays then stay in the processor's cache.
TOGETHER = 8192
#: Distinct words that a worker remembers, besides as many older ones.
REMEMBERED = 50_000


class Pieces:
    """A SentencePiece BPE model with byte fallback: vocabulary, pair ranks and the words met so far."""

    def __init__(self, path: str):
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        size = lib.get_piece_size()
        self.size = size
        self.pieces = [lib.id_to_piece(i) for i in range(size)]
        byte = [i for i in range(size) if lib.is_byte(i)]
        if len(byte) != 256:
            raise ValueError("the model has no byte fallback")
        self.first_byte = byte[0]
        plain = [i for i in range(size) if not (lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i))]
        self.id_of = {self.pieces[i]: i for i in plain}
        if any(MARK in self.pieces[i].lstrip(MARK) or (len(self.pieces[i]) > 1 and self.pieces[i][0] == MARK == self.pieces[i][1] and self.pieces[i].strip(MARK)) or "\n" in self.pieces[i] for i in plain):
            raise ValueError("pieces of this model reach across spaces or line feeds")
        scores = np.array([-lib.get_score(i) for i in range(size)])
        self.rank = np.unique(scores, return_inverse=True)[1].astype(np.int32)  # equal scores share a rank
        keys, merged = [], []
        for p, i in self.id_of.items():
            for cut in range(1, len(p)):
                a, b = self.id_of.get(p[:cut]), self.id_of.get(p[cut:])
                if a is not None and b is not None:
                    keys.append(a * size + b)
                    merged.append(i)
        #: Open addressing: a pair's key lies in its slot or in one of the next few.
        self.bits = max(8, int(np.ceil(np.log2(8 * len(keys) + 1))))
        self.keys, self.merged = np.full(2**self.bits + 64, -2, np.int64), np.full(2**self.bits + 64, -1, np.int32)
        self.probes = 1
        for key, slot, to in zip(keys, self._slot(np.array(keys, np.int64)).tolist(), merged, strict=True):
            n = 0
            while self.keys[slot + n] != -2:
                n += 1
            self.keys[slot + n], self.merged[slot + n] = key, to
            self.probes = max(self.probes, n + 1)
        self.decimal = [str(i) for i in range(size)]
        #: What each id adds to a decoded text.
        self.bytes_of = [bytes([i - self.first_byte]) if self.first_byte <= i < self.first_byte + 256 else (b" \xe2\x81\x87 " if lib.is_unknown(i) else b"" if lib.is_control(i) else p.replace(MARK, " ").encode()) for i, p in enumerate(self.pieces)]
        self.longest_run = max([len(p) for p in self.id_of if not p.strip(MARK)], default=1)
        self.runs = [self._queue(MARK * n) for n in range(self.longest_run + 1)]
        self.words: dict[str, tuple] = {}
        self.older: dict[str, tuple] = {}

    def _queue(self, word: str) -> list[int]:
        """One merge at a time, the best rank and then the leftmost first; for short runs of spaces at start-up."""
        ids = [self.id_of[c] for c in word]
        while True:
            best = min(((self.rank[m], i, m) for i in range(len(ids) - 1) if (m := self.id_of.get(self.pieces[ids[i]] + self.pieces[ids[i + 1]])) is not None), default=None)
            if best is None:
                return ids
            ids[best[1] : best[1] + 2] = [best[2]]

    def spaces(self, n: int) -> list[int]:
        """Ids of n spaces that no word takes."""
        return self.runs[self.longest_run] * (n // self.longest_run) + self.runs[n % self.longest_run]

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merged id (or -1) and rank (or NONE) of pairs of symbols; negative symbols merge with nothing."""
        key = np.where((left < 0) | (right < 0), -1, left.astype(np.int64) * self.size + right)
        slot = self._slot(key)
        to = np.full(len(key), -1, np.int32)
        open_ = np.arange(len(key))
        for n in range(self.probes):
            there = self.keys[slot[open_] + n]
            found = there == key[open_]
            to[open_[found]] = self.merged[slot[open_[found]] + n]
            open_ = open_[~found & (there != -2)]
            if not len(open_):
                break
        return to, np.where(to >= 0, self.rank[to], NONE)

    def merge(self, words: list[str]) -> list[list[int]]:
        """Ids of each word, all merged together in rounds."""
        lengths = np.array([len(w) for w in words], np.int64)
        code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        chars, inverse = np.unique(code, return_inverse=True)
        # a char outside the vocabulary is -1 - its code point: no pair has it, and its bytes follow at the end
        known = np.array([self.id_of.get(chr(c), -1 - c) for c in chars.tolist()], np.int32)
        sym, seg = known[inverse], np.repeat(np.arange(len(words), dtype=np.int32), lengths)
        done_sym, done_seg = [], []
        to, rank = np.full(len(sym), -1, np.int32), np.full(len(sym), NONE, np.int32)  # of each symbol and the next of its word

        def look(at: np.ndarray) -> None:
            """Sets the pairs that begin at these places."""
            to[at], rank[at] = -1, NONE
            at = at[at + 1 < len(sym)]
            at = at[seg[at] == seg[at + 1]]
            to[at], rank[at] = self._pairs(sym[at], sym[at + 1])

        look(np.arange(len(sym)))
        while len(sym):
            starts = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
            best = np.minimum.reduceat(rank, starts)
            least = np.repeat(best, np.diff(np.r_[starts, len(sym)]))
            live = least != NONE
            if not live.all():  # words without a pair are done
                done_sym.append(sym[~live])
                done_seg.append(seg[~live])
                sym, seg, to, rank, least = (x[live] for x in (sym, seg, to, rank, least))
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == least)
            # of touching hits i, i+1, ... (one chain) every other one merges, from the left
            chain = np.r_[0, np.flatnonzero((np.diff(hit) != 1) | (seg[hit[1:]] != seg[hit[:-1]])) + 1]
            place = np.arange(len(hit)) - np.repeat(chain, np.diff(np.r_[chain, len(hit)]))
            hit = hit[place % 2 == 0]
            new = to[hit]
            if (seg[hit[1:]] == seg[hit[:-1]]).any():  # a word with several merges keeps those up to its first stop
                before, after = np.maximum(hit - 1, 0), np.minimum(hit + 2, len(sym) - 1)
                _, left = self._pairs(np.where((hit > 0) & (seg[before] == seg[hit]), sym[before], -1), new)
                _, right = self._pairs(new, np.where((hit + 2 < len(sym)) & (seg[after] == seg[hit]), sym[after], -1))
                stop = np.minimum(left, right) <= rank[hit]
                past = np.cumsum(stop) - stop
                first = np.flatnonzero(np.r_[True, seg[hit[1:]] != seg[hit[:-1]]])
                past -= np.repeat(past[first], np.diff(np.r_[first, len(hit)]))
                hit, new = hit[past == 0], new[past == 0]
            sym[hit] = new
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            sym, seg, to, rank = sym[keep], seg[keep], to[keep], rank[keep]
            at = hit - np.arange(len(hit))
            look(at)
            look(at[at > 0] - 1)
        if not done_sym:
            return [[] for _ in words]
        sym, seg = np.concatenate(done_sym), np.concatenate(done_seg)
        order = np.argsort(seg, kind="stable")
        ids, ends = sym[order].tolist(), np.cumsum(np.bincount(seg, minlength=len(words))).tolist()
        out = [ids[a:b] for a, b in zip([0, *ends], ends)]  # noqa: B905
        if len(sym) and sym.min() < 0:
            out = [self._with_bytes(x) if min(x, default=0) < 0 else x for x in out]
        return out

    def _with_bytes(self, ids: list[int]) -> list[int]:
        flat: list[int] = []
        for i in ids:
            flat.extend([i] if i >= 0 else [self.first_byte + b for b in chr(-1 - i).encode("utf-8", "replace")])
        return flat

    def split(self, text: str) -> list[str]:
        """Words of a text. '' stands for a lone space mark; a word from a line feed on has no mark of its own."""
        if not text:
            return []
        return text.replace(MARK, " ").replace("\n", " \n").split(" ")

    def learn(self, words: set[str]) -> None:
        """Encodes the words that are not yet known. What was not met since the last half-full moment is forgotten."""
        if len(self.words) > REMEMBERED:
            self.older, self.words = self.words, {}
        fresh = words.difference(self.words)
        fresh.discard("")
        for w in fresh.intersection(self.older):
            self.words[w] = self.older[w]
        fresh = list(fresh.difference(self.older))
        todo = [w[1:] if w[0] == "\n" else MARK + w for w in fresh]
        for w, ids in zip(fresh, (ids for i in range(0, len(todo), TOGETHER) for ids in self.merge(todo[i : i + TOGETHER])), strict=True):
            found = ids
            if w[0] == "\n":
                found = [self.first_byte + 10, *found]
            self.words[w] = self.entry(found)

    def entry(self, ids: list[int]) -> tuple:
        """Number of ids, decimal ids, decoded bytes, whether the first is a bare space mark, and the ids as int32."""
        return len(ids), ",".join([self.decimal[i] for i in ids]), b"".join([self.bytes_of[i] for i in ids]), ids[:1] == [self.id_of[MARK]], array("i", ids).tobytes()

    def entries(self, words: list[str]) -> list[tuple]:
        """The entry of each word of a text, runs of space marks put in."""
        if "" not in words:
            return list(map(self.words.__getitem__, words))
        out, run = [], 0
        for w in words:
            if not w:
                run += 1
                continue
            found = self.words[w]
            if run and found[3]:  # the word left its own mark alone: it belongs to the run
                out.append(self.entry(self.spaces(run + 1) + self.ids_of([found])[1:].tolist()))
            else:
                if run:
                    out.append(self.entry(self.spaces(run)))
                out.append(found)
            run = 0
        if run:
            out.append(self.entry(self.spaces(run)))
        return out

    def encode_all(self, texts: list[str]) -> Iterator[list[tuple]]:
        """The entries of each text, a slice of texts at a time."""
        for start, end in slices(texts):
            split = [self.split(t) for t in texts[start:end]]
            self.learn(set().union(*split))
            yield from map(self.entries, split)

    @staticmethod
    def ids_of(entries: list[tuple]) -> np.ndarray:
        return np.frombuffer(b"".join([e[4] for e in entries]), np.int32)

    def encode(self, text: str) -> list[int]:
        return self.ids_of(next(self.encode_all([text]))).tolist()

    def decode(self, ids: list[int]) -> str:
        """The library's decode(ids): pieces joined, marks as spaces, the leading space dropped, bad bytes replaced one by one."""
        return self.text_of(b"".join(map(self.bytes_of.__getitem__, ids)))

    @staticmethod
    def text_of(data: bytes) -> str:
        return data.removeprefix(b" ").decode("utf-8", "replace")


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    """The model of a file, loaded once in each worker."""
    return Pieces(path)


def encode(docs: DataFrame, model: str = MODEL, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Encodes and decodes every whole text.

    Returns (key, token_ids array<int>, decoded string). Null and empty texts have no ids and decode to ''.
    Repeated rows are encoded each; other columns are not carried, so their names cannot clash.
    """

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe, ids, decoded = pieces(tokenizer_path(model)), [], []
        for e in bpe.encode_all(texts_of(batch, "_text")):
            ids.append(bpe.ids_of(e))
            decoded.append(bpe.text_of(b"".join([x[2] for x in e])))
        return pa.RecordBatch.from_arrays([batch.column("_key"), pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())], names=[key, "token_ids", "decoded"])

    kind = dict(docs.dtypes)[key]
    return map_arrow(docs.select(docs[key].alias("_key"), docs[text].alias("_text")), each, f"`{key}` {kind}, token_ids array<int>, decoded string")


def encode_digest(docs: DataFrame, model: str = MODEL, text: str = "text", key: str = "doc_id") -> DataFrame:
    """What `encode` finds, as counts and hashes: (key, n_tokens, ids_sha256, decoded_sha256), without sending the ids."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe, n, ids, decoded = pieces(tokenizer_path(model)), [], [], []
        for e in bpe.encode_all(texts_of(batch, "_text")):
            n.append(sum([x[0] for x in e]))
            ids.append(hashlib.sha256(",".join([x[1] for x in e]).encode()).hexdigest())
            data = bpe.text_of(b"".join([x[2] for x in e]))
            decoded.append(hashlib.sha256(data.encode()).hexdigest())
        return pa.RecordBatch.from_arrays([batch.column("_key"), pa.array(n, pa.int64()), pa.array(ids), pa.array(decoded)], names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = dict(docs.dtypes)[key]
    return map_arrow(docs.select(docs[key].alias("_key"), docs[text].alias("_text")), each, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
