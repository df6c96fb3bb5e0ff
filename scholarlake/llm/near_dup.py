"""Near duplicates by a chosen-path set similarity join.

A document is the set of its word shingles; equal sets are one. Each set has a sketch of minwise values. In each
of several independent trees a set walks down from the root: a node picks one coordinate of the sketch (now and
then a second one), and the set goes on to the child of its value there. Two sets of similarity s stay together
at a step with probability s, so after a few steps nodes hold little but similar sets. A walk depends only on the
set itself; one shuffle brings together the sets that end at the same node. Nodes that are still large walk on.
Within a node all sets are compared by sketch; sets that may be similar fall into the same cluster, and within a
cluster the links are decided on the full sets.

What is missed: a pair at the threshold stays together in one tree of depth 3 with probability 0.70 (at 0.85; 0.60 at
0.80), and there are as many trees as miss it all once in 1 / `miss` times, which is 14 (18). All trees share one
sketch of 128 coordinates, and sketches 4 standard deviations below the threshold are not compared further, which drops
a pair at the threshold once in 23,000 times. A node that walks on to depth 8 keeps such a pair less often: 14 trees miss
it once in 1,100 times. Pairs above the threshold are missed far less.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholarlake.llm.common import map_arrow, saved, slices, texts_of
from scholarlake.llm.components import components


#: Share of the nodes that pick two coordinates.
MORE = 0.176


@dataclass(frozen=True)
class Join:
    """Parameters of the join. A link: 100 * intersection >= `percent` * union of `words`-word shingles."""

    words: int = 5
    percent: int = 85
    #: How often all trees may miss a pair at the threshold; `trees` sets their number outright.
    miss: float = 1e-7
    trees: int | None = None
    depth: int = 3
    deepest: int = 8
    coordinates: int = 128
    #: Sketches that agree in fewer coordinates are not compared further: 4 standard deviations below the threshold.
    margin: float = 4.0
    #: A larger node walks on; at the deepest level it is compared block by block.
    node_rows: int = 1024
    #: Shingles of the sets that one task compares; a larger cluster is compared block by block.
    block_shingles: int = 4_000_000
    seed: int = 11

    @property
    def n_trees(self) -> int:
        """The trees that it takes: at each step a pair shares the one coordinate, or at MORE of the nodes either of two."""
        if self.trees is not None:
            return self.trees
        s, together = self.percent / 100, 1.0
        for _ in range(self.depth):
            together = (1 - MORE) * s * together + MORE * (1 - (1 - s * together) ** 2)
        return max(1, math.ceil(math.log(self.miss) / math.log(1 - together)))

    @property
    def least_agreeing(self) -> int:
        s = self.percent / 100
        return int(np.floor(self.coordinates * (s - self.margin * (s * (1 - s) / self.coordinates) ** 0.5)))


_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
#: Bits of the filter of documents that are worth reading again, as a power of 2: 8 a document, between half a megabyte and 8.
#: A filter that is too full lets documents through that the join then drops: at worst all sets are shuffled, 8 bytes a word.
LEAST_BITS, MOST_BITS = 22, 26


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX
    return x ^ (x >> np.uint64(29))


class Words:
    """Hashes of words, remembered."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def hashes(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > 100_000:
            known.clear()
        out = [known.get(w) for w in words]
        if None in out:
            for i, w in enumerate(words):
                if out[i] is None:
                    h = out[i] = xxhash.xxh3_64_intdigest(w)
                    if len(w) < 100:
                        known[w] = h
        return np.array(out, np.uint64)


_WORDS = Words()


def shingles(text: str, words: int = 5) -> np.ndarray:
    """The set of a text as sorted 64-bit hashes: lower case A-Z, words between white space, fewer words as one shingle."""
    ws = text.encode("utf-8", "replace").lower().split()
    if not ws:
        return np.zeros(0, np.uint64)
    h = _WORDS.hashes(ws)
    n = max(len(h) - words + 1, 1)
    out = np.full(n, len(ws) if len(ws) < words else words, np.uint64)
    for j in range(min(words, len(h))):
        out = mixed((out + h[j : j + n]) * _ODD)
    return np.unique(out)


def sketch(s: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """A minwise value for each factor, as 16 bits."""
    low = np.full(len(factors), np.iinfo(np.uint32).max, np.uint32)
    x = (s ^ (s >> np.uint64(32))).astype(np.uint32)
    for i in range(0, len(x), 4096):
        part = np.multiply.outer(factors, x[i : i + 4096])
        part ^= part >> np.uint32(15)
        part *= np.uint32(0x2C1B3C6D)
        np.minimum(low, part.min(1), out=low)
    return mixed(low.astype(np.uint64) * _ODD).astype(np.uint16)


def factors_of(j: Join) -> np.ndarray:
    return np.random.default_rng(j.seed).integers(0, 2**31, j.coordinates, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def walk(sk: np.ndarray, row: np.ndarray, path: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, paths) after so many steps down from `path`: a node's hash picks a coordinate, and at one in six nodes a second one."""
    t = sk.shape[1]
    for _ in range(steps):
        pick = mixed(path * _ODD + np.uint64(1))
        first = (pick % np.uint64(t)).astype(np.int64)
        second = (first + 1 + ((pick >> np.uint64(20)) % np.uint64(t - 1)).astype(np.int64)) % t
        more = np.flatnonzero((pick >> np.uint64(44)) % np.uint64(1000) < np.uint64(round(MORE * 1000)))
        at, r = np.r_[first, second[more]], np.r_[row, row[more]]
        p = np.r_[path, path[more]]
        path = mixed(mixed(p * _ODD + at.astype(np.uint64)) + sk[r, at].astype(np.uint64) * _ODD)
        row = r
    return row, path


def _sets(docs: DataFrame, j: Join) -> DataFrame:
    """(doc_id, text_key, n_shingles, set_key, sketch) of every row."""
    factors = factors_of(j)

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, keys, sks = [], [], []
        for t in texts_of(batch):
            s = shingles(t, j.words)
            n.append(len(s))
            keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
            sks.append(sketch(s, factors).tobytes() if len(s) else None)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(sks, pa.binary())], names=["doc_id", "text_key", "n_shingles", "set_key", "sketch"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_key(F.col("text")).alias("text_key")), each, "doc_id long, text_key long, n_shingles long, set_key binary, sketch binary")


def text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _matrix(batch: pa.RecordBatch, j: Join) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint16).reshape(-1, j.coordinates)


def _nodes(reps: DataFrame, j: Join) -> DataFrame:
    """(node, doc) of every set in every tree, for nodes of two sets and more that are small enough to compare, with (block, other) 0."""

    def down(steps: int, roots: bool):
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            sk = _matrix(batch, j)
            if roots:
                row = np.repeat(np.arange(len(sk)), j.n_trees)
                path = np.tile(mixed((np.arange(j.n_trees, dtype=np.uint64) + np.uint64(j.seed * 1000)) * _ODD), len(sk))
            else:
                row, path = np.arange(len(sk)), batch.column("node").to_numpy().view(np.uint64)
            row, path = walk(sk, row, path, steps)
            docs = batch.column("doc").to_numpy()[row]
            return pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), pa.array(docs)], names=["node", "doc"])

        return each

    def counted(rows: DataFrame) -> DataFrame:
        """`rows` with the size n of their node, from two on. Sizes are summed map-side and joined on, so Spark can split a large node."""
        rows = saved(rows, "walks")
        sizes = saved(rows.groupBy(F.col("node").alias("_node")).agg(F.count("*").alias("n")).filter("n > 1"), "node-sizes")
        return saved(rows.join(sizes, F.col("node") == F.col("_node")).select("node", "doc", "n"), "nodes")

    level = counted(map_arrow(reps.select("doc", "sketch"), down(j.depth, True), "node long, doc long"))
    found = level.filter(F.col("n") <= j.node_rows)
    large = level.filter(F.col("n") > j.node_rows)
    at = j.depth
    while at < j.deepest and not large.isEmpty():
        step = map_arrow(large.select("node", "doc").join(reps.select("doc", "sketch"), "doc"), down(1, False), "node long, doc long")
        level = counted(step)
        found = found.unionByName(level.filter(F.col("n") <= j.node_rows))
        large = level.filter(F.col("n") > j.node_rows)
        at += 1
    found = found.select("node", "doc", F.lit(0).alias("block"), F.lit(0).alias("other"))
    if at < j.deepest or large.isEmpty():
        return found
    # what is still large is compared exactly, block against block: a set goes to as many tasks as there are blocks
    blocks = F.ceil(F.col("n") / (j.node_rows // 2)).cast("int")
    own = large.withColumn("_b", blocks).withColumn("_own", F.pmod(F.xxhash64("doc"), F.col("_b")).cast("int"))
    pairs = own.select("node", "doc", F.explode(F.transform(F.sequence(F.lit(0), F.col("_b") - 1), lambda o: F.struct(F.least(o, F.col("_own")).alias("block"), F.greatest(o, F.col("_own")).alias("other")))).alias("p"))
    return found.unionByName(pairs.select("node", "doc", "p.block", "p.other"))


class Union:
    """Sets of rows joined so far."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        while (p := up.get(x, x)) != x:
            up[x] = x = up.get(p, p)
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Rows of equal keys together, from batches that are sorted by them; many small groups at once make a table."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        last = np.ones(batch.num_rows, bool)
        for c in cols:
            last &= c == c[-1]
        cut = batch.num_rows - int(np.argmin(last[::-1])) if not last.all() else 0
        if cut == 0 and kept and all(kept[-1].column(k)[-1].as_py() == batch.column(k)[0].as_py() for k in keys):
            kept.append(batch)
            continue
        if cut == 0:
            if kept:
                yield pa.Table.from_batches(kept)
            kept = [batch]
            continue
        yield pa.Table.from_batches([*kept, batch.slice(0, cut)])
        kept = [batch.slice(cut)]
    if kept:
        yield pa.Table.from_batches(kept)


def _alike(nodes: DataFrame, reps: DataFrame, j: Join) -> DataFrame:
    """(a, b): sets that may be similar by their sketches. Of those of a partition a spanning forest is enough: a row for each set at most."""
    rows = nodes.join(reps.select("doc", "sketch"), "doc").repartition("node", "block", "other").sortWithinPartitions("node", "block", "other", "doc")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Union()
        for t in _groups(batches, ["node", "block", "other"]):
            doc = t.column("doc").to_numpy()
            sk = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint16).reshape(-1, j.coordinates)
            node, block, other = (t.column(c).to_numpy() for c in ("node", "block", "other"))
            starts = np.flatnonzero(np.r_[True, (node[1:] != node[:-1]) | (block[1:] != block[:-1]) | (other[1:] != other[:-1])])
            ends = np.r_[starts[1:], len(doc)]
            size_of, start_of = np.repeat(ends - starts, ends - starts), np.repeat(starts, ends - starts)
            a, b = [], []
            for d in range(1, 16):  # small nodes: rows at distance d, all nodes at once
                i = np.flatnonzero((size_of[:-d] <= 16) & (start_of[:-d] == start_of[d:]))
                if len(i):
                    a.append(i)
                    b.append(i + d)
            out = []
            if a:
                a, b = np.concatenate(a), np.concatenate(b)
                for k in range(0, len(a), 20_000):
                    x, y = a[k : k + 20_000], b[k : k + 20_000]
                    good = (sk[x] == sk[y]).sum(1) >= j.least_agreeing
                    out += [(p, q) for p, q in zip(doc[x[good]].tolist(), doc[y[good]].tolist(), strict=True) if p != q and seen.join(p, q)]
            for s, e in zip(starts, ends, strict=True):
                if e - s > 16:
                    out += _forest(doc[s:e], sk[s:e], j, seen)
            if out:
                x, y = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["a", "b"])

    return rows.mapInArrow(each, "a long, b long")


def _forest(doc: np.ndarray, sk: np.ndarray, j: Join, seen: Union) -> list[tuple[int, int]]:
    """Links of a large node's forest: each row is compared with the later ones that are not yet joined to it."""
    out = []
    root = np.array([seen.find(d) for d in doc.tolist()])
    for i in range(len(doc) - 1):
        rest = i + 1 + np.flatnonzero(root[i + 1 :] != root[i])
        if not len(rest):
            continue
        good = rest[(sk[rest] == sk[i]).sum(1) >= j.least_agreeing]
        for r in np.unique(root[good]):
            k = good[root[good] == r][0]
            if doc[i] != doc[k] and seen.join(int(doc[i]), int(doc[k])):
                out.append((int(doc[i]), int(doc[k])))
            new = min(root[i], r)
            root[(root == r) | (root == root[i])] = new
    return out


def _linked(doc: np.ndarray, sets: list[np.ndarray], side: np.ndarray | None, percent: int) -> list[tuple[int, int]]:
    """Links, decided on the full sets, that connect all that the links of these sets connect.

    A pivot is compared with all sets of other components at once. After a few pivots from the middle, the sets
    of small components come first; when only one component is left, it is not compared within itself. `side`:
    only pairs of different sides count (two blocks of a larger cluster).
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    begin = np.r_[0, np.cumsum(sizes)[:-1]]
    label, open_, out = np.arange(n), np.ones(n, bool), []
    mark = np.zeros(int(ids.max()) + 1, bool)
    tried = 0
    while True:
        left = np.flatnonzero(open_)
        if len(left) < 2:
            return out
        names, back, count = np.unique(label[left], return_inverse=True, return_counts=True)
        if len(names) == 1:
            return out
        if tried < 8:  # early pivots: of a fresh component each, by size of set
            fresh = left[count[back] == 1]
            pool = fresh if len(fresh) else left
            i = int(pool[np.argsort(sizes[pool], kind="stable")[(tried * 5 + 3) * len(pool) // 47 % len(pool)]])
        else:
            i = int(left[np.argmin(count[back])])
        tried += 1
        open_[i] = False
        rest = left[(label[left] != label[i]) & (left != i)]
        near = (sizes[rest] * 100 >= percent * sizes[i]) & (sizes[i] * 100 >= percent * sizes[rest])
        if side is not None:
            near &= side[rest] != side[i]
        rest = rest[near]
        if not len(rest):
            continue
        mine = ids[begin[i] : begin[i] + sizes[i]]
        mark[mine] = True
        if len(rest) * 4 > n:
            both = np.add.reduceat(mark[ids], begin)[rest] if n else None
        else:
            both = np.array([np.count_nonzero(mark[ids[begin[k] : begin[k] + sizes[k]]]) for k in rest])
        mark[mine] = False
        good = rest[100 * both >= percent * (sizes[rest] + sizes[i] - both)]
        for r in np.unique(label[good]):
            k = good[label[good] == r][0]
            out.append((int(doc[i]), int(doc[k])))
            label[label == r] = label[i]


def _decided(clusters: DataFrame, docs: DataFrame, j: Join) -> DataFrame:
    """(a, b): links within clusters (node, component, doc, set_key, total), decided on the sets made anew from the texts."""
    bits = _bits(clusters.select("doc"))
    shift = np.uint64(64 - (8 * len(bits) - 1).bit_length())

    def sets(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        ids = batch.column("doc_id").to_pylist()
        slot = (mixed(np.array([d or 0 for d in ids], np.int64).astype(np.uint64) * _ODD) >> shift).astype(np.int64)
        there = bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1
        keep = [i for i, x in enumerate(there.tolist()) if x and ids[i] is not None]
        if not keep:
            return None
        texts = batch.column("text").take(pa.array(keep)).to_pylist()
        mine = [shingles(t or "", j.words) for t in texts]
        keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in mine]
        return pa.RecordBatch.from_arrays([pa.array([ids[i] for i in keep], pa.int64()), pa.array([s.tobytes() for s in mine], pa.binary()), pa.array(keys, pa.binary())], names=["_doc", "shingles", "_key"])

    made = map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), sets, "_doc long, shingles binary, _key binary")
    sized = clusters.join(made, (F.col("doc") == F.col("_doc")) & (F.col("set_key") == F.col("_key"))).select("component", "node", "shingles", "total")
    # small clusters are one block; of a larger one every pair of blocks is a group of its own
    blocks = F.ceil(F.col("total") / j.block_shingles).cast("int")
    own = sized.withColumn("_b", blocks).withColumn("_own", F.pmod(F.xxhash64("node"), F.col("_b")).cast("int"))
    pair = lambda o: F.struct(F.least(o, F.col("_own")).alias("block"), F.greatest(o, F.col("_own")).alias("other"))
    rows = own.select("component", "node", "shingles", F.col("_own").alias("own"), F.explode(F.transform(F.sequence(F.lit(0), F.col("_b") - 1), pair)).alias("p")).select("component", "node", "shingles", "own", "p.block", "p.other")
    keys = ["component", "block", "other"]
    rows = rows.repartition(*keys).sortWithinPartitions(*keys, "node")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, keys):
            c, b, o = (t.column(k).to_numpy() for k in keys)
            node, own_, raw = t.column("node").to_numpy(), t.column("own").to_numpy(), t.column("shingles").to_pylist()
            starts = np.flatnonzero(np.r_[True, (c[1:] != c[:-1]) | (b[1:] != b[:-1]) | (o[1:] != o[:-1])])
            out: list[tuple[int, int]] = []
            for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(c)], strict=True):
                if e - s > 1:
                    out += _linked(node[s:e], [np.frombuffer(x, np.uint64) for x in raw[s:e]], own_[s:e] if b[s] != o[s] else None, j.percent)
            if out:
                x, y = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["a", "b"])

    return rows.mapInArrow(each, "a long, b long")


def _bits(docs: DataFrame) -> np.ndarray:
    """A filter of document ids, packed, of bounded size: built as bitmaps by block on the executors."""
    power = min(max((8 * docs.count()).bit_length(), LEAST_BITS), MOST_BITS)

    def slots(batch: pa.RecordBatch) -> pa.RecordBatch:
        h = (mixed(batch.column("doc").to_numpy().astype(np.uint64) * _ODD) >> np.uint64(64 - power)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(h + 1)], names=["slot"])

    rows = map_arrow(docs, slots, "slot long").groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits")).collect()
    out = np.zeros(1 << (power - 3), np.uint8)
    for r in rows:  # buckets count from 1, bits from the lowest
        b = np.frombuffer(bytes(r["bits"]), np.uint8)
        at = (r["bucket"] - 1) * len(b)
        out[at : at + len(b)] |= b[: len(out) - at]
    return out


def _found(docs: DataFrame, j: Join) -> DataFrame:
    """(doc_id, text_key, n_shingles, component_id) of every row."""
    sets = saved(_sets(docs, j), "sets")
    # one representative of each set: equal sets, however many, are summed map-side
    some = sets.filter("n_shingles > 0 and doc_id is not null")
    keys = saved(some.groupBy("set_key").agg(F.min("doc_id").alias("doc"), F.count("*").alias("copies")), "set-keys")
    reps = some.join(keys.select(F.col("set_key").alias("_k"), F.col("doc").alias("_d")), (F.col("set_key") == F.col("_k")) & (F.col("doc_id") == F.col("_d"))).select(F.col("doc_id").alias("id"), "set_key", "n_shingles", "sketch").dropDuplicates(["id", "set_key"])
    # numbers of the representatives, fixed by the written table: ids would do, but texts may share one
    reps = saved(reps.withColumn("doc", F.monotonically_increasing_id()), "set-representatives")
    alike = _alike(_nodes(reps, j), reps, j).distinct()
    clusters = components(alike)
    of = clusters.join(reps.select(F.col("doc").alias("_n"), "id", "set_key", "n_shingles"), F.col("node") == F.col("_n")).select("node", "component", F.col("id").alias("doc"), "set_key", "n_shingles")
    weight = of.groupBy(F.col("component").alias("_c")).agg(F.sum("n_shingles").alias("total"))
    of = saved(of.join(weight, F.col("component") == F.col("_c")).select("node", "component", "doc", "set_key", "total"), "clusters")
    links = components(saved(_decided(of, docs, j), "near-links"))
    linked = saved(links.join(of.select(F.col("node").alias("_n"), "doc", "set_key"), F.col("node") == F.col("_n")).select("component", "doc", "set_key"), "linked-sets")
    least = linked.groupBy(F.col("component").alias("_c")).agg(F.min("doc").alias("_least"))
    linked = linked.join(least, F.col("component") == F.col("_c")).select(F.col("set_key").alias("_l"), "_least")
    # only sets that are not alone need to be looked up
    named = keys.join(linked, F.col("set_key") == F.col("_l"), "left").filter("copies > 1 or _least is not null").select(F.col("set_key").alias("_k"), F.coalesce("_least", "doc").alias("_c"))
    out = sets.select("doc_id", "text_key", "n_shingles", "set_key").join(named, F.col("set_key") == F.col("_k"), "left")
    return out.select("doc_id", "text_key", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("_c", "doc_id")).alias("component_id"))


def near_duplicates(docs: DataFrame, j: Join = Join()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of `docs` (doc_id, text).

    component_id is the smallest doc_id that links lead to, the row's own included. Texts without words (null and
    empty ones among them) have no shingles and are linked with nothing. Repeated rows and equal sets share a
    component; rows of one doc_id and different texts are each their own set, linked only as their texts are. A null
    doc_id stays null, and its row links with nothing. Other columns are not carried.
    """
    return _found(docs, j).select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, j: Join = Join()) -> DataFrame:
    """`docs` with one row of each group of near copies, all columns as they were.

    The row of the smallest doc_id stays; of several with this id and equal sets the one of the least text hash, and of
    equal ones any. Rows without shingles and rows without a doc_id stay, and so does every row whose text is
    linked with no other, whatever its id. Texts are shuffled once at most: only keys decide.
    """
    found = saved(_found(docs, j).filter("n_shingles > 0 and doc_id is not null").groupBy("component_id", "doc_id", "text_key").agg(F.count("*").alias("rows")), "near-found")
    named = lambda rows, stays: rows.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), stays.alias("_stays"))
    # rows of the smallest id: its texts are few, whatever the size of the group
    own = found.filter("doc_id = component_id")
    first = own.groupBy(F.col("doc_id").alias("_d")).agg(F.min("text_key").alias("_first"))
    own = own.join(first, F.col("doc_id") == F.col("_d"))
    stays = F.col("text_key") == F.col("_first")
    # what goes, and what stays but is there more than once
    named = saved(named(found.filter("doc_id <> component_id"), F.lit(False)).unionByName(named(own.filter(~stays | (F.col("rows") > 1)), stays)), "near-decided")
    names = docs.columns
    rows = docs.select(F.struct(*[docs[c] for c in names]).alias("_row"), docs["doc_id"].cast("long").alias("_doc"), text_key(docs["text"]).alias("_text"), F.coalesce(F.length(docs["text"]) > 0, F.lit(False)).alias("_any"))
    judged = F.col("_any") & F.col("_doc").isNotNull()
    # the decisions grow with the corpus: the join is a shuffle at every size, and rows that repeat are told apart in its partitions
    met = rows.filter(judged).join(named.hint("merge"), (F.col("_doc") == F.col("_id")) & (F.col("_text") == F.col("_key")), "left").filter("_stays is null or _stays")
    nth = F.row_number().over(Window.partitionBy("_doc", "_text").orderBy("_doc"))
    left = met.withColumn("_nth", nth).filter("_stays is null or _nth = 1").select("_row")
    return left.unionByName(rows.filter(~judged).select("_row")).select(*[F.col("_row").getField(c).alias(c) for c in names])
