"""Mixing, near duplicates, the pipeline, and all operators on odd tables."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline
from scholarlake.llm import imatch, mixing, near_dup, pieces, pii, quality, queries, secrets, token_counts, toxicity
from scholarlake.llm.common import table
from scholarlake.llm.components import components


def plain_sets(rows):
    out = {}
    for i, t in rows:
        w = (t or "").encode("utf-8", "replace").lower().split()
        out[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))) if w else frozenset()
    return out


def plain_components(rows, percent=85):
    sets, up = plain_sets(rows), {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    index = defaultdict(list)
    for i in sorted(sets):
        near = defaultdict(int)
        for s in sets[i]:
            for k in index[s]:
                near[k] += 1
            index[s].append(i)
        for k, n in near.items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[k]) - n):
                a, b = find(i), find(k)
                up[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def check_components(spark, rows, j=near_dup.Join()):  # noqa: B008
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), j).collect()}
    assert got == plain_components(rows, j.percent)


def test_near_dup_query(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").collect()]
    want = plain_components(rows)
    for r in queries.op8_near_dup(spark, sf_dir).collect():
        assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)


def copies(n, seed, words=120, swaps=3):
    rnd = random.Random(seed)
    base = [f"w{rnd.randrange(5000)}" for _ in range(words)]
    out = []
    for i in range(n):
        t = base[:]
        for _ in range(rnd.randint(0, swaps)):
            t[rnd.randrange(words)] = f"x{rnd.randrange(10**6)}"
        out.append(" ".join(t))
    return out


def test_near_dup_of_large_groups(spark):
    texts = copies(150, 1) + copies(60, 2, swaps=6) + copies(40, 3, words=12, swaps=1) + ["", None, "one", "one", "A b c", "a B c"]
    rows = list(enumerate(texts))
    check_components(spark, rows)
    check_components(spark, rows, near_dup.Join(percent=80))
    # nodes that walk on, nodes compared block by block, and clusters compared block by block
    check_components(spark, rows, near_dup.Join(node_rows=16, deepest=4, block_shingles=3000, trees=20))


def test_sketch_says_how_alike_sets_are():
    j = near_dup.Join()
    f, rnd = near_dup.factors_of(j), np.random.default_rng(1)
    both, a, b = (rnd.integers(0, 2**63, n, dtype=np.uint64) for n in (850, 75, 75))
    x, y = (near_dup.sketch(np.unique(np.r_[both, s]), f) for s in (a, b))
    assert abs((x == y).mean() - 0.85) < 0.13
    assert j.least_agreeing < 0.75 * j.coordinates


def test_one_text_of_a_group_stays(spark):
    near = " ".join(f"w{i}" for i in range(60))
    rows = [(5, "a b c d e f g h", "s"), (5, near, "s"), (2, near + " x", "s"), (5, "a b c d e f g h", "s"), (5, "A b c d e f g h", "u"), (None, near, "s"), (9, None, None), (9, "", "x"), (7, "all alone in its own words here", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, text_key string")
    got = near_dup.keep_one(docs)
    assert got.columns == docs.columns
    left = sorted((str(r.doc_id), (r.text or "").lower()) for r in got.collect())
    assert left == sorted([("2", near + " x"), ("5", "a b c d e f g h"), ("None", near), ("9", ""), ("9", ""), ("7", "all alone in its own words here")])
    assert near_dup.keep_one(docs.limit(0)).count() == 0


def test_components(spark):
    links = [(1, 2), (2, 3), (2, 3), (7, 7), (9, 8), (None, 4), (5, None)] + [(i, i + 1) for i in range(20, 60)] + [(100, i) for i in range(101, 160)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {1: 1, 2: 1, 3: 1, 7: 7, 8: 8, 9: 8} | dict.fromkeys(range(20, 61), 20) | dict.fromkeys(range(100, 160), 100)
    assert got == want and components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_trees_follow_from_the_target():
    assert near_dup.Join().n_trees == 14 and near_dup.Join(percent=80).n_trees == 18 and near_dup.Join(trees=3).n_trees == 3


# mixing


def plain_targets(sizes, weights=(5, 2, 1)):
    names = sorted((k for k in sizes if k is not None)) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), 1.5 * sum(sizes.values())
    while free:
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        free -= over
    return target


def test_mixing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = queries.op5_mixing(spark, sf_dir).collect()
    again = {(r.doc_id, r.taken) for r in queries.op5_mixing(spark, sf_dir).collect()}
    assert again == {(r.doc_id, r.taken) for r in rows}
    source = {r.doc_id: r.source for r in docs.collect()}
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in rows:
        s = source[r.doc_id]
        sizes[s] += r.size
        taken[s] += r.taken
        target[s] = r.target
        assert r.taken <= 2 * r.size and (r.size == 0 or r.taken % r.size == 0)
    want = plain_targets(sizes)
    assert all(abs(want[s] - target[s]) < 1e-6 * max(1, want[s]) for s in sizes)
    assert all(abs(taken[s] - target[s]) <= max(3, 0.02 * target[s]) for s in sizes)


def nearest_gap(lengths, counts, budget):
    sums = {0}
    for length, n in zip(lengths.tolist(), counts.tolist(), strict=True):
        sums = {s + length * k for s in sums for k in range(n + 1)}
    return min(abs(s - budget) for s in sums)


def test_fit_is_the_nearest_sum():
    rnd = random.Random(3)
    for trial in range(500):
        low, high = [(1, 40), (1, 1000), (3000, 40_000), (20_000, 200_000)][trial % 4]
        lengths = np.array(sorted(rnd.sample(range(low, high), rnd.randint(1, 7))))
        counts = np.array([rnd.randint(1, 3) for _ in lengths])
        budget = rnd.randint(0, int((lengths * counts).sum()))
        take = mixing.fit(lengths, counts, budget)
        assert (take <= counts).all() and (take >= 0).all()
        assert abs(int((take * lengths).sum()) - budget) == nearest_gap(lengths, counts, budget)
    assert mixing.fit(np.array([60_000]), np.array([1]), 59_333).tolist() == [1]
    assert mixing.fit(np.array([3000, 9000, 20_000, 30_000]), np.ones(4, int), 39_000).tolist() == [0, 1, 0, 1]


def test_fit_of_large_sources_is_exact_and_even():
    for lengths, counts, share in ((np.arange(1, 5000), np.full(4999, 7), 0.371), (np.arange(20, 20_000, 3), np.full(6660, 100_000), 0.77), (np.arange(3000, 200_000, 61), np.ones(3230, int), 0.4)):
        budget = int((lengths * counts).sum() * share)
        take = mixing.fit(lengths, counts, budget)
        assert (take * lengths).sum() == budget and (take <= counts).all()
        half = len(lengths) // 2
        assert all(abs(take[s].sum() / counts[s].sum() - share) < 0.15 for s in (slice(0, half), slice(half, None)))


def test_targets_of_many_sources(spark):
    rnd = random.Random(4)
    sizes = {f"host{rnd.randrange(10**6)}": rnd.choice([0, 1, 5, 40, 3000]) for _ in range(700)} | {None: 77, "": 12}
    rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(rows).collect()}
    want = plain_targets(sizes)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in want)
    assert mixing.targets(rows.limit(0)).count() == 0


def test_mix_is_applied_row_by_row(spark):
    rows = [(i % 40, f"w{i % 7} " * (1 + i % 9), f"s{i % 3}" if i % 5 else None, i) for i in range(400)] + [(1, "same row here", "s9", 7)] * 9 + [(None, "a b", "s9", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size long")
    mixed = mixing.mix(docs).collect()
    out = mixing.apply_mix(docs)
    assert out.columns == docs.columns
    words = defaultdict(int)
    for r in out.collect():
        words[r.source] += len(r.text.split())
    want = defaultdict(int)
    for r in mixed:
        want[r.source] += r.copies * r.size
    assert words == {k: v for k, v in want.items() if v}
    assert len(mixed) == len(rows) and all(abs(words[r.source] - r.target) <= 1 for r in mixed)


def test_null_source_is_last(spark):
    rows = [(1, "a b c d", None), (2, "e f", "b"), (3, "g h i", "a"), (4, None, "a"), (5, "j " * 30, "c")]
    got = {r.doc_id: r for r in mixing.taken(mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))).collect()}
    want = plain_targets({"a": 3, "b": 2, "c": 30, None: 4})
    assert abs(got[1].target - want[None]) < 1e-9 and got[4].taken == 0 and got[4].size == 0


# odd tables


ODD = {
    "pii": lambda d: pii.digest(pii.find(d)),
    "sanitise": pii.sanitise,
    "pieces": pieces.encode_digest,
    "secrets": lambda d: secrets.digest(secrets.find(d)),
    "redacted": secrets.redacted,
    "mixing": lambda d: mixing.taken(mixing.mix(d)),
    "quality": quality.assess,
    "token_counts": token_counts.recount,
    "near_dup": near_dup.near_duplicates,
    "imatch": imatch.compare,
    "fingerprint": imatch.fingerprint,
}


@pytest.mark.parametrize("name", ODD)
def test_odd_rows(spark, odd_docs, no_docs, name):
    got = ODD[name](odd_docs).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r.doc_id) for r in odd_docs.select("doc_id").collect())
    assert ODD[name](no_docs).count() == 0


#: What the odd rows give, by operator and doc_id: some columns of every row of that id.
EMPTY = hashlib.sha256(b"").hexdigest()
ODD_VALUES = {
    "pii": {2: {"n_email": 0, "spans": "", "base_sha256": EMPTY}, 3: {"spans": ""}, 4: {"spans": ""}, 6: {"n_email": 1, "n_ip": 1, "n_card": 0}, 7: {"spans": ""}},
    "sanitise": {2: {"text": ""}, 3: {"text": ""}, 4: {"text": " \n\t "}, 7: {"text": "one two"}},
    "pieces": {2: {"n_tokens": 0, "ids_sha256": EMPTY, "decoded_sha256": EMPTY}, 3: {"n_tokens": 0}},
    "secrets": {2: {"n_assign": 0, "spans": ""}, 3: {"spans": ""}, 6: {"n_assign": 1, "n_hex": 0}, None: {"spans": ""}},
    "redacted": {2: {"text": None, "lang": None}, 3: {"text": "", "source": "src1"}, 6: {"n_chars": 9}, None: {"lang": "en"}},
    "mixing": {2: {"size": 0, "taken": 0, "source_size": 15}, 3: {"size": 0, "taken": 0}, 4: {"taken": 0}, 1: {"size": 14}, 5: {"size": 160_000}, None: {"size": 15}},
    "quality": {2: {"n_words": 0, "n_tokens": 0, "base_failed": True, "kept": False, "script": "other"}, 4: {"n_words": 0, "kept": False}, 5: {"n_words": 160_000, "base_failed": True}, 7: {"n_words": 2, "base_failed": True}},
    "token_counts": {2: {"n_chars": 0, "n_tokens": 0}, 3: {"n_chars": 0, "n_tokens": 0}, 7: {"n_chars": 7}},
    "near_dup": {1: {"n_shingles": 10, "component_id": 1, "kept": True}, 2: {"n_shingles": 0, "component_id": 2, "kept": True}, 4: {"n_shingles": 0}, 5: {"n_shingles": 8, "component_id": 5}, 7: {"component_id": 7, "kept": True}, 8: {"n_shingles": 1, "component_id": 7, "kept": False}, None: {"component_id": None, "kept": True}},
    "imatch": {2: {"n_chars": 0, "edited_sha256": EMPTY}, 3: {"n_chars": 0}, 7: {"n_chars": 7, "near_next": 1.0}},
}


@pytest.mark.parametrize("name", ODD_VALUES)
def test_odd_values(spark, odd_docs, name):
    seen = set()
    for r in ODD[name](odd_docs).collect():
        for column, value in ODD_VALUES[name].get(r.doc_id, {}).items():
            assert r[column] == value, (r.doc_id, column, r[column])
            seen.add(r.doc_id)
    assert seen == ODD_VALUES[name].keys()


def test_odd_rows_of_toxicity(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (5, 0), (7, None), (None, 1), (6, 1), (8, 0)], "doc_id long, toxic int")
    model = toxicity.fit(odd_docs, labels)
    got = model.score(odd_docs).collect()
    assert len(got) == odd_docs.count() and all(0 <= r.score <= 1 for r in got)
    assert toxicity.fit(no_docs, labels).score(no_docs).count() == 0
    assert toxicity.fit(odd_docs, labels.limit(0)).score(odd_docs).count() == odd_docs.count()


def test_odd_rows_of_stages(spark, odd_docs, no_docs, sf_dir):
    for docs in (odd_docs, no_docs):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, sf_dir)
            out.count()
            if k < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == docs.columns


def test_pipeline_stages_decide(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").cache()
    kept = {r.doc_id for r in quality.assess(docs).filter("kept").collect()}
    first = corpus_pipeline.quality_stage(spark, docs, sf_dir)
    assert sorted(r.doc_id for r in first.collect()) == sorted(kept)
    want = plain_components([(r.doc_id, r.text) for r in first.collect()], 80)
    second = corpus_pipeline.near_dup_stage(spark, first, sf_dir)
    assert sorted(r.doc_id for r in second.collect()) == sorted(i for i, (_, c) in want.items() if c == i)
    third = corpus_pipeline.secrets_stage(spark, second, sf_dir)
    assert third.count() == second.count() and not any("token = \"" in r.text for r in third.collect())
    copies_of = defaultdict(int)
    for r in corpus_pipeline.mixing_stage(spark, third, sf_dir).collect():
        copies_of[r.doc_id] += 1
    wanted = {r.key: r.copies for r in mixing.mix(third).filter("copies > 0").collect()}
    assert copies_of == wanted
    final = corpus_pipeline.run(spark, sf_dir)
    assert final.count() == sum(wanted.values())


def test_mixed_rows_do_not_depend_on_where_they_lie(spark):
    # rows of one id, text and source that differ elsewhere, some of them twice: which ones are taken is told by the rows
    docs = [(1, "a b c d e f g", f"l{k % 6}", "s", k % 6) for k in range(9)] + [(k, "w " * 3, "en", "t", 6) for k in range(20, 40)]
    wide = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    found = {tuple(sorted(map(str, mixing.apply_mix(wide.repartition(n)).collect()))) for n in (1, 3, 5)}
    assert len(found) == 1
    copies = defaultdict(int)
    for r in mixing.mix(wide).collect():
        copies[r.key] += r.copies
    assert len(next(iter(found))) == sum(copies.values())
