"""The greedy operators, and what has no SQL, against plain Python over whole tables."""

import math
import random
from collections import defaultdict

import numpy as np

from scholarlake import catalog
from scholarlake.operators import greedy as G
from scholarlake.plans.greedy import _budget_rows
from scholarlake.sources.tables import events, table, vectors


def plain_selection(rows, slots, chars):
    out, used, left = {}, 0, chars
    turn = lambda r: 0 if r["is_anchor"] else 1 if r["n_anchors"] > 1 else 2
    for r in sorted(rows, key=lambda r: (turn(r), -r["priority"], -r["score"], r["size"], r["doc_id"])):
        if used >= slots:
            out[r["doc_id"]] = "no_slot"
        elif r["size"] > left:
            out[r["doc_id"]] = "over_budget"
        else:
            out[r["doc_id"]] = ("anchor", "shared", "fill")[turn(r)]
            used, left = used + 1, left - r["size"]
    return out


def test_budget_selection_of_all_rows(spark, sf_dir):
    rows = [r.asDict() for r in _budget_rows(spark, sf_dir).collect()]
    groups = defaultdict(list)
    for r in rows:
        groups[r["source"]].append(r)
    got = {r.doc_id: r.decision for r in catalog.queries()["x12_budget_selection"](spark, sf_dir).collect()}
    assert got == {k: v for g in groups.values() for k, v in plain_selection(g, 12, 24_000).items()}


def test_budget_selection_of_a_large_group(spark):
    rnd = random.Random(1)
    rows = [{"g": "a", "doc_id": i, "priority": float(rnd.randrange(3)), "score": rnd.randrange(50) / 50, "n_anchors": rnd.randrange(1, 3), "is_anchor": rnd.random() < 0.2, "size": rnd.randrange(1, 90)} for i in range(3000)]
    got = {r.doc_id: r.decision for r in G.select_with_budget(spark.createDataFrame(rows), "g", "doc_id", 900, 20_000).collect()}
    assert got == plain_selection(rows, 900, 20_000)


def test_prompt_budget(spark, sf_dir):
    sections = defaultdict(dict)
    for r in table(spark, sf_dir, "conversations").collect():
        sections[r.conv_id][r.role] = sections[r.conv_id].get(r.role, 0) + len(r.text or "")
    got = {(r.conv_id, r.section): r.granted for r in catalog.queries()["x14_prompt_budget"](spark, sf_dir).collect()}
    want = {}
    for conv, chars in sections.items():
        needed, left = {s: math.ceil(n / 3) for s, n in chars.items()}, 700
        order = sorted(needed, key=lambda s: (0 if s == "user" else 1, s))
        granted = dict.fromkeys(order, 0)
        for limit in (lambda s, needed=needed: needed[s] if s == "system" else 0, lambda s, needed=needed: min(needed[s], 200), lambda s, needed=needed: needed[s]):
            for s in order:
                more = min(max(limit(s) - granted[s], 0), left)
                granted[s] += more
                left -= more
        want |= {(conv, s): n for s, n in granted.items()}
    assert got == want


def test_evidence_pool(spark, sf_dir):
    rows = sorted((r.source, r.doc_id, r.doc_id * 31 % 211, r.n_chars) for r in table(spark, sf_dir, "documents").collect())
    want, pool = {}, defaultdict(lambda: [set(), 60_000])
    for source, _, key, size in rows:
        seen, left = pool[source]
        if key not in seen and len(seen) < 40 and size <= left:
            seen.add(key)
            pool[source][1] -= size
            want[source, key] = len(seen)
    got = {(r.source, r.key): r.place for r in catalog.queries()["x16_evidence_pool"](spark, sf_dir).collect()}
    assert got == want


def test_leader_clusters_of_many_topics(spark):
    rnd = random.Random(2)
    rows = [("g", f"t{i:04}", sorted(set(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=rnd.randint(1, 6)))), rnd.randrange(9)) for i in range(700)]
    want, leaders = {}, []
    for _, label, tokens, _ in sorted(rows, key=lambda r: (-r[3], r[1])):
        like = [(len(set(tokens) & set(t)) / len(set(tokens) | set(t)), -i) for i, (_, t) in enumerate(leaders)]
        best, i = max(like, default=(0, 0))
        if best >= 0.55:
            want[label] = leaders[-i][0]
        else:
            want[label] = label
            leaders.append((label, tokens))
    got = G.leader_clusters(spark.createDataFrame(rows, "g string, label string, tokens array<string>, weight long"), "g").collect()
    assert {r.label: r.leader for r in got} == want


def test_density_clusters(spark, sf_dir):
    rows = {r.vec_id: np.array(r.v) / np.linalg.norm(r.v) for r in vectors(spark, sf_dir).collect()}
    got = {(r.user_id, r.vec_id): r.cluster for r in catalog.queries()["a14_density_clusters"](spark, sf_dir).collect()}
    assert len(got) == len(rows)
    for user in range(8):
        ids = sorted(i for i in rows if i % 8 == user)
        far = 1 - np.stack([rows[i] for i in ids]) @ np.stack([rows[i] for i in ids]).T
        core = {a for a in range(len(ids)) if (far[a] <= 0.35).sum() >= 2}
        label, n = {}, 0
        for a in sorted(core):
            if a in label:
                continue
            todo = [a]
            while todo:
                x = todo.pop()
                if x not in label:
                    label[x] = n
                    todo += [y for y in core if y not in label and far[x, y] <= 0.35]
            n += 1
        for a, i in enumerate(ids):
            if a not in core:
                near = min(core, key=lambda c: far[c, a], default=None)
                label[a] = label[near] if near is not None and far[near, a] <= 0.35 else -1
            assert got[user, i] == label[a]


def test_overlong_split(spark, sf_dir):
    for r in catalog.queries()["c2_overlong_split"](spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").collect():
        assert r.n_chars <= 8000
    parts = defaultdict(list)
    rnd = random.Random(3)
    text = "".join(rnd.choice(["word ", "two words. ", "line\n", "para\n\n", "x"]) for _ in range(9000))
    for r in spark.createDataFrame([(1, text)], "id int, t string").lateralJoin(G.SplitOverlong(_c("t").outer(), _l(8000), _l(200), _l(400))).collect():
        parts[r.id].append((r.part, r.start, r.chunk))
    want, start, part = [], 0, 0
    while True:
        end = min(len(text), start + 8000)
        if end < len(text):
            low = max(start + 1, end - 400)
            cuts = [text.rfind(m, low, end) + len(m) for m in ("\n\n", "\n", ". ", " ") if text.rfind(m, low, end) >= 0]
            end = cuts[0] if cuts else end
        want.append((part, start, text[start:end]))
        if end == len(text):
            break
        start, part = max(start + 1, end - 200), part + 1
    assert sorted(parts[1]) == want


def _c(name):
    from pyspark.sql import functions as F

    return F.col(name)


def _l(value):
    from pyspark.sql import functions as F

    return F.lit(value)


def test_packed_units(spark, sf_dir):
    want = set()
    for d in table(spark, sf_dir, "documents").collect():
        part, kept = 0, []
        for u in (d.text or "").split("\n"):
            if kept and sum(len(x) + 1 for x in kept) + len(u) + 1 > 1200:
                want.add((d.doc_id, part, len(kept), len("\n".join(kept))))
                part, kept = part + 1, []
            kept.append(u)
        want.add((d.doc_id, part, len(kept), len("\n".join(kept))))
    assert {tuple(r) for r in catalog.queries()["c5_packed_units"](spark, sf_dir).select("doc_id", "part", "n_units", "n_chars").collect()} == want


def test_heading_paths(spark, sf_dir):
    want = {}
    for d in table(spark, sf_dir, "documents").collect():
        stack = []
        for pos, line in enumerate((d.text or "").split("\n")):
            level = 1 if len(line) < 20 else 2 if len(line) < 60 else 3 if len(line) < 120 else 0
            if level:
                stack = [x for x in stack if x[0] < level] + [(level, line.lstrip("#").strip())]
            want[d.doc_id, pos] = " > ".join(x for _, x in stack)
    got = {(r.doc_id, r.pos): r.path for r in catalog.queries()["c4_heading_paths"](spark, sf_dir).collect()}
    assert got == want


def test_leases(spark, sf_dir):
    users = defaultdict(list)
    for r in events(spark, sf_dir).filter("event_type in ('view', 'click', 'purchase')").collect():
        users[r.user_id].append((r.epoch, r.event_id, r.event_type))
    want = {}
    for rows in users.values():
        until = -1
        for at, i, kind in sorted(rows):
            held = at < until
            want[i] = {"view": ("claimed", "busy"), "click": ("lost", "renewed"), "purchase": ("ignored", "done")}[kind][held]
            if (kind == "view" and not held) or (kind == "click" and held):
                until = at + 7200
            elif kind == "purchase" and held:
                until = -1
    assert {r.event_id: r.outcome for r in catalog.queries()["t3_stream_leases"](spark, sf_dir).collect()} == want
