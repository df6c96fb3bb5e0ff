"""Chunks around an anchor, against plain Python, and what is shuffled for them."""

import random
import re
from collections import defaultdict

import pyarrow as pa
import pytest

from scholarlake.operators import chunks as C
from scholarlake.operators.streamed import whole
from scholarlake.plans import retrieval as R
from tests.shuffles import shuffled_rows

SCHEMA = "paper string, ord int, section string, page int, parent string, kind string, label string, cites array<string>"
POLICY = {"sibling_window": 1, "section_window": 2, "section_limit": 3, "page_window": 1, "page_limit": 4, "asset_limit": 2}


def plain(rows, p):
    papers, out = defaultdict(list), set()
    for r in sorted((r for r in rows if r[0] is not None), key=lambda r: r[1]):
        papers[r[0]].append(r)
    for paper, cs in papers.items():
        place = {c[1]: sum(x[2] == c[2] for x in cs[: i + 1]) for i, c in enumerate(cs)}
        for _, a, section, page, parent, _, _, cites in cs:
            if cites is None:
                continue
            step = lambda c: abs(c[1] - a)
            far = lambda c: None if c[3] is None or page is None else abs(c[3] - page)
            others = [c for c in cs if c[1] != a]
            is_near = lambda c: far(c) is not None and far(c) <= p["page_window"]
            same = lambda c: section and c[2] == section
            up = re.sub(r"[/>\\][^/>\\]*$", "", section).strip(" ") if section and re.search(r"[/>\\]", section) else ""
            asset = lambda c: c[5] in ("figure", "table")
            found = {
                "self": [(c, 0) for c in cs if c[1] == a],
                "sibling": [(c, step(c)) for c in others if parent is not None and c[4] == parent and step(c) <= p["sibling_window"]],
                "section_neighbors": [(c, step(c)) for c in sorted(others, key=lambda c: (step(c), c[1])) if same(c) and step(c) <= p["section_window"]][: p["section_limit"]],
                "section_header": [(c, step(c)) for c in cs if same(c) and place[c[1]] <= 2],
                "parent_section": [(c, step(c)) for c in cs if up and c[2] == up and place[c[1]] <= p["section_limit"]],
                "page_neighbors": [(c, far(c)) for c in sorted((c for c in others if is_near(c)), key=lambda c: (c[3], c[1]))][: p["page_limit"]],
                "asset_related": [(c, step(c)) for c in others if asset(c) and (same(c) or is_near(c))][: p["asset_limit"]],
                "cited_asset_context": [(c, far(c)) for c in cs if asset(c) and c[6] is not None and c[6] in cites][: p["asset_limit"]],
            }
            out |= {(paper, a, c[1], relation, d, c[5]) for relation, of in found.items() for c, d in of}
    return out


@pytest.mark.parametrize("policy", [POLICY, dict.fromkeys(POLICY, 0), {"sibling_window": 3, "section_window": 5, "section_limit": 1, "page_window": 3, "page_limit": 2, "asset_limit": 5}])
def test_around_is_that_of_plain_python(spark, policy):
    rnd, rows = random.Random(4), []
    for k in range(60):
        for o in rnd.sample(range(-5, 60), rnd.choice([1, 3, 8, 40])):
            cites = rnd.choice([None, None, [], ["t1"], ["t1", "t2", "t2", None], ["t9"]])
            section = rnd.choice(["A", "A > B", "A > B > C", "D/E", "D", "", None])
            rows.append((None if k == 7 else f"p{k}", o, section, rnd.choice([None, 1, 2, 3, 4, 9]), rnd.choice([None, "x", "y"]), rnd.choice(["body", "table", "figure", None]), rnd.choice([None, "t1", "t2"]), cites))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = [tuple(r) for r in C.around(spark.createDataFrame(rows, SCHEMA), policy).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(set(got)) and set(got) == plain(rows, policy)


def test_a_paper_of_one_long_section_makes_no_pairs(spark):
    rows = spark.range(30_000).selectExpr("'p' paper", "cast(id as int) ord", "'A' section", "1 page", "'x' parent", "'table' kind", "'t1' label", "array('t1') cites")
    found = {r.relation: r["count"] for r in C.around(rows, POLICY).groupBy("relation").count().collect()}
    n = 30_000
    assert found == {"self": n, "sibling": 2 * n - 2, "section_neighbors": 3 * n - 2, "section_header": 2 * n, "page_neighbors": 4 * n, "asset_related": 2 * n, "cited_asset_context": 2 * n}


def test_lines_are_shuffled_once(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    for query in (R.x1_x9_expansion, R.x2_x8_policy_relations):
        n, rows = shuffled_rows(spark, lambda q=query: q(spark, sf_dir).rdd.count())
        assert n > lines and rows <= lines  # each of eight relations had shuffles of its own


def test_groups_are_not_cut():
    batch = pa.RecordBatch.from_arrays([pa.array([None, None, 1, 1, 1, 2, 3, 3]), pa.array(list("aabbcccc"))], names=["a", "b"])
    for size in (1, 2, 3, 8):
        out = [b.to_pylist() for b in whole((batch.slice(i, size) for i in range(0, 8, size)), "a", "b")]
        assert sum(out, []) == batch.to_pylist()
        assert all(x[-1] != y[0] for x, y in zip(out, out[1:]))
    assert list(whole(iter([batch.slice(0, 0)]), "a")) == []
