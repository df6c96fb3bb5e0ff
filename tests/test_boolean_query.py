import pytest

from scholarlake.operators import boolean_query as bq


def rows(spark):
    data = [(1, "Retrieval with RAG", "a study", ["cs.CL"], "2024-01-03"), (2, "Dragomir", "rag and bone, of the old town", ["cs.AI"], "2024-01-02"), (3, "Vision AND sound", "nothing", ["cs.CV", "cs.CL"], "2024-01-01")]
    return spark.createDataFrame([(i, t, a, c, c[0], d) for i, t, a, c, d in data], "paper_id long, title string, abstract string, categories array<string>, primary_category string, created string")


def ids(spark, q, **how):
    return [r.paper_id for r in bq.search(rows(spark), q, **how).collect()]


def test_tokens_are_whole_words(spark):
    assert ids(spark, "all:rag") == [1, 2]


def test_title_hits_come_first(spark):
    assert ids(spark, "all:rag", sort="relevance") == [1, 2]


def test_operators_in_quotes_are_text(spark):
    assert ids(spark, 'ti:"vision AND sound"') == [3]


def test_or_binds_tighter_than_and():
    n = bq.parse("a AND b OR c")
    assert n.kind == "and" and n.parts[1].kind == "or"


def test_andnot_splits_first():
    n = bq.parse("a ANDNOT b AND c")
    assert n.kind == "andnot" and n.parts[1].kind == "and"
    assert len(bq.parse("x ANDNOT y ANDNOT z").parts) == 3


def test_exact_category(spark):
    assert ids(spark, "cat:cs.CL") == [1, 3]
    assert ids(spark, "cat:cs.C") == []


@pytest.mark.parametrize("q", ["", "ti:", "nope:x", "ti:ra*", "all:--"])
def test_bad_queries(q):
    with pytest.raises(bq.QueryError):
        bq.parse(q)


def test_outer_parentheses():
    assert bq.parse("((ti:a AND ti:b))").kind == "and"
    assert bq.parse("(ti:a) OR (ti:b)").kind == "or"


def test_built_queries_parse(spark):
    q = bq.build_query([("", "ti", "rag"), ("OR", "abs", "old town")], ["cs.CL", "cs.AI"], True, ("20240101", "20240131"))
    assert ids(spark, q) == [1, 2]


def test_side_tables_that_a_query_needs():
    assert bq.needs(bq.parse("id:1 AND submittedDate:[202401010000 TO 202402010000]")) == frozenset()
    assert bq.needs(bq.parse("(ti:a OR cat:cs.CL) ANDNOT au:b")) == {"text", "category"}


@pytest.mark.parametrize("how", [{"sort": "size"}, {"start": -1}, {"n": 0}, {"n": 5000}])
def test_bad_requests(how):
    with pytest.raises(bq.QueryError):
        bq.checked("all:rag", **how)


def test_authors(spark):
    data = [(1, "Trees", "on rag", ["Ada Lovelace"], ["cs.CL"], "2024-01-01"), (2, "RAG", "x", ["Rag Dragomir", "Émile Zola"], ["cs.RAG"], "2024-01-02"), (3, "None", "y", [], ["cs.AI"], "2024-01-03")]
    p = spark.createDataFrame(data, "paper_id long, title string, abstract string, authors array<string>, categories array<string>, created string")
    assert [r.paper_id for r in bq.search(p, 'au:"emile zola" OR author:ada').collect()] == [2, 1]
    assert [(r.paper_id, r.score) for r in bq.search(p, "rag", sort="relevance").collect()] == [(2, 8 + 3 + 1), (1, 5)]


def test_widened():
    assert list(bq.widened("all:rag", 100, "20241231")) == ["days_100", "days_365"] and bq.widened("all:rag", None, "20241231") == {}
    assert bq.widened("all:rag", 30, "20240301")["days_90"] == "(all:rag) AND submittedDate:[202312020000 TO 202403012359]"
