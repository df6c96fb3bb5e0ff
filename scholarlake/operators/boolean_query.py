"""A boolean field-query language that compiles to one Spark predicate.

Operators are AND, OR and ANDNOT in capitals between spaces. ANDNOT splits first, then AND, then OR, so OR binds
tighter than AND: a AND b OR c is a AND (b OR c). Quotes and parentheses protect what is in them.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholarlake.functions.stem import let
from scholarlake.functions.text import folded, has_words, query_tokens

FIELDS = {"ti": "title", "title": "title", "abs": "abstract", "abstract": "abstract", "au": "author", "author": "author", "authors": "author", "cat": "category", "category": "category", "all": "all", "id": "id"}
#: Relevance of a hit in a field.
WEIGHTS = {"title": 8, "abstract": 5, "category": 3, "author": 1}
POOL = 500
#: Days that a search over the last days may be widened to.
WIDER_DAYS = (90, 365)


class QueryError(ValueError):
    """The query cannot be read."""


@dataclass(frozen=True)
class Node:
    """kind: and, or, andnot, text, category, id or date."""

    kind: str
    parts: tuple[Node, ...] = ()
    field: str = ""
    value: str = ""
    phrase: bool = False


def _marks(s: str) -> Iterator[tuple[int, str, int, bool]]:
    """(place, character, depth before it, in quotes) of a query; a backslash escapes the next character."""
    depth, quoted, skip = 0, False, False
    for i, c in enumerate(s):
        yield i, c, depth, quoted or skip
        if skip:
            skip = False
        elif c == "\\":
            skip = True
        elif c == '"':
            quoted = not quoted
        elif not quoted:
            depth += (c == "(") - (c == ")")


def _stripped(s: str) -> str:
    s = s.strip()
    while s.startswith("(") and s.endswith(")"):
        closes = next((i for i, c, depth, quoted in _marks(s) if c == ")" and not quoted and depth == 1), -1)
        if closes != len(s) - 1:
            break
        s = s[1:-1].strip()
    return s


def _split(s: str, word: str) -> list[str]:
    """The parts between top-level operators; the operator must stand between spaces."""
    sep, cuts = f" {word} ", [0]
    free = {i for i, c, depth, quoted in _marks(s) if c == " " and depth == 0 and not quoted}
    i = 0
    while i <= len(s) - len(sep):
        if i in free and s.startswith(sep, i):
            cuts += [i, i + len(sep)]
            i += len(sep) - 1
        i += 1
    cuts.append(len(s))
    return [s[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True)]


def parse(s: str) -> Node:
    s = _stripped(s)
    if not s:
        raise QueryError("an empty clause")
    for word, kind in (("ANDNOT", "andnot"), ("AND", "and"), ("OR", "or")):
        parts = _split(s, word)
        if len(parts) > 1:
            return Node(kind, tuple(parse(p) for p in parts))
    if m := re.fullmatch(r"submittedDate:\[(\d{12}) TO (\d{12})\]", s):
        return Node("date", value=f"{m[1]} {m[2]}")
    name, colon, value = s.partition(":")
    if not colon or " " in name or '"' in name:
        name, value = "all", s
    if name not in FIELDS:
        raise QueryError(f"no field {name!r}")
    value = _stripped(value)
    phrase = len(value) > 1 and value[0] == value[-1] == '"'
    value = value.strip('"').strip()
    if not value:
        raise QueryError(f"nothing asked of {name!r}")
    if "*" in value or "?" in value:
        raise QueryError("wildcards are not supported")
    f = FIELDS[name]
    if f in ("category", "id"):
        return Node(f, value=value)
    if not query_tokens(value):
        raise QueryError(f"no word in {value!r}")
    return Node("text", field=f, value=value, phrase=phrase)


def needs(n: Node) -> frozenset[str]:
    """The side tables that a query asks: text for words, category for exact categories; ids and dates are in the papers themselves."""
    if n.parts:
        return frozenset().union(*map(needs, n.parts))
    return frozenset({n.kind}) if n.kind in ("text", "category") else frozenset()


def checked(query: str, sort: str = "date", start: int = 0, n: int = 10, most: int = 2000) -> Node:
    """The query of a request, or an error that says what is wrong with it: the sort, the page or the query."""
    if sort not in ("date", "relevance"):
        raise QueryError(f"no sort {sort!r}")
    if start < 0 or not 1 <= n <= most:
        raise QueryError(f"no page of {n} from {start}")
    return parse(query)


@dataclass(frozen=True)
class Columns:
    """The columns that queries ask: folded texts by field, categories, id and an ISO date."""

    texts: dict[str, Column]
    categories: Column
    id: Column
    date: Column


def asked(n: Node) -> frozenset[str]:
    """The text fields that a query asks."""
    if n.parts:
        return frozenset().union(*map(asked, n.parts))
    return frozenset({n.field}) if n.kind == "text" else frozenset()


def on_papers(papers: DataFrame, fields: frozenset[str], body: Callable[[Columns], Column]) -> Column:
    """`body` of how to ask papers, in which each of these fields is folded once a row, however many clauses ask it.

    All is title, authors and abstract. A table without authors has none.
    """
    names = F.array_join("authors", ", ") if "authors" in papers.columns else F.lit("")
    raw = {"title": F.col("title"), "abstract": F.col("abstract"), "author": names, "category": F.array_join("categories", ", ")}
    parts = ("title", "author", "abstract")
    single = [f for f in raw if f in fields or ("all" in fields and f in parts)]

    def bound(*texts: Column) -> Column:
        of = dict(zip(single, texts, strict=True))
        if "all" not in fields:
            return body(Columns(of, F.col("categories"), F.col("paper_id").cast("string"), F.col("created")))
        return let(F.concat_ws("\n", *[of[f] for f in parts]), lambda every: body(Columns(of | {"all": every}, F.col("categories"), F.col("paper_id").cast("string"), F.col("created"))))

    def bind(done: list[Column], left: list[str]) -> Column:
        return let(folded(raw[left[0]]), lambda x: bind([*done, x], left[1:])) if left else bound(*done)

    return bind([], single)


def compile_query(n: Node, c: Columns) -> Column:
    """One predicate for the whole query."""
    if n.kind in ("and", "or", "andnot"):
        first, *rest = [compile_query(p, c) for p in n.parts]
        for p in rest:
            first = first & p if n.kind == "and" else first | p if n.kind == "or" else first & ~p
        return first
    if n.kind == "date":
        day = lambda s: F.to_timestamp(F.lit(s), "yyyyMMddHHmm")
        a, b = n.value.split()
        return F.to_timestamp(c.date, "yyyy-MM-dd").between(day(a), day(b))
    if n.kind == "category":
        return F.array_contains(c.categories, n.value)
    if n.kind == "id":
        return c.id == n.value
    return has_words(c.texts[n.field], query_tokens(n.value), n.phrase)


def relevance(n: Node, c: Columns) -> Column:
    """Score of a hit: fields weigh title 8, abstract 5, category 3, author 1; AND adds, OR takes the best, ANDNOT counts its left side; a field clause is 10, categories and dates 0."""
    if n.kind == "and":
        return sum((relevance(p, c) for p in n.parts[1:]), relevance(n.parts[0], c))
    if n.kind == "or":
        return F.greatest(*[relevance(p, c) for p in n.parts])
    if n.kind == "andnot":
        return relevance(n.parts[0], c)
    if n.kind in ("date", "category", "id"):
        return F.lit(0)
    hit = lambda f: compile_query(Node("text", field=f, value=n.value, phrase=n.phrase), c)
    if n.field != "all":
        return F.when(hit(n.field), 10).otherwise(0)
    return sum((F.when(hit(f), w).otherwise(0) for f, w in WEIGHTS.items()), F.lit(0))


def scored_fields(n: Node) -> frozenset[str]:
    """The text fields that the relevance of a hit asks: a word of no field is scored by all of them."""
    return frozenset().union(*(WEIGHTS.keys() if f == "all" else (f,) for f in asked(n)))


def search(papers: DataFrame, query: str, sort: str = "date", start: int = 0, n: int = 10) -> DataFrame:
    """A page of hits with the total: (paper_id, created, score, total), newest first or by relevance.

    By relevance the newest POOL hits are scored, or as many as the page needs.
    """
    ast = checked(query, sort, start, n)
    hits = papers.filter(on_papers(papers, asked(ast), lambda c: compile_query(ast, c)))
    score = on_papers(papers, scored_fields(ast), lambda c: relevance(ast, c).cast("long")).alias("score")
    newest = [F.desc("created"), F.desc("paper_id")]
    # texts of the rows of a page only are scored
    if sort == "date":
        page = hits.orderBy(*newest).offset(start).limit(n).select("paper_id", "created", score)
    else:
        page = hits.orderBy(*newest).limit(max(POOL, start + n)).select("paper_id", "created", score).orderBy(F.desc("score"), *newest).offset(start).limit(n)
    # the total is one row; it is counted by a scan of its own, of the fields that the query asks
    total = hits.agg(F.count("*").alias("total"))
    return page.withColumn("_one", F.lit(1)).join(F.broadcast(total.withColumn("_one", F.lit(1))), "_one").drop("_one")


def count_many(papers: DataFrame, queries: dict[str, str]) -> DataFrame:
    """(name, n): hits of many queries in one scan."""
    asts = {name: parse(q) for name, q in queries.items()}
    hit = on_papers(papers, frozenset().union(*map(asked, asts.values())), lambda c: F.struct(*[F.when(compile_query(a, c), 1).otherwise(0).alias(f"q{i}") for i, a in enumerate(asts.values())]))
    rows = papers.select(F.explode(F.array(hit)).alias("_h"))
    counts = rows.agg(*[F.sum(f"_h.q{i}").cast("long").alias(name) for i, name in enumerate(asts)])
    return counts.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, queries)), F.array(*[F.coalesce(F.col(f"`{q}`"), F.lit(0).cast("long")) for q in queries]))).alias("name", "n"))


def first_level(papers: DataFrame, levels: list[str]) -> DataFrame:
    """Hits of the first query of a ladder, from strict to loose, that has any: (paper_id, level)."""
    asts = [parse(q) for q in levels]
    level = on_papers(papers, frozenset().union(*map(asked, asts)), lambda c: F.coalesce(*[F.when(compile_query(a, c), F.lit(i)) for i, a in enumerate(asts)]))
    hits = papers.select("paper_id", level.cast("long").alias("level")).filter("level is not null")
    least = hits.agg(F.min("level").alias("least"))  # one row
    return hits.join(F.broadcast(least), F.col("level") == F.col("least")).select("paper_id", "level")


def widened(query: str, days: int | None, today: str) -> dict[str, str]:
    """A search over the last `days` days before `today` (YYYYMMDD), and the same over more days."""
    if days is None:
        return {}
    from datetime import datetime, timedelta

    end = datetime.strptime(today, "%Y%m%d")
    since = lambda n: (end - timedelta(days=n)).strftime("%Y%m%d")
    return {f"days_{n}": f"({query}) AND submittedDate:[{since(n)}0000 TO {today}2359]" for n in (days, *[w for w in WIDER_DAYS if w > days])}


def suggestions(papers: DataFrame, base: str, forms: dict[str, str], drops: int = 2) -> DataFrame:
    """(name, n): the looser forms that find more than `base` does; of those that leave a term out the best `drops`. One scan."""
    counts = count_many(papers, {"base": base, **{k: v for k, v in forms.items() if k != "base"}})
    one = counts.agg(F.max(F.when(F.col("name") == "base", F.col("n"))).alias("least"))
    more = counts.join(F.broadcast(one)).filter((F.col("name") != "base") & (F.col("n") > F.col("least"))).select("name", "n")
    dropped = F.col("name").startswith("drop_")
    return more.filter(~dropped).unionByName(more.filter(dropped).orderBy(F.desc("n"), "name").limit(drops))


def relaxations(query: str, terms: list[str], expansions: dict[str, str]) -> dict[str, str]:
    """Looser forms of a query of terms: an abbreviation expanded, each term left out (of 2 to 6), any term."""
    out = {"base": query}
    for short, long in expansions.items():
        if short in terms:
            out[f"expand_{short}"] = " AND ".join(f'all:"{long}"' if t == short else f"all:{t}" for t in terms)
    if 2 <= len(terms) <= 6:
        for t in terms:
            out[f"drop_{t}"] = " AND ".join(f"all:{u}" for u in terms if u != t)
        out["any"] = " OR ".join(f"all:{t}" for t in terms)
    return out


def quoted(text: str) -> str:
    """A value as one clause: in quotes if it has spaces, inner quotes escaped away."""
    text = " ".join(text.replace('"', " ").split())
    return f'"{text}"' if " " in text else text


def build_query(fields: list[tuple[str, str, str]], categories: list[str] = (), any_category: bool = True, dates: tuple[str, str] | None = None) -> str:
    """A query from structured parameters: (operator, field, value) clauses, categories, and a date range."""
    out = ""
    for op, name, value in fields:
        clause = f"{name}:{quoted(value)}"
        out = f"({out}) {op} {clause}" if out else clause
    if categories:
        cats = (" OR " if any_category else " AND ").join(f"cat:{c}" for c in categories)
        out = f"({out}) AND ({cats})" if out else cats
    if dates:
        window = f"submittedDate:[{dates[0]}0000 TO {dates[1]}2359]"
        out = f"({out}) AND {window}" if out else window
    return out
