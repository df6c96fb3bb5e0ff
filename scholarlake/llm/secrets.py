"""Secret scans by a trigram inverted index, with DataFrame functions only.

From each rule's regular expression follows a Boolean query over trigrams that every match must contain. An
index holds the documents of each such trigram; intersecting its postings gives a rule's candidates, and only
these are verified by the expression. A rule whose expression forces no trigram scans all texts. Texts are shuffled to
their candidate rules only if a filter of the candidates' keys lets them through.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholarlake.llm.common import key_filter, let, running, saved

try:
    from re import _parser as _regex
except ImportError:  # Python before 3.11
    import sre_parse as _regex


@dataclass(frozen=True)
class Rule:
    """`pattern` holds for both Java and Python and has no nested quantifiers; a match counts if group `group` has at least `least` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The three base kinds, in the order in which they are listed.
BASE = (
    Rule("assign", r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 1, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
)
#: Further kinds, from the formats that their issuers document.
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("forge_token", r"gh[opsur]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+"),
    Rule("map_key", r"AIza[A-Za-z0-9_-]{35}"),
)
RULES = BASE + MORE
_MOST = 64


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """The query of a regular expression: a list of alternatives, of which each is a set of trigrams (lower case)
    that a match holds all of. None: a match need not hold any."""

    def literals(items: list) -> list[list[str]]:
        """Alternatives, each the literal runs that a match of the sequence holds."""
        done: list[list[str]] = [[""]]  # the last run of each is still open

        def close() -> None:
            # a break, also where no run is open yet: around a group, what stands before and after must not join
            for a in done:
                if len(a) < 2 or a[-1]:
                    a.append("")

        def append(options: list[str]) -> None:
            nonlocal done
            if len(done) * len(options) > _MOST:
                return close()
            done = [[*a[:-1], a[-1] + o] for a, o in product(done, options)]

        for op, arg in items:
            name = str(op)
            if name == "LITERAL":
                append([chr(arg).lower()])
            elif name == "IN" and all(str(o) == "LITERAL" for o, _ in arg) and len(arg) <= 8:
                append(sorted({chr(a).lower() for _, a in arg}))
            elif name == "SUBPATTERN" or name == "BRANCH" or name == "ATOMIC_GROUP":
                branches = arg[1] if name == "BRANCH" else [arg[-1] if name == "SUBPATTERN" else arg]
                inner = [x for b in branches for x in literals(list(b))]
                if len(done) * len(inner) > _MOST:
                    close()
                else:  # runs inside a group join those around it at its ends only if it is one run
                    done = [[*a[:-1], a[-1] + i[0], *i[1:]] if len(i) > 1 else [*a[:-1], a[-1] + i[0]] for a, i in product(done, inner)]
            elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
                low, high, body = arg
                inner = literals(list(body))
                exact = [i[0] for i in inner if len(i) == 1]
                if low == 0 and high == 1 and len(exact) == len(inner) and len(inner) <= 4:
                    append(["", *exact])
                elif low >= 1 and all(len(i) == 1 and i[0] for i in inner) and low == high == 1:
                    append(exact)
                else:
                    close()
            elif name != "AT":
                close()
        return done

    out = []
    for runs in literals(list(_regex.parse(pattern))):
        grams = frozenset(r[i : i + 3] for r in runs for i in range(len(r) - 2))
        if not grams:
            return None
        out.append(grams)
    # an alternative that asks for more than another one is implied by it
    return sorted({g for g in out if not any(h < g for h in out)}, key=sorted)


def queries_of(rules: tuple[Rule, ...]) -> tuple[dict[int, list[frozenset[str]]], list[int]]:
    """By rule number: the trigram queries of the rules that have one, and the rules that scan all texts."""
    found = {i: trigram_query(r.pattern) for i, r in enumerate(rules)}
    return {i: q for i, q in found.items() if q}, [i for i, q in found.items() if not q]


def index(docs: DataFrame, key: str, text: str, rules: tuple[Rule, ...]) -> DataFrame:
    """The inverted index of the trigrams that the rules ask for: (trigram, key), a row per document that has it."""
    asked = sorted(set().union(*(g for q in queries_of(rules)[0].values() for g in q)))
    if not asked:
        return docs.select(F.lit("").alias("trigram"), key).limit(0)
    low = docs.select(key, F.lower(text).alias("_low"))
    has = F.array(*[F.when(F.col("_low").contains(g), F.lit(g)) for g in asked])
    return low.select(key, F.explode(F.array_compact(has)).alias("trigram")).select("trigram", key)


def candidates(postings: DataFrame, key: str, rules: tuple[Rule, ...]) -> DataFrame:
    """(key, rules array<int>): the rules whose query a document's postings satisfy."""
    by_rule = queries_of(rules)[0]
    clauses = [(rule, n, gram, len(grams)) for rule, query in by_rule.items() for n, grams in enumerate(query) for gram in sorted(grams)]
    # one bit for each trigram: intersecting postings is a bitwise union by document, summed before the shuffle
    asked = sorted({c[2] for c in clauses})
    word, bit = {g: i // 60 for i, g in enumerate(asked)}, {g: i % 60 for i, g in enumerate(asked)}
    n_words = max(word.values(), default=0) + 1
    bits = []
    for w in range(n_words):
        mine = [g for g in asked if word[g] == w]
        place = F.array_position(F.array(*map(F.lit, mine)), F.col("trigram")) - 1
        masks = F.array(*[F.lit(1 << bit[g]).cast("long") for g in mine])
        bits.append(F.bit_or(F.coalesce(F.get(masks, place.cast("int")), F.lit(0).cast("long"))).alias(f"_w{w}"))
    held = postings.groupBy(key).agg(*bits)

    def satisfied(query: list[frozenset[str]]) -> Column:
        any_of = F.lit(False)
        for grams in query:
            all_of = F.lit(True)
            for w in range(n_words):
                if mask := sum(1 << bit[g] for g in grams if word[g] == w):
                    all_of = all_of & (F.col(f"_w{w}").bitwiseAND(F.lit(mask)) == F.lit(mask))
            any_of = any_of | all_of
        return any_of

    hits = F.array_compact(F.array(*[F.when(satisfied(q), F.lit(i)) for i, q in by_rule.items()]))
    return held.select(key, hits.alias("rules")).filter(F.size("rules") > 0)


def spans_of(text: Column, number: int, rule: Rule) -> Column:
    """array<struct<start,kind,end>> of a rule's matches in a text, in code points.

    The pieces between the matches come from split, the matches from regexp_extract_all; their lengths add up to
    the places.
    """
    whole = F.lit(f"({rule.pattern})")
    found = F.regexp_extract_all(text, whole, F.lit(1))
    counted = found if not rule.group else F.regexp_extract_all(text, whole, F.lit(rule.group + 1))
    pieces = F.split(text, rule.pattern, -1)
    sizes = F.zip_with(F.slice(pieces, F.lit(1), F.size(found)), F.transform(found, F.length), lambda piece, hit: F.length(piece) + hit)
    ends = running(sizes, lambda a, b: a + b, F.lit(0))

    def spans(x: Column) -> Column:
        every = F.zip_with(F.zip_with(x["ends"], x["found"], lambda end, hit: F.struct((end - F.length(hit)).alias("start"), F.lit(number).alias("kind"), end.alias("end"))), x["counted"], lambda span, c: F.struct(span.alias("span"), (F.length(c) >= rule.least).alias("counts")))
        return F.transform(F.filter(every, lambda y: y["counts"]), lambda y: y["span"])

    return F.when(F.size(found) > 0, let(F.struct(ends.alias("ends"), found.alias("found"), counted.alias("counted")), spans))


def find(docs: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The secrets of every whole text: (key, spans array<struct<start,kind,end>>), kind a rule's number, in order.

    Null texts and null keys: an empty text has no spans; rows without a key are scanned by every rule. Repeated
    rows each have their spans, rows that share a key only share candidates. Other columns are not carried.
    """
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    return _joined(rows, rules).select(F.col("_key").alias(key), F.col("_spans").alias("spans"))


def _joined(rows: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """`rows` (_key, _text and more) with _spans.

    Only rows whose key may be a candidate's meet the candidates; all others are judged where they lie, by the rules
    that scan every text.
    """
    _, scanned = queries_of(rules)
    found = saved(candidates(index(rows.filter("_key is not null"), "_key", "_text", rules), "_key", rules), "secret-candidates")
    may_be = key_filter(found, "_key")
    found = found.select(F.col("_key").alias("_doc"), F.col("rules").alias("_rules"))
    hot = F.coalesce(may_be(F.col("_key")), F.lit(False)) & F.col("_key").isNotNull()
    asked = rows.filter(hot)
    joined = asked.join(found, asked["_key"] == found["_doc"], "left").select(*rows.columns, "_rules")
    every = F.array(*[F.lit(i) for i in range(len(rules))])
    # a row without a key cannot be looked up: all rules scan it
    rest = rows.filter(~hot).select(*rows.columns, F.when(F.col("_key").isNull(), every).alias("_rules"))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")

    def spans(i: int) -> Column:
        asked = F.lit(True) if i in scanned else F.coalesce(F.array_contains("_rules", i), F.lit(False))
        return F.coalesce(F.when(asked & F.col("_text").rlike(rules[i].pattern), spans_of(F.col("_text"), i, rules[i])), none)

    return joined.unionByName(rest).select(*rows.columns, F.array_sort(F.concat(*map(spans, range(len(rules))))).alias("_spans"))


def digest(found: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "doc_id") -> DataFrame:
    """Counts and hashes of what `find` gives: key, n_assign, n_access, n_hex, base_sha256, spans, n_more."""
    names = F.array(*[F.lit(r.kind) for r in rules])
    said = lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))
    count = lambda test: F.size(F.filter("spans", test)).cast("long")
    of_kind = lambda i: count(lambda x: x["kind"] == i)
    base = F.filter("spans", lambda x: x["kind"] < len(BASE))
    return found.select(
        key,
        *[of_kind(i).alias(f"n_{r.kind}") for i, r in enumerate(BASE)],
        F.sha2(F.array_join(F.transform(base, said), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", said), ",").alias("spans"),
        count(lambda x: x["kind"] >= len(BASE)).alias("n_more"),
    )


#: Characters of a block: a text is cut into blocks once, so that no place in it is counted from its beginning.
BLOCK = 1000


def redact(text: Column, spans: Column, mark: str = "<SECRET>") -> Column:
    """A whole text with its spans, in order, put as `mark`; where spans overlap, a later one counts from its end on."""
    blocks = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    reach = running(F.transform(spans, lambda s: s["end"]), lambda a, b: F.greatest(a, b), F.lit(0))

    def cut(x: Column) -> Column:
        def between(low: Column, high: Column) -> Column:
            first = F.floor(low / BLOCK).cast("int")
            some = F.array_join(F.slice(x["blocks"], first + 1, F.floor(high / BLOCK).cast("int") - first + 1), "")
            return F.substring(some, low - first * BLOCK + 1, high - low)

        before = F.concat(F.array(F.lit(0)), F.slice(x["reach"], F.lit(1), F.size(x["reach"]) - 1))
        put = F.zip_with(spans, before, lambda s, at: F.when(s["start"] >= at, F.concat(between(at, s["start"]), F.lit(mark))))
        return F.concat(F.array_join(put, ""), between(F.element_at(x["reach"], -1), F.size(x["blocks"]) * BLOCK))

    return F.when(F.size(spans) > 0, let(F.struct(blocks.alias("blocks"), reach.alias("reach")), cut)).otherwise(text)


def redacted(docs: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with the secrets of its texts put as <SECRET>, all rows and columns else as they were; null texts stay null."""
    names = docs.columns
    rows = docs.select(F.struct(*[docs[c] for c in names]).alias("_row"), docs[key].alias("_key"), docs[text].alias("_text"))
    found = _joined(rows, rules)
    put = {c: (redact(F.col("_text"), F.col("_spans")) if c == text else F.col("_row").getField(c)) for c in names}
    return found.select(*[x.alias(c) for c, x in put.items()])
