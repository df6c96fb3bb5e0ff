"""English stems by staged suffix rules, as column expressions.

The rules are the published Snowball rules for English ("Porter2", the edition before its 2023 additions): R1 and R2 are what follows the first consonant
after a vowel, and what does within R1; each step looks for the longest of its suffixes and changes the word if that lies
in the region asked for. All steps are one expression within the JVM, in which each step's result is bound to a name: as
projections over one another they would be multiplied out by any condition on the stem.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the published rules: words that are not treated by them, regions given outright, suffixes and what they become.
WHOLE = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
WHOLE_AFTER_PLURAL = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
R1_AFTER = ("gener", "commun", "arsen")
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
LI_ENDING = "cdeghkmnrt"
STEP_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al",
    "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less",
}
STEP_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize")
#: A short syllable at the end, in words whose consonant y is Y.
SHORT = r"[^aeiouy][aeiouy][^aeiouywxY]$|^[aeiouy][^aeiouy]$"
REGION = r"^[^aeiouy]*[aeiouy]+[^aeiouy]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is evaluated once, however often it is read there."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _without(w: Column, n: int) -> Column:
    return F.substring(w, F.lit(1), F.length(w) - n)


def _longest(w: Column, cases: dict[str, Column], other: Column) -> Column:
    """The case of the longest suffix that a word has; `other` if it has none."""
    first, *rest = sorted(cases, key=len, reverse=True)
    out = F.when(w.endswith(first), cases[first])
    for suffix in rest:
        out = out.when(w.endswith(suffix), cases[suffix])
    return out.otherwise(other)


def _within(w: Column, region: Column, suffix: str, then: Column) -> Column:
    return F.when(F.length(w) - len(suffix) >= region, then).otherwise(w)


def _replaced(w: Column, rules: dict[str, str], region: Column) -> dict[str, Column]:
    return {s: _within(w, region, s, F.concat(_without(w, len(s)), F.lit(to))) for s, to in rules.items()}


def _before(w: Column, n: int) -> Column:
    """The character that stands before the last n."""
    return F.substring(w, F.length(w) - n, F.lit(1))


def _marked(token: Column) -> Column:
    """y is Y where it is a consonant."""
    return F.when(token.contains("y"), F.regexp_replace(F.regexp_replace(token, "^y", "Y"), "([aeiouy])y", "$1Y")).otherwise(token)


def _region(w: Column) -> Column:
    return F.length(F.regexp_extract(w, REGION, 0))


def _r1(w: Column) -> Column:
    given = F.coalesce(*[F.when(w.startswith(p), F.lit(len(p))) for p in R1_AFTER])
    return F.coalesce(given, F.nullif(_region(w), F.lit(0)), F.length(w))


def _r2(w: Column, r1: Column) -> Column:
    return let(_region(F.substring(w, r1 + 1, F.length(w))), lambda n: F.when(n > 0, r1 + n).otherwise(F.length(w)))


def _plural(w: Column) -> Column:
    ies = F.when(F.length(w) > 4, _without(w, 2)).otherwise(_without(w, 1))
    s = F.when(_without(w, 2).rlike("[aeiouy]"), _without(w, 1)).otherwise(w)
    return F.when(w.endswith("s") | w.endswith("ied"), _longest(w, {"sses": _without(w, 2), "ied": ies, "ies": ies, "us": w, "ss": w, "s": s}, w)).otherwise(w)


def _past(w: Column, r1: Column) -> Column:
    """-ed and -ing, and what the rest of the word then needs."""
    none = F.lit(None).cast("string")
    gone = lambda s: F.when(_without(w, len(s)).rlike("[aeiouy]"), _without(w, len(s)))
    cut = _longest(w, {"eedly": none, "eed": none, "ingly": gone("ingly"), "edly": gone("edly"), "ing": gone("ing"), "ed": gone("ed")}, none)
    kept = _longest(w, {"eed": _within(w, r1, "eed", _without(w, 1)), "eedly": _within(w, r1, "eedly", _without(w, 3))}, w)

    def mended(c: Column) -> Column:
        short = F.when((r1 >= F.length(c)) & c.rlike(SHORT), F.concat(c, F.lit("e"))).otherwise(c)
        return F.when(c.isNull(), kept).when(c.rlike("(at|bl|iz)$"), F.concat(c, F.lit("e"))).when(c.rlike(f"({'|'.join(DOUBLES)})$"), _without(c, 1)).otherwise(short)

    return F.when(w.endswith("ed") | w.endswith("ing") | w.endswith("ly"), let(cut, mended)).otherwise(w)


def _final_y(w: Column) -> Column:
    return F.when(F.lower(w).endswith("y") & w.rlike(".[^aeiouy][yY]$"), F.concat(_without(w, 1), F.lit("i"))).otherwise(w)


def _second(w: Column, r1: Column) -> Column:
    ogi = _within(w, r1, "ogi", F.when(_before(w, 3) == "l", _without(w, 1)).otherwise(w))
    li = _within(w, r1, "li", F.when(_before(w, 2).isin(list(LI_ENDING)), _without(w, 2)).otherwise(w))
    return _longest(w, _replaced(w, STEP_2, r1) | {"ogi": ogi, "li": li}, w)


def _third(w: Column, r1: Column, r2: Column) -> Column:
    return _longest(w, _replaced(w, STEP_3, r1) | {"ative": _within(w, r2, "ative", _without(w, 5))}, w)


def _fourth(w: Column, r2: Column) -> Column:
    ion = _within(w, r2, "ion", F.when(_before(w, 3).isin("s", "t"), _without(w, 3)).otherwise(w))
    return _longest(w, _replaced(w, dict.fromkeys(STEP_4, ""), r2) | {"ion": ion}, w)


def _last(w: Column, r1: Column, r2: Column) -> Column:
    n = F.length(w) - 1
    e = w.endswith("e") & ((n >= r2) | ((n >= r1) & ~_without(w, 1).rlike(SHORT)))
    return F.when(e | (w.endswith("ll") & (n >= r2)), _without(w, 1)).otherwise(w)


def stem_of(token: Column) -> Column:
    """The stem of a lower-case token. Words of two characters or fewer, and what is not of a-z, stay as they are; null gives null."""

    def steps(w: Column, r1: Column, r2: Column) -> Column:
        return let(_past(w, r1), lambda a: let(_final_y(a), lambda b: let(_second(b, r1), lambda c: let(_third(c, r1, r2), lambda d: let(_fourth(d, r2), lambda e: _last(e, r1, r2))))))

    def regions(w: Column, singular: Column) -> Column:
        return let(_r1(w), lambda r1: let(_r2(w, r1), lambda r2: F.translate(steps(singular, r1, r2), "Y", "y")))

    known = F.create_map(*[F.lit(x) for pair in WHOLE.items() for x in pair])
    ruled = let(_marked(token), lambda w: let(_plural(w), lambda s: F.when(s.isin(list(WHOLE_AFTER_PLURAL)), s).otherwise(regions(w, s))))
    # no rule changes a word without a vowel, or with another last letter than these
    same = (F.length(token) <= 2) | ~token.rlike(r"[aeiouy]") | ~token.rlike(r"[cdegilmnrsty]$")
    return F.when(same, token).when(token.isin(list(WHOLE)), known[token]).otherwise(ruled)


def with_stem(rows: DataFrame, token: str = "token", stem: str = "stem") -> DataFrame:
    """`rows` with the stem of a token in a new column, found once for each different token: for rows that name few words very often."""
    known = rows.select(F.col(token).alias("_v")).filter("_v is not null").distinct().select("_v", stem_of(F.col("_v")).alias("_s"))
    names = [c for c in rows.columns if c != stem]
    return rows.join(known, F.col(token) == F.col("_v"), "left").select(*names, F.col("_s").alias(stem))


#: Words that are sent to all tasks with their stems, and the longest of them.
MOST_SENT, LONGEST_SENT = 65536, 64


def vocabulary(rows: DataFrame, token: str = "token") -> DataFrame:
    """(token, stem, n): each different token, its stem, and how many rows have it. To be saved before `stem_known` reads it."""
    return rows.filter(F.col(token).isNotNull()).groupBy(F.col(token).alias("token")).agg(F.count("*").alias("n")).select("token", stem_of(F.col("token")).alias("stem"), "n")


def stem_known(rows: DataFrame, words: DataFrame, token: str = "token", most: int = MOST_SENT) -> DataFrame:
    """`rows` without tokens but with their stems, of a saved vocabulary of all their tokens. Null tokens have no stem.

    The most frequent words, `most` at most, are sent to all tasks, so most rows stay where they are; the others meet their
    stems by equality. How frequent a word must be is read off a histogram of the vocabulary.
    """
    bin_of = F.when(F.length("token") <= LONGEST_SENT, F.floor(F.log2("n") * 4).cast("int")).otherwise(-1)
    binned = words.select(F.col("token").alias("_v"), F.col("stem").alias("_s"), bin_of.alias("_b"))
    least, held, total = 1 << 20, 0, 0
    for b, n in binned.groupBy("_b").agg(F.count("*").alias("n")).orderBy(F.desc("_b")).collect():
        total += n
        if b >= 0 and total == held + n and held + n <= most:
            least, held = b, held + n
    names = [c for c in rows.columns if c != token]
    sent = binned.filter(F.col("_b") >= least).select("_v", "_s")
    beside = rows.join(F.broadcast(sent), F.col(token) == F.col("_v"), "left")
    if held == total:
        return beside.select(*names, F.col("_s").alias("stem"))
    near = beside.filter(F.col("_v").isNotNull() | F.col(token).isNull()).select(*names, F.col("_s").alias("stem"))
    far = beside.filter(F.col("_v").isNull() & F.col(token).isNotNull()).select(*names, token)
    far = far.join(binned.filter(F.col("_b") < least).select("_v", "_s"), F.col(token) == F.col("_v")).select(*names, F.col("_s").alias("stem"))
    return near.unionByName(far)


#: Stems of words that this driver was asked for.
_KNOWN: dict[str, str] = {}


def stems(spark: SparkSession, words: Sequence[str]) -> list[str]:
    """The stems of a stated list of words, in order, read by the driver."""
    new = sorted(set(words) - _KNOWN.keys())
    if new:
        listed = spark.createDataFrame([(w,) for w in new], "token string")
        _KNOWN.update({r["token"]: r["stem"] for r in listed.select("token", stem_of(F.col("token")).alias("stem")).collect()})
    return [_KNOWN[w] for w in words]
