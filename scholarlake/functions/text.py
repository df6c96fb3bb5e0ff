"""Text functions over columns: tokens, normal forms and simple classifications."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters with marks and what a full-text index folds them to.
MARKED, PLAIN = "áàâäãåéèêëíìîïóòôöõúùûüñçý", "aaaaaaeeeeiiiiooooouuuuncy"
CJK = r"\x{4e00}-\x{9fff}"
STOPWORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "how", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "what", "which", "with")

# What a search question says beside its subject, as words; questions are compared by stems as well.
QUESTION_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "can", "could", "do", "does", "for", "from", "how", "i", "in", "into", "is", "it", "of", "on", "or", "paper", "please", "should", "summarize", "summarise",
    "tell", "that", "the", "their", "this", "to", "was", "what", "which", "with", "would", "you",
    "的", "了", "和", "呢", "请", "这篇", "论文", "本文", "该文", "这个", "那个", "如何", "什么", "总结", "说明", "一个", "一下", "怎样", "是什么", "有哪些",
)


def document_tokens(text: Column) -> Column:
    """Tokens of an indexed text: letters and digits of any script, lower case, marks folded away."""
    return F.regexp_extract_all(F.translate(F.lower(text), MARKED, PLAIN), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def query_tokens(text: str) -> list[str]:
    """Tokens of a query: runs of ASCII letters and digits, lower case. A marked letter splits a word here."""
    import re

    return re.findall(r"[a-z0-9]+", text.lower())


def folded(text: Column) -> Column:
    """A text as its tokens are written: lower case, marks folded away. Looking for marks costs less than translating a text without any."""
    low = F.lower(text)
    return F.when(low.rlike(f"[{MARKED}]"), F.translate(low, MARKED, PLAIN)).otherwise(low)


def has_words(text: Column, words: Sequence[str], in_a_row: bool = False) -> Column:
    """Whether a folded text holds these tokens, all of them or in a row.

    Searched in place: no token array is built, and the search ends at the first hit. The words hold ASCII letters
    and digits only.
    """
    edge = r"[\p{L}\p{N}]"
    if in_a_row:
        gap = r"[^\p{L}\p{N}]+"
        return text.rlike(f"(?<!{edge}){gap.join(words)}(?!{edge})")
    out = F.lit(True)
    for w in words:
        out = out & text.contains(w) & text.rlike(f"(?<!{edge}){w}(?!{edge})")
    return out


#: A keyword, or what looks like one and is noise: digits and marks only, or one sign five times in a row. One
#: expression finds both, and only keywords are captured, so no token is looked at twice.
_NOISE = rf"[0-9][0-9_-]+(?![a-z0-9_-])|(?=[a-z0-9_-]*?([a-z0-9_-])\1{{4}})[a-z0-9][a-z0-9_-]+|(?=[{CJK}]*?([{CJK}])\2{{4}})[{CJK}]{{2,}}"
KEYWORD = rf"{_NOISE}|([a-z0-9][a-z0-9_-]+|[{CJK}]{{2,}})"


def keyword_tokens(text: Column) -> Column:
    """Search keywords: words of two and more of a-z, 0-9, _ and -, and runs of two and more CJK characters, without noise."""
    return F.array_remove(F.regexp_extract_all(F.lower(text), F.lit(KEYWORD), F.lit(3)), "")


def normal(text: Column) -> Column:
    """Lower case, white space collapsed and trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def language(text: Column) -> Column:
    """zh, en, mixed or unknown, by the scripts that occur."""
    zh, en = text.rlike(f"[{CJK}]"), text.rlike("[A-Za-z]")
    return F.when(zh & en, "mixed").when(zh, "zh").when(en, "en").otherwise("unknown")


def section_tags(text: Column, tags: dict[str, Sequence[str]]) -> Column:
    """The tags of which a keyword occurs in the first 900 characters, in the order given."""
    head = F.lower(F.substring(text, 1, 900))
    found = []
    for tag, words in tags.items():
        hit = F.lit(False)
        for w in words:
            hit = hit | head.contains(w)
        found.append(F.when(hit, F.lit(tag)))
    return F.array_compact(F.array(*found))


def noisy(text: Column) -> Column:
    """A field not worth indexing: under 3 letters or digits, a replacement character, or mostly signs or digits."""
    n = F.greatest(F.length(F.regexp_replace(text, r"\s", "")), F.lit(1))
    letters = F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""))
    digits = F.length(F.regexp_replace(text, r"[^0-9]", ""))
    signs = F.length(F.regexp_replace(text, r"[\p{L}\p{N}\s]", ""))
    return (letters < 3) | text.contains("�") | (signs / n > 0.28) | (digits / n > 0.45)


def singular(token: Column) -> Column:
    """English plural endings off: -ies, -es after a hiss, -s."""
    return (
        F.when((F.length(token) > 4) & token.endswith("ies"), F.concat(token.substr(F.lit(1), F.length(token) - 3), F.lit("y")))
        .when((F.length(token) > 3) & token.endswith("s") & ~token.endswith("ss"), token.substr(F.lit(1), F.length(token) - 1))
        .otherwise(token)
    )


def topic_key(label: Column, stopwords: Sequence[str] = STOPWORDS) -> Column:
    """A label's key: distinct singular tokens without stopwords, sorted."""
    tokens = F.filter(F.regexp_extract_all(F.lower(label), F.lit("[a-z0-9]+"), F.lit(0)), lambda t: ~t.isin(list(stopwords)))
    return F.array_join(F.array_sort(F.array_distinct(F.transform(tokens, singular))), " ")


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all elements of two arrays; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def utf8_cut(text: Column, most: int) -> Column:
    """The longest prefix of whole characters that has at most `most` bytes: bytes that begin no whole character go."""
    raw = F.substring(F.encode(text, "UTF-8"), 1, most)
    longest = F.when(F.octet_length(text) <= most, text)
    # of 4 candidates the longest that reads back as itself
    for cut in range(4):
        part = F.substring(F.encode(text, "UTF-8"), 1, most - cut)
        longest = F.coalesce(longest, F.when(F.is_valid_utf8(part.cast("string")), part.cast("string")))
    return F.coalesce(longest, raw.cast("string"))
