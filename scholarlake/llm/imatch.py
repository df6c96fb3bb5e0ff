"""Document fingerprints by I-Match, with DataFrame functions only.

The lexicon is the terms whose document frequency lies in a band: common enough that a chance misspelling is not
in it, rare enough to tell documents apart. A document keeps its distinct lexicon terms in order, and is hashed
once whole and once for each of many random subsets of the lexicon, so that a change spoils the hashes of those
subsets only that hold a changed term. Subsets come in three sizes, since a subset tells something only if it has
few terms of a document: short documents agree in large subsets, long ones in small subsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholarlake.llm.common import WS, constant, saved

#: Share of documents that a term of the lexicon is in. A document of n distinct terms adds n to all document
#: frequencies, so no more than (mean n) / LOW terms can reach LOW: the lexicon's size does not grow with the corpus.
LOW, HIGH = 0.002, 0.25
#: Random subsets of each size, and the share of the lexicon that a subset of each size holds, as a power of 1/2.
SUBSETS, SIZES = 32, (5, 7, 9)
#: Subsets of a size that two documents have to fill for their agreement to count in full.
ENOUGH = 8
#: Ranges of documents at most; beyond that a range grows, as a sorted file that is read through and spilled.
MOST_RANGES = 1 << 16


def terms_of(text: Column) -> Column:
    """The distinct words of a text as hashes: lower case, without marks at their ends."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), f"[{WS}.,;:!?\"'()]+")
    return F.transform(F.array_distinct(F.array_remove(words, "")), lambda w: F.xxhash64(w))


def lexicon(docs: DataFrame, text: str = "text", low: float = LOW, high: float = HIGH) -> DataFrame:
    """(term, n): hashes of the terms that are in at least `low` and at most `high` of all documents, and in two at least."""
    rows = docs.select(F.coalesce(F.col(text), F.lit("")).alias("_text"))
    total = rows.count()
    counts = rows.select(F.explode(terms_of(F.col("_text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    return counts.filter((F.col("n") >= max(2.0, total * low)) & (F.col("n") <= max(2.0, total * high)))


def _cuckoo(terms: list[int]) -> tuple[int, list[int]]:
    """(mask, table): each term stands at its low bits in the first half of the table or at its high bits in the second."""
    mask = (1 << (4 * len(terms) + 16).bit_length()) - 1
    while True:
        table = [0] * (2 * mask + 2)
        for t in terms:
            side, moves = 0, 0
            while t and moves < 64:
                at = (t & mask) if not side else mask + 1 + (t >> 32 & mask)
                t, table[at] = table[at], t
                side = 0 if at > mask else 1
                moves += 1
            if t:
                break
        else:
            return mask, table
        mask = 2 * mask + 1


class Fingerprints:
    """Fingerprints of texts against one lexicon, whose size is bounded: see LOW.

    A fingerprint is a struct (whole, parts): the hash of all terms, and for each subset of which the text has terms
    its number and 16 bits of a hash of these.
    """

    def __init__(self, lex: DataFrame):
        self.mask, table = _cuckoo([r["term"] for r in lex.select("term").filter("term <> 0").sort("term").collect()])
        self.table = constant(table)

    def known(self, term: Column) -> Column:
        """Whether a term is in the lexicon: two places of a constant table are read."""
        low, high = term.bitwiseAND(F.lit(self.mask)), F.shiftright(term, 32).bitwiseAND(F.lit(self.mask)) + (self.mask + 1)
        return (F.get(self.table, low.cast("int")) == term) | (F.get(self.table, high.cast("int")) == term)

    def terms(self, text: Column) -> Column:
        """The lexicon terms of a text in order; all its terms if it has none of the lexicon."""
        every = terms_of(text)
        inside = F.filter(every, self.known)
        return F.sort_array(F.when(F.size(inside) > 0, inside).otherwise(every))

    def hashes(self, terms: Column) -> Column:
        """The fingerprint of terms in order: subsets are ranges of bits of a term's hash, and one fold over terms sorted by subset hashes all."""
        bits = lambda x, shift, width: F.shiftrightunsigned(x, shift).bitwiseAND(F.lit((1 << width) - 1))

        def places(x: Column) -> Column:
            """The subset's number and the term's lower half, for each size."""
            at = []
            for size, width in enumerate(SIZES):
                n = bits(x, 64 - sum(SIZES[: size + 1]), width)
                code = F.shiftleft(n + size * SUBSETS, 32).bitwiseOR(bits(x, 0, 32))
                at.append(code if 1 << width == SUBSETS else F.when(n < SUBSETS, code))
            return F.array(*at)

        mixed = F.transform(terms, lambda t: F.xxhash64(t, F.lit(7)))
        codes = F.sort_array(F.array_compact(F.flatten(F.transform(mixed, places))))
        part = lambda acc: F.shiftleft(acc["subset"], 16).bitwiseOR(acc["hash"].bitwiseAND(F.lit(65535)).cast("int"))
        ended = lambda acc: F.when(acc["subset"] >= 0, F.concat(acc["parts"], F.array(part(acc)))).otherwise(acc["parts"])
        zero = F.struct(F.lit(-1).alias("subset"), F.lit(0).cast("long").alias("hash"), F.array().cast("array<int>").alias("parts"))

        def step(acc: Column, code: Column) -> Column:
            subset = F.shiftrightunsigned(code, 32).cast("int")
            same = subset == acc["subset"]
            return F.struct(subset.alias("subset"), F.xxhash64(F.when(same, acc["hash"]).otherwise(F.lit(0).cast("long")), code).alias("hash"), F.when(same, acc["parts"]).otherwise(ended(acc)).alias("parts"))

        whole = F.when(F.size(terms) > 0, F.xxhash64(terms)).otherwise(F.lit(0).cast("long"))
        return F.struct(whole.alias("whole"), F.aggregate(codes, zero, step, ended).alias("parts"))

    @staticmethod
    def written(own: Column) -> Column:
        return F.concat_ws("-", F.lower(F.hex(own["whole"])), F.array_join(F.transform(own["parts"], lambda p: F.lower(F.hex(p))), "."))

    @staticmethod
    def likeness(a: Column, b: Column) -> Column:
        """1 for equal fingerprints; else the share of the subsets of one size, of those that either has terms of, whose hashes agree: of the size at which it is greatest.

        Fewer than ENOUGH such subsets count as ENOUGH.
        """
        x, y = a["parts"], b["parts"]
        subset = lambda p: F.shiftright(p, 16)
        same, used = F.array_intersect(x, y), F.array_union(F.transform(x, subset), F.transform(y, subset))

        def share(size: int) -> Column:
            inside = lambda s: (s >= size * SUBSETS) & (s < (size + 1) * SUBSETS)
            return F.size(F.filter(same, lambda p: inside(subset(p)))) / F.greatest(F.size(F.filter(used, inside)), F.lit(ENOUGH))

        return F.when(a["whole"] == b["whole"], 1.0).otherwise(F.greatest(*map(share, range(len(SIZES)))))


def fingerprint(docs: DataFrame, key: str = "doc_id", text: str = "text", **band: float) -> DataFrame:
    """(key, fingerprint) of every whole text, against the lexicon of all of them.

    Null and empty texts, and texts without a word, have the fingerprint of no terms. Equal texts have equal
    fingerprints; so have texts of the same lexicon terms. Repeated rows are fingerprinted each; other columns are not carried.
    """
    rows = docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    made = Fingerprints(saved(lexicon(rows, "_text", **band), "imatch-lexicon"))
    # in steps: an expression that is used often is a column of its own, and so evaluated once
    return rows.select(key, made.terms(F.col("_text")).alias("_t")).select(key, made.hashes(F.col("_t")).alias("_h")).select(key, made.written(F.col("_h")).alias("fingerprint"))


def with_next(docs: DataFrame, carry: tuple[str, ...] = (), rows_per_part: int = 2000) -> DataFrame:
    """(doc_id, text, next_text): each document and the text of the next one by ascending doc_id (after the last: the first).

    Columns named in `carry` come along: x and next_x.
    Cut points, which are ids of documents, divide the ids into ranges of about `rows_per_part` rows (more, where that
    makes over MOST_RANGES). They are quantiles of some ids, drawn by hash: where they lie changes the sizes of ranges
    only. The first row of each range also goes to the range before it, that of the
    first to the last; so every row has its next one in its own range, and the texts are shuffled once. Rows of
    equal ids follow in order of their texts, repeated rows stay, null ids come first, null texts are empty.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *carry)
    rows = rows.withColumn("_id", F.coalesce("doc_id", F.lit(-(2**63)).cast("long")))
    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)).cast("long")).alias("_id"))
    n = ids.count()
    parts = min(max(n // rows_per_part, 1), MOST_RANGES)
    drawn = F.pmod(F.xxhash64("_id", F.lit(3)), F.lit(max(n // (parts * 64), 1))) == 0
    found = ids.agg(F.min("_id").alias("least"), F.percentile_approx(F.when(drawn, F.col("_id")), [i / parts for i in range(parts)], 20 * parts).alias("cuts")).first()
    cuts = sorted({found["least"], *(found["cuts"] or [])} - {None})
    if not cuts:
        return rows.select("doc_id", "text", F.col("text").alias("next_text"), *carry, *[F.col(c).alias(f"next_{c}") for c in carry])
    # the range of an id in two steps, over every 64th cut and then over the 64 from there
    every, tops = constant(cuts), constant(cuts[::64])
    below = lambda cs: F.size(F.filter(cs, lambda c: c <= F.col("_id"))) - 1
    rows = rows.withColumn("_top", below(tops) * 64)
    rows = rows.withColumn("_part", F.col("_top") + below(F.slice(every, F.col("_top") + 1, 64))).withColumn("_first", F.get(every, F.col("_part")) == F.col("_id"))
    own = F.struct(F.col("_part").alias("part"), F.lit(0).alias("extra"))
    before = F.struct(F.pmod(F.col("_part") - 1, F.lit(len(cuts))).alias("part"), F.lit(1).alias("extra"))
    dealt = rows.select("doc_id", "text", "_id", *carry, F.explode(F.when(F.col("_first"), F.array(own, before)).otherwise(F.array(own))).alias("_at"))
    order = Window.partitionBy("_at.part").orderBy("_at.extra", "_id", "text")
    found = dealt.select("doc_id", "text", *carry, "_at", *[F.lead(c).over(order).alias(f"next_{c}") for c in ("text", *carry)])
    return found.filter("_at.extra = 0").drop("_at")


def compare(docs: DataFrame, **band: float) -> DataFrame:
    """Fingerprints of documents, of their edited texts, and their likeness to those and to the next document's.

    The edited text is the text with its last floor(n_chars / 2) code points replaced by the first as many (or
    all) of the next document. Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next. Null and empty texts have no terms; see `with_next` for ties and repeated rows.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    made = Fingerprints(saved(lexicon(rows, **band), "imatch-lexicon"))
    # in steps: an expression that is used often is a column of its own, and so evaluated once
    own = rows.withColumn("terms", made.terms(F.col("text"))).select("doc_id", "text", made.hashes(F.col("terms")).alias("own"))
    both = with_next(own, carry=("own",))
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(F.col("next_text"), F.lit(1), half))
    wide = both.select("doc_id", F.length("text").cast("long").alias("n_chars"), edited.alias("edited"), "own", "next_own")
    wide = wide.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), made.terms(F.col("edited")).alias("terms"), "own", "next_own")
    wide = wide.withColumn("edited_own", made.hashes(F.col("terms")))
    return wide.select("doc_id", "n_chars", "edited_sha256", made.written(F.col("own")).alias("fingerprint"), made.written(F.col("edited_own")).alias("edited_fingerprint"), made.likeness(F.col("own"), F.col("edited_own")).alias("near_edited"), made.likeness(F.col("own"), F.col("next_own")).alias("near_next"))
