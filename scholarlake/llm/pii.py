"""Personal data: pattern spans, and information-theoretic sanitisation of the words that reveal them.

Entities are the values that the patterns find, and the domains of e-mail addresses, which many texts share. The corpus tells how strongly a word reveals an entity:
pointwise mutual information over texts, PMI(w; e) = log(p(w, e) / (p(w) p(e))), where w and e occur
together if a text holds both, wherever they stand. What was seen in few texts is known less surely, so w counts
as if it stood in half a text more. Its share of the entity's information content, PMI / -log p(e),
is the disclosure: 1 means that whoever reads w knows e. Words at or above `remove` go, those at or above
`generalise` become the label of a class that they belong to: a name, an acronym, a compound or a word.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholarlake.llm.common import map_arrow, saved, texts_of

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Bits of the filter of words that are worth counting: a table of this fixed size, whatever the corpus.
FILTER_BITS = 22


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """From each @ outwards: the local part is the run before it, so a long text without one costs nothing."""
    last = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > last and _LOCAL.match(text[start - 1]):
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            last = m.end()
            at = text.find("@", last)
        else:
            at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, index of kind, end) of every match that passes its test, in order."""
    found = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
    found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= sum(c.isascii() and c.isdigit() for c in m[0]) <= 15]
    return sorted(found)


def entity(kind: int, value: str) -> str:
    """A found value in the form in which two mentions are the same."""
    return f"{KINDS[kind]}:{value.lower() if kind < 2 else re.sub('[^0-9]', '', value)}"


def entities(kind: int, value: str) -> list[str]:
    """What a found value tells: itself, and of an e-mail address the domain."""
    own = entity(kind, value)
    return [own, f"domain:{own.rpartition('@')[2]}"] if kind == 0 else [own]


def class_of(word: str) -> str:
    """The label of the more general class that stands for a word, by its shape."""
    w = word.strip(".,;:!?()[]{}\"'*#%$&|<>=+-_")
    if "-" in w or "_" in w or "/" in w:
        return "<COMPOUND>"
    if w.isupper():
        return "<ACRONYM>"
    return "<NAME>" if w[:1].isupper() else "<WORD>"


def term(word: str) -> str:
    """A word as a term: lower case, without marks at its ends; short ones and numbers tell nothing and are ''."""
    t = word.lower().strip(".,;:!?()[]{}\"'*#%$&|<>=+-_")
    return t if len(t) >= 4 and not any(c.isdigit() for c in t) else ""


def words_around(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[str, int, int]]:
    """(term, start, end) of all words of a text that overlap no span."""
    if not spans:
        return []
    words = [(m.start(), m.end()) for m in _WORD.finditer(text)]
    starts = np.array([w[0] for w in words])
    taken = np.zeros(len(words), bool)
    for s, _, e in spans:
        taken[max(int(np.searchsorted(starts, s, "right")) - 1, 0) : int(np.searchsorted(starts, e, "left"))] = True
    return [(t, a, b) for (a, b), hit in zip(words, taken.tolist(), strict=True) if not hit and (t := term(text[a:b]))]


def find(docs: DataFrame, doubt: float = 0.5, generalise: float = 0.9, remove: float = 0.98, min_information: float = 1.0) -> DataFrame:
    """All spans of every whole text: (doc_id, text_key, base, terms).

    base is array<struct<start,kind,end>> in order (kind: its index in KINDS), terms array<struct<start,end,term,disclosure>>.
    A word of a text is a term span if it reveals an entity of that text, however far away: its disclosure is at
    least `generalise`. PMI is smoothed: a word counts as if `doubt` texts more had it, without the entity, so what
    was seen once is generalised and only what was seen often can reach `remove`. An entity of one text is judged
    too: by the words that hardly any other text has.
    Counts are over different texts, so copies of one page are one piece of evidence; an entity that carries less
    than `min_information` nats is public. Null texts are empty and have no spans; repeated rows have the same
    spans each; columns other than doc_id and text are ignored.
    """
    kind_of_id = dict(docs.dtypes)["doc_id"]

    def first(batch: pa.RecordBatch) -> pa.RecordBatch:
        base, who, near, starts, ends, keys = [], [], [], [], [], []
        for t in texts_of(batch):
            spans = base_spans(t)
            base.append([{"start": s, "kind": k, "end": e} for s, k, e in spans])
            who.append(sorted({x for s, k, e in spans for x in entities(k, t[s:e])}))
            around = words_around(t, spans)
            near.append(" ".join(x for x, _, _ in around))
            starts.append([s for _, s, _ in around])
            ends.append([e for _, _, e in around])
            keys.append(hashlib.blake2b(t.encode("utf-8", "replace"), digest_size=16).digest())
        one = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
        places = [pa.array(x, pa.list_(pa.int32())) for x in (starts, ends)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(keys, pa.binary()), pa.array(base, pa.list_(one)), pa.array(who, pa.list_(pa.string())), pa.array(near, pa.string()), *places], names=["doc_id", "text_key", "base", "entities", "near", "starts", "ends"])

    texts = docs.select("doc_id", "text")
    seen = saved(map_arrow(texts, first, f"doc_id {kind_of_id}, text_key binary, base array<struct<start:int,kind:int,end:int>>, entities array<string>, near string, starts array<int>, ends array<int>"), "pii-seen")
    told_in = F.size("entities") > 0
    total = float(max(seen.select("text_key").distinct().count(), 1))
    # one row for each different text with entities: its words are one string without repeats, and a number stands for it from here on
    each = seen.filter(told_in).select("text_key", "entities", F.array_join(F.array_distinct(F.split("near", " ")), " ").alias("words"))
    each = each.groupBy("text_key").agg(F.first("entities").alias("entities"), F.first("words").alias("words"))
    each = saved(each.withColumn("text", F.monotonically_increasing_id()), "pii-texts")
    held = each.select("text", F.explode("entities").alias("entity"))
    of_entity = saved(held.groupBy("entity").agg(F.count("*").alias("n_entity"), F.min("text").alias("_only")), "pii-entities")
    # entities of one and the same text are equal in all that follows: one stands for them, so a list of many is not multiplied
    alone = of_entity.filter("n_entity = 1").groupBy(F.col("_only").alias("text")).agg(F.min("entity").alias("entity")).select("text", "entity", F.lit(1).cast("long").alias("n_entity"))
    shared = held.join(of_entity.filter("n_entity > 1").select("entity", "n_entity"), "entity").select("text", "entity", "n_entity")
    held = saved(alone.unionByName(shared), "pii-held")
    information = F.log(F.lit(total) / F.col("n_entity"))
    disclosure = lambda n_both, n_term: F.when(information >= min_information, F.log(n_both * total / ((n_term + doubt) * F.col("n_entity"))) / information)
    words = each.filter("words <> ''").select("text", F.explode(F.split("words", " ")).alias("term"))
    around = words.groupBy("term").agg(F.count("*").alias("n_around"))
    # a word is in as many texts as it is in beside entities, or in more, and beside e in as many as e is or in fewer: what already falls short of the threshold goes
    pairs = words.join(around, "term").join(held, "text").filter(disclosure(F.least("n_around", "n_entity"), F.col("n_around")) >= generalise)
    pairs = saved(pairs.select("text", "entity", "term", "n_entity", "n_around"), "pii-pairs")
    together = pairs.groupBy("entity", "term").agg(F.count("*").alias("n_both"), F.max("n_entity").alias("n_entity"), F.max("n_around").alias("n_around"))
    together = saved(together.filter(disclosure(F.col("n_both"), F.col("n_around")) >= generalise).drop("n_around"), "pii-together")
    # how often the words of these pairs occur at all: one more pass over the texts
    bits = _filter(together.select("term"))

    def second(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        keys, terms = [], []
        known: dict[str, str] = {}
        for t in set(texts_of(batch)) if bits is not None else ():
            found = set()
            for w in set(t.split()):
                x = known.get(w)
                if x is None:
                    x = term(w)
                    x = known[w] = x if x and bits[_slot(x)] else ""
                if x:
                    found.add(x)
            if found:
                keys.append(hashlib.blake2b(t.encode("utf-8", "replace"), digest_size=16).digest())
                terms.append(" ".join(sorted(found)))
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(terms, pa.string())], names=["text_key", "terms"]) if keys else None

    # a row a text, its words as one string: a key beside every word would be most of what is shuffled
    different = map_arrow(texts, second, "text_key binary, terms string").groupBy("text_key").agg(F.first("terms").alias("terms"))
    of_term = different.select(F.explode(F.split("terms", " ")).alias("term")).groupBy("term").agg(F.count("*").alias("n_term"))
    told = together.join(of_term, "term").withColumn("disclosure", disclosure(F.col("n_both"), F.col("n_term"))).filter(F.col("disclosure") >= generalise).select("entity", "term", "disclosure")
    # back to the words: of each text those that its entities are told by, the strongest once. The pairs hold all of them, so no entity's words meet all of its texts
    of_text = pairs.select("text", "entity", "term").join(told, ["entity", "term"]).groupBy("text", "term").agg(F.max("disclosure").alias("d"))
    of_text = of_text.groupBy("text").agg(F.map_from_entries(F.collect_list(F.struct("term", "d"))).alias("_told"))
    of_text = of_text.join(each.select("text", F.col("text_key").alias("_key")), "text").select("_key", "_told")
    none = F.array().cast("array<struct<start:int,end:int,term:string,disclosure:double>>")
    some = seen.filter(told_in).join(of_text, F.col("text_key") == F.col("_key"), "left")
    near = F.arrays_zip(F.split("near", " ").alias("term"), F.col("starts").alias("start"), F.col("ends").alias("end"))
    places = F.transform(F.filter(near, lambda w: F.map_contains_key("_told", w["term"])), lambda w: F.struct(w["start"].alias("start"), w["end"].alias("end"), w["term"].alias("term"), F.element_at("_told", w["term"]).alias("disclosure")))
    some = some.select("doc_id", "text_key", "base", F.coalesce(F.array_sort(places), none).alias("terms"))
    return some.unionByName(seen.filter(~told_in).select("doc_id", "text_key", "base", none.alias("terms")))


def _slot(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode("utf-8", "replace"), digest_size=4).digest(), "little") & ((1 << FILTER_BITS) - 1)


def _filter(terms: DataFrame) -> np.ndarray | None:
    """The slots that these terms fill, of 2 ** FILTER_BITS: half a megabyte, whatever their number. None: no terms.

    A filter that is full lets all words through: then the join drops the rest.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = np.zeros(1 << FILTER_BITS, bool)
        for batch in batches:
            mine[[_slot(t) for t in batch.column("term").to_pylist()]] = True
        if mine.any():
            packed = np.packbits(mine).reshape(-1, 4096)
            full = np.flatnonzero(packed.any(1))
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([packed[i].tobytes() for i in full], pa.binary())], names=["block", "bits"])

    def union(key: tuple, group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(4096, np.uint8)
        for batch in group:
            for b in batch.column("bits").to_pylist():
                bits |= np.frombuffer(b, np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([bits.tobytes()], pa.binary())], names=["block", "bits"])

    blocks = terms.mapInArrow(each, "block int, bits binary").groupBy("block").applyInArrow(union, "block int, bits binary").collect()
    if not blocks:
        return None
    packed = np.zeros((1 << FILTER_BITS) // 8, np.uint8).reshape(-1, 4096)
    for row in blocks:
        packed[row["block"]] = np.frombuffer(row["bits"], np.uint8)
    return np.unpackbits(packed.reshape(-1)).astype(bool)


def sanitise(docs: DataFrame, **options: float) -> DataFrame:
    """Whole texts without personal data: (doc_id, text).

    Base spans become <EMAIL>, <IP>, <CARD>, <PHONE>; words that reveal them become the label of their class (<NAME>, <ACRONYM>,
    <COMPOUND>, <WORD>), or go at a disclosure of at least `remove` (0.98). Where spans overlap, the first counts and the later one only from its end on.
    Rows come back as they were, repeated ones too; null texts as empty. Other columns are not carried.
    """
    least = options.get("remove", 0.98)
    found = find(docs, **options)
    kind_of_id = dict(docs.dtypes)["doc_id"]
    # a row per different text: found has a row per row of docs
    found = found.dropDuplicates(["doc_id", "text_key"]).withColumnsRenamed({"doc_id": "_id", "text_key": "_key"})
    keyed = docs.select("doc_id", "text")

    def key(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys = [hashlib.blake2b(t.encode("utf-8", "replace"), digest_size=16).digest() for t in texts_of(batch)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.array(keys, pa.binary())], names=["doc_id", "text", "text_key"])

    keyed = map_arrow(keyed, key, f"doc_id {kind_of_id}, text string, text_key binary")
    rows = keyed.join(found, keyed.doc_id.eqNullSafe(F.col("_id")) & (keyed.text_key == F.col("_key")), "left")

    def rewrite(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for t, base, terms in zip(texts_of(batch), batch.column("base").to_pylist(), batch.column("terms").to_pylist(), strict=True):
            spans = sorted([(b["start"], b["end"], f"<{KINDS[b['kind']].upper()}>") for b in base or ()] + [(x["start"], x["end"], "" if x["disclosure"] >= least else class_of(t[x["start"] : x["end"]])) for x in terms or ()])
            parts, at = [], 0
            for s, e, label in spans:
                if s >= at:
                    parts += [t[at:s], label]
                at = max(at, e)
            out.append("".join(parts) + t[at:])
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], names=["doc_id", "text"])

    return map_arrow(rows.select("doc_id", "text", "base", "terms"), rewrite, f"doc_id {kind_of_id}, text string")


def digest(found: DataFrame) -> DataFrame:
    """Counts and hashes of what `find` gives: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_terms."""
    names = F.array(*map(F.lit, KINDS))
    said = lambda kind, x: F.concat_ws(":", kind, x["start"].cast("string"), x["end"].cast("string"))
    base = F.transform("base", lambda x: said(F.get(names, x["kind"]), x))
    both = F.array_sort(F.concat(F.transform("base", lambda x: F.struct(x["start"].alias("s"), x["kind"].alias("k"), x["end"].alias("e"))), F.transform("terms", lambda x: F.struct(x["start"].alias("s"), F.lit(len(KINDS)).alias("k"), x["end"].alias("e")))))
    every = F.transform(F.array_distinct(both), lambda x: F.concat_ws(":", F.get(F.array(*map(F.lit, (*KINDS, TERM))), x["k"]), x["s"].cast("string"), x["e"].cast("string")))
    counted = lambda i: F.size(F.filter("base", lambda x: x["kind"] == i)).cast("long")
    counts = [counted(i).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(F.array_join(base, ","), 256).alias("base_sha256"), F.array_join(every, ",").alias("spans"), F.size("terms").cast("long").alias("n_terms"))
