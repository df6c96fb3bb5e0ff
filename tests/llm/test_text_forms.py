"""Fill-in-the-middle, licence notices and spelling variants against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest

from scholarlake.llm import fim, licenses, queries, variants
from scholarlake.llm.common import table
from tests.oracle import compare, duck

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
EMPTY = hashlib.sha256(b"").hexdigest()


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_fim(key, text):
    text = text or ""
    units = UNIT.findall(text)
    n, digest = len(units), sha(f"42:{'' if key is None else key}")
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return key, n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 80:
        return key, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return key, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.fixture(scope="module")
def marked(spark, sf_dir, odd_docs):
    texts = ["a\x00b c", "<P> a b", "x <P y < S> z <S <M w", "é ü 日本 \n" * 5, " a b\v c d", "<M>", "<<P", "trailing  \t ", "\n"] * 4
    more = spark.createDataFrame(list(enumerate(texts, 1_000_000)), "doc_id long, text string")
    return table(spark, sf_dir, "documents").select("doc_id", "text").unionByName(odd_docs.select("doc_id", "text")).unionByName(more).cache()


def test_fim_is_that_of_plain_python(marked):
    rows = marked.collect()
    got = sorted(map(tuple, fim.transform(marked).collect()), key=str)
    assert got == sorted((plain_fim(r.doc_id, r.text) for r in rows), key=str)
    assert {g[2] for g in got} == {"plain", "psm", "spm"}


def test_fim_comes_back(marked):
    made = fim.transform(marked.withColumn("k", marked.text), carry=("k",))
    assert made.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "k"]
    back = fim.restore(made.drop("prefix_chars", "middle_chars", "n"), carry=("k",)).collect()
    assert all(r.text == (r.k or "") for r in back) and len(back) == marked.count()


def test_fim_of_other_recipes(spark):
    docs = spark.createDataFrame([(i, f"w{i} one's 'two' three") for i in range(300)], "doc_id long, text string")
    made = fim.transform(docs, fim.Recipe(percent=100, suffix_first=0, seed=7)).collect()
    assert {r.form for r in made} == {"psm"}
    assert fim.transform(docs, fim.Recipe(percent=0)).filter("form <> 'plain'").count() == 0
    quoted = fim.Recipe(prefix_mark="<'p'>", suffix_mark="<'s'>", middle_mark="<'m'>", percent=100)
    assert {r.text for r in fim.restore(fim.transform(docs, quoted), quoted).collect()} == {r.text for r in docs.collect()}
    with pytest.raises(ValueError, match="overlap"):
        fim.Recipe(prefix_mark="<<p>")


def test_fim_query(spark, sf_dir):
    compare(queries.op11_fill_in_middle(spark, sf_dir), queries.SQL["op11_fill_in_middle"], duck(sf_dir))


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def least_errors(words, n):
    best = None
    for i in range(len(words)):
        for j in range(i + 1, len(words) + 1):
            s = " ".join(words[i:j])
            if len(s) > len(n.text) + n.errors:
                break
            if len(s) >= len(n.text) - n.errors and s.startswith(n.text[: n.exact]):
                d = distance(s[n.exact :], n.text[n.exact :])
                if d <= n.errors and (best is None or d < best):
                    best = d
    return best


def edited(rnd, text, edits):
    t = list(text)
    for _ in range(edits):
        at, how = rnd.randrange(len(t)), rnd.randrange(3)
        t[at : at + (how < 2)] = [rnd.choice("abcdefg hij.")] if how else []
    return "".join(t)


def test_notices_within_their_edits(spark):
    rnd = random.Random(3)
    short = [n for n in licenses.NOTICES if len(n.text) < 40]
    search = licenses.searcher(tuple(short))
    for _ in range(250):
        n = rnd.choice(short)
        text = rnd.choice(["", "The Public, ", "mit "]) + edited(rnd, n.text, rnd.randrange(n.errors + 3)).title() + rnd.choice(["", " licence.", " " + n.text])
        words = licenses.WORD.findall(text.lower())
        count, found = licenses.places(text, search)
        got = {}
        for f in found:
            got[f["notice"]] = min(got.get(f["notice"], 99), f["errors"])
            span = text.lower()[f["start"] : f["end"]]
            assert least_errors(licenses.WORD.findall(span), short[f["notice"]]) == f["errors"] and words[f["word"]] == licenses.WORD.findall(span)[0]
        assert count == len(words)
        assert got == {i: e for i, m in enumerate(short) if (e := least_errors(words, m)) is not None}, text


def test_long_notices(spark):
    rnd = random.Random(4)
    search = licenses.searcher(licenses.NOTICES)
    for i, n in enumerate(licenses.NOTICES):
        for edits in {0, 1, n.errors}:
            words = licenses.WORD.findall(edited(rnd, n.text, edits).lower())
            window = " ".join(words)
            d = distance(window[n.exact :], n.text[n.exact :]) if window.startswith(n.text[: n.exact]) else 99
            found = [f["errors"] for f in licenses.places("Zum Anfang: " + window.upper().replace(" ", "\n * ") + " und weiter", search)[1] if f["notice"] == i]
            assert d > n.errors or (found and min(found) <= d)


PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


def plain_base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower().decode())
    places = sorted((i, label) for p, label in PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split())
    return len(words), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted({x for _, x in places}))


def test_licenses_base(spark, sf_dir, odd_docs):
    texts = ["MIT License MIT-License mit. LICENSE", "submit license", "mit licenses", "mit", "general public general public license license", "a" * 100_000 + " Mit License " * 500, "Straße MIT License é", "no MİT license"]
    more = spark.createDataFrame(list(enumerate(texts, 1_000_000)), "doc_id long, text string")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").unionByName(odd_docs.select("doc_id", "text")).unionByName(more).cache()
    got = licenses.digest(licenses.scan(docs)).collect()
    found = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got), key=str)
    assert found == sorted(((r.doc_id, *plain_base(r.text)) for r in docs.collect()), key=str)
    for r in got:
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1 and (r.score > 0) == (r.labels != "")
    by = {r.doc_id: r for r in got}
    assert by[1_000_002].labels == "mit" and by[1_000_002].n_base == 0 and by[1_000_002].spans == "mit:0:12:1"
    assert by[1_000_005].n_base == 500 and by[2].spans == "" and by[1_000_001].labels == ""
    assert queries.op12_licenses(spark, sf_dir).count() == table(spark, sf_dir, "documents").count()


def one_edit(a, b):
    a, b = sorted((a, b), key=len)
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def test_tries_find_all_pairs():
    rnd = random.Random(1)
    for _ in range(150):
        words = sorted({"".join(rnd.choice("abé") for _ in range(rnd.randrange(6))) for _ in range(rnd.randrange(60))})
        assert variants.one_edit_pairs(words) == {(a, b) for a in words for b in words if a < b and one_edit(a, b)}
    long = ["x" * 50_000, "x" * 49_999, "x" * 49_999 + "y"]
    assert len(variants.one_edit_pairs(long)) == 3


def plain_words(rows):
    counts = Counter()
    for i, t in rows:
        for w in re.findall(r"[A-Za-zÀ-ÿ]+", t or ""):
            w = w.encode().lower().decode()
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += len(w) >= 6
    return {w: n for w, n in counts.items() if n >= 5}


def plain_variants(counts, ratio=5):
    near = {w: {x for x in counts if abs(len(x) - len(w)) < 2 and x != w and one_edit(x, w)} for w in counts}
    best = {w: min(s, key=lambda x: (-counts[x], x)) for w, s in near.items() if s}
    form = {w: b for w, b in best.items() if counts[b] >= ratio * counts[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w), root(w), n, len(near[w]), counts.get(form.get(w))) for w, n in counts.items())


def test_variants_are_those_of_plain_python(spark):
    rnd = random.Random(2)
    base = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randrange(5, 9))) for _ in range(40)]
    texts = [" ".join(edited(rnd, w, rnd.random() < 0.3) for w in rnd.choices(base, weights=range(1, 41), k=80)) for _ in range(60)]
    # chains of forms, ties of forms, and what the other letters do
    texts += ["roota0 " * 1, "chainone " * 125, "chainonex " * 25, "chainonexy " * 5, "tiesaa " * 5, "tiesab " * 30, "tiesac " * 30, "Übermut×naïve übermut Straße " * 5]
    docs = spark.createDataFrame([*enumerate(texts), (None, "nothing nothing nothing nothing nothing"), (1, None), (2, "")], "doc_id long, text string")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = plain_variants(plain_words(rows))
    found = {}
    for most in (variants.MOST, 3):  # 3: nearly all groups are halved until they end
        found = variants.variants(variants.words(docs), most=most)
        assert sorted((tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in found.collect()), key=lambda r: r[0]) == want
    by = {r.word: r for r in found.collect()}
    assert by["chainonexy"].root == "chainone" and by["tiesaa"].form == "tiesab"


def test_variants_of_odd_tables(spark, odd_docs, no_docs):
    assert variants.variants(variants.words(no_docs)).count() == 0
    got = {r.word: r for r in variants.variants(variants.words(odd_docs)).collect()}
    assert got["report"].n == 20_000 and got["report"].form is None and got["report"].root == "report"
    words = spark.createDataFrame([("", 5), (None, 7), ("a", 50), ("b", 5), ("ab", 5)], "word string, n long")
    assert {r.word: (r.form, r.n_near) for r in variants.variants(words).collect()} == {"a": (None, 2), "b": ("a", 2), "ab": ("a", 2)}


def test_variants_query(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").collect()]
    got = queries.op13_spelling_variants(spark, sf_dir).collect()
    assert sorted(tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in got) == plain_variants(plain_words(rows))


def test_odd_rows_of_text_forms(odd_docs, no_docs):
    made = {r.doc_id: r for r in fim.digest(odd_docs).collect()}
    assert made[2].n == 0 and made[2].form == "plain" and made[2].output_sha256 == made[3].restored_sha256 == EMPTY
    assert fim.digest(odd_docs).count() == odd_docs.count() and fim.digest(no_docs).count() == 0
    seen = {r.doc_id: r for r in licenses.digest(licenses.scan(odd_docs)).collect()}
    assert seen[2].n_words == 0 and seen[2].first_word is None and seen[5].n_words == 160_000 and seen[7].labels == ""
    assert licenses.digest(licenses.scan(no_docs)).count() == 0
