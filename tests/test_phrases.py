"""Rules of phrases: the automaton against one expression for each phrase."""

import random
import re

from scholarlake.operators import phrases as PH


def plain(text, rules):
    out = []
    for i, (_, phrases) in enumerate(rules.phrases):
        if rules.words:
            hit = any(re.search(rf"(?<![a-z0-9]){re.escape(p)}(?:s|es)?(?![a-z0-9])", text) for p in phrases)
        else:
            hit = any(p in text for p in phrases)
        out += [i] if hit else []
    return out


def test_automaton_finds_what_expressions_find():
    rnd = random.Random(2)
    pieces = [p for t in (PH.TOPICS, PH.INTENTS) for ps in t.values() for p in ps]
    tables = [PH.Rules.of(PH.TOPICS, words=True), PH.Rules.of(PH.INTENTS), PH.Rules.of(PH.SUB_INTENTS)]
    for _ in range(3000):
        text = "".join(rnd.choice([rnd.choice(pieces), rnd.choice(["s", "es", "x", " ", "-", "é", "9", "; "])]) for _ in range(rnd.randrange(1, 7)))
        for rules in tables:
            assert PH.places(text, rules) == plain(text, rules), text


def test_columns(spark):
    rows = [("storage coverage", None, None), ("RAGs and diffusion  models", "RAG retrieval optimization", None), ("Multi—Agent", "multi-agent systems", None), ("models", None, "low_information"), (None, None, "empty"), ("cs.CL", None, "category"), ("of agents", None, "ngram"), ("Learning to rank with trees", None, "title"), ("graph trees", None, None), ("2401.00001", None, "id")]
    df = spark.createDataFrame([(k, r[0]) for k, r in enumerate(rows)], "k int, label string")
    got = {r.k: (r.topic, r.kind) for r in df.select("k", PH.topic(df.label).alias("topic"), PH.label_kind(df.label).alias("kind")).collect()}
    assert got == {k: r[1:] for k, r in enumerate(rows)}
    asked = spark.createDataFrame([(0, "Summarize the  Main Idea in a table"), (1, "hello"), (2, None)], "k int, q string")
    main = asked.withColumn("m", PH.main_intent(asked.q))
    assert {r.k: (r.m, r.s) for r in main.select("k", "m", PH.sub_intents(main.q, main.m).alias("s")).collect()} == {0: ("paper_overview", ["paper_overview", "table_lookup"]), 1: ("other", ["evidence_seeking"]), 2: ("other", ["evidence_seeking"])}
