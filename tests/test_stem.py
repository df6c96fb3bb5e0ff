"""Stems against the rules in plain Python and against pairs of the published list."""

import random

from pyspark.sql import functions as F

from scholarlake.functions.stem import stems, with_stem
from scholarlake.operators.retrieval import postings
from scholarlake.sources.tables import table
from tests.plain_stem import stem

#: Words and stems of the published sample vocabulary.
PUBLISHED = """consign consign consigned consign consigning consign consignment consign consist consist consisted consist consistency consist consistent consist consistently consist
consisting consist consists consist consolation consol consolations consol consolatory consolatori console consol consoled consol consoles consol consolidate consolid consolidated consolid
consolidating consolid consoling consol consolingly consol consols consol consonant conson consort consort consorted consort consorting consort conspicuous conspicu conspicuously conspicu
conspiracy conspiraci conspirator conspir conspirators conspir conspire conspir conspired conspir conspiring conspir constable constabl constables constabl constance constanc constancy constanc
constant constant knack knack knackeries knackeri knacks knack knag knag knave knave knaves knave knavish knavish kneaded knead kneading knead knee knee kneel kneel kneeled kneel kneeling kneel
kneels kneel knees knee knell knell knelt knelt knew knew knick knick knif knif knife knife knight knight knightly knight knights knight knit knit knits knit knitted knit knitting knit knives knive
knob knob knobs knob knock knock knocked knock knocker knocker knockers knocker knocking knock knocks knock knopp knopp knot knot knots knot
cats cat datasets dataset distributions distribut methods method ablation ablat limitations limit baselines baselin does doe generate generat generously generous communities communiti
saying say cry cri by by happy happi dying die skies sky news news inning inning succeed succeed hoped hope hopping hop fitting fit falling fall national nation rationally ration
relational relat hopefulness hope adoption adopt rate rate hopeful hope yellow yellow toy toy""".split()


def test_published_stems(spark):
    words, want = PUBLISHED[::2], PUBLISHED[1::2]
    got = stems(spark, words)
    assert {w: g for w, g, x in zip(words, got, want, strict=True) if g != x} == {}
    assert [stem(w) for w in words] == want


def test_stems_are_those_of_the_rules(spark, sf_dir):
    rnd = random.Random(5)
    ends = "s ies ied sses us ed edly eed eedly ing ingly y ational tional enci anci ably ization ator alism ality fulness ousness iveness ivity bility ology logi li ative alize icate ical ful ness ment ement ion ent ance er ic e ll".split()
    made = {"".join(rnd.choice("aeiouybcdglmnrstwxz") for _ in range(rnd.randrange(1, 6))) + rnd.choice(ends) + rnd.choice(["", "", *ends]) for _ in range(6000)}
    made |= {"a", "by", "y", "yy", "ayy", "eyyye", "x-ray", "co_ed", "3rd", "é", "日本", "generalization", "communism", "arsenal", "2020s"}
    real = [r.token for r in postings(table(spark, sf_dir, "documents"), "doc_id", F.regexp_extract_all("text", F.lit("[a-z]+"), F.lit(0))).select("token").distinct().collect()]
    words = sorted(made | set(real))
    got = {r.token: r.stem for r in with_stem(spark.createDataFrame([(w,) for w in words], "token string")).collect()}
    assert {w: (got[w], stem(w)) for w in words if got[w] != stem(w)} == {}
    assert with_stem(spark.createDataFrame([(None, 1)], "token string, stem int")).collect() == [(None, None)]
