"""Topics and the concepts most like them, against all pairs."""

import random

from scholarlake.operators import likeness
from scholarlake.operators import profile as P
from scholarlake.plans import recommend as plans


def test_most_similar_of_all(spark, monkeypatch):
    rnd = random.Random(3)
    text = lambda: " ".join(rnd.choices([f"w{i}" for i in range(40)], weights=[40 / (i + 1) for i in range(40)], k=rnd.choice((0, 1, 2, 3, 5, 8, 13, 40))))
    rows = [(i, text()) for i in range(600)] + [(600, None), (None, "w1 w2")]
    rows += [(700 + i, rows[i][1]) for i in range(0, 100, 3)]
    words = {i: set((t or "").split()) for i, t in rows if i is not None}
    concepts = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    topics = spark.createDataFrame([r for r in rows if r[0] is None or r[0] % 7 == 0], "item_id long, text string")
    for least in (0.3, 0.55, 1.0):
        want = {}
        for i in words:
            if i % 7 == 0:
                like = [(round(len(words[i] & words[d]) / len(words[i] | words[d]), 6), -d) for d in words if d != i and words[i] | words[d]]
                like = max((x for x in like if x[0] >= least), default=None)
                want |= {i: (-like[1], like[0])} if like else {}
        for most, pairs in ((1 << 16, 1 << 20), (40, 300)):
            monkeypatch.setattr(P, "MOST_TOPICS", most)
            monkeypatch.setattr(likeness, "PAIRS", pairs)
            assert {r.item_id: (r.doc_id, r.similarity) for r in P.similar_topics(topics, concepts, least).collect()} == want


def test_titles_do_not_meet_in_a_join(spark, sf_dir):
    plan = plans.j11_topic_concepts(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan  # of their tokens, which brought long lists together again and again
