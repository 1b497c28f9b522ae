import random

import numpy as np

from cellwise.llm import reading as r

FUNCTION = "the of and to is was that with from had".split()
LEVELS = {
    g: [
        f"{p}{s}" for p in ("ba", "do", "ki", "lu", "me", "ny")[:6] for s in (
            f"l{chr(96 + g)}t",
            f"m{chr(96 + g)}n",
            f"r{chr(96 + g)}s",
            f"v{chr(96 + g)}d"
        )
    ] for g in (1, 2, 3, 4)
}


def text(g, rng, n=80):
    words = [
        rng.choice(FUNCTION) if rng.random() < 0.4 else rng.choice(
            LEVELS[g if rng.random() < 0.85 else min(4, max(1, g + rng.choice((-1, 1))))]
        ) for _ in range(n)
    ]
    return " ".join(words).capitalize() + "."


def test_prose():
    assert r.prose_words(None) == r.prose_words("") == r.prose_words("see table") == []
    assert r.prose_words("| the | of |\n| --- | --- |\n" * 20) == []
    assert r.prose_words("Die Kunden zahlten für das Glas und die Kosten lagen unter dem Wert von 2001 im Jahr") == []
    assert len(r.prose_words("<p>The price of the glass was low and that is all there is to it for now.</p>\n| a | b |")) == 17


def test_acquisition_is_the_median_grade():
    got = r.acquisition(np.array([[10.0, 0, 0, 0], [0, 0, 0, 3], [5, 5, 5, 5]]), np.array([10.0, 10, 10, 10]))
    assert np.allclose(got, [1.0, 4.0, 2.5])


def test_levels_on_held_out_texts(spark):
    rng = random.Random(2)
    docs = [(i, text(1 + i % 4, rng)) for i in range(400)]
    ratings = [
        (i, f"r{k}", min(4, max(1, 1 + i % 4 + (1 if rng.random() < 0.05 else 0)))) for i in range(0, 200) for k in range(1 + i % 2)
    ] + [(0, "r0", 1), (1, "r9", None), (None, "r", 2)]
    extra = [
        (900, None),
        (901, "  "),
        (902, "TODO"),
        (903, "| the | of |\n" * 30),
        (904, "Les clients ont payé pour la céramique et le résultat est monté dans le cours de cette année sur les coûts"),
        (905, docs[3][1] * 400),
        (906, docs[3][1])
    ]
    d = spark.createDataFrame(docs + extra, "doc_id bigint, text string").selectExpr("*", "9 as grade", "'x' as word", "1 as band")
    m = spark.createDataFrame(ratings, "doc_id bigint, rater string, grade int").selectExpr("*", "'y' as text")
    got = {x["doc_id"]: x["band"] for x in r.levels(d, m).collect()}
    assert not {900, 901, 902, 903, 904} & set(got)
    assert got[905] == got[906] == 4
    right = [got[i] == 1 + i % 4 for i in range(200, 400)]
    assert np.mean(right) > 0.95


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "The price of the glass was low and that is all there is to it for now.")], "doc_id bigint, text string")
    m = spark.createDataFrame([], "doc_id bigint, rater string, grade int")
    assert r.levels(d, m).count() == 0
    assert r.levels(d.limit(0), spark.createDataFrame([(1, "a", 2)], "doc_id bigint, rater string, grade int")).count() == 0
