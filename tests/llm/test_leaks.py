import random

import pytest

from cellwise.llm import leaks as k

R = random.Random(5)
VOCAB = [f"{a}{b}{c}" for a in "bdfgklmnprst" for b in "aeiou" for c in ("ck", "st", "n", "rm", "lt")]


def passage(n=60):
    return " ".join(R.choice(VOCAB) for _ in range(n))


ITEMS = [(i, passage()) for i in range(20)]


def test_words_see_through_markup():
    assert k.words("The <b>red</b> *box*, Coope-\nrative[2] 1,000​ ｆｕｌｌ \\n сost") == ["the", "red", "box", "cooperative", "1,000", "full", "cost"]
    assert k.words(None) == [] and k.words("") == []


def test_alignment_counts_the_covered_words():
    p = [str(i) for i in range(30)]
    assert k.align(p, ["x"] * 5 + p[5:25] + ["y"] * 9) == (20, 0)
    assert k.align(p, p[:10] + ["new", "words", "put", "in"] + p[10:]) == (30, 0)
    assert k.align(p, [*p[:10], "changed", *p[11:]]) == (29, 1)
    assert k.align([], p) == (0, 0) and k.align(p, []) == (0, 0)


def docs():
    out, want = [], set()
    for i, text in ITEMS:
        w = text.split()
        noisy = [x + x[-1] if j % 11 == 5 else x for j, x in enumerate(w)]
        for j, (body, hit) in enumerate(
            (
                (w, True),
                (noisy, True),
                (w[10:40], True),
                (w[:8], False),
                (w[5:30:2], False),
                (passage().split(), False),
                (w[:25] + ["(a", "remark", "within)"] + w[25:], True)
            )
        ):
            d = i * 100 + j
            out.append((d, (passage(80) + " " + " <i>".join(body) + ". " + passage(50)).upper()))
            if hit:
                want.add((d, i))
    out += [(9001, None), (9002, ""), (9003, " ".join(passage(60) for _ in range(300)) + " " + ITEMS[0][1]), (9004, out[0][1])]
    return out, want | {(9003, 0), (9004, 0)}


@pytest.mark.parametrize("chars", [10**6, 2000])
def test_found_in_one_block_and_in_several(spark, chars):
    rows, want = docs()
    d = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as item_id", "'x' as passage", "2 as at")
    items = spark.createDataFrame(
        [*ITEMS, (98, None), (99, "two words")],
        "item_id bigint, passage string"
    ).selectExpr("*", "0 as doc_id", "'y' as text")
    got = {(r["doc_id"], r["item_id"]) for r in k.leaks(d, items, block_chars=chars).collect()}
    assert got == want


def test_empty_tables(spark):
    d = spark.createDataFrame(docs()[0], "doc_id bigint, text string")
    items = spark.createDataFrame(ITEMS, "item_id bigint, passage string")
    assert k.leaks(d.limit(0), items).count() == 0 and k.leaks(d, items.limit(0)).count() == 0


@pytest.mark.parametrize("chars", [10**6, 1500])
def test_passage_under_many_items(spark, chars):
    same, base = passage(), passage().split()
    close = [" ".join(base[:i] + [f"edit{chr(97 + i // 10)}"] + base[i + 1 :]) for i in range(5, 55, 10)]  # five near copies share most n-grams
    items = spark.createDataFrame(
        [(1, same), (2, same), (3, f"<b>{same}</b>"), (4, same.upper()), (5, same), (5, ITEMS[0][1]), *((10 + i, p) for i, p in enumerate(close))],
        "item_id bigint, passage string"
    )
    d = spark.createDataFrame(
        [(1, f"{passage(30)} {same} {passage(30)}"), (2, ITEMS[0][1]), (3, " ".join(base)), (4, " ".join(base[:30]))],
        "doc_id bigint, text string"
    )
    got = {(r["doc_id"], r["item_id"]) for r in k.leaks(d, items, block_chars=chars).collect()}
    assert got == {(1, i) for i in range(1, 6)} | {(2, 5)} | {(j, 10 + i) for j in (3, 4) for i in range(5)}


def test_excerpt_with_sentences_left_out(spark):
    p = passage(96).split()
    cut = [w for i in range(0, 96, 24) for w in p[i : i + 12]]  # every second stretch of 12 words is left out
    assert k.align(p, cut) == (48, 0)
    assert sum(k.align(p, p[:4] + p[90:])) == 6  # runs too short for their gap aren't joined
    d = spark.createDataFrame(
        [(1, f"{passage(30)} {' '.join(cut)} {passage(30)}"), (2, " ".join(w for i in range(0, 96, 12) for w in p[i : i + 2]))],
        "doc_id bigint, text string"
    )
    items = spark.createDataFrame([(7, " ".join(p))], "item_id bigint, passage string")
    assert [tuple(r)[:2] for r in k.leaks(d, items).collect()] == [(1, 7)]


def test_few_seeds_make_a_candidate(spark):
    p = passage(96).split()
    part = ["x" if i % 10 in (3, 6, 9) else w for i, w in enumerate(p[:40])]  # four whole seeds
    kept, changed = k.align(p, part)
    assert kept + changed >= len(p) / 3 and kept >= k.KEPT * (kept + changed)
    d = spark.createDataFrame([(1, f"{passage(30)} {' '.join(part)} {passage(30)}")], "doc_id bigint, text string")
    assert [r["item_id"] for r in k.leaks(d, spark.createDataFrame([(7, " ".join(p))], "item_id bigint, passage string")).collect()] == [7]


def test_common_words_bound_the_alignment():
    for _ in range(40):
        p, t = ([R.choice("abcdefgh") for _ in range(n)] for n in (20, 30))
        best = [0] * (len(t) + 1)
        for w in p:
            row = [0]
            for j, x in enumerate(t):
                row.append(best[j] + 1 if w == x else max(row[j], best[j + 1]))
            best = row
        assert k.common(p, t) == best[-1] >= k.align(p, t)[0]
    assert k.common([], ["a"]) == k.common(["a"], []) == 0


def test_short_passages_found_whole(spark):
    items = spark.createDataFrame([(n, " ".join(VOCAB[50 * n : 50 * n + n])) for n in range(1, 6)], "item_id bigint, passage string")
    d = spark.createDataFrame(
        [(n, f"{passage(30)} {' '.join(VOCAB[50 * n : 50 * n + n])}. {passage(30)}") for n in range(1, 6)],
        "doc_id bigint, text string"
    )
    assert sorted((r["doc_id"], r["item_id"]) for r in k.leaks(d, items).collect()) == [(3, 3), (4, 4), (5, 5)]


@pytest.mark.parametrize("n", [1, 4, 50])
def test_one_passage_in_any_number_of_items(spark, n):
    same = passage()
    items = spark.createDataFrame([(i, same) for i in range(n)], "item_id bigint, passage string")
    d = spark.createDataFrame([(1, f"{passage(30)} {same}"), (2, passage(90))], "doc_id bigint, text string")
    assert sorted((r["doc_id"], r["item_id"]) for r in k.leaks(d, items).collect()) == [(1, i) for i in range(n)]


def test_wording_of_the_language_makes_no_candidate(spark):
    stock = "at the end of the year".split()
    p = passage(20).split() + stock
    d = spark.createDataFrame(
        [(i, f"{passage(10)} {' '.join(stock)} {passage(10)}") for i in range(200)] + [(900, " ".join(p[8:]))],
        "doc_id bigint, text string"
    )
    assert [r["doc_id"] for r in k.leaks(d, spark.createDataFrame([(7, " ".join(p))], "item_id bigint, passage string")).collect()] == [900]


def test_long_passage_is_aligned_in_two_rows():
    p = [str(i) for i in range(6000)]
    assert k.align(p, p[:3000] + p[3500:]) == (5500, 0)


def test_recall_against_brute_force(spark):
    """Every document against every passage by the alignment alone."""
    rows, _ = docs()
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]) for r in k.leaks(d, spark.createDataFrame(ITEMS, "item_id bigint, passage string")).collect()}
    want = set()
    for doc, text in rows:
        for item, p in ITEMS:
            a, b = k.words(p), k.words(text)
            if k.common(a, b) >= k.KEPT * k.COVERED * len(a):
                kept, changed = k.align(a, b)
                if kept + changed >= k.COVERED * len(a) and kept >= k.KEPT * (kept + changed):
                    want.add((doc, item))
    assert want and len(got & want) >= 0.9 * len(want)
