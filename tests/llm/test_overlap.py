import random
from collections import Counter

import numpy as np
import pytest

from cellwise.llm import overlap as o
from cellwise.llm import wording as w

LABELS = ["Bulk tolls", "Seed sales (in millions)", "2019", "Q4 2018", "Grand Total"]
SAME = {
    "if|ask|bulk tolls higher": [
        "Which year shows the highest Bulk tolls?",
        "Please answer: Where does BULK TOLLS reach its greatest amount, by period? ??",
        "» Name the line item with the largest Bulk tolls (7). (see table)",
        "Bulk  tolls: which entry has the biggest amount? Leave out totals.",
        "For which peirod is Bulk tolls the highest",
        "Name the year with the largest Bulk tlols.",
        "In what quarter did bulk tolls peak?",
        "Identify the row whose Bulk tolls are at their maximum.",
        "When were Bulk tolls at their top?",
        "What is the period of maximal bulk tolls, excluding subtotals?",
    ],
    "if|bulk tolls gt 5.0|ask|seed sales lower": [
        "Which row has the lowest Seed sales among those with Bulk tolls over 5?",
        "With Bulk tolls exceeding $5.00, find the smallest Seed sales.",
        "Seed sales: where are they least, given more than 5 in Bulk tolls?",
        "Considering only years in which Bulk tolls > 5, when do Seed sales reach the minimum?",
    ],
    "if|bulk tolls lte 1200.5|seed sales gte -3.0|ask": [
        "Find all years having Seed sales not below -3 and Bulk tolls no more than 1,200.50.",
        "What periods report Bulk tolls at most 1200.5 together with Seed sales of at least −3?",
        "List rows whose Bulk tolls do not exceed 1,200.5 and whose Seed sales are -3 or more",
        "Show the entries where Seed sales >= -3 and Bulk tolls <= 1200.50",
    ],
    "if|ask|2019 higher|q 4 2018 higher": [
        "Weighing 2019 against Q4 2018, which rows are undominated when higher is better?",
        "Which entries are not beaten on both Q4 2018 and 2019, if more is better?",
        "Which are Pareto-optimal when maximizing both 2019 and Q4 2018?",
        "Give the frontier of Q4 2018 and 2019 (greater is better)"
    ],
    "if|ask|bulk tolls higher|seed sales lower": [
        "Which rows trade off the highest Bulk tolls against the lowest Seed sales?",
        "Pareto rows with the most Bulk tolls and the fewest Seed sales"
    ],
}


@pytest.mark.parametrize("want", SAME)
def test_wordings(want):
    for q in SAME[want]:
        assert w.signature(q, lambda: LABELS) == want, q


@pytest.mark.parametrize(
    "q",
    [
        "Which year shows the lowest Bulk tolls?",
        "Which year shows the highest Seed sales?",
        "Take only years with Bulk tolls over 5. Which has the highest Bulk tolls?",
        "Which years have the highest Bulk tolls and Seed sales?",
        None,
        "",
        "free words"
    ]
)
def test_other_questions(q):
    assert w.signature(q, lambda: LABELS) != "if|ask|bulk tolls higher"


def test_thresholds_tell_questions_apart():
    of = lambda x: w.signature(f"Which rows have Bulk tolls over {x}?", lambda: LABELS)
    assert len({of(x) for x in ("99,999.12", "99999.14", "1000000.0001", "1000000.0002")}) == 4
    assert of("1,000.50") == of("$ 1000.5")


def test_measure_that_its_table_lacks():
    assert w.signature("Which year has the highest revenue?") == w.signature(
        "In which period was Revenue the greatest?"
    ) != w.signature("Which year has the highest cost?")
    assert w.signature("Which years have revenue above 5?") == w.signature("List the years with revenue of more than 5")


def test_large_numbers_are_told_apart():
    _, h = o._digests(np.zeros(5, int), np.array([1e15, 2e15, 5e16, -0.0, 0.0]))
    assert len({*h.tolist()}) == 5  # the two zeros are numbered
    assert len({*o._digests(np.arange(2), np.array([0.0, -0.0]))[1].tolist()}) == 1


def test_a_changed_number_changes_only_the_chunks_around_it():
    r = np.random.default_rng(1)
    h = np.sort(r.integers(0, 2**63, 400).astype(np.uint64))
    g = np.delete(h, 200)
    ends = lambda x: {*x[o.cuts(x, np.arange(len(x)), np.full(len(x), len(x)))].tolist()}
    assert len(ends(h) ^ ends(g)) <= o.WINDOW + 1 and len(ends(h)) > 100


def make(n, seed):
    r = random.Random(seed)
    rows, rid = [], 0
    tables = [
        [[f"item {i}", *(r.choice([str(r.randint(1, 99_999)), "", "n/a", "7"]) for _ in range(4))] for i in range(r.randint(1, 6))] for _ in range(n)
    ]
    for t in tables:
        for _ in range(4):
            rid += 1
            grid = [row[:] for row in t]
            for _ in range(r.randint(0, 3)):
                row = r.choice(grid)
                row[r.randint(1, 4)] = str(r.randint(100_000, 200_000))
            if r.random() < 0.5:
                r.shuffle(grid)
            if r.random() < 0.3:
                grid = [[f"$ {c[:-3]},{c[-3:]}" if c.isdigit() and len(c) > 3 and j else c for j, c in enumerate(row)] for row in grid]
            if r.random() < 0.3:
                grid = [list(x) for x in zip(*([["category", *"abcd"], *grid]))][1:]
            q = r.choice(["Which year shows the highest a?", "For which year is A the biggest?", "Which year shows the highest b?"])
            rows.append((rid, q, (["category", "a", "b", "c", "d"], grid), r.choice(["train", " TRAIN", "dev", "test", None, "other"])))
    rows += [
        (rid + 1, None, None, "train"),
        (rid + 2, None, None, "dev"),
        (rid + 3, "Which year shows the highest a?", (None, None), "test"),
        (rid + 4, "Which year shows the highest a?", ([], [None, []]), "train")
    ]
    return rows


def brute(rows):
    sig = {i: w.signature(q, lambda: [*(t and t[0] or [])[1:], *(r[0] for r in (t and t[1]) or [] if r)]) for i, q, t, _ in rows}
    split = {i: (s or "").strip().lower() for i, _, _, s in rows}
    nums = {
        i: Counter(
            float(c.strip('$ ').replace(',', '')) for row in (t and t[1]) or [] for c in (row or [])[1:] if c and c.strip("$ ,-").replace(",", "").isdigit()
        ) for i, _, t, _ in rows
    }
    out = set()
    for a in sig:
        for b in sig:
            if split[a] == "train" and split[b] in ("dev", "test") and sig[a] == sig[b]:
                n = max(sum(nums[a].values()), sum(nums[b].values()))
                if n == 0 or sum((nums[a] & nums[b]).values()) >= 0.75 * n:
                    out.add((min(a, b), max(a, b)))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_pairs_as_by_brute_force(spark, seed):
    rows = make(60, seed)
    df = spark.createDataFrame(
        rows,
        "rec_id bigint, question string, table struct<headers array<string>, rows array<array<string>>>, split string"
    ).selectExpr("*", "'x' as side", "1 as n", "array(1) as chunks")
    got = o.overlaps(df, "rec_id", "question", "table.headers", "table.rows", "split").collect()
    pairs = [(r["rec_id_a"], r["rec_id_b"]) for r in got]
    assert len(pairs) == len(set(pairs))
    assert set(pairs) == brute(rows)
    assert all(r["chunk_overlap"] >= o.AGREEMENT if r["agreement"] is None else 0 <= r["chunk_overlap"] <= r["agreement"] + 1e-6 for r in got)
    links = Counter(r[c] for r in got for c in ("train_id", "held_out_id"))
    linked = o.linked_classes(df, "rec_id", "question", "table.headers", "table.rows", "split").collect()
    assert {r["rec_id"]: r["n_links"] for r in linked} == {
        i: links.get(i, 0) for i, _, _, s in rows if (s or "").strip().lower() in ("train", "dev", "test")
    }
    per = Counter((r["split"], (r["held_out_id"]) % 2) for r in got)
    rep = o.report(
        df.selectExpr("*", "cast(rec_id % 2 as string) as source"),
        "rec_id",
        "question",
        "table.headers",
        "table.rows",
        "split",
        "source"
    ).collect()
    assert {(r["split"], int(r["source"])): r["n_pairs"] for r in rep} == per
    ids = lambda k, c: len({r[c] for r in got if (r["split"], r["held_out_id"] % 2) == k})
    assert all(
        (r["n_held_out"], r["n_train"]) == (
            ids((r["split"], int(r["source"])), "held_out_id"),
            ids((r["split"], int(r["source"])), "train_id")
        ) for r in rep
    )


def test_hot_class(spark):
    """A third of all records are copies of one; they are compared once."""
    rows = [
        (
            i,
            "Which year shows the highest a?",
            (["category", "a"], [["x", "1"], ["y", str(i if i % 3 else 10**6)]]),
            "train" if i % 2 else "test"
        ) for i in range(900)
    ]
    df = spark.createDataFrame(rows, "rec_id bigint, question string, table struct<headers array<string>, rows array<array<string>>>, split string")
    linked = {
        r["rec_id"]: (r["class_id"], r["n_links"]) for r in o.linked_classes(
            df,
            "rec_id",
            "question",
            "table.headers",
            "table.rows",
            "split"
        ).collect()
    }
    assert linked[0][1] == 150 + 0 and linked[3] == (linked[0][0], 150) and o.overlaps(
        df,
        "rec_id",
        "question",
        "table.headers",
        "table.rows",
        "split"
    ).count() == sum(n for i, (_, n) in linked.items() if i % 2)


def test_empty_table(spark):
    df = spark.createDataFrame([], "rec_id bigint, question string, headers array<string>, grid array<array<string>>, split string")
    assert o.overlaps(df, "rec_id", "question", "headers", "grid", "split").count() == 0
