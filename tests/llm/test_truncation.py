import json
import random

import pytest

from cellwise.llm import truncation as t

WHOLE = json.dumps({"steps": [{"text": "keep the rows..."}], "answer": {"label": "2019"}})


@pytest.mark.parametrize(
    "text",
    [
        None,
        "",
        "  ",
        "none",
        "N/A",
        WHOLE,
        WHOLE + "\n// done",
        WHOLE + "}",
        "Here is it:\n```json\n" + WHOLE + "\n```",
        str(json.loads(WHOLE)),
        WHOLE.replace(", ", " ", 1),
        "The table has no such row",
        "Prices went up in spring. Final answer: 2019",
        "Prices went up.\n\nlabel = May 28, 2019"
    ],
)
def test_complete(text):
    assert t.judge(text)[0] in (t.COMPLETE, t.AMBIGUOUS)
    if text and "{" in text and "done" not in text:
        assert t.judge(text)[0] == t.COMPLETE


@pytest.mark.parametrize("cut", range(2, len(WHOLE) - 1, 3))
@pytest.mark.parametrize("after", ["", "...", "…", "\n```"])
def test_every_cut_of_an_object(cut, after):
    assert t.judge(WHOLE[:cut] + after)[0] == t.INCOMPLETE


@pytest.mark.parametrize(
    "text",
    [
        "In the same month prices went up and the station was so",
        "Sales fell in spring because of the weather in expo...",
        "Prices went up in the spring of that year. Answer: 20",
        "Here is it:\n```json\n" + WHOLE,
        "broken at a letter of the last word�"
    ]
)
def test_incomplete_prose(text):
    assert t.judge(text)[0] == t.INCOMPLETE


def rows():
    r, out, k = random.Random(2), [], 0
    prose = lambda n: " ".join("w" * r.randint(1, 9) for _ in range(n))  # noqa: E731 - lengths on no lattice
    for i in range(400):
        out.append((k, "free", f"{prose(20 + i % 37)} {i}."))
        k += 1
        out.append((k, "limited", f"{prose(25 + i % 37)} number {i} ended well. And then it went on for long."[:150]))
        k += 1
    out += [(k + j, "free", "none") for j in range(50)] + [(k + 50, None, None), (k + 51, "free", ""), (k + 52, "limited", "x" * 100_000 + " and so")]
    return out


def test_limits_and_report(spark):
    df = spark.createDataFrame(rows(), "detail_id bigint, model string, raw string").selectExpr("*", "1 as verdict", "2 as length", "3 as id")
    cut, limits, report = t.truncated(df, "detail_id", "model", "raw")
    got = {(r["source"], r["unit"], r["length"]) for r in limits.collect()}
    assert ("limited", "chars", 150) in got and not any(s == "free" for s, _, _ in got)
    texts = {i: (m, x) for i, m, x in rows()}
    found = {r["id"] for r in cut.collect()}
    assert sum(m == "limited" and len(x or "") == 150 for m, x in texts.values()) > 200
    assert all(i in found for i, (m, x) in texts.items() if m == "limited" and len(x or "") == 150)
    assert not any(texts[i][0] == "free" for i in found)
    assert {r["source"]: r["n_texts"] for r in report.collect()} == {"free": 451, "limited": 401, None: 1}


def test_empty_table(spark):
    df = spark.createDataFrame([], "detail_id bigint, model string, raw string")
    assert [d.count() for d in t.truncated(df, "detail_id", "model", "raw")] == [0, 0, 0]


def test_cuts_in_a_sparse_region(spark):
    """Endings one per eleven characters, and six texts cut at one length."""
    ends = [(i, "m", i, 1, *[11 * i + 200] * 4) for i in range(880)] + [(1000 + i, "m", 1000 + i, 1, *[5003] * 4) for i in range(6)]
    df = spark.createDataFrame(
        ends,
        "id bigint, source string, text_hash bigint, verdict int, chars bigint, bytes bigint, core_chars bigint, core_bytes bigint"
    )
    got = t.length_limits(df).collect()
    assert {(r["unit"], r["length"]) for r in got} == {(u, 5003) for u in t.UNITS}
    # 444 texts at least as long; of the 24 neighbouring lengths two have an ending each
    at_risk = 6 + sum(11 * i + 200 >= 5003 for i in range(880))
    risk = sum((6 if n <= 5003 else 0) + sum(11 * i + 200 >= n for i in range(880)) for n in range(4991, 5016) if n != 5003)
    near = sum(11 * i + 200 in range(4991, 5016) for i in range(880))
    assert got[0]["at_risk"] == at_risk and got[0]["expected"] == pytest.approx(at_risk * (near + 0.5) / (risk + 1))


def test_label_in_a_long_last_line():
    assert t.judge("word " * 60 + "and so the answer: 20")[0] == t.INCOMPLETE
    assert t.judge("Prices went up. " + "The label = " + "long name " * 30)[0] == t.AMBIGUOUS
