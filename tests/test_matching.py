import difflib
import random

from pyspark.sql import functions as F

from cellwise.operators import crosscheck, matching
from cellwise.functions.text import norm_words


def words(r, n):
    return ["".join(r.choice("abcd ") for _ in range(r.randint(1, 14))).strip() for _ in range(n)]


def test_fuzzy_match_as_over_all_pairs(spark):
    r = random.Random(4)
    right = [(g, x) for g in "xy" for x in words(r, 60)] + [("x", None), ("x", "")]

    def edit(t):
        t = list(t)
        for _ in range(r.randint(0, 2)):
            if t:
                i = r.randrange(len(t))
                t[i : i + 1] = r.choice([[], [t[i], r.choice("abcd")], [r.choice("abcd")]])
        return "".join(t)

    left = [(g, i, edit(x or "") if r.random() < 0.8 else x) for i, (g, x) in enumerate(right)]
    plain = lambda t: " ".join("".join(c if c.isalnum() else " " for c in t.lower()).split())
    want = {}
    for g, i, a in left:
        names = sorted({x for h, x in right if h == g and x is not None})
        if a is None:
            continue
        same = [x for x in names if plain(x) == plain(a)]
        near = same if len(same) == 1 else [] if same or not plain(a) else [
            x for x in names if difflib.SequenceMatcher(None, plain(a), plain(x), autojunk=False).ratio() >= matching.CUTOFF
        ]
        if len(near) == 1:
            want[i] = near[0]
    l, t = spark.createDataFrame(left, "g string, k int, a string"), spark.createDataFrame(right, "g string, b string")
    assert {x["k"]: x["match"] for x in matching.fuzzy_match(l, t, "g", "k", "a", "b").collect()} == want
    assert len(want) > 40


TABLE = (
    ["port", "2004", "2005", "Plan"],
    [["Pilots", "7", "9", "1"], ["Ice days", "31", "12", "2"], ["Tugs", "5", "5", "3"], ["Total", "43", "26", "6"]],
    ["categorical", "numeric", "numeric", "numeric"]
)
CASES = [
    ("In which year was Pilots the highest?", ["2005"], "9>7", ("derivation", "2005", True, None)),
    ("In which year was Pilots the lowest?", ["in 2005"], "9>7", ("derivation", "2004", False, None)),
    ("What is the largest in 2004?", ["Ice days"], "31>7>5", ("derivation", "ice days", True, None)),
    ("Which had the most?", ["Tugs"], "31>7", ("derivation", "ice days", False, None)),
    ("Which is the largest?", ["2004"], "99>98", (None, None, None, "ambiguous")),
    ("In which year were ice days the highest?", ["2004"], None, ("nl", "2004", True, None)),
    ("Which year had the lowest ice dais?", ["2004"], "", ("nl", "2005", False, None)),
    ("Which year had the lowest rain?", ["2004"], "", (None, None, None, "row_unmatched")),
    ("How many?", ["3"], "1+2", (None, None, None, None)),
    (None, None, None, (None, None, None, None)),
    ("In which year was Tugs the highest?", ["2004"], "5>5", ("derivation", "2004", True, None)),
]


def test_crosscheck(spark):
    df = spark.createDataFrame(
        [(i, TABLE, q, a, d) for i, (q, a, d, _) in enumerate(CASES)] + [(99, None, "In which year was x the highest?", ["2004"], "2>1")],
        "k int, t struct<headers array<string>, rows array<array<string>>, column_types array<string>>, q string, a array<string>, d string"
    )
    got = {r["k"]: (r["method"], r["ours"], r["agree"], r["trouble"]) for r in crosscheck.crosscheck(df, "k", "t", "q", "a", "d").collect()}
    for i, (q, _, _, want) in enumerate(CASES):
        assert got[i] == want, q
    assert got[99][0] is None
    assert {
        tuple(r) for r in crosscheck.agreement(crosscheck.crosscheck(df, "k", "t", "q", "a", "d")).collect()
    } == {("derivation", 5, 3), ("nl", 2, 1)}


def test_rebuilt_records(spark):
    src = "struct<table struct<headers array<string>>, metadata struct<example_id string>>"
    raw = 'x {"trace_steps": [{"kind": "conclude", "cites": [{"row": 1, "col_name": "b", "value": "2"}, {"row": 1, "col_name": "b", "value": "2"}]}], "final_answer": {"label": "l"}} y'
    df = spark.createDataFrame(
        [(1, raw, ((["a", "b"],), ("e",))), (2, "no", ((["a"],), ("f",))), (3, '{"q": 1}', ((["a"],), ("g",)))],
        f"k int, raw string, s {src}"
    )
    got = {r["k"]: r for r in matching.rebuild(df, "k", "raw", "s").collect()}
    assert got[1]["example_id"] == "e_llm" and [c["col"] for c in got[1]["record"]["evidence_cells"]] == [1] and got[1]["error"] is None
    assert (got[2]["error"], got[3]["error"]) == ("no object", "no steps") and got[2]["record"] is None
