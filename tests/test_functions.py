import math
import random

import pytest
from pyspark.sql import functions as F

from cellwise.functions import stats, text

PARSED = {
    "$  3,071.5": 3071.5,
    "62.9": 62.9,
    "415": 415.0,
    "(38)": -38.0,
    "( 38 )": -38.0,
    "$ (7,106)": -7106.0,
    "$(0.25)": -0.25,
    "-8.75": -8.75,
    "0.5%": 0.5,
    "(-4.5)": 4.5,
    "1,2": 12.0,
    "": None,
    " \t": None,
    "-": None,
    "--": None,
    "–": None,
    "\ufffd": None,
    "* * %": None,
    "n/A": None,
    "na": None,
    "n.a": None,
    "N.A.": None,
    "NM": None,
    "nil": None,
    None: None,
    "Ferries": "Ferries",
    "3.1.4": "3.1.4",
    "9b": "9b",
    ".5": ".5",
    "nils": "nils",
}


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[1] for r in df.select("i", f(F.col("v")).alias("r")).orderBy("i").collect()]


def test_parse_cell(spark):
    for (raw, want), got in zip(PARSED.items(), column(spark, PARSED, text.parse_cell)):
        if want is None:
            assert (got["kind"], got["num"], got["txt"]) == ("empty", None, ""), raw
        elif isinstance(want, str):
            assert (got["kind"], got["num"], got["txt"]) == ("str", None, want), raw
        else:
            assert got["kind"] == ("int" if want == int(want) else "float") and got["num"] == pytest.approx(want), raw


def test_is_total(spark):
    assert column(
        spark,
        ["Total", "Sub total", "subtotal of x", "Totals", "grand total", None, "aggregate"],
        text.is_total
    ) == [True, True, True, False, True, False, True]


def test_canon_num(spark):
    values = {
        "12.5%": 0.125,
        "RMB 1,000": 1000.0,
        "(3)": -3.0,
        ".5": 0.5,
        "+5": 5.0,
        "1e3": 1000.0,
        "5.": 5.0,
        "(€ 2.5E-1)": -0.25,
        "usd 7 %": 0.07,
        "": None,
        None: None,
        "x": None,
        "1e": None,
        "--1": None,
        "e5": None
    }
    assert column(spark, values, text.canon_num) == [None if v is None else pytest.approx(v) for v in values.values()]


def test_general_format(spark):
    values = [
        0.5,
        0.0,
        1234567.0,
        100000.0,
        1e-5,
        123456.7,
        -2.0,
        0.0001,
        3.14159265,
        999999.5,
        1e20,
        33269.25,
        20873.35,
        20873.45,
        2.6750005,
        1.000005,
        999999.4,
        9.9999995,
        0.00012345675,
        12345.65,
        0.1 + 0.2
    ]
    r = random.Random(3)
    values += [round(r.uniform(0, 10**k), d) for k in range(-3, 7) for d in (2, 3, 4, 7) for _ in range(40)]
    assert column(spark, values, text.general_format, "double") == [f"{v:g}" for v in values]


def test_gate(spark):
    df = spark.createDataFrame(
        [
            ("best_under_constraint", "highest x with y of at least 4"),
            ("best_under_constraint", "highest x"),
            ("tradeoff_summary", "maximizing both"),
            ("tradeoff_summary", "the Pareto set"),
            ("extremum", "under 4"),
            (None, None)
        ],
        "t string, q string"
    )
    assert [r[0] for r in df.select(text.gate_fires(F.col("t"), F.col("q"))).collect()] == [False, True, True, False, True, True]


def test_chain_values(spark):
    assert column(spark, ["918>914>814", "1<2>3", "5", "1>x", None], text.chain_values) == [[918.0, 914.0, 814.0], None, None, None, None]


def test_mcnemar(spark):
    cases = [(0, 0), (5, 5), (1, 0), (9, 2), (93, 1), (300, 9), (3027, 67)]
    df = spark.createDataFrame(cases, "b bigint, c bigint")
    for (b, c), r in zip(cases, df.select(stats.mcnemar_ln_p(F.col("b"), F.col("c"))).collect()):
        n, k = b + c, min(b, c)
        want = 0.0 if not n else min(0.0, math.log(2 * sum(math.comb(n, i) for i in range(k + 1))) - n * math.log(2))
        assert r[0] == pytest.approx(want, rel=1e-9, abs=1e-9)


def test_wilson(spark):
    r = spark.createDataFrame([(243.0, 254.0), (0.0, 0.0)], "k double, n double").select(stats.wilson(F.col("k"), F.col("n"))).collect()
    assert (round(r[0][0]["low"], 3), round(r[0][0]["high"], 3)) == (0.924, 0.976) and r[1][0]["low"] == 0.0
