import json
import random

import pytest
from pyspark.sql import functions as F

from cellwise.operators import corpus, engine, validator
from cellwise.plans import corpus_queries
from cellwise.sources.readers import RECORD

#: Five ferries: name, cars, knots; the last is a sum.
FERRIES = [
    (0, "Alder", 41.0, 17.5),
    (1, "Birch", 63.0, 12.25),
    (2, "Cedar", 63.0, 15.0),
    (3, "Dogwood", 20.0, 15.0),
    (4, "Subtotal, all ferries", 187.0, 59.75)
]


@pytest.fixture
def ferries(spark):
    return engine.universe(spark.createDataFrame(FERRIES, "row int, name string, cars double, knots double").withColumn("g", F.lit("fleet")), "name")


def got(df):
    return sorted(r["row"] for r in df.collect())


@pytest.mark.parametrize("by", [(), ("g",)])
def test_operators_on_ferries(ferries, by):
    assert got(engine.best_under_constraint(ferries, "cars", "higher", "knots", "lt", 17, by)) == [1, 2]
    assert got(engine.best_under_constraint(ferries, "cars", "lower", "knots", "ge", 15, by)) == [3]
    assert got(engine.best_under_constraint(ferries, "cars", "lower", "knots", "gte", 31, by)) == []
    assert got(engine.extremum(ferries, "knots", "lower", by)) == [1]
    assert got(engine.threshold_filter(ferries, [("cars", "gte", 41), ("knots", "gte", 15)])) == [0, 2]
    assert got(engine.threshold_filter(ferries, [])) == [0, 1, 2, 3]


def test_frontier_of_ferries(ferries):
    assert got(
        engine.pareto(ferries, "cars", "knots", "higher", "higher", ["g"])
    ) == got(engine.pareto_global(ferries, "cars", "knots", "higher", "higher")) == [0, 2]
    assert got(engine.pareto(ferries, "cars", "knots", "lower", "lower", ["g"])) == [1, 3]


@pytest.mark.parametrize(
    "call",
    [
        lambda d: engine.extremum(d, "cars", "upwards"),
        lambda d: engine.threshold_filter(d, [("cars", "<=", 3)]),
        lambda d: engine.pareto(d, "cars", "knots", "higher", "", ["g"])
    ]
)
def test_unknown_words_are_errors(ferries, call):
    with pytest.raises(ValueError):
        call(ferries)


@pytest.mark.parametrize("seed", range(4))
def test_frontiers_as_by_brute_force(spark, seed):
    r = random.Random(seed)
    vals = [float(round(r.choice([r.random(), r.randint(0, 5), 2 + 1e-10]), 12)) for _ in range(40)] + [None, float("nan")]
    rows = [(i, r.choice("ab"), r.choice(vals), r.choice(vals)) for i in range(150)]
    d1, d2 = r.choice(["higher", "lower"]), r.choice(["higher", "lower"])
    pts = [
        (
            i,
            g,
            a if d1 == "higher" else -a,
            b if d2 == "higher" else -b
        ) for i, g, a, b in rows if a is not None and b is not None and a == a and b == b
    ]
    beats = lambda p, q: p[2] >= q[2] - 1e-9 and p[3] >= q[3] - 1e-9 and (p[2] > q[2] + 1e-9 or p[3] > q[3] + 1e-9)
    df = spark.createDataFrame(rows, "row int, g string, x double, y double")
    by = sorted(q[0] for q in pts if not any(p[1] == q[1] and beats(p, q) for p in pts))
    whole = sorted(q[0] for q in pts if not any(beats(p, q) for p in pts))
    assert got(engine.pareto(df, "x", "y", d1, d2, ["g"])) == got(engine.pareto_antijoin(df, "x", "y", d1, d2, ["g"])) == by
    assert got(engine.pareto_global(df, "x", "y", d1, d2, blocks=5)) == whole


def test_empty(spark, ferries):
    none = ferries.limit(0)
    assert engine.extremum(none, "cars", "higher").count() == engine.pareto_global(none, "cars", "knots", "higher", "lower").count() == 0


NAMES = ("category", "tons", "days", "crew")


def number(text):
    """A brute reading of the few styles that ``draw`` writes."""
    t = text.replace("$", "").replace(",", "").replace("%", "").strip()
    sign = -1 if t.startswith("(") else 1
    try:
        return sign * float(t.strip("()").strip())
    except ValueError:
        return None


def draw(r):
    """A record of a random table and operation, without an answer."""
    n = r.randint(0, 7)
    style = lambda v: r.choice([f"{v}", f"$ {v}", f"{v}%", f"({v})", f"{v}.0", "n/a", "", "port"])
    rows = [[r.choice([f"hull {i}", "Total", f"hull {i}"]), *(style(r.randint(1, 6)) for _ in range(3))] for i in range(n)]
    name = lambda: r.choice([*NAMES[1:]] * 4 + ["depth"])
    word = lambda *w: r.choice([*w] * 4 + [None, "max"])
    op = {"rows": r.choice([None, [], [0, 2, 4, 99, -1], [*range(n)]])}
    kind = r.choice(["best_under_constraint", "threshold_filter", "tradeoff_summary", "extremum", "argmin"] * 3 + [None])
    op["type"] = kind
    if kind in ("best_under_constraint", "extremum"):
        op |= {"target": name(), "target_dir": word("higher", "lower")}
    if kind == "best_under_constraint":
        op |= {"constraint": name(), "op": word("lt", "gte", "ge"), "threshold": r.choice([1.5, 3.0, 5.0, 90.0, None])}
    if kind == "threshold_filter":
        op["conditions"] = r.choice(
            [None, [], *([{"metric": name(), "op": r.choice(["lt", "gte", "ge"]), "t": r.choice([2.0, 3.5])} for _ in range(k)] for k in (1, 2, 2))]
        )
    if kind == "tradeoff_summary":
        op |= {"m1": name(), "m2": name(), "d1": word("higher", "lower"), "d2": word("higher", "lower")}
    return rows, r.choice([None, None, [f"name {i}" for i in range(n)]]), op


def brute(rows, labels, op):
    """Answer and label by the definition; None where the operation can't run."""
    ids = range(len(rows)) if op["rows"] is None else [i for i in op["rows"] if 0 <= i < len(rows)]
    value = lambda i, m: number(rows[i][NAMES.index(m)])
    holds = lambda v, o, t: v is not None and (v < t if o == "lt" else v >= t)
    known = lambda *m: all(x in NAMES for x in m)
    turn = lambda v, d: v if d == "higher" else -v
    k = op["type"]
    if k == "extremum" or k == "best_under_constraint":
        if not known(op["target"]) or op["target_dir"] not in ("higher", "lower"):
            return None
        if k == "best_under_constraint":
            if not known(op["constraint"]) or op["op"] not in ("lt", "gte", "ge") or op["threshold"] is None:
                return None
            ids = [i for i in ids if holds(value(i, op["constraint"]), op["op"], op["threshold"])]
        vals = {i: turn(value(i, op["target"]), op["target_dir"]) for i in ids if value(i, op["target"]) is not None}
        won = sorted(i for i, v in vals.items() if v == max(vals.values()))
    elif k == "threshold_filter":
        if op["conditions"] is None or not known(*(c["metric"] for c in op["conditions"])):
            return None
        won = sorted(i for i in {*ids} if all(holds(value(i, c["metric"]), c["op"], c["t"]) for c in op["conditions"]))
    elif k == "tradeoff_summary":
        if not known(op["m1"], op["m2"]) or {op["d1"], op["d2"]} - {"higher", "lower"}:
            return None
        p = {
            i: (
                turn(value(i, op["m1"]), op["d1"]),
                turn(value(i, op["m2"]), op["d2"])
            ) for i in ids if value(i, op["m1"]) is not None and value(i, op["m2"]) is not None
        }
        won = sorted(i for i, (a, b) in p.items() if not any(c >= a and d >= b and (c, d) != (a, b) for c, d in p.values()))
        return won, f"{op['m1']} vs {op['m2']}"
    else:
        return None
    return won, ", ".join(labels[i] if labels else rows[i][0] for i in won) or "none"


def record(i, rows, labels, op, said, label, evidence, **change):
    out = {
        "rec_id": i,
        "table_id": f"t{i}",
        "domain": "ships",
        "question": "Which?",
        "question_type": {"extremum": "rank_models"}.get(op["type"], op["type"]) or "compare_rows",
        "trace_source": "programmatic",
        "split": "train",
        "table": {"headers": list(NAMES), "rows": rows, "row_labels": labels, "column_types": ["categorical", "numeric", "numeric", "text"]},
        "gold_answer": {"label": label, "rows": said, "metrics": [op["m2"], op["m1"]] if op.get("m1") else []},
        "trace_steps": [
            {"index": 0, "kind": "filter", "description": "read", "cites": [None, *evidence[:1]]},
            None,
            {"index": 1, "kind": "conclude", "description": "so", "cites": None}
        ],
        "evidence_cells": [*evidence, None], "metadata": {"difficulty": "easy", "edge_cases": [], "spec": op},
    }
    out = json.loads(json.dumps(out))
    for path, v in change.items():
        *head, last = path.split("__")
        at = out
        for k in head:
            at = at[int(k) if k.isdigit() else k]
        at[int(last) if last.isdigit() else last] = v
    return json.dumps(out)


def frame(spark, texts):
    return spark.createDataFrame([(t,) for t in texts], "t string").select(F.from_json("t", "rec_id int, " + RECORD).alias("r")).select("r.*")


def run(df):
    return corpus.execute(df, "rec_id", "table.headers", "table.rows", "metadata.spec", "table.row_labels")


def test_execution_and_validation_as_by_brute_force(spark):
    """The engine against the definition, and the validator on the engine's answers with the cells it read."""
    r = random.Random(11)
    drawn = [draw(r) for _ in range(400)]
    want = {i: brute(*d) for i, d in enumerate(drawn)}
    df = frame(spark, [record(i, rows, labels, op, [], "none", []) for i, (rows, labels, op) in enumerate(drawn)])
    done = {x["rec_id"]: x for x in run(df).collect()}
    assert {i: None if x["error"] else (x["answer"], x["label"]) for i, x in done.items()} == want
    assert sum(w is not None for w in want.values()) > 150
    shown = lambda i: [c.asDict() for c in done[i]["evidence"]]
    system = frame(spark, [record(i, rows, labels, op, want[i][0], want[i][1], shown(i)) for i, (rows, labels, op) in enumerate(drawn) if want[i]])
    for x in validator.validate(system, "rec_id").collect():
        rows, _, op = drawn[x["rec_id"]]
        said, label = want[x["rec_id"]]
        # an empty frontier keeps its label, and shows no cells; neither does an empty universe
        failed = {"empty_result_consistency"} if not said and label != "none" else set()
        needs = {op.get(k) for k in ("target", "constraint", "m1", "m2")} | {c["metric"] for c in op.get("conditions") or []}
        needs -= {None, op.get("target") if not said and op["type"] == "best_under_constraint" else None}
        failed |= {"relevance"} if needs - {c["col_name"] for c in shown(x["rec_id"])} else set()
        assert set(x["failed"]) == failed


BASE = (
    [["Alder", "41", "$ 17.5", "3"], ["Birch", "63", "12.25", "4"], ["Cedar", "63", "15", "n/a"]],
    None,
    {
        "type": "best_under_constraint",
        "target": "tons",
        "target_dir": "higher",
        "constraint": "days",
        "op": "lt",
        "threshold": 16.0,
        "rows": [0, 1, 2]
    }
)
SEEN = [{"row": i, "col": c, "col_name": NAMES[c], "value": BASE[0][i][c]} for i in (1, 2) for c in (1, 2)]
FAULTS = [
    ({}, []), ({"gold_answer__rows": [2, 1]}, []), ({"evidence_cells__0__value": "63.0"}, []),
    ({"evidence_cells__0__value": "64"}, ["cells_exist"]),
    ({"evidence_cells__1__row": 3}, ["cells_exist"]),
    ({"trace_steps__0__cites__1__col_name": "days"}, ["cells_exist"]),
    ({"gold_answer__rows": [1]}, ["answer_correct"]),
    ({"gold_answer__rows": [0]}, ["answer_correct", "numeric_comparisons_correct", "threshold_satisfaction"]),
    ({"gold_answer__rows": [77]}, ["answer_correct", "numeric_comparisons_correct", "threshold_satisfaction"]),
    ({"metadata__spec": None}, ["answer_correct"]),
    ({"metadata__spec__target": "draught"}, ["answer_correct", "threshold_satisfaction", "relevance"]),
    ({"evidence_cells": SEEN[:1]}, ["relevance"]), ({"gold_answer__rows": []}, ["answer_correct", "empty_result_consistency"]),
    ({"metadata__difficulty": "medium"}, ["difficulty_tag_present"]), ({"metadata__edge_cases": None}, ["difficulty_tag_present"]),
    *(
        ({k: v}, list(validator.CHECKS)) for k, v in {
            "table": None,
            "trace_steps": [],
            "trace_steps__2__kind": "select",
            "table__rows__0": ["Alder"],
            "question_type": "poem",
            "table__column_types__0": "number",
            "gold_answer__label": None,
            "evidence_cells__0__row": -1
        }.items()
    ),
]


def test_planted_faults_fail_their_checks(spark):
    df = frame(spark, [record(i, *BASE, [1, 2], "Birch, Cedar", SEEN, **json.loads(json.dumps(m))) for i, (m, _) in enumerate(FAULTS)])
    for x in validator.validate(df, "rec_id").collect():
        assert x["failed"] == FAULTS[x["rec_id"]][1], FAULTS[x["rec_id"]][0]


def test_frontier_and_metrics_faults(spark):
    op = {"type": "tradeoff_summary", "m1": "tons", "m2": "days", "d1": "higher", "d2": "lower", "rows": None}
    texts = [
        record(0, BASE[0], None, op, [1], "tons vs days", SEEN),
        record(1, BASE[0], None, op, [1, 2], "tons vs days", SEEN),
        record(2, BASE[0], None, op, [1], "x", SEEN, gold_answer__metrics=["tons"])
    ]
    assert [
        x["failed"] for x in validator.validate(frame(spark, texts), "rec_id").orderBy("rec_id").collect()
    ] == [[], ["answer_correct", "pareto_frontier_correct"], ["answer_correct"]]


def test_texts_that_are_no_records(spark):
    df = spark.createDataFrame([(1, "{"), (2, None), (3, '{"a": 1}'), (4, record(4, *BASE, [1, 2], "Birch, Cedar", SEEN))], "id int, t string")
    got = {x["id"]: x["failed"] for x in validator.validate_texts(df, "id", "t").collect()}
    assert got == {1: list(validator.CHECKS), 2: list(validator.CHECKS), 3: list(validator.CHECKS), 4: []}
    with pytest.raises(ValueError, match="cells_exist 3"):
        validator.assert_valid(validator.validate_texts(df, "id", "t"))
    assert validator.assert_valid(validator.validate_texts(df.where("id = 4"), "id", "t")) == 1


def test_errors_by_their_names(spark):
    ops = [
        {"type": "argmin"},
        {"type": "extremum", "target": "draught", "target_dir": "higher"},
        {"type": "extremum", "target": "tons", "target_dir": "up"},
        {"type": "threshold_filter", "conditions": [{"metric": "tons", "op": "gt", "t": 1.0}]},
        {"type": "threshold_filter"},
        BASE[2] | {"threshold": None},
        BASE[2] | {"op": "lte"}
    ]
    df = frame(spark, [record(i, BASE[0], None, {"rows": None} | o, [], "none", []) for i, o in enumerate(ops)])
    assert [x["error"] for x in run(df).orderBy("rec_id").collect()] == [
        "type",
        "column",
        "direction",
        "comparison",
        "conditions",
        "threshold",
        "comparison"
    ]


def test_universe_is_bound_to_entities(spark):
    rows = [["Alder", "4", "1", ""], ["TOTAL", "9", "2", ""], [None, "5", "3", ""], ["Totals", "6", "4", ""]]
    df = frame(spark, [record(0, rows, None, {"type": "extremum", "target": "tons", "target_dir": "higher", "rows": [1]}, [], "none", [])])
    bound = df.withColumn("metadata", F.struct(corpus.bind_universe(F.col("metadata.spec"), F.col("table.rows")).alias("spec")))
    assert [x["answer"] for x in run(df).unionByName(run(bound)).collect()] == [[1], [3]]


def test_row_labels(spark):
    table = "struct<rows array<array<string>>, row_labels array<string>, column_types array<string>>"
    df = spark.createDataFrame(
        [
            (([["a", "b"]], ["n"], ["text", "categorical"]),),
            (([["a", "b"]], [], ["text", "categorical"]),),
            (([["a", "b"]], None, ["text", "numeric"]),)
        ],
        f"t {table}"
    )
    assert [x[0] for x in df.select(corpus.row_label(F.col("t"), F.lit(0))).collect()] == ["n", "b", "row 0"]


def test_citation_labels(spark):
    cells = spark.createDataFrame(
        [(1, i, c, f"c{c}", v) for i, row in enumerate([["10", "x"], ["1,000", "y"], ["", "$ 5"]]) for c, v in enumerate(row)],
        "k int, row int, col int, col_name string, txt string"
    )
    cases = [
        (0, 0, "c0", "10.0", "ok"),
        (3, 0, "c0", "10", "row_oob"),
        (0, 9, "c0", "10", "row_oob"),
        (0, 0, "c1", "10", "colname_mismatch"),
        (0, 0, "c0", "1000", "wrong_row"),
        (1, 0, "c0", "1001", "rounding"),
        (0, 0, "c0", "ten", "type_format"),
        (0, 1, "c1", "z", "not_in_column"),
        (1, 0, "c0", "7", "not_in_column"),
        (2, 0, "c0", None, "ok")
    ]
    cites = spark.createDataFrame(
        [(1, i, *c[:4]) for i, c in enumerate(cases)],
        "k int, cite_no int, row int, col int, col_name string, value string"
    )
    assert [x["label"] for x in corpus.classify_cites(cites, cells, "k").orderBy("cite_no").collect()] == [c[4] for c in cases]
    grid = spark.createDataFrame(
        [(1, ["c0", "c1"], [["10", "x"], ["1,000", "y"], ["", "$ 5"]], [None] + [c[:4] for c in cases])],
        "k int, h array<string>, g array<array<string>>, c array<struct<row int, col int, col_name string, value string>>"
    )
    got = corpus.classify_within(grid, "k", "h", "g", "c").orderBy("cite_no").collect()
    assert [(x["cite_no"], x["label"]) for x in got] == [(i + 1, c[4]) for i, c in enumerate(cases)]


def test_citations_of_long_and_wide_tables(spark):
    n = corpus.NEAR
    shapes = {1: (3, 2), 2: (2 * n, 2), 3: (2, n + 3), 4: (n, n), 5: (n + 1, n + 1)}
    grids = {k: [[str(1000 * (i % (2 * n - 1)) + 7 * c) for c in range(w)] for i in range(h)] for k, (h, w) in shapes.items()}
    heads = {k: [f"c{c}" for c in range(w)] for k, (_, w) in shapes.items()}
    rows = sorted({0, 1, n - 1, n, n + 1, 2 * n - 1, 2 * n})
    # the cell's own value, one of another row, one of no row; the first value stands again in the last row of the second table
    cites = [
        (k, r, c, f"c{c}", v)
        for k in shapes for r in rows for c in (0, 1, n - 1, n, n + 2)
        for v in (str(1000 * r + 7 * c), str(7 * c), str(1000 * (n + 1) + 7 * c), "5")
    ] + [(None, 0, 0, "c0", "0"), (6, 0, 0, "c0", "0")]
    told = spark.createDataFrame(
        [(k, i, *c) for i, (k, *c) in enumerate(cites)],
        "k int, cite_no int, row int, col int, col_name string, value string"
    )
    cells = spark.createDataFrame(
        [(k, i, c, heads[k][c], v) for k, g in grids.items() for i, row in enumerate(g) for c, v in enumerate(row)],
        "k int, row int, col int, col_name string, txt string"
    )
    got = {x["cite_no"]: x["label"] for x in corpus.classify_cites(told, cells, "k").collect()}

    def label(k, r, c, _, v):
        g = grids.get(k, [])
        if r >= len(g) or c >= len(g[0]):
            return "row_oob"
        held = any(row[c] == v for row in g)
        near = abs(float(v) - float(g[r][c])) / max(abs(float(g[r][c])), 1) <= 5e-3
        return "ok" if g[r][c] == v else "wrong_row" if held else "rounding" if near else "not_in_column"

    assert got == {i: label(*c) for i, c in enumerate(cites)}


def test_citations_broadcast_nothing(spark, tmp_path):
    # tables in nested columns look small to the planner, which would send all cells to the driver
    cell = "struct<row int, col int, col_name string, value string>"
    table = "struct<headers array<string>, rows array<array<string>>>"
    spark.createDataFrame(
        [(1, (["a"], [["1"], ["2"]]), [(0, 0, "a", "1")])],
        f"rec_id bigint, table {table}, evidence_cells array<{cell}>"
    ).write.parquet(f"{tmp_path}/realtable_eval_verified.parquet")
    out = corpus_queries.classify_cites_joined(spark, str(tmp_path))
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()


def test_rescore_broadcasts_nothing(spark, tmp_path):
    r = record(0, [["a", "3", "1", ""], ["b", "5", "2", ""]], None, {"type": "extremum", "target": "tons", "target_dir": "higher"}, [], "none", [])
    df = frame(spark, [r]).withColumns({
        "rec_id": F.lit(1).cast("bigint"),
        "metadata": F.col("metadata").withField("example_id", F.lit("x")),
    })
    df.write.parquet(f"{tmp_path}/realtable_eval_verified.parquet")
    op = json.dumps({"operation": {"type": "extremum", "target": "tons", "target_dir": "higher"}})
    lost = op.replace("tons", "miles")
    answers = [(i, "x", "m", raw, False) for i, raw in enumerate([op, op, lost, "none", None])]
    spark.createDataFrame(
        answers, "detail_id bigint, example_id string, model string, raw string, grounded boolean"
    ).write.parquet(f"{tmp_path}/p3_4b_exec_test_verified.parquet")
    out = corpus_queries.grounded_rescore(spark, str(tmp_path))
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    assert [tuple(x)[:4] for x in out.select("model", "n", "n_model_grounded", "n_grounded").collect()] == [("m", 5, 0, 2)]
