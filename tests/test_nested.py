import json

from cellwise.operators import nested

F = ("trace_steps", "evidence_cells", "gold_answer")
C = lambda r: {"row": r, "col": 1, "col_name": "a", "value": "5"}
STEP = [{"index": 0, "kind": "filter", "cites": [C(0), None, C(2)]}, None, {"index": 1, "kind": "conclude", "cites": []}]
WHOLE = {"trace_steps": STEP, "evidence_cells": [C(None), C(3)], "gold_answer": {"label": "x", "rows": [1, None, 4]}}
WANT = [("cite", 0, 0, 0), ("cite", 0, 2, 2), ("evidence", -1, 1, 3), ("gold", -1, 0, 1), ("gold", -1, 2, 4)]
LINES = {
    1: (json.dumps(WHOLE), WANT),
    2: ("  " + json.dumps({"payload": {"n": 1, "example": WHOLE}}) + "\n", WANT),
    3: (
        json.dumps(
            WHOLE | {
                "trace_steps": json.dumps(STEP),
                "evidence_cells": {"0": C("x"), "1": json.dumps(C("3.0"))},
                "gold_answer": json.dumps({"rows": {"0": "1", "2": "4e0"}})
            }
        ),
        WANT
    ),
    4: (json.dumps({"trace_steps": {"cites": C(2.0), "kind": "filter"}, "gold_answer": {"rows": 7}}), [("cite", 0, 0, 2), ("gold", -1, 0, 7)]),
    5: (json.dumps(WHOLE)[:-5], []),
    6: (None, []),
    7: ("", []),
    8: ("[1, 2]", []),
    9: (json.dumps({"trace_steps": None, "evidence_cells": [], "gold_answer": None}), []),
    10: (json.dumps(WHOLE) + " trailing", []), 11: (json.dumps({"evidence_cells": {"900000000": C(1)}}), [("evidence", -1, 900000000, 1)]),
    12: (json.dumps({"gold_answer": {"rows": [1.5, True, "two", "0x1", " 3 ", 2**40]}}), [("gold", -1, 4, 3), ("gold", -1, 5, 2**40)]),
    13: (
        json.dumps({"row": "clash", "trace_steps": [{"cites": [C(1)], "path": "p", "trace_steps": [1]}], "reviews": [{"notes": [{"row": 3}]}]}),
        [("cite", 0, 0, 1)]
    ),
    14: (json.dumps({"text": json.dumps(WHOLE)}), WANT),
}


def refs(tables):
    out = {}
    for r in nested.cell_references(tables).collect():
        out.setdefault(r["rec_id"], []).append((r["path"], r["step_pos"], r["pos"], r["row_no"]))
    return {k: sorted(v) for k, v in out.items()}


def test_texts_of_all_shapes(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in LINES.items()], "rec_id bigint, line string")
    assert refs(nested.flatten(nested.from_json_texts(df, "line", F), "rec_id")) == {i: sorted(w) for i, (_, w) in LINES.items() if w}


def test_typed_records_and_links(spark):
    schema = "rec_id bigint, trace_steps array<struct<index:int,kind:string,cites:array<struct<row:int,col:int,col_name:string,value:string>>>>, evidence_cells array<struct<row:int,col:int,col_name:string,value:string>>, gold_answer struct<label:string,rows:array<int>>, _key string, path string"
    df = spark.createDataFrame(
        [
            (1, STEP, WHOLE["evidence_cells"], WHOLE["gold_answer"], "k", "p"),
            (2, None, None, None, None, None),
            (3, [], [], {"label": None, "rows": []}, "", "")
        ],
        schema
    )
    tables = nested.flatten(df, "rec_id")
    assert refs(tables) == {1: sorted(WANT)}
    assert set(tables) == {"record", "trace_steps", "trace_steps.cites", "evidence_cells", "gold_answer.rows"}
    assert tables["record"].count() == 3 and tables["trace_steps"].count() == 3
    steps = {(r["_key"], r["_place"]) for r in tables["trace_steps"].collect()}
    assert all((r["_key"], r["_ordinals"][-1]) in steps and r["_parent"] == "trace_steps" for r in tables["trace_steps.cites"].collect())


def test_deeper_arrays_and_empty_tables(spark):
    df = spark.createDataFrame([(1, [[[{"a": 1}], None], []])], "id bigint, x array<array<array<struct<a:int>>>>")
    tables = nested.flatten(df, "id")
    r = tables["x[][]"].collect()
    assert [(x["_ordinals"], x["_place"], x["a"]) for x in r] == [([0, 0], 0, 1)]
    none = spark.createDataFrame([], "rec_id bigint, line string")
    assert nested.cell_references(nested.flatten(nested.from_json_texts(none, "line", F), "rec_id")).count() == 0


def test_nothing_is_lost_to_narrow_types(spark):
    lines = [
        '{"trace_steps": [], "evidence_cells": {"0": {"row": 3000000000}, "4000000000": {"row": 1}}, "gold_answer": {"rows": [' + "1]}}",
        " " * 200 + '{"gold_answer": "' + " " * 90 + '{\\"rows\\": [7]}"}'
    ]
    df = spark.createDataFrame(list(enumerate(lines)), "rec_id bigint, line string")
    r = nested.cell_references(nested.flatten(nested.from_json_texts(df, "line", ("trace_steps", "evidence_cells", "gold_answer")), "rec_id"))
    assert sorted((x["rec_id"], x["path"], x["pos"], x["row_no"]) for x in r.collect()) == [
        (0, "evidence", 0, 3000000000),
        (0, "evidence", 4000000000, 1),
        (0, "gold", 0, 1),
        (1, "gold", 0, 7)
    ]
    assert r.where(nested.in_int(r)).count() == 2
