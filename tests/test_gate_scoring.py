"""Gate scoring against a direct reading of the answers and questions."""

import json
import os
import re
from collections import defaultdict

import pytest

from cellwise.operators import records
from cellwise.plans import catalog
from tests.conftest import SF

THRESHOLD = re.compile(r"\b(while|under|at least|at most|below|above|exceeds?|less than|greater than|no more than|no less than)\b", re.I)
TRADEOFF = re.compile(r"\b(pareto|trade-?off|optimal|optimi[sz]e|maxim|minim)\b", re.I)


def operation(raw):
    """The type of the operation in the first balanced object, None where there is none."""
    start, depth, quoted, escaped = (raw or "").find("{"), 0, False, False
    for i, c in enumerate(raw[start:] if start >= 0 else "", start):
        if quoted:
            quoted, escaped = escaped or c != '"', not escaped and c == "\\"
        elif c == '"':
            quoted = True
        elif c in "{}":
            depth += 1 if c == "{" else -1
            if not depth:
                try:
                    op = json.loads(raw[start : i + 1]).get("operation")
                except ValueError:
                    return None
                return op.get("type") if isinstance(op, dict) else None
    return None


def fires(op, question):
    if op in ("best_under_constraint", "threshold_filter"):
        return not THRESHOLD.search(question or "")
    return op != "tradeoff_summary" or not TRADEOFF.search(question or "")


def want(questions, answers):
    of, out = {}, defaultdict(lambda: [0] * 5)
    for r in sorted(questions, key=lambda r: r["rec_id"]):
        if r["question"] is not None:
            of[r["metadata"]["example_id"]] = r["question"]
    for a in answers:
        f, e, m = fires(operation(a["raw"]), of.get(a["example_id"])), bool(a["engine_ok"]), bool(a["model_ok"])
        for k, x in enumerate((True, e, m, m if f else e, f)):
            out[a["model"]][k] += x
    return dict(out)


def got(spark, folder):
    return {
        r["model"]: [
            r[c] for c in ("n", "n_engine", "n_model", "n_gated", "n_fires")
        ] for r in catalog.QUERIES["gate_scoring"](spark, folder).collect()
    }


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_gate_reads_the_question_and_the_operation(spark):
    r, a = (spark.read.parquet(f"{SF}/{t}.parquet").collect() for t in ("realtable_eval_verified", "p3_4b_exec_test_verified"))
    assert got(spark, SF) == want(r, a)


def test_wording_decides(spark, tmp_path):
    q = [(1, "x", "Which is highest while cost is under 5?"), (2, "x", "Which is highest?"), (3, "y", "Which are optimal?"), (4, "z", None)]
    spark.createDataFrame(
        [(i, "t", text, {"example_id": e}) for i, e, text in q],
        "rec_id bigint, table_id string, question string, metadata struct<example_id: string>"
    ).write.parquet(f"{tmp_path}/realtable_eval_verified.parquet")
    op = lambda t: json.dumps({"operation": {"type": t}})
    # the last record of x has no threshold; y is asked by a trade-off; an answer without an example has no question
    a = [
        ("x", op("best_under_constraint")),
        ("y", op("tradeoff_summary")),
        ("y", op("threshold_filter")),
        ("y", op("tradeoff_summary").replace('"', "'")),
        ("z", op("tradeoff_summary")),
        ("w", op("tradeoff_summary")),
        (None, None)
    ]
    spark.createDataFrame(
        [(e, "m", "tradeoff_summary", raw, True, False) for e, raw in a],
        "example_id string, model string, type string, raw string, engine_ok boolean, model_ok boolean"
    ).write.parquet(f"{tmp_path}/p3_4b_exec_test_verified.parquet")
    assert got(spark, str(tmp_path)) == {"m": [7, 7, 0, 1, 6]}


def test_operation_type_needs_strict_json(spark):
    rows = [
        ('a {"operation": {"type": "extremum", "x": [1]}} b',),
        ("{'operation': {'type': 'extremum'}}",),
        ('{"operation": "extremum"}',),
        ('{"operation": {"type": "ext',),
        (None,)
    ]
    df = spark.createDataFrame(rows, "raw string")
    assert [r[0] for r in df.select(records.operation_type(df["raw"])).collect()] == ["extremum", None, None, None, None]
