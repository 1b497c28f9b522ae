"""Question records as prompts, completions, chat records, flat rows and cards."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A string with its escapes (also one left open), or a brace.
_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*(?:"|$)|[{}]', re.S)

PROMPT = "Answer the question from the table.\n\n{TABLE}\n\nQuestion: {QUESTION}\n"


def markdown(headers: Column, rows: Column) -> Column:
    """A table in markdown: the header, a rule, and a line for each row; null cells are empty."""
    line = lambda cells: F.concat(F.lit("| "), F.array_join(F.transform(cells, lambda c: F.coalesce(c, F.lit(""))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.transform(headers, lambda h: F.lit("---")), " | "), F.lit(" |"))
    return F.array_join(F.concat(F.array(line(headers), rule), F.transform(F.coalesce(rows, F.array().cast("array<array<string>>")), line)), "\n")


def prompt(table: Column, question: Column, template: str = PROMPT) -> Column:
    return F.replace(F.replace(F.lit(template), F.lit("{TABLE}"), table), F.lit("{QUESTION}"), question)


def named_operation(spec: Column) -> Column:
    """An operation by the names of its measures only, as JSON: no row numbers, ge as gte."""
    op = F.when(spec["op"] == "ge", "gte").otherwise(spec["op"])
    conds = F.transform(
        spec["conditions"],
        lambda c: F.named_struct(F.lit("metric"), c["metric"], F.lit("op"), F.when(c["op"] == "ge", "gte").otherwise(c["op"]), F.lit("T"), c["t"])
    )
    t = spec["type"]
    return (
        F.when(
            t == "best_under_constraint",
            F.to_json(
                F.struct(
                    t.alias("type"),
                    spec["target"].alias("target"),
                    spec["target_dir"].alias("target_dir"),
                    spec["constraint"].alias("constraint"),
                    op.alias("op"),
                    spec["threshold"].alias("threshold")
                )
            )
        )
        .when(t == "threshold_filter", F.to_json(F.struct(t.alias("type"), conds.alias("conditions"))))
        .when(
            t == "tradeoff_summary",
            F.to_json(F.struct(t.alias("type"), spec["m1"].alias("m1"), spec["m2"].alias("m2"), spec["d1"].alias("d1"), spec["d2"].alias("d2")))
        )
        .when(t == "extremum", F.to_json(F.struct(t.alias("type"), spec["target"].alias("target"), spec["target_dir"].alias("target_dir"))))
    )


def completion(records: DataFrame) -> Column:
    """The target text of a record: its steps, its answer and its operation, as JSON."""
    steps = F.transform(
        "trace_steps",
        lambda s: F.named_struct(
            F.lit("kind"),
            s["kind"],
            F.lit("description"),
            s["description"],
            F.lit("cites"),
            F.transform(s["cites"], lambda c: F.named_struct(F.lit("row"), c["row"], F.lit("col_name"), c["col_name"], F.lit("value"), c["value"]))
        )
    )
    return F.to_json(
        F.struct(
            steps.alias("trace_steps"),
            F.col("gold_answer").alias("final_answer"),
            F.parse_json(named_operation(F.col("metadata.spec"))).alias("operation")
        )
    )


def chat(records: DataFrame) -> DataFrame:
    """``example_id``, ``question_type``, ``messages``: the prompt of the user and the completion of the assistant."""
    user = prompt(markdown(F.col("table.headers"), F.col("table.rows")), F.coalesce("question", F.lit("")))
    message = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return records.select(
        F.col("metadata.example_id").alias("example_id"),
        "question_type",
        F.array(message("user", user), message("assistant", completion(records))).alias("messages")
    )


def flat(records: DataFrame) -> DataFrame:
    """The 16 columns of a flat audit export."""
    joined = lambda c: F.array_join(c, "; ")
    return records.select(
        F.col("metadata.example_id").alias("example_id"),
        "table_id",
        "domain",
        "question_type",
        "question",
        F.col("gold_answer.label").alias("gold_label"),
        joined(F.transform("gold_answer.rows", lambda x: x.cast("string"))).alias("gold_rows"),
        joined(F.col("gold_answer.metrics")).alias("gold_metrics"),
        F.size("table.rows").alias("n_rows"),
        F.size("table.headers").alias("n_cols"),
        F.size("trace_steps").alias("n_steps"),
        F.size("evidence_cells").alias("n_evidence"),
        F.col("metadata.difficulty").alias("difficulty"),
        joined(F.col("metadata.edge_cases")).alias("edge_cases"),
        F.col("metadata.source.uid").alias("uid"),
        "split",
    )


def question_text(
    kind: str,
    noun: Column,
    target: Column,
    direction: str,
    constraint: Column | None = None,
    op: str = "gte",
    threshold: Column | None = None,
    has_totals: Column | None = None
) -> Column:
    """The text of a question from its parts; where the table has totals, it says that they don't count."""
    word = "highest" if direction == "higher" else "lowest"
    if kind == "extremum":
        q = F.concat(F.lit("Which "), noun, F.lit(f" has the {word} "), target, F.lit("?"))
    elif kind == "threshold_filter":
        q = F.concat(
            F.lit("Which "),
            noun,
            F.lit(" entries have "),
            target,
            F.lit(" of at least " if op != "lt" else " under "),
            threshold,
            F.lit("?")
        )
    else:
        q = F.concat(
            F.lit("Which "),
            noun,
            F.lit(f" has the {word} "),
            target,
            F.lit(" with "),
            constraint,
            F.lit(" of at least " if op != "lt" else " under "),
            threshold,
            F.lit("?")
        )
    return q if has_totals is None else F.concat(q, F.when(has_totals, " Exclude any total or subtotal rows.").otherwise(""))


def _first_object(text: str | None) -> str | None:
    """The first balanced object of a text, with regard to strings and escapes."""
    if text is None:
        return None
    start, depth = text.find("{"), 0
    for m in _TOKEN.finditer(text, max(start, 0)) if start >= 0 else ():
        if m[0] == "{":
            depth += 1
        elif m[0] == "}":
            depth -= 1
            if not depth:
                return text[start : m.end()]
    return None


def first_object(c: Column) -> Column:
    """The first balanced ``{...}`` of a text, or null: a scan that no built-in expression has, in Arrow batches."""
    @F.pandas_udf(T.StringType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(_first_object)

    return run(c)


OPERATION = "operation struct<type:string,target:string,target_dir:string,constraint:string,op:string,threshold:double,m1:string,m2:string,d1:string,d2:string,conditions:array<struct<metric:string,op:string,T:double>>>"
_STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}


def extract_operation(raw: Column) -> Column:
    """The operation within a model's answer, or null where it has none or the JSON is not strict."""
    return F.from_json(first_object(raw), OPERATION, _STRICT)["operation"]


def operation_type(raw: Column) -> Column:
    """The type of the operation within a model's answer; null where it has none or the JSON is not strict."""
    return F.from_json(first_object(raw), "operation struct<type:string>", _STRICT)["operation"]["type"]


def runnable(op: Column) -> Column:
    """An extracted operation in the form that ``corpus.execute`` takes, with no universe."""
    conds = F.transform(op["conditions"], lambda c: F.struct(c["metric"].alias("metric"), c["op"].alias("op"), c["T"].alias("t")))
    fields = [op[f].alias(f) for f in ("type", "target", "target_dir", "constraint", "op", "threshold")]
    return F.when(
        op.isNotNull(),
        F.struct(
            *fields,
            conds.alias("conditions"),
            *(op[f].alias(f) for f in ("m1", "m2", "d1", "d2")),
            F.lit(None).cast("array<int>").alias("rows")
        )
    )


def compare_operations(model: Column, gold: Column) -> Column:
    """Whether a model's operation agrees with the gold one in each field that the gold's type has (null for others), and as a ``whole``.

    Numbers agree within 1e-6 of the gold's size, ge is gte, conditions are compared in the order of their measures, the
    two measures of a trade-off as a set. An operation of null agrees in nothing.
    """
    canon = lambda c: F.when(c == "ge", "gte").otherwise(c)
    near = lambda x, y: F.coalesce(F.abs(x - y) <= 1e-6 * F.greatest(F.lit(1.0), F.abs(y)), x.isNull() & y.isNull())
    sorted_ = lambda a: F.array_sort(
        F.transform(
            F.coalesce(a, F.array()),
            lambda c: F.struct(F.coalesce(c["metric"], F.lit("")).alias("metric"), canon(c["op"]).alias("op"), c["t"].alias("t"))
        )
    )
    a, b = sorted_(model["conditions"]), sorted_(gold["conditions"])
    pairs = F.zip_with(a, b, lambda x, y: F.coalesce((x["metric"] == y["metric"]) & x["op"].eqNullSafe(y["op"]) & near(x["t"], y["t"]), F.lit(False)))
    t = gold["type"]
    best, keep, front, top = ((t == k) for k in ("best_under_constraint", "threshold_filter", "tradeoff_summary", "extremum"))
    same = lambda f: model[f].eqNullSafe(gold[f])
    pair = lambda o: F.array_sort(F.array_distinct(F.array(o["m1"], o["m2"])))
    fields = {
        "type": same("type"),
        "target": F.when(best | top, same("target")),
        "target_dir": F.when(best | top, same("target_dir")),
        "constraint": F.when(best, same("constraint")),
        "op": F.when(best, canon(model["op"]).eqNullSafe(canon(gold["op"]))), "threshold": F.when(best, near(model["threshold"], gold["threshold"])),
        "conditions": F.when(keep, (F.size(a) == F.size(b)) & F.forall(pairs, lambda x: x)),
        "metrics": F.when(front, pair(model) == pair(gold)),
        "dirs": F.when(front, same("d1") & same("d2")),
    }
    whole = model.isNotNull()
    for c in fields.values():
        whole = whole & F.coalesce(c, F.lit(True))
    return F.struct(*(c.alias(n) for n, c in fields.items()), F.coalesce(whole, F.lit(False)).alias("whole"))
