"""The validator of answers and citations: nine checks, recomputed within each record.

It shares no predicate, no parser and no plan with the executor in ``corpus.py``: cells are read once into a matrix of
numbers, and every check is a higher-order function over it, so that a record never leaves its row and nothing is shuffled.
Tables are expected to be small; a frontier is compared pair by pair within its record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellwise.functions.text import let
from cellwise.session import with_columns
from cellwise.sources.readers import RECORD

CHECKS = (
    "schema_valid",
    "cells_exist",
    "answer_correct",
    "numeric_comparisons_correct",
    "threshold_satisfaction",
    "relevance",
    "pareto_frontier_correct",
    "empty_result_consistency",
    "difficulty_tag_present"
)
#: What the literal fields of a record may hold.
QUESTION_TYPES = ("best_under_constraint", "threshold_filter", "tradeoff_summary", "compare_rows", "rank_models")
STEP_KINDS = ("filter", "compare", "aggregate", "select", "conclude")
COLUMN_TYPES = ("numeric", "categorical", "text")
SOURCES = ("programmatic", "llm")
OPTIMUM_SLACK, VALUE_SLACK = 1e-9, 1e-6


def reading(c: Column) -> Column:
    """The number that a cell holds, or null."""
    edges = r"(?U)^\s+|\s+$"
    plain = lambda t: F.when(t.rlike(r"^-?\d+(\.\d+)?$"), t).try_cast("double")
    inside = lambda t: F.regexp_replace(F.substring(t, F.lit(2), F.length(t) - 2), edges, "")
    return let(
        F.regexp_replace(F.translate(c, "$%,", ""), edges, ""),
        lambda t: F.when(t.startswith("(") & t.endswith(")"), -let(inside(t), plain)).otherwise(plain(t))
    )


def _satisfies(v: Column, op: Column, t: Column) -> Column:
    return F.coalesce(F.when(F.coalesce(op == "lt", F.lit(False)), v < t).otherwise(v >= t), F.lit(False))


def _no(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _shape(records: DataFrame) -> Column:
    """Whether a record has the shape of its kind; null elements of lists are left aside."""
    t, g = F.col("table"), F.col("gold_answer")
    cell = lambda c: c.isNull() | _no((c["row"] >= 0) & (c["col"] >= 0) & c["col_name"].isNotNull() & c["value"].isNotNull())
    steps = F.filter("trace_steps", lambda s: s.isNotNull())
    step = lambda s: _no(
        (s["index"] >= 0) & s["kind"].isin(*STEP_KINDS) & s["description"].isNotNull() & _no(F.forall(F.coalesce(s["cites"], F.array()), cell))
    )
    parts = [
        F.col("table_id").isNotNull(),
        F.col("domain").isNotNull(),
        F.col("question").isNotNull(),
        F.col("question_type").isin(*QUESTION_TYPES),
        F.coalesce("trace_source", F.lit(SOURCES[0])).isin(*SOURCES),
        F.size(t["headers"]) > 0, F.size(t["column_types"]) == F.size(t["headers"]), F.forall(t["column_types"], lambda c: c.isin(*COLUMN_TYPES)),
        F.forall(t["rows"], lambda r: F.size(r) == F.size(t["headers"])), t["row_labels"].isNull() | (F.size(t["row_labels"]) == F.size(t["rows"])),
        g["label"].isNotNull(),
        F.size(steps) > 0,
        F.forall(steps, step),
        F.try_element_at(steps, F.lit(-1))["kind"] == "conclude",
        F.forall(F.coalesce("evidence_cells", F.array()), cell),
    ]
    out = F.lit(True)
    for p in parts:
        out = out & _no(p)
    return out


def validate(records: DataFrame, key: str) -> DataFrame:
    """``key``, the nine checks, ``valid`` (all of them) and ``failed`` (the names of those that failed).

    ``records`` has the nested fields of question records. A record that isn't of their shape fails every check. Every
    check is false rather than null or an error where a part of the record is missing or out of range; null elements in
    a list are left aside. An operation's universe is the rows it names, or all rows where it names none.
    """
    ints, texts = F.array().cast("array<int>"), F.array().cast("array<string>")
    op = F.col("metadata.spec")
    steps = F.filter("trace_steps", lambda s: s.isNotNull())
    cites = F.flatten(F.transform(steps, lambda s: F.coalesce(s["cites"], F.array())))
    some = lambda a: F.filter(F.coalesce(a, F.array()), lambda c: c.isNotNull())
    one = records.select(
        F.col(key).alias("_key"),
        _shape(records).alias("_shape"),
        op.alias("_op"),
        F.col("gold_answer").alias("_gold"),
        F.col("table.headers").alias("_h"),
        F.coalesce("table.rows", F.array()).alias("_rows"),
        some(F.concat(F.coalesce(cites, F.array()), F.coalesce("evidence_cells", F.array()))).alias("_cells"),
        some(F.col("evidence_cells")).alias("_evidence"),
        F.try_element_at(steps, F.lit(-1))["kind"].alias("_last"),
        F.col("metadata.difficulty").alias("_level"), F.col("metadata.edge_cases").alias("_edges"),
    )
    at = lambda name: (F.array_position(F.col("_h"), name) - 1).cast("int")
    q = F.col("_op")
    two = one.select(
        "*", F.transform("_rows", lambda r: F.transform(r, reading)).alias("_num"), F.size("_rows").alias("_n"),
        at(F.coalesce(q["target"], q["m1"])).alias("_a"), at(F.coalesce(q["constraint"], q["m2"])).alias("_b"),
        F.transform(
            F.coalesce(q["conditions"], F.array()),
            lambda c: F.struct(at(c["metric"]).alias("c"), c["op"].alias("op"), c["t"].alias("t"))
        ).alias("_conds"),
        F.filter(F.coalesce(F.col("_gold.rows"), ints), lambda r: r.isNotNull()).alias("_said"),
    )
    whole = F.when(F.col("_n") > 0, F.sequence(F.lit(0), F.col("_n") - 1)).otherwise(ints)
    value = lambda i, c: F.get(F.get(F.col("_num"), i), c)
    meets = lambda i: F.forall("_conds", lambda c: _satisfies(value(i, c["c"]), c["op"], c["t"]))
    universe = F.when(q["rows"].isNull(), whole).otherwise(F.filter(q["rows"], lambda i: (i >= 0) & (i < F.col("_n"))))
    three = two.select(
        "*",
        F.transform(
            universe,
            lambda i: F.struct(i.alias("i"), value(i, F.col("_a")).alias("a"), value(i, F.col("_b")).alias("b"), meets(i).alias("ok"))
        ).alias("_pool")
    )
    best, keep, front, top = ((q["type"] == k) for k in ("best_under_constraint", "threshold_filter", "tradeoff_summary", "extremum"))
    able = F.when(
        best,
        F.filter("_pool", lambda x: x["a"].isNotNull() & _satisfies(x["b"], q["op"], q["threshold"]))
    ).when(keep, F.filter("_pool", lambda x: x["ok"])).when(top, F.filter("_pool", lambda x: x["a"].isNotNull()))
    sign = lambda v, d: F.when(_no(d == "higher"), v).otherwise(-v)
    points = F.transform(
        F.filter("_pool", lambda x: x["a"].isNotNull() & x["b"].isNotNull()),
        lambda x: F.struct(x["i"].alias("i"), sign(x["a"], q["d1"]).alias("a"), sign(x["b"], q["d2"]).alias("b"))
    )
    four = three.select(
        "*",
        F.when(~_no(front), F.coalesce(able, F.array().cast(three.schema["_pool"].dataType))).alias("_able"),
        F.when(front, points).alias("_points")
    )
    highest, lowest = F.array_max(F.transform("_able", lambda x: x["a"])), F.array_min(F.transform("_able", lambda x: x["a"]))
    five = four.select(
        "*",
        F.when(_no(q["target_dir"] == "higher"), highest).otherwise(lowest).alias("_best"),
        value(F.get("_said", F.lit(0)), F.col("_a")).alias("_first")
    )
    slack = OPTIMUM_SLACK
    beaten = lambda x: F.exists(
        "_points",
        lambda y: (y["a"] >= x["a"] - slack) & (y["b"] >= x["b"] - slack) & ((y["a"] > x["a"] + slack) | (y["b"] > x["b"] + slack))
    )
    number = lambda a: F.array_sort(F.transform(a, lambda x: x["i"]))
    want = (
        F.when(best | top, number(F.filter("_able", lambda x: F.abs(x["a"] - F.col("_best")) <= slack))).when(keep, number(F.col("_able")))
        .when(front, number(F.filter("_points", lambda x: ~beaten(x))))
    )
    six = five.select("*", want.alias("_want"))
    # columns that an operation needs and its table lacks, so that nothing can be recomputed
    needs = F.filter(
        F.concat(
            F.when(best | top, F.array(q["target"])).otherwise(texts),
            F.when(best, F.array(q["constraint"])).otherwise(texts),
            F.when(front, F.array(q["m1"], q["m2"])).otherwise(texts),
            F.when(keep, F.transform(F.coalesce(q["conditions"], F.array()), lambda c: c["metric"])).otherwise(texts)
        ),
        lambda n: F.lit(True)
    )
    seven = six.select("*", needs.alias("_needs"))
    lacking = F.exists("_needs", lambda n: ~_no(F.array_contains("_h", n)))
    said, known = F.array_sort("_said"), F.size("_said") > 0
    metrics = F.array_sort(F.array_distinct(F.coalesce(F.col("_gold.metrics"), texts))) == F.array_sort(F.array_distinct(F.array(q["m1"], q["m2"])))
    better = F.exists(
        "_able",
        lambda x: F.when(_no(q["target_dir"] == "higher"), x["a"] > F.col("_first") + slack).otherwise(x["a"] < F.col("_first") - slack)
    )
    ids = F.transform("_able", lambda x: x["i"])
    exists = lambda c: _no(
        (c["row"] >= 0) & (c["col"] >= 0) & (c["row"] < F.col("_n")) & (F.get("_h", c["col"]) == c["col_name"]) & (
            F.coalesce(F.abs(value(c["row"], c["col"]) - reading(c["value"])) <= VALUE_SLACK, F.lit(False)) | (
                F.coalesce(F.get(F.get("_rows", c["row"]), c["col"]), F.lit("")) == F.coalesce(c["value"], F.lit(""))
            )
        )
    )
    required = F.when(best & (F.size("_said") == 0), F.filter("_needs", lambda n: ~_no(n == q["target"]))).otherwise(F.col("_needs"))
    checks = {
        "cells_exist": F.forall("_cells", exists),
        "answer_correct": q["type"].isNotNull() & ~lacking & (said == F.col("_want")) & (~front | metrics),
        # of a first row that can't be compared nothing is right
        "numeric_comparisons_correct": F.when(
            best | top,
            (F.size("_able") == 0) | ~known | (F.col("_first").isNotNull() & ~better)
        ).when(keep, F.size(F.array_except(ids, F.col("_said"))) == 0).otherwise(True),
        "threshold_satisfaction": F.when(
            best | keep,
            F.when(best, F.size(F.array_except(F.col("_said"), ids)) == 0).otherwise(
                F.forall("_said", lambda i: _no((i >= 0) & (i < F.col("_n"))) & meets(i))
            )
        ).otherwise(True),
        "relevance": F.size(F.array_except(required, F.transform("_evidence", lambda c: c["col_name"]))) == 0,
        "pareto_frontier_correct": F.when(front, said == F.col("_want")).otherwise(True),
        "empty_result_consistency": known | ((F.col("_gold.label") == "none") & (F.col("_last") == "conclude")),
        "difficulty_tag_present": F.col("_level").isin("easy", "hard") & F.col("_edges").isNotNull(),
    }
    out = seven.select(
        F.col("_key").alias(key),
        F.col("_shape").alias("schema_valid"),
        *((F.col("_shape") & _no(c)).alias(n) for n, c in checks.items())
    )
    failed = F.array_compact(F.array(*(F.when(~F.col(n), F.lit(n)) for n in CHECKS)))
    return with_columns(out, failed=failed).withColumn("valid", F.size("failed") == 0)


def validate_texts(texts: DataFrame, key: str, text: str) -> DataFrame:
    """As ``validate`` for records delivered as JSON texts; a text that is no record fails every check."""
    parsed = texts.select(F.col(key).alias("_k"), F.from_json(text, RECORD, {"mode": "PERMISSIVE"}).alias("_r"))
    return validate(parsed.select(F.col("_k").alias(key), "_r.*"), key)


def assert_valid(checked: DataFrame) -> int:
    """How many records were checked; an error that names the failed checks if any failed."""
    bad = checked.where("not valid").select(F.explode("failed").alias("check")).groupBy("check").agg(F.count("*").alias("n")).collect()  # at most nine rows
    if bad:
        raise ValueError("invalid records: " + ", ".join(f"{r['check']} {r['n']}" for r in sorted(bad, key=lambda r: r["check"])))
    return checked.count()
