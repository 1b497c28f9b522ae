"""The gate before training: every completion is read back, validated and executed again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellwise.operators import corpus, matching, records, validator


def round_trip(examples: DataFrame, key: str) -> DataFrame:
    """``key``, ``failed``: what fails when a record's completion is parsed, rebuilt, validated, and its operation executed over the table's entities.

    ``failed`` has the validator's checks, ``operation_exec`` where the engine's answer isn't the gold answer, and
    ``unparsed`` where the completion can't be read back; it is empty for a record that may be trained on. Keys are
    unique.
    """
    text = records.completion(examples)
    base = examples.select(
        F.col(key).alias("_k"),
        "table_id",
        "domain",
        "table",
        "question",
        "question_type",
        "trace_source",
        "metadata",
        "gold_answer",
        matching.reconstruct(text, F.col("table.headers")).alias("_a"),
        records.runnable(records.extract_operation(text)).alias("_o")
    )
    steps = F.transform(
        "_a.trace_steps",
        lambda s, i: F.struct(
            i.alias("index"),
            s["kind"].alias("kind"),
            s["description"].alias("description"),
            F.transform(s["cites"], lambda c: matching.cell(c, F.col("table.headers"))).alias("cites")
        )
    )
    rebuilt = base.select(
        "_k",
        "table_id",
        "domain",
        "table",
        "question",
        "question_type",
        F.lit("llm").alias("trace_source"),
        "metadata",
        F.col("_a.final_answer").alias("gold_answer"),
        steps.alias("trace_steps"),
        F.col("_a.evidence_cells").alias("evidence_cells")
    )
    verdict = validator.validate(rebuilt, "_k").select("_k", "failed")
    bound = base.select(
        "_k",
        "table",
        F.when(F.col("_o").isNotNull(), corpus.bind_universe(F.col("_o"), F.coalesce("table.rows", F.array()))).alias("_o"),
        "gold_answer"
    )
    e = corpus.execute(bound, "_k", "table.headers", "table.rows", "_o", "table.row_labels").select("_k", "answer", "metrics", "error")
    j = base.select("_k", "gold_answer", F.col("_a").isNull().alias("lost")).join(verdict, "_k").join(e, "_k")
    front = F.size("metrics") > 0
    agrees = F.col("error").isNull() & (F.col("answer") == F.array_sort(F.coalesce("gold_answer.rows", F.array()))) & (
        ~front | (F.array_sort("metrics") == F.array_sort(F.coalesce("gold_answer.metrics", F.array())))
    )
    more = F.array_compact(F.array(F.when(~F.coalesce(agrees, F.lit(False)), "operation_exec"), F.when(F.col("lost"), "unparsed")))
    return j.select(F.col("_k").alias(key), F.concat("failed", more).alias("failed"))


def trainable(examples: DataFrame, key: str) -> DataFrame:
    """The chat records of ``examples``; an error that names what failed if any of them doesn't survive the round trip."""
    bad = round_trip(examples, key).where(F.size("failed") > 0).select(F.explode("failed").alias("f")).groupBy("f").agg(F.count("*").alias("n")).collect()  # a few names
    if bad:
        raise ValueError("round trip fails: " + ", ".join(f"{r['f']} {r['n']}" for r in sorted(bad, key=lambda r: r["f"])))
    return records.chat(examples)
