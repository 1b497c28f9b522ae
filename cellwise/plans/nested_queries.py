"""The queries of the nested records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwise.operators import nested
from cellwise.session import table

FIELDS = ("trace_steps", "evidence_cells", "gold_answer")


def typed_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return nested.flatten(table(spark, sf_dir, "realtable_eval_verified").select("rec_id", *FIELDS), "rec_id")


def raw_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return nested.flatten(nested.from_json_texts(table(spark, sf_dir, "realtable_raw").select("rec_id", "line"), "line", FIELDS), "rec_id")


def _references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.cell_references(typed_tables(spark, sf_dir)).unionAll(nested.cell_references(raw_tables(spark, sf_dir)))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The references in the 32-bit form that is asked for; ``p5_outside`` counts those that don't fit it."""
    r = _references(spark, sf_dir)
    return r.where(nested.in_int(r)).select("rec_id", "path", *(F.col(c).cast("int").alias(c) for c in ("step_pos", "pos", "row_no")))


def p5_outside(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By path: the references, and those whose place or row number doesn't fit 32 bits."""
    r = _references(spark, sf_dir)
    return r.groupBy("path").agg(F.count("*").alias("n"), F.count_if(~nested.in_int(r)).alias("n_outside"))


def p5_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The steps of the typed records with the number of their cell references: a child table joined with its own children."""
    t = typed_tables(spark, sf_dir)
    cites = t["trace_steps.cites"].groupBy("_key", F.element_at("_ordinals", 1).alias("_place")).agg(F.count("*").alias("n_cites"))
    return t["trace_steps"].join(cites, ["_key", "_place"], "left").select(
        F.col("_key").alias("rec_id"),
        F.col("_place").cast("int").alias("step_pos"),
        "kind",
        F.coalesce("n_cites", F.lit(0)).alias("n_cites")
    )


def p5_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The root table of the typed records."""
    return typed_tables(spark, sf_dir)["record"].select(F.col("_key").alias("rec_id"), F.col("`gold_answer.label`").alias("gold_label"))


QUERIES = {"p5_found": p5_found, "p5_outside": p5_outside, "p5_steps": p5_steps, "p5_records": p5_records}

ORACLE_SQL = {
    "p5_steps": """select rec_id, cast(i - 1 as integer) as step_pos, s.kind as kind, cast(coalesce(len(s.cites), 0) as bigint) as n_cites
        from (select rec_id, generate_subscripts(trace_steps, 1) as i, unnest(trace_steps) as s from realtable_eval_verified)""",
    "p5_records": "select rec_id, gold_answer.label as gold_label from realtable_eval_verified",
}
