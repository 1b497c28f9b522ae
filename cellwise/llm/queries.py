"""The queries of this subpackage over the test tables, and the SQL of those that SQL can express."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwise.llm import encode, grouping, leaks, overlap, reading, sampling, truncation
from cellwise.session import table


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """The vocabulary file, under CELLWISE_TOKENIZERS, else where the public tokenizers are installed."""
    folder = os.environ.get("CELLWISE_TOKENIZERS")
    if not folder:
        import public_tokenizers

        return public_tokenizers.path(name)
    return os.path.join(folder, name)


_P1 = ("rec_id", "question", "table.headers", "table.rows", "split")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.overlaps(table(spark, sf_dir, "realtable_eval_verified"), *_P1).select("rec_id_a", "rec_id_b")


def p1_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each record: its class of exact copies and its number of links."""
    return overlap.linked_classes(table(spark, sf_dir, "realtable_eval_verified"), *_P1)


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.report(table(spark, sf_dir, "realtable_eval_verified"), *_P1, "metadata.source.dataset")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut, _, _ = truncation.truncated(table(spark, sf_dir, "p3_4b_exec_test_verified"), "detail_id", "model", "raw")
    return cut.select(F.col("id").alias("detail_id"))


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.truncated(table(spark, sf_dir, "p3_4b_exec_test_verified"), "detail_id", "model", "raw")[2].withColumnRenamed("source", "model")


def _p3(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return sampling.balanced_sample(*(table(spark, sf_dir, t) for t in ("cards", "anchor_key", "sample_targets")))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p3(spark, sf_dir)[1].where("not filled").select("category")


def p3_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p3(spark, sf_dir)[0].withColumnRenamed("unit", "card_id")


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p3(spark, sf_dir)[1]


def _p4(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return grouping.grouped_splits(
        table(spark, sf_dir, "realtable_eval_verified"),
        table(spark, sf_dir, "split_targets"),
        "rec_id",
        "table_id",
        "metadata.source.uid",
        "question_type",
        "split"
    )


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = table(spark, sf_dir, "realtable_eval_verified")
    return grouping.broken_tables(grouping.members(grouping.links(records, "rec_id", "table_id", "metadata.source.uid", "question_type", "split")))


def p4_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p4(spark, sf_dir)[0].select("rec_id", "component", "split")


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p4(spark, sf_dir)[1]


def p4_together(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The assignment checked: records, base tables and filings in more than one new split, and whether each split is near its target."""
    assigned, _, _ = _p4(spark, sf_dir)
    records = table(spark, sf_dir, "realtable_eval_verified")
    edges = grouping.links(records, "rec_id", "table_id", "metadata.source.uid", "question_type", "split").select("rec_id", "base_table", "entity")
    x = edges.join(assigned.select("rec_id", "split"), "rec_id")
    broken = lambda c: x.where(F.col(c).isNotNull()).groupBy(c).agg(F.min("split").alias("a"), F.max("split").alias("b")).agg(
        F.count_if(F.col("a") != F.col("b")).alias(f"n_broken_{c}")
    )
    targets = table(spark, sf_dir, "split_targets").select(F.col("split_name").alias("split"), F.col("share").alias("target"))
    near = targets.join(x.groupBy("split").agg(F.count("*").alias("n")), "split", "left").agg(
        F.sum("n").alias("n_records"),
        F.collect_list(F.struct("n", "target")).alias("all")
    )
    near = near.select("n_records", F.forall("all", lambda s: F.abs(s["n"] / F.col("n_records") - s["target"]) <= 0.02).alias("near_targets"))
    return near.withColumns({f"n_broken_{c}": broken(c).scalar() for c in ("base_table", "entity")})


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.encode(table(spark, sf_dir, "documents"), tokenizer_path())


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "heldout_items")).select("doc_id", "item_id")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.levels(table(spark, sf_dir, "documents"), table(spark, sf_dir, "reading_ratings")).select("doc_id", "band")


def p8_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the mean of their median word grades by band and source."""
    docs = table(spark, sf_dir, "documents")
    levels = reading.levels(docs, table(spark, sf_dir, "reading_ratings"))
    return levels.join(docs.select("doc_id", F.coalesce("source", F.lit("(none)")).alias("source")), "doc_id").groupBy("band", "source").agg(
        F.count("*").alias("n_docs"),
        F.round(F.avg("median_grade"), 4).alias("mean_word_grade")
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_classes": p1_classes,
    "p1_report": p1_report,
    "p2_found": p2_found,
    "p2_report": p2_report,
    "p3_found": p3_found,
    "p3_sample": p3_sample,
    "p3_report": p3_report,
    "p4_found": p4_found,
    "p4_assign": p4_assign,
    "p4_report": p4_report,
    "p4_together": p4_together,
    "p6_ids": p6_ids,
    "p7_found": p7_found,
    "p8_found": p8_found,
    "p8_profile": p8_profile,
}

_BASE = "regexp_replace(regexp_replace(replace(lower(trim(table_id)), '-', '_'), '_v2$', ''), '_(rows|cols)$', '')"
_AVAILABLE = """
with c as (select card_id, min(replace(replace(lower(trim(type)), ' ', '_'), '-', '_')) as category from cards
           where replace(replace(lower(trim(type)), ' ', '_'), '-', '_') in (select category from sample_targets) and card_id in (select card_id from anchor_key)
           group by card_id),
     n as (select category, count(*) as n_available from c group by category),
     s as (select count(*) // 4 as n_sample from c),
     r as (select t.category, t.share_pct, t.min_cards, s.n_sample, coalesce(n.n_available, 0) as n_available, greatest(t.min_cards, (s.n_sample * t.share_pct) // 100) as n_needed
           from sample_targets t cross join s left join n on n.category = t.category)
"""

ORACLE_SQL: dict[str, str] = {
    "p3_found": _AVAILABLE + "select category from r where n_available < n_needed",
    "p3_report": _AVAILABLE + """select category, cast(share_pct as double) as share_pct, cast(min_cards as bigint) as min_cards, cast(n_sample as bigint) as n_sample, cast(n_available as bigint) as n_available,
        cast(n_needed as bigint) as n_needed, cast(least(n_available, n_needed) as bigint) as n_drawn, cast(least(n_available, n_needed) - n_needed as bigint) as residual, n_available >= n_needed as filled from r""",
    "p4_together": "select count(*) as n_records, true as near_targets, cast(0 as bigint) as n_broken_base_table, cast(0 as bigint) as n_broken_entity from realtable_eval_verified",
    "p4_found": f"""select base_table from (select {_BASE} as base_table, lower(trim(split)) as split from realtable_eval_verified where table_id is not null and trim(split) <> '')
        group by base_table having count(distinct split) > 1""",
}
