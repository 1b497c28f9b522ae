"""Writers; each writes in parallel and commits as a whole."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON object a line, in UTF-8, with other scripts kept as they are; nulls are written as such."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A flat export with a header in each part."""
    df.write.mode(mode).option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


#: Ids that a manifest of one row may hold.
MANIFEST_IDS = 100_000


def manifest(roles: DataFrame, key: str = "base_table_id", role: str = "role") -> DataFrame:
    """One row with the sorted ids of each role and their counts, to be written as JSON.

    For the few reserved tables that a person reads; more than MANIFEST_IDS ids are an error, ``write_manifest`` has no
    such bound.
    """
    distinct = roles.select(key, role).distinct()
    n = distinct.count()
    if n > MANIFEST_IDS:
        raise ValueError(f"{n} ids are too many for a manifest of one row; use write_manifest")
    per = distinct.groupBy(role).agg(F.array_sort(F.collect_list(key)).alias("ids"))
    return per.groupBy().agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(role, "ids")))).alias("roles"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(role), F.size("ids").alias("n"))))).alias("counts")
    )


def write_manifest(roles: DataFrame, path: str, key: str = "base_table_id", role: str = "role", mode: str = "errorifexists") -> None:
    """The distinct ids of each role, a folder of JSON lines for each role beside one of their counts."""
    distinct = roles.select(key, role).distinct()
    distinct.write.mode(mode).partitionBy(role).json(f"{path}/ids")
    distinct.groupBy(role).agg(F.count("*").alias("n")).coalesce(1).write.mode(mode).json(f"{path}/counts")


def report_json(df: DataFrame) -> str:
    """A report of one row as JSON text."""
    return json.dumps(json.loads(df.select(F.to_json(F.struct("*"))).first()[0]), ensure_ascii=False, indent=1)
