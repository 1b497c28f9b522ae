"""Readers of the record formats; schemas are given, never inferred from the data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CELL = "struct<row:int,col:int,col_name:string,value:string>"
SPEC = "struct<type:string,target:string,target_dir:string,constraint:string,op:string,threshold:double,conditions:array<struct<metric:string,op:string,t:double>>,m1:string,m2:string,d1:string,d2:string,rows:array<int>>"
RECORD = (
    "table_id string, domain string, question string, question_type string, trace_source string, split string, "
    "table struct<headers:array<string>,rows:array<array<string>>,row_labels:array<string>,column_types:array<string>>, "
    "gold_answer struct<label:string,rows:array<int>,metrics:array<string>>, "
    f"trace_steps array<struct<index:int,kind:string,description:string,cites:array<{CELL}>>>, evidence_cells array<{CELL}>, "
    f"metadata struct<difficulty:string,edge_cases:array<string>,example_id:string,spec:{SPEC},orientation:string,confidence:string,source:struct<dataset:string,uid:string,attribution:string>,verified_by:string,native_gold:array<string>,seed:int,generator_version:string,table_index:int,silver:boolean>"
)
CONTEXT_FIELDS = "table:struct<uid:string,table:array<array<string>>>,questions:array<struct<question:string,answer_from:string,answer:string,derivation:string>>"


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Question records, one JSON object a line; blank lines are skipped, broken ones are kept in ``_corrupt``."""
    return spark.read.schema(RECORD + ", _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def read_contexts(spark: SparkSession, path: str, table_only: bool = False, limit: int | None = None) -> DataFrame:
    """Raw grids with ``ordinal``, their place in the JSON array; on demand only those with a question answered from the table, the first ``limit`` of them.

    An array is one document, so that the ordinals come from its own order; of several files each counts for itself.
    """
    df = _arrays(spark, path)
    df = semi_table_only(df) if table_only else df
    return df.orderBy("file", "ordinal").limit(limit) if limit is not None else df


def _arrays(spark: SparkSession, path: str) -> DataFrame:
    texts = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("file"),
        F.posexplode(F.from_json("value", f"array<struct<{CONTEXT_FIELDS}>>")).alias("ordinal", "c")
    )
    return texts.select("file", "ordinal", "c.*")


def ingest_file(spark: SparkSession, path: str, table_only: bool = False, limit: int | None = None) -> DataFrame:
    """The clean table of each context of a file, with its place in the file and its ``uid``."""
    from cellwise.operators.grid import ingest_records

    c = read_contexts(spark, path, table_only, limit).select(
        "file",
        "ordinal",
        F.col("table.uid").alias("uid"),
        F.format_string("table_%04d", F.col("ordinal")).alias("table_id"),
        F.col("table.table").alias("_grid")
    )
    clean = ingest_records(c, "table_id", "_grid")
    return clean.join(c.select("table_id", "uid", "ordinal"), "table_id")


def semi_table_only(contexts: DataFrame) -> DataFrame:
    return contexts.where(F.coalesce(F.exists("questions", lambda q: q["answer_from"] == "table"), F.lit(False)))


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """The ``details`` of results files, one row each."""
    detail = "struct<example_id:string,type:string,parsed:boolean,render_error:string,raw:string,op_present:boolean,whole_op:boolean,engine_ok:boolean,engine_err:boolean,model_ok:boolean,valid:boolean,grounded:boolean>"
    return spark.read.schema(f"details array<{detail}>").option("multiLine", True).json(path).select(F.inline("details"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A split manifest as ``base_table_id``, ``role``."""
    roles = ("training_tables", "exclude_from_training", "eval_tables_dev", "eval_tables_test", "future_train_pool", "verified_tables")
    m = spark.read.schema(", ".join(f"{r} array<string>" for r in roles)).option("multiLine", True).json(path)
    return m.select(
        F.explode(F.array(*(F.struct(F.lit(r).alias("role"), F.col(r).alias("ids")) for r in roles))).alias("x")
    ).select(F.explode("x.ids").alias("base_table_id"), F.col("x.role").alias("role"))


def read_keyed(spark: SparkSession, path: str, value: str = "array<string>") -> DataFrame:
    """A JSON object keyed by id as ``card_id``, ``value``."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", f"map<string,{value}>")).alias("card_id", "value"))


def read_template(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()["value"]
