"""Queries of generated questions and datasets, of turned tables, and of the gates that they pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwise.operators import corpus, generate, grid, questions, roundtrip
from cellwise.plans import corpus_sql as sql
from cellwise.session import table

QUERIES, ORACLE_SQL = {}, {}
R = "realtable_eval_verified"


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


_UNI = "cast(concat('0x', substr(md5(concat('0:', p_brand)), 1, 8)) as bigint) / 4294967296.0"
_joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
_LIMIT = f"""u as (select p_brand, list_sort(list(distinct cast(p_size as double))) as u from part group by 1), k as (select p_brand, u, cast(floor({_UNI} * (len(u) - 1)) as integer) as k from u),
    t as (select p_brand, (u[k + 1] + u[k + 2]) / 2 as m, list_contains(u, (u[k + 1] + u[k + 2]) / 2) as taken from k), l as (select p_brand, round(m + case when taken then 1e-6 else 0 end, 6) as threshold from t)"""


@query(f"""with {_LIMIT}, s as (select part.*, threshold from part join l using (p_brand) where p_size < threshold), b as (select p_brand, max(p_retailprice) as best from s group by 1),
    w as (select s.p_brand, string_agg(p_partkey::varchar, ',' order by p_partkey) as answer, count(*) as n from s join b on s.p_brand = b.p_brand where abs(p_retailprice - best) <= 1e-9 group by 1)
    select l.p_brand, concat('Which p_partkey has the highest p_retailprice with p_size under ', cast(threshold as varchar), '?') as question, threshold, coalesce(answer, '') as answer, case when coalesce(n, 0) = 0 then 'empty' when n > 1 then 'argmax_tie' end as edge,
    case when coalesce(n, 0) <> 1 then 'hard' else 'easy' end as difficulty from l left join w on l.p_brand = w.p_brand""")
def gen_best(spark: SparkSession, d: str) -> DataFrame:
    q = generate.best_questions(table(spark, d, "part"), "p_brand", "p_partkey", "p_retailprice", "p_size", "lower", "normal")
    return q.withColumn("answer", _joined("answer"))


@query("select p_brand, '' as answer, 'empty' as edge, 'hard' as difficulty from part group by 1")
def gen_best_empty(spark: SparkSession, d: str) -> DataFrame:
    q = generate.best_questions(table(spark, d, "part"), "p_brand", "p_partkey", "p_retailprice", "p_size", "lower", "empty")
    return q.select("p_brand", _joined("answer").alias("answer"), "edge", "difficulty")


@query(f"""with {_LIMIT}, w as (select p_brand, string_agg(p_partkey::varchar, ',' order by p_partkey) as answer, count(*) as n from part join l using (p_brand) where p_size >= threshold group by 1)
    select l.p_brand, concat('Which p_partkeys have p_size of at least ', cast(threshold as varchar), '?') as question, coalesce(answer, '') as answer, case when n is null then 'empty' end as edge, case when n is null then 'hard' else 'easy' end as difficulty from l left join w on l.p_brand = w.p_brand""")
def gen_threshold(spark: SparkSession, d: str) -> DataFrame:
    return generate.filter_questions(
        table(spark, d, "part"),
        "p_brand",
        "p_partkey",
        "p_size",
        "higher",
        "normal"
    ).withColumn("answer", _joined("answer"))


@query("""with f as (select * from part a where not exists (select 1 from part b where b.p_brand = a.p_brand and b.p_size >= a.p_size and b.p_retailprice <= a.p_retailprice + 1e-9 and (b.p_size > a.p_size or b.p_retailprice < a.p_retailprice - 1e-9))),
    w as (select p_brand, string_agg(p_partkey::varchar, ',' order by p_partkey) as answer, count(*) as n from f group by 1), c as (select p_brand, count(*) as m from part group by 1)
    select p_brand, 'What is the trade-off between p_size and p_retailprice across these p_partkeys?' as question, answer, case when n = 1 then 'single_dominator' when n = m then 'no_domination' end as edge, case when n = 1 or n = m then 'hard' else 'easy' end as difficulty from w join c using (p_brand)""")
def gen_tradeoff(spark: SparkSession, d: str) -> DataFrame:
    return generate.tradeoff_questions(
        table(spark, d, "part"),
        "p_brand",
        "p_partkey",
        "p_size",
        "p_retailprice",
        "higher",
        "lower"
    ).withColumn("answer", _joined("answer"))


@query("""with b as (select c_nationkey, min(c_acctbal) as best from customer group by 1), w as (select c.c_nationkey, string_agg(c_custkey::varchar, ',' order by c_custkey) as answer, count(*) as n from customer c join b on c.c_nationkey = b.c_nationkey where abs(c_acctbal - best) <= 1e-9 group by 1)
    select c_nationkey, 'Which c_custkey has the lowest c_acctbal?' as question, answer, case when n > 1 then 'argmax_tie' end as edge, case when n > 1 then 'hard' else 'easy' end as difficulty from w""")
def gen_extremum(spark: SparkSession, d: str) -> DataFrame:
    return generate.extremum_questions(
        table(spark, d, "customer"),
        "c_nationkey",
        "c_custkey",
        "c_acctbal",
        "lower"
    ).withColumn("answer", _joined("answer"))


@query(
    "select type, cast(100 as bigint) as n, cast(100 as bigint) as n_engine, cast(0 as bigint) as n_invalid from (values ('best_under_constraint'), ('threshold_filter'), ('tradeoff_summary')) t(type)"
)
def synthetic_dataset(spark: SparkSession, d: str) -> DataFrame:
    """300 records over generated tables by kind: all valid, and their answers reached by the engine as well."""
    valid, invalid = questions.synthetic_dataset(spark, 300)
    e = corpus.execute(valid.withColumn("_id", F.col("metadata.example_id")), "_id", "table.headers", "table.rows", "metadata.spec")
    same = valid.select(
        F.col("metadata.example_id").alias("_id"),
        F.col("question_type").alias("type"),
        F.col("gold_answer.rows").alias("g")
    ).join(e, "_id")
    wrong = invalid.groupBy(F.col("question_type").alias("type")).agg(F.count("*").alias("n_invalid"))
    return same.groupBy("type").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("answer") == F.col("g")).alias("n_engine")
    ).join(wrong, "type", "left").fillna(0, ["n_invalid"])


def _real_tables(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, R).where(
        "table.headers is not null and table.rows is not null and table.column_types is not null and size(table.column_types) = size(table.headers)"
    )
    whole = F.struct(
        F.col("table.headers").alias("headers"),
        F.transform("table.rows", lambda x: F.transform(x, lambda c: F.coalesce(c, F.lit("")))).alias("rows"),
        F.lit(None).cast("array<string>").alias("row_labels"),
        F.transform(
            "table.headers",
            lambda h, i: F.when(i == 0, "categorical").otherwise(grid.value_type(F.transform("table.rows", lambda x: F.get(x, i))))
        ).alias("column_types")
    )
    unique = F.size(F.array_distinct("table.headers")) == F.size("table.headers")
    return r.where(unique & F.forall("table.rows", lambda x: F.size(x) == F.size("table.headers"))).select(
        F.concat(F.lit("r"), F.col("rec_id").cast("string")).alias("table_id"),
        whole.alias("table"),
        F.col("metadata.source.uid").alias("uid"),
        F.col("metadata.source.dataset").alias("dataset"),
        F.lit("high").alias("confidence")
    )


@query(
    "select orientation, question_type, true as some, cast(0 as bigint) as n_invalid from (values ('across_rows'), ('across_columns')) o(orientation), (values ('best_under_constraint'), ('threshold_filter'), ('tradeoff_summary')) t(question_type)".replace(" as some", ' as "any"')
)
def real_dataset(spark: SparkSession, d: str) -> DataFrame:
    """Questions of every kind over every table in both orientations: none that the validator finds wrong."""
    q = questions.real_dataset(_real_tables(spark, d))
    return q.groupBy(F.col("metadata.orientation").alias("orientation"), "question_type").agg(
        (F.count("*") > 0).alias("any"),
        F.count_if(~F.col("valid")).alias("n_invalid")
    )


_TURNED = f"""src as (select rec_id, "table".headers as h, "table"."rows" as rw from {R} where "table".headers is not null and "table"."rows" is not null),
    k as (select rec_id, h, rw, list_concat([h[1]], list_transform(rw, lambda r: coalesce(r[1], ''))) as raw from src where len(rw) > 0 and len(h) >= 2),
    n as (select *, list_transform(raw, lambda x: case when trim(coalesce(x, '')) = '' then 'period' else x end) as named from k),
    m as (select rec_id, h, rw, named, list_transform(rw, lambda r: list_filter(r[2:], lambda c: not regexp_matches(trim(regexp_replace(coalesce(c, ''), '[$%]', '', 'g')), '^[-‒–—―�*\\s]*$') and not regexp_matches(lower(trim(regexp_replace(c, '[$%]', '', 'g'))), '^(n/?a|n\\.a\\.?|nm|nil|--+)$'))) as known from n),
    t as (select rec_id, h, rw, named, list_transform(known, lambda v: case when len(v) > 0 and len(list_filter(v, lambda c: {sql.number('c')} is null)) = 0 then 'numeric' when len(v) > 0 and len(list_distinct(list_transform(v, lambda c: trim(c)))) <= greatest(2, len(v) // 2) then 'categorical' else 'text' end) as types from m)"""


@query(f"""with {_TURNED}, a as (select rec_id, i, unnest(named) as name, h, rw, types from (select *, generate_subscripts(named, 1) as i from t where list_contains(types, 'numeric'))), b as (select rec_id, generate_subscripts(named, 1) as i, unnest(named) as name, h, rw, types from t where list_contains(types, 'numeric')),
    c as (select *, row_number() over (partition by rec_id, name order by i) - 1 as k from b)
    select rec_id, string_agg(case when k > 0 then concat(name, '_', k) else name end, '|' order by i) as headers, any_value(array_to_string(list_transform(range(1, len(h)), lambda j: concat(h[j + 1], ':', array_to_string(list_transform(rw, lambda r: coalesce(r[j + 1], '')), ','))), ';')) as "rows", any_value(concat('categorical,', array_to_string(types, ','))) as types from c group by 1""".replace("a as (select rec_id, i, unnest(named) as name, h, rw, types from (select *, generate_subscripts(named, 1) as i from t where list_contains(types, 'numeric'))), ", ""))
def transpose_tables(spark: SparkSession, d: str) -> DataFrame:
    """Tables turned, with their new headers, rows and types; those without a numeric column are left out."""
    r = table(spark, d, R).where(
        "table.headers is not null and table.rows is not null"
    ).select("rec_id", grid.transposed(F.col("table")).alias("t")).where("t is not null")
    rows = F.array_join(
        F.transform(
            "t.rows",
            lambda x: F.concat(F.get(x, F.lit(0)), F.lit(":"), F.array_join(F.slice(x, F.lit(2), F.greatest(F.size(x) - 1, F.lit(0))), ","))
        ),
        ";"
    )
    return r.select("rec_id", F.array_join("t.headers", "|").alias("headers"), rows.alias("rows"), F.array_join("t.column_types", ",").alias("types"))


@query(
    "select type, cast(50 as bigint) as n, cast(0 as bigint) as n_failed from (values ('best_under_constraint'), ('threshold_filter'), ('tradeoff_summary')) t(type)"
)
def round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Generated records whose completions are parsed, rebuilt, validated and executed again, by kind."""
    valid, _ = questions.synthetic_dataset(spark, 150, seed=3)
    keyed = valid.withColumn("_id", F.col("metadata.example_id"))
    return keyed.select("_id", F.col("question_type").alias("type")).join(roundtrip.round_trip(keyed, "_id"), "_id").groupBy("type").agg(
        F.count("*").alias("n"),
        F.count_if(F.size("failed") > 0).alias("n_failed")
    )


@query(f"""with g as (select rec_id, "table"."rows" as rw from {R} where "table"."rows" is not null), l as (select rec_id, unnest(rw) as r from g), v as (select rec_id, trim(coalesce(r[1], '')) as label, list_filter(list_transform(r[2:], lambda c: struct_pack(n := {sql.number('c')}, t := trim(coalesce(c, '')))), lambda x: x.t <> '') as vs from l),
    h as (select rec_id, count_if(len(vs) > 0 and len(list_filter(vs, lambda x: x.n is not null and not (x.n = floor(x.n) and x.n between 1900 and 2099))) = 0 and len(list_filter(vs, lambda x: x.n = floor(x.n) and x.n between 1900 and 2099)) >= 2) as n_leak, count_if(label <> '') - count(distinct nullif(label, '')) as n_repeated from v group by 1)
    select count(*) as n_tables, count_if(n_leak > 0) as n_header_leak, count_if(n_repeated > 0) as n_duplicate_labels, count_if(n_leak > 0 or n_repeated > 0) = 0 as clean from h""")
def artifact_gate(spark: SparkSession, d: str) -> DataFrame:
    """Tables with header rows leaked into their body, and tables with repeated labels; the gate is open if there is neither."""
    return grid.artifacts(table(spark, d, R).select(F.col("rec_id").alias("table_id"), F.col("table.rows").alias("rows")), "table_id", "rows")
