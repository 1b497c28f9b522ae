"""Queries of cards, votes, sources and the numbers of a report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwise.functions import stats, text
from cellwise.operators import corpus, crosscheck, generate, records, selection
from cellwise.plans import corpus_queries, corpus_sql as sql
from cellwise.session import table
from cellwise.sources.readers import semi_table_only as only_tables

QUERIES, ORACLE_SQL = {}, {}
R, A = "realtable_eval_verified", "p3_4b_exec_test_verified"


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _u(*keys: str) -> str:
    return f"(cast(concat('0x', substr(md5(concat_ws(':', '0', {', '.join(keys)})), 1, 8)) as bigint) / 4294967296.0)"


_METRICS = ", ".join(f"({i}, '{m}', '{d}', {lo}, {hi}, {k})" for i, (m, d, lo, hi, k) in enumerate(generate.METRICS))


@query(f"""with ids as (select range as id from range(200)), s as (select id, cast(3 + floor({_u('id', "'rows'")} * 6) as integer) as r, cast(2 + floor({_u('id', "'cols'")} * 4) as integer) as c from ids), l as (select id, c, unnest(range(r)) as row from s)
    select id as table_id, cast(row as integer) as row, m as col_name, d as direction, floor((cast(lo as double) + {_u('id', 'row', 'i')} * (cast(hi as double) - cast(lo as double))) * pow(10.0, k) + 0.5) / pow(10.0, k) as value from l join (values {_METRICS}) v(i, m, d, lo, hi, k) on i < c""")
def synthetic_source(spark: SparkSession, d: str) -> DataFrame:
    return generate.synthetic_tables(spark, 200)


@query(
    """with x as (select rec_id, case when rec_id % 3 = 0 then null when rec_id % 3 = 1 then ['text', case when rec_id % 2 = 0 then 'table' else 'table-text' end] else ['table'] end as kinds from realtable_eval_verified) select rec_id from x where list_contains(kinds, 'table')"""
)
def semi_table_only(spark: SparkSession, d: str) -> DataFrame:
    """Contexts with a question that is answered from the table; the kinds of the questions are made up from the id."""
    k = F.col("rec_id")
    asked = lambda c: F.struct(c.alias("answer_from"))
    mixed = F.array(asked(F.lit("text")), asked(F.when(k % 2 == 0, "table").otherwise("table-text")))
    contexts = table(spark, d, R).select("rec_id", F.when(k % 3 == 1, mixed).when(k % 3 == 2, F.array(asked(F.lit("table")))).alias("questions"))
    return only_tables(contexts).select("rec_id")


_VOTES = f"v as (select example_id, type, coalesce(grounded, false) as g, detail_id from {A} where type is not null and example_id is not null)"


@query(f"""with {_VOTES}, c as (select example_id, type, count(*) as n, min(detail_id) as f, count_if(g) as k, min(case when g then detail_id end) as kf from v group by 1, 2)
    select example_id, type, n from (select example_id, type, case when k > 0 then k else n end as n, row_number() over (partition by example_id order by (k > 0) desc, case when k > 0 then k else n end desc, case when k > 0 then kf else f end) as p from c) where p = 1""")
def grounded_vote(spark: SparkSession, d: str) -> DataFrame:
    """The type that most grounded answers of an example name; of several the first; where none is grounded, that of most answers."""
    a = table(spark, d, A).where("example_id is not null").select("example_id", "type", "grounded", "detail_id")
    return selection.grounded_majority(a, "example_id", "type", "detail_id", "grounded")


@query(
    "select card_id, example_id, gold_label, array_to_string(list_transform(gold_rows, lambda x: cast(x as varchar)), ';') as gold_rows, coalesce(engine_ok, false) as engine_ok from (select *, row_number() over (partition by card_id order by keyed_at desc nulls last, example_id) as k from anchor_key) where k = 1 and card_id in (select card_id from cards)"
)
def blind_key(spark: SparkSession, d: str) -> DataFrame:
    """The key of the blind cards, apart from them: the last one of each card that was dealt."""
    k = selection.latest(table(spark, d, "anchor_key"), "card_id", [F.desc_nulls_last("keyed_at"), F.col("example_id")])
    dealt = table(spark, d, "cards").select("card_id").distinct()
    return k.join(dealt, "card_id", "left_semi").select(
        "card_id",
        "example_id",
        "gold_label",
        F.array_join(F.transform("gold_rows", lambda x: x.cast("string")), ";").alias("gold_rows"),
        F.coalesce("engine_ok", F.lit(False)).alias("engine_ok")
    )


@query(f"""with {sql.OBJECTS}, {corpus_queries._SYSTEM}, own as (select detail_id, case when json_valid(o) then json_extract_string(o::json, '$.final_answer.label') end as own from ro),
    q as (select metadata.example_id as example_id, arg_max(struct_pack(question := question, label := gold_answer.label), rec_id) as r from {R} where metadata.example_id is not null group by 1)
    select a.detail_id, q.r.question as question, q.r.label as gold_label, op.m.type as op_type, done.label as engine_label, cast(coalesce(len(done.cells), 0) as integer) as n_evidence, {sql.fires('op.m.type', 'q.r.question')} as fires,
        case when ({sql.fires('op.m.type', 'q.r.question')}) or done.label is null then own.own else done.label end as system_label
    from {A} a join q using (example_id) left join op using (detail_id) left join done on done.id = a.detail_id left join own using (detail_id)""")
def demo_card(spark: SparkSession, d: str) -> DataFrame:
    """One card for each answer: its question, the operation found in it, the engine's answer with its evidence, the gate, and what the system says."""
    r, a = table(spark, d, R), table(spark, d, A)
    last = r.where("metadata.example_id is not null").groupBy(F.col("metadata.example_id").alias("example_id")).agg(
        F.max_by(F.struct("question", F.col("gold_answer.label").alias("gold_label"), "table"), "rec_id").alias("x")
    )
    own = F.from_json(
        records.first_object(F.col("raw")),
        "final_answer struct<label:string>",
        {"allowSingleQuotes": "false"}
    )["final_answer"]["label"]
    ops = a.select(
        "detail_id",
        "example_id",
        records.runnable(records.extract_operation(F.col("raw"))).alias("o"),
        own.alias("own")
    ).withColumn("run", F.concat_ws("|", "example_id", F.to_json("o")))
    runs = ops.where("o is not null").dropDuplicates(["run"]).join(last, "example_id").select(
        "run",
        "x.table",
        corpus.bind_universe(F.col("o"), F.coalesce("x.table.rows", F.array())).alias("o")
    )
    e = corpus.execute(runs, "run", "table.headers", "table.rows", "o", "table.row_labels").select(
        "run",
        F.col("label").alias("engine_label"),
        F.size("evidence").alias("n_evidence")
    )
    fires = text.gate_fires(F.col("o.type"), F.col("x.question"))
    cards = ops.join(last, "example_id").join(e, "run", "left")
    system = F.when(fires | F.col("engine_label").isNull(), F.col("own")).otherwise(F.col("engine_label"))
    return cards.select(
        "detail_id",
        "x.question",
        "x.gold_label",
        F.col("o.type").alias("op_type"),
        "engine_label",
        F.coalesce("n_evidence", F.lit(0)).alias("n_evidence"),
        fires.alias("fires"),
        system.alias("system_label")
    )


_RATE = "round(greatest(0, (k/n + 1.96*1.96/(2*n)) / (1 + 1.96*1.96/n) - 1.96 * sqrt(k/n*(1-k/n)/n + 1.96*1.96/(4*n*n)) / (1 + 1.96*1.96/n)), 6) as low, round(least(1, (k/n + 1.96*1.96/(2*n)) / (1 + 1.96*1.96/n) + 1.96 * sqrt(k/n*(1-k/n)/n + 1.96*1.96/(4*n*n)) / (1 + 1.96*1.96/n)), 6) as high"
_NUMBERS = ("parsed", "op_present", "whole_op", "engine_ok", "model_ok", "grounded", "valid")


@query(
    "with x as (select metric, cast(count_if(coalesce(v, false)) as double) as k, cast(count(*) as double) as n from (" + " union all ".join(
        f"select '{c}' as metric, {c} as v from {A}" for c in _NUMBERS
    ) + f") group by 1) select metric, k, n, round(k / n, 6) as rate, {_RATE} from x"
)
def report_numbers(spark: SparkSession, d: str) -> DataFrame:
    """The rates that a report states, each with its interval, in one pass over the answers."""
    one = table(spark, d, A).agg(
        F.count("*").cast("double").alias("n"),
        *(F.count_if(F.coalesce(c, F.lit(False))).cast("double").alias(c) for c in _NUMBERS)
    )
    rows = one.unpivot("n", list(_NUMBERS), "metric", "k").where("n > 0")
    w = stats.wilson(F.col("k"), F.col("n"))
    return rows.select(
        "metric",
        "k",
        "n",
        F.round(F.col("k") / F.col("n"), 6).alias("rate"),
        F.round(w["low"], 6).alias("low"),
        F.round(w["high"], 6).alias("high")
    )


@query(f"""select rec_id, concat('| ', array_to_string("table".headers, ' | '), ' |', chr(10), '| ', array_to_string(list_transform("table".headers, lambda h: '---'), ' | '), ' |', coalesce(array_to_string(list_transform("table"."rows", lambda r: concat(chr(10), '| ', array_to_string(list_transform(r, lambda c: case when {sql.number('c')} is null then case when regexp_matches(trim(regexp_replace(coalesce(c, ''), '[$%]', '', 'g')), '^[-‒–—―�*\\s]*$') or regexp_matches(lower(trim(regexp_replace(c, '[$%]', '', 'g'))), '^(n/?a|n\\.a\\.?|nm|nil|--+)$') then '' else trim(c) end
    when {sql.number('c')} = floor({sql.number('c')}) then cast(cast({sql.number('c')} as bigint) as varchar) else printf('%g', {sql.number('c')}) end), ' | '), ' |')), ''), '')) as md from {R} where "table".headers is not null""")
def render_parsed(spark: SparkSession, d: str) -> DataFrame:
    """Tables in markdown with their cells parsed: numbers in at most six digits, missing values empty."""
    return table(spark, d, R).where("table.headers is not null").select(
        "rec_id",
        records.markdown(F.col("table.headers"), F.transform("table.rows", lambda r: F.transform(r, text.rendered))).alias("md")
    )


@query()
def crosscheck_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Questions for the highest of a row's periods, with the row's numbers as the chain beside the answer, found again from their tables."""
    r = table(spark, d, R).where("size(table.rows) > 0 and size(table.headers) > 2")
    first = F.get("table.rows", F.lit(0))
    chain = F.array_join(F.slice(first, F.lit(2), F.size(first) - 1), ">")
    asked = F.concat(F.lit("In which year was "), F.get(first, F.lit(0)), F.lit(" the highest?"))
    x = r.select(
        "rec_id",
        "table",
        asked.alias("asked"),
        F.slice("table.headers", 2, 1).alias("said"),
        F.when(F.col("rec_id") % 2 == 0, chain).alias("chain")
    )
    return crosscheck.agreement(crosscheck.crosscheck(x, "rec_id", "table", "asked", "said", "chain"))
