"""Queries over question records, model answers, cards and keys: evaluation, validation, selection and record forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwise.functions import stats, text
from cellwise.operators import engine, generate, matching, records, selection
from cellwise.session import table

QUERIES, ORACLE_SQL = {}, {}
R, A = "realtable_eval_verified", "p3_4b_exec_test_verified"


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _avg(c: str, name: str):  # noqa: ANN202
    return F.round(F.avg(F.coalesce(F.col(c), F.lit(False)).cast("int")), 6).alias(name)


_RATES = "count(*) as n, " + ", ".join(
    f"round(avg(case when {c} then 1 else 0 end), 6) as {c}" for c in ("parsed", "engine_ok", "model_ok", "grounded", "valid")
)


@query(f"select {_RATES} from {A}")
def eval_rates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, A).agg(F.count("*").alias("n"), *(_avg(c, c) for c in ("parsed", "engine_ok", "model_ok", "grounded", "valid")))


@query(f"select coalesce(type, '(none)') as type, {_RATES} from {A} group by 1")
def eval_by_type(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, A).groupBy(F.coalesce("type", F.lit("(none)")).alias("type")).agg(
        F.count("*").alias("n"),
        *(_avg(c, c) for c in ("parsed", "engine_ok", "model_ok", "grounded", "valid"))
    )


@query(
    f"select model, sum(case when engine_ok then 1 else 0 end)::bigint as k, count(*) as n, count_if(valid and grounded) as n_valid_grounded from {A} group by 1"
)
def model_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, A).groupBy("model").agg(
        F.count_if("engine_ok").alias("k"),
        F.count("*").alias("n"),
        F.count_if(F.col("valid") & F.col("grounded")).alias("n_valid_grounded")
    )


@query(f"""with c as (select model, count_if(engine_ok)::double as k, count(*)::double as n from {A} group by 1)
    select model, round(greatest(0, (k/n + 1.96*1.96/(2*n)) / (1 + 1.96*1.96/n) - 1.96 * sqrt(k/n*(1-k/n)/n + 1.96*1.96/(4*n*n)) / (1 + 1.96*1.96/n)), 6) as low,
        round(least(1, (k/n + 1.96*1.96/(2*n)) / (1 + 1.96*1.96/n) + 1.96 * sqrt(k/n*(1-k/n)/n + 1.96*1.96/(4*n*n)) / (1 + 1.96*1.96/n)), 6) as high from c""")
def wilson_ci(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, A).groupBy("model").agg(F.count_if("engine_ok").cast("double").alias("k"), F.count("*").cast("double").alias("n"))
    return c.select("model", stats.wilson(F.col("k"), F.col("n")).alias("w")).select(
        "model",
        F.round("w.low", 6).alias("low"),
        F.round("w.high", 6).alias("high")
    )


@query(f"select coalesce(engine_ok, false) as engine, coalesce(model_ok, false) as model_, count(*) as n from {A} group by 1, 2")
def contingency_2x2(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, A).groupBy(
        F.coalesce("engine_ok", F.lit(False)).alias("engine"),
        F.coalesce("model_ok", F.lit(False)).alias("model_")
    ).agg(F.count("*").alias("n"))


@query(f"""with c as (select model, count_if(engine_ok and not model_ok)::bigint as b, count_if(model_ok and not engine_ok)::bigint as c from {A} group by 1)
    select model, b, c, round(case when b + c = 0 then 0 else least(0, ln((select sum(exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) + (b + c) * ln(0.5))) from (select unnest(range(0, least(b, c) + 1)) as i))) + ln(2)) end, 6) as ln_p from c""")
def mcnemar_exact(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, A).groupBy("model").agg(
        F.count_if(F.col("engine_ok") & ~F.col("model_ok")).alias("b"),
        F.count_if(F.col("model_ok") & ~F.col("engine_ok")).alias("c")
    )
    return c.withColumn("ln_p", F.round(stats.mcnemar_ln_p(F.col("b"), F.col("c")), 6))


@query(
    f"select model, count_if(engine_err) as n_fallback, count_if(case when coalesce(engine_err, false) then coalesce(model_ok, false) else coalesce(engine_ok, false) end) as n_right from {A} group by 1"
)
def fallback_rate(spark: SparkSession, d: str) -> DataFrame:
    """The model's own answer is taken where the engine failed."""
    f = F.coalesce("engine_err", F.lit(False))
    right = F.when(f, F.coalesce("model_ok", F.lit(False))).otherwise(F.coalesce("engine_ok", F.lit(False)))
    return table(spark, d, A).groupBy("model").agg(F.count_if(f).alias("n_fallback"), F.count_if(right).alias("n_right"))


@query(
    f"select coalesce(render_error, '(none)') as failure, count(*) as n, count(distinct example_id) as n_examples from {A} where not coalesce(valid, false) group by 1"
)
def failure_hist(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, A).where(~F.coalesce("valid", F.lit(False))).groupBy(F.coalesce("render_error", F.lit("(none)")).alias("failure")).agg(
        F.count("*").alias("n"),
        F.count_distinct("example_id").alias("n_examples")
    )


@query(f"""select what, label, count(*) as n from (select 'type' as what, question_type as label from {R} union all select 'split', lower(trim(split)) from {R} union all select 'difficulty', metadata.difficulty from {R} union all select 'orientation', metadata.orientation from {R}
    union all select 'edge', unnest(metadata.edge_cases) from {R}) where label is not null group by 1, 2""")
def dataset_counts(spark: SparkSession, d: str) -> DataFrame:
    pairs = {
        "type": F.col("question_type"),
        "split": F.lower(F.trim("split")),
        "difficulty": F.col("metadata.difficulty"),
        "orientation": F.col("metadata.orientation")
    }
    what = F.array(*(F.struct(F.lit(k).alias("what"), c.alias("label")) for k, c in pairs.items()))
    edges = F.transform(
        F.coalesce("metadata.edge_cases", F.array().cast("array<string>")),
        lambda e: F.named_struct(F.lit("what"), F.lit("edge"), F.lit("label"), e)
    )
    return table(spark, d, R).select(
        F.explode(F.concat(what, edges)).alias("x")
    ).select("x.*").where("label is not null").groupBy("what", "label").agg(F.count("*").alias("n"))


@query(f"select a.detail_id, r.rec_id, r.question_type from {A} a left join {R} r on a.example_id = r.metadata.example_id")
def join_results(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, R).select("rec_id", "question_type", F.col("metadata.example_id").alias("example_id"))
    return table(spark, d, A).select("detail_id", "example_id").join(r, "example_id", "left").select("detail_id", "rec_id", "question_type")


_PAIRED = f"select x.example_id, bool_or(x.valid) as now, bool_or(y.valid) as before from {A} x join {A} y on x.example_id = y.example_id where x.model = 'tabra-4b-exec' and y.model = 'tabra-2b-base' group by 1"


@query(f"with p as ({_PAIRED}) select count(*) as n, count_if(now and not before) as gained, count_if(before and not now) as lost from p")
def paired_baseline(spark: SparkSession, d: str) -> DataFrame:
    """Two runs on the same examples; each run's answers are aggregated before they meet."""
    a = table(spark, d, A)
    run = lambda m, n: a.where(F.col("model") == m).groupBy("example_id").agg(F.bool_or("valid").alias(n))
    p = run("tabra-4b-exec", "now").join(run("tabra-2b-base", "before"), "example_id").where("example_id is not null")
    return p.agg(
        F.count("*").alias("n"),
        F.count_if(F.col("now") & ~F.col("before")).alias("gained"),
        F.count_if(F.col("before") & ~F.col("now")).alias("lost")
    )


@query(
    f"select rec_id from {R} where metadata.example_id is null or metadata.example_id not in (select example_id from {A} where example_id is not null)"
)
def resume_anti(spark: SparkSession, d: str) -> DataFrame:
    done = table(spark, d, A).select("example_id").where("example_id is not null").distinct()
    return table(spark, d, R).select(
        "rec_id",
        F.col("metadata.example_id").alias("example_id")
    ).join(done, "example_id", "left_anti").select("rec_id")


_SPLIT = "lower(trim(split))"


@query(f"select distinct table_id from {R} where {_SPLIT} = 'train' and table_id in (select table_id from {R} where {_SPLIT} in ('dev', 'test'))")
def leak_semi_id(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, R).select("table_id", F.lower(F.trim("split")).alias("s"))
    return r.where("s = 'train'").select("table_id").distinct().join(
        r.where("s in ('dev', 'test')").select("table_id").distinct(),
        "table_id",
        "left_semi"
    )


_SIG = """md5(concat_ws('|', array_to_string(list_sort("table".headers), '|'), array_to_string(list_sort(list_transform(flatten("table".rows), lambda x: coalesce(x, ''))), '|')))"""


@query(
    f"""with s as (select rec_id, {_SPLIT} as s, {_SIG} as sig from {R} where "table".headers is not null and "table".rows is not null) select rec_id from s where s = 'train' and sig in (select sig from s where s in ('dev', 'test'))"""
)
def leak_semi_content(spark: SparkSession, d: str) -> DataFrame:
    cells = F.array_join(F.array_sort(F.transform(F.flatten("table.rows"), lambda x: F.coalesce(x, F.lit("")))), "|")
    s = table(spark, d, R).where("table.headers is not null and table.rows is not null").select(
        "rec_id",
        F.lower(F.trim("split")).alias("s"),
        F.md5(F.concat_ws("|", F.array_join(F.array_sort("table.headers"), "|"), cells)).alias("sig")
    )
    return s.where("s = 'train'").join(s.where("s in ('dev', 'test')").select("sig").distinct(), "sig", "left_semi").select("rec_id")


@query(
    f"select type, count(*) as n, count_if(ok) as n_pass from (select example_id, min(type) as type, bool_or(coalesce(valid, false)) as ok from {A} where example_id is not null group by 1) group by 1"
)
def pass_at_n(spark: SparkSession, d: str) -> DataFrame:
    per = table(spark, d, A).where("example_id is not null").groupBy("example_id").agg(
        F.min("type").alias("type"),
        F.bool_or(F.coalesce("valid", F.lit(False))).alias("ok")
    )
    return per.groupBy("type").agg(F.count("*").alias("n"), F.count_if("ok").alias("n_pass"))


@query(
    "select user_id, event_type, n from (select *, row_number() over (partition by user_id order by n desc, first) as k from (select user_id, event_type, count(*) as n, min(event_id) as first from events group by 1, 2)) where k = 1"
)
def majority_vote(spark: SparkSession, d: str) -> DataFrame:
    return selection.majority(table(spark, d, "events"), "user_id", "event_type", "event_id")


@query("select l_orderkey, count(*) >= 3 and count(distinct l_returnflag) = 1 and bool_and(l_quantity > 2) as accepted from lineitem group by 1")
def silver_accept(spark: SparkSession, d: str) -> DataFrame:
    return selection.unanimous(table(spark, d, "lineitem").withColumn("ok", F.col("l_quantity") > 2), "l_orderkey", "l_returnflag", "ok", 3)


@query(
    "select o_orderpriority, count(*) as n, count_if(accepted) as n_accepted from orders join (select l_orderkey, count(*) >= 3 and count(distinct l_returnflag) = 1 and bool_and(l_quantity > 2) as accepted from lineitem group by 1) on o_orderkey = l_orderkey group by 1"
)
def silver_progress(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").join(
        silver_accept(spark, d),
        F.col("o_orderkey") == F.col("l_orderkey")
    ).groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count_if("accepted").alias("n_accepted"))


@query(
    f"select rec_id, question_type, row_number() over (partition by question_type order by rec_id) as turn from {R} where question_type is not null"
)
def round_robin(spark: SparkSession, d: str) -> DataFrame:
    return selection.round_robin(
        table(spark, d, R).select("rec_id", "question_type").where("question_type is not null"),
        "question_type",
        [F.col("rec_id")]
    )


@query(
    f"select rec_id, question_type, row_number() over (partition by question_type order by case when metadata.difficulty = 'hard' then 0 else 1 end, rec_id) as turn from {R} where question_type is not null"
)
def round_robin_hard_first(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, R).where("question_type is not null").select(
        "rec_id",
        "question_type",
        F.when(F.col("metadata.difficulty") == "hard", 0).otherwise(1).alias("e")
    )
    return selection.round_robin(r, "question_type", [F.col("rec_id")], [F.col("e")]).drop("e")


@query(
    "select doc_id, source from (select *, row_number() over (partition by source order by md5(concat('0:', doc_id)), doc_id) as k from documents) where k <= 3"
)
def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    return selection.stratified_sample(table(spark, d, "documents").select("doc_id", "source"), "source", "doc_id", 3)


@query(
    f"select question_type, rec_id from (select question_type, rec_id, row_number() over (partition by question_type order by rec_id) as k from {R} where metadata.confidence = 'high' and len(gold_answer.rows) > 0) where k = 1"
)
def featured(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, R).where((F.col("metadata.confidence") == "high") & (F.size("gold_answer.rows") > 0))
    return engine.first_per_group(q.select("question_type", "rec_id"), ["question_type"], [F.col("rec_id")])


_BASE = "regexp_replace(table_id, '_(rows|cols)$', '')"


@query(
    f"with t as (select distinct {_BASE} as base from {R} where table_id is not null), o as (select base, row_number() over (order by md5(concat('0:', base)), base) as k from t) select base, case when k <= 45 then 'test' when k <= 80 then 'dev' else 'pool' end as role from o"
)
def freeze_splits(spark: SparkSession, d: str) -> DataFrame:
    return selection.freeze_splits(table(spark, d, R).select(text.base_table_id(F.col("table_id")).alias("base")), "base", 45, 35)


@query(
    "select doc_id, case when cast(concat('0x', substr(md5(concat('0:', doc_id)), 1, 6)) as bigint) < 3355443 then 'eval' else 'train' end as part from documents"
)
def hash_split(spark: SparkSession, d: str) -> DataFrame:
    return selection.hash_split(table(spark, d, "documents").select("doc_id"), "doc_id", 0.2)


@query(f"select rec_id, {_BASE} as base from {R}")
def base_table_id(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, R).select("rec_id", text.base_table_id(F.col("table_id")).alias("base"))


@query(
    f"select rec_id from {R} where {_SPLIT} = 'train' and question_type in ('threshold_filter', 'tradeoff_summary') and metadata.confidence = 'high'"
)
def split_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, R).where(
        (F.lower(F.trim("split")) == "train") & F.col("question_type").isin("threshold_filter", "tradeoff_summary") & (F.col("metadata.confidence") == "high")
    ).select("rec_id")


@query(f"select detail_id from {A} where grounded and parsed and not model_ok")
def error_slice(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, A).where("grounded and parsed and not model_ok").select("detail_id")


@query("select card_id from (select card_id from cards intersect select card_id from anchor_key)")
def set_intersect(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "cards").select("card_id").intersect(table(spark, d, "anchor_key").select("card_id"))


@query("select card_id from (select card_id from cards except select card_id from anchor_key)")
def set_except(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "cards").select("card_id").subtract(table(spark, d, "anchor_key").select("card_id"))


@query("select card_id from (select card_id from cards union select card_id from anchor_key)")
def set_union(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "cards").select("card_id").union(table(spark, d, "anchor_key").select("card_id")).distinct()


_LAST = "(select card_id, gold_label, gold_label_set, engine_ok from (select *, row_number() over (partition by card_id order by keyed_at desc nulls last, example_id) as k from anchor_key) where k = 1)"


@query(f"select card_id, gold_label from {_LAST}")
def dedup_first(spark: SparkSession, d: str) -> DataFrame:
    return selection.latest(
        table(spark, d, "anchor_key"),
        "card_id",
        [F.desc_nulls_last("keyed_at"), F.col("example_id")]
    ).select("card_id", "gold_label")


_CARD = "(select card_id, type, row_labels from (select *, row_number() over (partition by card_id order by type nulls last, question) as k from cards) where k = 1)"
_NORM = "list_sort(list_distinct(list_transform({x}, lambda v: regexp_replace(regexp_replace(lower(trim(v)), '\\s+', ' ', 'g'), '^[ .,:;]+|[ .,:;]+$', '', 'g'))))"


@query(
    f"select coalesce(c.type, '(none)') as type, count(*) as n, count_if({_NORM.format(x='k.gold_label_set')} = {_NORM.format(x='[k.gold_label]')}) as n_agree from {_LAST} k join {_CARD} c on k.card_id = c.card_id where k.gold_label is not null and k.gold_label_set is not null group by 1"
)
def anchor_score(spark: SparkSession, d: str) -> DataFrame:
    """Keys and cards joined on the card; the set of labels compared with the label after normalisation."""
    k = selection.latest(
        table(spark, d, "anchor_key"),
        "card_id",
        [F.desc_nulls_last("keyed_at"), F.col("example_id")]
    ).where("gold_label is not null and gold_label_set is not null")
    c = selection.latest(table(spark, d, "cards"), "card_id", [F.asc_nulls_last("type"), F.asc_nulls_last("question")]).select("card_id", "type")
    norm = lambda a: F.array_sort(F.array_distinct(F.transform(a, text.norm_label)))
    return k.join(c, "card_id").groupBy(F.coalesce("type", F.lit("(none)")).alias("type")).agg(
        F.count("*").alias("n"),
        F.count_if(norm(F.col("gold_label_set")) == norm(F.array("gold_label"))).alias("n_agree")
    )


@query("select card_id, question, table_markdown from cards")
def blind_cards(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "cards").select("card_id", "question", "table_markdown")


@query(
    f"""select rec_id, concat('| ', array_to_string("table".headers, ' | '), ' |', chr(10), '| ', array_to_string(list_transform("table".headers, lambda h: '---'), ' | '), ' |', coalesce(array_to_string(list_transform("table".rows, lambda r: concat(chr(10), '| ', array_to_string(list_transform(r, lambda c: coalesce(c, '')), ' | '), ' |')), ''), '')) as md from {R} where "table".headers is not null"""
)
def render_markdown(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, R).where("table.headers is not null").select(
        "rec_id",
        records.markdown(F.col("table.headers"), F.col("table.rows")).alias("md")
    )


@query(
    "select card_id, md5(concat('Answer the question from the table.', chr(10), chr(10), table_markdown, chr(10), chr(10), 'Question: ', question, chr(10))) as prompt from cards where table_markdown is not null and question is not null"
)
def build_prompt(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "cards").where("table_markdown is not null and question is not null").select(
        "card_id",
        F.md5(records.prompt(F.col("table_markdown"), F.col("question"))).alias("prompt")
    )


@query(
    f"""select rec_id, metadata.spec.type as type, metadata.spec.target as target, case when metadata.spec.type = 'best_under_constraint' then metadata.spec.op end as op, case when metadata.spec.type = 'threshold_filter' then len(metadata.spec.conditions) end as n_conditions from {R} where metadata.spec.type is not null"""
)
def normalize_operation(spark: SparkSession, d: str) -> DataFrame:
    op = F.from_json(records.named_operation(F.col("metadata.spec")), "type string, target string, op string, conditions array<string>")
    return table(spark, d, R).where("metadata.spec.type is not null").select("rec_id", op.alias("o")).select(
        "rec_id",
        "o.type",
        "o.target",
        "o.op",
        F.when(F.col("o.type") == "threshold_filter", F.size("o.conditions").cast("bigint")).alias("n_conditions")
    )


@query(
    f"select rec_id, gold_answer.label as label, cast(len(trace_steps) as bigint) as n_steps from {R} where gold_answer is not null and trace_steps is not null"
)
def completion_json(spark: SparkSession, d: str) -> DataFrame:
    """Completions read back: an exact round trip of the label and the steps."""
    r = table(spark, d, R).where("gold_answer is not null and trace_steps is not null")
    c = F.from_json(records.completion(r), "trace_steps array<struct<kind:string>>, final_answer struct<label:string>")
    return r.select("rec_id", c.alias("c")).select(
        "rec_id",
        F.col("c.final_answer.label").alias("label"),
        F.size("c.trace_steps").cast("bigint").alias("n_steps")
    )


@query(f"select metadata.example_id as example_id, question_type, cast(2 as bigint) as n_messages from {R}")
def sft_records(spark: SparkSession, d: str) -> DataFrame:
    return records.chat(table(spark, d, R)).select("example_id", "question_type", F.size("messages").cast("bigint").alias("n_messages"))


@query(f"""select metadata.example_id as example_id, table_id, domain, question_type, question, gold_answer.label as gold_label, array_to_string(list_transform(gold_answer.rows, lambda x: cast(x as varchar)), '; ') as gold_rows, array_to_string(gold_answer.metrics, '; ') as gold_metrics,
    cast(len("table".rows) as integer) as n_rows, cast(len("table".headers) as integer) as n_cols, cast(len(trace_steps) as integer) as n_steps, cast(len(evidence_cells) as integer) as n_evidence, metadata.difficulty as difficulty, array_to_string(metadata.edge_cases, '; ') as edge_cases, metadata.source.uid as uid, split from {R}""")
def flatten_export(spark: SparkSession, d: str) -> DataFrame:
    return records.flat(table(spark, d, R))


@query(
    "select p_partkey, concat('Which part has the highest p_retailprice with p_size of at least ', p_size, '?', case when p_size > 25 then ' Exclude any total or subtotal rows.' else '' end) as q from part"
)
def question_text(spark: SparkSession, d: str) -> DataFrame:
    q = records.question_text(
        "best_under_constraint",
        F.lit("part"),
        F.lit("p_retailprice"),
        "higher",
        F.lit("p_size"),
        "gte",
        F.col("p_size").cast("string"),
        F.col("p_size") > 25
    )
    return table(spark, d, "part").select("p_partkey", q.alias("q"))


@query(
    f"select split, min(length(question)) as shortest, round(avg(length(question)), 4) as mean, max(length(question)) as longest from (select {_SPLIT} as split, question from {R} where question is not null and split is not null) group by 1"
)
def length_stats(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, R).where("question is not null and split is not null").select(
        F.lower(F.trim("split")).alias("split"),
        F.length("question").cast("bigint").alias("n")
    )
    return q.groupBy("split").agg(F.min("n").alias("shortest"), F.round(F.avg("n"), 4).alias("mean"), F.max("n").alias("longest"))


@query(f"select rec_id, metadata.spec.type as op_type, metadata.spec.target as target from {R} where metadata.spec.type is not null")
def extract_operation(spark: SparkSession, d: str) -> DataFrame:
    """Operations found again in answers with remarks and stray brackets around the JSON."""
    raw = F.concat(
        F.lit("So: "),
        F.to_json(F.struct(F.col("question").alias("quoted }"), F.col("metadata.spec").alias("operation"))),
        F.lit(" and } done")
    )
    return table(spark, d, R).where("metadata.spec.type is not null").select("rec_id", records.extract_operation(raw).alias("o")).select(
        "rec_id",
        F.col("o.type").alias("op_type"),
        "o.target"
    )


@query(
    "with u as (select p_brand, max(p_retailprice) - min(p_retailprice) as s, max(p_retailprice) as hi from part group by 1) select p_brand, round(hi + greatest(case when s > 0 then s else 1 end * 0.1, 0.01), 4) as threshold from u"
)
def threshold_empty(spark: SparkSession, d: str) -> DataFrame:
    return generate.thresholds(
        table(spark, d, "part"),
        "p_brand",
        "p_retailprice",
        "higher",
        "empty"
    ).withColumn("threshold", F.round("threshold", 4))


_UNI = "cast(concat('0x', substr(md5(concat('0:', p_brand)), 1, 8)) as bigint) / 4294967296.0"


@query(
    f"with u as (select p_brand, list_sort(list(distinct cast(p_size as double))) as u from part group by 1) select p_brand, (u[cast(floor({_UNI} * (len(u) - 1)) as integer) + 1] + u[cast(floor({_UNI} * (len(u) - 1)) as integer) + 2]) / 2 + case when list_contains(u, (u[cast(floor({_UNI} * (len(u) - 1)) as integer) + 1] + u[cast(floor({_UNI} * (len(u) - 1)) as integer) + 2]) / 2) then 1e-6 else 0 end as threshold from u"
)
def threshold_normal(spark: SparkSession, d: str) -> DataFrame:
    return generate.thresholds(table(spark, d, "part"), "p_brand", "p_size", "higher", "normal")


@query(
    f"with u as (select p_brand, list_sort(list(distinct cast(p_size as double))) as u, max(p_size) - min(p_size) as s from part group by 1) select p_brand, round(u[cast(floor({_UNI} * len(u)) as integer) + 1] + greatest(s * 0.04, 0.005), 4) as threshold from u"
)
def threshold_near(spark: SparkSession, d: str) -> DataFrame:
    return generate.thresholds(table(spark, d, "part"), "p_brand", "p_size", "lower", "near").withColumn("threshold", F.round("threshold", 4))


@query(
    "with w as (select p_brand, count(*) as n from (select *, max(p_size) over (partition by p_brand) as best from part where p_retailprice < 1500) where p_size = best group by 1) select p_brand, case when n > 1 then 'argmax_tie' end as tag from w"
)
def edge_tags(spark: SparkSession, d: str) -> DataFrame:
    won = engine.best_under_constraint(
        table(spark, d, "part"),
        "p_size",
        "higher",
        "p_retailprice",
        "lt",
        1500,
        ["p_brand"]
    ).groupBy("p_brand").agg(F.count("*").alias("n"))
    return won.select("p_brand", generate.edge_tag("best_under_constraint", F.col("n"), F.col("n")).alias("tag"))


@query(
    "select n_name, orientation, type from nation, (values ('rows'), ('columns')) o(orientation), (values ('best_under_constraint'), ('threshold_filter'), ('tradeoff_summary')) t(type)"
)
def cross_types(spark: SparkSession, d: str) -> DataFrame:
    """Each table in both orientations with each type: an explode of fixed lists, no cross join."""
    lists = lambda *v: F.explode(F.array(*map(F.lit, v)))
    return table(spark, d, "nation").select("n_name", lists("rows", "columns").alias("orientation")).select(
        "n_name",
        "orientation",
        lists("best_under_constraint", "threshold_filter", "tradeoff_summary").alias("type")
    )


@query(
    f"""select rec_id, cast(i - 1 as integer) as step, s.kind as kind, cast(len(list_filter(s.cites, lambda c: c is not null)) as bigint) as n_cites from (select rec_id, generate_subscripts(trace_steps, 1) as i, unnest(trace_steps) as s from {R}) where s is not null"""
)
def trace_steps(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, R).select("rec_id", F.posexplode("trace_steps").alias("step", "s")).where("s is not null")
    return x.select(
        "rec_id",
        "step",
        "s.kind",
        F.when(F.col("s.cites").isNotNull(), F.size(F.filter("s.cites", lambda c: c.isNotNull())).cast("bigint")).alias("n_cites")
    )


@query(
    "select p_partkey, p_brand, p_name as match from part where (p_brand, lower(p_name)) in (select p_brand, lower(p_name) from part group by 1, 2 having count(distinct p_name) = 1)"
)
def exact_match(spark: SparkSession, d: str) -> DataFrame:
    """Labels found again in another case with marks around them."""
    p = table(spark, d, "part")
    left = p.select("p_brand", "p_partkey", F.concat(F.lit(" "), F.upper("p_name"), F.lit("!")).alias("l"))
    return matching.fuzzy_match(left, p, "p_brand", "p_partkey", "l", "p_name").select("p_partkey", "p_brand", "match")


@query()
def fuzzy_match(spark: SparkSession, d: str) -> DataFrame:
    """Labels found again with their last letter lost."""
    p = table(spark, d, "part")
    left = p.select("p_brand", "p_partkey", F.expr("substr(p_name, 1, length(p_name) - 1)").alias("l"))
    return matching.fuzzy_match(left, p, "p_brand", "p_partkey", "l", "p_name").select("p_partkey", "p_brand", "match")


@query("select c_custkey, case when c_custkey % 2 = 0 then '2,0' end as places from customer")
def chain_match(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("c_nationkey").cast("double") + 1000
    values = F.array(n, F.when(F.col("c_custkey") % 2 == 0, n + 100).otherwise(n + 5000))
    places = matching.chain_match(values, F.array(n + 100.3, n + 500, n + 0.001))
    return table(spark, d, "customer").select("c_custkey", F.array_join(F.transform(places, lambda x: x.cast("string")), ",").alias("places"))


@query(
    f"""select rec_id, coalesce(gold_answer.label, '') as label, cast(len(list_distinct(list_filter(flatten(list_transform(list_filter(trace_steps, lambda s: s is not null), lambda s: coalesce(s.cites, []))), lambda c: c is not null))) as bigint) as n_evidence from {R} where gold_answer is not null and len(list_filter(trace_steps, lambda s: s is null)) = 0 and len(list_filter(flatten(list_transform(trace_steps, lambda s: coalesce(s.cites, []))), lambda c: c is null)) = 0 and "table".headers is not null"""
)
def reconstruct(spark: SparkSession, d: str) -> DataFrame:
    """Completions read back as records: the round trip keeps the label and the distinct cells."""
    no_null = F.forall(
        "trace_steps",
        lambda s: s.isNotNull() & F.forall(
            F.coalesce(s["cites"], F.array().cast(table(spark, d, R).schema["evidence_cells"].dataType)),
            lambda c: c.isNotNull()
        )
    )
    r = table(spark, d, R).where(F.col("gold_answer").isNotNull() & no_null & F.col("table.headers").isNotNull())
    out = matching.reconstruct(records.completion(r), F.col("table.headers"))
    return r.select("rec_id", out.alias("o")).select(
        "rec_id",
        F.coalesce("o.final_answer.label", F.lit("")).alias("label"),
        F.size("o.evidence_cells").cast("bigint").alias("n_evidence")
    )


@query("select card_id, upper(question) as raw, question is null as failed from cards")
def render_hook(spark: SparkSession, d: str) -> DataFrame:
    """A generator of any kind on every prompt; here one that shouts and fails on a missing prompt."""
    out = matching.render(table(spark, d, "cards"), "card_id", "question", lambda p: p.upper())
    return out.select("card_id", "raw", F.col("error").isNotNull().alias("failed"))
