"""Queries of the executor, the validator and the evaluations that rest on them, over records and model answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwise.functions import text
from cellwise.operators import corpus, records, validator
from cellwise.plans import corpus_sql as sql
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


_SOURCE = f"""src as (select rec_id as id, "table".headers as h, "table"."rows" as rw, "table".row_labels as rl, "table".column_types as ct, metadata.spec as s, gold_answer as gold, trace_steps as steps, evidence_cells as evidence,
    metadata.difficulty as level, metadata.edge_cases as edges, table_id, domain, question, question_type, trace_source from {R})"""
_RUN = f"with {_SOURCE}, {sql.executed('src')}"
_ANSWER = "case when error is null then array_to_string(ans, ',') end"
_joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


def _executed(spark: SparkSession, d: str, r: DataFrame | None = None) -> DataFrame:
    r = table(spark, d, R) if r is None else r
    return corpus.execute(r, "rec_id", "table.headers", "table.rows", "metadata.spec", "table.row_labels")


@query(
    f"{_RUN} select id as rec_id, {_ANSWER} as answer, label, case when error is null then case when s.type = 'tradeoff_summary' then concat(s.m1, ',', s.m2) else '' end end as metrics, error from x"
)
def corpus_execute(spark: SparkSession, d: str) -> DataFrame:
    """Every record's own operation on its own table, in one job."""
    return _executed(spark, d).select("rec_id", _joined("answer").alias("answer"), "label", F.array_join("metrics", ",").alias("metrics"), "error")


@query(f'{_RUN} select id as rec_id, cast("row" as integer) as "row", cast(col as integer) as col, col_name, value from ev')
def corpus_evidence(spark: SparkSession, d: str) -> DataFrame:
    """The cells that every record's answer was read from."""
    return _executed(spark, d).select("rec_id", F.explode("evidence").alias("c")).select("rec_id", "c.*")


@query(f"""with src0 as (select * from (with {_SOURCE} select * from src)), src as (select * exclude (s), case when s is not null then struct_pack(type := s.type, target := s.target, target_dir := s.target_dir, "constraint" := s."constraint", op := s.op, threshold := s.threshold, conditions := s.conditions,
    m1 := s.m1, m2 := s.m2, d1 := s.d1, d2 := s.d2, "rows" := {sql.entity_rows('coalesce(rw, [])')}) end as s from src0), {sql.executed('src')} select id as rec_id, {_ANSWER} as answer, label, error from x""")
def entity_execute(spark: SparkSession, d: str) -> DataFrame:
    """The same over the entities of each table, whatever rows the operation named."""
    bound = F.when(F.col("metadata.spec").isNotNull(), corpus.bind_universe(F.col("metadata.spec"), F.coalesce("table.rows", F.array())))
    r = table(spark, d, R).select("rec_id", "table", F.struct(bound.alias("spec")).alias("metadata"))
    return _executed(spark, d, r).select("rec_id", _joined("answer").alias("answer"), "label", "error")


@query(f"""{_RUN} select id as rec_id, fires, case when fires or error is not null then own else label end as label
    from (select x.id, x.error, x.label, {sql.fires('x.s.type', 'src.question')} as fires, src.gold.label as own from x join src using (id))""")
def gated_answer(spark: SparkSession, d: str) -> DataFrame:
    """What the system answers: the engine's label unless the gate fires or the engine failed, else the record's own."""
    r = table(spark, d, R)
    fires = text.gate_fires(F.col("metadata.spec.type"), F.col("question"))
    own = r.select("rec_id", F.col("gold_answer.label").alias("own"), fires.alias("fires"))
    return own.join(_executed(spark, d), "rec_id").select(
        "rec_id",
        "fires",
        F.when(F.col("fires") | F.col("error").isNotNull(), F.col("own")).otherwise(F.col("label")).alias("label")
    )


@query(f"""{_RUN} select coalesce(question_type, '(none)') as type, count(*) as n, count_if(coalesce(error is null and ans = list_sort(coalesce(gold."rows", [])) and (s.type <> 'tradeoff_summary' or list_sort(list_distinct(gold.metrics)) = list_sort(list_distinct([s.m1, s.m2]))), false)) as n_reached
    from (select x.ans, x.error, x.s, src.gold, src.question_type from x join src using (id)) group by 1""")
def gold_ceiling(spark: SparkSession, d: str) -> DataFrame:
    """How often the engine reaches the gold answer when it is given the gold operation."""
    gold = table(spark, d, R).select(
        "rec_id",
        F.coalesce("question_type", F.lit("(none)")).alias("type"),
        F.col("metadata.spec.type").alias("kind"),
        F.array_sort(F.coalesce("gold_answer.rows", F.array())).alias("g"),
        F.array_sort(F.array_distinct("gold_answer.metrics")).alias("m")
    )
    same = (F.col("answer") == F.col("g")) & ((F.col("kind") != "tradeoff_summary") | (F.array_sort(F.array_distinct("metrics")) == F.col("m")))
    return gold.join(_executed(spark, d), "rec_id").groupBy("type").agg(
        F.count("*").alias("n"),
        F.count_if(F.coalesce(F.col("error").isNull() & same, F.lit(False))).alias("n_reached")
    )


@query(f"""with {_SOURCE}, free as (select * exclude (s), case when s is not null then struct_pack(type := s.type, target := s.target, target_dir := s.target_dir, "constraint" := s."constraint", op := s.op, threshold := s.threshold, conditions := s.conditions, m1 := s.m1, m2 := s.m2, d1 := s.d1, d2 := s.d2, "rows" := cast(null as integer[])) end as s from src),
    one as (with {sql.executed('src')} select id, ans, error from x), two as (with {sql.executed('free')} select id, ans, {sql.entity_rows('rw')} as entities, len(rw) as height from x),
    z as (select coalesce(s.type, '(none)') as type, height > len(entities) as totals, one.ans <> two.ans as differs, len(list_filter(two.ans, lambda i: not list_contains(one.ans, i))) > 0 and len(list_filter(two.ans, lambda i: not list_contains(one.ans, i) and list_contains(entities, i))) = 0 as due from src join one using (id) join two using (id) where one.error is null)
    select case when grouping(type) = 1 then 'ALL' else type end as type, count(*) as n, count_if(totals) as n_with_totals, count_if(differs) as n_differs, count_if(differs and due) as n_due_to_totals from z group by rollup (type)""")
def universe_divergence(spark: SparkSession, d: str) -> DataFrame:
    """By type, and over all: answers that change where an operation ranges over all rows, and those that only totals change."""
    r = table(spark, d, R)
    free = r.select(
        "rec_id",
        "table",
        F.struct(F.col("metadata.spec").withField("rows", F.lit(None).cast("array<int>")).alias("spec")).alias("metadata")
    )
    rows = F.coalesce("table.rows", F.array())
    own = r.select(
        "rec_id",
        F.coalesce("metadata.spec.type", F.lit("(none)")).alias("type"),
        corpus.entity_rows(rows).alias("entities"),
        F.size(rows).alias("height")
    )
    x = own.join(
        _executed(spark, d).where("error is null").select("rec_id", F.col("answer").alias("one")),
        "rec_id"
    ).join(_executed(spark, d, free).select("rec_id", F.col("answer").alias("two")), "rec_id")
    added = F.array_except("two", "one")
    x = x.select(
        "type",
        (F.col("height") > F.size("entities")).alias("totals"),
        (F.col("one") != F.col("two")).alias("differs"),
        ((F.size(added) > 0) & (F.size(F.array_intersect(added, F.col("entities"))) == 0)).alias("due")
    )
    return x.rollup("type").agg(
        F.count("*").alias("n"),
        F.count_if("totals").alias("n_with_totals"),
        F.count_if("differs").alias("n_differs"),
        F.count_if(F.col("differs") & F.col("due")).alias("n_due_to_totals"),
        F.grouping("type").alias("g")
    ).withColumn("type", F.when(F.col("g") == 1, "ALL").otherwise(F.col("type"))).drop("g")


_CHECKED = f"with {_SOURCE}, {sql.validated('src')}"
_FAILED = "concat_ws(',', " + ", ".join(f"case when not {c} then '{c}' end" for c in validator.CHECKS) + ")"


@query(f"{_CHECKED} select id as rec_id, {', '.join(validator.CHECKS)}, {' and '.join(validator.CHECKS)} as valid, {_FAILED} as failed from checked")
def validate_all(spark: SparkSession, d: str) -> DataFrame:
    return validator.validate(table(spark, d, R), "rec_id").select("rec_id", *validator.CHECKS, "valid", F.array_join("failed", ",").alias("failed"))


#: A query for each check, over records into which faults were planted.
_BY_CHECK = {
    "check_schema": "schema_valid",
    "check_cells_exist": "cells_exist",
    "check_answer": "answer_correct",
    "check_comparisons": "numeric_comparisons_correct",
    "check_threshold": "threshold_satisfaction",
    "check_relevance": "relevance",
    "check_frontier": "pareto_frontier_correct",
    "check_empty": "empty_result_consistency",
    "check_tags": "difficulty_tag_present",
}
_PLANTED = f"""src as (select rec_id as id, "table".headers as h, "table"."rows" as rw, "table".row_labels as rl, "table".column_types as ct, metadata.spec as s,
    case when gold_answer is not null then struct_pack(label := case when rec_id % 5 = 2 then 'none' else gold_answer.label end, "rows" := case when rec_id % 4 = 2 then list_reverse(gold_answer."rows")[1:1] when rec_id % 4 = 3 then case when gold_answer."rows" is not null then list_concat(gold_answer."rows", [1]) end when rec_id % 11 = 8 then [] else gold_answer."rows" end, metrics := gold_answer.metrics) end as gold,
    trace_steps as steps, case when rec_id % 6 = 1 then list_transform(evidence_cells, lambda c: case when c is not null then struct_pack("row" := c."row" + 1, col := c.col, col_name := c.col_name, value := c.value) end) when rec_id % 6 = 2 then evidence_cells[2:] else evidence_cells end as evidence,
    case when rec_id % 3 = 1 then 'easy' else metadata.difficulty end as level, metadata.edge_cases as edges, table_id, domain, question, case when rec_id % 7 = 1 then 'other' else question_type end as question_type, trace_source from {R})"""


def _planted(spark: SparkSession, d: str) -> DataFrame:
    """Records with faults: other rows and labels in the answer, shifted and lost citations, unknown types, other difficulties."""
    k = F.col("rec_id")
    rows = F.col("gold_answer.rows")
    said = F.when(k % 4 == 2, F.slice(F.reverse(rows), 1, 1)).when(
        k % 4 == 3,
        F.concat(rows, F.array(F.lit(1)))
    ).when(k % 11 == 8, F.array().cast("array<int>")).otherwise(rows)
    moved = F.transform("evidence_cells", lambda c: F.when(c.isNotNull(), c.withField("row", c["row"] + 1)))
    fewer = F.slice("evidence_cells", F.lit(2), F.greatest(F.size("evidence_cells"), F.lit(1)))
    return table(spark, d, R).withColumns({
        "gold_answer": F.when(
            F.col("gold_answer").isNotNull(),
            F.col("gold_answer").withField("rows", said).withField("label", F.when(k % 5 == 2, "none").otherwise(F.col("gold_answer.label")))
        ),
        "evidence_cells": F.when(k % 6 == 1, moved).when(k % 6 == 2, fewer).otherwise(F.col("evidence_cells")),
        "metadata": F.col("metadata").withField("difficulty", F.when(k % 3 == 1, "easy").otherwise(F.col("metadata.difficulty"))),
        "question_type": F.when(k % 7 == 1, "other").otherwise(F.col("question_type")),
    })


def _check(name: str, check: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return validator.validate(_planted(spark, d), "rec_id").select("rec_id", check)

    run.__name__, run.__doc__ = name, f"The check {check} over records with planted faults."
    query(f"with {_PLANTED}, {sql.validated('src')} select id as rec_id, {check} from checked")(run)


for _name, _one in _BY_CHECK.items():
    _check(_name, _one)


@query(
    f"{_CHECKED} select failed, count(*) as n from (select unnest(string_split({_FAILED}, ',')) as failed from checked where {_FAILED} <> '') group by 1"
)
def validation_hist(spark: SparkSession, d: str) -> DataFrame:
    return validator.validate(table(spark, d, R), "rec_id").select(F.explode("failed").alias("failed")).groupBy("failed").agg(F.count("*").alias("n"))


_CITES = f"""cites as (select rec_id, cast(i - 1 as integer) as cite_no, case when rec_id % 6 = 1 then c."row" + 1000 when rec_id % 6 = 4 then c."row" + 1 else c."row" end as r, c.col as k, case when rec_id % 6 = 2 then concat(c.col_name, '?') else c.col_name end as name,
        case when rec_id % 6 = 3 then 'abc' when rec_id % 6 = 5 then cast(round({sql.number('c.value')} * 1.001, 3) as decimal(30, 3))::varchar else c.value end as v
        from (select rec_id, generate_subscripts(evidence_cells, 1) as i, unnest(evidence_cells) as c from {R}) where c is not null),
    grids as (select rec_id, "table".headers as h, "table"."rows" as rw, (select max(len(x)) from (select unnest("table"."rows") as x)) as width from {R} where "table".headers is not null),
    y as (select cites.*, h, rw, width, rw[r + 1][k + 1] as cell, {sql.number('v')} as a, {sql.number('rw[r + 1][k + 1]')} as b from cites left join grids using (rec_id)),
    z as (select rec_id, cite_no, case when not coalesce(r between 0 and len(rw) - 1 and k between 0 and least(len(h), width) - 1 and k < len(rw[r + 1]), false) then 'row_oob' when not coalesce(h[k + 1] = name, false) then 'colname_mismatch'
        when case when a is not null and b is not null then abs(a - b) <= 1e-6 else a is null and b is null and trim(coalesce(v, '')) = trim(coalesce(cell, '')) end then 'ok'
        when len(list_filter(rw, lambda x: case when a is not null then coalesce({sql.number('x[k + 1]')} = a, false) else {sql.number('x[k + 1]')} is null and trim(coalesce(x[k + 1], '')) = trim(coalesce(v, '')) end)) > 0 then 'wrong_row'
        when coalesce(abs(a - b) / greatest(abs(b), 1.0) <= 5e-3, false) then 'rounding' when (a is null) <> (b is null) then 'type_format' else 'not_in_column' end as label from y)"""


def _cites(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Citations with planted faults, and the cells of the tables."""
    r, k = table(spark, d, R), F.col("rec_id") % 6
    moved = F.when(k == 1, F.col("c.row") + 1000).when(k == 4, F.col("c.row") + 1).otherwise(F.col("c.row"))
    named = F.when(k == 2, F.concat("c.col_name", F.lit("?"))).otherwise(F.col("c.col_name"))
    value = F.when(k == 3, F.lit("abc")).when(
        k == 5,
        F.round(text.cell_number(F.col("c.value")) * 1.001, 3).cast("decimal(30,3)").cast("string")
    ).otherwise(F.col("c.value"))
    cites = r.select("rec_id", F.posexplode("evidence_cells").alias("cite_no", "c")).where("c is not null").select(
        "rec_id",
        "cite_no",
        moved.alias("row"),
        F.col("c.col").alias("col"),
        named.alias("col_name"),
        value.alias("value")
    )
    rows = r.where("table.headers is not null").select("rec_id", "table.headers", F.posexplode("table.rows").alias("row", "cells"))
    return cites, rows.select("rec_id", "row", "headers", F.posexplode("cells").alias("col", "txt")).where(F.col("col") < F.size("headers")).select(
        "rec_id",
        "row",
        "col",
        F.get("headers", F.col("col")).alias("col_name"),
        "txt"
    )


@query(f"with {_CITES} select rec_id, cite_no, label from z")
def classify_cites(spark: SparkSession, d: str) -> DataFrame:
    """What is wrong with citations in which faults were planted, within their records."""
    k = F.col("rec_id") % 6

    def planted(c):  # noqa: ANN001, ANN202
        value = F.when(k == 3, F.lit("abc")).when(
            k == 5,
            F.round(text.cell_number(c["value"]) * 1.001, 3).cast("decimal(30,3)").cast("string")
        ).otherwise(c["value"])
        row = F.when(k == 1, c["row"] + 1000).when(k == 4, c["row"] + 1).otherwise(c["row"])
        return F.when(
            c.isNotNull(),
            F.struct(
                row.alias("row"),
                c["col"].alias("col"),
                F.when(k == 2, F.concat(c["col_name"], F.lit("?"))).otherwise(c["col_name"]).alias("col_name"),
                value.alias("value")
            )
        )

    r = table(spark, d, R).select(
        "rec_id",
        F.col("table.headers").alias("heads"),
        F.col("table.rows").alias("grid"),
        F.transform("evidence_cells", planted).alias("cites")
    )
    return corpus.classify_within(r, "rec_id", "heads", "grid", "cites")


@query(f"with {_CITES} select rec_id, cite_no, label from z")
def classify_cites_joined(spark: SparkSession, d: str) -> DataFrame:
    """The same by joins, for tables of any length in their long form."""
    return corpus.classify_cites(*_cites(spark, d), "rec_id")


@query(f"with {_CITES} select label, count(*) as n, count(distinct rec_id) as n_records from z group by 1")
def cite_hist(spark: SparkSession, d: str) -> DataFrame:
    """Citations, and records with such a citation, by what is wrong."""
    return classify_cites(spark, d).groupBy("label").agg(F.count("*").alias("n"), F.count_distinct("rec_id").alias("n_records"))


_CANON = r"""regexp_replace(regexp_replace(regexp_replace(trim({x}), '^[()]+|[()]+$', '', 'g'), '[$£€¥,]|RMB|USD|GBP|EUR', '', 'gi'), '^\s+|\s+$', '', 'g')"""


def _canon(x: str) -> str:
    body = f"trim(regexp_replace({_CANON.format(x=x)}, '%+$', ''))"
    v = f"case when regexp_matches({body}, '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$') then try_cast({body} as double) end"
    return f"(case when trim({x}) like '(%)' then -1 else 1 end * ({v}) / case when {_CANON.format(x=x)} like '%\\%' escape '\\' then 100 else 1 end)"


_BAD = f"""bad as (select rec_id, coalesce(case when {_canon('c.value')} is not null and {_canon('cell')} is not null then abs({_canon('c.value')} - {_canon('cell')}) <= 1e-6 else trim(c.value) = trim(cell) end, false) as same
    from (select rec_id, c, rw[c."row" + 1][c.col + 1] as cell from (select rec_id, "table"."rows" as rw, unnest(evidence_cells) as c from {R}) where c is not null) where c.value is distinct from cell)"""


@query(
    f"with {_BAD} select count(*) as n_bad, count_if(same) as n_reclaimed, count(distinct rec_id) as n_cases, count(distinct rec_id) - count(distinct case when not same then rec_id end) as n_cases_reclaimed from bad"
)
def normalization_reclaim(spark: SparkSession, d: str) -> DataFrame:
    """Citations whose text isn't the cell's: how many are the same value in another format, and the cases in which all are."""
    c = table(spark, d, R).select("rec_id", "table.rows", F.explode("evidence_cells").alias("c")).where("c is not null").select(
        "rec_id",
        F.col("c.value").alias("v"),
        F.get(F.get("rows", F.col("c.row")), F.col("c.col")).alias("cell")
    )
    per = c.where("not (v <=> cell)").select("rec_id", text.fmt_equiv(F.col("v"), F.col("cell")).alias("same")).groupBy("rec_id").agg(
        F.count("*").alias("n"),
        F.count_if("same").alias("k"),
        F.bool_and("same").alias("all")
    )
    return per.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_bad"),
        F.coalesce(F.sum("k"), F.lit(0)).alias("n_reclaimed"),
        F.count("*").alias("n_cases"),
        F.count_if("all").alias("n_cases_reclaimed")
    )


_GOLD = f"gold as (select metadata.example_id as example_id, arg_max(metadata.spec, rec_id) as g from {R} where metadata.example_id is not null group by 1)"
_NEAR = "coalesce(abs({x} - {y}) <= 1e-6 * greatest(1.0, abs({y})), {x} is null and {y} is null)"
_OPC = "case when {x} = 'ge' then 'gte' else {x} end"


def _same_operation(m: str, g: str, t: str = "T") -> dict[str, str]:
    best, top, keep, front = (f"{g}.type = '{k}'" for k in ("best_under_constraint", "extremum", "threshold_filter", "tradeoff_summary"))
    eq = lambda f: f'{m}."{f}" is not distinct from {g}."{f}"'
    pairs = lambda o, n: f"list_sort(list_transform(coalesce({o}.conditions, []), lambda c: struct_pack(metric := coalesce(c.metric, ''), op := {_OPC.format(x='c.op')}, t := c.{n})))"
    a, b = pairs(m, t), pairs(g, "t")
    near = _NEAR.format(x="z[1].t", y="z[2].t")
    return {
        "type": eq("type"),
        "target": f"case when {best} or {top} then {eq('target')} end",
        "target_dir": f"case when {best} or {top} then {eq('target_dir')} end",
        "constraint": f"case when {best} then {eq('constraint')} end",
        "op": f"case when {best} then {_OPC.format(x=m + '.op')} is not distinct from {_OPC.format(x=g + '.op')} end",
        "threshold": f"case when {best} then {_NEAR.format(x=m + '.threshold', y=g + '.threshold')} end",
        "conditions": f"case when {keep} then len({a}) = len({b}) and len(list_filter(list_zip({a}, {b}), lambda z: not coalesce(z[1].metric = z[2].metric and z[1].op is not distinct from z[2].op and {near}, false))) = 0 end",
        "metrics": f"case when {front} then list_sort(list_distinct([{m}.m1, {m}.m2])) = list_sort(list_distinct([{g}.m1, {g}.m2])) end",
        "dirs": f"case when {front} then {eq('d1')} and {eq('d2')} end",
    }


_FIELDS = ("type", "target", "target_dir", "constraint", "op", "threshold", "conditions", "metrics", "dirs")
_WHOLE = " and ".join(f'coalesce(cmp."{f}", true)' for f in _FIELDS)
_CMP = f"cmp as (select detail_id, m, " + ", ".join(
    f'{v} as "{k}"' for k, v in _same_operation("m", "g").items()
) + f" from (select a.detail_id, op.m, gold.g from {A} a left join op using (detail_id) left join gold on a.example_id = gold.example_id))"


def _compared(spark: SparkSession, d: str) -> DataFrame:
    gold = table(spark, d, R).where("metadata.example_id is not null").groupBy(
        F.col("metadata.example_id").alias("example_id")
    ).agg(F.max_by("metadata.spec", "rec_id").alias("g"))
    a = table(spark, d, A).select("detail_id", "example_id", records.runnable(records.extract_operation(F.col("raw"))).alias("o"))
    return a.join(gold, "example_id", "left").select(
        "detail_id",
        "o",
        F.col("g.type").alias("gold_type"),
        records.compare_operations(F.col("o"), F.col("g")).alias("c")
    )


@query(
    f"with {sql.OBJECTS}, {_GOLD}, {_CMP} select a.detail_id, cmp.m.type as op_type, coalesce(cmp.m is not null and {_WHOLE}, false) as whole from {A} a left join cmp using (detail_id)"
)
def extract_operation_all(spark: SparkSession, d: str) -> DataFrame:
    """The operations of all answers, also of those with remarks around the JSON, compared with the gold operation."""
    return _compared(spark, d).select("detail_id", F.col("o.type").alias("op_type"), "c.whole")


@query(f"""with {sql.OBJECTS}, {_GOLD}, {_CMP} select gold_type, field, count(*) as n, count_if(ok) as n_ok from (select g.type as gold_type, unnest([{', '.join(f"struct_pack(field := '{f}', ok := cmp.\"{f}\")" for f in _FIELDS)}], recursive := true)
    from cmp join {A} a using (detail_id) join gold on a.example_id = gold.example_id where m is not null and g.type is not null) where ok is not null group by 1, 2""")
def op_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """Of the operations found, how often each field agrees with the gold operation, by the gold's type."""
    fields = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"c.`{f}`").alias("ok")) for f in _FIELDS))).alias("x")
    return _compared(spark, d).where("o is not null and gold_type is not null").select("gold_type", fields).select("gold_type", "x.*").where("ok is not null").groupBy("gold_type", "field").agg(
        F.count("*").alias("n"),
        F.count_if("ok").alias("n_ok")
    )


@query(f"""with r as materialized (select rec_id, metadata.spec as g from {R}), p as (select rec_id, g, struct_pack(type := g.type, target := case when rec_id % 3 = 1 then concat(g.target, 'x') else g.target end, target_dir := g.target_dir, "constraint" := g."constraint", op := case when g.op = 'gte' then 'ge' when rec_id % 7 = 2 then 'lt' else g.op end,
        threshold := case when rec_id % 5 = 2 then g.threshold + 100 else g.threshold * (1 + 1e-9) end, conditions := list_transform(list_reverse(g.conditions), lambda c: struct_pack(metric := case when rec_id % 4 = 1 then concat(c.metric, '?') else c.metric end, op := case when rec_id % 4 = 2 then 'lt' else c.op end, T := case when rec_id % 4 = 3 then c.t + 1 else c.t end)),
        m1 := g.m2, m2 := case when rec_id % 9 = 4 then 'zz' else g.m1 end, d1 := g.d1, d2 := case when rec_id % 6 = 5 then 'lower' else g.d2 end) as m from r where g.type is not null),
    cmp as (select rec_id, {', '.join(f'{v} as "{k}"' for k, v in _same_operation('m', 'g').items())} from p) select *, {_WHOLE} as whole from cmp""")
def cmp_ops(spark: SparkSession, d: str) -> DataFrame:
    """Operations with planted differences in every field compared with their originals."""
    k, g = F.col("rec_id"), F.col("metadata.spec")
    conds = F.transform(
        F.reverse(g["conditions"]),
        lambda c: F.struct(
            F.when(k % 4 == 1, F.concat(c["metric"], F.lit("?"))).otherwise(c["metric"]).alias("metric"),
            F.when(k % 4 == 2, "lt").otherwise(c["op"]).alias("op"),
            F.when(k % 4 == 3, c["t"] + 1).otherwise(c["t"]).alias("t")
        )
    )
    m = F.struct(
        g["type"].alias("type"),
        F.when(k % 3 == 1, F.concat(g["target"], F.lit("x"))).otherwise(g["target"]).alias("target"),
        g["target_dir"].alias("target_dir"),
        g["constraint"].alias("constraint"),
        F.when(g["op"] == "gte", "ge").when(k % 7 == 2, "lt").otherwise(g["op"]).alias("op"),
        F.when(k % 5 == 2, g["threshold"] + 100).otherwise(g["threshold"] * (1 + 1e-9)).alias("threshold"),
        conds.alias("conditions"),
        g["m2"].alias("m1"),
        F.when(k % 9 == 4, "zz").otherwise(g["m1"]).alias("m2"),
        g["d1"].alias("d1"),
        F.when(k % 6 == 5, "lower").otherwise(g["d2"]).alias("d2"),
    )
    return table(spark, d, R).where("metadata.spec.type is not null").select(
        "rec_id",
        records.compare_operations(m, g).alias("c")
    ).select("rec_id", "c.*")


@query(f"""with {sql.OBJECTS}, q as (select coalesce(metadata.example_id, table_id) as example_id, arg_max(question, rec_id) filter (question is not null) as question from {R} group by 1),
    g as (select a.model, coalesce(a.engine_ok, false) as e, coalesce(a.model_ok, false) as m, {sql.fires('op.m.type', 'q.question')} as fires from {A} a left join op using (detail_id) left join q on a.example_id = q.example_id)
    select model, count(*) as n, count_if(e) as n_engine, count_if(m) as n_model, count_if(case when fires then m else e end) as n_gated, count_if(fires) as n_fires from g group by 1""")
def gate_scoring(spark: SparkSession, d: str) -> DataFrame:
    """Engine, model and gated answers by model: the gate takes the operation in ``raw`` and the question of the answer's example.

    Of a repeated example the last record with a question counts; an answer without an example has no question. Answers
    are counted by example before the join, so that an example with many answers moves no more than any other.
    """
    questions = table(spark, d, R).where("question is not null").groupBy(
        F.coalesce("metadata.example_id", "table_id").alias("example_id")
    ).agg(F.max_by("question", "rec_id").alias("question"))
    a = table(spark, d, A).select(
        "example_id",
        "model",
        F.coalesce("engine_ok", F.lit(False)).alias("e"),
        F.coalesce("model_ok", F.lit(False)).alias("m"),
        records.operation_type(F.col("raw")).alias("op")
    )
    a = a.groupBy("example_id", "model", "e", "m", "op").agg(F.count("*").alias("k"))
    g = a.join(questions, "example_id", "left").withColumn("fires", text.gate_fires(F.col("op"), F.col("question")))
    n = lambda c: F.coalesce(F.sum(F.when(c, F.col("k"))), F.lit(0))
    return g.groupBy("model").agg(
        F.sum("k").alias("n"),
        n(F.col("e")).alias("n_engine"),
        n(F.col("m")).alias("n_model"),
        n(F.when(F.col("fires"), F.col("m")).otherwise(F.col("e"))).alias("n_gated"),
        n(F.col("fires")).alias("n_fires")
    )


def constructed(answers: DataFrame, examples: DataFrame) -> DataFrame:
    """``detail_id``, ``grounded_constructed``, ``valid_constructed``: each answer's operation run by the engine over its example's entities,
    and the system's record (the engine's answer with the cells it read as evidence) put before the validator.

    Equal operations of one example are run once. Of a repeated example the last record counts. The tables go with their
    runs through the engine to the validator; no join broadcasts a side, since the planner takes nested tables for small.
    """
    last = examples.where("metadata.example_id is not null").groupBy(F.col("metadata.example_id").alias("example_id")).agg(
        F.max_by(F.struct("table_id", "domain", "table", "question", "question_type", "metadata"), "rec_id").alias("r")
    )
    a = answers.select(
        "detail_id",
        "example_id",
        records.runnable(records.extract_operation(F.col("raw"))).alias("o")
    ).where("o is not null").withColumn("run", F.concat_ws("|", "example_id", F.to_json("o")))
    runs = a.select("run", "example_id", "o").dropDuplicates(["run"]).join(last.hint("merge"), "example_id").select(
        "run",
        "r.*",
        corpus.bind_universe(F.col("o"), F.coalesce("r.table.rows", F.array())).alias("o")
    )
    carried = ("table_id", "domain", "table", "question", "question_type", "metadata")
    e = corpus.execute(runs, "run", "table.headers", "table.rows", "o", "table.row_labels", carried).where("error is null")
    step = F.struct(
        F.lit(0).alias("index"),
        F.lit("conclude").alias("kind"),
        F.lit("Answer computed from the cited cells.").alias("description"),
        F.col("evidence").alias("cites")
    )
    # the key says as well whether there is evidence
    some = F.when(F.size("evidence") > 0, "1").otherwise("0")
    system = e.select(
        F.concat(some, "run").alias("key"),
        *carried,
        F.lit("programmatic").alias("trace_source"),
        F.struct("label", F.col("answer").alias("rows"), "metrics").alias("gold_answer"),
        F.array(step).alias("trace_steps"),
        F.col("evidence").alias("evidence_cells")
    )
    v = validator.validate(system, "key").select(
        F.expr("substr(key, 2)").alias("run"),
        F.col("key").startswith("1").alias("some"),
        "cells_exist",
        "valid"
    )
    return a.join(v.hint("merge"), "run").select(
        "detail_id",
        (F.col("some") & F.col("cells_exist")).alias("grounded_constructed"),
        F.col("valid").alias("valid_constructed")
    )


_SYSTEM = f"""last as (select metadata.example_id as example_id, arg_max(struct_pack(t := "table", spec := metadata.spec, level := metadata.difficulty, edges := metadata.edge_cases, table_id := table_id, domain := domain, question := question, question_type := question_type), rec_id) as r from {R} where metadata.example_id is not null group by 1),
    runs as (select a.detail_id as id, r.t.headers as h, r.t."rows" as rw, r.t.row_labels as rl, r.t.column_types as ct, r.spec as spec, r.level as level, r.edges as edges, r.table_id as table_id, r.domain as domain, r.question as question, r.question_type as question_type,
        struct_pack(type := m.type, target := m.target, target_dir := m.target_dir, "constraint" := m."constraint", op := m.op, threshold := m.threshold, conditions := list_transform(m.conditions, lambda c: struct_pack(metric := c.metric, op := c.op, t := c.T)), m1 := m.m1, m2 := m.m2, d1 := m.d1, d2 := m.d2, "rows" := {sql.entity_rows('coalesce(r.t."rows", [])')}) as s
        from {A} a join op using (detail_id) join last on a.example_id = last.example_id where m is not null),
    done as (with {sql.executed('runs')} select x.id, x.ans, x.label, case when s.type = 'tradeoff_summary' then [s.m1, s.m2] else [] end as metrics, coalesce(c.cells, []) as cells from x left join (select id, list(struct_pack("row" := "row", col := col, col_name := col_name, value := value)) as cells from ev group by 1) c using (id) where error is null),
    sys as (select r.id, r.h, r.rw, r.rl, r.ct, struct_pack(label := done.label, "rows" := done.ans, metrics := done.metrics) as gold, [struct_pack("index" := 0, kind := 'conclude', description := 'x', cites := done.cells)] as steps, done.cells as evidence, r.spec as s, r.level, r.edges, r.table_id, r.domain, r.question, r.question_type, 'programmatic' as trace_source from runs r join done using (id)),
    judged as (with {sql.validated('sys')} select checked.*, len(done.cells) > 0 as found from checked join done using (id))"""


@query(
    f"""with {sql.OBJECTS}, {_SYSTEM} select model, count(*) as n, count_if(coalesce(grounded, false)) as n_model_grounded, count_if(coalesce(found and cells_exist, false)) as n_grounded, count_if(coalesce({' and '.join(validator.CHECKS)}, false)) as n_valid from {A} a left join judged on a.detail_id = judged.id group by 1"""
)
def grounded_rescore(spark: SparkSession, d: str) -> DataFrame:
    """Citations by construction: every answer run again by the engine, and its evidence put before the validator."""
    a = table(spark, d, A)
    c = a.select("detail_id", "model", F.coalesce("grounded", F.lit(False)).alias("g")).join(
        constructed(a, table(spark, d, R)).hint("merge"),
        "detail_id",
        "left"
    )
    return c.groupBy("model").agg(
        F.count("*").alias("n"),
        F.count_if("g").alias("n_model_grounded"),
        F.count_if("grounded_constructed").alias("n_grounded"),
        F.count_if("valid_constructed").alias("n_valid")
    )


@query(
    f"""with {_SOURCE} select id as rec_id, cast(i as integer) as "row", coalesce(case when len(rl) > 0 then rl[i + 1] end, case when list_position(ct, 'categorical') > 0 then rw[i + 1][list_position(ct, 'categorical')] end, concat('row ', i)) as label from (select *, unnest(range(len(rw))) as i from src)"""
)
def row_labels(spark: SparkSession, d: str) -> DataFrame:
    """The name of every row by the chain of row label, first categorical column and number."""
    x = table(spark, d, R).select("rec_id", "table", F.posexplode("table.rows").alias("row", "_"))
    return x.select("rec_id", "row", corpus.row_label(F.col("table"), F.col("row")).alias("label"))
