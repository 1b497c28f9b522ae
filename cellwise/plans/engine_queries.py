"""Queries of the engine over the star schema: each group of a table is one table of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwise.functions import text
from cellwise.operators import engine
from cellwise.session import table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):  # noqa: ANN201
    """Registers a query under its function's name, with the SQL that gives the same rows."""

    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _part(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part")


_BEST = "with s as (select * from part where {where}), b as (select p_brand, {agg}({t}) as best from s group by p_brand) select s.p_brand, s.p_partkey, s.{t} from s join b on s.p_brand = b.p_brand where abs(s.{t} - b.best) <= 1e-9"


@query(_BEST.format(where="p_size < 25", agg="max", t="p_retailprice"))
def best_under_constraint_high(spark: SparkSession, d: str) -> DataFrame:
    return engine.best_under_constraint(
        _part(spark, d),
        "p_retailprice",
        "higher",
        "p_size",
        "lt",
        25,
        ["p_brand"]
    ).select("p_brand", "p_partkey", "p_retailprice")


@query(_BEST.format(where="p_size >= 25", agg="min", t="p_retailprice"))
def best_under_constraint_low(spark: SparkSession, d: str) -> DataFrame:
    return engine.best_under_constraint(
        _part(spark, d),
        "p_retailprice",
        "lower",
        "p_size",
        "ge",
        25,
        ["p_brand"]
    ).select("p_brand", "p_partkey", "p_retailprice")


@query(_BEST.format(where="p_retailprice < 1500", agg="max", t="p_size"))
def best_under_constraint_tie(spark: SparkSession, d: str) -> DataFrame:
    return engine.best_under_constraint(
        _part(spark, d),
        "p_size",
        "higher",
        "p_retailprice",
        "lt",
        1500,
        ["p_brand"]
    ).select("p_brand", "p_partkey", "p_size")


@query("select distinct p_brand, 'none' as label, cast(0 as bigint) as n_rows from part")
def best_under_constraint_empty(spark: SparkSession, d: str) -> DataFrame:
    won = engine.best_under_constraint(_part(spark, d), "p_retailprice", "higher", "p_size", "gte", 999, ["p_brand"])
    return engine.with_none(engine.answer_label(won, "p_name", "p_partkey", ["p_brand"]), _part(spark, d), ["p_brand"])


@query("select p_partkey, p_retailprice from part where p_retailprice = (select max(p_retailprice) from part where p_size < 10) and p_size < 10")
def best_under_constraint_whole(spark: SparkSession, d: str) -> DataFrame:
    return engine.best_under_constraint(_part(spark, d), "p_retailprice", "higher", "p_size", "lt", 10).select("p_partkey", "p_retailprice")


@query("select l_orderkey, l_linenumber, l_quantity from lineitem where l_quantity >= 45")
def threshold_filter_one(spark: SparkSession, d: str) -> DataFrame:
    return engine.threshold_filter(table(spark, d, "lineitem"), [("l_quantity", "gte", 45)]).select("l_orderkey", "l_linenumber", "l_quantity")


@query("select l_orderkey, l_linenumber, l_quantity, l_discount from lineitem where l_quantity >= 45 and l_discount < 0.02")
def threshold_filter_two(spark: SparkSession, d: str) -> DataFrame:
    return engine.threshold_filter(
        table(spark, d, "lineitem"),
        [("l_quantity", "gte", 45), ("l_discount", "lt", 0.02)]
    ).select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")


_FRONT = "select a.p_brand, a.p_partkey, a.p_size, a.p_retailprice from part a where not exists (select 1 from part b where b.p_brand = a.p_brand and {s}b.p_size >= {s}a.p_size and b.p_retailprice >= a.p_retailprice and ({s}b.p_size > {s}a.p_size or b.p_retailprice > a.p_retailprice))"
_COLS = ("p_brand", "p_partkey", "p_size", "p_retailprice")


@query(_FRONT.format(s=""))
def pareto_max_max(spark: SparkSession, d: str) -> DataFrame:
    return engine.pareto(_part(spark, d), "p_size", "p_retailprice", "higher", "higher", ["p_brand"]).select(*_COLS)


@query(_FRONT.format(s="-"))
def pareto_min_max(spark: SparkSession, d: str) -> DataFrame:
    return engine.pareto(_part(spark, d), "p_size", "p_retailprice", "lower", "higher", ["p_brand"]).select(*_COLS)


@query(_FRONT.format(s=""))
def pareto_antijoin(spark: SparkSession, d: str) -> DataFrame:
    return engine.pareto_antijoin(_part(spark, d), "p_size", "p_retailprice", "higher", "higher", ["p_brand"]).select(*_COLS)


@query(
    "select l_orderkey, l_linenumber, l_extendedprice, l_discount from (select *, max(l_discount) over (order by l_extendedprice desc rows between unbounded preceding and 1 preceding) as before, max(l_discount) over (partition by l_extendedprice) as same from lineitem) where l_discount >= same and (before is null or l_discount > before or (l_discount = before and l_extendedprice >= (select max(l_extendedprice) from lineitem x where x.l_discount >= same)))"
)
def pareto_whole_table(spark: SparkSession, d: str) -> DataFrame:
    return engine.pareto_global(
        table(spark, d, "lineitem"),
        "l_extendedprice",
        "l_discount",
        "higher",
        "higher"
    ).select("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount")


_EXT = "select c_nationkey, c_custkey, c_acctbal from (select *, {a}(c_acctbal) over (partition by c_nationkey) as best from customer) where abs(c_acctbal - best) <= 1e-9"


@query(_EXT.format(a="max"))
def extremum_high(spark: SparkSession, d: str) -> DataFrame:
    return engine.extremum(table(spark, d, "customer"), "c_acctbal", "higher", ["c_nationkey"]).select("c_nationkey", "c_custkey", "c_acctbal")


@query(_EXT.format(a="min"))
def extremum_low(spark: SparkSession, d: str) -> DataFrame:
    return engine.extremum(table(spark, d, "customer"), "c_acctbal", "lower", ["c_nationkey"]).select("c_nationkey", "c_custkey", "c_acctbal")


_TIES = "(select p_brand, p_partkey, p_name, p_size, p_retailprice from (select *, max(p_size) over (partition by p_brand) as best from part where p_retailprice < 1500) where p_size = best)"


def _ties(spark: SparkSession, d: str) -> DataFrame:
    return engine.best_under_constraint(_part(spark, d), "p_size", "higher", "p_retailprice", "lt", 1500, ["p_brand"])


@query(f"select p_brand, string_agg(p_name, ', ' order by p_partkey) as label, count(*) as n_rows from {_TIES} group by p_brand")
def answer_label(spark: SparkSession, d: str) -> DataFrame:
    return engine.answer_label(_ties(spark, d), "p_name", "p_partkey", ["p_brand"])


_UNPIVOT = "select p_partkey, 'p_size' as col_name, cast(p_size as double) as value from {s} union all select p_partkey, 'p_retailprice', p_retailprice from {s}"


@query(_UNPIVOT.format(s=_TIES))
def evidence_best(spark: SparkSession, d: str) -> DataFrame:
    return engine.evidence(_ties(spark, d), "p_partkey", ["p_size", "p_retailprice"])


@query(
    "with s as (select *, row_number() over (order by l_orderkey, l_linenumber) as k from lineitem where l_quantity >= 50 and l_discount < 0.01) select l_orderkey * 100 + l_linenumber as line, 'l_quantity' as col_name, l_quantity as value from s union all select l_orderkey * 100 + l_linenumber, 'l_discount', l_discount from s"
)
def evidence_threshold(spark: SparkSession, d: str) -> DataFrame:
    rows = engine.threshold_filter(table(spark, d, "lineitem"), [("l_quantity", "gte", 50), ("l_discount", "lt", 0.01)])
    return engine.evidence(rows.withColumn("line", F.col("l_orderkey") * 100 + F.col("l_linenumber")), "line", ["l_quantity", "l_discount"])


@query(_UNPIVOT.format(s=f"({_FRONT.format(s='')})"))
def evidence_pareto(spark: SparkSession, d: str) -> DataFrame:
    return engine.evidence(pareto_max_max(spark, d), "p_partkey", ["p_size", "p_retailprice"])


@query(f"select c_custkey, 'c_acctbal' as col_name, c_acctbal as value from ({_EXT.format(a='max')})")
def evidence_extremum(spark: SparkSession, d: str) -> DataFrame:
    return engine.evidence(extremum_high(spark, d), "c_custkey", ["c_acctbal"])


@query("""with won as (select p_brand, p_partkey, p_size, p_retailprice from (select *, max(p_retailprice) over (partition by p_brand) as best from part where p_size < 2) where p_retailprice = best)
    select p_brand, p_partkey, 'p_size' as col_name, cast(p_size as double) as value from won union all select p_brand, p_partkey, 'p_retailprice', p_retailprice from won
    union all select p_brand, p_partkey, 'p_size', cast(p_size as double) from part where p_brand not in (select p_brand from won)""")
def evidence_empty(spark: SparkSession, d: str) -> DataFrame:
    won = engine.best_under_constraint(_part(spark, d), "p_retailprice", "higher", "p_size", "lt", 2, ["p_brand"])
    return engine.evidence_or_universe(won, _part(spark, d), "p_partkey", ["p_size", "p_retailprice"], ["p_size"], ["p_brand"])


@query(
    "select c_custkey, 'c_acctbal' as col_name, c_acctbal as value from customer union all select c_custkey, 'c_nationkey', cast(c_nationkey as double) from customer"
)
def cells_unpivot(spark: SparkSession, d: str) -> DataFrame:
    return engine.evidence(table(spark, d, "customer"), "c_custkey", ["c_acctbal", "c_nationkey"])


_SUMS = "(select coalesce(o_orderpriority, 'Total') as label, o_orderstatus, round(sum(o_totalprice), 2) as amount from orders group by grouping sets ((o_orderpriority, o_orderstatus), (o_orderstatus)))"


def _sums(spark: SparkSession, d: str) -> DataFrame:
    per = table(spark, d, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.sum("o_totalprice").alias("s"))
    total = per.groupBy("o_orderstatus").agg(F.sum("s").alias("s")).withColumn("o_orderpriority", F.lit("Total"))
    return per.unionByName(total).select(F.col("o_orderpriority").alias("label"), "o_orderstatus", F.round("s", 2).alias("amount"))


@query(f"select label, o_orderstatus, label = 'Total' as total from {_SUMS}")
def is_total(spark: SparkSession, d: str) -> DataFrame:
    return _sums(spark, d).select("label", "o_orderstatus", text.is_total(F.col("label")).alias("total"))


@query(f"select label, o_orderstatus, round(amount, 0) as amount from {_SUMS} where label <> 'Total'")
def entity_universe(spark: SparkSession, d: str) -> DataFrame:
    return engine.universe(_sums(spark, d), "label").withColumn("amount", F.round("amount", 0))


@query(f"""with s as (select * from {_SUMS}), a as (select o_orderstatus, max(amount) as m from s group by 1), u as (select o_orderstatus, max(amount) as m from s where label <> 'Total' group by 1),
    x as (select s.o_orderstatus, s.label from s join a on s.o_orderstatus = a.o_orderstatus where s.amount = a.m), y as (select s.o_orderstatus, s.label from s join u on s.o_orderstatus = u.o_orderstatus where s.amount = u.m and s.label <> 'Total')
    select x.o_orderstatus, x.label as label_all, y.label as label_universe, x.label <> y.label as diverges from x join y on x.o_orderstatus = y.o_orderstatus""")
def totals_divergence(spark: SparkSession, d: str) -> DataFrame:
    """The same operation over all rows and over the universe: where they differ, a total leaked into the answer."""
    s = _sums(spark, d)
    a = engine.extremum(s, "amount", "higher", ["o_orderstatus"]).select("o_orderstatus", F.col("label").alias("label_all"))
    u = engine.extremum(
        engine.universe(s, "label"),
        "amount",
        "higher",
        ["o_orderstatus"]
    ).select("o_orderstatus", F.col("label").alias("label_universe"))
    return a.join(u, "o_orderstatus").withColumn("diverges", F.col("label_all") != F.col("label_universe"))


_STYLED = "case c_custkey % 6 when 0 then concat('$ ', cast(abs(c_nationkey) * 1111 as varchar)) when 1 then concat('(', cast(c_nationkey as varchar), '.5)') when 2 then concat(cast(c_nationkey as varchar), '.25%') when 3 then '—' when 4 then 'n/a' else concat('item ', cast(c_nationkey as varchar)) end"


def _styled(spark: SparkSession, d: str) -> DataFrame:
    n, k = F.col("c_nationkey"), F.col("c_custkey") % 6
    raw = F.when(k == 0, F.concat(F.lit("$ "), (n * 1111).cast("string"))).when(
        k == 1,
        F.concat(F.lit("("), n.cast("string"), F.lit(".5)"))
    ).when(k == 2, F.concat(n.cast("string"), F.lit(".25%"))).when(k == 3, "—").when(k == 4, "n/a").otherwise(F.concat(F.lit("item "), n.cast("string")))
    return table(spark, d, "customer").select("c_custkey", "c_nationkey", raw.alias("raw"))


@query(f"""select c_custkey, case c_custkey % 6 when 0 then 'int' when 1 then 'float' when 2 then 'float' when 5 then 'str' else 'empty' end as kind,
    case c_custkey % 6 when 0 then c_nationkey * 1111.0 when 1 then -(c_nationkey + 0.5) when 2 then c_nationkey + 0.25 end::double as num, case when c_custkey % 6 in (3, 4) then '' else {_STYLED} end as txt from customer""")
def parse_cell(spark: SparkSession, d: str) -> DataFrame:
    return _styled(spark, d).select("c_custkey", text.parse_cell(F.col("raw")).alias("p")).select("c_custkey", "p.*")


@query("select c_custkey, c_custkey % 6 in (3, 4) as missing from customer")
def missing_markers(spark: SparkSession, d: str) -> DataFrame:
    return _styled(spark, d).select("c_custkey", text.is_missing(F.col("raw")).alias("missing"))


@query(
    "select c_custkey, round(case c_custkey % 6 when 0 then c_nationkey * 1111.0 when 1 then -(c_nationkey + 0.5) when 2 then (c_nationkey + 0.25) / 100 end::double, 6) as num from customer"
)
def canon_num(spark: SparkSession, d: str) -> DataFrame:
    return _styled(spark, d).select("c_custkey", F.round(text.canon_num(F.col("raw")), 6).alias("num"))


@query("select c_custkey, c_custkey % 6 in (0, 3, 4, 5) as same from customer")
def fmt_equiv(spark: SparkSession, d: str) -> DataFrame:
    other = F.when(
        F.col("c_custkey") % 6 == 0,
        (F.col("c_nationkey") * 1111).cast("string")
    ).when(F.col("c_custkey") % 6 <= 2, F.lit("-99999")).otherwise(F.concat(F.col("raw"), F.lit(" ")))
    return _styled(spark, d).select("c_custkey", text.fmt_equiv(F.col("raw"), other).alias("same"))


@query("select l_orderkey, l_linenumber, l_extendedprice = floor(l_extendedprice) and l_extendedprice between 1900 and 2099 as year from lineitem")
def year_int(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", text.is_year(F.col("l_extendedprice")).alias("year"))


@query("select doc_id, nullif(regexp_extract(text, '(19|20)[0-9]{2}', 0), '') as year from documents")
def year_extract(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.year_of(F.col("text")).alias("year"))


@query("select p_partkey, lower(p_name) as label from part")
def norm_label(spark: SparkSession, d: str) -> DataFrame:
    return _part(spark, d).select("p_partkey", text.norm_label(F.concat(F.lit("  ."), F.upper("p_name"), F.lit(" ;"))).alias("label"))


@query("""select rec_id, case when list_has_any(w, ['largest','highest','greatest','most','maximum','max','biggest','longest','top']) then 'higher' when list_has_any(w, ['lowest','smallest','least','minimum','min','fewest','shortest']) then 'lower' end as direction
    from (select rec_id, string_split(trim(regexp_replace(lower(question), '[^a-z0-9]+', ' ', 'g')), ' ') as w from realtable_eval_verified)""")
def nl_superlative(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "realtable_eval_verified").select("rec_id", text.superlative_direction(F.col("question")).alias("direction"))


@query("select o_orderkey, case when o_orderkey % 2 = 0 then concat(o_custkey, '|', o_custkey + 5) end as chain from orders")
def chain_values(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_custkey")
    chain = F.when(
        F.col("o_orderkey") % 2 == 0,
        F.concat(k.cast("string"), F.lit(" < $"), (k + 5).cast("string"))
    ).otherwise(F.concat(k.cast("string"), F.lit(">5<"), k.cast("string")))
    return table(spark, d, "orders").select(
        "o_orderkey",
        F.array_join(F.transform(text.chain_values(chain), lambda v: v.cast("bigint").cast("string")), "|").alias("chain")
    )


@query("select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


_WORDS = "(^|[^\\p{L}\\p{M}\\p{N}_])"
_GATE = f"""case when t in ('best_under_constraint', 'threshold_filter') then not regexp_matches(lower(question), '{_WORDS}(while|under|at least|at most|below|above|exceed|exceeds|less than|greater than|no more than|no less than)([^\\p{{L}}\\p{{M}}\\p{{N}}_]|$)')
    when t = 'tradeoff_summary' then not regexp_matches(lower(question), '{_WORDS}(pareto|trade-?off|optimal|optimize|optimise|maxim|minim)([^\\p{{L}}\\p{{M}}\\p{{N}}_]|$)') else true end"""


@query(
    f"select rec_id, {_GATE} as fires from (select rec_id, coalesce(question, '') as question, metadata.spec.type as t from realtable_eval_verified)"
)
def safety_gate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "realtable_eval_verified").select("rec_id", text.gate_fires(F.col("metadata.spec.type"), F.col("question")).alias("fires"))


@query("select o_orderkey, case o_orderkey % 4 when 0 then 'gte' when 1 then 'lt' when 2 then 'gte' end as op from orders")
def canon_op(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey") % 4
    return table(spark, d, "orders").select(
        "o_orderkey",
        text.canonical_op(F.when(k == 0, "ge").when(k == 1, "lt").when(k == 2, "gte").otherwise("le")).alias("op")
    )


@query(
    "select p_partkey, printf('%g', p_retailprice * 1000) as big, printf('%g', p_retailprice / 1000000000) as small, printf('%g', -cast(p_size as double)) as whole from part"
)
def render_number(spark: SparkSession, d: str) -> DataFrame:
    g = text.general_format
    return _part(spark, d).select(
        "p_partkey",
        g(F.col("p_retailprice") * 1000).alias("big"),
        g(F.col("p_retailprice") / 1e9).alias("small"),
        g(-F.col("p_size").cast("double")).alias("whole")
    )
