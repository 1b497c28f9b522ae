"""Queries of the grid cleaning over the tables of the question records, with their header as the first row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwise.functions.text import cell_number, is_year, strip
from cellwise.operators import grid
from cellwise.session import table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _grids(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "realtable_eval_verified").where("table.headers is not null and table.rows is not null")
    return t.select(F.col("rec_id").alias("table_id"), F.concat(F.array("table.headers"), "table.rows").alias("grid"))


def _long(spark: SparkSession, d: str) -> DataFrame:
    return grid.cells(_grids(spark, d), "table_id", "grid")


def _profile(spark: SparkSession, d: str) -> DataFrame:
    return grid.row_profile(_long(spark, d))


_NUM = r"try_cast(nullif(regexp_extract(regexp_replace(regexp_replace(regexp_replace(regexp_replace(raw, '[$%]', '', 'g'), '^\s+|\s+$|,', '', 'g'), '^\(\s*(.*?)\s*\)$', '-\1'), '^--', ''), '^-?[0-9]+(\.[0-9]+)?$'), '') as double)"
_STRIPPED = r"regexp_replace(regexp_replace(coalesce(raw, ''), '[$%]', '', 'g'), '^\s+|\s+$', '', 'g')"
_MISSING = rf"({_STRIPPED} = '' or regexp_matches({_STRIPPED}, '^([-‒–—―�*\s]+|[nN]/[aA]|[nN][aA]|[nN]\.[aA]\.?|[nN][mM]|[nN][iI][lL])$'))"
_CELLS = f"""g as (select rec_id as table_id, list_prepend("table".headers, "table".rows) as grid from realtable_eval_verified where "table".headers is not null and "table".rows is not null),
    l as (select table_id, generate_subscripts(grid, 1) - 1 as row, unnest(grid) as cells from g),
    c as (select table_id, cast(row as integer) as row, cast(generate_subscripts(cells, 1) - 1 as integer) as col, unnest(cells) as raw from l),
    p as (select *, {_NUM} as num, {_MISSING} as missing from c)"""
_PROFILE = _CELLS + r""",
    a as (select table_id, row, coalesce(max(case when col = 0 then regexp_replace(raw, '^\s+|\s+$', '', 'g') end), '') as label, count(*) filter (col >= 1 and not missing) as n_values,
        count(*) filter (col >= 1 and not missing and num is not null) as n_numbers, count(*) filter (col >= 1 and not missing and num = floor(num) and num between 1900 and 2099) as n_years,
        count(*) filter (col >= 1 and not missing and num is null) as n_texts, count(*) filter (col >= 1 and not missing and num is not null and not (num = floor(num) and num between 1900 and 2099)) as n_real,
        count(*) filter (col >= 1 and not missing and regexp_matches(trim(raw), '^(19|20)[0-9]{2}([^0-9A-Za-z_]|$)')) as n_year_like from p group by 1, 2),
    b as (select *, coalesce(max(case when n_numbers > 0 then 1 else 0 end) over (partition by table_id order by row rows between 1 following and unbounded following), 0) = 1 as later, n_values > 0 and n_year_like = n_values as year_header from a),
    h as (select *, case when n_values = 0 then false when year_header then true when n_real = 0 and later and (n_years >= 2 or (n_years >= 1 and n_texts >= 1)) then true else n_numbers / n_values < 0.5 and later end as head from b),
    f as (select *, min(case when label <> '' and n_values > 0 then row end) over (partition by table_id) as first_row from h),
    s as (select table_id, max(row) + 1 as n_rows, coalesce(min(case when row >= first_row and not head then row end), max(row) + 1) as start from f group by 1)"""


@query(f"with {_PROFILE} select table_id, row, year_header from b")
def year_header(spark: SparkSession, d: str) -> DataFrame:
    return _profile(spark, d).select("table_id", "row", "year_header")


@query(f"with {_PROFILE} select table_id, row, head from h")
def header_like_rows(spark: SparkSession, d: str) -> DataFrame:
    return _profile(spark, d).select("table_id", "row", grid.header_like().alias("head"))


@query(f"with {_PROFILE} select table_id, n_rows, start from s")
def split_header_body(spark: SparkSession, d: str) -> DataFrame:
    return grid.body_start(_profile(spark, d))


@query(
    f"with {_PROFILE} select h.table_id, h.row, h.label from h join s on h.table_id = s.table_id where row >= start and n_values > 0 and (label <> '' or n_real > 0)"
)
def drop_section_rows(spark: SparkSession, d: str) -> DataFrame:
    p = _profile(spark, d)
    return grid.body_rows(p, grid.body_start(p)).select("table_id", "row", "label")


@query(f"with {_PROFILE} select table_id, row from a where n_real = 0 and n_years >= 2")
def header_leak(spark: SparkSession, d: str) -> DataFrame:
    """Rows without a real magnitude but with two years: headers that leaked into a body."""
    return _profile(spark, d).where("n_real = 0 and n_years >= 2").select("table_id", "row")


_BODY = """w as (select table_id, count(distinct col) as n_cols from c group by 1),
    x as (select p.*, s.start, h.n_values, h.label, h.n_real, w.n_cols from p join s using (table_id) join h on h.table_id = p.table_id and h.row = p.row join w on w.table_id = p.table_id),
    na as (select k.table_id, k.col, coalesce(name, case when k.col = 0 then 'category' else concat('col_', k.col) end) as name from (select distinct table_id, col from c) k left join
        (select table_id, col, nullif(string_agg(nullif(regexp_replace(coalesce(raw, ''), '^\\s+|\\s+$', '', 'g'), ''), ' ' order by row), '') as name from x where row < start and not (n_values <= 1 and n_cols > 2) group by 1, 2) y on y.table_id = k.table_id and y.col = k.col),
    hd as (select table_id, col, case when k > 0 then concat(name, '_', k) else name end as name from (select *, row_number() over (partition by table_id, name order by col) - 1 as k from na)),
    bo as (select * from x where row >= start and n_values > 0 and (label <> '' or n_real > 0)),
    ty as (select table_id, col, bool_and(num is not null) and count(*) > 0 as allnum from bo where not missing and col > 0 group by 1, 2)"""


@query(f"with {_PROFILE}, {_BODY} select table_id, col, name from hd")
def compose_headers(spark: SparkSession, d: str) -> DataFrame:
    """The column names from all header rows of each table, in the long form."""
    long = _long(spark, d)
    profile = grid.row_profile(long)
    return grid.headers(long, profile, grid.body_start(profile))


@query("""select o_custkey, array_to_string(list_transform(rows, lambda r: array_to_string(list_concat(r, list_transform(range(cast(w - len(r) as bigint)), lambda x: '')), ',')), ';') as rows from (select *, list_max(list_transform(rows, lambda r: len(r))) as w
    from (select o_custkey, list(list_transform(range(1 + o_orderkey % 3), lambda x: cast(o_orderkey as varchar)) order by o_orderkey) as rows from orders group by 1))""")
def rectangularize(spark: SparkSession, d: str) -> DataFrame:
    one = F.array_repeat(F.col("o_orderkey").cast("string"), (1 + F.col("o_orderkey") % 3).cast("int"))
    ragged = table(spark, d, "orders").groupBy("o_custkey").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", one.alias("r")))), lambda x: x["r"]).alias("rows")
    )
    return grid.rectangular(ragged, "rows").select("o_custkey", F.array_join(F.transform("rows", lambda r: F.array_join(r, ",")), ";").alias("rows"))


@query(
    "select p_partkey, case when k > 1 then concat(p_name, ' (', k, ')') else p_name end as label from (select *, row_number() over (partition by p_name order by p_partkey) as k from part)"
)
def dedup_labels(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").withColumn("t", F.lit(1))
    return p.select("p_partkey", grid.distinct_labels(p, "t", "p_partkey", "p_name").alias("label"))


@query("select p_name, count(*) as n from part where trim(p_name) <> '' group by 1 having count(*) > 1")
def duplicate_labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").where(strip(F.col("p_name")) != "").groupBy("p_name").agg(F.count("*").alias("n")).where("n > 1")


@query(f"""with {_CELLS}, b as (select * from p where row >= 1), t as (select table_id, col, bool_and(num is not null) as allnum, count(distinct regexp_replace(raw, '^\\s+|\\s+$', '', 'g')) as d, count(*) as n from b where not missing group by 1, 2)
    select k.table_id, k.col, case when k.col = 0 then 'categorical' when coalesce(allnum, false) then 'numeric' when d <= greatest(2, n // 2) then 'categorical' else 'text' end as type from (select distinct table_id, col from b) k left join t on k.table_id = t.table_id and k.col = t.col""")
def infer_types(spark: SparkSession, d: str) -> DataFrame:
    return grid.column_types(_long(spark, d).where("row >= 1"))


@query(f"""with {_PROFILE}, body as (select h.table_id, h.row from h join s on h.table_id = s.table_id where row >= start and n_values > 0 and (label <> '' or n_real > 0)),
    nb as (select table_id, count(*) as n from body group by 1), m as (select table_id, count(*) as n from (select p.table_id, p.col from p join body on p.table_id = body.table_id and p.row = body.row where not missing and col > 0 group by 1, 2 having bool_and(num is not null)) group by 1),
    r as (select table_id, count(distinct len(cells)) > 1 as ragged from l group by 1)
    select s.table_id, case when start = 0 or coalesce(nb.n, 0) < 2 or coalesce(m.n, 0) < 1 or r.ragged then 'low' else 'high' end as confidence from s left join nb using (table_id) left join m using (table_id) left join r using (table_id)""")
def ingest_confidence(spark: SparkSession, d: str) -> DataFrame:
    return grid.ingest_records(_grids(spark, d), "table_id", "grid").select("table_id", "confidence")


@query(f"""with {_PROFILE}, {_BODY}, su as (select table_id, string_agg(regexp_replace(raw, '^\\s+|\\s+$', '', 'g'), '|' order by row, col) as super from x where row < start and n_values <= 1 and n_cols > 2 and regexp_replace(coalesce(raw, ''), '^\\s+|\\s+$', '', 'g') <> '' group by 1),
    hs as (select table_id, string_agg(name, '|' order by col) as headers from hd group by 1), ms as (select hd.table_id, string_agg(name, '|' order by hd.col) as metrics from hd join ty on ty.table_id = hd.table_id and ty.col = hd.col where allnum group by 1),
    nb as (select table_id, count(*) filter (col = 0) as n_body from bo group by 1), nl as (select table_id, count(*) as n_below from h join s using (table_id) where row >= start group by 1),
    rg as (select l.table_id, count_if(len(cells) <> n_cols) as n_ragged from l join s using (table_id) join w using (table_id) where l.row >= start group by 1),
    rp as (select table_id, sum(n - 1)::bigint as n_repeated from (select table_id, label, count(*) as n from bo where col = 0 and label <> '' group by 1, 2) group by 1)
    select g.table_id, cast(s.start as integer) as start, hs.headers, coalesce(metrics, '') as metrics, coalesce(super, '') as super, cast(coalesce(n_body, 0) as integer) as n_rows,
        concat_ws('; ', case when s.start = 0 then 'no header rows' end, case when n_ragged > 0 then concat(n_ragged, ' ragged rows') end, case when n_below > coalesce(n_body, 0) then concat(n_below - coalesce(n_body, 0), ' section or blank rows dropped') end, case when n_repeated > 0 then concat(n_repeated, ' repeated labels numbered') end) as notes
    from g join s using (table_id) left join hs using (table_id) left join ms using (table_id) left join su using (table_id) left join nb using (table_id) left join nl using (table_id) left join rg using (table_id) left join rp using (table_id)""")
def ingest_tables(spark: SparkSession, d: str) -> DataFrame:
    """Every grid as a clean table: where its body begins, its headers, measures and super-headers, its rows and what was mended."""
    t = grid.ingest_records(_grids(spark, d), "table_id", "grid")
    return t.select(
        "table_id",
        "start",
        F.array_join("table.headers", "|").alias("headers"),
        F.array_join("metric_cols", "|").alias("metrics"),
        F.array_join("super_headers", "|").alias("super"),
        F.size("table.rows").alias("n_rows"),
        F.array_join("notes", "; ").alias("notes")
    )


@query(f"with {_CELLS} select table_id, col as row, row as col, raw from c")
def transpose(spark: SparkSession, d: str) -> DataFrame:
    return grid.transpose(_long(spark, d))


@query(
    f"with {_CELLS} select table_id, 'rows' as orientation, row, col, raw from c where row > 0 union all select table_id, 'columns', col, row, raw from c where col > 0"
)
def orientations(spark: SparkSession, d: str) -> DataFrame:
    long = _long(spark, d)
    return long.where("row > 0").select("table_id", F.lit("rows").alias("orientation"), "row", "col", "raw").unionAll(
        grid.transpose(long).where("row > 0").select("table_id", F.lit("columns"), "row", "col", "raw")
    )


@query(
    f"with {_CELLS} select table_id, md5(array_to_string(list_sort(list(regexp_replace(coalesce(raw, ''), '^\\s+|\\s+$', '', 'g'))), '|')) as sig from c group by 1"
)
def content_sig(spark: SparkSession, d: str) -> DataFrame:
    return grid.content_signature(_long(spark, d))


@query(
    f"with {_CELLS} select table_id, count(*) filter (not missing and num is not null) as n_numbers, round(coalesce(sum(num) filter (not missing), 0), 2) as total from p group by 1"
)
def cell_totals(spark: SparkSession, d: str) -> DataFrame:
    v = _long(spark, d).withColumn("num", cell_number(F.col("raw")))
    return v.groupBy("table_id").agg(F.count("num").alias("n_numbers"), F.round(F.coalesce(F.sum("num"), F.lit(0.0)), 2).alias("total"))


@query(f"with {_CELLS} select table_id, row, col from p where num = floor(num) and num between 1900 and 2099")
def year_cells(spark: SparkSession, d: str) -> DataFrame:
    return _long(spark, d).where(is_year(cell_number(F.col("raw")))).select("table_id", "row", "col")
