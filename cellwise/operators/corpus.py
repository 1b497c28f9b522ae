"""Operations over a corpus of many small tables: answers with their evidence, and what is wrong with citations.

The executor explodes the measures that an operation names and works with grouped aggregates and windows per operation.
The validator in ``validator.py`` shares no predicate with it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cellwise.functions.text import cell_number, is_total, let, strip
from cellwise.session import with_columns

EPS = 1e-9
CONDITIONS = "array<struct<metric:string,op:string,t:double>>"
OP = f"struct<type:string,target:string,target_dir:string,constraint:string,op:string,threshold:double,conditions:{CONDITIONS},m1:string,m2:string,d1:string,d2:string,rows:array<int>>"
CELL = "struct<row:int,col:int,col_name:string,value:string>"
DIRECTIONS = ("higher", "lower")
#: So many rows and columns of a table are gathered for its citations; cells beyond them are joined one by one.
NEAR = 64


def engine_error(op: Column, headers: Column) -> Column:
    """Why an operation can't run (unknown type, comparison, direction or column; no threshold), or null."""
    lost = lambda n: ~F.coalesce(F.array_contains(headers, n), F.lit(False))
    bad_op = lambda o: ~F.coalesce(o.isin("lt", "gte", "ge"), F.lit(False))
    bad_dir = lambda d: ~F.coalesce(d.isin(*DIRECTIONS), F.lit(False))
    t, conds = op["type"], op["conditions"]
    best = F.when(
        lost(op["target"]) | lost(op["constraint"]),
        "column"
    ).when(bad_op(op["op"]), "comparison").when(bad_dir(op["target_dir"]), "direction").when(op["threshold"].isNull(), "threshold")
    keep = F.when(conds.isNull(), "conditions").when(F.exists(conds, lambda c: lost(c["metric"])), "column").when(
        F.exists(conds, lambda c: bad_op(c["op"])),
        "comparison"
    ).when(F.exists(conds, lambda c: c["t"].isNull()), "threshold")
    front = F.when(lost(op["m1"]) | lost(op["m2"]), "column").when(bad_dir(op["d1"]) | bad_dir(op["d2"]), "direction")
    top = F.when(lost(op["target"]), "column").when(bad_dir(op["target_dir"]), "direction")
    return F.when(t == "best_under_constraint", best).when(t == "threshold_filter", keep).when(t == "tradeoff_summary", front).when(t == "extremum", top).otherwise("type")


def entity_rows(rows: Column) -> Column:
    """The numbers of a table's rows that stand for entities: those whose first cell is no total."""
    numbered = F.transform(rows, lambda r, i: F.when(~is_total(F.get(r, F.lit(0))), i))
    return F.array_compact(numbered)


def bind_universe(op: Column, rows: Column) -> Column:
    """An operation that ranges over the entities of a table, whatever rows it named."""
    return op.withField("rows", entity_rows(rows))


def row_label(table: Column, row: Column) -> Column:
    """A row's name: its row label, else its cell in the first categorical column, else ``row i``."""
    first = F.array_position(table["column_types"], "categorical")
    cell = F.when(first > 0, F.get(F.get(table["rows"], row), (first - 1).cast("int")))
    return F.coalesce(F.when(F.size(table["row_labels"]) > 0, F.get(table["row_labels"], row)), cell, F.concat(F.lit("row "), row.cast("string")))


def _holds(v: Column, op: Column, t: Column) -> Column:
    return F.when(op == "lt", v < t).otherwise(v >= t)


def execute(
    records: DataFrame,
    key: str,
    headers: str,
    rows: str,
    op: str,
    row_labels: str | None = None,
    keep: Sequence[str] = ()
) -> DataFrame:
    """``key``, ``answer`` (sorted row numbers), ``label``, ``metrics``, ``evidence``, ``error`` for each record's operation on its own table.

    The universe is the operation's ``rows`` (numbers out of range are left aside), or all rows where it names none;
    ``bind_universe`` restricts it to entities beforehand. A measure is the first column of that name. Rows are named by
    ``row_labels`` where a table has them, else by their first cell. The evidence are the cells that the answer was read
    from: for an empty answer, those of the whole universe. Records without table or operation have the error ``type``.
    Keys are unique. Columns of ``records`` named in ``keep`` follow. The numbers that the operations name are shuffled by
    key, the records with the answers once more; nothing is broadcast, whatever size the planner takes the answers for.
    """
    q = F.col("_op")
    no_rows, no_texts = F.array().cast("array<array<string>>"), F.array().cast("array<string>")
    base = records.select(
        F.col(key).alias("_id"),
        F.col(headers).alias("_h"),
        F.coalesce(F.col(rows), no_rows).alias("_rows"),
        F.coalesce(F.col(row_labels) if row_labels else no_texts, no_texts).alias("_names"),
        F.col(op).alias("_op"),
        *keep
    )
    base = base.withColumn("_error", engine_error(q, F.col("_h")))
    place = lambda name: (F.array_position(F.col("_h"), name) - 1).cast("int")
    conds = F.coalesce(q["conditions"], F.array().cast(CONDITIONS))
    lines = base.where("_error is null").select(
        "_id",
        q["type"].alias("_type"),
        q["target_dir"].alias("_dir"),
        q["d1"].alias("_d1"),
        q["d2"].alias("_d2"),
        q["op"].alias("_cmp"),
        q["threshold"].alias("_t"),
        q["rows"].alias("_only"),
        place(F.coalesce(q["target"], q["m1"])).alias("_c1"), place(F.coalesce(q["constraint"], q["m2"])).alias("_c2"),
        F.transform(conds, lambda c: F.named_struct(F.lit("c"), place(c["metric"]), F.lit("op"), c["op"], F.lit("t"), c["t"])).alias("_conds"),
        F.posexplode("_rows").alias("_row", "_cells"),
    )
    num = lambda i: cell_number(F.get(F.col("_cells"), i))
    ok = F.transform("_conds", lambda c: F.coalesce(_holds(num(c["c"]), c["op"], c["t"]), F.lit(False)))
    lines = lines.where(F.col("_only").isNull() | F.array_contains("_only", F.col("_row")))
    lines = lines.select(
        "_id",
        "_type",
        "_row",
        "_dir",
        "_d1",
        "_d2",
        "_cmp",
        "_t",
        num(F.col("_c1")).alias("_v1"),
        num(F.col("_c2")).alias("_v2"),
        ok.alias("_ok")
    )
    kind = F.col("_type")
    eligible = (
        F.when(kind == "best_under_constraint", F.col("_v1").isNotNull() & F.coalesce(_holds(F.col("_v2"), F.col("_cmp"), F.col("_t")), F.lit(False)))
        .when(kind == "extremum", F.col("_v1").isNotNull()).when(
            kind == "threshold_filter",
            F.forall("_ok", lambda x: x)
        ).otherwise(F.col("_v1").isNotNull() & F.col("_v2").isNotNull())
    )
    turn = lambda v, d: F.when(d == "lower", -v).otherwise(v)
    lines = lines.where(eligible).withColumns({"_o1": turn(F.col("_v1"), F.coalesce("_d1", "_dir")), "_o2": turn(F.col("_v2"), F.col("_d2"))})
    best = F.max("_o1").over(Window.partitionBy("_id"))
    reach = lambda x, y: F.expr(f"max({x}) over (partition by _id order by {y} desc range between unbounded preceding and {EPS}D following)")
    lines = lines.withColumns({"_best": best, "_w1": reach("_o2", "_o1"), "_w2": reach("_o1", "_o2")})
    undominated = ~(F.col("_w1") > F.col("_o2") + EPS) & ~(F.col("_w2") > F.col("_o1") + EPS)
    wins = F.when(
        kind.isin("best_under_constraint", "extremum"),
        F.abs(F.col("_o1") - F.col("_best")) <= EPS
    ).when(kind == "threshold_filter", F.lit(True)).otherwise(undominated)
    won = lines.where(wins).groupBy("_id").agg(F.array_sort(F.collect_list("_row")).alias("_won"))
    answer = F.coalesce("_won", F.array().cast("array<int>"))
    done = base.join(won.hint("merge"), "_id", "left").withColumn("_answer", answer)
    name = lambda i: F.coalesce(
        F.when(F.size("_names") > 0, F.get(F.col("_names"), i)).otherwise(F.get(F.get(F.col("_rows"), i), F.lit(0))),
        F.lit("")
    )
    front = q["type"] == "tradeoff_summary"
    label = F.when(
        front,
        F.concat(q["m1"], F.lit(" vs "), q["m2"])
    ).when(F.size("_answer") == 0, "none").otherwise(F.array_join(F.transform("_answer", name), ", "))
    good = F.col("_error").isNull()
    # the cells that were read, row by row; the last column of an empty search alone
    whole = F.when(q["rows"].isNull(), F.transform("_rows", lambda r, i: i)).otherwise(
        F.filter(q["rows"], lambda i: (i >= 0) & (i < F.size("_rows")))
    )
    none = F.size("_answer") == 0
    names = (
        F.when(q["type"] == "best_under_constraint", F.when(none, F.array(q["constraint"])).otherwise(F.array(q["target"], q["constraint"])))
        .when(
            q["type"] == "threshold_filter",
            F.transform(conds, lambda c: c["metric"])
        ).when(front, F.array(q["m1"], q["m2"])).otherwise(F.array(q["target"]))
    )
    read = F.when(none & ~front, whole).otherwise(F.col("_answer"))
    cell = lambda i, n: F.named_struct(
        F.lit("row"),
        i,
        F.lit("col"),
        place(n),
        F.lit("col_name"),
        n,
        F.lit("value"),
        F.coalesce(F.get(F.get(F.col("_rows"), i), place(n)), F.lit(""))
    )
    evidence = F.flatten(F.transform(F.array_distinct(read), lambda i: F.transform(F.array_distinct(names), lambda n: cell(i, n))))
    return done.select(
        F.col("_id").alias(key), F.when(good, F.col("_answer")).alias("answer"), F.when(good, label).alias("label"),
        F.when(good, F.when(front, F.array(q["m1"], q["m2"])).otherwise(no_texts)).alias("metrics"),
        F.when(good, evidence).cast(f"array<{CELL}>").alias("evidence"),
        F.col("_error").alias("error"),
        *keep,
    )


def classify_cites(cites: DataFrame, cells: DataFrame, key: str) -> DataFrame:
    """What is wrong with each citation, in this order: row_oob, colname_mismatch, ok, wrong_row, rounding, type_format, not_in_column.

    ``cites`` has ``key``, ``cite_no``, ``row``, ``col``, ``col_name``, ``value``; ``cells`` has ``key``, ``row``, ``col``,
    ``col_name``, ``txt`` of every cell. A table's first ``NEAR`` rows and columns are gathered with its size, at most
    ``NEAR ** 2`` cells, and joined once by key. Citations of larger tables go through two more equi-joins with the cells
    beyond: the cell itself, and the citation's value among the distinct values of its column, by which another row holds it.
    No column is ever collected and no side is broadcast, whatever size the planner takes it for.
    """
    norm = lambda c: let(cell_number(c), lambda n: F.coalesce(n.cast("string"), strip(F.coalesce(c, F.lit("")))))
    near = F.coalesce((F.col("row") < NEAR) & (F.col("col") < NEAR), F.lit(False))
    cell = F.struct("row", "col", F.col("col_name").alias("name"), "txt")
    # the cells are gathered alike for small and large tables, so that their exchange is used twice
    tables = cells.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.max("row").alias("_last"),
        F.max("col").alias("_wide"),
        F.collect_list(F.when(near, cell)).alias("_near")
    )
    tables = with_columns(tables, _norms=F.transform("_near", lambda c: F.struct(c["col"].alias("col"), norm(c["txt"]).alias("norm"))))
    j = with_columns(cites, _norm=norm(F.col("value"))).join(tables.hint("merge"), key, "left")
    j = j.select(
        key,
        "cite_no",
        "row",
        "col",
        "col_name",
        "value",
        "_norm",
        "_last",
        "_wide",
        F.exists("_norms", lambda c: (c["col"] == F.col("col")) & (c["norm"] == F.col("_norm"))).alias("_held"),
        F.explode_outer(F.filter("_near", lambda c: (c["row"] == F.col("row")) & (c["col"] == F.col("col")))).alias("_own")
    )
    far = cells.where(~near)
    values = far.select(key, "col", norm(F.col("txt")).alias("_norm")).distinct().withColumn("_beyond", F.lit(True))
    own = far.select(key, "row", "col", F.col("col_name").alias("_name"), F.col("txt").alias("_cell"))
    large = F.coalesce((F.col("_last") >= NEAR) | (F.col("_wide") >= NEAR), F.lit(False))
    more = j.where(large).join(values.hint("merge"), [key, "col", "_norm"], "left").join(own.hint("merge"), [key, "row", "col"], "left")
    found = F.col("_own").isNotNull()
    name, txt = (F.when(found, F.col(f"_own.{f}")).otherwise(F.col(c)) for f, c in (("name", "_name"), ("txt", "_cell")))
    told = [key, "cite_no", "row", "col", "col_name", "value", "_norm", "_last", "_wide"]
    j = j.where(~large).select(*told, "_held", F.col("_own.name").alias("_name"), F.col("_own.txt").alias("_cell")).union(
        more.select(*told, F.col("_held") | F.col("_beyond").isNotNull(), name, txt)
    )
    j = with_columns(j, _a=cell_number(F.col("value")), _b=cell_number(F.col("_cell")))
    a, b = F.col("_a"), F.col("_b")
    inside = F.coalesce(F.col("row").between(0, F.col("_last")) & F.col("col").between(0, F.col("_wide")), F.lit(False))
    same = F.when(a.isNotNull() & b.isNotNull(), F.abs(a - b) <= 1e-6).otherwise(F.col("_norm") == norm(F.col("_cell")))
    close = F.coalesce(F.abs(a - b) / F.greatest(F.abs(b), F.lit(1.0)) <= 5e-3, F.lit(False))
    label = (
        F.when(~inside, "row_oob").when(~F.coalesce(F.col("_name") == F.col("col_name"), F.lit(False)), "colname_mismatch").when(same, "ok")
        .when(F.coalesce("_held", F.lit(False)), "wrong_row").when(close, "rounding").when(a.isNull() != b.isNull(), "type_format").otherwise("not_in_column")
    )
    return j.select(key, "cite_no", label.alias("label"))


def classify_within(records: DataFrame, key: str, headers: str, rows: str, cites: str) -> DataFrame:
    """As ``classify_cites`` for tables that lie in the same record as their citations, an array of cells: nothing is shuffled.

    For small tables; each citation looks through its column. Null citations give no row, ``cite_no`` is their place.
    """
    norm = lambda c: let(cell_number(c), lambda n: F.coalesce(n.cast("string"), strip(F.coalesce(c, F.lit("")))))
    r = records.select(
        F.col(key).alias("_k"),
        F.col(headers).alias("_h"),
        F.col(rows).alias("_rows"),
        F.col(cites).alias("_c")
    ).where(F.size("_c") > 0)
    r = with_columns(r, _norm=F.transform("_rows", lambda row: F.transform(row, norm)), _wide=F.array_max(F.transform("_rows", F.size)))

    def label(c: Column) -> Column:
        at = lambda grid: F.get(F.get(grid, c["row"]), c["col"])
        own, said = F.coalesce(at("_norm"), F.lit("")), norm(c["value"])
        inside = F.coalesce(
            (c["row"] >= 0) & (c["row"] < F.size("_rows")) & (c["col"] >= 0) & (
                c["col"] < F.least(F.size("_h"), F.col("_wide"))
            ) & (c["col"] < F.size(F.get("_rows", c["row"]))),
            F.lit(False)
        )
        number = lambda t: F.when(t.rlike("^-?[0-9.]+(E-?[0-9]+)?$") & (t != "."), t).try_cast("double")

        def judged(x: Column) -> Column:
            a, b = x["a"], x["b"]
            same = F.when(a.isNotNull() & b.isNotNull(), F.abs(a - b) <= 1e-6).otherwise(x["said"] == x["own"])
            near = F.coalesce(F.abs(a - b) / F.greatest(F.abs(b), F.lit(1.0)) <= 5e-3, F.lit(False))
            held = F.exists("_norm", lambda row: F.coalesce(F.get(row, c["col"]) == x["said"], F.lit(False)))
            wrong = F.when(held, "wrong_row").when(near, "rounding").when(a.isNull() != b.isNull(), "type_format").otherwise("not_in_column")
            return F.when(~inside, "row_oob").when(
                ~F.coalesce(F.get("_h", c["col"]) == c["col_name"], F.lit(False)),
                "colname_mismatch"
            ).when(same, "ok").otherwise(wrong)

        return let(F.struct(number(said).alias("a"), number(own).alias("b"), said.alias("said"), own.alias("own")), judged)

    labelled = F.transform("_c", lambda c: F.when(c.isNotNull(), label(c)))
    return r.select(
        "_k",
        F.posexplode(labelled).alias("cite_no", "label")
    ).where("label is not null").select(F.col("_k").alias(key), "cite_no", "label")
