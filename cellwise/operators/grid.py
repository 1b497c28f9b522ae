"""Messy grids as clean tables: header detection, cleaning and typing over the long form of many small tables.

The long form has a row for each cell: ``table_id``, ``row``, ``col``, ``raw``. All steps are grouped aggregates and
windows per table, so that one job cleans any number of tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cellwise.functions.text import cell_number, is_missing, is_year, let, parse_cell, strip
from cellwise.session import materialize, with_columns


def cells(grids: DataFrame, table_id: str, rows: str) -> DataFrame:
    """The long form of a column of grids (arrays of rows of texts); null grids and rows give no cells.

    The compact grids are partitioned by table once, before they are exploded; the grouped steps and windows that follow
    all have the table in their keys and need no further exchange.
    """
    by_table = grids.select(F.col(table_id).alias("table_id"), F.col(rows).alias("_rows")).repartition("table_id")
    lines = by_table.select("table_id", F.posexplode("_rows").alias("row", "_cells"))
    return lines.select("table_id", "row", F.posexplode("_cells").alias("col", "raw"))


def rectangular(grids: DataFrame, rows: str, out: str = "rows") -> DataFrame:
    """Every row padded with empty texts, or cut, to the width of the widest."""
    width = F.aggregate(F.col(rows), F.lit(0), lambda w, r: F.greatest(w, F.coalesce(F.size(r), F.lit(0))))
    return grids.withColumn("_width", width).withColumn(
        out,
        F.transform(
            F.col(rows),
            lambda r: F.slice(
                F.concat(F.coalesce(r, F.array().cast("array<string>")), F.array_repeat(F.lit(""), F.col("_width"))),
                1,
                F.col("_width")
            )
        )
    ).drop("_width")


def values(long: DataFrame) -> DataFrame:
    """``long`` with ``_num``, the number a cell writes, and ``_missing``; only cells that are no number are looked at twice."""
    return long.withColumn("_num", cell_number(F.col("raw"))).withColumn(
        "_missing",
        F.when(F.col("_num").isNotNull(), False).otherwise(F.coalesce(is_missing(F.col("raw")), F.lit(True)))
    )


def row_profile(long: DataFrame) -> DataFrame:
    """Per row: its ``label``, how many values it has, how many are numbers, years or neither, and what follows it."""
    v = values(long).withColumn("_value", (F.col("col") >= 1) & ~F.col("_missing"))
    count = lambda c: F.count_if(F.col("_value") & c)
    num = F.col("_num")
    year = F.coalesce(is_year(num), F.lit(False))
    like = F.col("raw").rlike(r"(?U)^\s*(19|20)[0-9]{2}\b")
    per = v.groupBy("table_id", "row").agg(
        F.coalesce(F.max(F.when(F.col("col") == 0, strip(F.col("raw")))), F.lit("")).alias("label"),
        count(F.lit(True)).alias("n_values"),
        count(num.isNotNull()).alias("n_numbers"),
        count(year).alias("n_years"),
        count(num.isNull()).alias("n_texts"),
        count(num.isNotNull() & ~year).alias("n_real"),
        count(like).alias("n_year_like"),
    )
    after = Window.partitionBy("table_id").orderBy("row").rowsBetween(1, Window.unboundedFollowing)
    return per.withColumn(
        "later_number",
        F.coalesce(F.max((F.col("n_numbers") > 0)).over(after), F.lit(False))
    ).withColumn("year_header", (F.col("n_values") > 0) & (F.col("n_year_like") == F.col("n_values")))


def header_like() -> Column:
    """Whether a profiled row reads as a header."""
    years = (F.col("n_real") == 0) & F.col("later_number") & ((F.col("n_years") >= 2) | ((F.col("n_years") >= 1) & (F.col("n_texts") >= 1)))
    few = (F.col("n_numbers") / F.col("n_values") < 0.5) & F.col("later_number")
    return F.when(F.col("n_values") == 0, False).when(F.col("year_header"), True).when(years, True).otherwise(F.coalesce(few, F.lit(False)))


def body_start(profile: DataFrame) -> DataFrame:
    """``table_id``, ``n_rows``, ``start``: where the body begins; ``n_rows`` where there is none.

    The first row with a label and a value starts it; header-like rows from there on, as far as they are contiguous, still
    belong to the header.
    """
    p = profile.withColumn("_head", header_like())
    w = Window.partitionBy("table_id")
    first = F.min(F.when((F.col("label") != "") & (F.col("n_values") > 0), F.col("row"))).over(w)
    p = p.withColumn("_first", first)
    return p.groupBy("table_id").agg(
        (F.max("row") + 1).alias("n_rows"),
        F.min(F.when((F.col("row") >= F.col("_first")) & ~F.col("_head"), F.col("row"))).alias("_s")
    ).select("table_id", "n_rows", F.coalesce("_s", "n_rows").alias("start"))


def headers(long: DataFrame, profile: DataFrame, starts: DataFrame) -> DataFrame:
    """``table_id``, ``col``, ``name``: the header rows' texts joined per column; blanks named, repeats numbered.

    A header row with at most one value in a table of more than two columns is a super-header and names no column.
    """
    wide = long.groupBy("table_id").agg(F.count_distinct("col").alias("_n_cols"))
    head = long.join(starts.select("table_id", "start"), "table_id").where("row < start").join(
        profile.select("table_id", "row", "n_values"),
        ["table_id", "row"]
    ).join(wide, "table_id")
    used = head.where("not (n_values <= 1 and _n_cols > 2)").withColumn("_t", strip(F.coalesce("raw", F.lit(""))))
    named = used.where("_t <> ''").groupBy("table_id", "col").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "_t"))), lambda x: x["_t"]), " ").alias("_name")
    )
    every = long.select("table_id", "col").distinct().join(named, ["table_id", "col"], "left")
    every = every.withColumn(
        "_name",
        F.coalesce("_name", F.when(F.col("col") == 0, "category").otherwise(F.concat(F.lit("col_"), F.col("col").cast("string"))))
    )
    k = F.row_number().over(Window.partitionBy("table_id", "_name").orderBy("col")) - 1
    return every.withColumn("_k", k).select(
        "table_id",
        "col",
        F.when(F.col("_k") > 0, F.concat("_name", F.lit("_"), F.col("_k").cast("string"))).otherwise(F.col("_name")).alias("name")
    )


def body_rows(profile: DataFrame, starts: DataFrame) -> DataFrame:
    """The profiled rows of the body without sections and blank rows: those with a value, and with a label or a real number."""
    return profile.join(starts.select("table_id", "start"), "table_id").where(
        "row >= start and n_values > 0 and (label <> '' or n_real > 0)"
    ).drop("start")


def distinct_labels(rows: DataFrame, table_id: str, row: str, label: str) -> Column:
    """The row's label; from its second occurrence on with its number. Empty labels stay empty."""
    name = strip(F.col(label))
    k = F.row_number().over(Window.partitionBy(table_id, name).orderBy(row))
    return F.when((name != "") & (k > 1), F.concat(name, F.lit(" ("), k.cast("string"), F.lit(")"))).otherwise(name)


def column_types(long: DataFrame) -> DataFrame:
    """``table_id``, ``col``, ``type``: numeric, categorical or text; the first column is categorical."""
    p = values(long).where("not _missing")
    texts = F.when(F.col("_num").isNull(), 1).otherwise(0)
    per = p.groupBy("table_id", "col").agg(
        (F.sum(texts) == 0).alias("_num"),
        F.size(F.collect_set(strip(F.col("raw")))).alias("_d"),
        F.count("*").alias("_n")
    )
    every = long.select("table_id", "col").distinct().join(per, ["table_id", "col"], "left")
    kind = F.when(F.col("col") == 0, "categorical").when(F.coalesce("_num", F.lit(False)), "numeric").when(
        F.col("_d") <= F.greatest(F.lit(2), F.floor(F.col("_n") / 2)),
        "categorical"
    ).otherwise("text")
    return every.select("table_id", "col", kind.alias("type"))


def confidence(starts: DataFrame, body: DataFrame, types: DataFrame, ragged: DataFrame) -> DataFrame:
    """``table_id``, ``confidence``: low without header rows, with fewer than two body rows, without a measure, or ragged."""
    n = body.groupBy("table_id").agg(F.count("*").alias("_rows"))
    m = types.where("type = 'numeric'").groupBy("table_id").agg(F.count("*").alias("_metrics"))
    low = (F.col("start") == 0) | (F.coalesce("_rows", F.lit(0)) < 2) | (F.coalesce("_metrics", F.lit(0)) < 1) | F.coalesce("ragged", F.lit(False))
    return starts.join(n, "table_id", "left").join(m, "table_id", "left").join(ragged, "table_id", "left").select(
        "table_id",
        F.when(low, "low").otherwise("high").alias("confidence")
    )


def transpose(long: DataFrame) -> DataFrame:
    """The long form with rows and columns exchanged."""
    return long.select(
        "table_id",
        F.col("col").alias("row"),
        F.col("row").alias("col"),
        *(c for c in long.columns if c not in ("table_id", "row", "col"))
    )


def transposed(table: Column) -> Column:
    """A table (headers, rows, row labels, column types) with rows and columns exchanged; null if it then has no numeric column.

    The old headers become the first column, the old first column the headers: blank ones are named ``period``, repeated
    ones numbered. Types are inferred again, the first column is categorical.
    """
    none = F.array().cast("array<string>")
    heads, rows = table["headers"], table["rows"]
    raw = F.concat(F.slice(heads, 1, 1), F.transform(rows, lambda r: F.coalesce(F.get(r, F.lit(0)), F.lit(""))))
    named = F.transform(raw, lambda h: F.when(strip(F.coalesce(h, F.lit(""))) == "", "period").otherwise(h))
    count = lambda names, i, h: F.size(F.filter(F.slice(names, F.lit(1), i), lambda x: x == h))
    single = F.transform(
        named,
        lambda h, i: F.when(i == 0, h).when(count(named, i, h) > 0, F.concat(h, F.lit("_"), count(named, i, h).cast("string"))).otherwise(h)
    )
    body = F.transform(
        F.sequence(F.lit(1), F.size(heads) - 1),
        lambda c: F.concat(F.array(F.get(heads, c)), F.transform(rows, lambda r: F.coalesce(F.get(r, c), F.lit(""))))
    )
    types = F.concat(
        F.array(F.lit("categorical")),
        F.transform(rows, lambda r: value_type(F.slice(r, F.lit(2), F.greatest(F.size(r) - 1, F.lit(0)))))
    )
    out = F.struct(single.alias("headers"), body.alias("rows"), F.lit(None).cast("array<string>").alias("row_labels"), types.alias("column_types"))
    return F.when((F.size(rows) > 0) & (F.size(heads) >= 2) & F.array_contains(types, "numeric"), out)


def artifacts(tables: DataFrame, table_id: str, rows: str) -> DataFrame:
    """One row: ``n_tables``, ``n_header_leak``, ``n_duplicate_labels``, ``clean``; tables without rows don't count, a repeated id counts once.

    A row of years alone, two at least, is a header that leaked into the body.
    """
    t = tables.where(F.size(rows) > 0).dropDuplicates([table_id])
    # a text of years is a number that can be one; empty cells take no part
    values = lambda r: F.filter(
        F.transform(
            F.slice(r, F.lit(2), F.greatest(F.size(r) - 1, F.lit(0))),
            lambda c: F.struct(cell_number(c).alias("n"), strip(F.coalesce(c, F.lit(""))).alias("t"))
        ),
        lambda x: x["t"] != ""
    )
    year = lambda x: F.coalesce(is_year(x["n"]), F.lit(False))
    leak = lambda v: (F.size(v) > 0) & ~F.exists(v, lambda x: x["n"].isNotNull() & ~year(x)) & (F.size(F.filter(v, year)) >= 2)
    labels = F.filter(F.transform(rows, lambda r: strip(F.coalesce(F.get(r, F.lit(0)), F.lit("")))), lambda x: x != "")
    one = t.select(F.exists(F.transform(rows, values), leak).alias("leak"), (F.size(labels) > F.size(F.array_distinct(labels))).alias("twice"))
    n = one.agg(F.count("*").alias("n_tables"), F.count_if("leak").alias("n_header_leak"), F.count_if("twice").alias("n_duplicate_labels"))
    return n.withColumn("clean", F.col("n_header_leak") + F.col("n_duplicate_labels") == 0)


def value_type(cells: Column) -> Column:
    """The type of an array of cells: numeric, categorical or text."""
    known = F.filter(cells, lambda c: ~F.coalesce(is_missing(c), F.lit(True)))
    distinct = F.size(F.array_distinct(F.transform(known, strip)))
    return F.when((F.size(known) > 0) & F.forall(known, lambda c: cell_number(c).isNotNull()), "numeric").when(
        (F.size(known) > 0) & (distinct <= F.greatest(F.lit(2), F.floor(F.size(known) / 2))),
        "categorical"
    ).otherwise("text")


def content_signature(long: DataFrame) -> DataFrame:
    """``table_id``, ``sig``: a digest of a table's texts that rows and columns in another order don't change."""
    return long.groupBy("table_id").agg(F.md5(F.array_join(F.array_sort(F.collect_list(strip(F.coalesce("raw", F.lit(""))))), "|")).alias("sig"))


def ingest(grids: DataFrame, table_id: str, rows: str) -> dict[str, DataFrame]:
    """All steps for a column of raw grids: ``headers``, ``rows`` (labels), ``cells`` (typed values), ``types`` and ``tables``."""
    ragged = grids.select(
        F.col(table_id).alias("table_id"),
        (F.size(F.array_distinct(F.transform(F.col(rows), lambda r: F.size(r)))) > 1).alias("ragged")
    )
    long = cells(rectangular(grids, rows, rows), table_id, rows)
    profile = materialize(row_profile(long), "profile")  # a row of counts for each row; read four times below
    starts = body_start(profile)
    body = body_rows(profile, starts)
    labelled = body.withColumn("label", distinct_labels(body, "table_id", "row", "label"))
    kept = long.join(body.select("table_id", "row"), ["table_id", "row"], "left_semi")
    types = column_types(kept)
    return {
        "headers": headers(long, profile, starts),
        "rows": labelled.select("table_id", "row", "label"),
        "cells": kept.withColumn("_p", parse_cell(F.col("raw"))).select("table_id", "row", "col", "_p.kind", "_p.num", "_p.txt"),
        "types": types,
        "tables": confidence(starts, body, types, ragged),
    }


TABLE = "struct<headers:array<string>,rows:array<array<string>>,row_labels:array<string>,column_types:array<string>>"


def _cell(c: Column) -> Column:
    """A cell's text, its number, and whether it writes that there is no value."""
    return let(
        cell_number(c),
        lambda n: F.struct(
            strip(F.coalesce(c, F.lit(""))).alias("t"),
            n.alias("n"),
            F.when(n.isNotNull(), False).otherwise(F.coalesce(is_missing(c), F.lit(True))).alias("m")
        )
    )


def ingest_records(grids: DataFrame, table_id: str, rows: str) -> DataFrame:
    """One clean table for each grid: ``table_id``, ``table``, ``name_col``, ``metric_cols``, ``confidence``, ``notes``, ``super_headers``, ``start``.

    The same rules as ``ingest`` within each record: every cell is read once, and nothing is shuffled. For grids that fit a
    record; a table of any length is cleaned in its long form by ``ingest``. Cells are texts: numbers keep their style,
    markers of missing values are empty. A null grid is an empty one.
    """
    no_rows = F.array().cast("array<array<string>>")
    g = with_columns(grids.select(F.col(table_id).alias("table_id"), F.col(rows).alias("_in")), _raw=F.coalesce("_in", no_rows)).drop("_in")
    g = with_columns(
        g,
        _width=F.aggregate("_raw", F.lit(0), lambda w, r: F.greatest(w, F.coalesce(F.size(r), F.lit(0)))),
        _sizes=F.transform("_raw", lambda r: F.coalesce(F.size(r), F.lit(0)))
    )
    square = F.transform(
        "_raw",
        lambda r: F.slice(
            F.concat(F.coalesce(r, F.array().cast("array<string>")), F.array_repeat(F.lit(""), F.col("_width"))),
            F.lit(1),
            F.col("_width")
        )
    )
    g = with_columns(g, _cells=F.transform(square, lambda r: F.transform(r, _cell)))
    year = lambda x: F.coalesce(is_year(x["n"]), F.lit(False))
    values = lambda r: F.filter(F.slice(r, F.lit(2), F.greatest(F.size(r) - 1, F.lit(0))), lambda x: ~x["m"])
    count = lambda v, f: F.size(F.filter(v, f))
    profile = lambda r, v: F.struct(
        F.coalesce(F.get(r, F.lit(0))["t"], F.lit("")).alias("label"),
        F.size(v).alias("n"),
        count(v, lambda x: x["n"].isNotNull()).alias("numbers"),
        count(v, year).alias("years"),
        count(v, lambda x: x["n"].isNotNull() & ~year(x)).alias("real"), count(v, lambda x: x["t"].rlike(r"^(19|20)[0-9]{2}\b")).alias("like"),
    )
    g = with_columns(g, _values=F.transform("_cells", values))
    g = with_columns(g, _p=F.zip_with("_cells", "_values", profile))
    g = with_columns(g, _last=F.coalesce(F.array_max(F.transform("_p", lambda p, i: F.when(p["numbers"] > 0, i))), F.lit(-1)))
    later = lambda i: F.col("_last") > i
    texts = lambda p: p["n"] - p["numbers"]
    years = lambda p, i: (p["real"] == 0) & later(i) & ((p["years"] >= 2) | ((p["years"] >= 1) & (texts(p) >= 1)))
    head = lambda p, i: F.when(p["n"] == 0, False).when(p["like"] == p["n"], True).when(years(p, i), True).otherwise(
        (p["numbers"] / p["n"] < 0.5) & later(i)
    )
    first = F.array_min(F.transform("_p", lambda p, i: F.when((p["label"] != "") & (p["n"] > 0), i)))
    g = with_columns(g, _heads=F.transform("_p", head), _first=first)
    g = with_columns(g, start=F.coalesce(F.array_min(F.transform("_heads", lambda h, i: F.when((i >= F.col("_first")) & ~h, i))), F.size("_raw")))
    lines = F.arrays_zip(F.col("_cells").alias("c"), F.col("_p").alias("p"), F.col("_sizes").alias("s"))
    above, below = F.slice(lines, F.lit(1), F.col("start")), F.slice(lines, F.col("start") + 1, F.size("_raw"))
    g = with_columns(g, _above=above, _below=below)
    over = lambda x: (x["p"]["n"] <= 1) & (F.col("_width") > 2)
    named = lambda j: F.array_join(
        F.filter(F.transform(F.filter("_above", lambda x: ~over(x)), lambda x: F.get(x["c"], j)["t"]), lambda t: t != ""),
        " "
    )
    columns = F.when(F.col("_width") > 0, F.sequence(F.lit(0), F.col("_width") - 1)).otherwise(F.array().cast("array<int>"))
    blank = lambda j: F.when(j == 0, "category").otherwise(F.concat(F.lit("col_"), j.cast("string")))
    g = with_columns(
        g,
        _names=F.transform(columns, lambda j: F.coalesce(F.nullif(named(j), F.lit("")), blank(j))),
        _super=F.flatten(F.transform(F.filter("_above", over), lambda x: F.filter(F.transform(x["c"], lambda c: c["t"]), lambda t: t != "")))
    )
    kept = F.filter("_below", lambda x: (x["p"]["n"] > 0) & ((x["p"]["label"] != "") | (x["p"]["real"] > 0)))
    g = with_columns(g, _kept=kept)
    numbered = lambda names, h, i: F.size(F.filter(F.slice(names, F.lit(1), i), lambda x: x == h))
    one = lambda h, i: F.when(i == 0, F.lit(0)).otherwise(numbered(F.col("_names"), h, i))
    g = with_columns(
        g,
        _headers=F.transform("_names", lambda h, i: F.when(one(h, i) > 0, F.concat(h, F.lit("_"), one(h, i).cast("string"))).otherwise(h)),
        _labels=F.transform("_kept", lambda x: x["p"]["label"])
    )
    g = with_columns(g, _nth=F.transform("_labels", lambda h, i: F.when((h == "") | (i == 0), 0).otherwise(numbered(F.col("_labels"), h, i))))
    label = lambda h, k: F.when(k > 0, F.concat(h, F.lit(" ("), (k + 1).cast("string"), F.lit(")"))).otherwise(h)
    g = with_columns(g, _single=F.zip_with("_labels", "_nth", label))
    text = lambda c: F.when(c["m"], "").otherwise(c["t"])
    body = F.zip_with(
        "_kept",
        "_single",
        lambda x, l: F.concat(F.array(l), F.transform(F.slice(x["c"], F.lit(2), F.greatest(F.col("_width") - 1, F.lit(0))), text))
    )
    column = lambda j: F.filter(F.transform("_kept", lambda x: F.get(x["c"], j)), lambda c: ~c["m"])
    kinds = lambda v: F.when((F.size(v) > 0) & F.forall(v, lambda c: c["n"].isNotNull()), "numeric").when(
        (F.size(v) > 0) & (F.size(F.array_distinct(F.transform(v, lambda c: c["t"]))) <= F.greatest(F.lit(2), F.floor(F.size(v) / 2))),
        "categorical"
    ).otherwise("text")
    g = with_columns(g, _body=body, _known=F.transform(columns, column), _ragged=F.size(F.filter("_below", lambda x: x["s"] != F.col("_width"))))
    g = with_columns(g, _types=F.transform("_known", lambda v, j: F.when(j == 0, "categorical").otherwise(kinds(v))))
    g = with_columns(
        g,
        metric_cols=F.transform(
            F.filter(F.arrays_zip(F.col("_headers").alias("h"), F.col("_types").alias("t")), lambda x: x["t"] == "numeric"),
            lambda x: x["h"]
        )
    )
    dropped, repeated = F.size("_below") - F.size("_kept"), F.size(F.filter("_nth", lambda k: k > 0))
    note = lambda n, words: F.when(n > 0, F.concat(n.cast("string"), F.lit(words)))
    notes = F.array_compact(
        F.array(
            F.when(F.col("start") == 0, "no header rows"),
            note(F.col("_ragged"), " ragged rows"),
            note(dropped, " section or blank rows dropped"),
            note(repeated, " repeated labels numbered")
        )
    )
    low = (F.col("start") == 0) | (F.size("_body") < 2) | (F.size("metric_cols") == 0) | (F.col("_ragged") > 0)
    table = F.struct(
        F.col("_headers").alias("headers"),
        F.col("_body").alias("rows"),
        F.lit(None).cast("array<string>").alias("row_labels"),
        F.col("_types").alias("column_types")
    )
    return g.select(
        "table_id",
        table.cast(TABLE).alias("table"),
        F.coalesce(F.get("_headers", F.lit(0)), F.lit("category")).alias("name_col"),
        "metric_cols",
        F.when(low, "low").otherwise("high").alias("confidence"),
        notes.alias("notes"),
        F.col("_super").alias("super_headers"),
        "start"
    )
