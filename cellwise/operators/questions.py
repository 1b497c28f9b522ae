"""Questions over tables with their operation, answer, trace and evidence, built within each record.

A table comes with the measures that can be asked for and the noun of its rows. Draws are digests of seed, table and
purpose. Everything is an expression over the record's own arrays, so that building is a map without a shuffle, whatever
the number of tables. What is built goes through the independent validator before it becomes part of a dataset.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwise.functions.text import cell_number
from cellwise.operators import corpus, generate, grid, validator
from cellwise.session import materialize
from cellwise.session import with_columns as _with
from cellwise.sources.readers import CELL, SPEC

EPS = 1e-9
#: The kinds in the order in which a dataset cycles through them, and the hard modes of each.
KINDS = ("best_under_constraint", "threshold_filter", "tradeoff_summary")
HARD = {"best_under_constraint": ("empty", "near_threshold", "tie"), "threshold_filter": ("empty", "near_threshold"), "tradeoff_summary": ("normal",)}
#: Phrases of the questions.
UNDER, AT_LEAST, TOTALS_NOTE = " under ", " of at least ", " Exclude any total or subtotal rows."

Tables = DataFrame
_INTS = "array<int>"


def _get(a: Column | str, i: Column | int) -> Column:
    return F.get(a, i if isinstance(i, Column) else F.lit(i))


def plain_number(v: Column) -> Column:
    """A number as it is written, without trailing zeros, with up to six decimals."""
    t = v.cast("decimal(32,6)").cast("string")
    return F.regexp_replace(F.regexp_replace(t, r"0+$", ""), r"\.$", "")


def choose_threshold(values: Column, direction: Column, mode: Column, u: Column) -> Column:
    """A threshold for an array of numbers: beyond all, just at one, or between two neighbours of them; never one of them."""
    known = F.array_sort(F.array_distinct(values))
    low, high, n = F.array_min(known), F.array_max(known), F.size(known)
    spread = F.when(high > low, high - low).otherwise(1.0)
    margin, small, down = F.greatest(spread * 0.1, F.lit(0.01)), F.greatest(spread * 0.04, F.lit(0.005)), direction == "lower"
    k = F.floor(u * (n - 1)).cast("int")
    at = _get(known, F.floor(u * n).cast("int"))
    alone = F.when(down, low + margin).otherwise(high - margin)
    t = F.when(mode == "empty", F.when(down, low - margin).otherwise(high + margin)).when(
        mode == "near_threshold",
        F.when(down, at + small).otherwise(at - small)
    ).when(n >= 2, (_get(known, k) + _get(known, k + 1)) / 2).otherwise(alone)
    step = lambda x, _: F.when(F.exists(values, lambda v: F.abs(v - x) <= EPS), F.round(x + 1e-6, 6)).otherwise(x)
    return F.aggregate(F.sequence(F.lit(1), F.lit(8)), F.round(t, 6), step)


def _passes(v: Column, down: Column, t: Column) -> Column:
    return F.coalesce(F.when(down, v < t).otherwise(v >= t), F.lit(False))


def _staged(tables: Tables, kind: str, mode: Column, seed: int) -> DataFrame:
    """The tables with their numbers, entities and the measures in drawn order."""
    # no struct is carried over the generators of ``_with``: fields that are read above them alone would get lost in them
    flat = tables.select(
        *(c for c in tables.columns if c != "table"),
        F.col("table.headers").alias("heads"),
        F.col("table.rows").alias("cells"),
        F.col("table.row_labels").alias("labels"),
        F.col("table.column_types").alias("types")
    )
    t = _with(flat, mode=mode, num=F.transform("cells", lambda r: F.transform(r, cell_number)), entities=corpus.entity_rows(F.col("cells")))
    drawn = F.array_sort(
        F.transform(
            "metrics",
            lambda m: F.struct(F.md5(F.concat_ws(":", F.lit(f"{seed}:{kind}"), F.col("table_id"), m["name"])).alias("d"), m.alias("m"))
        )
    )
    way = lambda m, d: F.coalesce(m["direction"], F.when(F.substring(d, 1, 1) < "8", "higher").otherwise("lower"))
    turned = F.transform(
        drawn,
        lambda x: F.struct(
            x["m"]["name"].alias("name"),
            way(x["m"], F.reverse(x["d"])).alias("direction"),
            (F.array_position(F.col("heads"), x["m"]["name"]) - 1).cast("int").alias("col")
        )
    )
    return _with(t, order=turned, has_totals=F.size("entities") < F.size("cells"))


def _value(i: Column, c: Column) -> Column:
    return _get(_get("num", i), c)


def _name(i: Column) -> Column:
    return F.coalesce(_get(_get("cells", i), 0), F.lit(""))


def _names(ids: Column) -> Column:
    return F.array_join(F.transform(ids, _name), ", ")


def _cells(ids: Column, c: Column) -> Column:
    return F.transform(
        ids,
        lambda i: F.struct(
            i.cast("int").alias("row"),
            c.alias("col"),
            _get("heads", c).alias("col_name"),
            F.coalesce(_get(_get("cells", i), c), F.lit("")).alias("value")
        )
    )


def _phrase(m: Column, down: Column, t: Column) -> Column:
    return F.concat(F.col("prefix"), m, F.when(down, UNDER).otherwise(AT_LEAST), plain_number(t))


def _step(index: int | Column, kind: str, description: Column, cites: Column) -> Column:
    return F.struct(
        F.lit(index).cast("int").alias("index"),
        F.lit(kind).alias("kind"),
        description.alias("description"),
        F.array_distinct(cites).cast(f"array<{CELL}>").alias("cites")
    )


def _record(
    built: DataFrame,
    kind: str,
    question_type: str,
    question: Column,
    label: Column,
    said: Column,
    metrics: Column,
    steps: Column,
    edge: Column,
    spec: dict[str, Column]
) -> DataFrame:
    """The built columns as question records; ``table`` is the one that the answer belongs to."""
    note = F.when(F.col("has_totals"), TOTALS_NOTE).otherwise("")
    universe = F.when(F.col("whole_universe"), F.lit(None)).otherwise(F.col("entities")).cast(_INTS)
    fields = {"type": F.lit(kind), **spec, "rows": universe}
    names = ("type", "target", "target_dir", "constraint", "op", "threshold", "conditions", "m1", "m2", "d1", "d2", "rows")
    full = F.struct(*(fields.get(f, F.lit(None)).alias(f) for f in names)).cast(SPEC)
    out = built.select(
        F.col("table_id"),
        F.col("domain"),
        F.concat(question, note).alias("question"),
        F.lit(question_type).alias("question_type"),
        F.lit("programmatic").alias("trace_source"),
        F.struct(
            F.col("heads").alias("headers"),
            F.col("cells").alias("rows"),
            F.col("labels").alias("row_labels"),
            F.col("types").alias("column_types")
        ).alias("table"),
        F.struct(
            label.alias("label"),
            F.array_sort(said).cast(_INTS).alias("rows"),
            metrics.cast("array<string>").alias("metrics")
        ).alias("gold_answer"),
        steps.alias("trace_steps"),
        edge.alias("_edge"),
        full.alias("_spec"),
        F.concat_ws("_", F.col("table_id"), F.lit(question_type), F.col("mode")).alias("_id"), "orientation", "confidence", "uid", "dataset",
    )
    meta = F.struct(
        F.when(F.col("_edge").isNull(), "easy").otherwise("hard").alias("difficulty"),
        F.array_compact(F.array("_edge")).alias("edge_cases"),
        F.col("_id").alias("example_id"),
        F.col("_spec").alias("spec"),
        "orientation",
        "confidence",
        F.struct("dataset", "uid", F.lit(None).cast("string").alias("attribution")).alias("source"),
    )
    evidence = F.array_distinct(F.flatten(F.transform("trace_steps", lambda s: s["cites"])))
    return out.select(
        "table_id",
        "domain",
        "question",
        "question_type",
        "trace_source",
        "table",
        "gold_answer",
        "trace_steps",
        evidence.alias("evidence_cells"),
        meta.alias("metadata")
    )


def _two(t: DataFrame) -> DataFrame:
    """Tables with two measures and two rows in which both are numbers (``pool``)."""
    t = _with(t.where(F.size("order") >= 2), **{f"{x}_{f}": _get("order", i)[f] for i, x in enumerate("mc") for f in ("name", "direction", "col")})
    return _with(
        t,
        pool=F.filter("entities", lambda i: _value(i, F.col("m_col")).isNotNull() & _value(i, F.col("c_col")).isNotNull())
    ).where(F.size("pool") >= 2)


def build_best(tables: Tables, mode: Column, seed: int = 0) -> DataFrame:
    """Which row has the best measure while another keeps a limit. In mode ``tie`` a second survivor is given the best value."""
    t = _two(_staged(tables, "best", mode, seed))
    down, high = F.col("c_direction") == "lower", F.col("m_direction") == "higher"
    u = generate.uniform(seed, "table_id", F.lit("best"))
    t = _with(t, limit=choose_threshold(F.transform("pool", lambda i: _value(i, F.col("c_col"))), F.col("c_direction"), F.col("mode"), u))
    t = _with(t, left=F.filter("pool", lambda i: _passes(_value(i, F.col("c_col")), down, F.col("limit"))))
    best = lambda: F.when(
        high,
        F.array_max(F.transform("left", lambda i: _value(i, F.col("m_col"))))
    ).otherwise(F.array_min(F.transform("left", lambda i: _value(i, F.col("m_col")))))
    t = _with(t, best=best())
    top = lambda i: F.abs(_value(i, F.col("m_col")) - F.col("best")) <= EPS
    t = _with(
        t,
        moved=F.when((F.col("mode") == "tie") & (F.size("left") >= 2), _get(F.filter("left", lambda i: ~top(i)), 0)),
        model=_get(F.filter("left", top), 0)
    )
    cell = lambda r, i, rows: F.when(
        i == F.col("moved"),
        F.transform(r, lambda c, j: F.when(j == F.col("m_col"), _get(_get(rows, F.col("model")), F.col("m_col"))).otherwise(c))
    ).otherwise(r)
    tied = _with(
        t,
        _cells=F.transform("cells", lambda r, i: cell(r, i, F.col("cells"))),
        _num=F.transform("num", lambda r, i: cell(r, i, F.col("num")))
    )
    t = tied.drop("cells", "num").withColumnsRenamed({"_cells": "cells", "_num": "num"})
    t = _with(t, won=F.filter("left", top))
    word, limit, m = F.when(high, "highest").otherwise("lowest"), _phrase(F.col("c_name"), down, F.col("limit")), F.concat("prefix", "m_name")
    none, one = F.size("won") == 0, F.size("won") == 1
    kept = F.when(F.size("left") == 0, F.concat(F.lit("no "), "noun")).otherwise(_names(F.col("left")))
    first = _step(0, "filter", F.concat(F.lit("Rows with "), limit, F.lit(": "), kept, F.lit(".")), _cells(F.col("pool"), F.col("c_col")))
    steps = F.when(none, F.array(first, _step(1, "conclude", F.concat(F.lit("No "), "noun", F.lit(" has "), limit, F.lit(".")), _cells(F.col("pool"), F.col("c_col"))))).otherwise(F.array(
        first,
        _step(
            1,
            "select",
            F.concat(F.lit("Of these the "), word, F.lit(" "), m, F.lit(" is that of "), _names(F.col("won")), F.lit(".")),
            _cells(F.col("left"), F.col("m_col"))
        ),
        _step(
            2,
            "conclude",
            F.concat(F.lit("The answer is "), _names(F.col("won")), F.lit(".")),
            F.concat(_cells(F.col("won"), F.col("m_col")), _cells(F.col("won"), F.col("c_col")))
        ),
    ))
    label = F.when(none, "none").when(one, _names(F.col("won"))).otherwise(F.concat(F.lit("tie: "), _names(F.col("won"))))
    edge = F.when(none, "empty").when(~one, "argmax_tie").when(F.col("mode") == "near_threshold", "near_threshold")
    question = F.concat(F.lit("Which "), "noun", F.lit(" has the "), word, F.lit(" "), m, F.lit(" while keeping "), limit, F.lit("?"))
    spec = {
        "target": F.col("m_name"),
        "target_dir": F.col("m_direction"),
        "constraint": F.col("c_name"),
        "op": F.when(down, "lt").otherwise("ge"),
        "threshold": F.col("limit")
    }
    return _record(t, "best_under_constraint", "best_under_constraint", question, label, F.col("won"), F.array(), steps, edge, spec)


def build_filter(tables: Tables, mode: Column, seed: int = 0) -> DataFrame:
    """Which rows meet one or two limits."""
    t = _staged(tables, "filter", mode, seed).where(F.size("order") >= 1)
    k = F.least(F.size("order"), F.when(generate.uniform(seed, "table_id", F.lit("how many")) < 0.5, 1).otherwise(2))
    t = _with(t, ms=F.slice("order", F.lit(1), k))
    numbers = lambda m: F.filter(F.transform("entities", lambda i: _value(i, m["col"])), lambda v: v.isNotNull())
    t = t.where(F.forall("ms", lambda m: F.size(numbers(m)) >= 2))
    us = [generate.uniform(seed, "table_id", F.lit(f"filter {j}")) for j in (0, 1)]
    # the mode holds for the first condition
    cond = lambda m, j: F.struct(
        m["name"].alias("name"),
        m["col"].alias("col"),
        (m["direction"] == "lower").alias("down"),
        choose_threshold(
            numbers(m),
            m["direction"],
            F.when(j == 0, F.col("mode")).otherwise("normal"),
            F.when(j == 0, us[0]).otherwise(us[1])
        ).alias("t")
    )
    t = _with(t, conds=F.transform("ms", cond))
    t = _with(t, won=F.filter("entities", lambda i: F.forall("conds", lambda c: _passes(_value(i, c["col"]), c["down"], c["t"]))))
    phrase = lambda c: _phrase(c["name"], c["down"], c["t"])
    none = F.size("won") == 0
    steps = F.concat(
        F.transform(
            "conds",
            lambda c, j: _step(j, "filter", F.concat(F.lit("Rows with "), phrase(c), F.lit(".")), _cells(F.col("entities"), c["col"]))
        ),
        F.array(
            _step(
                F.size("conds"),
                "conclude",
                F.when(none, F.concat(F.lit("No "), "noun", F.lit(" meets all conditions."))).otherwise(
                    F.concat(F.lit("All conditions are met by "), _names(F.col("won")), F.lit("."))
                ),
                F.flatten(F.transform("conds", lambda c: _cells(F.col("won"), c["col"])))
            )
        ),
    )
    edge = F.when(none, "empty").when(F.col("mode") == "near_threshold", "near_threshold")
    question = F.concat(F.lit("Which "), "noun", F.lit("s have "), F.array_join(F.transform("conds", phrase), " and "), F.lit("?"))
    spec = {
        "conditions": F.transform(
            "conds",
            lambda c: F.struct(c["name"].alias("metric"), F.when(c["down"], "lt").otherwise("ge").alias("op"), c["t"].alias("t"))
        )
    }
    return _record(
        t,
        "threshold_filter",
        "threshold_filter",
        question,
        F.when(none, "none").otherwise(_names(F.col("won"))),
        F.col("won"),
        F.array(),
        steps,
        edge,
        spec
    )


def build_tradeoff(tables: Tables, mode: Column, seed: int = 0) -> DataFrame:
    """Which rows no other beats in two measures. Measures without a direction are both to be high."""
    given = F.transform("metrics", lambda m: m.withField("direction", F.coalesce(m["direction"], F.lit("higher"))))
    fixed = F.forall("metrics", lambda m: m["direction"].isNull())
    t = _two(_staged(tables.withColumns({"metrics": given, "both_high": fixed}), "tradeoff", mode, seed))
    o = lambda i, m: F.when(F.col(f"{m}_direction") == "higher", _value(i, F.col(f"{m}_col"))).otherwise(-_value(i, F.col(f"{m}_col")))
    t = _with(t, points=F.transform("pool", lambda i: F.struct(i.alias("i"), o(i, "m").alias("a"), o(i, "c").alias("b"))))
    worse = lambda x: F.exists(
        "points",
        lambda y: (y["a"] >= x["a"] - EPS) & (y["b"] >= x["b"] - EPS) & ((y["a"] > x["a"] + EPS) | (y["b"] > x["b"] + EPS))
    )
    t = _with(t, won=F.transform(F.filter("points", lambda x: ~worse(x)), lambda x: x["i"]))
    both = lambda ids: F.concat(_cells(ids, F.col("m_col")), _cells(ids, F.col("c_col")))
    m1, m2 = F.concat("prefix", "m_name"), F.concat("prefix", "c_name")
    edge = F.when(F.size("won") == 1, "single_dominator").when(F.size("won") == F.size("pool"), "no_domination")
    last = F.when(F.size("won") == 1, F.concat(_names(F.col("won")), F.lit(" is best in both."))).when(F.size("won") == F.size("pool"), F.concat(F.lit("No "), "noun", F.lit(" is beaten."))).otherwise(
        F.concat(F.lit("What is gained in "), m1, F.lit(" is lost in "), m2, F.lit(" along "), _names(F.col("won")), F.lit("."))
    )
    steps = F.array(
        _step(
            0,
            "aggregate",
            F.concat(
                F.lit("Read "),
                m1,
                F.lit(" ("),
                "m_direction",
                F.lit(" is better) and "),
                m2,
                F.lit(" ("),
                "c_direction",
                F.lit(" is better).")
            ),
            both(F.col("pool"))
        ),
        _step(1, "select", F.concat(F.lit("Beaten by no other: "), _names(F.col("won")), F.lit(".")), both(F.col("won"))),
        _step(2, "conclude", last, both(F.col("won"))),
    )
    free = F.concat(F.lit("What is the trade-off between "), m1, F.lit(" and "), m2, F.lit(" across these "), "noun", F.lit("s?"))
    high = F.concat(F.lit("Among these "), "noun", F.lit("s, which are Pareto-optimal when maximizing both "), m1, F.lit(" and "), m2, F.lit("?"))
    spec = {"m1": F.col("m_name"), "m2": F.col("c_name"), "d1": F.col("m_direction"), "d2": F.col("c_direction")}
    return _record(
        t,
        "tradeoff_summary",
        "tradeoff_summary",
        F.when(F.col("both_high"), high).otherwise(free),
        F.concat("m_name", F.lit(" vs "), "c_name"),
        F.col("won"),
        F.array("m_name", "c_name"),
        steps,
        edge,
        spec
    )


def build_extremum(tables: Tables, target: Column, direction: Column, question: Column, native_gold: Column) -> DataFrame:
    """A given question for the row with the extreme of one column, with what people answered as its provenance."""
    t = _staged(tables.withColumns({"target": target, "way": direction, "asked": question, "native": native_gold}), "extremum", F.lit("verified"), 0)
    t = _with(t, col=(F.array_position(F.col("heads"), F.col("target")) - 1).cast("int")).where("col >= 0 and way in ('higher', 'lower')")
    t = _with(t, pool=F.filter("entities", lambda i: _value(i, F.col("col")).isNotNull())).where(F.size("pool") >= 2)
    values = F.transform("pool", lambda i: _value(i, F.col("col")))
    t = _with(t, best=F.when(F.col("way") == "higher", F.array_max(values)).otherwise(F.array_min(values)))
    t = _with(t, won=F.filter("pool", lambda i: F.abs(_value(i, F.col("col")) - F.col("best")) <= EPS))
    word = F.when(F.col("way") == "higher", "highest").otherwise("lowest")
    steps = F.array(
        _step(0, "aggregate", F.concat(F.lit("Read "), "target", F.lit(" of every "), "noun", F.lit(".")), _cells(F.col("pool"), F.col("col"))),
        _step(
            1,
            "conclude",
            F.concat(F.lit("The "), word, F.lit(" is that of "), _names(F.col("won")), F.lit(".")),
            _cells(F.col("won"), F.col("col"))
        )
    )
    out = _record(
        t.withColumn("has_totals", F.lit(False)),
        "extremum",
        "rank_models",
        F.col("asked"),
        _names(F.col("won")),
        F.col("won"),
        F.array(),
        steps,
        F.when(F.size("won") > 1, "argmax_tie"),
        {"target": F.col("target"), "target_dir": F.col("way")}
    )
    return out.withColumn("split", F.lit("eval"))


#: The builders by the kind of their operation; a new kind is registered here, and in the executor and the validator.
BUILDERS: dict[str, Callable[[Tables, Column, int], DataFrame]] = {
    "best_under_constraint": build_best,
    "threshold_filter": build_filter,
    "tradeoff_summary": build_tradeoff
}


def synthetic(ids: DataFrame, id_col: str, seed: int = 0, config: generate.Config = generate.Config()) -> Tables:
    """A generated table for each id: rows named by letters, measures of the registry with their directions."""
    i = F.col(id_col)
    u = lambda *k: generate.uniform(seed, i, *(x if isinstance(x, Column) else F.lit(x) for x in k))
    between = lambda lo, hi, *k: (lo + F.floor(u(*k) * (hi - lo + 1))).cast("int")
    registry = F.array(
        *(
            F.struct(
                F.md5(F.concat_ws(":", F.lit(f"{seed}:{m}"), i.cast("string"))).alias("o"),
                F.lit(m).alias("name"),
                F.lit(d).alias("direction"),
                F.lit(lo).alias("lo"),
                F.lit(hi).alias("hi"),
                F.lit(k).alias("k")
            ) for m, d, lo, hi, k in generate.METRICS
        )
    )
    t = _with(
        ids,
        _i=i,
        n=between(config.min_rows, config.max_rows, "rows"),
        ms=F.slice(F.array_sort(registry), F.lit(1), between(config.min_metrics, config.max_metrics, "cols"))
    )
    digit = lambda v, k: F.regexp_replace(F.format_string("%.3f", F.round(v * F.pow(F.lit(10.0), k) + 0.0, 0) / F.pow(F.lit(10.0), k)), r"\.?0+$", "")
    cell = lambda r, m: digit(m["lo"] + u("cell", r.cast("string"), m["name"]) * (m["hi"] - m["lo"]), m["k"])
    rows = F.transform(
        F.sequence(F.lit(0), F.col("n") - 1),
        lambda r: F.concat(
            F.array(F.concat(F.lit("model-"), F.char(65 + r), F.pmod(F.xxhash64("_i"), F.lit(97)).cast("string"))),
            F.transform("ms", lambda m: cell(r, m))
        )
    )
    table = F.struct(
        F.concat(F.array(F.lit("model")), F.transform("ms", lambda m: m["name"])).alias("headers"),
        rows.alias("rows"),
        F.lit(None).cast("array<string>").alias("row_labels"),
        F.concat(F.array(F.lit("categorical")), F.transform("ms", lambda m: F.lit("numeric"))).alias("column_types")
    )
    return t.select(
        F.format_string("tbl_%04d", F.col(id_col).cast("bigint")).alias("table_id"),
        table.alias("table"),
        F.transform("ms", lambda m: F.struct(m["name"].alias("name"), m["direction"].alias("direction"))).alias("metrics"),
        F.lit("model").alias("noun"),
        F.lit("").alias("prefix"),
        F.lit("ml_benchmark").alias("domain"),
        F.lit(True).alias("whole_universe"),
        *(F.lit(None).cast("string").alias(c) for c in ("orientation", "confidence", "uid", "dataset")),
        F.col(id_col).alias("table_index"),
    )


def _mode(kind: str, hard: float, seed: int, key: str, names: tuple[str, ...] | None = None) -> Column:
    names = names or HARD[kind]
    pick = F.get(F.array(*map(F.lit, names)), F.floor(generate.uniform(seed, key, F.lit("which mode")) * len(names)).cast("int"))
    return F.when(generate.uniform(seed, key, F.lit("hard")) < hard, pick).otherwise("normal")


def checked(built: DataFrame, eval_share: float, seed: int) -> DataFrame:
    """Built records with ``split`` drawn by their example, and ``valid`` and ``failed`` of the validator.

    The records are built and written to the shared folder when the plan is built. Example ids are unique.
    """
    part = F.when(generate.uniform(seed, "metadata.example_id", F.lit("split")) < eval_share, "eval").otherwise("train")
    out = materialize(built.withColumn("split", part).withColumn("_key", F.col("metadata.example_id")), "built")
    verdict = validator.validate(out, "_key").select("_key", "valid", "failed")
    return materialize(out.join(verdict, "_key").drop("_key"), "checked")


def synthetic_dataset(
    spark: SparkSession,
    n: int,
    seed: int = 0,
    *,
    hard: float = 0.35,
    eval_share: float = 0.2,
    config: generate.Config = generate.Config()
) -> tuple[DataFrame, DataFrame]:
    """``n`` valid records over generated tables, the kinds in turn, and the invalid ones.

    At most 20 tables are tried for each record asked for; those beyond the first 1.5 n are only tried if they are needed.
    """

    def attempt(first: int, last: int) -> DataFrame:
        ids = spark.range(first, last)
        parts = [
            BUILDERS[k](
                synthetic(ids.where(F.col("id") % len(KINDS) == j), "id", seed, config),
                _mode(k, hard, seed, "table_id"),
                seed
            ) for j, k in enumerate(KINDS)
        ]
        built = parts[0]
        for p in parts[1:]:
            built = built.unionByName(p)
        return checked(built, eval_share, seed).withColumn("table_index", F.regexp_extract("table_id", r"(\d+)$", 1).cast("bigint"))

    got = attempt(0, n + n // 2 + len(KINDS))
    if got.where("valid").count() < n:
        got = attempt(0, 20 * n)
    return got.where("valid").orderBy("table_index").limit(n), got.where("not valid")


def as_rows(tables: DataFrame) -> Tables:
    """Tables as they are: their rows are asked for, their numeric columns are the measures. ``tables`` has ``table_id``, ``table``, ``uid``, ``dataset``, ``confidence``."""
    return _asked(tables, "rows", "line item", "value in ")


def _asked(tables: DataFrame, way: str, noun: str, prefix: str) -> Tables:
    numeric = F.filter(
        F.arrays_zip(F.col("table.headers").alias("name"), F.col("table.column_types").alias("kind")),
        lambda x: x["kind"] == "numeric"
    )
    metrics = F.transform(numeric, lambda x: F.struct(x["name"].alias("name"), F.lit(None).cast("string").alias("direction")))
    return tables.select(
        F.concat("table_id", F.lit(f"_{way}")).alias("table_id"),
        "table",
        metrics.alias("metrics"),
        F.lit(noun).alias("noun"),
        F.lit(prefix).alias("prefix"),
        F.lit("finance").alias("domain"),
        F.lit(False).alias("whole_universe"),
        F.lit("across_rows" if way == "rows" else "across_columns").alias("orientation"),
        "confidence",
        "uid",
        "dataset"
    )


def as_columns(tables: DataFrame) -> Tables:
    """Tables turned: their columns are asked for, their rows are the measures. Tables that turned have no numeric column are left out."""
    turned = _with(tables, _turned=grid.transposed(F.col("table"))).drop("table").withColumnRenamed("_turned", "table").where("table is not null")
    return _asked(turned, "cols", "period", "")


def real_dataset(tables: DataFrame, seed: int = 0, *, hard: float = 0.35, eval_share: float = 0.2) -> DataFrame:
    """Records of every kind over every table in both orientations, with the validator's verdict; tables of high confidence only."""
    good = tables.where("confidence = 'high'")
    out = None
    for turned in (as_rows(good), as_columns(good)):
        for k in KINDS:
            names = tuple(m for m in HARD[k] if m != "tie")
            built = BUILDERS[k](turned, _mode(k, hard, seed, "table_id", names), seed)
            out = built if out is None else out.unionByName(built)
    return checked(out, eval_share, seed)
