"""The query operators over one wide table, or over many tables that a partition key tells apart.

A row takes part where its measures are numbers; NaN is none. Thresholds are exact, optimum and dominance allow EPS.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cellwise.functions.text import is_total
from cellwise.session import materialize

EPS = 1e-9
OPS = {"lt": "lt", "gte": "gte", "ge": "gte"}
DIRECTIONS = ("higher", "lower")


def canon_op(op: str) -> str:
    """lt or gte; ge is gte. Anything else is an error."""
    if op not in OPS:
        raise ValueError(f"unknown comparison {op!r}")
    return OPS[op]


def canon_direction(direction: str) -> str:
    if direction not in DIRECTIONS:
        raise ValueError(f"unknown direction {direction!r}")
    return direction


def number(c: str | Column) -> Column:
    """``c`` as a double, null where it is NaN."""
    v = (F.col(c) if isinstance(c, str) else c).cast("double")
    return F.when(~F.isnan(v), v)


def passes(metric: str, op: str, threshold: float) -> Column:
    v = number(metric)
    return F.coalesce(v < threshold if canon_op(op) == "lt" else v >= threshold, F.lit(False))


def universe(df: DataFrame, label: str) -> DataFrame:
    """The rows that stand for entities: those whose label is no total."""
    return df.where(~is_total(F.col(label)))


def extremum(df: DataFrame, target: str, direction: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """The rows whose ``target`` is within EPS of the best, per partition.

    The best values are aggregated first and joined back, so that a partition with a third of all rows is neither sorted
    nor held by one task.
    """
    canon_direction(direction)
    v = number(target)
    rows = df.where(v.isNotNull())
    best = (F.max if direction == "higher" else F.min)(v).alias("_best")
    if partition_by:
        tops = rows.groupBy(*partition_by).agg(best)
        keys = [f"_k{i}" for i in range(len(partition_by))]
        tops = tops.select(*(F.col(c).alias(k) for c, k in zip(partition_by, keys)), "_best")
        on = F.lit(True)
        for c, k in zip(partition_by, keys):
            on = on & F.col(c).eqNullSafe(F.col(k))
        joined = rows.join(tops, on)
    else:
        joined = rows.withColumn("_best", rows.agg(best).scalar())  # a subquery of one number
    return joined.where(F.abs(v - F.col("_best")) <= EPS).select(*(f"`{c}`" for c in df.columns))


def best_under_constraint(
    df: DataFrame,
    target: str,
    direction: str,
    constraint: str,
    op: str,
    threshold: float,
    partition_by: Sequence[str] = ()
) -> DataFrame:
    """Of the rows whose ``constraint`` passes, those with the best ``target``."""
    return extremum(df.where(passes(constraint, op, threshold)), target, direction, partition_by)


def threshold_filter(df: DataFrame, conditions: Sequence[tuple[str, str, float]]) -> DataFrame:
    """The rows that pass all ``(metric, op, threshold)``."""
    keep = F.lit(True)
    for metric, op, t in conditions:
        keep = keep & passes(metric, op, t)
    return df.where(keep)


def _oriented(m: str, d: str) -> Column:
    return number(m) if canon_direction(d) == "higher" else -number(m)


def pareto(df: DataFrame, m1: str, m2: str, d1: str, d2: str, partition_by: Sequence[str], salts: int = 16) -> DataFrame:
    """The rows that no other row of their partition dominates in both measures.

    Windows instead of a self-join: the best second measure among the rows that are as good in the first, and the other
    way round. They run over the parts of each partition first, so that a partition with a third of all rows is sorted by
    many tasks; what may be on the frontier, or beats another row without any tolerance, goes on to the windows over
    whole partitions. What beats a row left out is beaten by no tolerance of a row kept.
    """
    rows = df.withColumns({"_o1": _oriented(m1, d1), "_o2": _oriented(m2, d2)}).where("_o1 is not null and _o2 is not null").withColumn(
        "_part",
        F.pmod(F.xxhash64("_o1", "_o2"), F.lit(salts))
    )
    by = ", ".join(f"`{c}`" for c in partition_by)

    def beaten(d: DataFrame, keys: str, eps: float) -> tuple[DataFrame, str]:
        best = lambda x, y: F.expr(f"max({x}) over (partition by {keys} order by {y} desc range between unbounded preceding and {eps}D following)")
        n = f"{eps:.0e}".replace("-", "_").replace("+", "_")
        return d.withColumns({f"_w1{n}": best("_o2", "_o1"), f"_w2{n}": best("_o1", "_o2")}), f"(_w1{n} > _o2 + {eps}D or _w2{n} > _o1 + {eps}D)"

    part, near = beaten(rows, f"{by}, _part", EPS)
    part, exact = beaten(part, f"{by}, _part", 0.0)
    kept = part.where(f"not {near} or not {exact}").select(*(f"`{c}`" for c in df.columns), "_o1", "_o2")
    whole, near = beaten(kept, by, EPS)
    return whole.where(f"not {near}").select(*(f"`{c}`" for c in df.columns))


def _reach(rows: DataFrame, x: str, y: str, blocks: int) -> DataFrame:
    """For each value of ``x`` the largest ``y`` among rows with at least this ``x`` less EPS.

    Maxima per value come first; the values are cut into blocks of equal size by quantiles, a window runs within each
    block, and what the higher blocks reach is a table of as many rows as there are blocks.
    """
    per = rows.groupBy(x).agg(F.max(y).alias("_top"))
    cuts = sorted({float(v) for v in per.approxQuantile(x, [i / blocks for i in range(1, blocks)], 0.01)})
    # a value just under a cut is also reached from just over it
    placed = per.withColumns({"_b": _blocks(cuts, F.col(x)), "_up": _blocks([c - EPS for c in cuts], F.col(x))})
    tops = {r["_b"]: r["t"] for r in placed.groupBy("_b").agg(F.max("_top").alias("t")).collect()}  # one row for each block
    above, after = float("-inf"), {}
    for b in range(len(cuts), -1, -1):
        after[b] = above
        above = max(above, tops.get(b, above))
    ghosts = placed.where("_up > _b").select(F.col(x), F.col("_top"), F.col("_up").alias("_b"), F.lit(True).alias("_ghost"))
    both = placed.select(F.col(x), "_top", "_b", F.lit(False).alias("_ghost")).unionAll(ghosts)
    near = F.expr(f"max(_top) over (partition by _b order by `{x}` desc range between unbounded preceding and {EPS}D following)")
    higher = F.element_at(F.array(*(F.lit(after[b]) for b in range(len(cuts) + 1))), F.col("_b") + 1)
    return both.withColumn("_w", F.greatest(near, higher)).where("not _ghost").select(F.col(x).alias("_x"), "_w")


def _blocks(cuts: Sequence[float], x: Column) -> Column:
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: x >= c)) if cuts else F.lit(0)


def _candidates(rows: DataFrame, blocks: int) -> DataFrame:
    """The rows that no block of better first measures beats as a whole.

    What beats a row left out also beats whatever that row beats, so that the frontier among the candidates is the
    frontier of all rows. One pass takes the maximum of each block.
    """
    cuts = sorted({float(v) for v in rows.approxQuantile("_o1", [i / blocks for i in range(1, blocks)], 0.01)})
    placed = rows.withColumn("_b", _blocks(cuts, F.col("_o1")))
    tops = {r["_b"]: r["t"] for r in placed.groupBy("_b").agg(F.max("_o2").alias("t")).collect()}  # one row for each block
    best, after = float("-inf"), {}
    for b in range(len(cuts), -1, -1):
        after[b] = best
        best = max(best, tops.get(b, best))
    higher = F.element_at(F.array(*(F.lit(after[b]) for b in range(len(cuts) + 1))), F.col("_b") + 1)
    return placed.where(~(higher > F.col("_o2") + EPS)).drop("_b")


def pareto_global(df: DataFrame, m1: str, m2: str, d1: str, d2: str, blocks: int = 32) -> DataFrame:
    """The frontier of one whole table, without a sort in one task and without a theta join."""
    rows = df.withColumns({"_o1": _oriented(m1, d1), "_o2": _oriented(m2, d2)}).where("_o1 is not null and _o2 is not null")
    rows = materialize(_candidates(rows, blocks), "candidates")
    w1, w2 = _reach(rows, "_o1", "_o2", blocks), _reach(rows, "_o2", "_o1", blocks)
    seen = rows.join(
        w1.withColumnsRenamed({"_x": "_x1", "_w": "_w1"}),
        F.col("_o1") == F.col("_x1")
    ).join(w2.withColumnsRenamed({"_x": "_x2", "_w": "_w2"}), F.col("_o2") == F.col("_x2"))
    return seen.where(f"not (_w1 > _o2 + {EPS}D) and not (_w2 > _o1 + {EPS}D)").select(*(f"`{c}`" for c in df.columns))


def pareto_antijoin(df: DataFrame, m1: str, m2: str, d1: str, d2: str, partition_by: Sequence[str]) -> DataFrame:
    """The frontier by the definition, as an anti-join within each partition; for partitions known to be small, and to check ``pareto``."""
    rows = df.withColumns({"_o1": _oriented(m1, d1), "_o2": _oriented(m2, d2)}).where("_o1 is not null and _o2 is not null")
    other = rows.select(
        *(F.col(c).alias(f"_p{i}") for i, c in enumerate(partition_by)),
        F.col("_o1").alias("_q1"),
        F.col("_o2").alias("_q2")
    ).distinct()
    on = F.expr(f"_q1 >= _o1 - {EPS}D and _q2 >= _o2 - {EPS}D and (_q1 > _o1 + {EPS}D or _q2 > _o2 + {EPS}D)")
    for i, c in enumerate(partition_by):
        on = on & F.col(c).eqNullSafe(F.col(f"_p{i}"))
    return rows.join(other, on, "left_anti").select(*(f"`{c}`" for c in df.columns))


def answer_label(answer: DataFrame, label: str, order: str, partition_by: Sequence[str]) -> DataFrame:
    """The labels of each partition's answer rows in row order, joined by commas."""
    names = F.array_join(
        F.transform(
            F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce(F.col(label), F.lit("")).alias("l")))),
            lambda x: x["l"]
        ),
        ", "
    )
    return answer.groupBy(*partition_by).agg(F.coalesce(F.nullif(names, F.lit("")), F.lit("none")).alias("label"), F.count("*").alias("n_rows"))


def with_none(answers: DataFrame, groups: DataFrame, partition_by: Sequence[str]) -> DataFrame:
    """The labelled answers with a row ``none`` for each group that has no answer row."""
    return groups.select(*partition_by).distinct().join(answers, list(partition_by), "left").withColumns(
        {"label": F.coalesce("label", F.lit("none")), "n_rows": F.coalesce("n_rows", F.lit(0))}
    )


def evidence(answer: DataFrame, key: str, metrics: Sequence[str]) -> DataFrame:
    """The cells that an answer rests on: ``key``, ``col_name``, ``value`` for each answer row and measure."""
    wide = answer.select(key, *(number(m).alias(m) for m in metrics))
    return wide.unpivot(key, list(metrics), "col_name", "value").where("value is not null")


def evidence_or_universe(
    answer: DataFrame,
    whole: DataFrame,
    key: str,
    metrics: Sequence[str],
    if_empty: Sequence[str],
    partition_by: Sequence[str]
) -> DataFrame:
    """As ``evidence``; a partition without an answer row is shown by ``if_empty`` over its whole universe."""
    keep = [*partition_by, key]
    shape = lambda d, ms: d.select(*keep, *(number(m).alias(m) for m in ms)).unpivot(keep, list(ms), "col_name", "value").where("value is not null")
    lacking = whole.join(answer.select(*partition_by).distinct(), list(partition_by), "left_anti")
    return shape(answer, metrics).unionByName(shape(lacking, if_empty))


def first_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column]) -> DataFrame:
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
