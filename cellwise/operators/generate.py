"""Seeded tables and questions. Draws are digests of seed, id and purpose: the same on every run and in every partition."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The measures of generated tables with their direction, range and decimals.
METRICS = (
    ("accuracy", "higher", 0.70, 0.99, 3),
    ("robustness", "higher", 0.40, 0.95, 2),
    ("latency_ms", "lower", 5.0, 200.0, 0),
    ("cost", "lower", 0.5, 20.0, 2),
    ("memory_gb", "lower", 1.0, 40.0, 1),
)


@dataclass(frozen=True)
class Config:
    """The least and most rows and measures of a generated table."""

    min_rows: int = 3
    max_rows: int = 8
    min_metrics: int = 2
    max_metrics: int = 5


def uniform(seed: int, *keys: Column | str) -> Column:
    """A number in [0, 1) from a digest."""
    parts = [F.lit(str(seed)), *((F.col(k) if isinstance(k, str) else k).cast("string") for k in keys)]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("double") / float(16**8)


def synthetic_tables(spark: SparkSession, n: int, seed: int = 0, config: Config = Config()) -> DataFrame:
    """``table_id``, ``row``, ``col_name``, ``direction``, ``value`` of n generated tables, sized by ``config``."""
    between = lambda lo, hi, what: (lo + F.floor(uniform(seed, "table_id", F.lit(what)) * (hi - lo + 1))).cast("int")
    ids = spark.range(n).select(F.col("id").alias("table_id"))
    sized = ids.select(
        "table_id",
        between(config.min_rows, config.max_rows, "rows").alias("_r"),
        between(config.min_metrics, config.max_metrics, "cols").alias("_c")
    )
    metrics = F.array(
        *(
            F.struct(
                F.lit(i).alias("i"),
                F.lit(m).alias("m"),
                F.lit(d).alias("d"),
                F.lit(lo).alias("lo"),
                F.lit(hi).alias("hi"),
                F.lit(k).alias("k")
            ) for i, (m, d, lo, hi, k) in enumerate(METRICS)
        )
    )
    rows = sized.select(
        "table_id",
        "_c",
        F.explode(F.sequence(F.lit(0), F.col("_r") - 1)).alias("row")
    ).select("table_id", "row", F.explode(F.slice(metrics, 1, F.col("_c"))).alias("x"))
    raw = F.col("x.lo") + uniform(seed, "table_id", "row", F.col("x.i")) * (F.col("x.hi") - F.col("x.lo"))
    value = F.floor(raw * F.pow(F.lit(10.0), F.col("x.k")) + 0.5) / F.pow(F.lit(10.0), F.col("x.k"))
    return rows.select("table_id", "row", F.col("x.m").alias("col_name"), F.col("x.d").alias("direction"), value.alias("value"))


def thresholds(df: DataFrame, group: str, value: str, direction: str, mode: str, seed: int = 0) -> DataFrame:
    """``group``, ``threshold``: normal (between two values), near (just at a value) or empty (beyond all), never on a value.

    Only each group's extremes and one drawn pair of neighbouring distinct values are needed. They are ranked in a window
    over the distinct values, which sorts and spills but collects none of them.
    """
    v = df.select(group, F.col(value).cast("double").alias("v")).where("v is not null and not isnan(v)").distinct()
    own = Window.partitionBy(group).orderBy("v")
    per = v.groupBy(group).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    rank = F.floor(uniform(seed, group) * (F.col("n") if mode == "near" else F.col("n") - 1)) + 1
    ranked = v.select(group, "v", F.row_number().over(own).alias("k"), F.lead("v").over(own).alias("next")).join(per, group)
    drawn = ranked.where(F.col("k") == F.least(rank, F.col("n")))
    spread = F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(1.0)
    margin, small = F.greatest(spread * 0.1, F.lit(0.01)), F.greatest(spread * 0.04, F.lit(0.005))
    down = direction == "lower"
    if mode == "empty":
        t = F.col("lo") - margin if down else F.col("hi") + margin
    elif mode == "near":
        t = F.col("v") + small if down else F.col("v") - small
    else:
        t = F.when(F.col("n") >= 2, (F.col("v") + F.col("next")) / 2).otherwise(F.col("lo") + margin if down else F.col("hi") - margin)
    chosen = drawn.select(group, F.round(t, 6).alias("t"))
    on = v.select(
        group,
        F.round("v", 6).alias("t"),
        F.col("v").alias("_v")
    ).where(F.abs(F.col("_v") - F.col("t")) <= 1e-9).select(group, "t", F.lit(True).alias("_on")).distinct()
    return chosen.join(on, [group, "t"], "left").select(
        group,
        F.when(F.col("_on"), F.round(F.col("t") + 1e-6, 6)).otherwise(F.col("t")).alias("threshold")
    )


def edge_tag(kind: str, n_answer: Column, n_universe: Column) -> Column:
    """The edge case that an answer shows, or null."""
    if kind == "tradeoff_summary":
        return F.when(n_answer == 1, "single_dominator").when(n_answer == n_universe, "no_domination")
    return F.when(n_answer == 0, "empty").when((n_answer > 1) & F.lit(kind != "threshold_filter"), "argmax_tie")


def best_questions(df: DataFrame, group: str, key: str, target: str, constraint: str, direction: str, mode: str, seed: int = 0) -> DataFrame:
    """A question of the best row under a constraint for each group, with its threshold, answer rows and edge tag.

    The constraint is to be low where the drawn direction says so, else high; its threshold comes from ``thresholds``.
    """
    from cellwise.operators import engine

    limit = thresholds(df, group, constraint, direction, mode, seed)
    rows = df.join(limit, group)
    v = engine.number(constraint)
    keep = rows.where(v < F.col("threshold") if direction == "lower" else v >= F.col("threshold"))
    won = engine.extremum(keep, target, "higher", [group])
    answer = won.groupBy(group).agg(F.array_sort(F.collect_list(key)).alias("answer"), F.count("*").alias("n_answer"))
    n = F.coalesce("n_answer", F.lit(0))
    tag = F.coalesce(F.lit("near_threshold" if mode == "near" else None), edge_tag("best_under_constraint", n, n))
    words = F.concat(
        F.lit(f"Which {key} has the highest {target} with {constraint} "),
        F.lit("under " if direction == "lower" else "of at least "),
        F.col("threshold").cast("string"),
        F.lit("?")
    )
    return limit.join(answer, group, "left").select(
        group,
        words.alias("question"),
        "threshold",
        F.coalesce("answer", F.array().cast(answer.schema["answer"].dataType)).alias("answer"),
        tag.alias("edge"),
        F.when(tag.isNotNull(), "hard").otherwise("easy").alias("difficulty")
    )


def _asked(limit: DataFrame, answer: DataFrame, group: str, words: Column, tag: Column) -> DataFrame:
    empty = F.array().cast(answer.schema["answer"].dataType)
    return limit.join(answer, group, "left").select(
        group,
        words.alias("question"),
        F.coalesce("answer", empty).alias("answer"),
        tag.alias("edge"),
        F.when(tag.isNotNull(), "hard").otherwise("easy").alias("difficulty")
    )


def filter_questions(df: DataFrame, group: str, key: str, metric: str, direction: str, mode: str, seed: int = 0) -> DataFrame:
    """A question of all rows beyond a drawn limit for each group, with its answer rows and edge tag."""
    from cellwise.operators import engine

    limit = thresholds(df, group, metric, direction, mode, seed)
    v = engine.number(metric)
    won = df.join(limit, group).where(v < F.col("threshold") if direction == "lower" else v >= F.col("threshold"))
    answer = won.groupBy(group).agg(F.array_sort(F.collect_list(key)).alias("answer"), F.count("*").alias("n_answer"))
    n = F.coalesce("n_answer", F.lit(0))
    tag = F.coalesce(edge_tag("threshold_filter", n, n), F.lit("near_threshold" if mode == "near" else None))
    words = F.concat(
        F.lit(f"Which {key}s have {metric} "),
        F.lit("under " if direction == "lower" else "of at least "),
        F.col("threshold").cast("string"),
        F.lit("?")
    )
    return _asked(limit, answer, group, words, tag)


def tradeoff_questions(df: DataFrame, group: str, key: str, m1: str, m2: str, d1: str, d2: str) -> DataFrame:
    """A question of the frontier of two measures for each group, with its rows; the edge tag compares it with all rows that take part."""
    from cellwise.operators import engine

    able = df.where(engine.number(m1).isNotNull() & engine.number(m2).isNotNull()).groupBy(group).agg(F.count("*").alias("n_able"))
    answer = engine.pareto(df, m1, m2, d1, d2, [group]).groupBy(group).agg(
        F.array_sort(F.collect_list(key)).alias("answer"),
        F.count("*").alias("n_answer")
    )
    words = F.lit(f"What is the trade-off between {m1} and {m2} across these {key}s?")
    return _asked(able, answer, group, words, edge_tag("tradeoff_summary", F.coalesce("n_answer", F.lit(0)), F.col("n_able")))


def extremum_questions(df: DataFrame, group: str, key: str, target: str, direction: str) -> DataFrame:
    """A question of the extreme row of each group, with its answer rows and edge tag."""
    from cellwise.operators import engine

    answer = engine.extremum(df, target, direction, [group]).groupBy(group).agg(
        F.array_sort(F.collect_list(key)).alias("answer"),
        F.count("*").alias("n_answer")
    )
    words = F.lit(f"Which {key} has the {'highest' if direction == 'higher' else 'lowest'} {target}?")
    return _asked(df.select(group).distinct(), answer, group, words, edge_tag("extremum", F.coalesce("n_answer", F.lit(0)), F.lit(0)))
