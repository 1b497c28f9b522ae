"""Orders, samples, splits and votes. Draws come from digests of a seed and an id, so that they are the same on every run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cellwise.operators.skew import numbered


def draw(seed: int | str, key: str | Column) -> Column:
    """A digest by which rows are put in random, repeatable order."""
    k = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}:"), k.cast("string")))


def round_robin(df: DataFrame, group: str, order: Sequence[Column], first: Sequence[Column] = ()) -> DataFrame:
    """``df`` with ``turn`` (its place within its group): sorted by turn and group, the groups alternate. Groups may be of any size."""
    return numbered(df, group, [*first, *order], "turn")


def stratified_sample(df: DataFrame, group: str, key: str, n: int, seed: int | str = 0) -> DataFrame:
    """``n`` rows of each group, drawn at random; all of a smaller group."""
    w = Window.partitionBy(group).orderBy(draw(seed, key), key)
    return df.withColumn("_n", F.row_number().over(w)).where(f"_n <= {n}").drop("_n")


def hash_split(df: DataFrame, key: str, share: float, seed: int | str = 0) -> DataFrame:
    """``df`` with ``part``: eval for about ``share`` of the ids, train for the others."""
    return df.withColumn(
        "part",
        F.when(F.conv(F.substring(draw(seed, key), 1, 6), 16, 10).cast("bigint") < int(share * 16**6), "eval").otherwise("train")
    )


def freeze_splits(tables: DataFrame, key: str, n_test: int, n_dev: int, seed: int | str = 0) -> DataFrame:
    """``key``, ``role`` of the distinct tables in random order: test, then dev, then pool.

    Only the reserved tables are ordered, by a distributed top-n; the others are the rest of an anti-join.
    """
    ids = tables.select(key).where(F.col(key).isNotNull()).distinct()
    top = ids.orderBy(draw(seed, key), key).limit(n_test + n_dev)
    ranked = top.withColumn("_n", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(draw(seed, key), key)))  # n_test + n_dev rows
    reserved = ranked.select(key, F.when(F.col("_n") <= n_test, "test").otherwise("dev").alias("role"))
    return reserved.unionAll(ids.join(F.broadcast(reserved), key, "left_anti").withColumn("role", F.lit("pool")))


def majority(df: DataFrame, group: str, vote: str, order: str) -> DataFrame:
    """The vote that most rows of a group cast, of several the one cast first."""
    counts = df.where(F.col(vote).isNotNull()).groupBy(group, vote).agg(F.count("*").alias("n"), F.min(order).alias("_first"))
    best = counts.groupBy(group).agg(F.max(F.struct("n", (-F.col("_first").cast("double")).alias("f"), F.col(vote).alias("v"))).alias("x"))
    return best.select(group, F.col("x.v").alias(vote), F.col("x.n").alias("n"))


def grounded_majority(df: DataFrame, group: str, vote: str, order: str, grounded: str) -> DataFrame:
    """As ``majority`` among the grounded votes of each group; a group without one has the majority of all."""
    some = df.withColumn("_g", F.coalesce(F.col(grounded), F.lit(False))).where(F.col(vote).isNotNull())
    counts = some.groupBy(group, vote, "_g").agg(F.count("*").alias("n"), F.min(order).alias("_first"))
    all_ = counts.groupBy(group, vote).agg(
        F.sum("n").alias("n"),
        F.min("_first").alias("_first"),
        F.coalesce(F.sum(F.when(F.col("_g"), F.col("n"))), F.lit(0)).alias("k"),
        F.min(F.when(F.col("_g"), F.col("_first"))).alias("_kfirst")
    )
    place = F.when(
        F.col("k") > 0,
        F.struct(F.lit(1).alias("r"), F.col("k").alias("n"), (-F.col("_kfirst").cast("double")).alias("f"), F.col(vote).alias("v"))
    ).otherwise(F.struct(F.lit(0).alias("r"), F.col("n").alias("n"), (-F.col("_first").cast("double")).alias("f"), F.col(vote).alias("v")))
    return all_.groupBy(group).agg(F.max(place).alias("x")).select(group, F.col("x.v").alias(vote), F.col("x.n").alias("n"))


def unanimous(df: DataFrame, group: str, vote: str, ok: str, n: int) -> DataFrame:
    """Per group whether at least ``n`` rows agree in one vote and all are ok."""
    return df.groupBy(group).agg(
        (
            (F.count(vote) == F.count("*")) & (F.count("*") >= n) & (F.count_distinct(vote) == 1) & F.bool_and(F.coalesce(F.col(ok), F.lit(False)))
        ).alias("accepted")
    )


def latest(df: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """One row for each key: the last by ``order``, as a merge on resume keeps it."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")
