"""Joins in which one key may hold a large part of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cellwise.session import materialize

#: A key with more than this share of the rows is hot; there are at most 1 / HOT of these. Each is split into SALTS parts.
HOT, SALTS = 1e-3, 64


def hot_keys(rows: DataFrame, key: str, share: float = HOT) -> DataFrame:
    """``key`` of the values that more than ``share`` of the rows carry: at most 1 / share, counted in one pre-aggregated pass."""
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
    whole = counts.agg(F.sum("_n")).scalar()  # a subquery of one number
    return counts.where(F.col("_n") > F.greatest(F.lit(1.0), share * whole)).select(key)


def salted_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    spread: Column,
    how: str = "inner",
    *,
    hot: DataFrame | None = None,
    share: float = HOT,
    salts: int = SALTS
) -> DataFrame:
    """``left`` joined with ``right`` on ``key`` (inner or left), hot keys of ``left`` split over ``salts`` tasks.

    ``spread`` tells the rows of a hot key apart. Rows of ``right`` with a hot key, expected to be few, are given to each of
    its parts. Only the list of hot keys is broadcast, at most 1 / share values.
    """
    hot = F.broadcast((hot if hot is not None else hot_keys(left, key, share)).select(key).withColumn("_hot", F.lit(True)))
    parts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    big = left.withColumn("_spread", spread).join(hot, key, "left").withColumn(
        "_salt",
        F.when(F.col("_hot"), F.pmod(F.xxhash64("_spread"), F.lit(salts)).cast("int")).otherwise(0)
    ).drop("_hot", "_spread")
    small = right.join(hot, key, "left").withColumn("_salt", F.explode(parts)).drop("_hot")
    return big.join(small, [key, "_salt"], how).drop("_salt")


def numbered(df: DataFrame, group: str, order: Sequence[Column], name: str) -> DataFrame:
    """``df`` with ``name``: the place of each row within its group by ``order``, from 1; groups of any size.

    The rows are partitioned by ranges of group and order, so that a large group lies in many partitions, and written
    (which runs when the plan is built). Each partition numbers its own rows; what lies before it in its group is added
    from the counts, of which there are no more than partitions and groups together.
    """
    ranged = materialize(df.repartitionByRange(group, *order).withColumn("_pid", F.spark_partition_id()), "ranged")
    local = ranged.withColumn("_k", F.row_number().over(Window.partitionBy("_pid", group).orderBy(*order)))
    sizes = ranged.groupBy("_pid", group).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(F.col("_pid").alias("_p"), F.col(group).alias("_g"), before.alias("_before"))
    placed = local.join(offsets, (F.col("_pid") == F.col("_p")) & F.col(group).eqNullSafe(F.col("_g")))
    return placed.select(*(f"`{c}`" for c in df.columns), (F.col("_k") + F.col("_before")).cast("int").alias(name))
