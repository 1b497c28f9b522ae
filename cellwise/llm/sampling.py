"""A balanced sample whose share of each category matches targets: the cube method, distributed.

Each unit starts with its inclusion probability. The flight phase moves these probabilities inside the cube, keeping the
balancing totals (here one per category), until almost all are 0 or 1. It runs in each partition for itself; what a
partition can't resolve, at most one unit per category and one more, moves to the next level, where the rests of many
partitions fly together, and so on up to one small rest. The landing phase resolves that by giving up one balancing
constraint after the other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellwise.session import materialize

#: Partitions whose rests fly together on the next level.
FAN_IN = 64
#: Units that fly in one block of the first level, which is what a task holds.
BLOCK_UNITS = 20_000
EPS = 1e-9


def _apart(pi: np.ndarray, c: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The flight phase where each unit counts for one constraint only (``c``, -1 for none), by value ``pi``.

    Two units of one constraint span a null direction by themselves, so that a step moves a pair and solves nothing.
    """
    p, draw = pi.tolist(), rng.random(2 * len(pi)).tolist()
    held: dict[int, int] = {}
    for i, k in enumerate(c.tolist()):
        if not EPS < p[i] < 1 - EPS:
            continue
        if k < 0:
            p[i] = float(draw.pop() < p[i])
            continue
        j = held.pop(k, None)
        if j is None:
            held[k] = i
            continue
        up, down = min(1 - p[i], p[j]), min(p[i], 1 - p[j])  # the first of the pair rises, or falls
        move = up if draw.pop() < down / (up + down) else -down
        for at, v in ((i, p[i] + move), (j, p[j] - move)):
            p[at] = 0.0 if v < EPS else 1.0 if v > 1 - EPS else v
            if 0 < p[at] < 1:
                held[k] = at
    return np.array(p)


def flight(pi: np.ndarray, x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The flight phase: probabilities moved to 0 or 1 while ``x / pi`` keeps its totals. ``x`` has a row for each unit.

    Units enter in their order; at most one more than there are constraints are in the air at a time, so that each step
    costs the same, however many units there are.
    """
    p = np.clip(pi.astype(float), 0, 1)
    ratio = np.where(p[:, None] > EPS, x / np.maximum(p[:, None], EPS), 0.0)
    if x.shape[1] and ((ratio > EPS).sum(axis=1) <= 1).all() and np.allclose(ratio[ratio > EPS], 1.0):  # indicators of disjoint categories
        return _apart(p, np.where((ratio > EPS).any(axis=1), ratio.argmax(axis=1), -1), rng)
    waiting = [i for i in range(len(p)) if EPS < p[i] < 1 - EPS][::-1]
    air: list[int] = []
    room = x.shape[1] + 1
    while True:
        while waiting and len(air) < room:
            air.append(waiting.pop())
        if not air:
            return p
        a = ratio[air].T
        _, s, vt = np.linalg.svd(a, full_matrices=True)
        rank = int((s > 1e-8).sum())
        if rank >= len(air):
            return p
        u = vt[-1]
        now = p[air]
        with np.errstate(divide="ignore", invalid="ignore"):
            up = np.min(np.where(u > EPS, (1 - now) / u, np.where(u < -EPS, -now / u, np.inf)))
            down = np.min(np.where(u > EPS, now / u, np.where(u < -EPS, (now - 1) / u, np.inf)))
        now = now + (up if rng.random() < down / (up + down) else -down) * u
        now = np.where(now < EPS, 0.0, np.where(now > 1 - EPS, 1.0, now))
        p[air] = now
        air = [i for i, v in zip(air, now) if 0 < v < 1]


def land(pi: np.ndarray, x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The landing phase: constraints are given up from the last until every unit is in or out."""
    p = np.where(np.abs(pi - np.round(pi)) < 1e-6, np.round(pi), pi)
    for k in range(x.shape[1], -1, -1):
        if not ((p > EPS) & (p < 1 - EPS)).any():
            break
        p = flight(p, x[:, :k] if k else np.zeros((len(p), 0)), rng) if k else np.where((p > EPS) & (p < 1 - EPS), rng.random(len(p)) < p, p)
        p = np.where(np.abs(p - np.round(p)) < 1e-6, np.round(p), p)
    return p


def category_of(label: Column) -> Column:
    """A category's name in lower case, trimmed, with ``_`` for blanks and hyphens."""
    return F.regexp_replace(F.lower(F.regexp_replace(label, r"(?U)^\s+|\s+$", "")), r"(?U)[\s-]", "_")


def frame(cards: DataFrame, keys: DataFrame, targets: DataFrame, id_col: str, label_col: str) -> tuple[DataFrame, DataFrame]:
    """The units that can be drawn (``unit``, ``category``), and per target category what is needed and available.

    A unit is a distinct id that stands in both tables and has a target category; of an id with several, the first by
    name counts. Cards without category, without key or of categories nobody asked for are no units. The sample has a
    quarter of all units; a category needs the larger of its minimum and its share.
    """
    wanted = targets.select(
        category_of(F.col("category")).alias("category"),
        F.col("share_pct").cast("double").alias("share_pct"),
        F.col("min_cards").cast("bigint").alias("min_cards")
    ).where("category is not null")
    units = (
        cards.select(F.col(id_col).alias("unit"), category_of(F.col(label_col)).alias("category")).where("unit is not null and category is not null")
        .join(F.broadcast(wanted.select("category")), "category", "left_semi")
        .groupBy("unit").agg(F.min("category").alias("category"))
        .join(keys.select(F.col(id_col).alias("unit")).where("unit is not null").distinct(), "unit", "left_semi")
    )
    units = materialize(units, "units")
    by = units.groupBy("category").agg(F.count("*").alias("n_available"))
    n_sample = units.agg(F.floor(F.count("*") / 4)).scalar()  # a subquery of one number
    need = (
        wanted.withColumn("n_sample", n_sample).join(by, "category", "left")
        .select(
            "category",
            "share_pct",
            "min_cards",
            "n_sample",
            F.coalesce("n_available", F.lit(0)).cast("bigint").alias("n_available"),
            F.greatest(F.col("min_cards"), F.floor(F.col("n_sample") * F.col("share_pct") / 100 + 1e-9)).cast("bigint").alias("n_needed")
        )
    )
    return units, need


def cube_sample(units: DataFrame, need: DataFrame, seed: int = 7) -> DataFrame:
    """``unit``, ``category`` of the units drawn. ``need`` is small, one row for each category."""
    rows = need.where("n_available > 0").orderBy("category").collect()  # bounded by the target table
    order = [r["category"] for r in rows]
    chance = {r["category"]: min(1.0, r["n_needed"] / r["n_available"]) for r in rows}
    schema = "unit bigint, category string, p double, done boolean"

    def fly(last: bool, level: int):  # noqa: ANN202
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            got = [b for b in batches if len(b)]
            if not got:
                return
            pdf = pd.concat(got)
            key = pd.util.hash_array(pdf["unit"].to_numpy(np.int64), categorize=False)
            pdf = pdf.iloc[np.argsort(key, kind="stable")].reset_index(drop=True)
            rng = np.random.default_rng([seed, level, int(key.min() % (1 << 31))])
            p = pdf["p"].to_numpy(float) if "p" in pdf else pdf["category"].map(chance).to_numpy(float)
            x = np.zeros((len(pdf), len(order)))
            x[np.arange(len(pdf)), pdf["category"].map({c: i for i, c in enumerate(order)}).to_numpy(int)] = 1.0
            x = x * p[:, None]
            p = land(flight(p, x, rng), x, rng) if last else flight(p, x, rng)
            pdf["p"], pdf["done"] = p, (p < EPS) | (p > 1 - EPS)
            yield pdf[["unit", "category", "p", "done"]]

        return run

    blocks = max(1, -(-units.count() // BLOCK_UNITS))
    flown = materialize(units.repartition(blocks, F.xxhash64("unit")).mapInPandas(fly(False, 0), schema), "flight")
    drawn = [flown.where("done and p > 0.5")]
    level = 1
    while True:
        rest = flown.where("not done").select("unit", "category", "p")
        blocks = -(-blocks // FAN_IN)
        last = blocks == 1
        flown = materialize(
            (rest.coalesce(1) if last else rest.repartition(blocks, F.xxhash64("unit"))).mapInPandas(fly(last, level), schema),
            "flight"
        )
        drawn.append(flown.where("done and p > 0.5"))
        if last:
            break
        level += 1
    out = drawn[0]
    for d in drawn[1:]:
        out = out.unionAll(d)
    return out.select("unit", "category")


def balanced_sample(
    cards: DataFrame,
    keys: DataFrame,
    targets: DataFrame,
    id_col: str = "card_id",
    label_col: str = "type",
    seed: int = 7
) -> tuple[DataFrame, DataFrame]:
    """The sample (``unit``, ``category``), and a report per target category.

    The report has the units ``n_available``, ``n_needed`` and ``n_drawn``, the ``residual`` (drawn less needed) and
    whether the category is ``filled``. A category with fewer units than it needs gives all it has. Empty tables give an
    empty sample, and a report in which only categories that need nothing are filled.
    """
    units, need = frame(cards, keys, targets, id_col, label_col)
    sample = cube_sample(units, need, seed)
    drawn = sample.groupBy("category").agg(F.count("*").alias("n_drawn"))
    report = need.join(drawn, "category", "left").withColumn("n_drawn", F.coalesce("n_drawn", F.lit(0)).cast("bigint"))
    return sample, report.withColumn("residual", F.col("n_drawn") - F.col("n_needed")).withColumn("filled", F.col("n_drawn") >= F.col("n_needed"))
