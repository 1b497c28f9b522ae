"""Train, validation and test splits that keep related records together.

Records and the entities that they name (base table, filing) form a bipartite graph. The lowest label of each entity's
neighbours is propagated, entity to entity over the records, each label is also handed to the entity
that the old label names, and labels take over the label of the entity they name, so that long chains fold up in a number
of rounds that grows with the logarithm of their length. When no label changes, a component carries one label. Whole
components are assigned to splits so that the splits' sizes and their distributions over a stratum come as near to the
targets as they can. Hubs, hot tables and giant components are split over many tasks wherever they are joined.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellwise.operators.skew import hot_keys, salted_join
from cellwise.session import discard, materialize

#: Components with more than this share of all records are placed first, by one greedy pass; there are at most 1 / LARGE.
LARGE = 1e-3
#: Components that one block of the greedy assignment holds.
BLOCK = 20_000
#: Strata that are balanced each for itself, the most frequent ones; what is beyond them is balanced as one.
STRATA = 1_000


def base_table(table_id: Column) -> Column:
    """``table_id`` in lower case, trimmed, with ``_`` for hyphens, without an ending ``_v2`` and then ``_rows`` or ``_cols``."""
    name = F.regexp_replace(F.lower(F.regexp_replace(table_id, r"(?U)^\s+|\s+$", "")), "-", "_")
    return F.regexp_replace(F.regexp_replace(name, "_v2$", ""), "_(rows|cols)$", "")


def links(records: DataFrame, id_col: str, table_col: str, entity_col: str, stratum_col: str, split_col: str) -> DataFrame:
    """``rec_id``, ``base_table``, ``entity``, ``stratum``, ``split`` of each record: the edges of the graph."""
    clean = lambda c: F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))
    entity = F.regexp_replace(F.col(entity_col), r"(?U)^\s+|\s+$", "")
    return records.select(
        F.col(id_col).alias("rec_id"),
        base_table(F.col(table_col)).alias("base_table"),
        F.when(entity != "", entity).alias("entity"),
        F.coalesce(clean(F.col(stratum_col)), F.lit("(none)")).alias("stratum"),
        F.when(clean(F.col(split_col)) != "", clean(F.col(split_col))).alias("split")
    )


def _nodes() -> tuple[Column, Column]:
    return F.xxhash64(F.lit("t"), F.col("base_table")), F.xxhash64(F.lit("e"), F.col("entity"))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node`` (digest of a base table or an entity) and ``label``, the same for all nodes of a component.

    Each round runs when it is reached and is written to the shared folder; the files of the round before are deleted.
    """
    t, u = _nodes()
    pairs = materialize(edges.where("base_table is not null and entity is not null").select(t.alias("a"), u.alias("b")).distinct(), "edges")
    both = pairs.select(F.col("a").alias("node"), F.col("b").alias("near")).unionAll(pairs.select(F.col("b").alias("node"), F.col("a").alias("near")))
    hubs = materialize(hot_keys(both, "near"), "hubs")
    labels = both.select("node", F.col("node").alias("label")).distinct()
    before = None
    for _ in range(max_rounds):
        reach = salted_join(
            both,
            labels.withColumnRenamed("node", "near"),
            "near",
            F.col("node"),
            hot=hubs
        ).groupBy("node").agg(F.min("label").alias("low"))
        seen = labels.join(reach, "node")
        # what a node sees goes to the node and to the entity whose label it carries, so that whole trees are hung over
        lower = seen.select("node", "low").unionAll(seen.select(F.col("label").alias("node"), "low")).groupBy("node").agg(F.min("low").alias("low"))
        hung = materialize(labels.join(lower, "node").select("node", "label", F.least("label", "low").alias("new")), "labels")
        ahead = hung.select(F.col("node").alias("new"), F.col("new").alias("jump"))
        jumped = materialize(
            salted_join(hung, ahead, "new", F.col("node"), "left").select("node", "label", F.least("new", F.coalesce("jump", "new")).alias("new")),
            "labels"
        )
        for old in (hung, before):
            if old is not None:
                discard(old)
        labels, before = jumped.select("node", F.col("new").alias("label")), jumped
        if jumped.where("new <> label").isEmpty():
            discard(pairs)
            return labels
    raise RuntimeError(f"labels still change after {max_rounds} rounds")


def members(edges: DataFrame) -> DataFrame:
    """``rec_id``, ``base_table``, ``stratum``, ``delivered`` (its split) and ``component`` of every row of ``edges``."""
    t, u = _nodes()
    own = F.when(F.col("base_table").isNotNull(), t).when(F.col("entity").isNotNull(), u).otherwise(F.xxhash64(F.lit("r"), F.col("rec_id")))
    recs = edges.select("rec_id", "base_table", "stratum", F.col("split").alias("delivered"), own.alias("node"))
    labelled = salted_join(recs, components(edges), "node", F.col("rec_id"), "left")
    return materialize(labelled.select("rec_id", "base_table", "stratum", "delivered", F.coalesce("label", "node").alias("component")), "members")


def broken_tables(recs: DataFrame) -> DataFrame:
    """``base_table`` of the base tables whose records, as ``members`` labels them, were delivered in more than one split.

    The delivered splits are put beside the propagated labels: components all of one split are whole, and in the others
    each base table is looked at. A null split is no split; a null table is no case. Everything is pre-aggregated by
    component and table, so that a table with a third of all rows moves no more than any other.
    """
    per = recs.where("base_table is not null and delivered is not null").groupBy("component", "base_table").agg(
        F.min("delivered").alias("low"),
        F.max("delivered").alias("high")
    )
    mixed = per.groupBy("component").agg(F.min("low").alias("_low"), F.max("high").alias("_high")).where("_low <> _high").select("component")
    return per.where("low <> high").join(mixed, "component", "left_semi").select("base_table").distinct()


def _place(counts: np.ndarray, have: np.ndarray, want: np.ndarray) -> np.ndarray:
    """The split of each component (rows of ``counts`` by stratum), largest first, each where the deviation grows least."""
    choice = np.empty(len(counts), dtype=int)
    scale = 1.0 / np.maximum(want, 1.0)
    whole = 1.0 / np.maximum(want.sum(axis=1), 1.0)
    for i in np.argsort(-counts.sum(axis=1), kind="stable"):
        c = counts[i]
        gap = have - want
        cost = ((2 * gap * c + c * c) * scale).sum(axis=1) + (2 * gap.sum(axis=1) * c.sum() + c.sum() ** 2) * whole
        s = int(np.argmin(cost))
        have[s] += c
        choice[i] = s
    return choice


def assign(recs: DataFrame, targets: DataFrame) -> DataFrame:
    """``rec_id``, ``component``, ``stratum``, ``split`` for every row of ``members``; ``targets`` has ``split_name`` and ``share``."""
    total = recs.count()
    often = recs.groupBy("stratum").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "stratum").limit(STRATA).collect()
    strata = {r["stratum"]: r["n"] for r in often}
    sized = recs
    if len(strata) == STRATA and sum(strata.values()) < total:
        sized = recs.join(
            F.broadcast(recs.sparkSession.createDataFrame([(k, True) for k in strata], "stratum string, _often boolean")),
            "stratum",
            "left"
        ).withColumn("stratum", F.when(F.col("_often"), F.col("stratum")).otherwise("(other)"))
        strata["(other)"] = total - sum(n for k, n in strata.items() if k != "(other)")
    sizes = sized.groupBy("component", "stratum").agg(F.count("*").alias("n"))
    per = materialize(
        sizes.groupBy("component").agg(F.map_from_entries(F.collect_list(F.struct("stratum", "n"))).alias("by"), F.sum("n").alias("n")),
        "components"
    )
    names = sorted(strata)
    goal = targets.where("split_name is not null and share > 0").groupBy("split_name").agg(F.sum("share").alias("share")).orderBy(F.desc("share"), "split_name").collect()
    splits = [r["split_name"] for r in goal]
    share = np.array([r["share"] for r in goal], dtype=float)
    schema = "component bigint, split string"
    if not names or not splits:
        return recs.select("rec_id", "component", "stratum", F.lit(None).cast("string").alias("split"))
    want = (share / share.sum())[:, None] * np.array([strata[k] for k in names], dtype=float)
    matrix = lambda rows: np.array([[dict(by or ()).get(k, 0) for k in names] for by in rows], dtype=float).reshape(-1, len(names))
    large = per.where(F.col("n") > max(1.0, LARGE * total)).orderBy(F.desc("n"), "component").collect()  # at most 1 / LARGE
    have = np.zeros_like(want)
    placed = _place(matrix([r["by"] for r in large]), have, want) if large else []
    first = F.broadcast(recs.sparkSession.createDataFrame([(r["component"], splits[s]) for r, s in zip(large, placed)], schema))  # at most 1 / LARGE
    small = per.where(F.col("n") <= max(1.0, LARGE * total))
    n_small = small.count()
    blocks = max(1, -(-n_small // BLOCK))
    left = np.maximum(want - have, 0.0)
    left_share = left / np.maximum(left.sum(axis=0, keepdims=True), 1e-9)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("component").reset_index(drop=True)
        counts = matrix(pdf["by"])
        choice = _place(counts, np.zeros_like(want), left_share * counts.sum(axis=0))
        return pd.DataFrame({"component": pdf["component"], "split": [splits[s] for s in choice]})

    rest = small.select("component", "by", F.pmod(F.xxhash64("component"), F.lit(blocks)).alias("block")).groupBy("block").applyInPandas(run, schema)
    plain = recs.select("rec_id", "component", "stratum")
    # large components meet a broadcast list; none of the others is hot
    return plain.join(first, "component").unionByName(
        plain.join(first, "component", "left_anti").join(rest, "component")
    ).select("rec_id", "component", "stratum", "split")


def grouped_splits(
    records: DataFrame,
    targets: DataFrame,
    id_col: str,
    table_col: str,
    entity_col: str,
    stratum_col: str,
    split_col: str
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Every record with its new split, a report by split and stratum, and the base tables that the delivered split breaks.

    Records of one base table or one entity, and all that these connect, come out in one split. A record without both
    stands for itself. Repeated ids each get the split of their component; a null stratum is a stratum of its own. An
    empty table gives empty results; without targets every split is null.
    """
    recs = members(links(records, id_col, table_col, entity_col, stratum_col, split_col))
    assigned = materialize(assign(recs, targets), "assigned")
    wanted = targets.where("split_name is not null and share > 0").groupBy(F.col("split_name").alias("split")).agg(F.sum("share").alias("share"))
    wanted = wanted.withColumn("all", F.expr("sum(share) over ()")).select("split", (F.col("share") / F.col("all")).alias("target_share"))
    per = assigned.groupBy("split", "stratum").agg(F.count("*").alias("n_records"))
    whole = per.groupBy("stratum").agg(F.sum("n_records").alias("n_stratum"))
    report = per.join(whole, "stratum").join(F.broadcast(wanted), "split").select(
        "split",
        "stratum",
        "n_records",
        F.round(F.col("n_records") / F.col("n_stratum"), 6).alias("share"),
        F.round("target_share", 6).alias("target_share"),
        F.round(F.col("n_records") / F.col("n_stratum") - F.col("target_share"), 6).alias("deviation")
    )
    return assigned, report, broken_tables(recs)
