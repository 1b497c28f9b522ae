"""Answers that people gave to table questions, found again from the table alone.

A comparison chain written down beside an answer names the compared cells: where one row (for answers that are periods) or
one column of entities (for others) holds them all, the extreme among them is the answer. Without a chain, a question of
one of two known forms names a row and a direction. Everything is computed within the record.
"""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellwise.functions.text import SUPERLATIVE_HIGH, SUPERLATIVE_LOW, cell_number, chain_values, is_total, norm_words, superlative_direction, year_of
from cellwise.operators.matching import CUTOFF, chain_match
from cellwise.session import with_columns

_WORDS = "|".join(sorted((*SUPERLATIVE_HIGH, *SUPERLATIVE_LOW), key=len, reverse=True))
#: The two forms of a question for a period, as entity and superlative, and as superlative and entity.
FORM_A = r"(?i)in which (?:year|period|fiscal year)\b.*?\b(?:was|were|did|is|are|has|had)\b\s+(?:the\s+)?(?:amount\s+(?:for|of)\s+|value\s+(?:for|of)\s+)?(.+?)\s+(?:the\s+|at\s+(?:its|their)\s+)?(" + _WORDS + r")\b"
FORM_B = r"(?i)which (?:year|period|fiscal year)\b\s+(?:has|had|saw|recorded|reported)\s+(?:the\s+)?(" + _WORDS + r")\s+(.+?)\s*\??$"


def parsed_question(question: Column) -> Column:
    """``struct(entity, direction)`` of a question of one of the two forms; nulls for any other."""
    found = lambda form, k: F.nullif(F.regexp_extract(question, form, k), F.lit(""))
    entity, word = F.coalesce(found(FORM_A, 1), found(FORM_B, 2)), F.lower(F.coalesce(found(FORM_A, 2), found(FORM_B, 1)))
    plain = norm_words(F.regexp_replace(entity, r"(?i)\b(amount|value)\b", ""))
    return F.struct(
        plain.alias("entity"),
        F.when(word.isin(*SUPERLATIVE_HIGH), "higher").when(word.isin(*SUPERLATIVE_LOW), "lower").alias("direction")
    )


@F.pandas_udf(T.IntegerType())
def _closest(entity: pd.Series, labels: pd.Series) -> pd.Series:
    """The place of the one label that equals ``entity``, or resembles it most and is no other's; -1 for none."""

    def find(e: str | None, names: list[str] | None) -> int:
        names = [] if e is None or names is None else list(names)
        if e in names:
            return names.index(e) if names.count(e) == 1 else -1
        near = difflib.get_close_matches(e, names, n=1, cutoff=CUTOFF) if names else []
        return names.index(near[0]) if near and names.count(near[0]) == 1 else -1

    return pd.Series([find(e, n) for e, n in zip(entity, labels)])


def crosscheck(records: DataFrame, key: str, table: str, question: str, answer: str, derivation: str) -> DataFrame:
    """``key``, ``method`` (derivation, nl or null), ``ours``, ``agree``, ``trouble`` (ambiguous, row_unmatched or null).

    ``table`` is a clean table, ``answer`` an array of texts. Records that neither a chain nor a form reaches have the
    method null. Lists and texts may be null.
    """
    texts = F.array().cast("array<string>")
    r = records.select(
        F.col(key).alias("_k"),
        F.coalesce(f"{table}.headers", texts).alias("heads"),
        F.coalesce(f"{table}.rows", F.array().cast("array<array<string>>")).alias("cells"),
        F.coalesce(f"{table}.column_types", texts).alias("types"),
        F.coalesce(question, F.lit("")).alias("q"),
        F.coalesce(answer, texts).alias("said"),
        F.coalesce(derivation, F.lit("")).alias("chain")
    )
    r = with_columns(
        r,
        num=F.transform("cells", lambda row: F.transform(row, cell_number)),
        labels=F.transform("cells", lambda row: F.coalesce(F.get(row, F.lit(0)), F.lit(""))),
        vals=chain_values(F.col("chain")),
        way=superlative_direction(F.col("q")),
        years=F.array_distinct(F.array_compact(F.transform("said", year_of))),
        dated=(F.size("said") > 0) & F.forall("said", lambda s: F.coalesce(year_of(s).isNotNull(), F.lit(False))),
        nl=parsed_question(F.col("q"))
    )
    r = r.select(*(c for c in r.columns if c != "nl"), F.col("nl.entity").alias("entity"), F.col("nl.direction").alias("nl_way"))
    usable = F.coalesce((F.size("vals") >= 2) & F.col("way").isNotNull(), F.lit(False))
    # the numbers of each row, and of each numeric column without totals, with their places
    placed = lambda a: F.filter(a, lambda x: x["v"].isNotNull())
    by_row = F.transform(
        "num",
        lambda row, i: F.struct(
            i.alias("at"),
            placed(
                F.transform(F.slice(row, F.lit(2), F.greatest(F.size(row) - 1, F.lit(0))), lambda v, j: F.struct(v.alias("v"), (j + 1).alias("i")))
            ).alias("xs")
        )
    )
    columns = F.when(F.size("heads") > 1, F.sequence(F.lit(1), F.size("heads") - 1)).otherwise(F.array().cast("array<int>"))
    entity = F.filter(F.transform("labels", lambda x, i: F.when(~is_total(x), i)), lambda i: i.isNotNull())
    by_column = F.transform(
        F.filter(columns, lambda c: F.get("types", c) == "numeric"),
        lambda c: F.struct(
            c.alias("at"),
            placed(F.transform(entity, lambda i: F.struct(F.get(F.get("num", i), c).alias("v"), i.alias("i")))).alias("xs")
        )
    )
    r = with_columns(r, lines=F.when(usable, F.when(F.col("dated"), by_row).otherwise(by_column)), usable=usable)
    r = with_columns(
        r,
        hits=F.filter(
            F.transform(
                "lines",
                lambda x: F.struct(
                    x["at"].alias("at"),
                    x["xs"].alias("xs"),
                    chain_match(F.col("vals"), F.transform(x["xs"], lambda y: y["v"])).alias("m")
                )
            ),
            lambda x: x["m"].isNotNull()
        )
    )
    one = F.coalesce(F.size("hits") == 1, F.lit(False))
    compared = F.when(one, F.transform(F.get("hits", F.lit(0))["m"], lambda k: F.get(F.get("hits", F.lit(0))["xs"], k)))
    r = with_columns(r, compared=compared, one=one)
    # of equal values the first compared counts
    extreme = lambda xs, way: F.when(
        way == "higher",
        F.array_max(F.transform(xs, lambda x: x["v"]))
    ).otherwise(F.array_min(F.transform(xs, lambda x: x["v"])))
    first = lambda xs, way: F.get(F.filter(xs, lambda x: x["v"] == extreme(xs, way)), F.lit(0))["i"]
    r = with_columns(r, best=F.when(F.col("one"), first(F.col("compared"), F.col("way"))))
    period = year_of(F.get("heads", F.col("best")))
    name = norm_words(F.get("labels", F.col("best")))
    golds = F.transform("said", norm_words)
    alike = F.exists(golds, lambda g: (g == name) | ((g != "") & (name.contains(g) | g.contains(name))))
    chained = F.col("one")
    asked = F.when(~chained & F.col("entity").isNotNull() & (F.size("years") > 0), F.col("entity"))
    r = r.withColumn("row", _closest(asked, F.transform("labels", norm_words)))
    dated = F.filter(
        F.transform(
            columns,
            lambda c: F.struct(
                F.when((F.get("types", c) == "numeric") & year_of(F.get("heads", c)).isNotNull(), F.get(F.get("num", F.col("row")), c)).alias("v"),
                c.alias("i")
            )
        ),
        lambda x: x["v"].isNotNull()
    )
    some = F.exists(columns, lambda c: F.coalesce((F.get("types", c) == "numeric") & year_of(F.get("heads", c)).isNotNull(), F.lit(False)))
    r = with_columns(r, at=F.when(F.col("row") >= 0, dated), some=some, asked=asked)
    told = F.col("asked").isNotNull() & F.col("some") & (F.coalesce(F.size("at"), F.lit(0)) > 0)
    nl = year_of(F.get("heads", first(F.col("at"), F.col("nl_way"))))
    ours = F.when(F.col("one"), F.when(F.col("dated"), period).otherwise(name)).when(told, nl)
    agree = F.when(F.col("one"), F.when(F.col("dated"), F.array_contains("years", period)).otherwise(alike)).when(told, F.array_contains("years", nl))
    trouble = F.when(F.col("usable") & ~F.col("one"), "ambiguous").when(
        ~F.col("one") & F.col("asked").isNotNull() & F.col("some") & ~told,
        "row_unmatched"
    )
    return r.select(
        F.col("_k").alias(key),
        F.when(F.col("one"), "derivation").when(told, "nl").alias("method"),
        ours.alias("ours"),
        F.when(F.col("one") | told, F.coalesce(agree, F.lit(False))).alias("agree"),
        trouble.alias("trouble")
    )


def agreement(checked: DataFrame) -> DataFrame:
    """By method: how many answers were found again, and how many agree."""
    return checked.where("method is not null").groupBy("method").agg(F.count("*").alias("n"), F.count_if("agree").alias("n_agree"))
