"""Matching of labels and values that differ a little, and answers of models read back as records."""

from __future__ import annotations

import difflib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellwise.functions.text import norm_words

CUTOFF = 0.85


def _ratio(a: str | None, b: str | None) -> float:
    return difflib.SequenceMatcher(None, a or "", b or "", autojunk=False).ratio()


def _grams(text: Column) -> Column:
    """The keys by which two labels with a similarity of CUTOFF must meet: trigrams, and bigrams of short labels.

    Of labels of n letters at least 0.85 n are matched, in no more blocks than there are letters left over and one, so
    that the longest block has three letters, or two in labels of fewer than eight.
    """
    n = F.length(text)
    cut = lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.substring(text, i, F.lit(k)))
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(F.when(n >= 8, cut(3)).otherwise(none), F.when((n >= 2) & (n <= 10), cut(2)).otherwise(none)))


def fuzzy_match(left: DataFrame, right: DataFrame, group: str, key: str, label: str, right_label: str) -> DataFrame:
    """``group``, ``key``, ``match``: the one label of the same group that equals or resembles a label.

    An exact match after normalisation wins if it is unique; otherwise the one label with a similarity of at least
    CUTOFF. Exact matches are an equi-join. What is left meets only the labels with which it shares letters in a row (see
    ``_grams``); of these, only pairs within the edit distance that the similarity allows are compared in Python.
    """
    l = left.select(group, key, norm_words(F.col(label)).alias("_a"))
    r = right.select(group, F.col(right_label).alias("_label"), norm_words(F.col(right_label)).alias("_b")).where("_label is not null").distinct()
    one = r.groupBy(group, F.col("_b").alias("_a")).agg(F.count("*").alias("_n"), F.min("_label").alias("_exact"))
    exact = l.join(one, [group, "_a"], "left")
    sure = exact.where("_n = 1").select(group, key, F.col("_exact").alias("match"))

    @F.pandas_udf(T.DoubleType())
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([_ratio(x, y) for x, y in zip(a, b)])

    rest = exact.where("_n is null and _a <> ''").select(group, key, "_a")
    asked = rest.select(group, "_a").distinct().withColumn("_g", F.explode(_grams(F.col("_a"))))
    known = r.select(group, "_b").distinct().withColumn("_g", F.explode(_grams(F.col("_b"))))
    whole = F.length("_a") + F.length("_b")
    pairs = asked.join(known, [group, "_g"]).where(2 * F.least(F.length("_a"), F.length("_b")) >= CUTOFF * whole).select(group, "_a", "_b").distinct()
    near = pairs.where(F.levenshtein("_a", "_b") <= whole - 2 * F.ceil(CUTOFF * whole / 2)).where(ratio("_a", "_b") >= CUTOFF)
    found = rest.join(near, [group, "_a"]).join(r, [group, "_b"]).groupBy(group, key).agg(
        F.count("*").alias("_n"),
        F.min("_label").alias("match")
    ).where("_n = 1").select(group, key, "match")
    return sure.unionByName(found)


def close(a: Column, b: Column) -> Column:
    """Whether two numbers are equal within a hundredth and half a percent."""
    return F.abs(a - b) <= 0.01 + 0.005 * F.greatest(F.abs(a), F.abs(b))


def chain_match(values: Column, cells: Column) -> Column:
    """For each value, in order, the place of the first cell that is close to it and not yet taken; null if one has none.

    ``values`` and ``cells`` are arrays of numbers; the greedy pass is one fold within the row.
    """
    free = lambda acc: F.filter(
        F.transform(cells, lambda c, i: F.named_struct(F.lit("c"), c, F.lit("i"), i)),
        lambda x: ~F.array_contains(acc, x["i"])
    )
    step = lambda acc, v: F.when(acc.isNull(), acc).otherwise(
        F.when(
            F.size(F.filter(free(acc), lambda x: close(x["c"], v))) > 0,
            F.concat(acc, F.array(F.get(F.transform(F.filter(free(acc), lambda x: close(x["c"], v)), lambda x: x["i"]), F.lit(0))))
        )
    )
    return F.aggregate(values, F.array().cast("array<int>"), step)


CITE = "struct<row:int,col_name:string,value:string>"
ANSWER = f"trace_steps array<struct<kind:string,description:string,cites:array<{CITE}>>>, final_answer struct<label:string,rows:array<int>,metrics:array<string>>"


def cell(c: Column, headers: Column) -> Column:
    """A citation with its column filled in from the name."""
    at = F.nullif(F.array_position(headers, c["col_name"]) - 1, F.lit(-1)).cast("int")
    return F.named_struct(F.lit("row"), c["row"], F.lit("col"), at, F.lit("col_name"), c["col_name"], F.lit("value"), c["value"])


def reconstruct(answer: Column, headers: Column) -> Column:
    """A model's JSON answer as steps, answer and distinct evidence cells; columns are filled in from their names.

    Null where the answer is no JSON with steps.
    """
    a = F.from_json(answer, ANSWER)
    none = F.array().cast("array<struct<row:int,col:int,col_name:string,value:string>>")
    cites = F.flatten(F.transform(a["trace_steps"], lambda s: F.coalesce(F.transform(s["cites"], lambda c: cell(c, headers)), none)))
    return F.when(
        a["trace_steps"].isNotNull(),
        F.struct(a["trace_steps"].alias("trace_steps"), a["final_answer"].alias("final_answer"), F.array_distinct(cites).alias("evidence_cells"))
    )


def rebuild(answers: DataFrame, key: str, raw: str, source: str) -> DataFrame:
    """``key``, ``example_id``, ``record``, ``error``: answers of a model read back as records of their source.

    ``source`` is the name of a struct column with ``table``, ``metadata.example_id``. The rebuilt record's id has the
    suffix ``_llm``; an answer without an object, or whose object has no steps, gives the error and no record.
    """
    from cellwise.operators.records import first_object

    text = first_object(F.col(raw))
    a = reconstruct(text, F.col(f"{source}.table.headers"))
    out = answers.select(
        F.col(key),
        F.concat(F.col(f"{source}.metadata.example_id"), F.lit("_llm")).alias("example_id"),
        a.alias("record"),
        text.isNull().alias("_none")
    )
    return out.select(key, "example_id", "record", F.when(F.col("_none"), "no object").when(F.col("record").isNull(), "no steps").alias("error"))


def render(prompts: DataFrame, key: str, prompt: str, generate: Callable[[str], str]) -> DataFrame:
    """``key``, ``raw``, ``error`` of a generator called on each prompt; what it raises is kept as the row's error."""

    def run(batches):  # noqa: ANN001, ANN202
        for pdf in batches:
            raw, error = [], []
            for p in pdf[prompt]:
                try:
                    raw.append(generate(p))
                    error.append(None)
                except Exception as e:  # noqa: BLE001
                    raw.append(None)
                    error.append(f"{type(e).__name__}: {e}")
            yield pd.DataFrame({key: pdf[key], "raw": raw, "error": error})

    kind = prompts.schema[key].dataType.simpleString()
    return prompts.select(key, prompt).mapInPandas(run, f"`{key}` {kind}, raw string, error string")
