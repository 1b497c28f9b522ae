"""Deeply nested records as related flat tables.

A merged schema is inferred over all records: records are typed rows, or JSON texts whose senders disagree on the shape.
Each array level then becomes a child table. Its rows carry the surrogate key of the record, the ordinal of every array
element on the way down, and its own ordinal; null elements keep their place.

For JSON texts the schema says where a list belongs. A list that was delivered as text, as a lone value or as an object
keyed by place is read as that list, and a record that lies inside another object is found by its fields.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellwise.session import materialize

#: The field that holds an element's place where lists were read from JSON texts.
PLACE, VALUE = "_place", "_value"
_KEYED = re.compile(r"\s*\d+\s*$")
_BRACKET = re.compile(r"\s*[\[{]")


def _merge(a: T.DataType | None, b: T.DataType | None) -> T.DataType:
    """The type that holds both: lists win over lone values, structs are united, numbers widen, anything else is text."""
    if a is None or isinstance(a, T.NullType):
        return b if b is not None else T.NullType()
    if b is None or isinstance(b, T.NullType) or a == b:
        return a
    if isinstance(a, T.ArrayType) or isinstance(b, T.ArrayType):
        x = a.elementType if isinstance(a, T.ArrayType) else a
        y = b.elementType if isinstance(b, T.ArrayType) else b
        return T.ArrayType(_merge(x, y))
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        names = [f.name for f in a] + [f.name for f in b if f.name not in a.names]
        pick = lambda s, n: s[n].dataType if n in s.names else None
        return T.StructType([T.StructField(n, _merge(pick(a, n), pick(b, n))) for n in names])
    if isinstance(a, T.StructType) or isinstance(b, T.StructType):  # an object delivered as text, here and there
        return a if isinstance(a, T.StructType) else b
    if {type(a), type(b)} == {T.LongType, T.DoubleType}:
        return T.DoubleType()
    return T.StringType()


def _opened(value: object) -> object:
    """``value``, or the list or object that it holds as text."""
    if isinstance(value, str) and _BRACKET.match(value):
        try:
            return _opened(json.loads(value))
        except (ValueError, RecursionError):
            return value
    return value


def _type_of(value: object) -> T.DataType:
    value = _opened(value)
    if value is None:
        return T.NullType()
    if isinstance(value, bool):
        return T.BooleanType()
    if isinstance(value, int):
        return T.LongType() if -(2**63) <= value < 2**63 else T.DoubleType()
    if isinstance(value, float):
        return T.DoubleType()
    if isinstance(value, list):
        out: T.DataType = T.NullType()
        for v in value:
            out = _merge(out, _type_of(v))
        return T.ArrayType(out)
    if isinstance(value, dict):
        if value and all(_KEYED.match(k) for k in value):  # a list keyed by place
            return _type_of(list(value.values()))
        return T.StructType([T.StructField(k, _type_of(v)) for k, v in value.items()])
    return T.StringType()


def whole_json(text: str | None) -> object | None:
    """What ``text`` holds if it is whole JSON, surrounding white space aside; None otherwise."""

    def refuse(name: str) -> None:
        raise ValueError(name)

    try:
        return json.loads(text, parse_constant=refuse) if text and text.strip() else None
    except (ValueError, RecursionError):
        return None


def inner_record(value: object, fields: tuple[str, ...]) -> dict | None:
    """The object nearest to the top that has most of ``fields``, in ``value`` or in an object, list or text inside it."""
    best, most, level = None, 0, [_opened(value)]
    while level:
        below: list[object] = []
        for v in level:
            if isinstance(v, dict):
                n = sum(f in v for f in fields)
                if n > most:
                    best, most = v, n
                below.extend(map(_opened, v.values()))
            elif isinstance(v, list):
                below.extend(map(_opened, v))
        if best is not None:
            return best
        level = [v for v in below if isinstance(v, (dict, list))]
    return best


def infer_schema(records: DataFrame, text_col: str, fields: tuple[str, ...]) -> T.StructType:
    """The merged schema of ``fields`` in all JSON texts of a column: one partial schema per partition, merged at last.

    What reaches the driver is as large as the schemas are, whatever the number of records.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: T.DataType = T.StructType([])
        for pdf in batches:
            for text in pdf[text_col]:
                if (rec := inner_record(whole_json(text), fields)) is not None:
                    out = _merge(out, _type_of({f: rec[f] for f in fields if f in rec}))
        yield pd.DataFrame({"schema": [json.dumps(out.jsonValue())]})

    merged: T.DataType = T.StructType([T.StructField(f, T.NullType()) for f in fields])
    for row in records.select(text_col).mapInPandas(run, "schema string").distinct().collect():
        merged = _merge(merged, T.StructType.fromJson(json.loads(row["schema"])))
    return _named(merged)


def _named(t: T.DataType) -> T.DataType:
    """``t`` with text for what is always null, and with each list's elements paired with their places."""
    if isinstance(t, T.NullType):
        return T.StringType()
    if isinstance(t, T.ArrayType):
        return T.ArrayType(T.StructType([T.StructField(PLACE, T.LongType()), T.StructField(VALUE, _named(t.elementType))]))
    if isinstance(t, T.StructType):
        return T.StructType([T.StructField(f.name, _named(f.dataType)) for f in t])
    return t


def number(value: object) -> float | int | None:
    """The number that ``value`` writes, in any notation; None for anything else."""
    if isinstance(value, bool) or value is None:
        return None
    if isinstance(value, str):
        try:
            value = float(value.strip().replace(",", "")) if not re.fullmatch(r"\s*[+-]?\d+\s*", value) else int(value)
        except ValueError:
            return None
    if isinstance(value, float):
        return None if not math.isfinite(value) else int(value) if value == int(value) else value
    return value if isinstance(value, int) else None


def conform(value: object, t: T.DataType) -> object:
    """``value`` in the shape of ``t``: what isn't a list where one belongs becomes one, and lists keep their places."""
    value = _opened(value) if isinstance(t, (T.ArrayType, T.StructType)) else value
    if value is None:
        return None
    if isinstance(t, T.ArrayType):
        inner = t.elementType[VALUE].dataType
        if isinstance(value, list):
            places = list(enumerate(value))
        elif isinstance(value, dict) and value and all(_KEYED.match(k) for k in value):
            places = sorted((int(k), v) for k, v in value.items())
        else:
            places = [(0, value)] if value != "" else []
        return [{PLACE: i, VALUE: conform(v, inner)} for i, v in places]
    if isinstance(t, T.StructType):
        return {f.name: conform(value[f.name], f.dataType) for f in t if f.name in value} if isinstance(value, dict) else None
    if isinstance(t, (T.LongType, T.DoubleType)):
        n = number(value)
        return n if n is None or isinstance(t, T.DoubleType) else int(n) if n == int(n) and abs(n) < 2**63 else None
    if isinstance(t, T.BooleanType):
        return value if isinstance(value, bool) else None
    return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def from_json_texts(records: DataFrame, text_col: str, fields: tuple[str, ...], schema: T.StructType | None = None) -> DataFrame:
    """``records`` with a column for each of ``fields`` instead of ``text_col``, in the merged schema.

    A text that is null or not whole JSON, or that holds no record, gives a row of nulls. The texts are parsed twice, once
    for the schema and once into a table that is written to the shared folder, both when the plan is built; whatever reads
    the columns reads that table.
    """
    schema = schema or infer_schema(records, text_col, fields)

    @F.pandas_udf(T.StringType())
    def shaped(texts: pd.Series) -> pd.Series:
        found = (inner_record(whole_json(t), fields) for t in texts)
        return pd.Series([None if r is None else json.dumps(conform(r, schema), ensure_ascii=False) for r in found], dtype=object)

    parsed = materialize(records.withColumn("_record", F.from_json(shaped(F.col(text_col)), schema)).drop(text_col), "parsed")
    return parsed.select(*(c for c in parsed.columns if c != "_record" and c not in fields), *(F.col(f"_record.`{f}`").alias(f) for f in fields))


def _element(t: T.ArrayType) -> tuple[T.DataType, bool]:
    e = t.elementType
    placed = isinstance(e, T.StructType) and e.names == [PLACE, VALUE]
    return (e[VALUE].dataType if placed else e), placed


def flatten(records: DataFrame, key: str, root: str = "record") -> dict[str, DataFrame]:
    """The flat tables of ``records``: ``root`` with the scalar fields, and one for each array level by its dotted path.

    Struct fields become columns with dotted names. Each child table has ``_key`` (the record's ``key``), ``_parent``
    (the path of the parent table), ``_ordinals`` (the places of the enclosing elements, outermost first), ``_place`` and
    the element's scalar fields, or ``value`` where the elements are scalars; the parent of a row is the row of
    ``_parent`` with the same key whose ordinals and place together are the row's ordinals. Null and empty arrays give no
    rows, a null element gives a row of nulls at its place. Keys are expected to be unique; rows that share one aren't
    merged. Each table is one narrow plan over the records, without a shuffle.
    """
    tables: dict[str, DataFrame] = {}

    def scalars(of: Column, t: T.StructType, name: str) -> tuple[list[Column], list[tuple[str, Column, T.ArrayType]]]:
        cols, arrays = [], []
        for f in t:
            c, path = of.getField(f.name), f"{name}.{f.name}" if name else f.name
            if isinstance(f.dataType, T.StructType):
                more, nested = scalars(c, f.dataType, path)
                cols += more
                arrays += nested
            elif isinstance(f.dataType, T.ArrayType):
                arrays.append((path, c, f.dataType))
            else:
                cols.append(c.alias(path))
        return cols, arrays

    def child(base: DataFrame, path: str, parent: str, array: Column, t: T.ArrayType) -> None:
        inner, placed = _element(t)
        if placed:
            rows = base.select("_key", F.col("_at").alias("_ordinals"), F.explode(array).alias("_e")).select(
                "_key",
                "_ordinals",
                F.col(f"_e.{PLACE}").alias("_place"),
                F.col(f"_e.{VALUE}").alias("_v")
            )
        else:
            rows = base.select(
                "_key",
                F.col("_at").alias("_ordinals"),
                F.posexplode(array).alias("_place", "_v")
            ).withColumn("_place", F.col("_place").cast("bigint"))
        head = [F.col("_key"), F.lit(parent).alias("_parent"), F.col("_ordinals"), F.col("_place")]
        below = rows.select("_key", F.concat("_ordinals", F.array("_place")).alias("_at"), "_v")
        if isinstance(inner, T.StructType):
            cols, arrays = scalars(F.col("_v"), inner, "")
            tables[path] = rows.select(*head, *cols)
            for name, c, at in arrays:
                child(below, f"{path}.{name}", path, c, at)
        elif isinstance(inner, T.ArrayType):
            tables[path] = rows.select(*head)
            child(below, f"{path}[]", path, F.col("_v"), inner)
        else:
            tables[path] = rows.select(*head, F.col("_v").alias("value"))

    cols: list[Column] = []
    base = records.select(
        F.col(key).alias("_key"),
        F.array().cast("array<bigint>").alias("_at"),
        F.struct(*(F.col(f"`{c}`") for c in records.columns if c != key)).alias("_v")
    )
    cols, arrays = scalars(F.col("_v"), base.schema["_v"].dataType, "")
    tables[root] = base.select("_key", *cols)
    for path, c, t in arrays:
        child(base, path, root, c, t)
    return tables


def cell_references(tables: dict[str, DataFrame], key: str = "rec_id") -> DataFrame:
    """``key``, ``path``, ``step_pos``, ``pos``, ``row_no`` of every cell reference with a whole row number, from the flat tables.

    Places and row numbers are 64-bit, so that none is lost to a narrow type.
    """
    parts = []
    for path, name, column in (("cite", "trace_steps.cites", "row"), ("evidence", "evidence_cells", "row"), ("gold", "gold_answer.rows", "value")):
        t = tables.get(name)
        if t is None or column not in t.columns:
            continue
        step = F.element_at("_ordinals", 1) if path == "cite" else F.lit(-1).cast("bigint")
        row = F.expr(f"try_cast(`{column}` as double)")
        row = F.when((row == F.floor(row)) & (F.abs(row) < 2.0**63), row.cast("bigint"))
        parts.append(
            t.select(
                F.col("_key").alias(key),
                F.lit(path).alias("path"),
                step.alias("step_pos"),
                F.col("_place").alias("pos"),
                row.alias("row_no")
            ).where("row_no is not null")
        )
    if not parts:
        return next(iter(tables.values())).sparkSession.createDataFrame(
            [],
            f"`{key}` bigint, path string, step_pos bigint, pos bigint, row_no bigint"
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def in_int(references: DataFrame) -> Column:
    """Whether a cell reference fits 32-bit places and row numbers."""
    return F.greatest("step_pos", "pos", F.abs("row_no")) < 2**31
