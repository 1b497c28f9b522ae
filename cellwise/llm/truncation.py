"""Detection of texts that lost their end: at a field's length limit, or at any place in mid-transfer.

1. Each text gets a verdict on its ending from the text alone: *complete* (whole JSON, balanced brackets and a known
   closing, a finished answer line), *incomplete* (brackets or a code fence left open, a broken character, a sentence that
   breaks off) or *ambiguous* (it may end here or not, such as prose after a full stop).
2. Per source, the discrete hazard of each length, texts that end here against texts at least as long, is tested against
   the hazard of the neighbouring lengths; Benjamini-Hochberg control within a source leaves the significant lengths,
   which are the limits at which that source cuts. Lengths are taken in characters and in bytes, with and without what was
   put after the break, over distinct texts: a stock answer that is given a thousand times is no limit.
3. Incomplete texts are found wherever they end; ambiguous ones only at a significant length of their source.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from cellwise.session import materialize

COMPLETE, AMBIGUOUS, INCOMPLETE = 0, 1, 2
#: Prose shorter than this is a stub, which need not be a sentence.
STUB_CHARS = 40
UNITS = ("chars", "bytes", "core_chars", "core_bytes")

_ADDED = re.compile(r"(?:\s*\n```|\s*…|\s*\.\.\.|\s*\[?(?:truncated|cut)\]?)\s*$", re.I)
_MARK = re.compile(r"""["'\\{}\[\]]""")
_LABEL = re.compile(r"(?:^|[\s*_])(?:final answer|answer|label|result)\s*[:=]\s*(?P<value>(?:(?![.!?] )[^\n])*)$", re.I)
_MONTH = r"(?:January|February|March|April|May|June|July|August|September|October|November|December)"
_PERIOD = re.compile(rf"(?:FY|CY)?(?:19|20)\d\d|[QH]\d (?:19|20)\d\d|{_MONTH} \d\d?, (?:19|20)\d\d|{_MONTH} (?:19|20)\d\d")
_PERIOD_CUT = re.compile(r"(?:FY|CY|F|C)?\d{0,3}|[QH]\d? ?\d{0,3}|[A-Z][a-z]{0,8}(?: \d{0,2}(?:,? ?\d{0,3})?)?")
_SENTENCE_END = re.compile(r"[.!?:][\"')\]*_`]*$")


def scan(text: str, start: int) -> tuple[int, bool, int]:
    """Brackets left open, whether a string is left open, and where the brackets were first closed again (or -1)."""
    single = text[start : start + 3].replace(" ", "").startswith(("{'", "['"))
    quote = "'" if single else '"'
    depth, inside, closed, escaped = 0, False, -1, -1
    for m in _MARK.finditer(text, start):
        i, c = m.start(), m.group()
        if i == escaped:
            continue
        if c == "\\":
            escaped = i + 1
        elif inside:
            if c == quote and (not single or not text[i + 1 : i + 2].isalnum()):
                inside = False
        elif c == quote:
            inside = True
        elif c in "{[":
            depth += 1
        elif c in "}]" and depth:
            depth -= 1
            if not depth:
                closed = i + 1
    return depth, inside, closed


def _open_ignoring_strings(text: str) -> bool:
    return text.count("{") > text.count("}") or text.count("[") > text.count("]")


def judge(text: str | None) -> tuple[int, int]:
    """The verdict on the ending of ``text``, and the number of characters before what was put after a break."""
    if text is None or not text.strip():
        return COMPLETE, len(text or "")
    try:
        json.loads(text)
        return COMPLETE, len(text)
    except (ValueError, RecursionError):
        pass
    m = _ADDED.search(text)
    core = text[: m.start()] if m else text
    if core.endswith("\ufffd"):
        return INCOMPLETE, len(core)
    start = min((i for i in (text.find("{"), text.find('[{')) if i >= 0), default=-1)
    fence = text.find("```")
    if start >= 0:
        depth, inside, closed = scan(text, start)
        if depth or inside:
            body = core.rstrip()
            if body.endswith("}") and not _open_ignoring_strings(body[start:]):
                return COMPLETE, len(text)  # malformed within, but whole
            return INCOMPLETE, len(core)
        rest = text[closed:].strip()
        if 0 <= fence < start and "```" not in rest:
            return INCOMPLETE, len(core)  # the fence was opened and never closed
        if not rest or rest.endswith(("```", ">", "}", "]")) or _SENTENCE_END.search(rest):
            return COMPLETE, len(text)
        return AMBIGUOUS, len(core)  # a remark after the object
    if fence >= 0 and text.count("```") % 2:
        return INCOMPLETE, len(core)
    body = core.rstrip()
    if label := _LABEL.search(body, max(0, body.rfind("\n", 0, max(0, body.rfind("\n"))))):  # the last two lines
        value = label.group("value").strip()
        if _PERIOD.fullmatch(value):
            return COMPLETE, len(text)
        if not value or _PERIOD_CUT.fullmatch(value) and len(body) >= STUB_CHARS:
            return INCOMPLETE, len(core)
        return AMBIGUOUS, len(core)
    if len(body) < STUB_CHARS:
        return AMBIGUOUS, len(core)
    if m is None or text[m.start() :].strip() not in ("...", "\u2026"):
        if _SENTENCE_END.search(text.rstrip()):
            return AMBIGUOUS, len(core)
    elif _SENTENCE_END.search(body):
        return AMBIGUOUS, len(core)
    return INCOMPLETE, len(core)


def endings(answers: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    """``id``, ``source``, ``text_hash``, ``verdict`` and the four lengths of each text."""
    out = pa.schema(
        [("id", pa.int64()), ("source", pa.string()), ("text_hash", pa.int64()), ("verdict", pa.int32()), *((u, pa.int64()) for u in UNITS)]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t in batch.column(3).to_pylist():
                verdict, core = judge(t)
                if t is None:
                    rows.append((verdict, None, None, None, None))
                elif t.isascii():
                    rows.append((verdict, len(t), len(t), core, core))
                else:
                    rows.append((verdict, len(t), len(t.encode()), core, len(t[:core].encode())))
            columns = list(zip(*rows)) if rows else [[] for _ in range(5)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).cast(pa.int64()),
                    batch.column(1).cast(pa.string()),
                    batch.column(2),
                    *(pa.array(c, f.type) for c, f in zip(columns, list(out)[3:]))
                ],
                schema=out
            )

    source = answers.select(
        F.col(id_col).alias("id"),
        F.col(source_col).alias("source"),
        F.xxhash64(text_col).alias("text_hash"),
        F.col(text_col).alias("text")
    )
    return source.mapInArrow(run, "id bigint, source string, text_hash bigint, verdict int, " + ", ".join(f"{u} bigint" for u in UNITS))


@F.pandas_udf(T.DoubleType())
def _poisson_tail(n: pd.Series, mean: pd.Series) -> pd.Series:
    """P(X >= n) of a Poisson variable."""

    def tail(k: int, m: float) -> float:
        if k <= 0:
            return 1.0
        if k > m:  # the terms fall from here on
            term = math.exp(-m + k * math.log(m) - math.lgamma(k + 1))
            total, j = 0.0, k
            while term > 1e-300 and term > 1e-12 * total:
                total += term
                j += 1
                term *= m / j
            return min(1.0, total)
        if k > 1_000:  # by the normal distribution, which is near at such means
            return 0.5 * math.erfc((k - 0.5 - m) / math.sqrt(2 * m))
        return 1.0 - sum(math.exp(-m + j * math.log(m) - math.lgamma(j + 1)) for j in range(k))

    return pd.Series([tail(int(a), float(b)) for a, b in zip(n, mean)])


def length_limits(ends: DataFrame, reach: int = 12, fdr: float = 0.01, least: int = 3) -> DataFrame:
    """``source``, ``unit``, ``length``, ``n``, ``at_risk``, ``expected``, ``p_value`` of the significant lengths.

    ``ends`` is what ``endings`` returns. A length's hazard is tested against the pooled hazard of all lengths up to
    ``reach`` below and above it, those at which no text ends included: a text of length m is at risk at each of them up
    to m. All windows run per source and unit over distinct lengths, which text lengths bound,
    after the counts were aggregated. A source of null is a source of its own. Where a source writes lengths on a lattice
    only, each point of it stands out from the gaps and can be significant.
    """
    distinct = ends.where("text_hash is not null and chars is not null").groupBy("source", "text_hash").agg(
        F.max("verdict").alias("verdict"),
        *(F.min(u).alias(u) for u in UNITS)
    )
    units = F.explode(F.array(*(F.struct(F.lit(u).alias("unit"), F.col(u).alias("length")) for u in UNITS))).alias("x")
    counts = distinct.where("chars > 0").select("source", "verdict", units).select("source", "verdict", "x.*").groupBy("source", "unit", "length").agg(
        F.count("*").alias("n_any"),
        F.count_if(F.col("verdict") > COMPLETE).alias("n")
    )
    by = Window.partitionBy("source", "unit")
    near = by.orderBy("length").rangeBetween(-reach, reach)
    beyond = by.orderBy("length").rangeBetween(reach + 1, Window.unboundedFollowing)
    low = F.greatest(F.lit(1), F.col("length") - reach)  # the first of the neighbouring lengths
    span = F.col("length") + reach - low + 1
    tested = (
        counts.withColumn("at_risk", F.sum("n_any").over(by.orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("near_n", F.sum("n").over(near) - F.col("n"))
        .withColumn(
            "near_risk",
            F.sum(F.col("n_any") * F.col("length")).over(near) - (low - 1) * F.sum("n_any").over(near) + span * F.coalesce(F.sum("n_any").over(beyond), F.lit(0)) - F.col("at_risk")
        )
        .withColumn("expected", F.col("at_risk") * (F.col("near_n") + 0.5) / (F.col("near_risk") + 1.0))
        .withColumn("p_value", _poisson_tail("n", "expected"))
    )
    order = by.orderBy("p_value", "length")
    return (
        tested.withColumn("rank", F.row_number().over(order))
        .withColumn("ok", (F.col("p_value") <= fdr * F.col("rank") / F.count("*").over(by)).cast("int"))
        .withColumn("ok", F.max("ok").over(order.rowsBetween(0, Window.unboundedFollowing)))
        .where(f"ok = 1 and n >= {least}")
        .select("source", "unit", "length", "n", "at_risk", "expected", "p_value")
    )


def truncated(
    answers: DataFrame,
    id_col: str,
    source_col: str,
    text_col: str,
    *,
    reach: int = 12,
    fdr: float = 0.01
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The truncated texts (``id``, ``source``, ``at_limit``), the limits, and a report per source.

    Null, blank and stub texts are complete. Repeated rows are judged each for itself and count once for the limits. An
    empty table gives three empty results. Only the three columns named are read, whatever else the table holds.
    """
    ends = materialize(endings(answers, id_col, source_col, text_col), "endings")
    limits = materialize(length_limits(ends, reach, fdr), "limits")
    pairs = F.explode(F.array(*(F.struct(F.lit(u).alias("unit"), F.col(u).alias("length")) for u in UNITS))).alias("x")
    suspects = ends.where(f"verdict > {COMPLETE}")
    at = suspects.select("id", "source", pairs).select("id", "source", "x.*").alias("s").join(
        limits.alias("l"),
        F.expr("s.source <=> l.source and s.unit = l.unit and s.length = l.length"),
        "left_semi"
    ).select("id").distinct()
    cut = suspects.join(at.withColumn("at_limit", F.lit(True)), "id", "left").where(f"verdict = {INCOMPLETE} or at_limit").select(
        "id",
        "source",
        F.coalesce("at_limit", F.lit(False)).alias("at_limit")
    )
    totals = ends.groupBy("source").agg(F.count("*").alias("n_texts"))
    lost = cut.groupBy("source").agg(F.count("*").alias("n_truncated"), F.sum(F.col("at_limit").cast("bigint")).alias("n_at_limit"))
    lists = limits.groupBy("source").agg(
        F.array_join(F.array_sort(F.collect_set(F.concat_ws(" ", F.col("length").cast("string"), "unit"))), ", ").alias("limits")
    )
    report = (
        totals.alias("t").join(lost.alias("c"), F.expr("t.source <=> c.source"), "left").join(
            lists.alias("m"),
            F.expr("t.source <=> m.source"),
            "left"
        )
        .select(
            "t.source",
            "n_texts",
            F.coalesce("n_truncated", F.lit(0)).alias("n_truncated"),
            F.coalesce("n_at_limit", F.lit(0)).alias("n_at_limit"),
            F.round(F.coalesce("n_truncated", F.lit(0)) / F.col("n_texts"), 6).alias("share"),
            "limits"
        )
    )
    return cut, limits, report
