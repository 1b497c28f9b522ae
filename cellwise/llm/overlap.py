"""Records that stand, exactly or almost, in two splits: content-defined chunks of normalised records.

A record is normalised to what it asks and to the quantities of its table: the question becomes its slots (conditions,
measures, directions), whatever the wording; the table becomes the multiset of its numbers, whatever their style, order or
orientation and however rows and columns are labelled. The quantities, in the order of their digests, are cut into chunks
where a rolling hash over the last WINDOW of them meets a mask, so that a changed number changes only the chunks around
it. Records of one split with the same question and the same numbers form a class and are compared once.

Chunk digests, each taken together with the question, are joined across splits, and the lengths of the shared chunks are
summed into the overlap fraction of each pair of classes. A fraction of AGREEMENT decides: the pair is accepted as it is.
Changed numbers can hit many chunks of a small table; a pair with a lower fraction is undecided, and the exact share of
agreeing numbers decides. So that no undecided pair is lost whose changed numbers hit every chunk, a class also emits
keys of one quantity, of no length, for the first n - ceil(3n/4) + 1 quantities in digest order: two records that agree in
three quarters of their numbers must share one of these.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellwise.llm.wording import signature
from cellwise.operators.skew import salted_join
from cellwise.session import materialize

#: A chunk ends where the rolling hash of the last WINDOW quantities meets a mask, one in 2 ** CUT_BITS times.
WINDOW, CUT_BITS = 2, 1
#: The share of the numbers of the larger table that must agree.
AGREEMENT = 0.75

_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    """64 well-mixed bits of each 64-bit value."""
    x = x.astype(np.uint64) + _MIX[0]
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def _quantities(rows: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Of a column of grids: for each number outside the first column its record, and the number."""
    n = len(rows)
    outer = np.diff(rows.offsets.to_numpy()) if not rows.null_count else np.array([len(r) if r is not None else 0 for r in rows.to_pylist()])
    grid_rows = rows.flatten()
    record_of_row = np.repeat(np.arange(n), outer)
    cells = grid_rows.flatten()
    inner = pc.fill_null(pc.list_value_length(grid_rows), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    row_of_cell = np.repeat(np.arange(len(inner)), inner)
    first = np.repeat(np.cumsum(inner) - inner, inner)
    place = np.arange(len(row_of_cell)) - first
    coded = cells.dictionary_encode()  # few styles and many repeated cells: each distinct cell is parsed once
    texts = coded.dictionary.cast(pa.string())
    bare = pc.replace_substring_regex(pc.replace_substring(texts, "−", "-"), r"[\s$€£¥,% ]+|USD|EUR|GBP", "")
    plain = pc.match_substring_regex(bare, r"^[-+(]{0,2}(\d+\.?\d*|\.\d+)\)?$")
    negative = pc.match_substring_regex(bare, r"^[+]?[-(]")
    digits = pc.replace_substring_regex(bare, r"[-+()]", "")
    values = pc.cast(pc.if_else(plain, digits, None), pa.float64())
    v = np.where(pc.fill_null(negative, False).to_numpy(zero_copy_only=False), -1.0, 1.0) * values.to_numpy(zero_copy_only=False)
    v = np.append(v, np.nan)
    code = coded.indices.fill_null(len(v) - 1).to_numpy(zero_copy_only=False)
    v = v[code]
    keep = (place > 0) & ~np.isnan(v)
    return record_of_row[row_of_cell[keep]], v[keep]


def _digests(of: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Record and digest of each quantity, in the order of the digests; equal quantities of a record are numbered."""
    h = mix((np.round(v, 4) + 0.0).view(np.uint64))
    order = np.lexsort((h, of))
    of, h = of[order], h[order]
    if len(of):
        new = np.r_[True, (of[1:] != of[:-1]) | (h[1:] != h[:-1])]
        start = np.maximum.accumulate(np.where(new, np.arange(len(of)), 0))
        h = mix(h + (np.arange(len(of)) - start).astype(np.uint64))
        order = np.lexsort((h, of))
        of, h = of[order], h[order]
    return of, h


def cuts(h: np.ndarray, place: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Whether a chunk ends after each quantity, by the rolling hash of the last WINDOW ones of its record, or with the record."""
    rolled = np.zeros(len(h), np.uint64)
    for k in range(WINDOW):
        back = np.r_[np.zeros(min(k, len(h)), np.uint64), h[: max(len(h) - k, 0)]]
        rolled += np.where(place >= k, mix(back + np.uint64(k)), np.uint64(0))
    return ((mix(rolled) & np.uint64((1 << CUT_BITS) - 1)) == 0) | (place == count - 1)


def normalised(records: DataFrame, id_col: str, question: str, headers: str, grid: str, side: str) -> DataFrame:
    """``rec_id``, ``side``, ``question`` and ``content`` (digests of what is asked and of all numbers), ``numbers`` (their digests in order), ``chunks``, ``lengths``."""
    out = pa.schema(
        [
            ("rec_id", pa.int64()),
            ("side", pa.string()),
            ("question", pa.int64()),
            ("content", pa.int64()),
            ("numbers", pa.list_(pa.int64())),
            ("chunks", pa.list_(pa.int64())),
            ("lengths", pa.list_(pa.int32()))
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            grids = batch.column(4)

            def labels(heads: list[str] | None, i: int) -> Iterable[str | None]:
                return (*(heads or ())[1:], *(row[0] for row in grids[i].as_py() or () if row))

            asked = []
            for i, (q, heads) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                asked.append(xxhash.xxh64_intdigest(signature(q, lambda: labels(heads, i))))
            asked = np.array(asked, dtype=np.uint64)
            of, h = _digests(*_quantities(grids))
            count = np.bincount(of, minlength=n)
            offsets = np.r_[0, np.cumsum(count)]
            place = np.arange(len(of)) - offsets[of]
            last = np.flatnonzero(cuts(h, place, count[of]))
            begin = np.r_[0, last[:-1] + 1] if len(last) else last
            length = last - begin + 1
            total = np.r_[np.uint64(0), np.cumsum(mix(h ^ _MIX[1]), dtype=np.uint64)]
            content = mix(total[offsets[1:]] - total[offsets[:-1]] + count.astype(np.uint64))
            digest = mix(mix(total[last + 1] - total[begin]) ^ asked[of[last]])
            # single quantities that two agreeing records can't all lack; a record without numbers has one empty chunk
            first = place <= count[of] - np.ceil(AGREEMENT * count[of])
            none = np.flatnonzero(count == 0)
            who = np.concatenate([of[last], of[first], none])
            key = np.concatenate([digest, mix(h[first] ^ mix(asked[of[first]])), mix(asked[none])])
            size = np.concatenate([length, np.zeros(first.sum(), dtype=np.int64), np.zeros(len(none), dtype=np.int64)])
            order = np.argsort(who, kind="stable")
            at = pa.array(np.r_[0, np.cumsum(np.bincount(who, minlength=n))], pa.int32())
            lists = lambda offset, values: pa.ListArray.from_arrays(offset, pa.array(values))
            columns = [
                batch.column(0).cast(pa.int64()),
                batch.column(1).cast(pa.string()),
                pa.array(asked.view(np.int64)),
                pa.array(content.view(np.int64))
            ]
            columns += [
                lists(pa.array(offsets, pa.int32()), h.view(np.int64)),
                lists(at, key[order].view(np.int64)),
                lists(at, size[order].astype(np.int32))
            ]
            yield pa.RecordBatch.from_arrays(columns, schema=out)

    chosen = records.select(
        F.col(id_col).alias("rec_id"),
        F.col(side).alias("side"),
        F.col(question).alias("q"),
        F.col(headers).alias("headers"),
        F.col(grid).alias("grid")
    ).where("side is not null")
    return chosen.mapInArrow(
        run,
        "rec_id bigint, side string, question bigint, content bigint, numbers array<bigint>, chunks array<bigint>, lengths array<int>"
    )


def class_pairs(
    records: DataFrame,
    id_col: str,
    question: str,
    headers: str,
    grid: str,
    split: str,
    train: tuple[str, ...] = ("train",),
    held_out: tuple[str, ...] = ("dev", "test")
) -> tuple[DataFrame, DataFrame]:
    """The records' classes (``rec_id``, ``side``, ``question``, ``content``) and the overlapping pairs of classes.

    A pair has ``question``, ``train_class``, ``held_class``, ``chunk_overlap``, ``agreement`` (null where the chunks
    decided). The normalised records are written when the plan is built.
    """
    lower = F.lower(F.regexp_replace(F.col(split), r"^\s+|\s+$", ""))
    sided = records.withColumn("_side", F.when(lower.isin(*train, *held_out), lower)).select(
        F.col(id_col).alias("_id"),
        F.col(question).alias("_q"),
        F.col(headers).alias("_h"),
        F.col(grid).alias("_g"),
        "_side"
    )
    recs = materialize(normalised(sided, "_id", "_q", "_h", "_g", "_side"), "records")
    is_train = F.col("side").isin(*train)
    flags = [F.max(is_train.cast("int")).alias("t"), F.max((~is_train).cast("int")).alias("e")]
    both = recs.groupBy("question").agg(*flags).where("t = 1 and e = 1").select("question")
    kept = recs.join(both, "question", "left_semi")
    classes = kept.groupBy("question", "content").agg(
        *flags,
        F.first(F.size("numbers")).alias("n"),
        *(F.first(c).alias(c) for c in ("chunks", "lengths"))
    )
    chunks = classes.select("question", "content", "t", "e", "n", F.explode(F.arrays_zip("chunks", "lengths")).alias("c")).select(
        "question",
        "content",
        "t",
        "e",
        "n",
        F.col("c.chunks").alias("chunk"),
        F.col("c.lengths").alias("length")
    )
    a = chunks.where("t = 1").select("chunk", "question", F.col("content").alias("train_class"), F.col("n").alias("n_a"), "length")
    b = chunks.where("e = 1").select("chunk", F.col("question").alias("q"), F.col("content").alias("held_class"), F.col("n").alias("n_b"))
    near = a.join(b, "chunk").where(f"question = q and least(n_a, n_b) >= {AGREEMENT} * greatest(n_a, n_b)")
    pairs = near.groupBy("question", "train_class", "held_class").agg(F.sum("length").alias("shared"), F.max(F.greatest("n_a", "n_b")).alias("n"))
    pairs = pairs.withColumn("chunk_overlap", F.when(F.col("n") == 0, 1.0).otherwise(F.col("shared") / F.col("n")))
    pairs = materialize(pairs.select("question", "train_class", "held_class", "n", "chunk_overlap"), "pairs")
    decided = pairs.where(f"chunk_overlap >= {AGREEMENT}").withColumn("agreement", F.lit(None).cast("double"))
    # the numbers of the undecided classes alone are moved
    open_ = pairs.where(f"chunk_overlap < {AGREEMENT}")
    ids = open_.select("question", F.col("train_class").alias("content")).unionAll(
        open_.select("question", F.col("held_class").alias("content"))
    ).distinct()
    numbers = recs.select("question", "content", "numbers").join(
        ids,
        ["question", "content"],
        "left_semi"
    ).groupBy("question", "content").agg(F.first("numbers").alias("numbers"))
    exact = (
        open_.join(numbers.select("question", F.col("content").alias("train_class"), F.col("numbers").alias("x")), ["question", "train_class"])
        .join(numbers.select("question", F.col("content").alias("held_class"), F.col("numbers").alias("y")), ["question", "held_class"])
        .withColumn("agreement", F.size(F.array_intersect("x", "y")) / F.col("n")).where(f"agreement >= {AGREEMENT}")
    )
    cols = ["question", "train_class", "held_class", F.round("chunk_overlap", 6).alias("chunk_overlap"), F.round("agreement", 6).alias("agreement")]
    return recs.select("rec_id", "side", "question", "content"), decided.select(*cols).unionAll(exact.select(*cols))


def overlaps(
    records: DataFrame,
    id_col: str,
    question: str,
    headers: str,
    grid: str,
    split: str,
    train: tuple[str, ...] = ("train",),
    held_out: tuple[str, ...] = ("dev", "test")
) -> DataFrame:
    """``rec_id_a`` < ``rec_id_b``, ``train_id``, ``held_out_id``, ``split``, ``chunk_overlap``, ``agreement`` of each overlapping pair.

    ``split`` is read without regard to case and surrounding blanks; other splits and null take no part. A null question
    equals a null question only, a table that is null, empty or without numbers only another such table. Records that
    occur twice under other ids are found with each of their partners. An empty table gives an empty result; other
    columns aren't read. Hot classes are split where their members are put in.
    """
    recs, pairs = class_pairs(records, id_col, question, headers, grid, split, train, held_out)
    is_train = F.col("side").isin(*train)
    member = lambda who, c, name: recs.where(who).select(
        F.col("rec_id").alias(name),
        F.col("question").alias(f"q_{c}"),
        F.col("content").alias(c),
        *(["side"] if c == "held_class" else [])
    )
    held = salted_join(member(~is_train, "held_class", "held_out_id"), pairs, "held_class", F.col("held_out_id")).where("question = q_held_class")
    held = materialize(held.drop("q_held_class"), "held")  # read twice, for its hot classes and for the join
    found = salted_join(held, member(is_train, "train_class", "train_id"), "train_class", F.col("held_out_id")).where("question = q_train_class")
    return found.select(
        F.least("train_id", "held_out_id").alias("rec_id_a"),
        F.greatest("train_id", "held_out_id").alias("rec_id_b"),
        "train_id",
        "held_out_id",
        F.col("side").alias("split"),
        "chunk_overlap",
        "agreement"
    )


def linked_classes(
    records: DataFrame,
    id_col: str,
    question: str,
    headers: str,
    grid: str,
    split: str,
    train: tuple[str, ...] = ("train",),
    held_out: tuple[str, ...] = ("dev", "test")
) -> DataFrame:
    """``rec_id``, ``class_id``, ``n_links`` of every record of a known split: its class and how many records of the other side it overlaps.

    Nothing is expanded to pairs of records, so that copies cost no more than one row each.
    """
    recs, pairs = class_pairs(records, id_col, question, headers, grid, split, train, held_out)
    is_train = F.col("side").isin(*train)
    sizes = recs.groupBy("question", "content").agg(F.count_if(is_train).alias("n_train"), F.count_if(~is_train).alias("n_held"))
    count = lambda mine, other, n: pairs.join(
        sizes.select("question", F.col("content").alias(other), n),
        ["question", other]
    ).groupBy("question", F.col(mine).alias("content")).agg(F.sum(n).alias(f"links_{n}"))
    per = sizes.join(count("train_class", "held_class", "n_held"), ["question", "content"], "left").join(
        count("held_class", "train_class", "n_train"),
        ["question", "content"],
        "left"
    )
    per = per.select(F.col("question").alias("q"), "content", "links_n_held", "links_n_train")
    labelled = salted_join(recs, per, "content", F.col("rec_id")).where("question = q")
    return labelled.select(
        "rec_id",
        F.xxhash64("question", "content").alias("class_id"),
        F.coalesce(F.when(is_train, F.col("links_n_held")).otherwise(F.col("links_n_train")), F.lit(0)).alias("n_links")
    )


def report(
    records: DataFrame,
    id_col: str,
    question: str,
    headers: str,
    grid: str,
    split: str,
    source: str,
    train: tuple[str, ...] = ("train",),
    held_out: tuple[str, ...] = ("dev", "test")
) -> DataFrame:
    """Per evaluation split and source of the held-out record: pairs, held-out records and train records concerned, from class counts alone."""
    recs, pairs = class_pairs(records, id_col, question, headers, grid, split, train, held_out)
    is_train = F.col("side").isin(*train)
    names = records.select(F.col(id_col).alias("rec_id"), F.coalesce(F.col(source), F.lit("(none)")).alias("source"))
    held = recs.where(~is_train).join(names, "rec_id").groupBy(
        "question",
        F.col("content").alias("held_class"),
        F.col("side").alias("split"),
        "source"
    ).agg(F.count("*").alias("n_h"))
    own = recs.where(is_train).groupBy("question", F.col("content").alias("train_class")).agg(F.count("*").alias("n_t"))
    linked = pairs.join(held, ["question", "held_class"]).join(own, ["question", "train_class"])
    per = linked.groupBy("split", "source").agg(
        F.sum(F.col("n_h") * F.col("n_t")).alias("n_pairs"),
        F.round(F.sum(F.col("chunk_overlap") * F.col("n_h") * F.col("n_t")) / F.sum(F.col("n_h") * F.col("n_t")), 4).alias("mean_chunk_overlap")
    )
    once = lambda c, n, name: linked.select("split", "source", "question", c, n).distinct().groupBy("split", "source").agg(F.sum(n).alias(name))
    return per.join(once("held_class", "n_h", "n_held_out"), ["split", "source"]).join(once("train_class", "n_t", "n_train"), ["split", "source"]).select(
        "split",
        "source",
        "n_pairs",
        "n_held_out",
        "n_train",
        "mean_chunk_overlap"
    )
