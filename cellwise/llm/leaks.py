"""Passages of evaluation material that stand in the documents of a corpus, wholly or partly, edited or not.

1. Documents and passages are read as words: case, markup, line breaks within words, odd characters, footnote marks and
   spacing are left aside.
2. Rare n-grams of the passages, those that few distinct passages share, are the seeds. One pass over all documents joins
   them with the seeds; where several seeds of a passage stand close together, the stretch of words is cut out as a
   candidate, so that no whole text is ever shuffled. The same pass counts how often each seed stands alone: n-grams that
   are common in the corpus apart from any copy of the passage are wording of the language and carry no candidate alone.
3. The words of each candidate are aligned with the passage by Smith-Waterman, which passes over changed words and
   insertions; the words of the passage that the alignment covers decide.

The items are a query set: it meets all documents block by block, each block bounded by BLOCK_CHARS and broadcast.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellwise.session import materialize

#: Words of a seed; the most passages that may share a seed; seeds that a candidate needs (all of a passage that has fewer).
GRAM, RARE, SEEDS = 3, 3, 3
#: A passage has at least this share of its n-grams as seeds: where too few are rare, the rarest of them. The same share of its
#: seeds, those that stand alone least often in the corpus, counts as rare there, besides all that stand alone RARE times at most.
SEEDED = 0.5
#: The share of a passage's words that a document must hold.
COVERED = 1 / 3
#: So many characters of passages make a block; its seeds (28 bytes each, no more than words) and passages are broadcast.
BLOCK_CHARS = 8_000_000
#: Smith-Waterman: a word kept, a word changed, a word left out of the passage, a word put in.
MATCH, CHANGE, LEFT_OUT, PUT_IN = 2.0, -2.0, -2.0, -0.5
#: Any number of successive words left out costs no more than this, so that what is kept of longer sentences is joined.
LEFT_RUN = -16.0
#: Of the covered words at least this share must be kept; where more are changed, only the frame of a sentence is shared.
KEPT = 0.7

#: Letters of other scripts that look like Latin ones.
LOOKALIKES = str.maketrans("аеорсухіјѕԁһ" + "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧο" + "АВЕКМНОРСТХ", "aeopcyxijsdh" + "ABEZHIKMNOPTYXo" + "ABEKMHOPCTX")

_TAG = re.compile(r"</?[a-zA-Z][^<>]*>|&(?:nbsp|amp|lt|gt|quot|#\d+);")
_NOTE = re.compile(r"\[\d{1,3}\]|\[\^\d+\]")
_ESCAPE = re.compile(r'\\[nrt]|\\(?=")|\\u00a0')
_BROKEN = re.compile(r"(?<=[a-z])[-­‐]\s*\n\s*(?=[a-z])")
_INVISIBLE = re.compile("[­​-‏⁠﻿]")
_WORD = re.compile(r"[a-z]+(?:['’][a-z]+)?|\d[\d,]*(?:\.\d+)?|[^\W\d_a-z]+")


def words(text: str | None) -> list[str]:
    """The words and numbers of a text in lower case, without anything else."""
    if not text:
        return []
    if not text.isascii():
        text = _INVISIBLE.sub("", unicodedata.normalize("NFKC", text)).translate(LOOKALIKES)
        text = "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))
    text = text.lower()
    if "\\" in text:
        text = _ESCAPE.sub(" ", text)
    if "<" in text or "&" in text:
        text = _TAG.sub("", text)
    if "[" in text:
        text = _NOTE.sub("", text)
    text = _BROKEN.sub("", text) if "-" in text or not text.isascii() else text
    return _WORD.findall(text.replace("*", "").replace("_", "").replace("`", ""))


class Grams:
    """Digests of the word n-grams of texts; each distinct word is hashed once."""

    def __init__(self, size: int = GRAM) -> None:
        self.size, self.of_word = size, {}

    def hashes(self, tokens: list[str]) -> np.ndarray:
        known = self.of_word
        if len(known) > 2_000_000:
            known.clear()
        for w in {*tokens}.difference(known):
            known[w] = xxhash.xxh64_intdigest(w)
        return np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens))

    def grams(self, h: np.ndarray) -> np.ndarray:
        n = len(h) - self.size + 1
        if n <= 0:
            return np.empty(0, np.int64)
        out = np.zeros(n, np.uint64)
        for k in range(self.size):
            out = (out * np.uint64(0x9E3779B97F4A7C15)) ^ h[k : k + n]
        return (out ^ (out >> np.uint64(29))).view(np.int64)


#: A cell of the alignment packs twice its score, the words kept and the words changed into one integer, which compares as the score.
_ONE, _KEPT = 1 << 40, 1 << 20


def align(passage: list[str], text: list[str]) -> tuple[int, int]:
    """The words of ``passage`` in its best local alignment with ``text``: those kept, and those changed one for one.

    Each cell carries what its alignment has kept and changed, so that two rows are held instead of the whole matrix.
    """
    code = {w: i for i, w in enumerate(dict.fromkeys(passage))}
    p = [code[w] for w in passage]
    t = np.array([code.get(w, -1) for w in text])
    m = len(t)
    if not p or not m:
        return 0, 0
    match, change, left_out, left_run, put_in = (int(2 * x) * _ONE for x in (MATCH, CHANGE, LEFT_OUT, LEFT_RUN, PUT_IN))
    last, above = np.zeros(m + 1, np.int64), np.zeros(m + 1, np.int64)  # ``above``: the best of each column so far
    ramp = np.arange(m + 1, dtype=np.int64) * put_in
    step = {c: np.where(t == c, match + _KEPT, change + 1) for c in {*p}}
    best = 0
    for c in p:
        np.maximum(above, last, out=above)
        row = np.maximum(last + left_out, above + left_run)
        np.maximum(row[1:], last[:-1] + step[c], out=row[1:])
        row[row < _ONE] = 0  # a local alignment starts anew where nothing is gained
        row = np.maximum.accumulate(row - ramp) + ramp  # any number of words put in
        row[row < _ONE] = 0
        last = row
        best = max(best, int(row.max()))
    return best % _ONE // _KEPT, best % _KEPT


def common(passage: list[str], text: list[str]) -> int:
    """The length of the longest common subsequence, which no alignment keeps more words than; by bits of one number."""
    at: dict[str, int] = {}
    for i, w in enumerate(passage):
        at[w] = at.get(w, 0) | 1 << i
    full = left = (1 << len(passage)) - 1
    for w in text:
        if hit := at.get(w):
            left = ((left + (left & hit)) | (left & ~hit)) & full
    return len(passage) - left.bit_count()


def distinct_passages(items: DataFrame, item_col: str, passage_col: str) -> DataFrame:
    """``item_id``, ``passage_id``, ``passage``: the same ``passage_id``, a digest of the words, for each copy of a passage."""
    out = pa.schema([("item_id", pa.int64()), ("passage_id", pa.int64()), ("passage", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = np.array([xxhash.xxh3_64_intdigest(" ".join(words(t))) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.int64()), batch.column(1).cast(pa.string())], schema=out)

    return items.select(F.col(item_col).cast("bigint"), passage_col).mapInArrow(run, "item_id bigint, passage_id bigint, passage string")


def passage_seeds(passages: DataFrame) -> DataFrame:
    """``seed``, ``passage_id``, ``place``, ``n_words``, ``need``: the n-grams that at most RARE of the distinct passages share.

    Where these are less than SEEDED of a passage's n-grams, its rarest ones fill up, whatever their number. ``need`` is how
    many of them a candidate holds: SEEDS, or all where a short passage has fewer.
    """
    out = pa.schema([("seed", pa.int64()), ("passage_id", pa.int64()), ("place", pa.int32()), ("n_words", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams()
        for batch in batches:
            cols: list[list] = [[], [], [], []]
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                tokens = words(text)
                g = grams.grams(grams.hashes(tokens))
                first = np.unique(g, return_index=True)[1]
                cols[0] += g[first].tolist()
                cols[1] += [key] * len(first)
                cols[2] += first.tolist()
                cols[3] += [len(tokens)] * len(first)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, out)], schema=out)

    found = passages.select("passage_id", "passage").mapInArrow(run, "seed bigint, passage_id bigint, place int, n_words int")
    counted = found.join(found.groupBy("seed").agg(F.count("*").alias("n")), "seed")
    own = Window.partitionBy("passage_id")
    ranked = counted.withColumn(
        "rank",
        F.row_number().over(own.orderBy("n", F.xxhash64("seed")))
    ).withColumn("least", F.ceil(SEEDED * F.count("*").over(own)))
    kept = ranked.where(f"n <= {RARE} or rank <= least")
    return kept.select("seed", "passage_id", "place", "n_words", F.least(F.lit(SEEDS), F.count("*").over(own)).cast("int").alias("need"))


def _stretches(
    s: dict[str, np.ndarray],
    doc: np.ndarray,
    at: np.ndarray,
    seed: np.ndarray
) -> tuple[np.ndarray, list[tuple[int, int, int, int, list[int]]]]:
    """Of seed hits (document, place in it, number of the seed): the stretches that hold enough seeds of one passage.

    Returns which hits stand in one, and document, passage, begin, end and seeds of each stretch. A hit counts where the
    passage would begin, in overlapping blocks that are a little longer than the passage.
    """
    place, n_words = s["place"][seed].astype(np.int64), s["n_words"][seed].astype(np.int64)
    block = (at - place) // (n_words + 64)
    hit = np.tile(np.arange(len(at)), 2)
    d, passage, block = doc[hit], s["passage_id"][seed][hit], np.r_[block, block + 1]
    order = np.lexsort((place[hit], block, passage, d))
    hit, d, passage, block = hit[order], d[order], passage[order], block[order]
    new = np.r_[True, (d[1:] != d[:-1]) | (passage[1:] != passage[:-1]) | (block[1:] != block[:-1])] if len(hit) else np.empty(0, bool)
    begin = np.flatnonzero(new)
    if not len(begin):
        return np.zeros(len(at), bool), []
    p = place[hit]
    distinct = np.add.reduceat(np.r_[True, p[1:] != p[:-1]] | new, begin)
    first, last = np.minimum.reduceat(at[hit], begin), np.maximum.reduceat(at[hit], begin)
    low, high = np.minimum.reduceat(p, begin), np.maximum.reduceat(p, begin)
    one = seed[hit[begin]]
    good = distinct >= s["need"][one]
    inside = np.zeros(len(at), bool)
    inside[hit[np.repeat(good, np.diff(np.r_[begin, len(hit)]))]] = True
    start, stop = np.maximum(0, first - 2 * low - 20), last + 2 * (s["n_words"][one] - high) + 20
    end = np.r_[begin[1:], len(hit)]
    found = {}
    for k in np.flatnonzero(good):  # two blocks often hold the same seeds
        found[int(d[begin[k]]), int(passage[begin[k]]), int(start[k]), int(stop[k])] = np.unique(seed[hit[begin[k] : end[k]]]).tolist()
    return inside, [(*key, seeds) for key, seeds in found.items()]


def candidates(documents: DataFrame, seeds: dict[str, np.ndarray]) -> DataFrame:
    """One pass over (id, text): ``doc_id``, ``passage_id``, ``stretch`` (its words), ``seeds`` (their numbers) of each candidate.

    Besides, rows with ``lone`` alone set: for each seed by its number (``seeds``) how often it stands outside any candidate.
    """
    shared = documents.sparkSession.sparkContext.broadcast(seeds)
    out = pa.schema(
        [("doc_id", pa.int64()), ("passage_id", pa.int64()), ("stretch", pa.string()), ("seeds", pa.list_(pa.int32())), ("lone", pa.int64())]
    )
    rows = lambda r: pa.RecordBatch.from_arrays([pa.array([x[k] for x in r], f.type) for k, f in enumerate(out)], schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, s = Grams(), shared.value
        known = s["seed"]
        lone = np.zeros(len(known), np.int64)
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            tokens = [words(t) for t in batch.column(1).to_pylist()]
            count = np.array([len(t) for t in tokens], dtype=np.int64)
            g = grams.grams(grams.hashes([w for t in tokens for w in t]))
            of = np.repeat(np.arange(len(tokens)), count)
            start = (np.cumsum(count) - count)[of] if len(of) else of
            whole = of[: len(g)] == of[GRAM - 1 :] if len(g) else np.empty(0, bool)
            lo, hi = np.searchsorted(known, g, "left"), np.searchsorted(known, g, "right")
            hit = np.flatnonzero((hi > lo) & whole)
            times = (hi - lo)[hit]
            at = np.repeat(hit, times)
            seed = np.repeat(lo[hit], times) + np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
            inside, found = _stretches(s, of[at], at - start[at], seed)
            lone += np.bincount(seed[~inside], minlength=len(known))
            yield rows([(ids[d], key, " ".join(tokens[d][begin:end]), held, None) for d, key, begin, end, held in found])
        alone = np.flatnonzero(lone)
        yield rows([(None, None, None, [k], n) for k, n in zip(alone.tolist(), lone[alone].tolist())])

    return documents.mapInArrow(run, "doc_id bigint, passage_id bigint, stretch string, seeds array<int>, lone bigint")


def _rare(seeds: pd.DataFrame, lone: pd.DataFrame) -> np.ndarray:
    """Which seeds of a block are rare in the corpus: the better half of each passage's, and all that hardly stand alone."""
    n = pd.Series(0, index=seeds.index).add(lone.set_index("seed")["n"], fill_value=0) if len(lone) else pd.Series(0, index=seeds.index)
    rank = n.groupby(seeds["passage_id"]).rank(method="first")
    size = n.groupby(seeds["passage_id"]).transform("size")
    return ((n <= RARE) | (rank <= np.ceil(SEEDED * size))).to_numpy(dtype=bool)


def _block(docs: DataFrame, seeds: DataFrame, passages: DataFrame) -> DataFrame:
    """``doc_id``, ``passage_id``, ``n_words``, ``kept``, ``changed`` of the documents that hold a passage of one block."""
    spark = docs.sparkSession
    known = seeds.orderBy("seed", "passage_id").toPandas()  # a block, bounded by BLOCK_CHARS
    texts = {r["passage_id"]: r["passage"] for r in passages.collect()}  # the same block
    found = materialize(candidates(docs, {c: known[c].to_numpy() for c in known.columns}), "candidates")
    lone = found.where("lone is not null").groupBy(F.get("seeds", F.lit(0)).alias("seed")).agg(F.sum("lone").alias("n")).toPandas()  # no more than seeds
    shared = spark.sparkContext.broadcast((_rare(known, lone), dict(zip(known["passage_id"].tolist(), known["need"].tolist())), texts))
    out = pa.schema([("doc_id", pa.int64()), ("passage_id", pa.int64()), ("n_words", pa.int32()), ("kept", pa.int32()), ("changed", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rare, need, of = shared.value
        split: dict[int, list[str]] = {}
        for batch in batches:
            rows = []
            for doc, key, stretch, held in zip(*(c.to_pylist() for c in batch.columns)):
                if rare[held].sum() < need[key] and len(held) < 2 * SEEDS:
                    continue  # wording of the language
                p = split.get(key) or split.setdefault(key, words(of[key]))
                t = stretch.split(" ")
                if common(p, t) < KEPT * COVERED * len(p):
                    continue  # too few words to be kept in any alignment
                kept, changed = align(p, t)
                if kept + changed >= COVERED * len(p) and kept >= KEPT * (kept + changed):
                    rows.append((doc, key, len(p), kept, changed))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(out)], schema=out)

    return found.where("lone is null").select("doc_id", "passage_id", "stretch", "seeds").mapInArrow(
        run,
        "doc_id bigint, passage_id bigint, n_words int, kept int, changed int"
    )


def leaks(
    documents: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    passage_col: str = "passage",
    *,
    block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """``doc_id``, ``item_id``, ``n_words``, ``kept``, ``changed``: every document with at least COVERED of an item's passage.

    Null and empty texts and passages, and passages shorter than a seed, match nothing. Copies of a document are found
    each for itself. Document ids are unique; of a repeated item id each passage counts. Very long texts are read whole;
    the alignment takes the stretch around the seeds. A passage longer than a block is a block of its own. Other columns
    aren't read. The seeds and the candidates are found when the plan is built.
    """
    docs = documents.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        F.col(text_col).alias("text")
    ).where("doc_id is not null and text is not null")
    tests = items.select(
        F.col(item_col).cast("bigint").alias("item_id"),
        F.col(passage_col).alias("passage")
    ).where("item_id is not null and passage is not null")
    tests = materialize(distinct_passages(tests, "item_id", "passage"), "items")
    passages = tests.groupBy("passage_id").agg(F.min("passage").alias("passage"))  # one for all its copies
    seeds = materialize(passage_seeds(passages), "seeds")
    size = passages.agg(F.coalesce(F.sum(F.length("passage")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_chars))
    mine = lambda d, k: d if blocks == 1 else d.where(F.pmod(F.xxhash64("passage_id"), F.lit(blocks)) == k)
    aligned = reduce(DataFrame.unionAll, (_block(docs, mine(seeds, k), mine(passages, k)) for k in range(blocks)))
    best = aligned.groupBy("doc_id", "passage_id").agg(F.max(F.struct("kept", "changed", "n_words")).alias("x"))
    found = best.join(tests.select("item_id", "passage_id").distinct(), "passage_id")
    return found.groupBy("doc_id", "item_id").agg(F.max("x").alias("x")).select("doc_id", "item_id", "x.n_words", "x.kept", "x.changed")
