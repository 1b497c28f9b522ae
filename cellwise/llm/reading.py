"""The reading level of English documents, from the grades at which their words are acquired.

1. Prose is taken from each document without tables, headings and markup, and kept where its function words are English.
2. From the graded documents each word's distribution over the grades, freed of how many documents each grade has, gives
   its acquisition grade: the grade, interpolated, below which half of the distribution lies.
3. A document's features are quantiles of the acquisition grades of its known words; a quadratic discriminant over the
   graded documents calibrates these quantiles to grades.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellwise.session import materialize

#: At most so many graded documents, those with the lowest hash of their id, fit the model; it bounds what is collected and broadcast.
GRADED_SAMPLE = 20_000
#: Graded documents that a word needs to be known.
SUPPORT = 3
#: Words that running prose has at least.
LEAST_WORDS = 12
QUANTILES = (0.1, 0.25, 0.5, 0.75, 0.9)

#: Frequent function words that tell the languages apart.
FUNCTION_WORDS = {
    "en": "the of and to is are was were that this for by with from has had have not it its as at than which be been or if can you we they he she his her their there when under remain would who how many what".split(),
    "fr": "le la les des du et une est pour dans que qui sur avec par au aux ont été cette ce sont plus ne pas".split(),
    "de": "der das und ist für mit den dem von ein eine im auf nicht um aus wird wurde sich wegen rund lag lagen unter".split(),
    "es": "el los las del y una es por con para que se en su al lo fue han más no como según".split(),
}

_TAG = re.compile(r"<[^<>]*>")
_DROP = re.compile(r"^\s*(?:#{1,6}\s.*|[-=_*~\s]{3,}|```.*|[^\n]*\|[^\n]*|[^\S\n]*\S[^\n\t]*\t[^\n\t]*\t[^\n]*)$", re.M)
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_LANGUAGE = {w: k for k, words in FUNCTION_WORDS.items() for w in words}
_SHARED = {w for w, n in Counter(w for words in FUNCTION_WORDS.values() for w in words).items() if n > 1}


def prose_words(text: str | None) -> list[str]:
    """The words of a text's prose in lower case; none if it isn't running English prose."""
    if not text:
        return []
    if "<" in text:
        text = _TAG.sub(" ", text)
    text = _DROP.sub("", text)
    tokens = _WORD.findall(text.lower())
    if len(tokens) < LEAST_WORDS:
        return []
    votes = Counter(_LANGUAGE[w] for w in tokens if w in _LANGUAGE and w not in _SHARED)
    if not votes or votes["en"] <= max(votes[k] for k in ("fr", "de", "es")):
        return []
    return tokens


def acquisition(counts: np.ndarray, documents: np.ndarray) -> np.ndarray:
    """The interpolated median grade (1 is the first) of each row of ``counts`` (graded documents with the word, by grade)."""
    rate = counts / np.maximum(documents, 1)
    share = rate / rate.sum(axis=1, keepdims=True)
    upto = np.cumsum(share, axis=1)
    g = (upto < 0.5 - 1e-12).sum(axis=1)
    g = np.minimum(g, counts.shape[1] - 1)
    at = np.arange(len(g))
    before = upto[at, g] - share[at, g]
    return g + 0.5 + (0.5 - before) / share[at, g]


def features(grades: np.ndarray) -> np.ndarray:
    return np.r_[np.quantile(grades, QUANTILES), grades.mean()]


class Discriminant:
    """A quadratic discriminant; graded documents that it places elsewhere are set aside once, as their raters may have erred, and it is fitted again.

    ``set_aside`` is how many they were.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray) -> None:
        self.classes = np.unique(y)
        self._fit(x, y)
        right, self.set_aside = self.predict(x) == y, 0
        if all((right & (y == c)).sum() > x.shape[1] for c in self.classes):
            self.set_aside = int((~right).sum())
            self._fit(x[right], y[right])

    def _fit(self, x: np.ndarray, y: np.ndarray) -> None:
        d = x.shape[1]
        centred = x - np.array([x[y == c].mean(axis=0) for c in self.classes])[np.searchsorted(self.classes, y)]
        common = centred.T @ centred / len(x) + 1e-3 * np.eye(d)
        self.parts = []
        for c in self.classes:
            z = centred[y == c]
            weight = len(z) / (len(z) + 10.0 * d)  # few documents: rather the common covariance
            cov = weight * (z.T @ z / len(z) + 1e-3 * np.eye(d)) + (1 - weight) * common
            self.parts.append((x[y == c].mean(axis=0), np.linalg.inv(cov), np.log(len(z) / len(x)) - 0.5 * np.linalg.slogdet(cov)[1]))

    def predict(self, x: np.ndarray) -> np.ndarray:
        score = [bias - 0.5 * np.einsum("ij,jk,ik->i", x - mean, inverse, x - mean) for mean, inverse, bias in self.parts]
        return self.classes[np.argmax(score, axis=0)]


def graded_documents(documents: DataFrame, ratings: DataFrame, id_col: str, text_col: str, grade_col: str, *, sample: int) -> DataFrame:
    """``doc_id``, ``grade`` (the lower median of its grades; repeated ratings and ratings without grade aside) and ``text`` of the graded documents that fit the model."""
    keys = [c for c in ("rater",) if c in ratings.columns]
    rated = ratings.select(
        F.col(id_col).alias("doc_id"),
        F.col(grade_col).cast("int").alias("grade"),
        *keys
    ).where("grade is not null and doc_id is not null").distinct()
    by_doc = rated.groupBy("doc_id").agg(F.sort_array(F.collect_list("grade")).alias("g")).select(
        "doc_id",
        F.expr("g[cast((size(g) - 1) div 2 as int)]").alias("grade")
    )
    chosen = by_doc.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    return documents.select(
        F.col(id_col).alias("doc_id"),
        F.col(text_col).alias("text")
    ).where("text is not null").join(F.broadcast(chosen), "doc_id")  # at most ``sample`` rows of two numbers


def fit(graded: DataFrame) -> tuple[dict[str, float], Discriminant] | None:
    """The acquisition grade of each known word, and the discriminant; None if no graded document has English prose."""
    pairs = pa.schema([("grade", pa.int32()), ("word", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[], []]
            for grade, text in zip(*(c.to_pylist() for c in batch.columns)):
                if words := {*prose_words(text)}:
                    cols[0] += [grade] * (len(words) + 1)
                    cols[1] += ["", *words]  # the empty word counts the documents
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, pairs)], schema=pairs)

    texts = graded.select("grade", "text")
    counted = texts.mapInArrow(run, "grade int, word string").groupBy("word", "grade").agg(F.count("*").alias("n"))
    by_word = counted.groupBy("word").agg(F.map_from_entries(F.collect_list(F.struct("grade", "n"))).alias("by"), F.sum("n").alias("n"))
    table = by_word.where(f"n >= {SUPPORT} or word = ''").select("word", "by").toArrow().to_pylist()  # bounded by the sample
    documents = next((dict(r["by"]) for r in table if r["word"] == ""), {})
    table = [r for r in table if r["word"] != ""]
    if not documents or not table:
        return None
    classes = sorted(documents)
    counts = np.array([[dict(r["by"]).get(c, 0) for c in classes] for r in table], dtype=float)
    grades = dict(zip((r["word"] for r in table), acquisition(counts, np.array([documents[c] for c in classes], dtype=float)).tolist()))
    shared = graded.sparkSession.sparkContext.broadcast(grades)
    names = [f"f{i}" for i in range(len(QUANTILES) + 1)]
    out = pa.schema([("grade", pa.int32()), *((n, pa.float64()) for n in names)])

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for grade, text in zip(*(c.to_pylist() for c in batch.columns)):
                if known := [g for g in map(shared.value.get, prose_words(text)) if g is not None]:
                    rows.append((grade, *features(np.array(known))))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(out)], schema=out)

    rows = texts.mapInArrow(summarise, "grade int, " + ", ".join(f"{n} double" for n in names)).toArrow()  # a few numbers for each document of the sample
    return grades, Discriminant(np.column_stack([rows.column(n).to_numpy() for n in names]), rows.column("grade").to_numpy())


def levels(
    documents: DataFrame,
    ratings: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    grade_col: str = "grade",
    *,
    sample: int = GRADED_SAMPLE
) -> DataFrame:
    """``doc_id``, ``band``, ``median_grade``, ``known_share`` of every document with running English prose.

    Null, blank, stub, table-only and non-English texts give no row, whatever any language column says; texts none of
    whose words are known give none either. Without a graded document in English nothing can be estimated and the result
    is empty. Copies get the same level each.
    """
    spark = documents.sparkSession
    model = fit(materialize(graded_documents(documents, ratings, id_col, text_col, grade_col, sample=sample), "graded"))  # read twice, no more than the sample
    schema = "doc_id bigint, band int, median_grade double, known_share double"
    if model is None:
        return spark.createDataFrame([], schema)
    words_known, discriminant = model
    shared = spark.sparkContext.broadcast(words_known)  # bounded by the sample of graded documents
    out = pa.schema([("doc_id", pa.int64()), ("band", pa.int32()), ("median_grade", pa.float64()), ("known_share", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grades = shared.value
        for batch in batches:
            ids, x, share = [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = prose_words(text)
                if words and (known := [g for g in map(grades.get, words) if g is not None]):
                    ids.append(doc)
                    x.append(features(np.array(known)))
                    share.append(len(known) / len(words))
            f = np.array(x).reshape(len(ids), len(QUANTILES) + 1)
            band = discriminant.predict(f) if ids else []
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(band, pa.int32()), pa.array(np.round(f[:, 2], 6)), pa.array(np.round(share, 6), pa.float64())],
                schema=out
            )

    return documents.select(F.col(id_col).cast("bigint"), text_col).mapInArrow(run, schema)
