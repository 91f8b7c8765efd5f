"""Quality classifier: votes of the nearest labelled documents in a latent-semantic space.

A text's terms are hashed words, pairs of neighbouring byte classes (letters, one class for capitals,
each sign, blanks, non-ASCII) and the shares of its shape: words that repeat the word before or an
earlier pair, repeated lines, capitals, signs, and the magnitude of its length. Word and pair counts
become log(1 + count) * idf, each kind of term is brought to a fixed length, and a truncated singular value
decomposition of the labelled sample gives DIMS latent axes. Every document's vector meets every labelled
vector in blocks of exact cosine products; the labels of the NEIGHBOURS nearest (all that tie
with the last included) are weighted by similarity ** POWER.

Document frequencies are taken over all documents. Axes and labels are fitted on a sample of labelled rows that
are not held out: about SAMPLE, chosen by the hash of id and text, at most 2 * SAMPLE. What is broadcast follows from
that and from DIMS alone: TERMS x DIMS and 2 * SAMPLE x DIMS floats, 4 MB, whatever the corpus.
Neither labels, lang, source nor doc_id enter a document's vector.

Defined results: NULL is an empty text; an empty text is scored by its length alone; a text that no
labelled vector resembles gets the sample's share of label 1, and so do all texts where that sample has
one label only; without labelled rows every score is 0.5; an id with several labels counts with
their mean; NULL labels and ids are no labels; repeated rows are scored alike (similarities are rounded
to five places, so that the size of a block doesn't show); an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm.common import bucket, documents
from touchline.llm.kernels import Words, arrow_rows, arrow_schema, doc_blocks, mix64, table

SAMPLE, DIMS, NEIGHBOURS, POWER = 2500, 64, 15, 8.0
#: Classes of bytes, hashed words, shares of a text's shape with the magnitudes of its length.
CLASSES, WORDS, SHARES, SIZES = 64, 4096, 5, 20
PAIRS = CLASSES * CLASSES
TERMS = PAIRS + WORDS + SHARES + SIZES
#: How much each kind of term weighs: pairs, words, shape.
WEIGHTS = (0.4, 0.2, 0.4)
#: Texts that a step works on at once.
ROWS = 256

_SIGNS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_CLASS = np.full(256, 30, np.int64)
_CLASS[97:123] = np.arange(26)
_CLASS[65:91], _CLASS[48:58], _CLASS[32], _CLASS[10], _CLASS[128:] = 26, 27, 28, 29, 63
_CLASS[list(_SIGNS)] = np.arange(31, 63)
_ODD = np.zeros(256, dtype=bool)
_ODD[list(b"#$%&*+<=>@[\\]^_`{|}~!")] = True


def _repeats(keys: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether a key occurred before in its text."""
    order = np.lexsort((np.arange(len(keys)), keys, doc))
    same = np.zeros(len(keys), dtype=bool)
    same[order[1:]] = (keys[order[1:]] == keys[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])
    return same


def _sums(flag: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(doc[flag], minlength=n)


def counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Term counts and shares of a few texts, one row for each, TERMS columns."""
    n = len(offsets) - 1
    out = np.zeros((n, TERMS), np.float32)
    byte_doc = np.repeat(np.arange(n), np.diff(offsets))
    kinds = _CLASS[data]
    inside = byte_doc[1:] == byte_doc[:-1]
    pair = (byte_doc[:-1] * PAIRS + kinds[:-1] * CLASSES + kinds[1:])[inside]
    out[:, :PAIRS] = np.bincount(pair, minlength=n * PAIRS).reshape(n, PAIRS)
    words = Words(data, offsets, *table("blank"))
    doc = np.repeat(np.arange(n), np.diff(words.first))
    out[:, PAIRS : PAIRS + WORDS] = np.bincount(doc * WORDS + (words.hashes % np.uint64(WORDS)).astype(np.int64), minlength=n * WORDS).reshape(n, WORDS)
    many, size = np.maximum(np.diff(words.first), 1), np.maximum(np.diff(offsets), 1)
    again = np.zeros(len(doc), dtype=bool)
    again[1:] = (words.hashes[1:] == words.hashes[:-1]) & (doc[1:] == doc[:-1])
    lines = Words(data, offsets, np.arange(256, dtype=np.uint8), np.arange(256) != 10)
    line_doc = np.repeat(np.arange(n), np.diff(lines.first))
    two, at = mix64(words.hashes[:-1]) + words.hashes[1:], doc[1:]
    two_same = doc[1:] == doc[:-1]
    at = at[two_same]
    shape = PAIRS + WORDS
    out[:, shape] = _sums(again, doc, n) / many
    out[:, shape + 1] = _sums(_repeats(two[two_same], at), at, n) / many
    out[:, shape + 2] = _sums(_repeats(lines.hashes, line_doc), line_doc, n) / np.maximum(np.diff(lines.first), 1)
    out[:, shape + 3] = _sums(kinds == 26, byte_doc, n) / size
    out[:, shape + 4] = _sums(_ODD[data], byte_doc, n) / size
    magnitude = np.minimum(np.frexp(np.diff(words.first).astype(np.float64))[1], SIZES - 1)
    out[np.arange(n), shape + SHARES + magnitude] = 1
    return out


def vectors(found: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Weighted terms: each kind of a text's terms has a fixed length."""
    edges = (0, PAIRS, PAIRS + WORDS, TERMS)
    for k, weight in enumerate(WEIGHTS):
        part = found[:, edges[k] : edges[k + 1]]
        if k < 2:
            np.log1p(part, out=part)
            part *= idf[edges[k] : edges[k + 1]]
        else:
            np.sqrt(part, out=part)
            part[:, SHARES:] *= 0.35
        length = np.sqrt(np.einsum("ij,ij->i", part, part))
        part *= (np.sqrt(weight) / np.maximum(length, 1e-9))[:, None]
    return found


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """(rows, their counts) of at most ROWS texts at once."""
    for rows, data, offsets in doc_blocks(batches):
        for a in range(0, rows.num_rows, ROWS):
            part = rows.slice(a, ROWS)
            low, high = offsets[a], offsets[a + part.num_rows]
            yield part, counts(data[low:high], offsets[a : a + part.num_rows + 1] - low)


def document_frequencies(docs: DataFrame) -> tuple[int, np.ndarray]:
    """(documents, documents that hold each word and pair) over all texts."""
    out = "term int, n bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, docs_ = np.zeros(PAIRS + WORDS, np.int64), 0
        for rows, found in _steps(batches):
            total += np.count_nonzero(found[:, : PAIRS + WORDS], axis=0)
            docs_ += rows.num_rows
        yield arrow_rows(arrow_schema(out), np.append(-1, np.flatnonzero(total)), np.append(docs_, total[total > 0]))

    rows = docs.select("text").mapInArrow(run, out).groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # a row for each term at most
    term, n = rows["term"].to_numpy(), rows["n"].to_numpy()
    df = np.zeros(PAIRS + WORDS, np.int64)
    df[term[term >= 0]] = n[term >= 0]
    return int(n[term < 0].sum()), df


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str = "quality", size: int = SAMPLE) -> DataFrame:
    """doc_id, text, label of about so many labelled rows, by the hash of id and text; at most twice as many."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.avg(F.col(label).cast("double")).alias("label"))
    rows = docs.select("doc_id", "text").join(known, "doc_id")
    rows = rows.withColumn("_h", F.xxhash64("doc_id", "text")).select("doc_id", "text", "label", "_h")
    total = max(1, known.count())
    span = 1 << 30
    unit = F.pmod("_h", F.lit(span))
    some = rows.filter(unit < int(span * min(1.0, size / total)))
    # ids that many rows share could overfill it: equal rows count once, and the bound is kept in the order of the hash
    return some.dropDuplicates(["doc_id", "_h"]).orderBy(unit, "doc_id").limit(2 * size).select("doc_id", "text", "label")


class Model:
    """Axes, the sample's unit vectors and its labels."""

    def __init__(self, idf: np.ndarray, found: np.ndarray, label: np.ndarray):
        self.idf, self.label = idf, label.astype(np.float64)
        self.prior = float(self.label.mean()) if len(label) else 0.5
        terms = vectors(found, idf)
        self.axes = self._axes(terms) if len(label) else np.zeros((TERMS, 1), np.float32)
        self.points = _unit(terms @ self.axes)

    @staticmethod
    def _axes(terms: np.ndarray) -> np.ndarray:
        """The first DIMS right singular vectors, by seeded subspace iteration."""
        wide = min(DIMS + 16, *terms.shape)
        basis = np.random.default_rng(12).standard_normal((terms.shape[1], wide)).astype(np.float32)
        for _ in range(4):
            basis = np.linalg.qr(terms.T @ np.linalg.qr(terms @ basis)[0])[0]
        right = np.linalg.svd(terms @ basis, full_matrices=False)[2]
        return np.ascontiguousarray((basis @ right.T)[:, :DIMS].astype(np.float32))

    def score(self, found: np.ndarray) -> np.ndarray:
        if not len(self.label):
            return np.full(len(found), 0.5)
        alike = np.round(_unit(vectors(found, self.idf) @ self.axes) @ self.points.T, 5)
        k = min(NEIGHBOURS, alike.shape[1])
        least = np.partition(alike, alike.shape[1] - k, axis=1)[:, alike.shape[1] - k]
        weight = np.where(alike >= least[:, None], np.maximum(alike, 0), 0).astype(np.float64) ** POWER
        return (weight @ self.label + 1e-6 * self.prior) / (weight.sum(axis=1) + 1e-6)


def _unit(points: np.ndarray) -> np.ndarray:
    length = np.sqrt(np.einsum("ij,ij->i", points, points))
    return points / np.maximum(length, 1e-9)[:, None]


def fit(docs: DataFrame, train: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    """A model of the labelled rows of train, with the document frequencies of docs."""
    n, df = document_frequencies(docs)
    idf = (np.log((n + 1) / (df + 1)) + 0.1).astype(np.float32)
    out = "doc_id bigint, hash bigint, label double, terms binary, counts binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(out)
        for rows, found in _steps(batches):
            held = [np.flatnonzero(row) for row in found]
            yield arrow_rows(schema, rows.column(0), rows.column(1), rows.column(2), [h.astype("<u2").tobytes() for h in held], [found[i, h].astype("<f4").tobytes() for i, h in enumerate(held)])

    sample = labelled_sample(train, labels, label).select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("hash"), "label", "text")
    rows = sample.mapInArrow(run, out).toArrow().sort_by([("doc_id", "ascending"), ("hash", "ascending")])  # at most 2 * SAMPLE rows of sparse counts
    found = np.zeros((len(rows), TERMS), np.float32)
    for i, (terms, values) in enumerate(zip(rows["terms"], rows["counts"], strict=True)):
        found[i, np.frombuffer(terms.as_py(), "<u2")] = np.frombuffer(values.as_py(), "<f4")
    return Model(idf, found, rows["label"].to_numpy())


def classify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs (doc_id, held_out, text)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    out = "doc_id bigint, held_out boolean, score double, predicted int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(out)
        for rows, found in _steps(batches):
            score = sent.value.score(found)
            yield arrow_rows(schema, rows.column(0), rows.column(1), score, (score >= 0.5).astype(np.int32))

    return docs.select(F.col("doc_id").cast("long"), "held_out", F.col(text).alias("text")).mapInArrow(run, out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: the quality of every document."""
    docs = documents(spark, sf_dir).select("doc_id", "text").withColumn("held_out", bucket(F.col("doc_id"), 3) == 1)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return classify(docs, fit(docs, docs.filter(~F.col("held_out")), labels))
