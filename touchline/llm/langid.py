"""Language identification by language-bitmask n-gram filters.

The n-grams (ORDERS bytes of the lower-cased text) typical of each language are put into a Bloom
filter that is bit-sliced: every cell holds a mask with a bit for each language, and the AND of
an n-gram's PROBES cells is the set of all languages that have it, found at once. Per text, each
language's n-grams are counted (popcounts of its bit), the hits that are expected by chance from
the filter's fill are taken out, and the largest count decides.

The model is fitted on a sample of labelled rows, about SAMPLE of each language, chosen by the hash
of their id and text. The filter has CELLS x languages / 8 bytes, 2 MB for 64 languages, whatever the corpus.

Defined results: "und" with score 0 for NULL texts and texts without a letter, and for all texts
where nothing was learned; a text whose n-grams no language has gets the most frequent language
with score 0; ties go to the more frequent language; repeated rows are judged alike; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm.common import bucket, documents
from touchline.llm.kernels import arrow_rows, arrow_schema, doc_blocks, mix64, sums_by_doc

ORDERS, PROBES, CELLS = (3, 4), 2, 1 << 18
#: Labelled rows to learn from for each language, about; n-grams kept for a language.
SAMPLE, PROFILE = 4000, 8000
#: An n-gram is a language's own if its share there is at least this part of its largest share anywhere.
OWN = 0.3

_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_LOW[[9, 10, 11, 12, 13]] = 32


def _grams(data: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(the n-grams as integers, whether each lies within one text), one for each start byte."""
    low = _LOW[data].astype(np.uint64)
    n = len(low) - order + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    key = np.full(n, order, np.uint64)
    for k in range(order):
        key = (key << np.uint64(8)) | low[k : k + n]
    inside = np.ones(n, dtype=bool)
    for k in range(1, order):
        cuts = offsets[1:-1] - k
        inside[cuts[(cuts >= 0) & (cuts < n)]] = False
    return key, inside


def _profiles(sample: DataFrame) -> DataFrame:
    """lang, gram, c over the sampled texts."""
    out = "lang string, gram bigint, c bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(out)
        for rows, data, offsets in doc_blocks(batches):
            langs = np.array(rows.column(rows.schema.get_field_index("lang")).to_pylist(), dtype=object)
            for lang in sorted(set(langs)):
                raw = [data[offsets[i] : offsets[i + 1]] for i in np.flatnonzero(langs == lang)]
                ends = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
                for order in ORDERS:
                    key, inside = _grams(np.concatenate(raw), ends, order)
                    keys, counts = np.unique(key[inside], return_counts=True)
                    yield arrow_rows(schema, [lang] * len(keys), keys.astype(np.int64), counts)

    return sample.select("text", "lang").mapInArrow(run, out).groupBy("lang", "gram").agg(F.sum("c").alias("c"))


class Model:
    """The bit-sliced filter and the languages of its bits, most frequent first."""

    def __init__(self, langs: list[str], grams: dict[str, np.ndarray]):
        self.langs, self.slices = langs, (len(langs) + 63) // 64
        self.cells = np.zeros((self.slices, CELLS), np.uint64)
        for bit, lang in enumerate(langs):
            for probe in range(PROBES):
                self.cells[bit // 64, _cells(grams[lang], probe)] |= np.uint64(1) << np.uint64(bit % 64)
        fill = [np.count_nonzero(self.cells[b // 64] >> np.uint64(b % 64) & np.uint64(1)) / CELLS for b in range(len(langs))]
        self.chance = np.array(fill) ** PROBES

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(n-grams of each text, hits of each text and language)."""
        n, hits, total = len(offsets) - 1, np.zeros((len(offsets) - 1, len(self.langs))), np.zeros(len(offsets) - 1)
        for order in ORDERS:
            key, inside = _grams(data, offsets, order)
            if not len(key):
                continue
            bounds = np.minimum(offsets, len(key))
            at = [_cells(key, probe) for probe in range(PROBES)]
            total += sums_by_doc(inside.astype(np.int64), bounds)
            for s in range(self.slices):
                mask = self.cells[s][at[0]]
                for more in at[1:]:
                    mask &= self.cells[s][more]
                mask[~inside] = 0
                for bit in range(64 * s, min(len(self.langs), 64 * s + 64)):
                    hits[:, bit] += sums_by_doc((mask >> np.uint64(bit % 64) & np.uint64(1)).astype(np.int64), bounds)
        return total[:n], hits


def _cells(grams: np.ndarray, probe: int) -> np.ndarray:
    x = mix64(grams)
    return ((x >> np.uint64(18 * probe)) & np.uint64(CELLS - 1)).astype(np.int64)


def fit(train: DataFrame) -> Model:
    """A model of the labelled rows (doc_id, text, lang)."""
    labelled = train.filter(F.col("lang").isNotNull())
    sizes = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()  # a row per language
    if not sizes:
        return Model([], {})
    # each language's share of rows, by the hash of the id
    share = F.create_map(*(F.lit(x) for r in sizes for x in (r["lang"], min(1.0, SAMPLE / r["count"]))))[F.col("lang")]
    unit = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) / float(1 << 20)
    found = _profiles(labelled.filter(unit < share))
    per_lang = found.groupBy("lang").agg(F.sum("c").alias("all"))
    found = found.join(F.broadcast(per_lang), "lang").withColumn("share", F.col("c") / F.col("all"))  # a row per language
    top = found.groupBy("gram").agg(F.max("share").alias("top"))
    own = found.filter("c > 1").join(top, "gram").filter(F.col("share") >= OWN * F.col("top"))
    least = _cut(own)
    kept = own.join(F.broadcast(least), "lang").filter(F.col("c") > F.col("least")).select("lang", "gram").toArrow()  # at most PROFILE a language
    langs, grams = np.array(kept["lang"].to_pylist(), dtype=object), kept["gram"].to_numpy().astype(np.uint64)
    return Model([r["lang"] for r in sizes], {r["lang"]: grams[langs == r["lang"]] for r in sizes})


def _cut(own: DataFrame) -> DataFrame:
    """lang, least: the count above which a language has at most PROFILE n-grams."""
    from pyspark.sql import Window

    steps = own.groupBy("lang", "c").agg(F.count("*").alias("n"))
    above = Window.partitionBy("lang").orderBy(F.desc("c")).rowsBetween(Window.unboundedPreceding, 0)
    steps = steps.withColumn("sum", F.sum("n").over(above))
    return steps.groupBy("lang").agg(F.coalesce(F.max(F.when(F.col("sum") > PROFILE, F.col("c"))), F.lit(0)).alias("least"))


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of docs (doc_id, held_out, text)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    out = "doc_id bigint, held_out boolean, lang_pred string, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, schema = sent.value, arrow_schema(out)
        names = [*known.langs, "und"]
        for rows, data, offsets in doc_blocks(batches):
            total, hits = known.counts(data, offsets)
            raw = data.tobytes()
            letter = np.array([any(map(str.isalpha, raw[a:b].decode())) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], dtype=bool)
            if known.langs:
                fair = np.maximum(0.0, hits - total[:, None] * known.chance) / (1 - known.chance)
                best = np.where(letter, fair.argmax(axis=1), len(known.langs))
                sum_ = fair.sum(axis=1)
                score = np.where(letter & (sum_ > 0), fair.max(axis=1) / np.maximum(sum_, 1e-12), 0.0)
            else:
                best, score = np.zeros(len(letter), np.int64), np.zeros(len(letter))
            yield arrow_rows(schema, rows.column(0), rows.column(1), [names[b] for b in best], score)

    return docs.select(F.col("doc_id").cast("long"), "held_out", F.col(text).alias("text")).mapInArrow(run, out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: the language of every document."""
    docs = documents(spark, sf_dir).withColumn("held_out", bucket(F.col("doc_id"), 4) == 2)
    model = fit(docs.filter(~F.col("held_out")).select("doc_id", "text", "lang"))
    return predict(docs.select("doc_id", "held_out", "text"), model)
