"""Language-model scoring with a log-frequency Bloom filter.

A bigram model over all words and an end token, keyed by 64-bit hashes. Training counts are gathered
whole: every bigram with its count is in the filter, as the entries (bigram, 1) .. (bigram,
level), level = 1 + floor(log2 count), and so is every word outside the head. Scoring probes levels
until one is missing, which gives the quantised count back; a false hit needs all PROBES bits by
chance. The head is a cache of fixed size: the exact counts of the most frequent words, which the base
score takes as they are and the score quantised, so its size shows in no score.
With c the quantised counts, p(w) = (c(w) + 1) / (N + V + 1) and
p(w | v) = (min(max(c(v w) - DISCOUNT, 0), c(v)) + MU p(w)) / (c(v) + MU).

The filter is made of segments, one for a range of hashes, each built by one task from packed,
already merged counts. It grows with the corpus: up to BROADCAST_BYTES it is broadcast at once,
and beyond that in groups of segments of at most that size, one pass over the documents for each
group, since a text's score is a sum over bigrams. A group is released after its pass.

Defined results: NULL and empty texts are one end token; NULL ids hash as the empty text;
repeated rows are scored one by one (and train the model each time); without training rows all
base scores and scores are 0; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm.common import bucket, documents, store
from touchline.llm.kernels import HashIndex, Words, arrow_rows, arrow_schema, doc_blocks, mix64, table

#: Words with exact counts on every executor, and the most bytes of the filter there at once.
HEAD, BROADCAST_BYTES = 1 << 19, 128 << 20
#: Filter bits for an entry, bits that a probe looks at; tokens merged before they are sent; bigrams of a segment, about.
ENTRY_BITS, PROBES, MERGE, SEGMENT = 10, 7, 2_000_000, 2_000_000
MU, DISCOUNT = 300.0, 0.5
END = np.uint64(0x9AE16A3B2F90404F)


def _levels(counts: np.ndarray) -> np.ndarray:
    return np.frexp(counts.astype(np.float64))[1]


def _estimate(level: np.ndarray) -> np.ndarray:
    """The middle of the counts that a level stands for; 0 for level 0."""
    top = np.exp2(level)
    return np.where(level > 0, (top / 2 + top - 1) / 2, 0.0)


def _merged(held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    ordered = np.sort(np.concatenate(held)) if held else np.zeros(0, np.uint64)
    edge = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)
    return ordered[edge], np.diff(np.append(edge, len(ordered)))


def vocabulary(train: DataFrame) -> DataFrame:
    """w (hash), c of every word of the texts and of the end token."""
    out = "w bigint, c bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, (low, word), held, docs = arrow_schema(out), table("blank"), [], 0
        for rows, data, offsets in doc_blocks(batches):
            held.append(Words(data, offsets, low, word).hashes)
            docs += len(offsets) - 1
            if sum(map(len, held)) > MERGE:
                keys, counts = _merged(held)
                yield arrow_rows(schema, keys.view(np.int64), counts)
                held = []
        keys, counts = _merged(held)
        yield arrow_rows(schema, keys.view(np.int64), counts)
        if docs:
            yield arrow_rows(schema, np.array([END]).view(np.int64), [docs])

    return store(train.select("text").mapInArrow(run, out).groupBy("w").agg(F.sum("c").alias("c")), "vocabulary")


class Head:
    """Exact counts of the frequent words, the end token always among them; a cache of what the filter holds quantised."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, tokens: int, distinct: int):
        order = np.argsort(words)
        self.words, self.tokens, self.distinct = words[order], tokens, distinct
        self.counts = counts[order].astype(np.float64)

    def count(self, index: HashIndex, hashes: np.ndarray) -> np.ndarray:
        """The count of each word, -1 outside the head."""
        place = index.find(hashes)
        return np.where(place < 0, -1.0, self.counts[place]) if len(self.counts) else np.full(len(hashes), -1.0)


def sequence(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of the tokens, of the token before each, where each text starts); the end token closes and precedes a text."""
    n = len(words.first) - 1
    token = np.full(len(words.hashes) + n, END, np.uint64)
    token[np.arange(len(words.hashes)) + np.repeat(np.arange(n), np.diff(words.first))] = words.hashes
    start = words.first + np.arange(n + 1)
    before = np.empty_like(token)
    before[1:] = token[:-1]
    before[start[:-1]] = END
    return token, before, start


def _grams(before: np.ndarray, token: np.ndarray) -> np.ndarray:
    return mix64(mix64(before) + token)


def choose_head(words: DataFrame, most: int) -> tuple[Head, DataFrame]:
    """The head: the end token and the most frequent words that are at most so many, and the words left with their counts.

    The head only decides where counts are looked up, not which words or bigrams are modelled.
    """
    end = int(np.array([END]).view(np.int64)[0])
    fine = F.when(F.col("w") == end, F.lit(1 << 20)).when(F.col("c") < 1024, F.col("c")).otherwise(1024 + F.floor((F.log2("c") - 10) * 64)).cast("int")
    words = words.withColumn("_rank", fine)
    steps = words.groupBy("_rank").agg(F.count("*").alias("n"), F.sum("c").alias("c")).collect()  # under 5,000 rows
    tokens, distinct, cut, room = sum(r["c"] for r in steps), sum(r["n"] for r in steps), 1 << 20, most
    for row in sorted(steps, key=lambda r: -r["_rank"]):
        room -= row["n"]
        if room < 0:
            break
        cut = row["_rank"]
    top = words.filter(F.col("_rank") >= cut).select("w", "c").toArrow()
    head = Head(top["w"].to_numpy().view(np.uint64), top["c"].to_numpy(), tokens, distinct)
    return head, words.filter(F.col("_rank") < cut).select("w", "c")


FILTER = "r int, n_bits bigint, n_grams bigint, bits binary"


def _positions(grams: np.ndarray, level: int, probe: int, n_bits: np.ndarray | int) -> np.ndarray:
    x = mix64(grams + np.uint64(level * 0x9E3779B97F4A7C15 % 2**64))
    step = (x >> np.uint64(32)) | np.uint64(1)
    return ((x & np.uint64(0xFFFFFFFF)) + np.uint64(probe) * step) % np.asarray(n_bits, dtype=np.uint64)


def segment(grams: np.ndarray, counts: np.ndarray) -> tuple[int, bytes]:
    """(bits, the packed bits) of the filter of counted bigrams."""
    levels = _levels(counts)
    n_bits = max(64, (int(levels.sum()) * ENTRY_BITS + 63) // 64 * 64)
    bits = np.zeros(n_bits, dtype=bool)
    for level in range(1, int(levels.max(initial=0)) + 1):
        have = grams[levels >= level]
        for probe in range(PROBES):
            bits[_positions(have, level, probe, n_bits).astype(np.int64)] = True
    return n_bits, np.packbits(bits, bitorder="little").tobytes()


def _ranges(entries: int) -> int:
    """How many ranges of hashes, about SEGMENT entries each."""
    return 1 << max(0, (entries // SEGMENT).bit_length())


def _range_of(grams: np.ndarray, ranges: int) -> np.ndarray:
    bits = (ranges - 1).bit_length()
    return (grams >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(grams), np.int64)


PACKED = "r int, grams binary, counts binary"


def _packed(grams: np.ndarray, counts: np.ndarray, ranges: int) -> pa.RecordBatch:
    """Counted grams in ascending order, packed by range."""
    range_ = _range_of(grams, ranges)
    edge = np.flatnonzero(np.concatenate([[True], range_[1:] != range_[:-1]])) if len(grams) else np.zeros(0, np.int64)
    ends = np.append(edge[1:], len(grams)) if len(edge) else edge
    return arrow_rows(arrow_schema(PACKED), range_[edge], [grams[a:b].tobytes() for a, b in zip(edge, ends, strict=True)], [counts[a:b].astype("<u4").tobytes() for a, b in zip(edge, ends, strict=True)])


def _segments(packed: DataFrame, ranges: int, tag: str) -> DataFrame:
    """The filter's segments: a task for about every range, so tasks stay as large as they are when the corpus grows."""

    def build(key: tuple, rows: pa.Table) -> pa.Table:
        grams = np.concatenate([np.frombuffer(b, "<u8") for b in rows["grams"].to_pylist()])
        counts = np.concatenate([np.frombuffer(b, "<u4") for b in rows["counts"].to_pylist()]).astype(np.int64)
        order = np.argsort(grams)
        grams, counts = grams[order], counts[order]
        edge = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
        n_bits, bits = segment(grams[edge], np.add.reduceat(counts, edge))
        return pa.Table.from_batches([arrow_rows(arrow_schema(FILTER), [key[0].as_py()], [n_bits], [len(edge)], [bits])])

    return store(packed.repartition(ranges, "r").groupBy("r").applyInArrow(build, FILTER), tag)


def build_filter(train: DataFrame, ranges: int) -> DataFrame:
    """The filter's segments over all bigrams of the texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (low, word), held = table("blank"), []
        for _, data, offsets in doc_blocks(batches):
            token, before, _ = sequence(Words(data, offsets, low, word))
            held.append(_grams(before, token))
            if sum(map(len, held)) > MERGE:
                yield _packed(*_merged(held), ranges)
                held = []
        yield _packed(*_merged(held), ranges)

    return _segments(train.select("text").mapInArrow(count, PACKED), ranges, "filter")


def build_words(rest: DataFrame, ranges: int) -> DataFrame:
    """Segments with the counts of the words outside the head."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = batch.column(0).to_numpy().view(np.uint64)
            order = np.argsort(grams)
            yield _packed(grams[order], batch.column(1).to_numpy()[order], ranges)

    return _segments(rest.select("w", "c").mapInArrow(pack, PACKED), ranges, "rare-words")


class Filter:
    """A group of the filter's segments: those of ranges low <= r < high."""

    def __init__(self, rows: pa.Table, low: int, high: int, ranges: int):
        self.low, self.high, self.ranges = low, high, ranges
        parts = {r: (n, b) for r, n, b in zip(rows["r"].to_pylist(), rows["n_bits"].to_pylist(), rows["bits"].to_pylist(), strict=True)}
        sizes = np.array([parts[r][0] if r in parts else 64 for r in range(low, high)], dtype=np.int64)
        self.n_bits, self.base = sizes.astype(np.uint64), np.cumsum(sizes) - sizes
        self.bits = np.frombuffer(b"".join(parts[r][1] if r in parts else bytes(8) for r in range(low, high)), dtype=np.uint8)

    def levels(self, grams: np.ndarray, range_: np.ndarray) -> np.ndarray:
        out, who = np.zeros(len(grams), np.int64), np.arange(len(grams))
        level = 1
        while len(who) and level < 64:
            for probe in range(PROBES):
                at = _positions(grams[who], level, probe, self.n_bits[range_[who]]).astype(np.int64) + self.base[range_[who]]
                who = who[(self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0]
                if not len(who):
                    break
            out[who] = level
            level += 1
        return out

    def look(self, grams: np.ndarray) -> np.ndarray:
        """The level of each gram, -1 where it is another group's; each distinct one is probed once."""
        if not len(grams):
            return np.zeros(0, np.int64)
        once, back = np.unique(grams, return_inverse=True)
        range_ = _range_of(once, self.ranges) - self.low
        mine = np.flatnonzero((range_ >= 0) & (range_ < self.high - self.low))
        found = np.full(len(once), -1, np.int64)
        found[mine] = self.levels(once[mine], range_[mine])
        return found[back]


SCORED = "doc_id bigint, row bigint, held_out boolean, n_tokens bigint, head_known bigint, head_sum double, rest array<bigint>, score double"


def _score(rows: DataFrame, sent_head: Broadcast, sent_words: Broadcast | None, sent_grams: Broadcast | None, first: bool, last: bool) -> DataFrame:
    """One pass: counts of rare words and terms of bigrams that the groups at hand hold are added to what rows has.

    rare: a byte for every token outside the head, its level, filled before the first bigrams are looked up.
    """
    out = SCORED if last else f"{SCORED}, rare binary, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, schema, (low, word) = sent_head.value, arrow_schema(out), table("blank")
        index, row = HashIndex(known.words), TaskContext.get().partitionId() << 33
        for part, data, offsets in doc_blocks(batches):
            words, n = Words(data, offsets, low, word), len(offsets) - 1
            token, before, start = sequence(words)
            exact = known.count(index, token)
            seen, lost = exact > 0, np.flatnonzero(exact < 0)
            rare = np.zeros(len(lost), np.int64)
            if not first:
                had = {c: part.column(part.schema.get_field_index(c)) for c in (*(f.name for f in arrow_schema(SCORED)), "rare")}
                rare += np.frombuffer(b"".join(had["rare"].to_pylist()), np.uint8)
            if sent_words is not None:
                rare += np.maximum(sent_words.value.look(token[lost]), 0)
            total = np.zeros(n)
            if sent_grams is not None:
                # the score takes every count as the filter would hold it, wherever it was looked up
                count = _estimate(np.where(exact > 0, _levels(np.maximum(exact, 1)), 0))
                count[lost] = _estimate(rare)
                context_ = np.empty_like(count)
                context_[1:] = count[:-1]
                context_[start[:-1]] = count[start[1:] - 1]
                level = sent_grams.value.look(_grams(before, token))
                unigram = (count + 1) / (known.tokens + known.distinct + 1)
                chance = (np.minimum(np.maximum(_estimate(level) - DISCOUNT, 0), context_) + MU * unigram) / (context_ + MU)
                total = np.add.reduceat(np.where(level < 0, 0.0, np.log10(chance)), start[:-1])
            if first:
                logs = np.where(seen, np.log10(np.maximum(exact, 0) + 1), 0.0)
                cut = np.searchsorted(lost, start)
                lists = pa.ListArray.from_arrays(pa.array(cut, type=pa.int32()), pa.array(token[lost].view(np.int64)))
                columns = [part.column(0), row + np.arange(n), part.column(part.schema.get_field_index("held_out")), np.diff(start), np.add.reduceat(seen.astype(np.int64), start[:-1]), np.add.reduceat(logs, start[:-1]), lists, total]
            else:
                columns = [*(had[f.name] for f in list(arrow_schema(SCORED))[:-1]), total + had["score"].to_numpy()]
            if not last:
                cut = np.searchsorted(lost, start)
                raw = rare.astype(np.uint8).tobytes()
                columns += [[raw[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)], part.column(part.schema.get_field_index("text"))]
            row += n
            yield pa.RecordBatch.from_arrays([c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return rows.mapInArrow(run, out)


def _groups(segments: DataFrame, ranges: int, most: int) -> list[tuple[int, int]]:
    """Runs of ranges whose segments have at most so many bytes together."""
    sizes = {r["r"]: r["n_bits"] // 8 for r in segments.select("r", "n_bits").collect()}  # a row for a range
    runs, low, held = [], 0, 0
    for r in range(ranges):
        if held and held + sizes.get(r, 8) > most:
            runs.append((low, r))
            low, held = r, 0
        held += sizes.get(r, 8)
    return [*runs, (low, ranges)]


def _send(segments: DataFrame, group: tuple[int, int], ranges: int) -> Broadcast:
    low, high = group
    part = segments.filter((F.col("r") >= low) & (F.col("r") < high)).select("r", "n_bits", "bits").toArrow()
    return segments.sparkSession.sparkContext.broadcast(Filter(part, low, high, ranges))


def score_documents(docs: DataFrame, held_out: str = "held_out", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row; rows not held out are learned from."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(held_out).alias("held_out"), F.col(text).alias("text"))
    train = rows.filter(~F.col("held_out"))
    words = vocabulary(train)
    head, rest = choose_head(words, HEAD)
    ranges, word_ranges = _ranges(head.tokens), _ranges(max(0, head.distinct - len(head.words)))
    segments, rare = build_filter(train, ranges), build_words(rest, word_ranges)
    word_groups, gram_groups = _groups(rare, word_ranges, BROADCAST_BYTES // 4), _groups(segments, ranges, BROADCAST_BYTES)
    # the last group of words goes with the first of bigrams
    passes = [(w, None) for w in word_groups[:-1]] + [(word_groups[-1], gram_groups[0])] + [(None, g) for g in gram_groups[1:]]
    sent_head = docs.sparkSession.sparkContext.broadcast(head)
    for k, (w, g) in enumerate(passes):
        sent_words, sent_grams = w and _send(rare, w, word_ranges), g and _send(segments, g, ranges)
        rows = store(_score(rows, sent_head, sent_words, sent_grams, k == 0, k == len(passes) - 1), "scores")
        for sent in (sent_words, sent_grams):
            if sent is not None:
                sent.destroy()  # the pass is written: no task asks for it again
    others = rows.select("row", F.explode("rest").alias("w")).join(rest, "w")
    others = others.groupBy("row").agg(F.sum(F.log10(F.col("c") + 1)).alias("rest_sum"), F.count("*").alias("rest_known"))
    every = rows.drop("rest").join(others, "row", "left")
    base = F.col("head_sum") + F.coalesce("rest_sum", F.lit(0.0)) - F.col("n_tokens") * F.log10(F.lit(float(head.tokens + head.distinct + 1)))
    return every.select("doc_id", "held_out", "n_tokens", (F.col("head_known") + F.coalesce("rest_known", F.lit(0))).alias("n_known"), F.lit(head.tokens).cast("long").alias("train_tokens"), base.alias("base_score"), "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: base and model scores of every document."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return score_documents(docs.withColumn("held_out", bucket(F.col("doc_id"), 7) == 2))
