"""Benchmark decontamination by an FM-index per training shard.

A shard is a block of whole documents. Its word sequence, as far as it can hold a test phrase
(see PhraseSet), becomes a suffix array, of which the index keeps the transformed sequence in a
wavelet tree and every SAMPLE-th suffix position. Each distinct test phrase (a window of
WINDOW item words) is searched backwards through the tree's ranks; its occurrences are located by
walking to sampled positions, and their spans are merged per document.

Test phrases reach the executors in blocks of items with about ITEM_WORDS words at most, one pass over
the documents for each block, so what is broadcast has a bound whatever the benchmark's size.

Defined results: NULL and empty texts have no words and no hits; an item without words is no
item; an item id counts once, however many rows have it; repeated documents are judged one by one; an empty benchmark hits
nothing and an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm.common import documents, fresh, store
from touchline.llm.kernels import HashIndex, Words, arrow_rows, arrow_schema, doc_blocks, mix64, sums_by_doc, table

WINDOW = 10
#: Words of items in one block of the benchmark: about 150 MB in the driver, half of that on its way to a worker.
ITEM_WORDS = 1_000_000
#: Every SAMPLE-th position of the sequence is kept for locating.
SAMPLE = 16


class WaveletTree:
    """Ranks in a sequence of symbols 0 .. 2 ** levels - 1, level by level from the highest bit."""

    def __init__(self, seq: np.ndarray, levels: int):
        self.n, self.levels = len(seq), levels
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        for level in reversed(range(levels)):
            bit = (seq >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(len(seq) - int(self.ones[-1][-1]))
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before the position beside it."""
        low, high = np.zeros(len(at), np.int64), at.astype(np.int64)
        for k, level in enumerate(reversed(range(self.levels))):
            one, ones, zeros = ((symbol >> level) & 1).astype(bool), self.ones[k], self.zeros[k]
            a, b = ones[low], ones[high]
            low, high = np.where(one, zeros + a, low - a), np.where(one, zeros + b, high - b)
        return high - low

    def access(self, at: np.ndarray) -> np.ndarray:
        """The symbols at the positions."""
        at, out = at.astype(np.int64), np.zeros(len(at), np.int64)
        for k in range(self.levels):
            ones, zeros = self.ones[k], self.zeros[k]
            a = ones[at]
            one = ones[at + 1] > a
            out = out * 2 + one
            at = np.where(one, zeros + a, at - a)
        return out


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Positions of the suffixes in order, by doubling; only ties are sorted again. The last symbol must be the unique least."""
    n = len(seq)
    order = np.argsort(seq, kind="stable")
    ordered = seq[order]
    rank = np.empty(n, np.int64)
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    heads = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank[order] = heads
    step = 1
    while True:
        size = np.diff(np.append(np.flatnonzero(new), n))
        tied = np.flatnonzero(np.repeat(size > 1, size))
        if not len(tied):
            return order
        who = order[tied]
        after = np.where(who + step < n, rank[np.minimum(who + step, n - 1)], -1)
        again = np.lexsort((after, heads[tied]))
        who, after, group = who[again], after[again], heads[tied][again]
        order[tied] = who
        fresh = np.concatenate([[True], (group[1:] != group[:-1]) | (after[1:] != after[:-1])])
        new[tied] = fresh
        heads = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        rank[order[tied]] = heads[tied]
        step *= 2


class FMIndex:
    """Backward search and locating over a sequence of symbols >= 1; 0 closes it."""

    def __init__(self, seq: np.ndarray, sigma: int, sample: int = SAMPLE):
        seq = np.append(seq, 0).astype(np.int64)
        sa = suffix_array(seq)
        levels = max(1, int(sigma).bit_length())
        self.tree = WaveletTree(seq[sa - 1], levels)  # the symbol before each suffix, in suffix order
        self.before = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=sigma + 1))])
        kept = sa % sample == 0
        self.kept_rank = np.concatenate([[0], np.cumsum(kept)])
        self.samples = sa[kept]
        self.n = len(seq)

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges [low, high) of phrases, given as rows filled from the left."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for back in range(int(lengths.max(initial=0))):
            live = np.flatnonzero((lengths > back) & (low < high))
            if not len(live):
                break
            symbol = phrases[live, lengths[live] - 1 - back]
            base = self.before[symbol]
            low[live], high[live] = base + self.tree.rank(symbol, low[live]), base + self.tree.rank(symbol, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The position of each suffix row: steps back to a sampled one."""
        out, steps = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        at, who = rows.astype(np.int64), np.arange(len(rows))
        while len(who):
            hit = self.kept_rank[at + 1] > self.kept_rank[at]
            out[who[hit]] = self.samples[self.kept_rank[at[hit]]] + steps[who[hit]]
            who, at = who[~hit], at[~hit]
            steps[who] += 1
            symbol = self.tree.access(at)
            at = self.before[symbol] + self.tree.rank(symbol, at)
        return out


class PhraseSet:
    """The distinct windows of a block of items, over the alphabet of the items' words."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        low, word = table("alnum")
        data = np.frombuffer(b"".join(t for _, t in items), dtype=np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(t) for _, t in items])]).astype(np.int64)
        words = Words(data, offsets, low, word)
        self.vocabulary, symbols = np.unique(words.hashes, return_inverse=True)
        symbols = (symbols + 1).astype(np.int32)
        n = np.diff(words.first)
        many = np.where(n > 0, np.maximum(n - window + 1, 1), 0)
        item = np.repeat(np.arange(len(items), dtype=np.int32), many)
        start = np.arange(len(item)) - np.repeat(np.cumsum(many) - many, many) + words.first[item]
        length = np.minimum(n, window)[item].astype(np.int32)
        # equal windows have equal hashes; the windows themselves are laid out once each
        made = length.astype(np.uint64)
        for k in range(window):
            inside = np.flatnonzero(length > k)
            made[inside] = mix64(made[inside] + self.vocabulary[symbols[start[inside] + k] - 1])
        _, once, phrase = np.unique(made, return_index=True, return_inverse=True)
        self.lengths = length[once].astype(np.int64)
        self.phrases = np.zeros((len(once), window), np.int32)
        for k in range(window):
            inside = np.flatnonzero(self.lengths > k)
            self.phrases[inside, k] = symbols[start[once[inside]] + k]
        self.items = [item for item, _ in items]
        pairs = np.unique((phrase.astype(np.int64) << 32) | item)
        #: Items of phrase p: owners[owner_first[p]:owner_first[p + 1]].
        self.owners = (pairs & 0xFFFFFFFF).astype(np.int32)
        self.owner_first = np.searchsorted(pairs >> 32, np.arange(len(once) + 1))
        self.shortest = int(self.lengths.min(initial=window))


def find_spans(symbols: np.ndarray, first: np.ndarray, phrases: PhraseSet) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(phrase, first word, document) of every occurrence in a shard.

    symbols: per word its place in the phrases' alphabet, 0 if it has none. A run of known words
    that is shorter than the shortest phrase holds none and is left out of the sequence; the
    others are set apart by a separator, as are documents.
    """
    none = np.zeros(0, np.int64)
    sigma = len(phrases.vocabulary) + 1
    if not len(symbols) or not len(phrases.lengths):
        return none, none, none
    known = symbols > 0
    begins = known.copy()
    begins[1:] &= ~known[:-1]
    docs = first[:-1][first[:-1] < len(symbols)]
    begins[docs] = known[docs]
    starts = np.flatnonzero(begins)
    run = np.cumsum(begins) - 1
    length = np.bincount(run[known], minlength=len(starts)) if len(starts) else none
    use = length >= phrases.shortest
    starts, length = starts[use], length[use]
    if not len(starts):
        return none, none, none
    # runs in a row, each after a separator; origin: the word that a place of the sequence stands for
    size = length + 1
    to = np.cumsum(size) - size
    inner = np.arange(int(size.sum())) - np.repeat(to, size)
    origin = np.repeat(starts, size) + inner - 1
    seq = np.where(inner == 0, sigma, symbols[np.maximum(origin, 0)])
    index = FMIndex(seq, sigma)
    low, high = index.search(phrases.phrases, phrases.lengths)
    count = high - low
    phrase = np.repeat(np.arange(len(count)), count)
    if not len(phrase):
        return none, none, none
    rows = np.repeat(low, count) + np.arange(len(phrase)) - np.repeat(np.cumsum(count) - count, count)
    word = origin[index.locate(rows)]
    return phrase, word, np.searchsorted(first, word, side="right") - 1


OUT = "doc_id bigint, n_words bigint, n_hit bigint, items array<string>, span_from array<bigint>, span_to array<bigint>"


def _scan(rows: DataFrame, phrases: PhraseSet, last: bool) -> DataFrame:
    """One block's findings, added to those that rows has from earlier blocks; the text stays unless this is the last."""
    sent = rows.sparkSession.sparkContext.broadcast(phrases)
    out = OUT if last else f"{OUT}, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, schema = sent.value, arrow_schema(out)
        (low, word), index = table("alnum"), HashIndex(known.vocabulary)
        for part, data, offsets in doc_blocks(batches):
            words = Words(data, offsets, low, word)
            first, n = words.first, len(offsets) - 1
            phrase, at, doc = find_spans(index.find(words.hashes).astype(np.int64) + 1, first, known)
            to = at + known.lengths[phrase]
            items: list[set] = [set() for _ in range(n)]
            for p, d in set(zip(phrase.tolist(), doc.tolist(), strict=True)):
                items[d].update(known.items[i] for i in known.owners[known.owner_first[p] : known.owner_first[p + 1]].tolist())
            named = [sorted(i) for i in items]
            if "items" in part.schema.names:
                had = {c: part.column(c).to_pylist() for c in ("items", "span_from", "span_to")}
                named = [sorted({*i, *j}) for i, j in zip(named, had["items"], strict=True)]  # an id counts once, in however many blocks it is
                at = np.concatenate([at, *(np.array(x, np.int64) + f for x, f in zip(had["span_from"], first, strict=False))])
                to = np.concatenate([to, *(np.array(x, np.int64) + f for x, f in zip(had["span_to"], first, strict=False))])
            cover = np.zeros(len(words.hashes) + 1, np.int64)
            np.add.at(cover, at, 1)
            np.add.at(cover, to, -1)
            hit = np.cumsum(cover[:-1]) > 0
            # merged spans: runs of hit words within a document
            edge = np.zeros(len(hit), dtype=bool)
            edge[first[:-1][first[:-1] < len(hit)]] = True
            begins = np.flatnonzero(hit & (edge | ~np.concatenate([[False], hit[:-1]])))
            ends = np.flatnonzero(hit & np.concatenate([edge[1:] | ~hit[1:], [True]])) + 1 if len(hit) else begins
            owner = np.searchsorted(first, begins, side="right") - 1
            cut = np.searchsorted(owner, np.arange(n + 1))
            froms, tos = (begins - first[owner]).tolist(), (ends - first[owner]).tolist()
            spans = [(froms[cut[d] : cut[d + 1]], tos[cut[d] : cut[d + 1]]) for d in range(n)]
            kept = [] if last else [part.column("text")]
            yield arrow_rows(schema, part.column(0), np.diff(first), sums_by_doc(hit.astype(np.int64), first), named, [s[0] for s in spans], [s[1] for s in spans], *kept)

    return rows.mapInArrow(run, out)


def item_blocks(benchmark: DataFrame, most: int | None = None) -> Iterator[list[tuple[str, bytes]]]:
    """The items, by id, in blocks of at most so many text bytes / 8; a larger item is a block of its own."""
    held, size, most = [], 0, most or ITEM_WORDS
    for row in benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").orderBy("item_id", "text").toLocalIterator():
        text = (row["text"] or "").encode()
        if held and size + len(text) > 8 * most:
            yield held
            held, size = [], 0
        held.append((row["item_id"] or "", text))
        size += len(text)
    yield held


def find_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, items, span_from, span_to (words, merged spans) of every row of docs."""
    rows, block = docs.select("doc_id", F.col(text).alias("text")), None
    for more in item_blocks(benchmark):
        if block is not None:
            rows = store(_scan(rows, PhraseSet(block), last=False), "contamination")
        block = more
    return _scan(rows, PhraseSet(block), last=True)


def without_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs that share no window with the benchmark."""
    key, (mark,) = F.xxhash64("doc_id", text), fresh(docs, "_hit")
    found = find_contamination(docs.select(key.alias("doc_id"), F.col(text).alias("text")), benchmark)
    hit = found.filter("n_hit > 0").select(F.col("doc_id").alias(mark)).distinct()
    return docs.join(hit, key == F.col(mark), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: what every document shares with the benchmark."""
    found = find_contamination(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    digest = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\x{80}-\x{10FFFF}]+')"
_WINDOWS = "unnest(list_transform(range(1, len(w) - n + 2), lambda i: {'i': i, 'words': array_to_string(w[i:i + n - 1], ' ')})) AS s"

ORACLE = f"""
WITH docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
items AS (SELECT item_id, w, least(len(w), {WINDOW}) AS n FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
windows AS (SELECT item_id, n, s.words AS words FROM (SELECT item_id, n, {_WINDOWS} FROM items)),
places AS (SELECT doc_id, n, s.i AS i, s.words AS words FROM (SELECT doc_id, n, {_WINDOWS} FROM docs, (SELECT DISTINCT n FROM items) WHERE len(w) >= n)),
hits AS (SELECT DISTINCT doc_id, item_id, i, n FROM places JOIN windows USING (n, words)),
covered AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hits) GROUP BY 1),
owners AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered USING (doc_id) LEFT JOIN owners USING (doc_id)
"""


def clean_items(text: str | None, window: int = WINDOW) -> list[tuple]:
    """The windows of one item in plain Python, for tests."""
    import re

    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return [tuple(words[k : k + window]) for k in range(max(1, len(words) - window + 1) if words else 0)]


def brute_force(docs: list[tuple[int, str | None]], items: list[tuple[int, str | None]]) -> dict[int, tuple]:
    """doc_id -> (n_words, n_hit, n_items, items_sha256) in plain Python, for tests."""
    import re

    windows: dict[tuple, set] = {}
    for item, text in items:
        for w in clean_items(text):
            windows.setdefault(w, set()).add(str(item))
    sizes = {len(w) for w in windows}
    out = {}
    for doc, text in docs:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
        hit, found = set(), set()
        for size in sizes:
            for k in range(len(words) - size + 1):
                if owners := windows.get(tuple(words[k : k + size])):
                    hit.update(range(k, k + size))
                    found |= owners
        out[doc] = (len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest())
    return out
