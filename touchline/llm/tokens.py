"""Token ids in Re-Pair compressed shards.

Documents, in ascending order of doc_id, become token ids closed by an end id; runs of about
SHARD_TOKENS ids form a shard. Per shard, rounds of Re-Pair replace frequent pairs by
nonterminals; a pair never starts with an end id, so every document begins at a symbol and can be
decoded alone. A shard is one row of the file format (Parquet): the pairs of its rules, how many
ids each rule expands to, the symbols left, and the documents' ids and lengths.

Defined results: NULL and empty texts are the end id alone; NULL ids come first; equal ids are
ordered by text; an empty table writes no shard; extra columns of the input are not written.
"""

from __future__ import annotations

import contextlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from touchline.llm.common import documents, scratch_dir
from touchline.llm.kernels import HashIndex, Words, arrow_schema, doc_blocks, table

TOKENIZER = "word_bpe_49k.json"
END_ID = 2
SHARD_TOKENS = 1 << 20
#: Re-Pair: rounds at most, rules of a shard at most, uses that make a rule worth its two symbols.
ROUNDS, MAX_RULES, MIN_USES = 8, 16_000, 8
#: Bits of a cell's number in the table of a round's pairs.
CELL_BITS = 17

#: Words whose pieces can be counted: signs and letters up to U+00FF, which normalisation leaves as they are.
_LATIN = re.compile(r"[!-~\u00a1-\u00ac\u00ae-\u00ff]+")

FORMAT = "part int, shard int, doc_ids array<bigint>, doc_tokens array<bigint>, n_tokens bigint, base int, rules binary, expansions binary, symbols binary"


class WordEncoder:
    """Token ids of words, each distinct one tokenized once and remembered.

    It serves tokenizers that lower-case, drop white space and then work on the pieces that a pattern
    finds (checked on the file: ValueError for others), so a text's ids are those of its words in
    turn. A full stop or comma that ends a word of letters is a piece too.
    """

    MEMO = 4_000_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        made = json.loads(self.tokenizer.to_str())
        steps = [made["pre_tokenizer"], *(made["pre_tokenizer"] or {}).get("pretokenizers", [])]
        split = next((x for x in steps if x and x["type"] == "Split"), None)
        if split is None or not split["invert"] or split["behavior"] != "Removed" or "Lowercase" not in json.dumps(made["normalizer"]) or any(not t["content"].startswith("<|") for t in made["added_tokens"]):
            raise ValueError(f"{path} is no tokenizer of lower-cased words without white space")
        #: The pattern of its pieces; None where a piece's last id does not tell that it is the last.
        self.pieces = regex.compile(split["pattern"]["Regex"]) if made["model"].get("end_of_word_suffix") == "</w>" else None
        self.ends = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True) + 1, dtype=bool)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.ends[i] = token.endswith("</w>")
        self._clear()

    def _clear(self) -> None:
        self.index, self.ids = HashIndex(), np.zeros(1 << 16, np.uint32)
        self.start, self.size, self.used = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0

    def _batched(self, words: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """(ids, ids of each word) of words tokenized as one text; None if its pieces are not those expected.

        Pieces never cross a space, and each ends with an id of self.ends, so counts of pieces tell the words apart.
        """
        if not all(map(_LATIN.fullmatch, words)):
            return None
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, dtype=np.uint32)
        cuts = np.flatnonzero(self.ends[ids]) + 1
        pieces = np.array([1 if w.isalpha() else len(self.pieces.findall(w.lower())) for w in words], dtype=np.int64)
        if len(cuts) != pieces.sum() or (len(cuts) and cuts[-1] != len(ids)):
            return None
        bounds = np.concatenate([[0], cuts])[np.concatenate([[0], np.cumsum(pieces)])]
        return ids, np.diff(bounds)

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, ids of each word)."""
        if (made := self._batched(words) if self.pieces else None) is not None:
            return made
        lists = [m.ids for m in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return np.array([i for m in lists for i in m], np.uint32), np.array([len(m) for m in lists], np.int64)

    def _learn(self, words: Words, hashes: np.ndarray, at: np.ndarray) -> None:
        if len(self.index.keys) + len(hashes) > self.MEMO:
            self._clear()
        raw = words.data.tobytes()
        texts = b"\n".join([raw[a:b] for a, b in zip(words.starts[at].tolist(), words.ends[at].tolist(), strict=True)]).decode().split("\n")
        latin = np.fromiter((_LATIN.fullmatch(w) is not None for w in texts), bool, len(texts))
        for some in (np.flatnonzero(latin), np.flatnonzero(~latin)):
            for k in range(0, len(some), 2000):
                these = some[k : k + 2000]
                flat, sizes = self._encode([texts[i] for i in these.tolist()])
                while self.used + len(flat) > len(self.ids):
                    self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), np.uint32)])
                self.ids[self.used : self.used + len(flat)] = flat
                self.start.append(self.used + np.cumsum(sizes) - sizes)
                self.size.append(sizes)
                self.used += len(flat)
            self.index.add(hashes[some])
        self.start, self.size = [np.concatenate(self.start)], [np.concatenate(self.size)]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each closed by END_ID; ids of each text) for a block of texts."""
        special = b"<|" in data.tobytes()  # the strings of special tokens count in their own case only
        low, word = table("blank", lower=not special)
        cut = None
        if len(data) and not special:
            after = np.append(data[1:], np.uint8(32))
            ends = ~word[after]
            ends[offsets[1:][offsets[1:] > 0] - 1] = True
            letter = np.zeros(256, dtype=bool)
            letter[97:123] = letter[65:91] = True
            cut = ((data == 46) | (data == 44)) & ends
            cut[1:] &= letter[data[:-1]]
            cut[0] = False
        words = Words(data, offsets, low, word, cut)
        known = self.index.find(words.hashes)
        if (known < 0).any():
            missing = np.flatnonzero(known < 0)
            hashes, where = np.unique(words.hashes[missing], return_index=True)
            before = len(self.index.keys)
            self._learn(words, hashes, missing[where])
            known = self.index.find(words.hashes) if len(self.index.keys) < before + len(hashes) else np.where(known < 0, self.index.find(words.hashes), known)
            if (known < 0).any():  # the memo was emptied: what it held is learned anew
                missing = np.flatnonzero(known < 0)
                hashes, where = np.unique(words.hashes[missing], return_index=True)
                self._learn_more(words, hashes, missing[where])
                known = self.index.find(words.hashes)
        size = self.size[0][known]
        total = np.concatenate([[0], np.cumsum(size)])
        per_doc = total[words.first[1:]] - total[words.first[:-1]] + 1
        out = np.empty(int(total[-1]) + len(per_doc), np.uint32)
        shift = np.repeat(np.arange(len(per_doc)), np.diff(words.first))  # ids of ends so far
        to = total[:-1] + shift
        if len(size):
            inner = np.arange(int(total[-1])) - np.repeat(total[:-1], size)
            out[inner + np.repeat(to, size)] = self.ids[inner + np.repeat(self.start[0][known], size)]
        out[np.cumsum(per_doc) - 1] = END_ID
        return out, per_doc

    def _learn_more(self, words: Words, hashes: np.ndarray, at: np.ndarray) -> None:
        keep, self.MEMO = self.MEMO, 1 << 62
        self._learn(words, hashes, at)
        self.MEMO = keep


def compress(ids: np.ndarray, base: int, stop: int = END_ID) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Re-Pair in rounds -> (symbols, rules as pairs of symbols, ids that each rule expands to).

    A round counts all neighbouring pairs, makes rules of the most frequent ones and replaces
    them where they are the more frequent of the two pairs that want a symbol.
    """
    seq = ids.astype(np.uint32)
    narrow = base + MAX_RULES <= 1 << 16  # then a pair fits into 32 bits
    kind, half = (np.uint32, np.uint32(16)) if narrow else (np.uint64, np.uint64(32))
    none = np.iinfo(kind).max
    rules: list[np.ndarray] = []
    n_rules = 0
    for turn in range(ROUNDS):
        if len(seq) < 2 or n_rules >= MAX_RULES:
            break
        keys = (seq[:-1].astype(kind) << half) | seq[1:].astype(kind)
        keys[seq[:-1] == stop] = none
        ordered = np.sort(keys)
        edge = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        counts = np.diff(np.append(edge, len(ordered)))
        pairs = ordered[edge]
        often = (counts >= MIN_USES) & (pairs != none)
        pairs, counts = pairs[often], counts[often]
        most = min(MAX_RULES // 4, MAX_RULES - n_rules)
        best = np.argsort(-counts, kind="stable")[:most]
        pairs, counts = pairs[best], counts[best]
        if not len(pairs):
            break
        # a direct-mapped table of the pairs; where two want a cell the more frequent stays
        spin, shift = kind((0x9E3779B97F4A7C15 >> (32 if narrow else 0)) + 2 * turn), kind((32 if narrow else 64) - CELL_BITS)
        cells = np.full(1 << CELL_BITS, -1, np.int16)
        cells[((pairs * spin) >> shift)[::-1]] = np.arange(len(pairs) - 1, -1, -1, dtype=np.int16)
        rule = cells.take((keys * spin) >> shift)
        at = np.flatnonzero(rule >= 0)
        rule = rule[at]
        same = pairs[rule] == keys[at]
        at, rule = at[same], rule[same]
        weight, beside = counts[rule], np.diff(at) == 1
        take = np.ones(len(at), dtype=bool)
        take[1:] &= ~beside | (weight[1:] > weight[:-1])
        take[:-1] &= ~beside | (weight[:-1] >= weight[1:])
        uses = np.bincount(rule[take], minlength=len(pairs))
        kept = uses >= MIN_USES // 2
        take &= kept[rule]
        if not take.any():
            break
        number = (np.cumsum(kept) - 1 + n_rules + base).astype(np.uint32)
        at, rule = at[take], rule[take]
        seq[at] = number[rule]
        left = np.ones(len(seq), dtype=bool)
        left[at + 1] = False
        seq = seq[left]
        chosen = pairs[kept].astype(np.uint64)
        rules.append(np.stack([chosen >> np.uint64(half), chosen & np.uint64((1 << int(half)) - 1)], axis=1).astype(np.uint32))
        n_rules += int(kept.sum())
    table_ = np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)
    return seq, table_, expansions(table_, base)


def expansions(rules: np.ndarray, base: int) -> np.ndarray:
    """Ids that each rule stands for; rules use earlier ones only."""
    size = np.ones(len(rules), np.int64)
    for i, (a, b) in enumerate(rules.tolist()):
        size[i] = (size[a - base] if a >= base else 1) + (size[b - base] if b >= base else 1)
    return size


def _unfold(symbols: np.ndarray, rules: np.ndarray, base: int) -> np.ndarray:
    """The ids that symbols stand for, level by level."""
    seq = symbols.astype(np.uint32)
    while (big := seq >= base).any():
        size = np.where(big, 2, 1)
        to = np.cumsum(size) - size
        out = np.empty(int(size.sum()), np.uint32)
        out[to[~big]] = seq[~big]
        pair = rules[seq[big] - base]
        out[to[big]], out[to[big] + 1] = pair[:, 0], pair[:, 1]
        seq = out
    return seq


def expand(symbols: np.ndarray, rules: np.ndarray, base: int) -> np.ndarray:
    """The ids that symbols stand for: every rule is unfolded once, and symbols are looked up."""
    if not len(rules) or not len(symbols):
        return symbols.astype(np.uint32)
    size = np.concatenate([np.ones(base, np.int32), expansions(rules, base).astype(np.int32)])
    start = np.cumsum(size, dtype=np.int64) - size
    unfolded = np.concatenate([np.arange(base, dtype=np.uint32), _unfold(rules.ravel(), rules, base)])
    each = size[symbols]
    ahead = np.cumsum(each, dtype=np.int64) - each
    return unfolded[np.repeat(start[symbols] - ahead, each) + np.arange(int(each.sum()))]


def _kind(base: int) -> np.dtype:
    return np.dtype("<u2") if base + MAX_RULES <= 1 << 16 else np.dtype("<u4")


def decode_range(row: dict, start: int, stop: int) -> np.ndarray:
    """Ids start..stop of a shard, from the symbols that cover them alone."""
    kind, base = _kind(row["base"]), row["base"]
    symbols = np.frombuffer(row["symbols"], kind)
    rules = np.frombuffer(row["rules"], kind).reshape(-1, 2)
    size = np.frombuffer(row["expansions"], "<i8")
    width = np.ones(len(symbols), np.int64)
    big = symbols >= base
    width[big] = size[symbols[big] - base]
    ends = np.cumsum(width)
    low, high = np.searchsorted(ends, start, side="right"), np.searchsorted(ends, stop, side="left")
    ids = expand(symbols[low : high + 1], rules, base)
    skip = start - (int(ends[low - 1]) if low else 0)
    return ids[skip : skip + stop - start]


_ENCODERS: dict[str, WordEncoder] = {}


def _encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def write_shards(docs: DataFrame, path: str, tokenizer_path: str, text: str = "text", keep_order: bool = False) -> None:
    """Write docs as shards under path, by doc_id.

    keep_order: in the order in which docs stands in its files, if it is read from files.
    """
    place = None
    if keep_order:
        with contextlib.suppress(AnalysisException):  # no files, no such columns
            place = docs.select("doc_id", F.col(text).alias("text"), F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    if place is not None:
        # numbers of part files have five digits at least: a longer name is a later file
        key = [F.length("_file"), F.col("_file"), F.col("_row")]
        ordered = place.repartitionByRange(*key).sortWithinPartitions(*key).select("doc_id", "text")
    else:
        ordered = docs.select("doc_id", F.col(text).alias("text")).withColumn("_h", F.xxhash64("text"))
        ordered = ordered.repartitionByRange(F.col("doc_id").asc_nulls_first(), "_h").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "_h", "text").select("doc_id", "text")

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, n = _encoder(tokenizer_path), TaskContext.get().partitionId(), 0
        base = len(encoder.ends)
        kind, schema = _kind(base), arrow_schema(FORMAT)
        held: list[tuple[list, np.ndarray, np.ndarray]] = []

        def shard() -> pa.RecordBatch:
            ids = np.concatenate([h[1] for h in held])
            symbols, rules, size = compress(ids, base)
            row = {"part": part, "shard": n, "doc_ids": [d for h in held for d in h[0]], "doc_tokens": np.concatenate([h[2] for h in held]).tolist(), "n_tokens": len(ids), "base": base, "rules": rules.astype(kind).tobytes(), "expansions": size.astype("<i8").tobytes(), "symbols": symbols.astype(kind).tobytes()}
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for rows, data, offsets in doc_blocks(batches):
            ids, per_doc = encoder.encode(data, offsets)
            held.append((rows.column(0).to_pylist(), ids, per_doc))
            if sum(len(h[1]) for h in held) >= SHARD_TOKENS:
                yield shard()
                held, n = [], n + 1
        if held:
            yield shard()

    ordered.mapInArrow(shards, FORMAT).write.parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the shards under path."""
    files = spark.read.schema(FORMAT).parquet(path)
    out = "part int, shard int, doc_id bigint, at bigint, n_tokens bigint, ids_crc32 bigint"

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(out)
        for batch in batches:
            for row in batch.to_pylist():
                kind = _kind(row["base"])
                ids = expand(np.frombuffer(row["symbols"], kind), np.frombuffer(row["rules"], kind).reshape(-1, 2), row["base"]).astype("<u4")
                size = np.array(row["doc_tokens"], dtype=np.int64)
                at = np.cumsum(size) - size
                crc = [zlib.crc32(ids[a : a + n]) for a, n in zip(at, size, strict=True)]
                columns = [np.full(len(size), row["part"], np.int32), np.full(len(size), row["shard"], np.int32), row["doc_ids"], at, size, crc]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    shards = files.select("part", "shard", "n_tokens")
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("_all"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    parts = parts.select("part", F.coalesce(F.sum("_all").over(ahead), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = shards.withColumn("_ahead", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(parts, "part").select("part", "shard", (F.col("_base") + F.col("_ahead")).alias("_start"))
    rows = files.select("part", "shard", "doc_ids", "doc_tokens", "base", "rules", "symbols").mapInArrow(decode, out)
    return rows.join(starts, ["part", "shard"]).select("doc_id", (F.col("_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_documents(docs: DataFrame, path: str | None = None, tokenizer: str | None = None, keep_order: bool = False) -> DataFrame:
    """Write docs in the file format, in the order of write_shards, and read the files back."""
    spark = docs.sparkSession
    path = path or f"{scratch_dir(spark)}/touchline/tokens-{uuid.uuid4().hex}"
    write_shards(docs, path, tokenizer or tokenizer_path(), keep_order=keep_order)
    return read_shards(spark, path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: where every document's ids stand in the files."""
    return encode_documents(documents(spark, sf_dir).select("doc_id", "text"))
