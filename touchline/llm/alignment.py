"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes of a text.

Tokenizing gives every text its ids and the byte offsets where tokens end, for both tokenizers. From
there on Spark's higher-order functions do all: array_intersect of the end arrays are the offsets where
both end, which cut a text into groups; both ends, each with its token's place in it, are sorted into one array,
and since the k-th mark that is the i-th of its own side has k - i of the other side before it, one
transform finds the token of the other side that covers it. Every offset where either side ends closes exactly one
pair of overlapping tokens, so links are as many as distinct ends, and no pair is searched for.
Counts of id pairs are an aggregate over all links; sums by text read them back.

The pairs' counts come to the links in two ways: the most frequent pairs, at most HOT of them (under 5 MB), are
broadcast; links of all other pairs are shuffled to their counts. No pair is left out.

Tokenizers give a segment (a space and what follows up to the next single space) the same ids wherever it stands, and
both end there. So tokenizing gives blocks of about BLOCK bytes of texts (a longer text is a block of its own): the tokens of each
distinct segment, and every text as a list of segments. Groups and links are built once a segment and block and put together
by text. That segments may be taken apart is checked on the tokenizers' files; texts with a segment that either side does not give
back byte for byte are one segment. Segments are told apart by a 64-bit hash and their length. A task holds one block.

Defined results: NULL, empty and unfaithful texts (joined bytes of either side differ from space + text) have
no tokens: zeros, and '' for the digest; repeated rows are texts of their own, in the counts too; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm.common import documents, store
from touchline.llm.kernels import HashIndex, Words, doc_blocks

BYTE_LEVEL, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Pairs whose counts are broadcast; segments that a task remembers; segments tokenized in one call.
HOT, MEMO, BATCH = 1 << 18, 300_000, 1000
#: Bytes of text that are tokenized at once, and that share one table of segments.
STEP, BLOCK = 1 << 18, 5 << 20

_MARK, _SIDE, _PLACE = 32, 1 << 31, (1 << 31) - 1
_PLAIN = np.ones(256, dtype=bool)
_ANY = np.arange(256, dtype=np.uint8)
#: First bytes of characters that white space may start with: no segment is cut before them.
_BLANK_LEAD = np.zeros(256, dtype=bool)
_BLANK_LEAD[[*range(9, 14), *range(28, 33), 0xC2, 0xE1, 0xE2, 0xE3]] = True


class _Side:
    """Ids of strings and bytes of ids."""

    encode: Callable[[list[str]], list[list[int]]]
    token: list[bytes]

    def faithful(self, ids: list[int], text: bytes) -> bool:
        return b"".join(map(self.token.__getitem__, ids)) == text


class ByteLevel(_Side):
    """A byte-level tokenizer on space + text; special tokens in texts are plain text.

    The file's vocabulary and merges are run by tiktoken, a few times faster on rare words. That asks for merges in the
    order of the ids they make, which is checked; tests hold the ids against the tokenizers library.
    """

    #: The pieces that byte-level tokenizers of this kind cut a text into.
    PIECE = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            made = json.load(file)
        split, model = made["pre_tokenizer"] or {}, made["model"]
        if made["normalizer"] or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex"):
            raise ValueError(f"{path} is no byte-level tokenizer whose pieces begin at single spaces")
        merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if merged != list(range(256, 256 + len(merged))) or model.get("ignore_merges"):
            raise ValueError(f"{path} has merges in another order than their ids")
        # the usual byte alphabet: printable Latin-1 signs stand for themselves, the others for the code points from 256 on
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in own)}
        ranks = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if i < 256 + len(merged)}
        self.token = [b""] * len(ranks)
        for token, i in ranks.items():
            self.token[i] = token
        encoding = tiktoken.Encoding("byte_level", pat_str=self.PIECE, mergeable_ranks=ranks, special_tokens={})
        self.encode = lambda texts: [encoding.encode_ordinary(f" {t}") for t in texts]

    def faithful(self, ids: list[int], text: bytes) -> bool:
        """Always: the pieces leave out no character and every byte has a token."""
        return True


class Pieces(_Side):
    """A piece tokenizer, which puts a space before the text itself."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        if any("▁" in name.lstrip("▁") for name in names):
            raise ValueError(f"{path} has pieces that hold a space within")
        self.token = [bytes([int(n[3:5], 16)]) if model.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]
        self.encode = lambda texts: model.encode(texts, num_threads=1)


class Aligner:
    """Both sides' tokens of blocks of texts, each distinct segment tokenized once."""

    def __init__(self, byte_path: str, piece_path: str):
        self.sides = (ByteLevel(byte_path), Pieces(piece_path))
        self.length = [np.array([len(t) for t in side.token], np.int32) for side in self.sides]
        self.clear()

    def clear(self) -> None:
        self.index, self.bytes, self.good = HashIndex(), np.zeros(0, np.int64), np.zeros(0, bool)
        self.ids, self.start, self.size = ([np.zeros(0, np.int32)] * 2, [np.zeros(0, np.int64)] * 2, [np.zeros(0, np.int64)] * 2)

    def _encoded(self, k: int, segments: list[bytes], joined: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all segments, ids of each, whether each is faithful) for one side.

        joined: the segments are tokenized as one text. They are taken apart where tokens end with them; if some token
        doesn't, or the text does not come back, each is tokenized alone.
        """
        side = self.sides[k]
        if joined:
            text = b"".join(segments)
            ids = np.array(side.encode([text[1:].decode()])[0], np.int32)
            ends, want = np.cumsum(self.length[k][ids], dtype=np.int64), np.cumsum([len(s) for s in segments])
            at = np.minimum(np.searchsorted(ends, want), len(ends) - 1)
            if (ends[at] == want).all() and side.faithful(ids.tolist(), text):
                return ids, np.diff(at, prepend=-1), np.ones(len(segments), dtype=bool)
        made = side.encode([s[1:].decode() for s in segments])
        sizes = np.fromiter(map(len, made), np.int64, len(made))
        return np.fromiter((i for ids in made for i in ids), np.int32, int(sizes.sum())), sizes, np.fromiter(map(side.faithful, made, segments), bool, len(made))

    def _learn(self, hashes: np.ndarray, segments: list[bytes]) -> None:
        spaced = np.fromiter((s.endswith(b" ") for s in segments), bool, len(segments))  # a space would join the next one's
        order = np.concatenate([np.flatnonzero(~spaced), np.flatnonzero(spaced)])
        plain, good, made = int((~spaced).sum()), [], ([], [])
        steps = [(a, min(a + BATCH, plain)) for a in range(0, plain, BATCH)] + [(a, a + BATCH) for a in range(plain, len(segments), BATCH)]
        for a, b in steps:
            some = [segments[i] for i in order[a:b].tolist()]
            parts = [self._encoded(k, some, a < plain) for k in (0, 1)]
            good.append(parts[0][2] & parts[1][2])
            for k in (0, 1):
                made[k].append(parts[k][:2])
        for k in (0, 1):
            size, used = np.concatenate([p[1] for p in made[k]]), len(self.ids[k])
            self.ids[k] = np.concatenate([self.ids[k], *(p[0] for p in made[k])])
            self.start[k] = np.concatenate([self.start[k], used + np.cumsum(size) - size])
            self.size[k] = np.concatenate([self.size[k], size])
        self.bytes = np.concatenate([self.bytes, np.fromiter(map(len, segments), np.int64, len(segments))[order]])
        self.good = np.concatenate([self.good, *good])
        self.index.add(hashes[order])

    def _whole(self, text: bytes) -> int:
        """The number of a text that is one segment, -1 if it is unfaithful."""
        key = np.array([xxhash.xxh64_intdigest(text, 17)], np.uint64)
        found = int(self.index.find(key)[0])
        if found < 0:
            self._learn(key, [text])
            found = len(self.index.keys) - 1
        return found if self.good[found] else -1

    def full(self) -> bool:
        return len(self.index.keys) > MEMO

    def segments(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of all texts' segments in turn, segments of each text); a text without tokens has none."""
        n, size = len(offsets) - 1, np.diff(offsets)
        # a space before every text that is not empty
        shift = np.cumsum(size > 0)
        spaced = np.full(len(data) + int(shift[-1]), 32, np.uint8)
        spaced[np.arange(len(data)) + np.repeat(shift, size)] = data
        bounds = np.concatenate([[0], np.cumsum(size + (size > 0))])
        cut = np.zeros(len(spaced), dtype=bool)
        cut[1:-1] = (spaced[1:-1] == 32) & (spaced[:-2] != 32) & ~_BLANK_LEAD[spaced[2:]]
        words = Words(spaced, bounds, _ANY, _PLAIN, cut)
        known = self.index.find(words.hashes)
        lacking = np.flatnonzero(known < 0)
        raw = spaced.tobytes()
        if len(lacking):
            hashes, where = np.unique(words.hashes[lacking], return_index=True)
            self._learn(hashes, [raw[words.starts[i] : words.ends[i]] for i in lacking[where].tolist()])
            known[lacking] = self.index.find(words.hashes[lacking])
        known = known.astype(np.int64)
        bad = ~self.good[known] | (self.bytes[known] != words.ends - words.starts)
        each = np.diff(words.first)
        if bad.any():  # texts that are one segment
            doc = np.repeat(np.arange(n), each)
            odd = np.unique(doc[bad])
            keep = ~np.isin(doc, odd)
            keep[words.first[odd]] = True
            known[words.first[odd]] = [self._whole(raw[bounds[i] : bounds[i + 1]]) for i in odd.tolist()]
            keep &= known >= 0
            each, known = np.bincount(doc[keep], minlength=n), known[keep]
        return known, each

    def table(self, held: list[tuple[list, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        """One row: the tokens of the distinct segments, and the texts as lists of their places."""
        known, each = np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
        once, place = np.unique(known, return_inverse=True)
        lists, totals = [], []
        doc = np.repeat(np.arange(len(each)), each)
        for k in (0, 1):
            size = self.size[k][once]
            first = np.concatenate([[0], np.cumsum(size)])
            ids = self.ids[k][np.repeat(self.start[k][once] - first[:-1], size) + np.arange(int(first[-1]))]
            ends = np.cumsum(self.length[k][ids], dtype=np.int64)
            ends -= np.repeat(np.concatenate([[0], ends])[first[:-1]], size)
            at = pa.array(first, pa.int32())
            lists += [pa.ListArray.from_arrays(at, pa.array(ids, pa.int32())), pa.ListArray.from_arrays(at, pa.array(ends, pa.int32()))]
            totals.append(np.bincount(doc, weights=self.size[k][known], minlength=len(each)).astype(np.int64))
        segments = pa.StructArray.from_arrays(lists, names=["a_ids", "a_ends", "b_ids", "b_ends"])
        places = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(each)]), pa.int32()), pa.array(place, pa.int32()))
        texts = pa.StructArray.from_arrays([pa.array([i for h in held for i in h[0]], pa.int64()), *(pa.array(t) for t in totals), places], names=["doc_id", "n_a", "n_b", "places"])
        row = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
        return pa.RecordBatch.from_arrays([row(segments), row(texts)], names=["segments", "texts"])


_ALIGNERS: dict[tuple[str, str], Aligner] = {}
TOKENS = "segments array<struct<a_ids:array<int>,a_ends:array<int>,b_ids:array<int>,b_ends:array<int>>>, texts array<struct<doc_id:bigint,n_a:bigint,n_b:bigint,places:array<int>>>"


def tokenized(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """Blocks of docs (doc_id, text): the tokens of their segments, and the texts (no segments where a text has no tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths = (byte_path, piece_path)
        if paths not in _ALIGNERS:
            _ALIGNERS[paths] = Aligner(*paths)
        aligner, held, size = _ALIGNERS[paths], [], 0
        for rows, data, offsets in doc_blocks(batches, most=STEP):
            if held and (size + len(data) > BLOCK or aligner.full()):
                yield aligner.table(held)
                held, size = [], 0
            if aligner.full():
                aligner.clear()
            held.append((rows.column(0).to_pylist(), *aligner.segments(data, offsets)))
            size += len(data)
        if held:
            yield aligner.table(held)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, TOKENS)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, whatever number of times the body's lambdas read it."""
    return F.transform(F.array(value), body)[0]


def _marks(a_ends: Column, b_ends: Column) -> Column:
    """The ends of both sides in order; each holds its offset, its side and its place there."""
    one = F.transform(a_ends, lambda e, i: F.shiftleft(e.cast("long"), _MARK) + i)
    two = F.transform(b_ends, lambda e, j: F.shiftleft(e.cast("long"), _MARK) + F.lit(_SIDE) + j)
    return F.sort_array(F.concat(one, two))


def _steps(marks: Column) -> Column:
    """For each mark the places of the tokens that overlap up to it, as a << 32 | b; -1 for the second mark at one offset."""

    def step(v: Column, k: Column) -> Column:
        place = v.bitwiseAND(F.lit(_PLACE)).cast("int")
        first = v.bitwiseAND(F.lit(_SIDE)) == 0
        twice = (k > 0) & (F.shiftright(marks[k - 1], _MARK) == F.shiftright(v, _MARK))
        pair = lambda a, b: F.shiftleft(a.cast("long"), _MARK) + b
        return F.when(first, pair(place, k - place)).when(twice, F.lit(-1).cast("long")).otherwise(pair(k - place, place))

    return F.array_remove(F.transform(marks, step), -1)


def _aligned_segment(s: Column, b_size: int) -> Column:
    """links (a_id * b_size + b_id of every overlapping pair) and groups (their text form) of one segment.

    Sides that end at the same offsets throughout pair up token by token, and one token overlaps all of the other
    side's; these two cases need no marks.
    """
    high, low = lambda x: F.shiftright(x, _MARK).cast("int"), lambda x: x.bitwiseAND(F.lit(_PLACE)).cast("int")
    a_ids, b_ids, a_ends, b_ends = (s[name] for name in ("a_ids", "b_ids", "a_ends", "b_ends"))
    made = lambda links, groups: F.struct(links.alias("links"), groups.alias("groups"))
    link = lambda a, b: a.cast("long") * b_size + b

    def listed(ids: Column, place: Callable[[Column], Column], ends: Column, g: Column) -> Column:
        before = F.when(g > 0, place(ends[g - 1]) + 1).otherwise(F.lit(0))
        return F.array_join(F.slice(ids, before + 1, place(ends[g]) + 1 - before), ",")

    def built(steps: Column) -> Column:
        links = F.transform(steps, lambda x: link(a_ids[high(x)], b_ids[low(x)]))
        # the steps that end where both sides end close the groups: as many as shared offsets, in the same order
        closing = F.filter(steps, lambda x: a_ends[high(x)] == b_ends[low(x)])
        shared = F.array_intersect(a_ends, b_ends)
        groups = lambda ends: F.transform(F.sequence(F.lit(0), F.size(shared) - 1), lambda g: F.concat_ws("|", listed(a_ids, high, ends, g), listed(b_ids, low, ends, g)))
        return made(links, F.array_join(_let(closing, groups), ";"))

    pairs = made(F.transform(a_ids, lambda a, i: link(a, b_ids[i])), F.array_join(F.transform(a_ids, lambda a, i: F.concat(a.cast("string"), F.lit("|"), b_ids[i].cast("string"))), ";"))
    whole = F.concat_ws("|", F.array_join(a_ids, ","), F.array_join(b_ids, ","))
    fan = F.when(F.size(a_ids) == 1, F.transform(b_ids, lambda b: link(a_ids[0], b))).otherwise(F.transform(a_ids, lambda a: link(a, b_ids[0])))
    return F.when(a_ends == b_ends, pairs).when((F.size(a_ids) == 1) | (F.size(b_ids) == 1), made(fan, whole)).otherwise(_let(_let(_marks(a_ends, b_ends), _steps), built))


def aligned(tokens: DataFrame, b_size: int) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, links, groups (text form, in order) of every text.

    tokens: as tokenized gives them; b_size: above all ids of the second side.
    """

    def text(segments: Column, t: Column) -> Column:
        links = F.flatten(F.transform(t["places"], lambda i: segments[i]["links"]))
        groups = F.array_join(F.transform(t["places"], lambda i: segments[i]["groups"]), ";")
        return F.struct(t["doc_id"].alias("doc_id"), t["n_a"].alias("n_a"), t["n_b"].alias("n_b"), links.alias("links"), groups.alias("groups"))

    segments = F.transform("segments", lambda s: _aligned_segment(s, b_size))
    texts = tokens.select(F.inline(_let(segments, lambda known: F.transform("texts", lambda t: text(known, t)))))
    # each offset where either side ends closes one link, those where both end close a group
    return texts.select("doc_id", "n_a", "n_b", (F.col("n_a") + F.col("n_b") - F.size("links")).alias("n_groups"), "links", "groups")


def pair_counts(linked: DataFrame, b_size: int) -> DataFrame:
    """pair, n (links in all texts), best (whether no pair of its second id has more)."""
    counted = store(linked.select(F.explode("links").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")), "pairs")
    top = counted.groupBy((F.col("pair") % b_size).alias("b")).agg(F.max("n").alias("top"))
    return store(counted.withColumn("b", F.col("pair") % b_size).join(top, "b").select("pair", "n", (F.col("n") == F.col("top")).cast("long").alias("best")), "pair-counts")


def _threshold(counts: DataFrame, most: int) -> int:
    """The least count such that at most so many pairs reach it."""
    rank = F.when(F.col("n") < 1024, F.col("n")).otherwise(1024 + F.floor((F.log2("n") - 10) * 64)).cast("int")
    steps = counts.groupBy(rank.alias("rank")).agg(F.count("*").alias("pairs"), F.min("n").alias("least")).collect()  # under 5,000 rows
    least = 1 << 62
    for row in sorted(steps, key=lambda r: -r["rank"]):
        most -= row["pairs"]
        if most < 0:
            break
        least = row["least"]
    return least


def align(docs: DataFrame, byte_path: str | None = None, piece_path: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row of docs (doc_id, text)."""
    import public_tokenizers
    from sentencepiece import SentencePieceProcessor

    byte_path, piece_path = byte_path or public_tokenizers.path(BYTE_LEVEL), piece_path or public_tokenizers.path(PIECES)
    b_size = SentencePieceProcessor(model_file=piece_path).get_piece_size()
    made = aligned(tokenized(docs, byte_path, piece_path), b_size)
    digest = F.when(F.col("n_groups") > 0, F.sha2("groups", 256)).otherwise(F.lit(""))
    rows = store(made.select("doc_id", F.monotonically_increasing_id().alias("_row"), "n_a", "n_b", "n_groups", digest.alias("groups_sha256"), "links"), "links")
    counts = pair_counts(rows, b_size)
    least = _threshold(counts, HOT)
    hot, cold = F.broadcast(counts.filter(F.col("n") >= least)), counts.filter(F.col("n") < least)  # at most HOT rows
    each = rows.select("_row", F.explode("links").alias("pair"))
    near = each.join(hot, "pair").select("_row", "n", "best")
    far = each.join(hot.select("pair"), "pair", "left_anti").join(cold, "pair").select("_row", "n", "best")
    sums = near.unionByName(far).groupBy("_row").agg(F.sum("best").alias("n_best"), F.sum("n").alias("count_sum"))
    out = rows.withColumn("n_links", F.size("links").cast("long")).drop("links").join(sums, "_row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: how the tokens of two tokenizers meet in every document."""
    return align(documents(spark, sf_dir).select("doc_id", "text"))
