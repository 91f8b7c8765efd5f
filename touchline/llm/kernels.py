"""Array helpers for the Arrow stages: blocks of documents, words by byte tables, hashes, a hash table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes that a stage works on at once; a longer document is a block of its own.
BLOCK_BYTES = 1 << 20

_U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on uint64."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
_STEP = 0x5851F42D4C957F2D


def table(keep: str, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(byte -> lower-cased byte, byte -> whether words are made of it) for "blank" words [^\\x20\\x09-\\x0D]+ or "alnum" ones."""
    low = np.arange(256, dtype=np.uint8)
    if lower:
        low[65:91] += 32
    word = np.ones(256, dtype=bool)
    if keep == "blank":
        word[[32, *range(9, 14)]] = False
    else:
        word[0:0x30] = word[0x3A:0x61] = word[0x7B:0x80] = False
    return low, word


def doc_blocks(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, their texts' UTF-8 bytes, offsets of the texts) in blocks of bounded size; NULL is empty."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + most, side="right")))
            part = batch.slice(at, to - at)
            texts = part.column(batch.schema.get_field_index(text)).to_pylist() if column.null_count else None
            if texts is None:
                cells = part.column(batch.schema.get_field_index(text))
                wide = pa.types.is_large_string(cells.type)
                offsets = np.frombuffer(cells.buffers()[1], dtype=np.int64 if wide else np.int32)[cells.offset : cells.offset + len(cells) + 1].astype(np.int64)
                data = np.frombuffer(cells.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]] if cells.buffers()[2] is not None else np.zeros(0, np.uint8)
                offsets = offsets - offsets[0]
            else:
                raw = [(t or "").encode() for t in texts]
                data = np.frombuffer(b"".join(raw), dtype=np.uint8)
                offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
            yield part, data, offsets
            at = to
        del batch, column
        pa.default_memory_pool().release_unused()


class Words:
    """The words of a block: hashes (uint64), start and end bytes, and first[i]..first[i + 1] of text i."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, low: np.ndarray, word: np.ndarray, cut: np.ndarray | None = None):
        self.data = data = low[data]
        inside = word[data]
        before = np.empty_like(inside)
        before[:1] = False
        before[1:] = inside[:-1]
        before[offsets[:-1][offsets[:-1] < len(data)]] = False
        if cut is not None:
            before &= ~cut
        begins = inside & ~before
        self.starts = starts = np.flatnonzero(begins)
        self.first = np.searchsorted(starts, offsets)
        n = len(starts)
        if not n:
            self.ends, self.hashes = starts, np.zeros(0, np.uint64)
            return
        stops = np.flatnonzero(~inside)
        bound = np.append(starts[1:], len(data))
        where = np.searchsorted(stops, starts)
        stop = np.append(stops, len(data))[where]
        self.ends = np.minimum(stop, bound)
        lens = self.ends - starts
        longest = int(lens.max())
        powers = np.empty(longest + 1, np.uint64)
        powers[0] = 1
        powers[1:] = _STEP
        np.multiply.accumulate(powers, out=powers)
        at = np.arange(starts[0], len(data), dtype=np.int64)
        at -= np.repeat(starts, np.diff(np.append(starts, len(data))))
        np.minimum(at, longest, out=at)
        values = _BYTE[data[starts[0] :]]
        values *= powers[at]
        values *= inside[starts[0] :]
        self.hashes = mix64(np.add.reduceat(values, starts - starts[0]) + lens.astype(np.uint64))

    def text(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def word_hash(word: bytes) -> int:
    """The hash that Words gives a word that stands alone."""
    data = np.frombuffer(word, dtype=np.uint8)
    powers = [1]
    for _ in word:
        powers.append(powers[-1] * _STEP % 2**64)
    total = sum(int(_BYTE[b]) * p for b, p in zip(data, powers, strict=False)) + len(word)
    return int(mix64(np.array([total % 2**64], dtype=np.uint64))[0])


class HashIndex:
    """uint64 keys -> the order they came in (0, 1, ...), by open addressing; lookups and inserts take arrays."""

    def __init__(self, keys: np.ndarray | None = None, slots: int = 1 << 12):
        self.keys = np.zeros(0, np.uint64)
        self._make(slots)
        if keys is not None:
            self.add(keys)

    def _make(self, slots: int) -> None:
        self.mask = _U(slots - 1)
        self.slots = np.full(slots, -1, np.int32)
        self._place(np.arange(len(self.keys), dtype=np.int32))

    def _place(self, ids: np.ndarray) -> None:
        at = (self.keys[ids] & self.mask).astype(np.int64)
        while len(ids):
            free = self.slots[at] < 0
            self.slots[at[free]] = ids[free]  # the last of those that want a slot gets it
            lost = self.slots[at] != ids
            ids, at = ids[lost], (at[lost] + 1) & int(self.mask)

    def add(self, keys: np.ndarray) -> None:
        """Adds distinct keys that are not there yet."""
        n = len(self.keys)
        self.keys = np.concatenate([self.keys, keys.astype(np.uint64)])
        if 2 * len(self.keys) > len(self.slots):
            slots = len(self.slots)
            while 2 * len(self.keys) > slots:
                slots *= 2
            self._make(slots * 2)
        else:
            self._place(np.arange(n, len(self.keys), dtype=np.int32))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 where it is unknown."""
        out = np.full(len(keys), -1, np.int32)
        if not len(self.keys):
            return out
        at = (keys & self.mask).astype(np.int64)
        got = self.slots[at]
        hit = (got >= 0) & (self.keys[got] == keys)
        out[hit] = got[hit]
        open_ = np.flatnonzero((got >= 0) & ~hit)
        at = at[open_]
        while len(open_):
            at = (at + 1) & int(self.mask)
            got = self.slots[at]
            hit = (got >= 0) & (self.keys[got] == keys[open_])
            out[open_[hit]] = got[hit]
            more = (got >= 0) & ~hit
            open_, at = open_[more], at[more]
        return out


def sums_by_doc(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of values[first[i]:first[i + 1]] for every i."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[first[1:]] - total[first[:-1]]


_TYPES = {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow schema of "name type, ..." for the plain types and arrays of them."""
    fields = (part.split() for part in ddl.split(","))
    return pa.schema([(name, pa.list_(_TYPES[kind[6:-1]]) if kind.startswith("array<") else _TYPES[kind]) for name, kind in fields])


def arrow_rows(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
