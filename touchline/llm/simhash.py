"""SimHash near-duplicates, candidates by pigeonring filtering.

Fingerprints are cut into SEGMENTS parts on a ring. If two differ in at most MAX_BITS bits, the
pigeonring principle gives a start i from which every chain of l consecutive parts differs in at
most l * MAX_BITS / SEGMENTS bits. With 3 parts and 2 bits: part i is equal, and part i + 1 differs
in at most one bit, so one of its halves is equal too. Part i with a half of part i + 1 is the key
(about 32 bits) under which fingerprints meet; the chain's budgets prune what meets before the
full Hamming check. Distinct fingerprints only are searched, so copies cost nothing.

A key that more than DENSE fingerprints share (families of near copies) is not paired up: two of
its members differ in at most 2 bits outside the key, so they are equal to each other, or meet, at
a distance of one flipped bit. Members join the smallest member at each such meeting point,
which makes the same components with rows in proportion to the members.

Components are found by rounds of minimum labels over the links, with every round's table written
to the shared folder. A component's id is its smallest doc_id.

Defined results: NULL, empty and blank texts have fingerprint 0; a NULL doc_id counts as the
largest and is an id only where a component has no other; repeated rows are one group; an empty
table gives an empty result; extra columns are ignored, and one_of_each carries them along.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm.common import documents, fresh, row_hash, store
from touchline.llm.kernels import arrow_rows, arrow_schema, doc_blocks

SHINGLE, SEED, MAX_BITS = 3, 42, 2
#: (lowest bit, bits) of the ring's parts, and of the two halves of each.
PARTS = [(0, 21), (21, 21), (42, 22)]
HALVES = [[(0, 10), (10, 11)], [(21, 10), (31, 11)], [(42, 11), (53, 11)]]
DENSE = 64


def fingerprint(text: bytes) -> int:
    """A bit is set if it is set in over half of the shingles' hashes."""
    words = text.lower().split()  # bytes: A-Z alone, and ASCII white space
    if not words:
        return 0
    shingles = [b" ".join(words)] if len(words) < SHINGLE else map(b" ".join, zip(*(words[k:] for k in range(SHINGLE)), strict=False))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, SEED) for s in shingles), np.uint64)
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        some = hashes[k : k + (1 << 16)].astype("<u8")
        ones += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def row_key(key: str | None) -> Column:
    """The column by which a caller knows its rows again; NULL if it needs none."""
    return (F.col(key) if key else F.lit(None)).cast("long").alias("key")


def fingerprints(docs: DataFrame, text: str = "text", key: str | None = None) -> DataFrame:
    """doc_id, key, fp (the 64 bits as a bigint) of every row."""
    out = "doc_id bigint, key bigint, fp bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(out)
        for rows, data, offsets in doc_blocks(batches):
            raw = data.tobytes()
            yield arrow_rows(schema, rows.column(0), rows.column(1), [fingerprint(raw[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key(key), F.col(text).alias("text")).mapInArrow(run, out)


def _bits(fp: Column, low: int, size: int) -> Column:
    return F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << size) - 1).cast("long"))


def _key(fp: Column, i: int, half: int) -> Column:
    """The key of start i: which one it is, part i, and that half of the next part."""
    low, size = HALVES[(i + 1) % 3][half]
    return F.shiftleft(F.lit(2 * i + half).cast("long"), 40).bitwiseOR(F.shiftleft(_bits(fp, *PARTS[i]), 16)).bitwiseOR(_bits(fp, low, size))


def _mask(i: int, half: int) -> int:
    (a, n), (b, m) = PARTS[i], HALVES[(i + 1) % 3][half]
    return ((1 << n) - 1) << a | ((1 << m) - 1) << b


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def links(prints: DataFrame) -> DataFrame:
    """a, b (a < b): fingerprints at up to MAX_BITS bits, so many that their components are those of all such pairs.

    prints: fp, distinct.
    """
    keys = F.array(*(_key(F.col("fp"), i, half) for i in range(3) for half in range(2)))
    keyed = store(prints.select("fp", F.explode(keys).alias("key")), "keys")
    counts = keyed.groupBy("key").count().filter("count > 1")
    shared = keyed.join(counts, "key")
    few = shared.filter(F.col("count") <= DENSE).select("key", "fp")
    pairs = few.select("key", F.col("fp").alias("a")).join(few.select("key", F.col("fp").alias("b")), "key").filter("a < b")
    x = F.col("a").bitwiseXOR(F.col("b"))
    part = F.shiftright(F.col("key"), 40)
    apart = [F.bit_count(_bits(x, *p)) for p in PARTS]
    start = F.floor(part / 2)
    # chains of 1, 2 and 3 parts within budgets of 2/3, 4/3 and 2 bits
    chain = F.lit(False)
    for i in range(3):
        one, two = apart[i], apart[i] + apart[(i + 1) % 3]
        chain = chain | ((start == i) & (one * 3 <= MAX_BITS) & (two * 3 <= 2 * MAX_BITS))
    near = pairs.filter(chain).filter(F.bit_count(x) <= MAX_BITS).select("a", "b")
    # dense keys: meeting points at one flipped bit outside the key
    flips = F.lit(None)
    for i in range(3):
        for half in range(2):
            free = [_signed(1 << k) for k in range(64) if not _mask(i, half) >> k & 1]
            flips = F.when(part == 2 * i + half, F.array(F.lit(0).cast("long"), *(F.lit(v).cast("long") for v in free))).otherwise(flips)
    dense = shared.filter(F.col("count") > DENSE).select("key", "fp", F.explode(flips).alias("flip"))
    dense = dense.select("key", "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("at"))
    least = dense.groupBy("key", "at").agg(F.min("fp").alias("a"), F.max("fp").alias("_most")).filter(F.col("a") < F.col("_most")).drop("_most")
    met = dense.join(least, ["key", "at"]).filter(F.col("a") < F.col("fp")).select("a", F.col("fp").alias("b"))
    return near.unionByName(met).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, label (the least node reachable) of every node of edges a, b.

    Alternating rounds: every node's larger neighbours, then its smaller ones, are linked to the
    least node it knows, until every link leads to a least node. Rounds grow with the
    logarithm of the longest chain.
    """
    edges = store(edges, "links")
    seen = None
    while True:
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b"))
        large = store(large.filter("a < b").distinct(), "large")
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b").select("m", "a", "b")
        step = small.select(F.col("m").alias("a"), "b").union(small.select("m", F.col("a").alias("b"))).filter("a < b").distinct()
        edges = store(step, "links")
        n, total, stars = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.count_distinct("b")).first()
        if n == stars and seen == (n, total):
            return edges.select(F.col("b").alias("node"), F.col("a").alias("label")).union(edges.select("a", "a").distinct())
        seen = (n, total)


def near_duplicates(docs: DataFrame, text: str = "text", key: str | None = None) -> DataFrame:
    """doc_id, key, fp, group (the component, named by its least fingerprint), component_id of every row of docs."""
    marked = store(fingerprints(docs, text, key), "fingerprints")
    prints = store(marked.groupBy("fp").agg(F.min("doc_id").alias("id")), "prints")
    linked = components(links(prints.select("fp")))
    named = linked.join(prints, linked["node"] == prints["fp"]).select("node", "label", "id")
    least = named.groupBy("label").agg(F.min("id").alias("component_id"))
    ids = prints.join(named.join(least, "label").select(F.col("node").alias("fp"), "label", "component_id"), "fp", "left")
    # written, so that the last join deals both sides anew and a fingerprint of many rows can be split
    ids = store(ids.select("fp", F.coalesce("label", "fp").alias("group"), F.when(F.col("label").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id")), "components")
    return marked.join(ids, "fp", "left").select("doc_id", "key", "fp", "group", "component_id")


def one_of_each(docs: DataFrame, text: str = "text", find: Callable[[DataFrame, str, str], DataFrame] = near_duplicates) -> DataFrame:
    """One row of docs for each group that find gives: that of the smallest doc_id, NULL last; of equal ids that of the least hash.

    Rows are known by their id and the hash of all their columns, so rows that share an id, or
    have none, are told apart; only rows equal in every column are one and the same.
    """
    names = docs.columns
    mark, first_id, first_key, n = fresh(docs, "_row_key", "_first_id", "_first_key", "_n")
    keyed = docs.withColumn(mark, row_hash(docs))
    found = find(keyed, text, mark).groupBy("group", "doc_id", "key").agg(F.count("*").alias("n"))
    first = found.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "n")).alias("f"))
    first = store(first.select(F.col("f.doc_id").alias(first_id), F.col("f.key").alias(first_key), F.col("f.n").alias(n)), "kept")
    kept = keyed.join(first, (keyed[mark] == first[first_key]) & keyed["doc_id"].cast("long").eqNullSafe(first[first_id]))
    if first.filter(F.col(n) > 1).limit(1).count():
        kept = kept.filter(F.col(n) == 1).unionByName(kept.filter(F.col(n) > 1).dropDuplicates([first_id, first_key]))
    return kept.select(*(F.col(f"`{c}`") for c in names))


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: every document's fingerprint and component."""
    found = near_duplicates(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", hex_digits(F.col("fp")).alias("fingerprint"), "component_id")
