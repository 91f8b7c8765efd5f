"""Source divergence audit: how far the term shares of sources lie apart, in exact whole numbers.

Terms are runs of letters and non-ASCII characters, A-Z lower-cased; a language keeps the terms
found in at least LEAST_DOCS of its documents. With N the kept tokens of a group (lang, source) and V
the language's kept terms, a term's share is p = 1 + floor(SCALE * (count + PRIOR) / (N + PRIOR * V)).
Two reports come out: for every pair of sources of a language the sum over all kept terms of the
differences of their shares, and for every group its TOP terms that lie above the language's share.

Kept terms are dealt by hash to blocks of about BLOCK terms a language. A block is a dense int64 tile, group by
term; all pairs of its groups are broadcast against each other in numpy, a bounded number of
cells at once. Partial pair matrices are summed by Spark, and every block hands on the TOP terms of
each group, which are merged by a ranked window whose first step is again bounded by TOP a task.

Nothing is broadcast: totals reach a block as rows beside its terms (a row for each group). A block
holds at most BLOCK terms of every source; the pairs of a language's sources are the result itself.

Defined results: NULL text, lang and source are ''; empty texts and texts without terms count as
documents, and their groups take part with all counts 0; a language without kept terms has value 0
for every pair; a language of one source has no pairs; ties are ranked by term or source in UTF-8
order; repeated rows are documents of their own; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from touchline.llm.common import documents, store
from touchline.llm.kernels import doc_blocks

LEAST_DOCS, PRIOR, SCALE_DIGITS, TOP = 30, 5, 9, 50
#: Terms of a block; cells that a step of the pair matrix makes at once; counted rows that a task merges before it hands them on.
BLOCK, CELLS, MERGE = 2048, 1 << 21, 1 << 20

COUNTED = "lang string, source string, term string, n bigint, df bigint"
TILE = "lang string, source string, part string, item string, value bigint"

_FOLD = np.full(256, 32, np.uint8)
_FOLD[128:] = np.arange(128, 256)
_FOLD[97:123] = _FOLD[65:91] = np.arange(97, 123)


def _block_counts(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> pa.Table:
    """lang, source, term, n, df over one block of texts; terms are compared as strings, not as hashes."""
    folded = pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(_FOLD[data])])
    split = pc.split_pattern(folded, " ")
    doc, words = pc.list_parent_indices(split).to_numpy(), pc.list_flatten(split).dictionary_encode()
    known, code = words.dictionary, words.indices.to_numpy()
    real = pc.not_equal(known, "").to_numpy(zero_copy_only=False)[code] if len(known) else np.zeros(0, bool)
    doc, code = doc[real], code[real]
    seen, n = np.unique(doc.astype(np.int64) * max(len(known), 1) + code, return_counts=True)
    doc, code = seen // max(len(known), 1), seen % max(len(known), 1)
    made = {name: rows.column(rows.schema.get_field_index(name)).take(pa.array(doc)) for name in ("lang", "source")}
    return _merged(pa.table({**made, "term": known.take(pa.array(code)).cast(pa.string()), "n": n.astype(np.int64), "df": np.ones(len(n), np.int64)}))


def _merged(counted: pa.Table) -> pa.Table:
    out = counted.group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("df", "sum")])
    return out.rename_columns(["lang", "source", "term", "n", "df"] if out.column_names[0] == "lang" else ["n", "df", "lang", "source", "term"]).select(["lang", "source", "term", "n", "df"])


def term_counts(docs: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """lang, source, term, n: occurrences in each group of the terms that at least so many documents of the language hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for rows, data, offsets in doc_blocks(batches):
            held.append(_block_counts(rows, data, offsets))
            if sum(len(t) for t in held) > MERGE:
                yield from _merged(pa.concat_tables(held)).combine_chunks().to_batches()
                held = []
        if held:
            yield from _merged(pa.concat_tables(held)).combine_chunks().to_batches()

    counted = docs.mapInArrow(run, COUNTED)
    # tasks have merged what they counted; one shuffle by term serves both the sums of a source and those of its language
    dealt = counted.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    everywhere = F.sum("df").over(Window.partitionBy("lang", "term"))
    return dealt.withColumn("_df", everywhere).filter(F.col("_df") >= least).select("lang", "source", "term", "n")


def scaled(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """floor(10 ** SCALE_DIGITS * part / whole) for int64 arrays, part of any size, whole under 2 ** 53: long division, three digits a step."""
    out, rest = np.divmod(part, whole)
    for _ in range(SCALE_DIGITS // 3):
        digits, rest = np.divmod(rest * 1000, whole)
        out = out * 1000 + digits
    return out


def _tile(terms: pa.Table, groups: pa.Table) -> pa.Table:
    """The partial pair matrix and the top terms of every group of one block."""
    groups = groups.sort_by("source")
    lang, names = groups["lang"][0].as_py(), groups["source"].to_pylist()
    size, prior = groups["tokens"].to_numpy(), PRIOR * groups["terms"][0].as_py()
    known = terms["term"].combine_chunks().dictionary_encode() if len(terms) else pa.array([], pa.string()).dictionary_encode()
    order = pc.sort_indices(known.dictionary).to_numpy()  # UTF-8 order
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    counts = np.zeros((len(names), len(order)), np.int64)
    if len(terms):
        counts[pc.index_in(terms["source"], value_set=groups["source"].combine_chunks()).to_numpy(), place[known.indices.to_numpy()]] = terms["n"].to_numpy()
    p = 1 + scaled(counts + PRIOR, np.maximum(size + prior, 1)[:, None])
    q = 1 + scaled(counts.sum(axis=0) + PRIOR, np.maximum(size.sum() + prior, 1))
    pairs = np.zeros((len(names), len(names)), np.int64)
    wide = max(1, min(len(order), CELLS // max(1, len(names))))
    high = max(1, CELLS // max(1, len(names) * wide))
    for a in range(0, len(names), high):
        for t in range(0, len(order), wide):
            pairs[a : a + high] += np.abs(p[a : a + high, None, t : t + wide] - p[None, :, t : t + wide]).sum(axis=2)
    one, two = np.nonzero(~np.eye(len(names), dtype=bool))
    columns = [[names[i] for i in one], ["pair"] * len(one), [names[i] for i in two], pairs[one, two]]
    gain = np.where((counts > 0) & (p > q), p - q, 0)
    for g, name in enumerate(names):
        best = np.argsort(-gain[g], kind="stable")[:TOP]
        best = best[gain[g, best] > 0]
        columns[0] += [name] * len(best)
        columns[1] += ["term"] * len(best)
        columns[2] += known.dictionary.take(pa.array(order[best])).to_pylist()
        columns[3] = np.concatenate([columns[3], gain[g, best]])
    texts = [pa.array(c, pa.string()) for c in ([lang] * len(columns[0]), *columns[:3])]
    return pa.Table.from_arrays([*texts, pa.array(columns[3], pa.int64())], names=["lang", "source", "part", "item", "value"])


def divergence(docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value, rank of the sources in docs (text, lang, source)."""
    docs = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    kept = store(term_counts(docs), "terms")
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("tokens"))
    sizes = kept.select("lang", "term").distinct().groupBy("lang").agg(F.count("*").alias("terms"))
    groups = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(sizes, "lang", "left").na.fill(0)
    blocks = lambda n: F.greatest(F.lit(1), F.ceil(n / F.lit(float(BLOCK)))).cast("int")
    header = groups.withColumn("block", F.explode(F.sequence(F.lit(0), blocks(F.col("terms")) - 1)))
    dealt = kept.join(sizes, "lang").withColumn("block", _block(F.col("term"), blocks(F.col("terms"))))
    tiles = dealt.select("lang", "block", "source", "term", "n").groupBy("lang", "block").cogroup(header.groupBy("lang", "block")).applyInArrow(_tile, TILE)
    tiles = store(tiles, "tiles")
    ranked = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    pairs = tiles.filter("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")).withColumn("rank", F.row_number().over(ranked))
    terms = tiles.filter("part = 'term'").withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= TOP)
    return pairs.unionByName(terms)


def _block(term: Column, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(term), blocks.cast("long")).cast("int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: distances between sources, and the terms that set each source apart."""
    return divergence(documents(spark, sf_dir))


ORACLE = f"""
WITH docs AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w
  FROM documents),
words AS (SELECT lang, source, id, unnest(w) AS term FROM docs),
kept AS (SELECT lang, term FROM words GROUP BY 1, 2 HAVING count(DISTINCT id) >= {LEAST_DOCS}),
sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY 1),
counts AS (SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
totals AS (SELECT lang, source, sum(n) AS t FROM counts GROUP BY 1, 2),
groups AS (
  SELECT lang, source, coalesce(t, 0)::HUGEINT AS t, coalesce(v, 0)::HUGEINT AS v
  FROM (SELECT DISTINCT lang, source FROM docs) LEFT JOIN totals USING (lang, source) LEFT JOIN sizes USING (lang)),
shares AS (
  SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n, 1 + ({10**SCALE_DIGITS}::HUGEINT * (coalesce(n, 0) + {PRIOR})) // (t + {PRIOR} * v) AS p
  FROM groups g JOIN kept k ON g.lang = k.lang LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
langs AS (SELECT lang, sum(t) AS t, any_value(v) AS v FROM groups GROUP BY 1),
whole AS (
  SELECT lang, term, 1 + ({10**SCALE_DIGITS}::HUGEINT * (sum(n)::HUGEINT + {PRIOR})) // (any_value(t) + {PRIOR} * any_value(v)) AS q
  FROM shares JOIN langs USING (lang) GROUP BY 1, 2),
apart AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q)::BIGINT FROM shares JOIN whole USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM found)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= {TOP}
"""
