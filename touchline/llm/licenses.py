"""License scans: MinHash bands over text windows retrieve templates, exact containment verifies.

Texts and templates are words of [a-z0-9] and non-ASCII characters. A template's shingles are of five
words, or of all its words where it has fewer, and a text is cut into shingles of every size its possible templates
have. A window of PER shingles starts at every STEP-th word of a text and at every word of a template, so a copied
stretch of WINDOW + STEP words holds a window of both. Every window has BANDS min-hashes, one to a
band; a window holding the whole of a one-shingle template agrees with it in a band with chance
1 / 8, so in one of 64 with chance 1 - (7 / 8) ** 64 > 0.9998, and longer templates do better. The
share of the template's shingles that the whole text holds then decides: CONTAINMENT or more is a match.

Only texts with an anchor are cut into windows, and only in the sizes of which they have one. A template's anchors are
words that more than a fifth of its distinct shingles hold, so a text without any cannot hold four fifths of the shingles.

Only DataFrame expressions touch the documents and templates. A band's key leads to a template's
number; its shingles are joined once text and template are known to meet.

Defined results: NULL, empty and blank texts have no license; a template under five words is found
wherever its words stand together, one without words is none; repeated rows are judged one by one; repeated templates count once; an empty table gives an
empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm.common import documents, lower_ascii, store
from touchline.llm.license_texts import TEMPLATES

SHINGLE, WINDOW, STEP, BANDS, CONTAINMENT = 5, 12, 4, 64, 0.8
#: Shingles of a window.
PER = WINDOW - SHINGLE + 1


def plain_words(text: Column) -> Column:
    flat = F.trim(F.regexp_replace(lower_ascii(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))
    return F.when(flat == "", F.array().cast("array<string>")).otherwise(F.split(flat, " "))


def _shingles(words: Column, size: int | Column = SHINGLE) -> Column:
    n, size = F.size(words), F.lit(size) if isinstance(size, int) else size
    runs = F.transform(F.sequence(F.lit(0), F.greatest(n - size, F.lit(0))), lambda i: F.xxhash64(F.array_join(F.slice(words, i + 1, size), " ")))
    return F.when(n > 0, runs).otherwise(F.array().cast("array<bigint>"))


def _bands(hashes: Column) -> Column:
    """The min-hash of each band, with the band in it."""
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda j: F.xxhash64(j, F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, j)))))


def _windows(hashes: Column, step: int) -> Column:
    """(at, hashes) of the windows, the last one at the end of the text."""
    last = F.greatest(F.size(hashes) - PER, F.lit(0))
    starts = F.array_distinct(F.concat(F.sequence(F.lit(0), last, F.lit(step)), F.array(last)))
    return F.transform(starts, lambda s: F.struct(s.alias("at"), F.slice(hashes, s + 1, PER).alias("part")))


def _plain(text: str) -> list[str]:
    return re.sub(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ", text.lower()).split()


def anchors(texts: Iterable[str]) -> dict[int, list[str]]:
    """Words by size of shingle, such that of every template more than a fifth of the distinct shingles hold one of its size: long ones that many templates share first."""
    words: dict[int, list[list[str]]] = {}
    for many in map(_plain, texts):
        if many:
            words.setdefault(min(SHINGLE, len(many)), []).append(many)
    out = {}
    for size, group in sorted(words.items()):
        shared = Counter(w for many in group for w in set(many))
        chosen: set[str] = set()
        for many in group:
            runs = {tuple(many[k : k + size]) for k in range(len(many) - size + 1)}  # distinct ones, as containment counts them
            for word in sorted(set(many), key=lambda w: (-min(len(w), 7), -shared[w], -len(w), w)):
                if 5 * sum(any(w in chosen for w in run) for run in runs) > len(runs):
                    break
                chosen.add(word)
        out[size] = sorted(chosen)
    return out


def template_table(spark: SparkSession, templates: list[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame(templates, "license string, text string")


def scan(docs: DataFrame, templates: DataFrame | None = None, text: str = "text") -> DataFrame:
    """doc_id, licenses (names, sorted), containment (largest, 0 if none) of every row of docs.

    templates: license, text. They are the operator's configuration: their texts pass through the
    driver for the anchors; their keys and shingles are tables whose joins Spark plans by size.
    """
    spark = docs.sparkSession
    templates = template_table(spark, TEMPLATES) if templates is None else templates.select("license", "text").distinct()
    # written, so that the windows below read an array and don't make it anew
    known = templates.select("license", F.xxhash64("license", "text").alias("template"), plain_words(F.col("text")).alias("words"))
    known = store(known.withColumn("runs", _shingles(F.col("words"), F.least(F.size("words"), F.lit(SHINGLE)))).drop("words").withColumn("all", F.array_distinct("runs")), "templates").filter(F.size("runs") > 0)
    windows = F.transform(_windows(F.col("runs"), 1), lambda w: _bands(w["part"]))
    keys = known.select("template", F.explode(F.array_distinct(F.flatten(windows))).alias("key"))

    small = F.lower(F.col(text))  # all that lower_ascii changes and more: no anchor is missed
    sizes = anchors(r["text"] or "" for r in templates.toLocalIterator())
    hopes = [F.when(reduce(or_, (F.contains(small, F.lit(a)) for a in words)), size) for size, words in sizes.items()]
    hope = F.array_compact(F.array(*hopes)) if hopes else F.array().cast("array<int>")
    # what goes on is the ids, and the texts with an anchor
    rows = docs.select("doc_id", F.col(text).alias("text"), hope.alias("_sizes")).withColumn("_row", F.monotonically_increasing_id())
    rows = store(rows.withColumn("text", F.when(F.size("_sizes") > 0, F.col("text"))), "hopeful")
    near = rows.filter("text is not null").select("_row", "_sizes", plain_words(F.col("text")).alias("_words")).filter(F.size("_words") > 0)
    near = store(near.select("_row", F.transform("_sizes", lambda k: _shingles(F.col("_words"), k)).alias("_runs")), "shingles")
    mine = F.array_distinct(F.flatten(F.transform("_runs", lambda r: F.flatten(F.transform(_windows(r, STEP), lambda w: _bands(w["part"]))))))
    spread = near.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "_row")  # few bytes, much work: dealt by rows, not by files
    met = spread.select("_row", F.explode(mine).alias("key")).join(keys, "key").select("_row", "template").distinct()
    near = near.select("_row", F.flatten("_runs").alias("_all"))
    share = F.size(F.array_intersect("_all", "all")) / F.size("all")
    judged = met.join(known.select("template", "license", "all"), "template").join(near, "_row").select("_row", "license", share.alias("share"))
    found = judged.filter(F.col("share") >= CONTAINMENT).groupBy("_row").agg(F.array_sort(F.collect_set("license")).alias("licenses"), F.max("share").alias("containment"))
    out = rows.select("_row", "doc_id").join(found, "_row", "left")
    return out.select("doc_id", F.coalesce("licenses", F.array().cast("array<string>")).alias("licenses"), F.coalesce("containment", F.lit(0.0)).alias("containment"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: the licenses that every document names."""
    found = scan(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", F.array_join("licenses", ",").alias("licenses"), F.size("licenses").cast("long").alias("n_licenses"), "containment")


def _oracle() -> str:
    cells = []
    for k, (name, text) in enumerate(TEMPLATES):
        words = _plain(text)
        size = min(SHINGLE, len(words))
        cells += [f"({k}, '{name}', '{' '.join(words[i : i + size])}')" for i in range(len(words) - size + 1)]
    sizes = sorted({min(SHINGLE, len(_plain(text))) for _, text in TEMPLATES})
    return f"""
WITH shingles(template, license, words) AS (SELECT DISTINCT * FROM (VALUES {", ".join(cells)})),
docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\\x{{80}}-\\x{{10FFFF}}]+') AS w
  FROM documents),
have AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - k, 0) + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS words
  FROM docs, (SELECT unnest({sizes}) AS k) WHERE len(w) > 0),
sizes AS (SELECT template, count(*) AS n FROM shingles GROUP BY 1),
shares AS (
  SELECT doc_id, template, license, count(*) / any_value(n) AS share
  FROM have JOIN shingles USING (words) JOIN sizes USING (template) GROUP BY 1, 2, 3),
found AS (
  SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses, count(DISTINCT license) AS n, max(share) AS share
  FROM shares WHERE share >= {CONTAINMENT} GROUP BY 1)
SELECT doc_id, coalesce(licenses, '') AS licenses, coalesce(n, 0) AS n_licenses, coalesce(share, 0.0) AS containment
FROM docs LEFT JOIN found USING (doc_id)
"""


ORACLE = _oracle()
