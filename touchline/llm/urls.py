"""URL filters: host-suffix and path-prefix expressions against hashed rules.

A URL becomes every expression (host suffix, path prefix) that a rule could have; expressions
meet the rules in an equi-join on a short hash prefix, full digests confirm the pairs, and the
longest rule wins. Host suffixes are taken only with the numbers of labels that rule hosts have,
path prefixes only at the lengths that rule paths have, so a URL makes at most (distinct numbers of
labels) x (distinct path lengths) expressions however long it is.

Defined results: NULL URLs and those without :// have an empty host and path, fit no rule and get
the default verdict; repeated rows are judged one by one; an empty table gives an empty result;
extra columns of the input are ignored, whatever their names. Ties of length go to the longer host, then to "allow".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm.common import lower_ascii

#: (action, host, path); a rule's name is host and path together
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]

#: Hex digits of the digest that the equi-join uses, and the most rules that are sent to every executor.
PREFIX, BROADCAST_RULES = 8, 100_000


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "action string, rule_host string, rule_path string")


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL: from the first :// to / ? or #, then up to ? or #."""
    after = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = lower_ascii(F.regexp_extract(after, r"^([^/?#]*)", 1))
    path = F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat_ws("\n", host, path), 256)


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """One row per row of pages: page_id, host, path, rule (NULL if none fits), verdict."""
    host, path = split_url(F.col(url))
    rows = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("_row", F.monotonically_increasing_id())
    rules = rules.dropDuplicates(["rule_host", "rule_path", "action"])
    labels = lambda host: F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1
    n_rules, lengths, depths = rules.agg(F.count("*"), F.collect_set(F.length("rule_path")), F.collect_set(labels(F.col("rule_host")))).first()
    lengths = F.array(*(F.lit(x) for x in sorted(lengths))).cast("array<int>")
    # substring_index takes its count as a literal: one suffix for each number of labels
    suffixes = F.array_compact(F.array(F.lit(None).cast("string"), *(F.when(F.col("_labels") >= k, F.substring_index("host", ".", -k)) for k in sorted(depths))))
    expressions = (
        rows.withColumn("_labels", labels(F.col("host")))
        .withColumn("_host", F.explode_outer(suffixes))
        .withColumn("_len", F.explode_outer(F.filter(lengths, lambda n: n <= F.length("path"))))
        .withColumn("_full", _digest(F.col("_host"), F.substring("path", F.lit(1), F.col("_len"))))
        .withColumn("_short", F.when(F.col("_host").isNotNull() & F.col("_len").isNotNull(), F.substring("_full", 1, PREFIX)))
    )
    full = _digest(F.col("rule_host"), F.col("rule_path"))
    wins = F.struct((F.length("rule_host") + F.length("rule_path")).alias("n"), F.length("rule_host").alias("h"), (F.col("action") == "allow").alias("a"))
    known = rules.select(full.alias("_rule_full"), F.substring(full, 1, PREFIX).alias("_rule_short"), wins.alias("_wins"), F.concat("rule_host", "rule_path").alias("_name"), "action")
    if n_rules <= BROADCAST_RULES:
        known = F.broadcast(known)
    found = expressions.join(known, F.col("_short") == F.col("_rule_short"), "left")
    fits = F.col("_full") == F.col("_rule_full")
    best = found.groupBy("_row").agg(F.first("page_id").alias("page_id"), F.first("host").alias("host"), F.first("path").alias("path"), F.max(F.when(fits, F.struct("_wins", "_name", "action"))).alias("_best"))
    return best.select("page_id", "host", "path", F.col("_best._name").alias("rule"), F.coalesce("_best.action", F.lit(default)).alias("verdict"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: the verdict on every page's URL."""
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"), rule_table(spark, RULES))


_CASES = " ".join(
    f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{a} {h}{p}'" for a, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2]))
)

ORACLE = rf"""
WITH cut AS (
  SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
hit AS (SELECT *, CASE {_CASES} END AS best FROM parts)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, split_part(best, ' ', 2) AS rule,
       coalesce(split_part(best, ' ', 1), 'allow') AS verdict
FROM hit
"""
