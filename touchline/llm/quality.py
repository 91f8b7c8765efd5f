"""Quality rules by weak supervision.

Rules vote good (1), bad (-1) or abstain (0). Expectation-maximisation estimates, without
labels, how often each rule is right; the posterior of "good" given all votes replaces
a filter that asks for every rule to pass.

START, PULL, NOISE, LEAST_GOOD and MOST_GOOD are its parameters: they suit corpora of mostly sound
text and name the latent classes. A corpus of mostly junk needs others.

Only DataFrame expressions touch the documents. What reaches the driver is the table of
vote patterns, at most 3 ** len(RULES) rows of counts whatever the corpus.

Defined results: NULL and empty texts have no words and fail the base test; repeated rows are
judged alike; an empty table gives an empty result; other columns are carried along, and those
named like an output column are replaced by it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm.common import blank_to_space, documents, fresh, store, words_of

SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_shouts", "n_stops", "n_distinct")


def _count_of(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the counts of FEATURES (long) for every whole text."""
    t, size = F.coalesce(F.col(text), F.lit("")), F.size
    scratch = fresh(docs, "_t", "_words", "_lines", "_h", "_w", "_s", "_p")
    t_, words, lines, h_, w_, s_, p_ = scratch
    df = docs.drop(*FEATURES).withColumn(t_, t).withColumn(words, words_of(F.col(t_)))
    df = df.withColumns(
        {
            lines: F.filter(F.split(t_, "\n", -1), lambda x: F.trim(blank_to_space(x)) != ""),
            h_: F.transform(words, lambda w: F.xxhash64(w)),
        }
    )
    hashes = F.col(h_)
    window = F.transform(hashes, lambda h, i: F.xxhash64(h, *(F.get(hashes, i + k) for k in range(1, 5))))
    df = df.withColumn(w_, F.when(size(h_) >= 5, F.slice(window, F.lit(1), size(h_) - 4)).otherwise(F.array().cast("array<bigint>")))
    # positions of the windows that occur again: neighbours in hash order; most texts have none and skip the sort
    pairs = F.when(size(F.array_distinct(w_)) < size(w_), F.array_sort(F.transform(w_, lambda w, i: F.struct(w.alias("w"), i.alias("i")))))
    df = df.withColumn(s_, pairs)
    runs = F.col(s_)
    again = F.transform(runs, lambda s, k: F.when((F.get(runs, k - 1)["w"] == s["w"]) | (F.get(runs, k + 1)["w"] == s["w"]), s["i"]))
    df = df.withColumn(p_, F.sort_array(F.array_compact(again)))
    at = F.col(p_)
    covered = F.aggregate(F.transform(at, lambda p, k: F.least(F.lit(5), F.coalesce(F.get(at, k + 1) - p, F.lit(5)))), F.lit(0), lambda a, x: a + x)
    made = {
        "n_words": size(words),
        "word_chars": F.length(F.replace(blank_to_space(F.col(t_)), F.lit(" "), F.lit(""))),
        "n_symbols": _count_of(F.col(t_), SYMBOLS),
        "n_dup_lines": size(lines) - size(F.array_distinct(lines)),
        "n_repeat_words": F.coalesce(covered, F.lit(0)),
        "n_lines": size(lines),
        "n_upper": _count_of(F.col(t_), UPPER),
        "n_shouts": _count_of(F.col(t_), "!?"),
        "n_stops": _count_of(F.col(t_), ".,;:"),
        "n_distinct": size(F.array_distinct(h_)),
    }
    return df.withColumns({k: c.cast("long") for k, c in made.items()}).drop(*scratch)


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0))


def _share(name: str, of: str) -> Column:
    return F.col(name) / F.greatest(F.col(of), F.lit(1))


#: name -> vote expression over FEATURES
RULES = {
    "length": lambda: _vote(F.col("n_words") >= 30, F.col("n_words") < 10),
    "word_length": lambda: _vote(_share("word_chars", "n_words").between(3.5, 7.5), ~_share("word_chars", "n_words").between(2.0, 12.0)),
    "symbols": lambda: _vote(F.lit(False), _share("n_symbols", "n_words") > 0.1),
    "symbol_chars": lambda: _vote(F.lit(False), _share("n_symbols", "word_chars") > 0.015),
    "upper": lambda: _vote(F.lit(False), _share("n_upper", "word_chars") > 0.2),
    "shouts": lambda: _vote(F.lit(False), _share("n_shouts", "n_words") > 0.15),
    "repeats": lambda: _vote(F.lit(False), _share("n_repeat_words", "n_words") > 0.3),
    "stops": lambda: _vote(_share("n_stops", "n_words") >= 0.08, _share("n_stops", "n_words") < 0.02),
    "variety": lambda: _vote(F.lit(False), F.col("n_distinct") * F.col("n_distinct") < F.col("n_words") * 4),
}


#: Where EM starts: the chances of (bad, abstain, good) votes by a rule on good and on bad documents.
START = {True: (0.01, 0.49, 0.5), False: (0.25, 0.35, 0.4)}
#: Share of the documents that START counts for, and the most bad votes that a sound rule gives to good documents.
PULL, NOISE = 0.02, 0.02
#: The share of good documents that EM may find: outside it the two classes are no longer those of START.
LEAST_GOOD, MOST_GOOD = 0.6, 0.98


def fit_votes(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 40, prior: float = 0.85) -> tuple[float, list[dict[bool, tuple[float, float, float]]]]:
    """EM on counted vote patterns -> (share of good documents, per rule and class the chances of its votes).

    Class-conditional chances let a rule be rarely heard on bad documents and yet be trusted when
    it is. START and NOISE fix which latent class is the bad one.
    """
    n = len(patterns[0][0]) if patterns else len(RULES)
    pull = PULL * sum(count for _, count in patterns) + 1
    table = [dict(START) for _ in range(n)]
    for _ in range(rounds):
        total = good = 0.0
        seen = [{c: [pull * x for x in START[c]] for c in START} for _ in range(n)]
        for votes, count in patterns:
            p = posterior(votes, prior, table)
            good, total = good + p * count, total + count
            for rule, v in zip(seen, votes, strict=True):
                rule[True][v + 1] += p * count
                rule[False][v + 1] += (1 - p) * count
        prior = min(MOST_GOOD, max(LEAST_GOOD, good / total)) if total else prior
        for rule in seen:
            rule[True][0] = min(rule[True][0], NOISE * sum(rule[True]))
        table = [{c: tuple(x / sum(rule[c]) for x in rule[c]) for c in rule} for rule in seen]
    return prior, table


def weight(rule: dict[bool, tuple[float, float, float]], vote: int) -> float:
    """Log odds that a vote adds; a bad vote never speaks for a document, a good one never against."""
    w = math.log(rule[True][vote + 1] / rule[False][vote + 1])
    return min(w, 0.0) if vote < 0 else max(w, 0.0) if vote > 0 else 0.0


def posterior(votes: tuple[int, ...], prior: float, table: list[dict[bool, tuple[float, float, float]]]) -> float:
    z = math.log(prior / (1 - prior)) + sum(weight(rule, v) for rule, v in zip(table, votes, strict=True))
    return 1 / (1 + math.exp(-z))


def judge(docs: DataFrame, text: str = "text", threshold: float = 0.5, carry: list[str] | None = None) -> DataFrame:
    """Adds FEATURES, base_failed, quality (posterior, double) and kept to the rows of docs, or to their columns carry alone.

    base_failed: under 10 words, or over 20 % of the words in repeated five-word windows.
    """
    drop = {"base_failed", "quality", "kept", *RULES_COLUMNS}
    rows = features(docs.drop(*drop), text).withColumns({f"vote_{k}": rule().cast("int") for k, rule in RULES.items()})
    if carry is not None:
        rows = rows.select(*carry, *FEATURES, *RULES_COLUMNS)
    rows = store(rows.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))), "quality")
    counted = rows.groupBy(*RULES_COLUMNS).count().collect()  # at most 3 ** len(RULES) rows
    prior, table = fit_votes(sorted((tuple(r[:-1]), r[-1]) for r in counted))
    z = F.lit(math.log(prior / (1 - prior)))
    for name, rule in zip(RULES_COLUMNS, table, strict=True):
        z = z + F.when(F.col(name) < 0, F.lit(weight(rule, -1))).when(F.col(name) > 0, F.lit(weight(rule, 1))).otherwise(F.lit(0.0))
    quality = F.lit(1.0) / (F.lit(1.0) + F.exp(-z))
    return rows.withColumn("quality", quality).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold)).drop(*RULES_COLUMNS)


RULES_COLUMNS = [f"vote_{k}" for k in RULES]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: every document's base counts and verdict."""
    out = judge(documents(spark, sf_dir).select("doc_id", "text"), carry=["doc_id"])
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")
