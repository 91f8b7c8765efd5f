"""op11 against plain Python in exact whole numbers."""

import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.llm import divergence


def plain(rows, least, top=divergence.TOP):
    docs = [((lang or ""), (source or ""), re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        df = collections.Counter(t for d in mine for t in set(d[2]))
        kept = sorted(t for t, n in df.items() if n >= least)
        groups = sorted({d[1] for d in mine})
        counts = {g: collections.Counter(t for d in mine if d[1] == g for t in d[2] if df[t] >= least) for g in groups}
        share = lambda c, n: 1 + 10**9 * (c + 5) // (n + 5 * len(kept))
        p = {g: {t: share(counts[g][t], sum(counts[g].values())) for t in kept} for g in groups}
        all_ = sum(counts.values(), collections.Counter())
        q = {t: share(all_[t], sum(all_.values())) for t in kept}
        for g in groups:
            pairs = [("pair", h, sum(abs(p[g][t] - p[h][t]) for t in kept)) for h in groups if h != g]
            terms = [("term", t, p[g][t] - q[t]) for t in kept if counts[g][t] and p[g][t] > q[t]]
            for items in (pairs, terms):
                ranked = sorted(items, key=lambda x: (-x[2], x[1].encode()))
                out += [(lang, g, *x, k + 1) for k, x in enumerate(ranked) if x[0] == "pair" or k < top]
    return sorted(out)


def _rows(n=400):
    rng = random.Random(5)
    words = [f"{a}{b}" for a in ("the", "Éa", "zu", "日") for b in "abcdefghij"]
    lang = lambda: rng.choice(["en", "en", "de", None, ""])
    rows = [(" ".join(rng.choices(words, k=rng.randint(0, 30))) + rng.choice(["", ". 12", "\x00x|y~z"]), lang(), rng.choice(["s1", "s2", "s3", None])) for _ in range(n)]
    return [*rows, (None, "en", "only"), ("", "xx", "a"), ("rare", "xx", "b"), (None, None, None), ("THE the The", "one", "one")]


@pytest.mark.parametrize("block, cells, merge", [(2048, 1 << 21, 1 << 20), (3, 8, 10)])
def test_equals_plain_python(spark, monkeypatch, block, cells, merge):
    monkeypatch.setattr(divergence, "BLOCK", block)
    monkeypatch.setattr(divergence, "CELLS", cells)
    monkeypatch.setattr(divergence, "MERGE", merge)
    rows = _rows()
    docs = spark.createDataFrame(rows, "text string, lang string, source string").repartition(5).withColumn("term", F.lit(1)).withColumn("n", F.lit("x"))
    found = sorted(tuple(r) for r in divergence.divergence(docs).select("lang", "source", "part", "item", "value", "rank").collect())
    assert found == plain(rows, divergence.LEAST_DOCS)


def test_shares_are_exact_for_large_counts():
    rng = np.random.default_rng(1)
    whole = rng.integers(1, 1 << 52, 2000)
    part = (whole * rng.random(2000)).astype(np.int64)
    assert divergence.scaled(part, whole).tolist() == [10**9 * int(a) // int(b) for a, b in zip(part, whole, strict=True)]


def test_empty_table(spark):
    assert divergence.divergence(spark.createDataFrame([], "text string, lang string, source string")).collect() == []
