"""op1: scores against plain Python, words outside the head, clashing columns and reruns."""

import collections
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from touchline.llm import lm


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")), None]


def middle(count):
    top = 2 ** count.bit_length()
    return (top / 2 + top - 1) / 2 if count else 0.0


def brute_force(train, texts):
    """id -> score by the docstring's formula; all counts are quantised."""
    ones, twos = collections.Counter(), collections.Counter()
    for t in map(tokens, train):
        ones.update(t)
        twos.update(zip([None, *t], t, strict=False))
    n, v = sum(ones.values()), len(ones)
    count = lambda w: middle(ones[w])
    out = {}
    for i, text in texts.items():
        out[i] = 0.0
        for a, b in zip([None, *tokens(text)], tokens(text), strict=False):
            p = (count(b) + 1) / (n + v + 1)
            out[i] += math.log10((min(max(middle(twos[a, b]) - lm.DISCOUNT, 0), count(a)) + lm.MU * p) / (count(a) + lm.MU))
    return out


@pytest.mark.parametrize("head, segment, most", [(1 << 19, 2_000_000, 128 << 20), (40, 2000, 3000), (0, 2000, 1 << 20)])
def test_scores(spark, monkeypatch, head, segment, most):
    monkeypatch.setattr(lm, "HEAD", head)
    monkeypatch.setattr(lm, "SEGMENT", segment)
    monkeypatch.setattr(lm, "BROADCAST_BYTES", most)
    draw = random.Random(1)
    texts = {i: " ".join(f"W{int(draw.paretovariate(0.8))}" for _ in range(draw.randrange(0, 120))) for i in range(150)}
    texts |= {200: None, 201: "  ", 202: texts[3]}
    docs = spark.createDataFrame([(i, t, i % 5 == 0) for i, t in texts.items()], "doc_id bigint, text string, held_out boolean")
    got = {r["doc_id"]: r["score"] for r in lm.score_documents(docs.withColumns({"row": F.lit(1), "score": F.lit("x"), "rest": F.lit(2)})).collect()}
    want = brute_force([t for i, t in texts.items() if i % 5], texts)
    assert got.keys() == want.keys()
    close = [abs(got[i] - want[i]) <= 0.02 * abs(want[i]) + 1e-9 for i in want]
    assert sum(close) >= 0.97 * len(close)
    assert got[202] == pytest.approx(got[3])


def test_end_token_is_known_with_a_small_head(spark, monkeypatch):
    monkeypatch.setattr(lm, "HEAD", 50)
    docs = spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(200)), False)], "doc_id bigint, text string, held_out boolean")
    r = lm.score_documents(docs).first()
    assert r["n_known"] == 201 and r["base_score"] == pytest.approx(201 * math.log10(2 / (201 + 201 + 1)))


def test_counts_of_the_head_are_quantised():
    """What the score takes for a count is a function of its level alone, as the filter holds it."""
    import numpy as np

    counts = np.array([1, 2, 3, 4, 7, 8, 1000, 1023])
    assert lm._estimate(lm._levels(counts)).tolist() == [middle(int(c)) for c in counts]
