"""op12 against plain loops, and on held-out labels."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.llm import neighbours

SF = "/root/testdata/sf0.01"


def _counts(texts):
    raw = [t.encode() for t in texts]
    return neighbours.counts(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))


def test_terms_of_a_text():
    found = _counts(["aa BB", "", "x x x y y", "l one\nl one\n#$"])
    kind = neighbours._CLASS
    pairs = lambda t: {(kind[a], kind[b]) for a, b in zip(t, t[1:], strict=False)}
    assert set(np.flatnonzero(found[0, : neighbours.PAIRS])) == {a * neighbours.CLASSES + b for a, b in pairs(b"aa BB")}
    assert found[1, : neighbours.PAIRS + neighbours.WORDS + neighbours.SHARES].sum() == 0
    shape = neighbours.PAIRS + neighbours.WORDS
    assert found[2, shape] == pytest.approx(3 / 5) and found[2, shape + 1] == pytest.approx(1 / 5)
    assert found[3, shape + 2] == pytest.approx(1 / 3) and found[3, shape + 4] == pytest.approx(2 / 14) and found[0, shape + 3] == pytest.approx(2 / 5)
    together = _counts(["one two", "aa BB", ""])
    assert (together[1] == found[0]).all()  # the texts beside it change nothing


def test_votes_equal_plain_loops():
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(["to", "be", "or", "not", "X#", "Y$"], size=rng.integers(1, 12))) for _ in range(60)]
    label = np.array([float("#" in t) for t in texts])
    idf = np.ones(neighbours.PAIRS + neighbours.WORDS, np.float32)
    model = neighbours.Model(idf, _counts(texts), label)
    asked = [*texts[:10], "", "to X# be", "zzz"]
    points, off = neighbours.vectors(_counts(asked), idf) @ model.axes, 0
    for point, score in zip(points, model.score(_counts(asked)), strict=True):
        length = math.sqrt(sum(float(x) ** 2 for x in point)) or 1e-9
        alike = [round(sum(float(x) * float(y) for x, y in zip(point, other, strict=True)) / length, 5) for other in model.points]
        least = sorted(alike)[-neighbours.NEIGHBOURS]
        votes = [(max(a, 0) ** neighbours.POWER, y) for a, y in zip(alike, label, strict=True) if a >= least]
        total = sum(w for w, _ in votes)
        want = sum(w * y for w, y in votes) / total if total else label.mean()
        off += abs(score - want) > 2e-3
        assert 0 <= score <= 1
    assert off <= 1  # a fifth place that rounds the other way in single precision may move one tie


def test_axes_keep_what_a_full_decomposition_keeps():
    rng = np.random.default_rng(4)
    terms = (rng.standard_normal((200, 30)) @ rng.standard_normal((30, neighbours.TERMS))).astype(np.float32)
    axes = neighbours.Model._axes(terms.copy())
    kept = np.linalg.norm(terms @ axes) ** 2
    full = np.linalg.svd(terms.astype(np.float64), compute_uv=False)[: neighbours.DIMS]
    assert kept == pytest.approx((full**2).sum(), rel=1e-4)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_held_out_accuracy(spark):
    found = neighbours.query(spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    held = found.filter("held_out").join(labels, "doc_id").toPandas()
    assert found.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert len(held) > 50 and (held["predicted"] == held["quality"]).mean() >= 0.95


def test_edges(spark):
    schema = "doc_id long, text string, held_out boolean"
    rows = [(1, "good text of words", False), (1, "good text of words", False), (2, "#### $$$$ ####", False), (None, "good text", False), (3, None, True), (4, "", True), (5, "good text of words", True), (5, "good text of words", True), (6, "w" * 300_000, True)]
    docs = spark.createDataFrame(rows, schema).withColumn("label", F.lit("x")).withColumn("_h", F.lit(2))
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (None, 1), (4, None), (9, 1)], "doc_id long, quality int")
    model = neighbours.fit(docs, docs.filter(~F.col("held_out")), labels)
    found = [tuple(r) for r in neighbours.classify(docs, model).collect()]
    assert len(found) == len(rows) and all(0 <= r[2] <= 1 and r[3] == int(r[2] >= 0.5) for r in found)
    assert {r[3] for r in found if r[0] == 5} == {1} and len({r[2] for r in found if r[0] == 5}) == 1 and next(r[3] for r in found if r[0] == 2) == 0
    none = neighbours.fit(docs, docs.filter("false"), labels)
    assert {r["score"] for r in neighbours.classify(docs, none).collect()} == {0.5}
    assert neighbours.classify(docs.filter("false"), model).collect() == []


def test_sample_is_bounded(spark):
    docs = spark.range(300).selectExpr("id % 3 as doc_id", "concat('text ', id) as text")
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 1), (2, 0)], "doc_id long, quality int")
    some = neighbours.labelled_sample(docs, labels, size=20).collect()
    assert len(some) == 40 and {r["label"] for r in some} <= {0.0, 0.5, 1.0}
