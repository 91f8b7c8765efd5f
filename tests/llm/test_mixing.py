"""op2: the schedule decides the order, shares hold in every prefix, reruns agree, and rows are carried whole."""

import random

import pytest
from pyspark.sql import functions as F

from touchline.llm import mixing


def rows(seed=0, n=300):
    draw = random.Random(seed)
    return [(i if draw.random() < 0.9 else None, "  ".join(f"w{i}\t{k}" for k in range(draw.randrange(0, 40))), draw.choice(["a", "a", "a", "b", "c", None])) for i in range(n)]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(rows(), "doc_id bigint, text string, source string").repartition(3)


def sizes(docs):
    return sorted((tuple(r) for r in mixing.mixed_sizes(docs).collect()), key=str)


def test_the_golden_ratio_decides_the_slots(spark, docs, monkeypatch):
    before = sizes(docs)
    monkeypatch.setattr(mixing, "GOLDEN", 0.001)
    after = sizes(docs)
    drop = lambda rows: sorted((r[:5] for r in rows), key=str)
    assert drop(before) == drop(after) and before != after


def test_reruns_agree_on_other_partitions(docs):
    assert sizes(docs) == sizes(docs.repartition(7, "text"))


def test_every_prefix_has_the_target_shares(spark, docs, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 16)
    sized = docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("_hash"))
    placed, pieces = mixing.mix(sized, block=16)
    want = {r["_src"]: r["target"] for r in placed.select("_src", "target").distinct().collect()}
    total, have, slots = sum(want.values()), dict.fromkeys(want, 0), pieces.groupBy("slot", "_src").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("n")).orderBy("slot").collect()
    assert len(slots) > 100
    done = 0
    for r in slots:
        have[r["_src"]] += r["n"]
        done += r["n"]
        assert all(abs(have[s] - done * want[s] / total) <= 16 * 3 for s in want)


def test_documents_come_in_slot_order_with_their_columns(spark, docs):
    extra = docs.withColumns({"_src": F.lit("x"), "slot": F.lit(7), "size": F.lit("y"), "n_chars": F.length("text").cast("long"), "row": F.lit(1)})
    out = mixing.mixed_documents(extra)
    assert out.columns == extra.columns
    texts, got = {(r[0], r[1]) for r in rows()}, [tuple(r) for r in out.collect()]
    cut = [r for r in got if (r[0], r[1]) not in texts]
    assert len(cut) <= 4 and all(any(i == r[0] and r[1] in t for i, t in texts) and r[6] == len(r[1]) for r in cut)
    first = {}
    for k, r in enumerate(got):
        first.setdefault((r[0], r[1]), k)
    slots = {(r["doc_id"], r["text"]): r["first_slot"] for r in mixing.mixed_sizes(docs).join(docs.filter("doc_id is not null"), "doc_id").collect()}
    order = [slots[k] for k in sorted(first, key=first.get) if k in slots and slots[k] is not None]
    assert order == sorted(order) and len(order) > 200


def test_cut_keeps_white_space(spark):
    df = spark.createDataFrame([(" a\t\tb \n c  d ", 1, 3)], "t string, a bigint, b bigint")
    assert df.select(mixing._cut(F.col("t"), F.col("a"), F.col("b"))).first()[0] == "b \n c"
