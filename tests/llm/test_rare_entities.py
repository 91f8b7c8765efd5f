"""Entities of one or two texts take part in op9's co-occurrence."""

from touchline.llm import pii


def test_rare_entities_are_judged(spark):
    rows = [(k, f"common words here zorblax unique{k} zed@spy.example.org today") for k in range(2)]
    rows += [(2, "common words here quorvex shared ann@one.example.org today"), (3, "common words here shared today")]
    rows += [(10 + k, f"common words here today other{k}") for k in range(1100)]
    got = {r["doc_id"]: r for r in pii.sanitise(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert [got[k]["sanitised"] for k in range(2)] == [f"common words here <term> unique{k} <email> today" for k in range(2)]
    assert got[2]["sanitised"] == "common words here <term> shared <email> today"
    assert all(r["spans"] == "" for k, r in got.items() if k > 2)
