"""Cases that once gave wrong results: repeated shingles of a template, item ids in two blocks."""

from touchline.llm import decontaminate, licenses


def test_template_with_a_repeated_phrase(spark):
    words = [f"word{k}" for k in range(44)]
    phrase = "alpha beta gamma delta epsilon"
    template = " ".join([*words, *[phrase] * 8])
    templates = licenses.template_table(spark, [("repeating", template)])
    distinct = {tuple(t) for t in (template.split()[k : k + 5] for k in range(len(template.split()) - 4))}
    share = sum(set(s) <= set(words) for s in distinct) / len(distinct)
    assert share >= licenses.CONTAINMENT
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:20])), (3, template), (4, phrase)], "doc_id bigint, text string")
    found = {r["doc_id"]: (r["licenses"], r["containment"]) for r in licenses.scan(docs, templates).collect()}
    assert found[1] == (["repeating"], share) and found[3] == (["repeating"], 1.0) and found[2][0] == found[4][0] == []


def test_item_ids_count_once_over_blocks(spark, monkeypatch):
    one, two = " ".join(f"a{k}" for k in range(12)), " ".join(f"b{k}" for k in range(12))
    benchmark = spark.createDataFrame([(7, one), (7, two), (8, two)], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, f"{one} x {two}"), (2, two), (3, "none")], "doc_id bigint, text string")
    found = []
    for words in (1_000_000, 1):
        monkeypatch.setattr(decontaminate, "ITEM_WORDS", words)
        found.append(sorted((r["doc_id"], r["items"], r["n_hit"]) for r in decontaminate.find_contamination(docs, benchmark).collect()))
    assert found[0] == found[1] == [(1, ["7", "8"], 24), (2, ["7", "8"], 12), (3, [], 0)]
