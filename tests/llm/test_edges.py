"""Every operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from touchline.llm import decontaminate, langid, licenses, lm, mixing, pii, quality, simhash, tokens, urls
from touchline.llm.common import bucket

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = "word another third, " * 20000
NORMAL = "The quick brown fox jumps over the lazy dog near the old river bank, and nobody in the quiet village seems to notice. " * 2
ROWS = [
    (1, NORMAL, "en", "a", 10),
    (2, None, "en", "a", None),
    (3, "", None, None, 0),
    (4, " \t\n ", "de", "b", 4),
    (None, NORMAL, None, None, 3),
    (6, LONG, "en", "b", 5),
    (7, NORMAL, "en", "a", 10),
    (7, NORMAL, "en", "a", 10),
    (9, "éàü 日本語 \x00 zero", "fr", "c", 9),
    (10, "mail bob.smith@mail.example.com or +1 (017) 555-7713, 10.0.0.256, 10.0.0.25", "en", "c", 9),
]


@pytest.fixture(params=["rows", "empty"])
def docs(request, spark):
    return spark.createDataFrame(ROWS if request.param == "rows" else [], SCHEMA)


def same_ids(out, docs):
    got = sorted(((r[0] is None, r[0]) for r in out.select("doc_id").collect()), key=str)
    assert got == sorted(((r[0] is None, r[0]) for r in docs.select("doc_id").collect()), key=str)


def test_language_model(docs):
    out = lm.score_documents(docs.withColumn("held_out", bucket(F.col("doc_id"), 7) == 2))
    same_ids(out, docs)
    for r in out.collect():
        assert r["score"] <= 1e-9 and r["base_score"] <= 1e-9 and r["n_tokens"] >= 1


def test_mixing(docs):
    out = mixing.mixed_sizes(docs)
    same_ids(out, docs)
    rows = out.collect()
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    total = sum(r["size"] for r in rows)
    assert abs(sum(r["taken"] for r in rows) - 1.5 * total) <= 3
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert sum(len((r["text"] or "").split()) for r in mixed.collect()) == pytest.approx(1.5 * total, abs=10)


def test_simhash(docs):
    out = simhash.near_duplicates(docs)
    same_ids(out, docs)
    found = {r["doc_id"]: (r["fp"], r["component_id"]) for r in out.collect()}
    if found:
        assert found[1][1] == found[7][1] == found[None][1] == 1
        assert found[2] == found[3] == found[4] == (0, 2)
        assert sorted(r["doc_id"] for r in simhash.one_of_each(docs).collect()) == [1, 2, 6, 9, 10]


def test_licenses(docs):
    out = licenses.scan(docs)
    same_ids(out, docs)
    assert all(r["licenses"] == [] for r in out.collect())


def test_decontamination(docs, spark):
    items = spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog near the old"), (2, "Zero"), (3, None), (4, ""), (2, "zero")], "item_id bigint, text string")
    out = decontaminate.find_contamination(docs, items)
    same_ids(out, docs)
    want = decontaminate.brute_force([(r[0], r[1]) for r in docs.collect()], [tuple(r) for r in items.collect()])
    for r in out.collect():
        assert (r["n_words"], r["n_hit"]) == want[r["doc_id"]][:2]
    assert decontaminate.find_contamination(docs, items.limit(0)).filter("n_hit > 0").count() == 0
    left = {r["doc_id"] for r in decontaminate.without_contaminated(docs, items).collect()}
    assert left == ({2, 3, 4, 6, 10} if want else set())


def test_languages(docs):
    out = langid.predict(docs.withColumn("held_out", F.lit(False)), langid.fit(docs.select("doc_id", "text", "lang")))
    same_ids(out, docs)
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in out.collect()}
    if found:
        assert found[2] == found[3] == found[4] == ("und", 0.0)
        assert found[1][0] == "en" and all(0 <= s <= 1 for _, s in found.values())


def test_quality(docs):
    out = quality.judge(docs)
    same_ids(out, docs)
    assert set(docs.columns) < set(out.columns)
    assert not out.filter("n_words < 10 and kept").count()


def test_quality_replaces_clashing_columns(docs):
    out = quality.judge(docs.withColumns({"kept": F.lit("x"), "n_words": F.lit("y"), "quality": F.lit(1), "extra": F.lit(2)}))
    assert dict(out.dtypes)["kept"] == "boolean" and out.columns.count("n_words") == 1 and "extra" in out.columns


def test_pii(docs):
    out = pii.sanitise(docs)
    same_ids(out, docs)
    found = {r["doc_id"]: r for r in out.collect()}
    if found:
        assert found[10]["base"] == "email:5:31,ip:66:75,phone:35:52"
        assert found[10]["sanitised"] == "mail <email> or <phone>, 10.0.0.256, <ip>"
        assert found[1]["spans"] == "" and found[2]["sanitised"] is None


def test_tokens(docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokens.tokenizer_path())
    rows = sorted(docs.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
    want, at = [], 0
    for r in rows:
        ids = tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [2]
        want.append((r["doc_id"], at, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
        at += len(ids)
    got = tokens.encode_documents(docs.withColumn("start", F.lit("clash"))).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want


def test_urls(spark):
    rows = [(1, None), (2, ""), (3, "no scheme"), (4, "http://"), (5, "HTTP://A.Example.COM/en/71?x#y"), (5, "HTTP://A.Example.COM/en/71?x#y"), (6, "x://b.net/de/8"), (None, "y://example.net/de/80/"), (8, "z://com/en/"), (9, "z://notcom/en/"), (10, "z://com?en/")]
    for rows in (rows, []):
        pages = spark.createDataFrame(rows, "page_id bigint, url string").withColumn("rule", F.lit("clash"))
        out = urls.filter_urls(pages, urls.rule_table(spark, urls.RULES))
        assert out.count() == len(rows)
        found = {r["page_id"]: tuple(r)[1:] for r in out.collect()}
        if rows:
            assert found[1] == found[3] == ("", "", None, "allow")
            assert found[5] == ("a.example.com", "/en/71", "example.com/en/7", "allow")
            assert found[6][2:] == ("net/de/", "allow") and found[None][2:] == ("example.net/de/8", "block")
            assert found[8][2:] == ("com/en/", "block") and found[9][2] is None and found[10][:2] == ("com", "")


def test_pipeline_stages_keep_columns(docs, spark, tmp_path):
    spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven")], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == corpus_pipeline.COLUMNS
        out.count()
