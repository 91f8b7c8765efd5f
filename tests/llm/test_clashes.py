"""Extra columns named like an operator's results or scratch columns change nothing; reruns and ties agree."""

import pytest
from pyspark.sql import functions as F

from touchline.llm import decontaminate, langid, licenses, lm, mixing, near_copies, pii, quality, simhash
from touchline.llm.common import bucket

from .test_edges import ROWS, SCHEMA

CLASHES = (
    "score base_score n_tokens n_known train_tokens size source_size target taken first_slot slots slot fp fingerprint component_id component licenses n_words n_hit n_items "
    "items contaminated lang_pred spans base sanitised start kept quality key word words hash id h p n "
    "_id _hash _src _key _null _hit _t _words _lines _h _w _s _p _n _b _doc _row _text _band _piece _size _slot _mark"
).split()
ITEMS = [(1, "quick brown fox jumps over the lazy dog near the old"), (2, "Zero")]


def operators(spark):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    return {
        "lm": lambda d: lm.score_documents(d.withColumn("held_out", bucket(F.col("doc_id"), 7) == 2)),
        "mixing": mixing.mixed_sizes,
        "simhash": simhash.near_duplicates,
        "one_of_each": simhash.one_of_each,
        "near_copies": lambda d: simhash.one_of_each(d, find=near_copies.near_copies),
        "licenses": licenses.scan,
        "decontaminate": lambda d: decontaminate.find_contamination(d, items),
        "without_contaminated": lambda d: decontaminate.without_contaminated(d, items),
        "langid": lambda d: langid.predict(d.withColumn("held_out", F.lit(False)), langid.fit(d.select("doc_id", "text", "lang"))),
        "quality": quality.judge,
        "pii": pii.sanitise,
    }


NAMES = "lm mixing simhash one_of_each near_copies licenses decontaminate without_contaminated langid quality pii".split()


def kept(out, names):
    return sorted((str(tuple(r)) for r in out.select(*names).collect()))


@pytest.mark.parametrize("name", NAMES)
def test_clashing_columns(spark, name):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    run = operators(spark)[name]
    plain = run(docs)
    odd = docs.withColumns({c: F.lit("clash") for c in CLASHES if c not in docs.columns})
    assert kept(run(odd), plain.columns) == kept(plain, plain.columns)


@pytest.mark.parametrize("name", ["mixing", "langid", "lm", "one_of_each"])
def test_reruns_agree_in_any_order(spark, name):
    run = operators(spark)[name]
    one, two = run(spark.createDataFrame(ROWS, SCHEMA)), run(spark.createDataFrame(ROWS[::-1], SCHEMA).repartition(5))
    assert kept(one, one.columns) == kept(two, two.columns)


def test_tied_languages(spark):
    docs = spark.createDataFrame([(1, "same words here", "b", None, 0), (2, "same words here", "a", None, 0)], SCHEMA)
    found = langid.predict(docs.withColumn("held_out", F.lit(False)), langid.fit(docs.select("doc_id", "text", "lang"))).collect()
    assert len({r["lang_pred"] for r in found}) == 1 and found[0]["lang_pred"] in ("a", "b")
