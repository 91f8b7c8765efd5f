"""op4, op5, op6 and op8 against plain Python: full license texts, phrase blocks, exact n-gram sets, plain EM; clashing columns."""

import collections
import math
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.llm import decontaminate, langid, licenses, quality

SF = os.environ.get("TOUCHLINE_SF", "/root/testdata/sf0.001")
FULL = [f"/usr/share/common-licenses/{n}" for n in ("Apache-2.0", "GPL-3", "MPL-2.0")]


def plain(text):
    return re.sub(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ", re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")).split()


def shingles(text, size=5):
    w = plain(text)
    return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if w else set()


def check_licenses(spark, texts, templates):
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").withColumns({"key": F.lit(1), "_row": F.lit(2), "template": F.lit(3)})
    wanted = [(n, size, s) for n, t in templates if (s := shingles(t, size := min(5, max(1, len(plain(t))))))]
    got = {r["doc_id"]: (r["licenses"], r["containment"]) for r in licenses.scan(docs, licenses.template_table(spark, templates)).collect()}
    for i, text in texts.items():
        have = {k: shingles(text, k) for k in range(1, 6)}
        share = [(len(have[size] & s) / len(s), n) for n, size, s in wanted]
        ok = [x for x in share if x[0] >= 0.8]
        assert got[i] == (sorted({n for _, n in ok}), max((x for x, _ in ok), default=0.0)), i
    return got


@pytest.mark.skipif(not all(map(os.path.isfile, FULL)), reason="no license texts")
def test_full_license_texts(spark):
    draw, templates = random.Random(0), [(os.path.basename(p), open(p, encoding="utf-8").read()) for p in FULL]
    assert all(len(plain(t)) > 1500 for _, t in templates)
    texts, speech = {-1: None, -2: ""}, [f"w{k}" for k in range(300)]
    for k, (_, t) in enumerate(templates):
        words = t.split()
        for j, share in enumerate((1.0, 0.95, 0.85, 0.7)):
            cut = words[: int(share * len(words))]
            texts[10 * k + j] = " ".join([*draw.choices(speech, k=50), *cut, *draw.choices(speech, k=50)])
        texts[10 * k + 5] = " ".join(w if draw.random() > 0.01 else "changed" for w in words)
    got = check_licenses(spark, texts, [*templates, templates[0], ("empty", ""), ("none", None)])
    assert sum(bool(g[0]) for g in got.values()) >= 9


def test_a_thousand_templates(spark):
    draw = random.Random(1)
    templates = [(f"L{k}", "This licence grants permission " + " ".join(f"v{draw.randrange(5000)}" for _ in range(20))) for k in range(1001)]
    texts = {k: f"x{k} y z " + templates[37 * k][1] + " end of text" for k in range(10)} | {99: "nothing of this licence grants permission here"}
    got = check_licenses(spark, texts, templates)
    assert all(got[k][0] == [f"L{37 * k}"] for k in range(10)) and got[99][0] == []


def test_short_templates(spark):
    draw = random.Random(5)
    templates = [("one", "Copyleft"), ("two", "MIT licensed"), ("three", "All rights reserved."), ("four", "SPDX-License-Identifier: MIT"), ("five", "Licensed under the MIT License"), ("again", "reserved reserved reserved reserved")]
    speech = ["all", "rights", "mit", "the", "licensed", "under", "license", "identifier", "spdx", "reserved", "word", "copyleft"]
    texts = {k: " ".join(draw.choices(speech, k=draw.randrange(1, 60))) for k in range(150)}
    for k, (_, t) in enumerate(templates):
        texts[1000 + k] = t
        texts[2000 + k] = f"// {t}"
        texts[3000 + k] = " ".join([*draw.choices(["w1", "w2"], k=40), t, *draw.choices(["w3", "w4"], k=40)])
        texts[4000 + k] = t.rpartition(" ")[0] + " but not"
    texts |= {-1: None, -2: "", -3: "ALL  RIGHTS\nRESERVED", -4: "overall rights reserved", -5: "all rights"}
    got = check_licenses(spark, texts, templates)
    assert got[-3][0] == ["three"] and got[-4][0] == got[-5][0] == [] and got[2003][0] == ["four"] and got[3002][0] == ["three"]


def test_phrases_of_items_in_few_bytes():
    rng = np.random.default_rng(0)
    words = rng.integers(0, 60_000, 200_000)
    items = [(str(k), " ".join(map(str, words[k * 200 : k * 200 + 200])).encode()) for k in range(1000)]
    made = decontaminate.PhraseSet(items)
    size = sum(v.nbytes for v in vars(made).values() if isinstance(v, np.ndarray))
    assert len(made.lengths) == 191_000 and size < 100 * 200_000


def test_phrases_know_their_items():
    items = [("a", b"one two three"), ("b", b"One, TWO three"), ("c", " ".join(f"w{k}" for k in range(12)).encode()), ("d", b"  ..."), ("e", b"w0 w1")]
    made = decontaminate.PhraseSet(items)
    owners = [tuple(made.items[i] for i in made.owners[a:b]) for a, b in zip(made.owner_first[:-1], made.owner_first[1:], strict=True)]
    assert sorted(zip(owners, made.lengths.tolist(), strict=True)) == [(("a", "b"), 3), (("c",), 10), (("c",), 10), (("c",), 10), (("e",), 2)]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_decontamination_carries_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b c d e", "x"), (2, "q r s", "y")], "doc_id bigint, text string, _hit string").withColumn("n_hit", F.lit(9))
    out = decontaminate.without_contaminated(docs, spark.createDataFrame([(7, "B, c D")], "item_id bigint, text string"))
    assert [tuple(r) for r in out.collect()] == [(2, "q r s", "y", 9)]


def grams(text):
    raw = (text or "").encode().lower().translate(bytes.maketrans(b"\t\n\x0b\x0c\r", b"     "))
    return [raw[k : k + n] for n in langid.ORDERS for k in range(len(raw) - n + 1)]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_languages_equal_exact_sets(spark):
    """The docstring's rules with sets in place of the filter: the same languages, for all but a few texts."""
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()
    counts, many = collections.defaultdict(collections.Counter), collections.Counter()
    for r in rows:
        if zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2 and r["lang"] is not None:
            counts[r["lang"]].update(grams(r["text"]))
            many[r["lang"]] += 1
    share = {lang: {g: c / sum(n.values()) for g, c in n.items()} for lang, n in counts.items()}
    top = collections.Counter()
    for s in share.values():
        for g, x in s.items():
            top[g] = max(top[g], x)
    sets = {}
    for lang, n in counts.items():
        own = {g: c for g, c in n.items() if c > 1 and share[lang][g] >= langid.OWN * top[g]}
        steps = collections.Counter(own.values())
        total = least = 0
        for c in sorted(steps, reverse=True):
            total += steps[c]
            if total > langid.PROFILE:
                least = c
                break
        sets[lang] = {g for g, c in own.items() if c > least}
    names = sorted(many, key=lambda x: (-many[x], x))
    got, same = {r["doc_id"]: r["lang_pred"] for r in langid.query(spark, SF).collect()}, 0
    for r in rows:
        found = [sum(g in sets[lang] for g in grams(r["text"])) for lang in names]
        want = names[found.index(max(found))] if any(map(str.isalpha, r["text"] or "")) else "und"
        same += got[r["doc_id"]] == want
    assert same >= 0.99 * len(rows)


def test_language_edges(spark):
    rows = [(None, f"the house and the garden number {k}", "en") for k in range(30)] + [(k, f"das Haus und der Garten Nummer {k}", "de") for k in range(20)] + [(90, "xyz qqq", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumns({"score": F.lit("x"), "gram": F.lit(1), "held_out": F.lit(True)})
    model = langid.fit(docs)
    got = langid.predict(docs, model).collect()
    assert model.langs == ["en", "de"] and len(got) == 51 and all(r["lang_pred"] == "en" for r in got if r["doc_id"] is None)
    tie = langid.predict(spark.createDataFrame([(1, "ЖЖЖЖ")], "doc_id bigint, text string").withColumn("held_out", F.lit(False)), model).first()
    assert (tie["lang_pred"], tie["score"]) == ("en", 0.0)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_verdicts_equal_plain_em(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = quality.features(docs).withColumns({f"vote_{k}": rule().cast("int") for k, rule in quality.RULES.items()}).collect()
    votes = np.array([[r[c] for c in quality.RULES_COLUMNS] for r in rows]) + 1
    good, bad = (np.array([quality.START[c]] * votes.shape[1]) for c in (True, False))
    prior, pull = 0.85, quality.PULL * len(rows) + 1
    at = np.arange(votes.shape[1])

    def posteriors():
        z = np.full(len(rows), math.log(prior / (1 - prior)))
        for k in at:
            w = np.log(good[k] / bad[k])
            w[0], w[1], w[2] = min(w[0], 0), 0, max(w[2], 0)
            z += w[votes[:, k]]
        return 1 / (1 + np.exp(-z))

    for _ in range(40):
        p = posteriors()
        one, two = good * 0, bad * 0
        for k in at:
            for v in range(3):
                one[k, v] = p[votes[:, k] == v].sum() + pull * quality.START[True][v]
                two[k, v] = (1 - p)[votes[:, k] == v].sum() + pull * quality.START[False][v]
        prior = min(quality.MOST_GOOD, max(quality.LEAST_GOOD, p.mean()))
        one[:, 0] = np.minimum(one[:, 0], quality.NOISE * one.sum(axis=1))
        good, bad = one / one.sum(axis=1, keepdims=True), two / two.sum(axis=1, keepdims=True)
    want = {r["doc_id"]: bool(q >= 0.5) and not (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]) for r, q in zip(rows, posteriors(), strict=True)}
    assert {r["doc_id"]: r["kept"] for r in quality.query(spark, SF).collect()} == want


def test_quality_carries_scratch_names(spark):
    docs = spark.createDataFrame([(1, "a b c", "x", "y")], "doc_id bigint, text string, _t string, _words string")
    assert quality.judge(docs).select("_t", "_words").first() == ("x", "y")
