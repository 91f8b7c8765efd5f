"""Every operator's query on the smallest tables against plain Python or SQL."""

import collections
import hashlib
import math
import os
import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash

import corpus_pipeline
from touchline.llm import decontaminate, langid, licenses, lm, mixing, pii, quality, simhash, tokens, urls

SF = os.environ.get("TOUCHLINE_SF", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


@pytest.mark.parametrize("head, segment, most", [(1 << 19, 2_000_000, 128 << 20), (500, 5_000, 40_000)])
def test_language_model(spark, texts, monkeypatch, head, segment, most):
    monkeypatch.setattr(lm, "HEAD", head)
    monkeypatch.setattr(lm, "SEGMENT", segment)
    monkeypatch.setattr(lm, "BROADCAST_BYTES", most)
    token = {i: [*words(lower(t)), None] for i, t in texts.items()}
    count = collections.Counter(w for i, t in token.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in t)
    n, v = sum(count.values()), len(count)
    got = by_id(lm.query(spark, SF))
    assert got.keys() == texts.keys()
    for i, r in got.items():
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(token[i]), sum(count[w] > 0 for w in token[i]), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in token[i]))
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 7 == 2)
    out = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_filter_gives_counts_back():
    rng = np.random.default_rng(0)
    grams = np.unique(rng.integers(0, 2**63, 20_000).astype(np.uint64))
    counts = np.minimum(rng.zipf(1.6, len(grams)), 10_000)
    n_bits, packed = lm.segment(grams, counts)
    group = lm.Filter(lm.pa.table({"r": [0], "n_bits": [n_bits], "n_grams": [len(grams)], "bits": [packed]}), 0, 1, 1)
    level = group.levels(grams, np.zeros(len(grams), np.int64))
    assert (level >= lm._levels(counts)).all() and (level == lm._levels(counts)).mean() > 0.97
    other = rng.integers(0, 2**63, 20_000).astype(np.uint64)
    assert (group.levels(other, np.zeros(len(other), np.int64)) > 0).mean() < 0.02


def test_mixing(spark, texts):
    got, source = by_id(mixing.query(spark, SF)), {r["doc_id"]: r["source"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {i: r["size"] for i, r in got.items()} == {i: len(words(t)) for i, t in texts.items()}
    size, took = collections.Counter(), collections.Counter()
    for i, r in got.items():
        size[source[i]] += r["size"]
        took[source[i]] += r["taken"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    names = sorted(size, key=lambda s: (s is None, s))
    weight, left = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}, set(names)
    target = {}
    while True:
        level = (1.5 * sum(size.values()) - sum(target.values())) / sum(weight[s] for s in left)
        full = {s for s in left if level * weight[s] > 2 * size[s]}
        if not full:
            break
        target |= {s: 2.0 * size[s] for s in full}
        left -= full
    target |= {s: level * weight[s] for s in left}
    for i, r in got.items():
        assert r["target"] == pytest.approx(target[source[i]]) and r["source_size"] == size[source[i]]
    assert all(abs(took[s] - target[s]) <= 1 for s in names)


def test_simhash(spark, texts):
    prints = {}
    for i, t in texts.items():
        w = words(lower(t))
        shingles = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
        ones = [0] * 64
        for s in shingles:
            h = xxhash.xxh64_intdigest(s.encode(), 42)
            for b in range(64):
                ones[b] += h >> b & 1
        prints[i] = sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))
    check_components(prints, by_id(simhash.query(spark, SF)))


def check_components(prints, got):
    ids = sorted(prints)
    label = {i: i for i in ids}
    moved = True
    while moved:
        moved = False
        for a in ids:
            for b in ids:
                if a < b and label[a] != label[b] and (prints[a] ^ prints[b]).bit_count() <= 2:
                    label[a] = label[b] = min(label[a], label[b])
                    moved = True
    assert {i: (r["fingerprint"], r["component_id"]) for i, r in got.items()} == {i: (f"{prints[i]:016x}", label[i]) for i in ids}


@pytest.mark.parametrize("dense", [1, 64])
def test_dense_keys_lose_no_link(spark, monkeypatch, dense):
    monkeypatch.setattr(simhash, "DENSE", dense)
    rng = np.random.default_rng(0)
    prints = []
    for v in rng.integers(0, 2**62, 4).tolist():
        for _ in range(60):
            for _ in range(int(rng.integers(1, 4))):
                v ^= 1 << int(rng.integers(64))
            prints.append(simhash._signed(v))
    prints = sorted(set(prints))
    found = {r["node"]: r["label"] for r in simhash.components(simhash.links(spark.createDataFrame([(p,) for p in prints], "fp bigint"))).collect()}
    label = {p: p for p in prints}
    moved = True
    while moved:
        moved = False
        for a in prints:
            for b in prints:
                if label[a] != label[b] and ((a ^ b) & (2**64 - 1)).bit_count() <= 2:
                    label[a] = label[b] = min(label[a], label[b])
                    moved = True
    assert {p: found.get(p, p) for p in prints} == label


def test_licenses(spark, texts):
    def plain(t):
        return re.sub(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ", lower(t)).split()

    def shingles(w, size):
        return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if w else set()

    for i, r in by_id(licenses.query(spark, SF)).items():
        have = {k: shingles(plain(texts[i]), k) for k in range(1, 6)}
        want = {n for n, t in licenses.TEMPLATES if (k := min(5, len(plain(t)))) and len(have[k] & shingles(plain(t), k)) >= 0.8 * len(shingles(plain(t), k))}
        assert r["licenses"] == ",".join(sorted(want))


@pytest.mark.parametrize("most", [2_000_000, 100])
def test_decontamination(spark, texts, monkeypatch, most):
    monkeypatch.setattr(decontaminate, "ITEM_WORDS", most)
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    want = decontaminate.brute_force(list(texts.items()), items)
    got = by_id(decontaminate.query(spark, SF))
    assert {i: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) for i, r in got.items()} == want
    assert sum(r["contaminated"] for r in got.values()) == sum(w[1] > 0 for w in want.values())


def test_index_finds_every_occurrence():
    rng = np.random.default_rng(0)
    for _ in range(20):
        seq = rng.integers(1, 5, int(rng.integers(1, 300)))
        index = decontaminate.FMIndex(seq, 5, sample=4)
        phrases = rng.integers(1, 5, (30, 4))
        lengths = rng.integers(1, 5, 30)
        low, high = index.search(phrases, lengths)
        for p, n, a, b in zip(phrases, lengths, low, high, strict=True):
            want = [k for k in range(len(seq) - n + 1) if (seq[k : k + n] == p[:n]).all()]
            assert sorted(index.locate(np.arange(a, b))) == want


def test_languages(spark):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = by_id(langid.query(spark, SF))
    out = [i for i, r in got.items() if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    assert sum(got[i]["lang_pred"] == truth[i] for i in out) >= 0.95 * len(out)


def test_urls(spark):
    db = duckdb.connect()
    db.sql(f"create view pages as select * from read_parquet('{SF}/pages.parquet')")
    want = sorted(map(tuple, db.sql(f"select page_id, host, path, rule, verdict from ({urls.ORACLE})").fetchall()), key=str)
    assert sorted(map(tuple, urls.query(spark, SF).select("page_id", "host", "path", "rule", "verdict").collect()), key=str) == want


def test_quality(spark, texts):
    got = by_id(quality.query(spark, SF))
    for i, t in texts.items():
        w = words(t)
        runs = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        again = {k + j for k in range(len(w) - 4) if runs[tuple(w[k : k + 5])] > 1 for j in range(5)}
        lines = [x for x in t.split("\n") if words(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again))
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (len(w) < 10 or 100 * len(again) > 20 * len(w)) and not (r["base_failed"] and r["kept"])
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    right = [got[i]["kept"] == bool(q) for i, q in labels.items() if not got[i]["base_failed"]]
    assert sum(right) >= 0.95 * len(right)


def test_rules_learn_who_is_right():
    patterns = [((1, 0, 1), 800), ((0, 0, 1), 60), ((1, -1, 1), 70), ((1, 0, -1), 70)]
    prior, table = quality.fit_votes(patterns)
    assert quality.posterior((1, 0, 1), prior, table) > 0.5 > quality.posterior((1, -1, 1), prior, table)


def pattern_spans(text):
    pats = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    for kind, pattern in pats.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or kind == "card" and 16 <= len(digits) <= 19 and pii.luhn(digits) or kind == "phone" and 8 <= len(digits) <= 15
            if ok:
                yield kind, m.start(), m.end()


def test_personal_data(spark, texts):
    for i, r in by_id(pii.query(spark, SF)).items():
        base = ",".join("%s:%d:%d" % s for s in pattern_spans(texts[i]))
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest() and r["spans"].startswith(base)


def test_patterns_on_noise():
    rng = np.random.default_rng(0)
    for _ in range(20_000):
        text = "".join(rng.choice(list("ab1@..-+ 2(45.é9_\n"), int(rng.integers(1, 30))))
        assert list(pattern_spans(text)) == pii.base_spans(text)


def test_disclosing_terms(spark):
    rows = [(k, f"common words here number{k} agent zorblax writes from zed@spy.example.org today") for k in range(4)]
    rows += [(10 + k, f"common words here again and today other{k} text writes") for k in range(30)]
    got = by_id(pii.sanitise(spark.createDataFrame(rows, "doc_id bigint, text string")))
    assert got[0]["sanitised"] == "common words here number0 <term> <term> writes <term> <email> today"
    assert all(got[10 + k]["spans"] == "" for k in range(30))


def test_token_files(spark, texts):
    from tokenizers import Tokenizer

    tokenizer, at = Tokenizer.from_file(tokens.tokenizer_path()), 0
    got = by_id(tokens.query(spark, SF))
    for i in sorted(texts):
        ids = np.array([*tokenizer.encode(texts[i], add_special_tokens=False).ids, 2], dtype="<u4")
        assert tuple(got[i])[1:] == (at, len(ids), zlib.crc32(ids))
        at += len(ids)


def test_grammar_round_trip():
    rng = np.random.default_rng(0)
    ids = np.concatenate([np.tile(rng.integers(3, 50, 30), 200), rng.integers(3, 60, 5000)]).astype(np.uint32)
    ids[::97] = 2
    symbols, rules, size = tokens.compress(ids, 100)
    assert len(symbols) < len(ids) and (tokens.expand(symbols, rules, 100) == ids).all() and len(rules)
    assert not (rules[:, 0] == 2).any()
    kind = tokens._kind(100)
    row = {"base": 100, "symbols": symbols.astype(kind).tobytes(), "rules": rules.astype(kind).tobytes(), "expansions": size.astype("<i8").tobytes()}
    for a, b in ((0, 1), (5, 900), (4000, 4001), (len(ids) - 3, len(ids))):
        assert (tokens.decode_range(row, a, b) == ids[a:b]).all()


def test_words_of_special_tokens():
    encoder = tokens.WordEncoder(tokens.tokenizer_path())
    for text in ("a <|endoftext|> b", "A <|EndOfText|>. x", "it's we'll, don't. o'clock", "é́ é. 東京, ²½. 1,2. a.b. ..,", " x y", "\x1c a\x1db"):
        ids, _ = encoder.encode(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]))
        assert ids.tolist() == [*encoder.tokenizer.encode(text, add_special_tokens=False).ids, 2]


def test_pipeline(spark, texts):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).cache()
        kept[name] = [tuple(r) for r in docs.collect()]
    good = {r["doc_id"] for r in quality.query(spark, SF).filter("kept").collect()}
    assert {r[0] for r in kept["quality_rules"]} == good
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := words(lower(texts[i]))) else set() for i in good}
    near = lambda i, j: sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])
    ids = {r[0] for r in kept["near_duplicates"]}
    assert all(any(near(i, j) for j in good - {i}) for i in good - ids)
    assert not any(near(i, j) for i in ids for j in ids if i < j)
    want = decontaminate.brute_force([(i, texts[i]) for i in ids], [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()])
    assert {r[0] for r in kept["decontamination"]} == {i for i in ids if not want[i][1]}
    mixed = collections.Counter()
    for doc, text, _, source, _ in kept["source_mix"]:
        mixed[doc] += len(words(text))
    assert all(n <= 2 * len(words(texts[i])) for i, n in mixed.items())
    assert sum(mixed.values()) == pytest.approx(1.5 * sum(len(words(r[1])) for r in kept["decontamination"]), abs=30)
    assert len(kept["token_files"]) == len(kept["source_mix"])
