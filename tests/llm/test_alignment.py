"""op13 against whole-text tokenizing and plain loops."""

import collections
import hashlib

import pytest
import tokenizers
from pyspark.sql import functions as F

from touchline.llm import alignment

public_tokenizers = pytest.importorskip("public_tokenizers")

TEXTS = [
    None, "", " ", "  two  blanks ", "plain words here", "Ünïcode élan, straße", "line\nbreak\n\n and\ttab", "no-break space  em 　wide", "<|endoftext|> as text <s> </s> <unk>",
    "nul \x00 and \x7f", "日本語 テキスト 🙂 emoji", "it's we'll they'd", "a" * 3000, "word " * 2000, "ends in space ", "\n", "x \x1c y \x85 z", "é combining", "﻿bom", "▁ piece mark ▁▁", "12345 67 8,9.0", "repeat this", "repeat this",
]


class ByFile(alignment.ByteLevel):
    """The first side by the tokenizers library."""

    def __init__(self, path):
        super().__init__(path)
        tokenizer = tokenizers.Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        self.faithful = lambda ids, text: b"".join(self.token[i] for i in ids) == text
        self.encode = lambda texts: [tokenizer.encode(f" {t}", add_special_tokens=False).ids for t in texts]


def plain(texts):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, digest) of every text, both tokenizers on whole texts."""
    one, two = ByFile(public_tokenizers.path(alignment.BYTE_LEVEL)), alignment.Pieces(public_tokenizers.path(alignment.PIECES))
    made, count = [], collections.Counter()
    for text in texts:
        full = b" " + (text or "").encode()
        a, b = (side.encode([text])[0] if text else [] for side in (one, two))
        if not text or not one.faithful(a, full) or not two.faithful(b, full):
            made.append(([], [], [], ""))
            continue
        spans = []
        for side, ids in ((one, a), (two, b)):
            ends = [sum(len(side.token[i]) for i in ids[: k + 1]) for k in range(len(ids))] if len(ids) < 500 else _ends(side, ids)
            spans.append(list(zip([0, *ends[:-1]], ends, ids, strict=True)))
        links = [(x, y) for s, e, x in spans[0] for t, u, y in spans[1] if s < u and t < e] if len(a) < 500 else _merge(spans)
        shared = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups, low = [], 0
        for high in shared:
            groups.append("|".join(",".join(str(i) for s, e, i in side if low < e <= high) for side in spans) if len(shared) < 500 else None)
            low = high
        if None in groups:
            groups = _groups(spans, shared)
        count.update(links)
        made.append((a, b, links, ";".join(groups)))
    best = collections.Counter()
    for (_, y), n in count.items():
        best[y] = max(best[y], n)
    return [(len(a), len(b), text.count(";") + bool(text), len(links), sum(count[p] == best[p[1]] for p in links), sum(count[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if text else "") for a, b, links, text in made]


def _ends(side, ids):
    out, at = [], 0
    for i in ids:
        at += len(side.token[i])
        out.append(at)
    return out


def _merge(spans):
    i = j = 0
    out = []
    while i < len(spans[0]) and j < len(spans[1]):
        out.append((spans[0][i][2], spans[1][j][2]))
        x, y = spans[0][i][1], spans[1][j][1]
        i, j = i + (x <= y), j + (y <= x)
    return out


def _groups(spans, shared):
    out, at = [], [0, 0]
    for high in shared:
        part = []
        for k, side in enumerate(spans):
            start = at[k]
            while at[k] < len(side) and side[at[k]][1] <= high:
                at[k] += 1
            part.append(",".join(str(x[2]) for x in side[start : at[k]]))
        out.append("|".join(part))
    return out


PATHS = public_tokenizers.path(alignment.BYTE_LEVEL), public_tokenizers.path(alignment.PIECES)
COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("hot", [alignment.HOT, 20])
def test_equals_plain_loops(spark, monkeypatch, hot):
    monkeypatch.setattr(alignment, "HOT", hot)  # few hot pairs: the others take the shuffle
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string").withColumn("links", F.lit(1)).withColumn("pair", F.lit("x"))
    found = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in alignment.align(docs).collect()}
    assert [found[k] for k in range(len(TEXTS))] == plain(TEXTS)


def test_small_memo_and_blocks_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(alignment, "_ALIGNERS", {})
    docs = spark.createDataFrame(list(enumerate(TEXTS * 3)), "doc_id int, text string")
    size = 32_000
    want = sorted(tuple(r) for r in alignment.aligned(alignment.tokenized(docs, *PATHS), size).collect())
    monkeypatch.setattr(alignment, "MEMO", 3)
    monkeypatch.setattr(alignment, "BLOCK", 10)
    monkeypatch.setattr(alignment, "STEP", 10)
    assert sorted(tuple(r) for r in alignment.aligned(alignment.tokenized(docs, *PATHS), size).collect()) == want


@pytest.mark.parametrize("hot", [alignment.HOT, 20])
def test_small_blocks_give_the_same_sums(spark, monkeypatch, hot):
    monkeypatch.setattr(alignment, "HOT", hot)
    for name in ("STEP", "BLOCK"):
        monkeypatch.setattr(alignment, name, 10)
    docs = spark.createDataFrame(list(enumerate(TEXTS * 2)), "doc_id int, text string").repartition(3)
    found = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in alignment.align(docs).collect()}
    assert [found[k] for k in range(2 * len(TEXTS))] == plain(TEXTS * 2)


def test_empty_table(spark):
    assert alignment.align(spark.createDataFrame([], "doc_id long, text string")).collect() == []
