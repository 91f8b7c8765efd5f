"""Personal data: patterns, and terms that give the matched entities away.

Patterns find e-mail addresses, IP and card numbers, phone numbers and secrets (keys, passwords).
Each distinct value is a protected entity. From corpus co-occurrence, a term t discloses an entity e by

    PMI(e; t) / IC(e) = log(p(e | t) / p(e)) / log(1 / p(e)),  p(e) = df(e) / N,
    p(e | t) = (df(e, t) + p(e)) / (df(t) + 1),

which nears 1 when t never occurs without e. p(e | t) is smoothed by one document at e's background
rate, so the fewer documents hold t, the less they prove. In documents that hold e, terms at
DISCLOSURE or above are spans too, to be generalised like the entity itself.

All entities take part, and all documents count towards N and every df; copies of a text are paired
once with their number.

Defined results: NULL and empty texts have no spans; NULL ids are carried along; runs of digits may
have any length; repeated rows are judged one by one; a term exactly at the threshold is a span; an
empty table gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm.common import documents, store
from touchline.llm.kernels import Words, arrow_rows, arrow_schema, doc_blocks, mix64, table, word_hash

KINDS = ("email", "ip", "card", "phone")
#: Secrets: public forms of keys (fixed values), and values of at least eight characters with a digit that are set to a telling name.
SECRET_MARKS = ("AKIA", "ASIA", "ghp_", "gho_", "ghs_", "xoxb-", "xoxp-", "AIza", "sk_live_", "-----BEGIN")
SECRET_NAMES = ("password", "passwd", "secret", "api_key", "api-key", "apikey", "access_token", "auth_token")
DISCLOSURE = 0.9
MERGE = 3_000_000

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
# a run of digits is taken from its start: a match that began inside it would have begun there
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_KEY = re.compile(r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pos]_[A-Za-z0-9]{36}|xox[bp]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35}|sk_live_[A-Za-z0-9]{16,})(?![A-Za-z0-9])|-----BEGIN [A-Z ]*PRIVATE KEY-----")
_VALUE = re.compile("(?:" + "|".join(SECRET_NAMES) + r")[\x22']?[\x20]?[=:][\x20]?[\x22']?(?=[^\s\x22']{0,200}[0-9])([^\s\x22',;]{8,})", re.IGNORECASE)


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start; code points."""
    found = []
    end = free = 0
    for m in _DOMAIN.finditer(text) if "@" in text else ():
        # what stands before this @, back to the last one or the end of the last match
        before = text[free : m.start()]
        size = len(before) - len(before.rstrip(_LOCAL))
        free = m.start() + 1
        if size:
            found.append(("email", m.start() - size, m.end()))
            end = free = m.end()
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in (part.lstrip("0") for part in m[0].split("."))):
            found.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            found.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 8 <= len(_digits(m[0])) <= 15:
            found.append(("phone", m.start(), m.end()))
    return found


def secret_spans(text: str) -> list[tuple[str, int, int]]:
    """("secret", start, end) of keys and of values set to a telling name, by start; none overlap."""
    found = [m.span() for m in _KEY.finditer(text)] if any(m in text for m in SECRET_MARKS) else []
    small = text.lower()
    if any(n in small for n in SECRET_NAMES):
        found += [m.span(1) for m in _VALUE.finditer(text)]
    out: list[tuple[str, int, int]] = []
    for a, b in sorted(found):
        if not out or a >= out[-1][2]:
            out.append(("secret", a, b))
    return out


def _entity(kind: str, value: str) -> int:
    value = value.lower() if kind == "email" else _digits(value) if kind in ("card", "phone") else value
    return int(np.array([word_hash(f"{kind}:{value}".encode())], np.uint64).view(np.int64)[0])


def _join(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _terms(text: str, spans: list[tuple[str, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of the words outside the spans; code points."""
    low, word = table("alnum")
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    words = Words(data, np.array([0, len(data)]), low, word)
    point = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    starts, ends = point[words.starts], point[words.ends]
    free = np.ones(len(starts), dtype=bool)
    for _, a, b in spans:
        free &= (ends <= a) | (starts >= b)
    return words.hashes[free].view(np.int64), starts[free], ends[free]


FOUND = "doc_id bigint, row bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, n_secret bigint, base string, found string, text string, text_hash bigint, entities array<bigint>, terms array<bigint>"


def find_entities(docs: DataFrame) -> DataFrame:
    """FOUND for every row of docs (doc_id, text); text, entities and terms only where there are base spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, row = arrow_schema(FOUND), TaskContext.get().partitionId() << 33
        for part, data, offsets in doc_blocks(batches):
            raw, n = data.tobytes(), len(offsets) - 1
            # only texts with a digit, an @ or a dash (key headers) can match
            mark = np.concatenate([[0], np.cumsum(((data >= 48) & (data <= 57)) | (data == 64) | (data == 45))])
            hopeful = np.flatnonzero(mark[offsets[1:]] > mark[offsets[:-1]]).tolist()
            spans: dict[int, list] = {}
            cells: dict[str, list] = {c: [None] * n for c in ("text", "text_hash", "entities", "terms")}
            for i in hopeful:
                text = raw[offsets[i] : offsets[i + 1]].decode()
                if found := base_spans(text) + secret_spans(text):
                    spans[i] = found
                    hashes = np.unique(_terms(text, found)[0])
                    cells["text"][i], cells["terms"][i] = text, hashes
                    cells["text_hash"][i] = int(np.frombuffer(hashlib.blake2b(text.encode(), digest_size=8).digest(), np.int64)[0])
                    cells["entities"][i] = sorted({_entity(k, text[a:b]) for k, a, b in found})
            counts = [[sum(s[0] == kind for s in spans.get(i, ())) for i in range(n)] for kind in (*KINDS, "secret")]
            base = [_join([s for s in spans.get(i, ()) if s[0] in KINDS]) for i in range(n)]
            yield arrow_rows(schema, part.column(0), row + np.arange(n), *counts, base, [_join(spans.get(i, ())) for i in range(n)], *cells.values())
            row += n

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, FOUND)


def document_frequencies(docs: DataFrame) -> DataFrame:
    """t (hash of a word), df over all rows of docs."""
    out = "t bigint, df bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, (low, word), held = arrow_schema(out), table("alnum"), []

        def merged() -> pa.RecordBatch:
            ordered = np.sort(np.concatenate(held)) if held else np.zeros(0, np.uint64)
            edge = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)
            return arrow_rows(schema, ordered[edge].view(np.int64), np.diff(np.append(edge, len(ordered))))

        for _, data, offsets in doc_blocks(batches):
            words = Words(data, offsets, low, word)
            # once for each text: the first of equal (text, word) marks
            doc = np.repeat(np.arange(len(offsets) - 1, dtype=np.uint64), np.diff(words.first))
            _, once = np.unique(mix64(words.hashes ^ (doc * np.uint64(0x9E3779B97F4A7C15))), return_index=True)
            held.append(words.hashes[once])
            if sum(map(len, held)) > MERGE:
                yield merged()
                held.clear()
        yield merged()

    return docs.select("text").mapInArrow(run, out).groupBy("t").agg(F.sum("df").alias("df"))


def disclosures(found: DataFrame, docs: DataFrame) -> DataFrame:
    """row, terms: the words of each row of found that disclose one of its entities.

    Entities of the same texts have all counts in common and are judged as one class. As df(e, t)
    is at most df(e), a term that is in more than (df(e) + p(e)) / p(e) ** (1 - DISCLOSURE) - 1
    documents can't disclose e: it is left out before terms meet classes, and nothing is lost.
    """
    held = found.filter(F.col("entities").isNotNull())
    texts = store(held.groupBy("text_hash").agg(F.first("entities").alias("entities"), F.first("terms").alias("terms"), F.count("*").alias("copies")), "texts")
    each = texts.select("text_hash", "copies", F.explode("entities").alias("e"))
    same = F.xxhash64(F.count("*"), F.bit_xor(F.xxhash64("text_hash")), F.bit_xor(F.xxhash64("text_hash", F.lit(1))))
    entities = each.groupBy("e").agg(same.alias("class"), F.sum("copies").alias("df_e"))
    classes = store(each.join(entities, "e").select("text_hash", "class", "copies", "df_e").distinct(), "classes")
    n = float(max(found.count(), 2))
    rate = F.col("df_e") / n
    most = (F.col("df_e") + rate) / F.pow(rate, F.lit(1 - DISCLOSURE)) - 1 + 1e-6
    widest = classes.filter(rate < 1).agg(F.max(most)).first()[0] or 0.0
    rare = document_frequencies(docs).filter(F.col("df") <= widest)
    words = texts.select("text_hash", F.explode("terms").alias("t")).join(rare, "t")
    met = store(words.join(classes, "text_hash").filter((rate < 1) & (F.col("df") <= most)).select("text_hash", "class", "t", "copies", "df_e", "df"), "met")
    pairs = met.groupBy("class", "t").agg(F.first("df_e").alias("df_e"), F.first("df").alias("df"), F.sum("copies").alias("df_et"))
    pmi = F.log2((F.col("df_et") + rate) / (F.col("df") + 1) / rate)
    telling = pairs.filter(pmi >= DISCLOSURE * F.log2(1 / rate)).select("class", "t")
    mine = met.join(telling, ["class", "t"], "left_semi").groupBy("text_hash").agg(F.collect_set("t").alias("telling"))
    return held.select("row", "text_hash").join(mine, "text_hash").select("row", "telling")


SPANS = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, n_secret bigint, base string, spans string, sanitised string"


def sanitise(docs: DataFrame, text: str = "text") -> DataFrame:
    """SPANS for every row of docs; sanitised: the text with every span put as its kind, NULL where there is none."""
    rows = docs.select("doc_id", F.col(text).alias("text"))
    found = store(find_entities(rows), "entities")
    every = found.drop("entities", "terms", "text_hash").join(disclosures(found, rows), "row", "left").drop("row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(SPANS)
        for batch in batches:
            at = batch.schema.names
            known, texts, telling = (batch.column(at.index(c)).to_pylist() for c in ("found", "text", "telling"))
            spans, clean = [], []
            for b, t, terms in zip(known, texts, telling, strict=True):
                mine = [(k, int(x), int(y)) for k, x, y in (s.split(":") for s in b.split(","))] if b else []
                if terms:
                    hashes, starts, ends = _terms(t, mine)
                    use = np.isin(hashes, np.array(terms, np.int64))
                    mine += [("term", x, y) for x, y in zip(starts[use].tolist(), ends[use].tolist(), strict=True)]
                spans.append(_join(mine))
                clean.append(mask(t, mine) if mine else None)
            yield arrow_rows(schema, *(batch.column(at.index(c)) for c in ("doc_id", "n_email", "n_ip", "n_card", "n_phone", "n_secret", "base")), spans, clean)

    return every.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "n_secret", "base", "found", "text", "telling").mapInArrow(run, SPANS)


def mask(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span generalised to its kind; of overlapping ones the first stands for all."""
    out, done = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= done:
            out += [text[done:a], f"<{kind}>"]
        done = max(done, b)
    return "".join([*out, text[done:]])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: the spans of personal data in every document."""
    made = sanitise(documents(spark, sf_dir).select("doc_id", "text"))
    return made.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans", "n_secret")
