"""Token files keep the order of the mixture: ids in the files against the slots."""

import random
import shutil

from pyspark.sql import functions as F

from touchline.llm import mixing, tokens
from touchline.llm.common import store


def test_ids_stand_in_the_order_of_the_slots(spark):
    draw = random.Random(5)
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(draw.randrange(1, 40))), draw.choice("aaabc"), None) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, n_chars bigint").repartition(3)
    mixed = mixing.mixed_documents(docs)
    want = [r["doc_id"] for r in mixed.collect()]
    read = tokens.encode_documents(store(mixed, "mixed"), keep_order=True).orderBy("start").collect()
    assert [r["doc_id"] for r in read] == want and len(want) > 200
    slots = {r["doc_id"]: r["first_slot"] for r in mixing.mixed_sizes(docs).collect()}
    first = list(dict.fromkeys(r["doc_id"] for r in read))
    assert [slots[d] for d in first] == sorted(slots[d] for d in first) and first != sorted(first)
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(read, read[1:], strict=False))


def test_part_files_of_more_digits_come_later(spark, tmp_path):
    for k, number in enumerate(("00002", "99999", "100000", "100001")):
        spark.createDataFrame([(10 - k, f"text {k}"), (20 - k, "more")], "doc_id bigint, text string").coalesce(1).write.parquet(str(tmp_path / f"one{k}"))
        (tmp_path / "all").mkdir(exist_ok=True)
        shutil.copy(next((tmp_path / f"one{k}").glob("*.parquet")), tmp_path / "all" / f"part-{number}-x.parquet")
    read = tokens.encode_documents(spark.read.parquet(str(tmp_path / "all")), keep_order=True)
    assert [r["doc_id"] for r in read.orderBy("start").collect()] == [10, 20, 9, 19, 8, 18, 7, 17]
    by_id = tokens.encode_documents(spark.read.parquet(str(tmp_path / "all")).filter(F.col("doc_id") > 0))
    assert [r["doc_id"] for r in by_id.orderBy("start").collect()] == [7, 8, 9, 10, 17, 18, 19, 20]
