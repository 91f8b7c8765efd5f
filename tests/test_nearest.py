"""The nearest histograms in blocks against plain loops: ties, missing bins, rows without a histogram."""

import random
from decimal import ROUND_HALF_UP, Decimal

from touchline.operators import datasets


def plain(queries, gallery, k):
    out = []
    for query, q in queries:
        met = []
        for vec, v in gallery:
            if vec == query:
                continue
            total = None if q is None or v is None else 0.0
            for i in range(max(len(q or ()), len(v or ()))) if total is not None else ():
                both = [abs(x[i]) for x in (q, v) if i < len(x) and x[i] is not None]
                total = None if total is None or not both else total + min(both)
            met.append((None if total is None else float(Decimal(repr(total)).quantize(Decimal("1e-6"), ROUND_HALF_UP)), vec))
        met.sort(key=lambda m: (m[0] is None, -(m[0] or 0.0), m[1]))
        out += [(query, vec, s, i + 1) for i, (s, vec) in enumerate(met[:k])]
    return sorted(out)


def found(spark, queries, gallery, k):
    q = spark.createDataFrame(queries, "query_id long, q array<double>")
    g = spark.createDataFrame(gallery, "vec_id long, v array<double>")
    return sorted(tuple(r) for r in datasets.nearest_histograms(q, g, k, 3).select("query_id", "vec_id", "similarity", "rank").collect())


def test_blocks_equal_plain_loops(spark, monkeypatch):
    rng = random.Random(5)
    gallery = [(i, [rng.choice((0.0, 0.5, 0.1250005, -0.25, None if i % 9 == 4 else 0.25)) for _ in range(rng.choice((3, 4)))]) for i in range(60)]
    gallery += [(60, None), (61, [])]
    queries = [r for r in gallery if r[0] % 10 == 0]
    want = plain(queries, gallery, 4)
    assert found(spark, queries, gallery, 4) == want
    monkeypatch.setattr(datasets, "GALLERY_ROWS", 5)
    monkeypatch.setattr(datasets, "QUERY_ROWS", 2)
    assert found(spark, queries, gallery, 4) == want
    assert found(spark, queries[:1], gallery[:2], 4) == plain(queries[:1], gallery[:2], 4)
    assert found(spark, [], gallery, 4) == []


def test_copies_tie_by_id(spark):
    gallery = [(i, [0.1, 0.2, 0.3]) for i in range(50)]
    assert [r[1] for r in found(spark, gallery[7:8], gallery, 3)] == [0, 1, 2]


def test_pairs_meet_in_arrow_blocks(spark):
    q, g = spark.createDataFrame([(0, [1.0])], "query_id long, q array<double>"), spark.createDataFrame([(1, [1.0])], "vec_id long, v array<double>")
    plan = datasets.nearest_histograms(q, g, 1)._jdf.queryExecution().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "zip_with" not in plan
