"""Data sets of annotations: merging, splitting, statistics and selection for labelling."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge(labels: DataFrame) -> DataFrame:
    """The labels of every image in the first source, train before val, that has it.

    labels: dataset, split, image, class_name. The choice of a source is an aggregate of a row per
    image, joined back, so a name that many sources share shuffles as partial minima.
    """
    place = F.struct("dataset", (F.col("split") != "train").alias("val"))
    first = labels.groupBy("image").agg(F.min(place).alias("_p"))
    return labels.join(first, "image").filter(place == F.col("_p")).drop("_p")


def merge_named(datasets: DataFrame, labels: DataFrame, sources: list[str], deduplicate: bool = True) -> DataFrame:
    """The labels of the named sources as one data set, in the order named; ValueError where their formats differ or one is missing.

    datasets: name, format, a row for each data set. labels: dataset (a name), split, image, class_name.
    """
    known = {r["name"]: r["format"] for r in datasets.filter(F.col("name").isin(sources)).select("name", "format").collect()}
    missing = [n for n in sources if n not in known]
    if missing:
        raise ValueError(f"no data set {', '.join(missing)}")
    if len(set(known.values())) > 1:
        raise ValueError(f"data sets of different formats: {sorted(set(known.values()))}")
    place = F.array_position(F.array(*map(F.lit, sources)), F.col("dataset"))
    rows = labels.filter(F.col("dataset").isin(sources)).withColumn("_name", F.col("dataset")).withColumn("dataset", place)
    return (merge(rows) if deduplicate else rows).withColumn("dataset", F.col("_name")).drop("_name")


def statistics(labels: DataFrame) -> DataFrame:
    """images and annotations of every data set by split, with the totals of a rollup."""
    return labels.rollup("dataset", "split").agg(F.count_distinct("image").alias("images"), F.count("*").alias("annotations"))


def class_distribution(labels: DataFrame) -> DataFrame:
    return labels.groupBy("dataset", "class_name").agg(F.count("*").alias("annotations"))


def top(rows: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k rows: a heap per task, merged."""
    return rows.orderBy(*order).limit(k)


def uncertainty(predictions: DataFrame) -> DataFrame:
    """1 - mean confidence, missing ones counting 0.5; 1 without boxes. predictions: path, boxes (array of confidence)."""
    sum_ = F.aggregate("boxes", F.lit(0.0), lambda a, c: a + F.coalesce(c.cast("double"), F.lit(0.5)))
    return predictions.withColumn("uncertainty", F.when(F.coalesce(F.size("boxes"), F.lit(0)) <= 0, 1.0).otherwise(1 - sum_ / F.size("boxes")))


def stratified(predictions: DataFrame, k: int, key: Column) -> DataFrame:
    """k rows spread over bins of box counts: k / bins of each by the key, then filled up by the key.

    Ranks past k within a bin can't be chosen, so each bin sends its k first rows at most.
    """
    rows = predictions.withColumn("bin", F.least((F.col("n_boxes") / 5).cast("int"), F.lit(10))).withColumn("_key", key)
    bins = rows.agg(F.count_distinct("bin")).first()[0] or 1
    share = max(1, k // bins)
    rows = rows.withColumn("_rank", F.row_number().over(Window.partitionBy("bin").orderBy("_key", "path"))).filter(F.col("_rank") <= k)
    return rows.orderBy(F.col("_rank") > share, F.when(F.col("_rank") <= share, F.col("bin")), "_key", "path").limit(k).drop("_key", "_rank")


def hash_split(rows: DataFrame, key: Column, ratio: float) -> DataFrame:
    """split by a key in [0, 1): independent of order and of other rows, so it holds as rows are added."""
    return rows.withColumn("split", F.when(key < ratio, "train").otherwise("val"))


def shuffle_key(path: Column, seed: int = 42) -> Column:
    """60 bits that shuffle paths: the head of the md5 of seed and path."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), path)), 1, 15), 16, 10).cast("long")


def exact_split(rows: DataFrame, ratio: float, seed: int = 42, path: str = "path") -> DataFrame:
    """split: train for exactly int(rows * ratio) rows of a seeded shuffle, val for the others.

    The order is by shuffle_key and path, so it is the same on any partitioning. Rows are counted by the
    first 16 bits of their keys; a bucket before the border is train and one behind it val as a whole, and only
    the bucket that holds the border is ranked. NULL paths come first; equal paths fall as they lie.
    """
    keyed = rows.select(F.struct("*").alias("_row"), F.col(path).alias("_path"), F.coalesce(shuffle_key(F.col(path), seed), F.lit(0)).alias("_key"))
    keyed = keyed.withColumn("_bucket", F.shiftright("_key", 44))
    whole = Window.partitionBy(F.lit(1))
    sizes = keyed.groupBy("_bucket").agg(F.count("*").alias("_n"))  # at most 65,536 rows, one of which holds the border
    sizes = sizes.withColumn("_ahead", F.sum("_n").over(whole.orderBy("_bucket")) - F.col("_n")).withColumn("_most", F.floor(F.sum("_n").over(whole) * F.lit(ratio)))
    known = keyed.join(F.broadcast(sizes), "_bucket")
    clear = (F.col("_ahead") + F.col("_n") <= F.col("_most")) | (F.col("_ahead") >= F.col("_most"))
    made = known.filter(clear).withColumn("_rank", F.col("_ahead") + 1)
    border = known.filter(~clear).withColumn("_rank", F.col("_ahead") + F.row_number().over(Window.partitionBy("_bucket").orderBy("_key", "_path")))
    both = made.unionByName(border)
    return both.withColumn("split", F.when(F.col("_rank") <= F.col("_most"), "train").otherwise("val")).select("_row.*", "split")


def video_ids(paths: DataFrame, path: str = "path") -> DataFrame:
    """video_id: the file's stem, lower-case with underscores and cut to 20, and 8 digits of the path's md5."""
    stem = F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")
    name = F.substring(F.lower(F.replace(stem, F.lit(" "), F.lit("_"))), 1, 20)
    return paths.withColumn("video_id", F.concat_ws("_", name, F.substring(F.md5(path), 1, 8)))


def output_paths(paths: DataFrame, prefix: str, suffix: str, seconds: Column, path: str = "path") -> DataFrame:
    stem = F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")
    return paths.withColumn("output", F.concat(F.concat_ws("_", F.lit(prefix), stem, F.when(seconds.isNotNull(), F.concat(seconds.cast("int").cast("string"), F.lit("s"))), F.lit(suffix)), F.lit(".avi")))


#: Rows of the gallery and queries that meet in one task at a time.
GALLERY_ROWS, QUERY_ROWS = 20_000, 4_000
#: Rows whose bins are compared in one piece of memory.
STRIP = 2048


def _histograms(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bins by rows, NaN where a bin is missing; which rows have no histogram)."""
    rows = column.combine_chunks()
    none = rows.is_null().to_numpy(zero_copy_only=False)
    sizes = pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = rows.flatten().to_numpy(zero_copy_only=False)
    table = np.full((len(rows), int(sizes.max(initial=0))), np.nan, dtype=flat.dtype if flat.dtype.kind == "f" else float)
    table[np.arange(table.shape[1]) < sizes[:, None]] = flat
    return np.abs(table.T), none


def _sixth(x: np.ndarray) -> np.ndarray:
    """x in millionths, halves rounded up as SQL does; NaN is the least."""
    scaled = x * 1e6
    whole = np.where(np.isnan(x), -1.0, np.floor(scaled + 0.5))
    for i in np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-4).tolist():
        whole[i] = float(Decimal(repr(float(x[i]))).scaleb(6).to_integral_value(ROUND_HALF_UP))
    return whole


def nearest_histograms(queries: DataFrame, gallery: DataFrame, k: int, blocks: int = 64) -> DataFrame:
    """query_id, vec_id, similarity, rank: the k gallery rows with the largest histogram intersection.

    Queries meet the gallery block by block, so that every pair is made once, in numpy: a task holds GALLERY_ROWS
    rows, QUERY_ROWS queries and one query's sums. All pairs have rough sums first; those that may be among the k best
    are summed in doubles in order of bins, as SQL does. k candidates a query and block leave a task.
    """
    across = max(blocks, -(-gallery.count() // GALLERY_ROWS))
    down = max(1, -(-queries.count() // QUERY_ROWS))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))
    spread = gallery.filter("vec_id is not null").select("vec_id", "v").withColumn("_block", deal("vec_id", across)).withColumn("_part", every(down))
    asked = queries.filter("query_id is not null").select("query_id", "q").withColumn("_part", deal("query_id", down)).withColumn("_block", every(across))
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, vec_id {gallery.schema['vec_id'].dataType.simpleString()}, similarity double"

    def meet(near: pa.Table, asks: pa.Table) -> pa.Table:
        (bins, none), (wanted, blank) = _histograms(near["v"]), _histograms(asks["q"])
        width = max(len(bins), len(wanted))
        bins, wanted = (np.pad(t, ((0, width - len(t)), (0, 0)), constant_values=np.nan) for t in (bins, wanted))
        # in order of ids, so that a stable sort by similarity leaves ties in it
        order = pc.sort_indices(near["vec_id"]).to_numpy()
        bins, none, ids = np.ascontiguousarray(bins[:, order]), none[order], near["vec_id"].take(order)
        known = ids.to_numpy()
        least = np.fmin if np.isnan(bins).any() or np.isnan(wanted).any() else np.minimum
        space, rough = np.empty((width, STRIP), np.result_type(bins, wanted)), np.zeros(len(none))
        asker, picked, sums = [], [], []
        for j, query in enumerate(asks["query_id"].to_pylist()):
            rows = np.flatnonzero(known != query)
            if len(rows) > k:
                for at in range(0, len(none), STRIP):
                    part = bins[:, at : at + STRIP]
                    least(part, wanted[:, j, None], out=space[:, : part.shape[1]])
                    rough[at : at + STRIP] = space[:, : part.shape[1]].sum(axis=0)
                lost = -np.nan_to_num(np.where(none | blank[j], np.nan, rough), nan=-1.0)[rows]
                last = np.partition(lost, k - 1)[k - 1]
                rows = rows[lost <= last + 2e-6 + 4 * width * np.finfo(space.dtype).eps * abs(last)]  # the k best and what may be, or round to, the same
            total = np.zeros(len(rows))
            if width:
                total = np.add.accumulate(least(bins[:, rows], wanted[:, j, None]).astype(float), axis=0)[-1]
            total[none[rows] | blank[j]] = np.nan
            best = (-_sixth(total)).argsort(kind="stable")[:k]
            asker.append(np.full(len(best), j))
            picked.append(rows[best])
            sums.append(total[best])
        asker, picked, sums = (np.concatenate(v or [np.zeros(0)]) for v in (asker, picked, sums))
        return pa.table({"query_id": asks["query_id"].take(asker.astype(np.int64)), "vec_id": ids.take(picked.astype(np.int64)), "similarity": pa.array(sums, pa.float64(), from_pandas=True)})

    keys = ["_block", "_part"]
    rows = spread.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(meet, schema).withColumn("similarity", F.round("similarity", 6))
    order = (F.desc("similarity"), F.asc("vec_id"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).filter(F.col("rank") <= k)
