"""Readers and writers of the annotation formats, as Spark sources."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MOT = "frame INT, track_id INT, x DOUBLE, y DOUBLE, w DOUBLE, h DOUBLE, conf DOUBLE, class_id INT, visibility DOUBLE, unused DOUBLE"
DATASET_INFO = (
    "name STRING, version STRING, format STRING, num_images INT, num_annotations INT, class_distribution MAP<STRING,INT>, "
    "train_split DOUBLE, created_at STRING, updated_at STRING, source_videos ARRAY<STRING>, metadata MAP<STRING,STRING>"
)
COCO = (
    "images ARRAY<STRUCT<id: BIGINT, file_name: STRING>>, "
    "annotations ARRAY<STRUCT<id: BIGINT, image_id: BIGINT, category_id: BIGINT, bbox: ARRAY<DOUBLE>, area: DOUBLE>>"
)
CALIBRATION = "MAP<STRING, ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>>"
IMAGE = "_id BIGINT, _name STRING, box ARRAY<STRUCT<_label: STRING, _xtl: DOUBLE, _ytl: DOUBLE, _xbr: DOUBLE, _ybr: DOUBLE, _occluded: STRING, attribute: ARRAY<STRUCT<_name: STRING, _VALUE: STRING>>>>"


def read_mot(spark: SparkSession, folder: str) -> DataFrame:
    """Ground truth of all sequences below folder (<seq>/gt/gt.txt), with seq_name."""
    rows = spark.read.schema(MOT).csv(f"{folder}/*/gt/gt.txt")
    return rows.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/gt/gt\.txt$", 1).alias("seq_name"), "*")


def read_calibration(spark: SparkSession, folder: str) -> DataFrame:
    """frame_id, class_name, pos, x, y of the line annotations <frame_id>.json; empty ones have no rows."""
    files = spark.read.option("wholetext", True).text(f"{folder}/*.json")
    lines = files.select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1).alias("frame_id"), F.explode(F.from_json("value", CALIBRATION)).alias("class_name", "points"))
    return lines.select("frame_id", "class_name", F.posexplode("points").alias("pos", "p")).select("frame_id", "class_name", "pos", "p.x", "p.y")


def read_images_xml(spark: SparkSession, path: str) -> DataFrame:
    """frame_idx, label, xtl..ybr, occluded, attributes of the boxes of image elements."""
    images = spark.read.schema(IMAGE).option("rowTag", "image").format("xml").load(path)
    rows = images.select(F.coalesce("_id", F.lit(0).cast("bigint")).alias("frame_idx"), F.explode("box").alias("b"))
    box = [F.coalesce(F.col(f"b._{c}"), F.lit(0.0)).alias(c) for c in ("xtl", "ytl", "xbr", "ybr")]
    pairs = F.transform(F.coalesce("b.attribute", F.array().cast("array<struct<_name:string,_VALUE:string>>")), lambda a: F.struct(a["_name"], F.coalesce(a["_VALUE"], F.lit(""))))
    return rows.select("frame_idx", F.coalesce("b._label", F.lit("")).alias("label"), *box, (F.coalesce("b._occluded", F.lit("")) == "1").alias("occluded"), F.map_from_entries(pairs).alias("attributes"))


def read_calibration_pairs(spark: SparkSession, folder: str, ending: str = "jpg") -> DataFrame:
    """read_calibration for the frames that have an image <frame_id>.jpg beside their annotations."""
    return read_calibration(spark, folder).join(_stems(spark, f"{folder}/*.{ending}", "frame_id"), "frame_id", "left_semi")


def read_line_samples(spark: SparkSession, folder: str, split: str) -> DataFrame:
    """image (path), lines, extremities (JSON) of a training split.

    <split>_annotations.json, a list of samples, is read where there is one, else labels/<split>/<stem>.json;
    either way only samples whose image is there count.
    """
    listed = f"{folder}/{split}_annotations.json"
    if _exists(spark, listed):
        samples = spark.read.option("multiLine", True).schema("image STRING, lines STRING, extremities STRING").json(listed)
        images = _paths(spark, f"{folder}/images", "*.jpg", True)
        known = images.select(F.regexp_extract("path", r"/images/(.+)$", 1).alias("image"), "path")
        return samples.join(known, "image").select(F.col("path").alias("image"), "lines", F.coalesce("extremities", F.lit("{}")).alias("extremities"))
    if not (_exists(spark, f"{folder}/images/{split}") and _exists(spark, f"{folder}/labels/{split}")):
        return spark.createDataFrame([], "image STRING, lines STRING, extremities STRING")
    labels = spark.read.option("wholetext", True).option("pathGlobFilter", "*.json").text(f"{folder}/labels/{split}")
    fields = F.from_json("value", "lines STRING, extremities STRING")
    labels = labels.select(F.regexp_extract("_metadata.file_name", r"^(.*)\.json$", 1).alias("stem"), fields.alias("s"))
    images = _paths(spark, f"{folder}/images/{split}", "*.jpg", False)
    paired = images.withColumn("stem", F.regexp_extract("path", r"([^/]+)\.jpg$", 1)).join(labels, "stem")
    return paired.select(F.col("path").alias("image"), *(F.coalesce(f"s.{c}", F.lit("{}")).alias(c) for c in ("lines", "extremities")))


def list_videos(spark: SparkSession, folder: str) -> DataFrame:
    """video_id of the folders <video_id>/metadata.json, in order."""
    found = _paths(spark, folder, "metadata.json", True)
    return found.select(F.regexp_extract("path", r"([^/]+)/metadata\.json$", 1).alias("video_id")).distinct().orderBy("video_id")


def load_metadata(spark: SparkSession, folder: str, video_id: str) -> DataFrame:
    """The one row of <video_id>/metadata.json; FileNotFoundError without it."""
    path = f"{folder}/{video_id}/metadata.json"
    if not _exists(spark, path):
        raise FileNotFoundError(f"no metadata of video {video_id}")
    return spark.read.option("multiLine", True).json(path)


def _paths(spark: SparkSession, folder: str, pattern: str, deep: bool) -> DataFrame:
    """Paths of files below folder, without their contents."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", deep)
    return files.load(folder).select("path")


def _stems(spark: SparkSession, pattern: str, name: str) -> DataFrame:
    """Names without their ending of the files that match, none where none do."""
    folder, _, ending = pattern.rpartition("/")
    return _paths(spark, folder, ending, False).select(F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias(name))


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether Spark can read there, on any file system it knows."""
    try:
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    except AnalysisException:
        return False
    return True


def read_yolo(spark: SparkSession, folder: str) -> DataFrame:
    """split, image, class_id, cx, cy, w, h of label files <folder>/<split>/<image>.txt."""
    from touchline.operators.annotations import parse_yolo

    lines = spark.read.text(f"{folder}/*/*.txt")
    path = F.col("_metadata.file_path")
    return parse_yolo(lines.select(F.regexp_extract(path, r"([^/]+)/[^/]+$", 1).alias("split"), F.regexp_extract(path, r"([^/]+)\.txt$", 1).alias("image"), "value"))


def read_coco(spark: SparkSession, folder: str) -> DataFrame:
    """file (name without its ending), frame, image_id, annotation_id, category_id, left, top, width, height, area of the annotations of <folder>/<file>.json.

    A file is one document, so one task reads it. Annotations whose image is missing have no frame.
    """
    found = spark.read.schema(COCO).option("multiLine", True).json(f"{folder}/*.json")
    named = found.select(F.regexp_extract("_metadata.file_name", r"^(.*)\.json$", 1).alias("file"), "images", F.explode("annotations").alias("a"))
    images = F.map_from_arrays("images.id", "images.file_name")
    frame = F.regexp_extract(F.try_element_at(images, F.col("a.image_id")), r"(\d+)\.[^.]*$", 1).try_cast("bigint")
    box = [F.get("a.bbox", F.lit(k)).alias(n) for k, n in enumerate(("left", "top", "width", "height"))]
    return named.select("file", frame.alias("frame"), "a.image_id", F.col("a.id").alias("annotation_id"), "a.category_id", *box, "a.area")


def write_yolo(labels: DataFrame, folder: str) -> None:
    """labels: split, frame_key, lines; a folder for each split and frame."""
    labels.select("split", "frame_key", F.col("lines").alias("value")).write.partitionBy("split", "frame_key").text(folder)


def read_datasets(spark: SparkSession, base: str) -> DataFrame:
    """Data-set records <base>/<name>/dataset_info.json, by name."""
    return spark.read.schema(DATASET_INFO).option("multiLine", True).json(f"{base}/*/dataset_info.json").orderBy("name")


def create_dataset(spark: SparkSession, base: str, name: str, form: str = "yolo", train_split: float = 0.8, sources: list[str] | None = None) -> DataFrame:
    """The record of a new, empty data set, written to <base>/<name>/dataset_info.json; ValueError if the data set exists."""
    folder = f"{base}/{name}"
    if _exists(spark, folder):
        raise ValueError(f"data set {name} exists")
    row = (name, "1.0.0", form, 0, 0, {}, train_split, None, None, sources or [], {})
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    record = spark.createDataFrame([row], DATASET_INFO).withColumns({"created_at": now, "updated_at": now})
    record.coalesce(1).write.json(f"{folder}/dataset_info.json")
    return spark.read.schema(DATASET_INFO).json(f"{folder}/dataset_info.json")


def stamped(record: DataFrame, images: Column, annotations: Column) -> DataFrame:
    """record with new counts and updated_at; created_at stays."""
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return record.withColumns({"num_images": images.cast("int"), "num_annotations": annotations.cast("int"), "updated_at": now})


def write_data_yaml(spark: SparkSession, folder: str, labels: dict[str, int], val: str = "images/val") -> None:
    """data.yaml as a text file in the folder <folder>/data.yaml: paths of the splits and class names by id."""
    lines = ["names:", *(f"  {k}: {v}" for v, k in sorted(labels.items(), key=lambda item: item[1])), f"path: {folder}", "train: images/train", f"val: {val}"]
    spark.createDataFrame([("\n".join(lines),)], "value STRING").coalesce(1).write.mode("overwrite").text(f"{folder}/data.yaml")


def write_tracks(tracks: DataFrame, path: str) -> None:
    tracks.write.partitionBy("video_id").json(path)


def mot_row(seq_name: str, line: str) -> tuple | None:
    """The row of a ground truth line; None for lines of under six cells."""
    kinds = (int, int, float, float, float, float, float, int, float, float)
    cells = line.strip().split(",")
    if len(cells) < 6:
        return None
    cells += [""] * (10 - len(cells))
    return (seq_name, *(int(float(c)) if k is int and c else k(c) if c else None for k, c in zip(kinds, cells, strict=False)))


class ZipSequences(DataSource):
    """Ground truth inside zip archives: spark.read.format("zip_mot").load("a.zip,b.zip"). One task an archive and sequence."""

    @classmethod
    def name(cls) -> str:
        return "zip_mot"

    def schema(self) -> str:
        return f"seq_name STRING, {MOT}"

    def reader(self, schema) -> ZipReader:
        return ZipReader(self.options["path"].split(","))


class ZipReader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = paths

    def partitions(self) -> list[InputPartition]:
        out = []
        for path in self.paths:
            with zipfile.ZipFile(path) as archive:
                out += [InputPartition((path, name)) for name in sorted(archive.namelist()) if name.endswith("/gt/gt.txt")]
        return out or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.value is None:
            return
        path, name = partition.value
        with zipfile.ZipFile(path) as archive, archive.open(name) as raw:
            for line in io.TextIOWrapper(raw):
                if row := mot_row(name.split("/")[-3], line):
                    yield row
