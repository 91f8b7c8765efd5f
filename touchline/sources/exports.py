"""Whole data sets as files: a writer that commits or leaves nothing, and one-call exports on it.

The writer takes rows of name, body and kind. Rows of one name are one file, their bodies one after another, so they
must be in one task and together; a file of any length streams through it. Tasks write below a staging folder
beside the target, each file under a name of its attempt and then renamed, so that repeated and speculative attempts don't
meet. Commit is one rename of the whole folder (a copy where the file system has no renames); abort deletes it.
"""

from __future__ import annotations

import json
import time
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from touchline.operators.annotations import ordered_split, yolo_labels

ROWS = "name STRING, body STRING, kind STRING"
COUNTS = "_counts.json"


@dataclass
class Written(WriterCommitMessage):
    counts: dict[str, int]


class TextFiles(DataSource):
    """rows.write.format("text_files").mode("append" or "overwrite").save(folder).

    append makes a new folder and fails where one is; overwrite replaces it, at commit. The option folders names folders,
    separated by commas, that shall be there though they be empty. Rows of each kind are counted in _counts.json.
    """

    @classmethod
    def name(cls) -> str:
        return "text_files"

    def schema(self) -> str:
        return ROWS

    def writer(self, schema, overwrite: bool) -> TextFilesWriter:
        if schema.fieldNames() != ["name", "body", "kind"]:
            raise ValueError("text_files takes the columns name, body, kind")
        folders = [f for f in self.options.get("folders", "").split(",") if f]
        return TextFilesWriter(self.options["path"], overwrite, folders)


class TextFilesWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool, folders: list[str]):
        self.path, self.overwrite, self.folders = path.rstrip("/"), overwrite, folders
        self.staging = f"{self.path}.staging-{uuid.uuid4().hex}"
        if not overwrite and _there(self.path):
            raise FileExistsError(f"{self.path} exists")

    def write(self, iterator: Iterator) -> Written:
        system, root = _system(self.staging)
        attempt, counts, made, done = f"{root}/_attempts/{uuid.uuid4().hex}", Counter(), set(), set()
        system.create_dir(attempt)
        name, out = None, None

        def close() -> None:
            out.close()
            folder = f"{root}/{name}".rpartition("/")[0]
            if folder not in made:
                system.create_dir(folder)
                made.add(folder)
            try:
                system.move(f"{attempt}/file", f"{root}/{name}")
            except OSError:  # some file systems don't rename onto a file: then another attempt's whole file is there
                if system.get_file_info(f"{root}/{name}").type != fs.FileType.File:
                    raise
            done.add(name)

        try:
            for row in iterator:
                if row.name != name:
                    if out is not None:
                        close()
                    if row.name in done or row.name.startswith(("/", "_")) or ".." in row.name.split("/"):
                        raise ValueError(f"{row.name}: rows of a file must come together, and its name be below the folder")
                    name, out = row.name, system.open_output_stream(f"{attempt}/file")
                out.write((row.body or "").encode())
                if row.kind is not None:
                    counts[row.kind] += 1
            if out is not None:
                close()
        finally:
            if out is not None and not out.closed:
                out.close()
        return Written(dict(counts))

    def commit(self, messages: list[Written | None]) -> None:
        system, root = _system(self.staging)
        target = _system(self.path)[1]
        for folder in ("", *self.folders):
            system.create_dir(f"{root}/{folder}".rstrip("/"))
        if system.get_file_info(f"{root}/_attempts").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/_attempts")
        total = sum((Counter(m.counts) for m in messages if m is not None), Counter())
        with system.open_output_stream(f"{root}/{COUNTS}") as out:
            out.write(json.dumps(total).encode())
        if _there(self.path):
            if not self.overwrite:
                self.abort(messages)
                raise FileExistsError(f"{self.path} exists")
            system.delete_dir(target)
        system.move(root, target)

    def abort(self, messages: list[Written | None]) -> None:
        """Deletes the staging folder, again where a task that is being stopped still wrote to it."""
        system, root = _system(self.staging)
        clear = 0
        for _ in range(50):
            try:
                if system.get_file_info(root).type == fs.FileType.NotFound:
                    clear += 1
                else:
                    clear = 0
                    system.delete_dir(root)
            except OSError:
                clear = 0
            if clear == 3:
                return
            time.sleep(0.1)
        raise OSError(f"{self.staging} is still written to")


def _system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and its path there; Hadoop writes file:/ with one slash."""
    return fs.FileSystem.from_uri(path.removeprefix("file:") if path.startswith("file:/") and not path.startswith("file://") else path)


def _there(path: str) -> bool:
    system, root = _system(path)
    return system.get_file_info(root).type != fs.FileType.NotFound


def write_files(rows: DataFrame, folder: str, overwrite: bool = False, folders: tuple[str, ...] = ()) -> dict[str, int]:
    """Writes rows of name, body, kind as files below folder; the number of rows of each kind."""
    spark: SparkSession = rows.sparkSession
    spark.dataSource.register(TextFiles)
    writer = rows.select("name", "body", "kind").write.format("text_files").option("folders", ",".join(folders))
    writer.mode("overwrite" if overwrite else "append").save(folder)
    system, root = _system(f"{folder.rstrip('/')}/{COUNTS}")
    with system.open_input_stream(root) as found:
        return json.loads(found.read())


def _category(labels: dict[str, int]) -> Column:
    return F.create_map(*(F.lit(x) for kv in labels.items() for x in kv))[F.col("label")]


def export_yolo(boxes: DataFrame, folder: str, labels: dict[str, int], ratio: float = 0.8, width: float = 1920.0, height: float = 1080.0, overwrite: bool = False) -> dict[str, int]:
    """A YOLO data set of one match's boxes (frame_idx, label, x1..y2): labels/<split>/frame_<8 digits>.txt and data.yaml.

    The first int(n * ratio) frames train. A frame whose labels are all unknown has an empty file; NULL labels are unknown
    ones; rows without a frame are left out. Returns total_frames, train_frames, val_frames.
    """
    rows = boxes.filter("frame_idx is not null").select("frame_idx", _category(labels).alias("class_id"), "x1", "y1", "x2", "y2")
    known = rows.filter("class_id is not null and x1 is not null and y1 is not null and x2 is not null and y2 is not null").withColumnRenamed("frame_idx", "frame_key")
    files = ordered_split(rows, "frame_idx", ratio).join(yolo_labels(known, width, height).withColumnRenamed("frame_key", "frame_idx"), "frame_idx", "left")
    name = F.format_string("labels/%s/frame_%08d.txt", "split", "frame_idx")
    names = "\n".join(f"  {k}: {v}" for v, k in sorted(labels.items(), key=lambda item: item[1]))
    yaml = boxes.sparkSession.range(1).select(F.lit("data.yaml").alias("name"), F.lit(f"names:\n{names}\npath: {folder}\ntrain: images/train\nval: images/val\n").alias("body"), F.lit(None).cast("string").alias("kind"))
    wanted = files.select(name.alias("name"), F.coalesce("lines", F.lit("")).alias("body"), F.col("split").alias("kind"))
    found = write_files(wanted.unionByName(yaml), folder, overwrite, tuple(f"{a}/{b}" for a in ("images", "labels") for b in ("train", "val")))
    train, val = found.get("train", 0), found.get("val", 0)
    return {"total_frames": train + val, "train_frames": train, "val_frames": val}


def export_coco(boxes: DataFrame, folder: str, labels: dict[str, int], width: int = 1920, height: int = 1080, overwrite: bool = False) -> dict[str, int]:
    """<folder>/<video_id>.json for every match of boxes (video_id, frame_idx, track_id, label, x1..y2).

    Images are the frames in order, those with unknown labels alone too; annotations go by frame, track and box.
    A match is numbered and written by one task, row by row, as the format is one document. Returns images, annotations.
    """
    rows = boxes.filter("video_id is not null and frame_idx is not null").withColumn("category_id", _category(labels))
    by = Window.partitionBy("video_id")
    images = rows.select("video_id", "frame_idx").distinct().withColumn("id", F.row_number().over(by.orderBy("frame_idx")))
    image = F.struct("id", F.format_string("frame_%08d.jpg", "frame_idx").alias("file_name"), F.lit(width).alias("width"), F.lit(height).alias("height"))
    corner = ["x1", "y1", "x2", "y2"]
    kept = rows.filter("category_id is not null and x1 is not null and y1 is not null and x2 is not null and y2 is not null")
    kept = kept.join(images.select("video_id", "frame_idx", F.col("id").alias("image_id")), ["video_id", "frame_idx"])
    kept = kept.withColumn("id", F.row_number().over(by.orderBy("frame_idx", "track_id", *corner, "category_id")))
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    made = F.struct("id", "image_id", "category_id", F.array("x1", "y1", w, h).alias("bbox"), (w * h).alias("area"), F.lit(0).alias("iscrowd"))

    def pieces(df: DataFrame, part: int, body: Column, kind: str | None) -> DataFrame:
        place = F.col("id") if "id" in df.columns else F.lit(0)
        return df.select("video_id", F.lit(part).alias("_part"), place.cast("long").alias("_place"), body.alias("body"), F.lit(kind).cast("string").alias("kind"))

    comma = F.when(F.col("id") > 1, ", ").otherwise("")
    categories = json.dumps([{"id": v, "name": k} for k, v in labels.items()])
    matches = images.select("video_id").distinct()
    all_ = pieces(matches, 0, F.lit(f'{{"categories": {categories}, "images": ['), None)
    for df, part, body, kind in ((images, 1, F.concat(comma, F.to_json(image)), "images"), (matches, 2, F.lit('], "annotations": ['), None), (kept, 3, F.concat(comma, F.to_json(made)), "annotations"), (matches, 4, F.lit("]}"), None)):
        all_ = all_.unionByName(pieces(df, part, body, kind))
    ordered = all_.withColumn("name", F.concat(F.col("video_id").cast("string"), F.lit(".json"))).repartition("name").sortWithinPartitions("name", "_part", "_place")
    found = write_files(ordered, folder, overwrite)
    return {k: found.get(k, 0) for k in ("images", "annotations")}
