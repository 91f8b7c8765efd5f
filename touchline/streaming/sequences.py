"""Sequences of boxes as a stream: ground truth in archives and folders, taken up where the last micro-batch ended.

spark.readStream.format("mot_stream").load("a.zip,folder") reads <seq>/gt/gt.txt below each folder or within each archive,
sequences without one being skipped. The offset has the bytes taken of each sequence, so a restart with its checkpoint
goes on there, and files that come later are taken whole. One task a sequence and micro-batch; archives are read whole.

Files are taken as finished when they appear. With the option growing, a folder's file may still be appended to, in order of
frames: its last frame waits until a later one follows or <seq>/gt/_SUCCESS is there. Files only grow: one
that has got shorter is an error, not a new sequence. Paths are read by pyarrow's file systems (local, HDFS, object stores).
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from touchline.sources.exports import _system
from touchline.sources.readers import MOT, mot_row

TRUTH = "/gt/gt.txt"


class SequenceStream(DataSource):
    """seq_name and the columns of a ground truth file."""

    @classmethod
    def name(cls) -> str:
        return "mot_stream"

    def schema(self) -> str:
        return f"seq_name STRING, {MOT}"

    def streamReader(self, schema) -> SequenceReader:
        paths = [p.rstrip("/") for p in self.options["path"].split(",")]
        return SequenceReader(paths, self.options.get("growing", "false").lower() == "true")


class SequenceReader(DataSourceStreamReader):
    def __init__(self, paths: list[str], growing: bool):
        self.paths, self.growing = paths, growing

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """Bytes there are to take of each sequence, by path or archive!member; listed, not read."""
        out = {}
        for path in self.paths:
            system, root = _system(path)
            kind = system.get_file_info(root).type
            if kind == fs.FileType.NotFound:
                continue  # not there yet
            if kind == fs.FileType.File:
                with system.open_input_file(root) as file, zipfile.ZipFile(file) as archive:
                    out |= {f"{path}!{m.filename}": m.file_size for m in archive.infolist() if f"/{m.filename}".endswith(TRUTH)}
                continue
            below = {f.path: f.size for f in system.get_file_info(fs.FileSelector(root, recursive=True)) if f.type == fs.FileType.File}
            for name, size in below.items():
                if name.endswith(TRUTH):
                    settled = not self.growing or f"{name.rpartition('/')[0]}/_SUCCESS" in below
                    out[f"{path}{name[len(root):]}"] = size if settled else _last_frame(system, name, size)
        return out

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        out = []
        for name, to in sorted(end.items()):
            since = start.get(name, 0)
            if to < since:
                raise ValueError(f"{name} has got shorter: {to} of {since} bytes")
            if to > since:
                out.append(InputPartition((name, since, to)))
        return out or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.value is None:
            return
        name, since, to = partition.value
        path, _, member = name.partition("!")
        system, root = _system(path)
        with system.open_input_file(root) as file:
            if member:
                with zipfile.ZipFile(file) as archive, archive.open(member) as raw:
                    yield from _rows(raw, member, since, to)
            else:
                yield from _rows(file, path, since, to)

    def commit(self, end: dict) -> None:
        """Nothing to do: files stay."""


def _rows(file: io.IOBase, name: str, since: int, to: int) -> Iterator[tuple]:
    """Rows of the lines in bytes since to to, read piece by piece; both are borders of lines."""
    file.seek(since)
    left, rest, seq = to - since, b"", f"/{name}".split("/")[-3]
    while left > 0:
        piece = file.read(min(left, 1 << 20))
        if not piece:
            raise EOFError(f"{name} ends before byte {to}")
        left -= len(piece)
        *lines, rest = (rest + piece).split(b"\n")
        yield from filter(None, (mot_row(seq, line.decode()) for line in lines))
    if row := mot_row(seq, rest.decode()):
        yield row


def _last_frame(system: fs.FileSystem, name: str, size: int) -> int:
    """The byte at which the lines of the last whole line's frame begin, 0 if there is no other frame."""
    reach = 1 << 16
    with system.open_input_file(name) as file:
        while True:
            begin = max(size - reach, 0)
            file.seek(begin)
            tail = file.read(size - begin)
            at = tail.find(b"\n") + 1 if begin else 0  # begins within a line
            whole = tail[at : tail.rfind(b"\n") + 1].split(b"\n")[:-1]
            ends = begin + at + sum(len(line) + 1 for line in whole)
            last = whole[-1].partition(b",")[0] if whole else None
            while whole and whole[-1].partition(b",")[0] == last:
                ends -= len(whole.pop()) + 1
            if whole or not begin:
                return ends
            reach *= 4


def read_sequences(spark: SparkSession, paths: str, growing: bool = False) -> DataFrame:
    """The stream of all sequences in paths (archives and folders, separated by commas)."""
    spark.dataSource.register(SequenceStream)
    return spark.readStream.format("mot_stream").option("growing", str(growing).lower()).load(paths)


def as_detections(rows: DataFrame) -> DataFrame:
    """video_id, frame_idx, det_id, x1..y2 as the streaming tracker takes them; video_id is a hash of the sequence's name."""
    corner = {"x1": F.col("x"), "y1": F.col("y"), "x2": F.col("x") + F.col("w"), "y2": F.col("y") + F.col("h")}
    return rows.select(F.xxhash64("seq_name").alias("video_id"), F.col("frame").cast("long").alias("frame_idx"), F.col("track_id").cast("long").alias("det_id"), *(c.alias(n) for n, c in corner.items()))
