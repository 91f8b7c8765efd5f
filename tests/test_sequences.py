"""Ground truth as a stream: over archives and folders, restarts, growing files, and into the tracker."""

import zipfile

import pytest
from pyspark.sql import functions as F

from touchline.operators import tracking
from touchline.streaming import sequences
from touchline.streaming.tracker import track_stream


def line(frame, track, x=0.0, y=0.0):
    return f"{frame},{track},{x},{y},10,20,1,1,0.5,-1\n"


def truth(folder, name, text, mode="w"):
    (folder / name / "gt").mkdir(parents=True, exist_ok=True)
    with open(folder / name / "gt" / "gt.txt", mode) as out:
        out.write(text)


def run(rows, out, state):
    query = rows.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(state)).trigger(availableNow=True).start()
    query.awaitTermination()


@pytest.fixture
def place(tmp_path):
    for name in ("in", "out", "state"):
        (tmp_path / name).mkdir()
    return tmp_path


def seen(spark, place):
    return sorted((r["seq_name"], r["frame"], r["track_id"]) for r in spark.read.parquet(str(place / "out")).collect())


def test_archives_and_folders_and_a_restart(spark, place):
    source = f"{place}/in,{place}/a.zip,{place}/later.zip"
    truth(place / "in", "one", line(1, 1) + line(2, 1) + "1,2\n")
    (place / "in" / "none").mkdir()
    with zipfile.ZipFile(place / "a.zip", "w") as archive:
        archive.writestr("train/two/gt/gt.txt", "".join(line(f, 5) for f in range(1, 4)))
        archive.writestr("three/gt/gt.txt", line(7, 8).strip())
        archive.writestr("train/two/readme", "1,2,3,4,5,6")
    run(sequences.read_sequences(spark, source), place / "out", place / "state")
    first = [("one", 1, 1), ("one", 2, 1), ("three", 7, 8), ("two", 1, 5), ("two", 2, 5), ("two", 3, 5)]
    assert seen(spark, place) == first
    run(sequences.read_sequences(spark, source), place / "out", place / "state")
    assert seen(spark, place) == first
    truth(place / "in", "one", line(3, 1), "a")
    truth(place / "in", "four", line(1, 9))
    with zipfile.ZipFile(place / "later.zip", "w") as archive:
        archive.writestr("five/gt/gt.txt", line(1, 4))
    run(sequences.read_sequences(spark, source), place / "out", place / "state")
    assert seen(spark, place) == sorted([*first, ("one", 3, 1), ("four", 1, 9), ("five", 1, 4)])


def test_a_growing_file_gives_whole_frames(spark, place):
    source, go = str(place / "in"), lambda: run(sequences.read_sequences(spark, str(place / "in"), growing=True), place / "out", place / "state")
    truth(place / "in", "one", line(1, 1) + line(1, 2) + line(2, 1) + "2,2,0")
    go()
    assert seen(spark, place) == [("one", 1, 1), ("one", 1, 2)]
    truth(place / "in", "one", ",0,10,20,1,1,0.5,-1\n" + line(3, 1), "a")
    go()
    assert seen(spark, place) == [("one", 1, 1), ("one", 1, 2), ("one", 2, 1), ("one", 2, 2)]
    (place / "in" / "one" / "gt" / "_SUCCESS").touch()
    go()
    assert seen(spark, place)[-1] == ("one", 3, 1) and source


def test_the_last_frame_may_be_long(place):
    text = line(1, 1) + "".join(line(2, k) for k in range(5000))
    truth(place / "in", "one", text)
    system, root = sequences._system(str(place / "in" / "one" / "gt" / "gt.txt"))
    assert sequences._last_frame(system, root, len(text)) == len(line(1, 1))
    assert sequences._last_frame(system, root, len(line(1, 1))) == 0


def test_shorter_files_are_an_error():
    reader = sequences.SequenceReader([], False)
    with pytest.raises(ValueError, match="shorter"):
        reader.partitions({"a": 9}, {"a": 5})
    assert [p.value for p in reader.partitions({"a": 9, "gone": 3}, {"a": 9, "b": 4})] == [("b", 0, 4)]


def test_missing_and_empty_inputs_give_no_rows(spark, place):
    truth(place / "in", "empty", "")
    run(sequences.read_sequences(spark, f"{place}/in,{place}/never.zip"), place / "out", place / "state")
    assert sequences.SequenceReader([str(place / "never.zip")], False).latestOffset() == {}
    assert not [p for p in (place / "out").glob("*.parquet")] or spark.read.parquet(str(place / "out")).count() == 0


def test_feeds_the_tracker_as_the_batch_does(spark, place):
    steps = [(f, k, 100.0 * k + 2 * f, 50.0 + f) for f in range(1, 13) for k in range(3) if (f + k) % 5]
    head, tail = ("".join(line(*s) for s in steps if (s[0] <= 6) == early) for early in (True, False))
    truth(place / "in", "one", head)
    stream = lambda: track_stream(sequences.as_detections(sequences.read_sequences(spark, str(place / "in"))))
    run(stream(), place / "out", place / "state")
    truth(place / "in", "one", tail, "a")
    run(stream(), place / "out", place / "state")
    rows = spark.createDataFrame(steps, "frame int, track_id int, x double, y double").withColumns({"seq_name": F.lit("one"), "w": F.lit(10.0), "h": F.lit(20.0)})
    want = tracking.track_boxes(sequences.as_detections(rows))
    both = [sorted(tuple(r[c] for c in ("video_id", "frame_idx", "track", "x1", "y1")) for r in df.collect()) for df in (spark.read.parquet(str(place / "out")), want)]
    assert both[0] == both[1] and len(both[0]) >= len(steps)
