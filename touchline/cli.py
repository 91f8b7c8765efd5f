"""Command line: list the queries, run one into Parquet or show its plan, analyse matches, list data sets or create one."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from touchline.operators import analysis, influence
from touchline.plans import catalogue, motion
from touchline.sources import readers


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="touchline", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list", help="names of all queries")
    for name, text in (("run", "write a query's rows as Parquet"), ("explain", "print a query's plan")):
        sub = commands.add_parser(name, help=text)
        sub.add_argument("query", choices=sorted(catalogue.QUERIES))
        sub.add_argument("--tables", required=True, help="folder of the input tables")
        if name == "run":
            sub.add_argument("--out", required=True, help="folder to write")
            sub.add_argument("--overwrite", action="store_true")
    sub = commands.add_parser("analyze", help="boxes and homographies to placed boxes, cast and paths, as Parquet")
    sub.add_argument("--boxes", required=True, help="Parquet of video_id, frame_idx, x1..y2 and track_id or det_id")
    sub.add_argument("--homographies", required=True, help="Parquet of video_id, frame_idx, h00..h22")
    sub.add_argument("--colours", help="Parquet of video_id, track_id, colour")
    sub.add_argument("--out", required=True, help="folder to write")
    sub.add_argument("--duration", type=float, help="seconds of each match, all by default")
    sub.add_argument("--fps", type=float, default=25.0)
    sub.add_argument("--homography-interval", type=int, default=1)
    sub.add_argument("--dominance", action="store_true", help="write the teams' shares of the pitch too")
    sub = commands.add_parser("dataset", help="list the data sets in a folder, or create one there")
    sub.add_argument("--base", required=True, help="folder of the data sets")
    sub.add_argument("--create", metavar="NAME")
    sub.add_argument("--format", choices=["yolo", "coco", "cvat"], default="yolo")
    sub.add_argument("--train-split", type=float, default=0.8)
    args = parser.parse_args(argv)
    if args.command == "list":
        print("\n".join(sorted(catalogue.QUERIES)))
        return 0
    spark = SparkSession.builder.appName(f"touchline {getattr(args, 'query', args.command)}").getOrCreate()
    if args.command == "analyze":
        return _analyze(spark, args)
    if args.command == "dataset":
        if args.create:
            readers.create_dataset(spark, args.base, args.create, args.format, args.train_split)
        for row in readers.read_datasets(spark, args.base).toLocalIterator():  # a row for each data set
            print(f"{row['name']}\t{row['format']}\t{row['num_images']}\t{row['num_annotations']}")
        return 0
    rows = catalogue.QUERIES[args.query](spark, args.tables)
    if args.command == "explain":
        rows.explain("formatted")
    else:
        rows.write.mode("overwrite" if args.overwrite else "errorifexists").parquet(args.out)
    return 0


def _analyze(spark: SparkSession, args: argparse.Namespace) -> int:
    spark.sparkContext.setCheckpointDir(motion._scratch(spark))
    frames = None if args.duration is None else int(args.duration * args.fps)
    colours = spark.read.parquet(args.colours) if args.colours else None
    made = analysis.analyse(spark.read.parquet(args.boxes), spark.read.parquet(args.homographies), colours, args.homography_interval, frames)
    if args.dominance:
        team = F.regexp_extract("slot_key", r"^T(\d)_", 1)  # the referee's slot has none
        players = made["paths"].filter("x is not null").withColumn("team", F.when(team != "", team).cast("int")).filter("team is not null")
        made["dominance"] = influence.dominance(influence.influence(players))
    for name, rows in made.items():
        rows.write.parquet(f"{args.out}/{name}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
