"""Helpers shared by the corpus operators: input columns, scratch tables, text primitives."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the operators define it: \x20 and \x09-\x0D.
BLANKS = "\t\n\x0b\x0c\r"


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); where it is unset a temporary one, in local mode alone."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="touchline-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def store(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage: write df as Parquet in the shared folder and read it back.

    The written table survives the loss of any executor. The folder is scratch space:
    nothing removes it before the application that made it has ended.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/touchline/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores in front as it takes to clash with no column of df."""
    known = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in known:
            name = f"_{name}"
        out.append(name)
    return out


def row_hash(df: DataFrame) -> Column:
    """A hash of all columns of a row, but for maps, which have no order."""
    return F.xxhash64(*(F.col(f"`{c}`") for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def blank_to_space(text: Column) -> Column:
    """White space characters become single spaces, one for one."""
    return F.translate(text, BLANKS, " " * len(BLANKS))


def words_of(text: Column) -> Column:
    """The words [^\\x20\\x09-\\x0D]+ of a text as an array; NULL has none."""
    flat = F.trim(blank_to_space(F.coalesce(text, F.lit(""))))
    return F.when(flat == "", F.array().cast("array<string>")).otherwise(F.split(flat, " +"))


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z alone."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def bucket(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; NULL ids count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n
