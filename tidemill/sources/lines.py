"""Numbered lines of text files, as a table or a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Up to so many splits, a few bytes each, their line counts are sent to all tasks; more are joined.
SPLITS = 200_000


def split_lines(text: Column) -> Column:
    """Lines of a text: a final newline adds no line, and one \\r before a line's end goes. Empty: no lines."""
    body = F.regexp_replace(text, r"\n\z", "")
    return F.when(F.length(text) > 0, F.transform(F.split(body, "\n", -1), _bare)).otherwise(F.array().cast("array<string>"))


def _bare(line: Column) -> Column:
    return F.regexp_replace(line, r"\r\z", "")


def _tuples(df: DataFrame, name: Column, number: Column, value: Column) -> DataFrame:
    n = number.cast("string")
    return df.select(F.concat(F.lit("leader-"), name, F.lit("-"), n).alias("ID"), F.concat(name, F.lit(":"), n).alias("Key"), value.alias("Value"), F.current_timestamp().alias("Timestamp"))


def numbered(df: DataFrame, name: Column, text: Column) -> DataFrame:
    """(ID, Key, Value, Timestamp) rows: Key is name:line, lines count from 1 and blank ones count too."""
    lined = df.select(name.alias("_name"), F.posexplode(split_lines(F.coalesce(text, F.lit("")))).alias("_pos", "_line"))
    return _tuples(lined, F.col("_name"), F.col("_pos") + 1, F.col("_line"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """A file, or the files right inside a folder; large files are read in splits.

    A line's number is its place in its split and the lines of the splits before it, which are counted first.
    """
    m = lambda c: F.col(f"_metadata.{c}")
    df = spark.read.option("lineSep", "\n").text(path, recursiveFileLookup=False)
    few = len(df.inputFiles()) + df.rdd.getNumPartitions() <= SPLITS
    df = df.select(m("file_path").alias("_f"), m("file_name").alias("_name"), m("file_block_start").alias("_s"), F.monotonically_increasing_id().alias("_i"), "value")
    splits = df.groupBy("_f", "_s").agg(F.min("_i").alias("_first"), F.count("*").alias("_n"))
    before = W.partitionBy("_f").orderBy("_s").rowsBetween(W.unboundedPreceding, -1)
    splits = splits.select("_f", "_s", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    df = df.join(F.broadcast(splits) if few else splits, ["_f", "_s"])
    return _tuples(df, F.col("_name"), F.col("_i") - F.col("_first") + F.col("_before") + 1, _bare(F.col("value")))


def stream_lines(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of the files of a folder; a file is one row until it is split into lines, so an executor's memory bounds its size."""
    reader = spark.readStream.option("wholetext", True).format("text").schema("value string")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return numbered(reader.load(path), F.col("_metadata.file_name"), F.col("value"))


def read_appended(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a sink folder, base and appends alike."""
    return spark.read.schema("Key string, Value string").json(path)


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(name, path, size, modified) of the files of a folder; no content is read."""
    df = spark.read.format("binaryFile").load(path)
    return df.select(F.element_at(F.split("path", "/"), -1).alias("name"), "path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
