"""JSON lines of Key and Value; a second run appends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import hadoop_path


def key_value(df: DataFrame) -> DataFrame:
    return df.select(F.coalesce("Key", F.lit("")).alias("Key"), F.coalesce("Value", F.lit("")).alias("Value"))


def write_lines(df: DataFrame, path: str, mode: str = "append") -> None:
    """mode 'errorifexists' is `create`, 'append' creates or appends, 'existing' appends and refuses a target that isn't there."""
    if mode == "existing":
        fs, p = hadoop_path(df.sparkSession, path)
        if not fs.exists(p):
            raise FileNotFoundError(path)
    key_value(df).write.mode("append" if mode == "existing" else mode).json(path)


def json_line(df: DataFrame) -> DataFrame:
    return key_value(df).select(F.to_json(F.struct("Key", "Value")).alias("line"))
