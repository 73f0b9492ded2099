"""The stage operators, each DataFrame -> DataFrame over (ID, Key, Value, Timestamp)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.csvcells import first_cells, nth_cell
from ..jobspec import builtin
from ..streaming.state import running_count_stream


def filter_lines(df: DataFrame, pattern: str | None = None, column: str | int | None = None) -> DataFrame:
    """Keep rows whose Value contains the pattern, a literal. With a column, Key and Value become that CSV cell.

    The column counts from 1; one that isn't a positive number is ignored. A row without the cell is dropped.
    """
    if pattern is None:
        raise ValueError("filter needs a pattern; write 'filter::' for every line")
    kept = df.where(F.contains(F.coalesce("Value", F.lit("")), F.lit(pattern)))
    text = str(column if column is not None else "")
    n = int(text) if text.lstrip("+").isascii() and text.lstrip("+").isdigit() and text.count("+") <= 1 else 0
    if n <= 0:
        return kept
    cell = kept.withColumn("_cell", nth_cell("Value", n)).where(F.col("_cell").isNotNull())
    return cell.withColumns({"Key": F.col("_cell"), "Value": F.col("_cell")}).drop("_cell")


def transform_lines(df: DataFrame) -> DataFrame:
    """Value becomes its first three CSV cells; all else stays."""
    return df.withColumn("Value", first_cells("Value", 3))


def _by_line() -> list[Column]:
    """What orders rows as their source did: its name, the line's number, and a place for each time a line was split up."""
    parts = r"^(.*?)(?:-(\d{1,18}))?((?:#\d{1,9})*)$"
    name = F.coalesce("ID", F.lit(""))
    places = F.transform(F.split(F.regexp_extract(name, parts, 3), "#"), lambda x: x.try_cast("int"))
    return [F.regexp_extract(name, parts, 1), F.coalesce(F.regexp_extract(name, parts, 2).try_cast("bigint"), F.lit(0)), places]


def running_count(df: DataFrame, order: str | None = None, width: int = 100_000) -> DataFrame:
    """For each row its Key and the count of that Key so far, as text; in a stream by arrival.

    In a batch rows are ordered by the bigint `order`, or as their sources were. Each task counts one key's rows in a block
    of `width` numbers, and the blocks' totals, which are few, are summed up in order; so no task ever holds more of a
    hot key than a block.
    """
    if df.isStreaming:
        return running_count_stream(df)
    source, at, child = [F.lit(""), F.col(order), F.lit(0)] if order else _by_line()
    df = df.withColumns({"Key": F.coalesce("Key", F.lit("")), "_s": source, "_at": at, "_c": child, "_b": F.floor(at / width)})
    block = ["Key", "_s", "_b"]
    before = W.partitionBy("Key").orderBy("_s", "_b").rowsBetween(W.unboundedPreceding, -1)
    totals = df.groupBy(*block).agg(F.count("*").alias("_n")).select(*block, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    out = df.withColumn("_i", F.row_number().over(W.partitionBy(*block).orderBy("_at", "_c"))).join(totals, block)
    return out.withColumn("Value", (F.col("_i") + F.col("_before")).cast("string")).drop(*block[1:], "_at", "_c", "_i", "_before")


def final_count(df: DataFrame) -> DataFrame:
    """The last count of each Key."""
    return df.groupBy(F.coalesce("Key", F.lit("")).alias("Key")).agg(F.count("*").cast("string").alias("Value"))


def dedup(df: DataFrame, within: str | None = None) -> DataFrame:
    """One row for each ID. `within` bounds a stream's state: copies that arrive later than that may pass again."""
    if within and df.isStreaming:
        return df.withWatermark("Timestamp", within).dropDuplicatesWithinWatermark(["ID"])
    return df.dropDuplicates(["ID"])


def drop_messages(df: DataFrame, rate: float, seed: int = 0) -> DataFrame:
    """Rows that get through when a share of `rate`, clamped to 0 .. 1, is lost; which ones a hash of ID and seed decides. For tests."""
    kept = round((1 - min(1.0, max(0.0, rate))) * (1 << 30))
    return df.where(F.pmod(F.xxhash64("ID", F.lit(seed)), F.lit(1 << 30)) < kept)


#: A stage is f(df, *args), for batches and streams alike; a stateful one asks df.isStreaming, as `aggregate` does.
REGISTRY: dict[str, Callable[..., DataFrame]] = {
    "filter": lambda df, *a: filter_lines(df, *a[:2]),
    "transform": lambda df, *a: transform_lines(df),
    "aggregate": lambda df, *a: running_count(df),
}


def register(name: str, f: Callable[..., DataFrame]) -> None:
    """Make f(df, *args) a stage of the name."""
    REGISTRY[name] = f


def stage(name: str) -> Callable[..., DataFrame] | None:
    """The stage of a name or, else, of the last part of a path; None if an executable has to run it."""
    return REGISTRY.get(name) or REGISTRY.get(builtin(name))
