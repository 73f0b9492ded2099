"""The per-key running count of a stream, kept in Spark's state store."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OUT = "ID string, Key string, Value string, Timestamp timestamp"


def _count(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    (n,) = state.get if state.exists else (0,)
    for f in frames:
        yield f[["ID"]].assign(Key=key[0], Value=[str(n + i) for i in range(1, len(f) + 1)], Timestamp=f["Timestamp"])
        n += len(f)
    state.update((n,))


def running_count_stream(df: DataFrame) -> DataFrame:
    """One row for each row in; counts go on where the checkpoint left them."""
    df = df.select("ID", F.coalesce("Key", F.lit("")).alias("Key"), "Value", "Timestamp")
    return df.groupBy("Key").applyInPandasWithState(_count, OUT, "n bigint", "append", "NoTimeout")
