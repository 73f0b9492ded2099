"""The tuple schema and the job description that every stage shares."""

from __future__ import annotations

from dataclasses import dataclass
from enum import IntEnum

from pyspark.sql import types as T

TUPLE = T.StructType(
    [
        T.StructField("ID", T.StringType()),
        T.StructField("Key", T.StringType()),
        T.StructField("Value", T.StringType()),
        T.StructField("Timestamp", T.TimestampType()),
    ]
)


class TaskStatus(IntEnum):
    RUNNING = 0
    FAILED = 1
    STOPPED = 2


@dataclass(frozen=True)
class StageOp:
    name: str
    args: tuple[str, ...] = ()


@dataclass(frozen=True)
class JobSpec:
    """A linear chain of stages between a line source and a JSON-lines sink."""

    ops: tuple[StageOp, ...]
    tasks: int
    source: str
    dest: str
    exactly_once: bool = True
    autoscale: bool = False
    rate: int = 0
    low: int = 0
    high: int = 0

    @property
    def stages(self) -> int:
        return len(self.ops)
