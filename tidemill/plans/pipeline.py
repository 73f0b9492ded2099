"""JobSpec -> DataFrame. Stateless stages fuse into one Spark stage; only counts shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import JobSpec
from ..operators.core import stage
from ..operators.external import external
from ..sources.lines import read_lines


def chain(df: DataFrame, job: JobSpec, counted: str | None = None) -> DataFrame:
    """All stages of a job over df. counted: what to call the counts of rows that each stage hands on, in a stream's reports."""
    for i, op in enumerate(job.ops):
        f = stage(op.name)
        df = f(df, *op.args) if f else external(df, op.name, *op.args)
        if counted:
            df = df.observe(counted.format(i), F.count(F.lit(1)).alias("n"))
    return df


def plan_batch(spark: SparkSession, job: JobSpec) -> DataFrame:
    """A job over what its source holds now. A batch has no clock, so the rate says nothing here."""
    return chain(read_lines(spark, job.source), job)
