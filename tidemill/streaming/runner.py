"""Start, watch and stop a job as a stream."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..model import JobSpec
from ..operators.core import dedup
from ..plans.control import scale_decision
from ..plans.pipeline import chain
from ..sources.lines import stream_lines
from ..sources.rated import RatedLines
from ..sources.sinks import key_value

JOB = "tidemill"
#: How often a job without an end writes what has come, and how its stages' counts are called.
FLUSH, COUNTED = "5 seconds", "stage_{}"
# Spark's setting of the state store, and the provider that keeps state on disk.
_STORE, _ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def plan_stream(spark: SparkSession, job: JobSpec) -> DataFrame:
    """A job's rows; with a rate its lines come at most that fast."""
    if job.rate:
        spark.dataSource.register(RatedLines)
        df = spark.readStream.format(RatedLines.name()).option("path", job.source).option("rate", str(job.rate)).load()
        df = df.withColumn("Timestamp", F.current_timestamp())
    else:
        df = stream_lines(spark, job.source)
    return chain(dedup(df) if job.exactly_once else df, job, COUNTED)


@contextmanager
def _on_disk(spark: SparkSession) -> Iterator[None]:
    """State goes to RocksDB in queries started here, unless the session names another store itself."""
    before = spark.conf.get(_STORE)
    if before.rsplit(".", 1)[-1] == "HDFSBackedStateStoreProvider":
        spark.conf.set(_STORE, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_STORE, before)


def start(df: DataFrame, dest: str, checkpoint: str, bounded: bool = True, name: str | None = None) -> StreamingQuery:
    """Append Key and Value to dest; each batch commits its files and its offsets together. bounded: ends with the input."""
    writer = key_value(df).writeStream.format("json").option("checkpointLocation", checkpoint).outputMode("append")
    writer = writer.trigger(availableNow=True) if bounded else writer.trigger(processingTime=FLUSH)
    with _on_disk(df.sparkSession):
        return (writer.queryName(name) if name else writer).start(dest)


def stop_job(spark: SparkSession) -> int:
    """Stop the job that runs, if any; how many were stopped."""
    running = [q for q in spark.streams.active if q.name == JOB]
    for q in running:
        q.stop()
    return len(running)


def run_job(spark: SparkSession, job: JobSpec, checkpoint: str, bounded: bool | None = None) -> StreamingQuery:
    """Stop the job that runs, if any, and start this one: one job at a time. A job with a rate has no end unless it's stopped."""
    stop_job(spark)
    return start(plan_stream(spark, job), job.dest, checkpoint, not job.rate if bounded is None else bounded, JOB)


def live_rates(spark: SparkSession, query: StreamingQuery, job: JobSpec) -> DataFrame:
    """(batch, stage, received, rate, tasks, avg_rate) of a job's last batches, as Spark reports them; a stage's rows are those that left it."""
    rows = []
    for p in query.recentProgress:
        seconds = max(p.durationMs.get("triggerExecution", 0), 1) / 1000
        for k in range(job.stages):
            seen = p.observedMetrics.get(COUNTED.format(k))
            if seen is not None:
                rows.append((p.batchId, k, seen["n"], seen["n"] / seconds, job.tasks, seen["n"] / seconds / job.tasks))
    return spark.createDataFrame(rows, "batch bigint, stage int, received bigint, rate double, tasks int, avg_rate double")


def live_decisions(spark: SparkSession, query: StreamingQuery, job: JobSpec) -> DataFrame:
    """live_rates with delta: what the job's marks ask for; 0 for all if it doesn't scale itself."""
    rates = live_rates(spark, query, job)
    return scale_decision(rates, job.low, job.high) if job.autoscale else rates.withColumn("delta", F.lit(0))
