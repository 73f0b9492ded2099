"""Routing, topology, scaling and log replay, as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.hashing import fnv1a32
from ..model import JobSpec


def route_index(key: Column | str, tasks: int) -> Column:
    return (fnv1a32(key) % tasks).cast("int")


def route_order(df: DataFrame, task: str = "task_id") -> DataFrame:
    """Adds the index by which a stage's tasks are addressed: their names in text order, so 10 comes before 2."""
    return df.withColumn("idx", F.row_number().over(W.partitionBy("stage").orderBy(task)) - 1)


def tasks(spark: SparkSession, stages: int, per_stage: int) -> DataFrame:
    return spark.range(stages).select(F.col("id").cast("int").alias("stage")).crossJoin(spark.range(per_stage).select(F.col("id").cast("int").alias("task")))


def task_names(t: DataFrame, started: int) -> DataFrame:
    """Adds task_id: stage, index and the second of the start."""
    return t.withColumn("task_id", F.format_string("task-%d-%d-%d", "stage", "task", F.lit(started).cast("bigint")))


def topology_edges(t: DataFrame) -> DataFrame:
    """Every task to every task of the next stage."""
    a, b = t.select(F.col("stage").alias("from_stage"), F.col("task").alias("from_task")), t.select(F.col("stage").alias("to_stage"), F.col("task").alias("to_task"))
    return a.join(b, F.col("to_stage") == F.col("from_stage") + 1)


def round_robin(t: DataFrame, workers: list[str]) -> DataFrame:
    """Task k goes to worker k modulo their number; tasks in order of stage and index."""
    if not workers:
        raise ValueError("no worker is alive")
    k = F.col("stage") * t.select("task").distinct().count() + F.col("task")
    return t.withColumn("worker", F.element_at(F.array(*[F.lit(w) for w in workers]), (k % len(workers) + 1).cast("int")))


def print_topology(spark: SparkSession, job: JobSpec) -> DataFrame:
    names = F.array(*[F.lit(op.name) for op in job.ops])
    return tasks(spark, job.stages, job.tasks).withColumn("op", F.element_at(names, F.col("stage") + 1))


def throughput(metrics: DataFrame, every: float = 2.0) -> DataFrame:
    """metrics (stage, task, t seconds, received so far) -> rate since the last report.

    The first report counts from zero over `every`; so does one whose counter went back.
    """
    w = W.partitionBy("stage", "task").orderBy("t")
    d, dt = F.col("received") - F.lag("received").over(w), F.col("t") - F.lag("t").over(w)
    rate = F.when(d.isNull() | (dt <= 0), F.col("received") / every).when(d < 0, F.col("received") / dt).otherwise(d / dt)
    return metrics.withColumn("rate", rate)


def stage_rates(rates: DataFrame) -> DataFrame:
    """rates (stage, task, rate): those of one moment, or of each t if they have one."""
    by = ["stage", "t"] if "t" in rates.columns else ["stage"]
    return rates.groupBy(*by).agg(F.sum("rate").alias("rate"), F.count("*").alias("tasks")).withColumn("avg_rate", F.col("rate") / F.col("tasks"))


def bandwidth(messages: DataFrame, every: float) -> DataFrame:
    """messages (node, t seconds, direction, bytes) -> bytes in and out of each node in each `every` seconds, and a second."""
    way = lambda d: F.coalesce(F.sum(F.when(F.col("direction") == d, F.col("bytes"))), F.lit(0))
    g = messages.groupBy("node", F.floor(F.col("t") / every).alias("slice")).agg(way("in").alias("bytes_in"), way("out").alias("bytes_out"))
    return g.withColumns({"rate_in": F.col("bytes_in") / every, "rate_out": F.col("bytes_out") / every})


def scale_decision(stages: DataFrame, low: float, high: float) -> DataFrame:
    """-1 below low while more than one task runs, 1 above high, else 0."""
    return stages.withColumn("delta", F.when((F.col("avg_rate") < low) & (F.col("tasks") > 1), -1).when(F.col("avg_rate") > high, 1).otherwise(0))


def wal_received(log: DataFrame) -> DataFrame:
    """log (seq, type, tuple_id, payload): the last REC record of each tuple."""
    rec = log.where(F.col("type") == "REC")
    return rec.groupBy("tuple_id").agg(F.max_by("payload", "seq").alias("payload"))


def wal_pending(log: DataFrame) -> DataFrame:
    """The last SENT record of each tuple that no later ACK has cleared."""
    marks = log.where(F.col("type").isin("SENT", "ACK"))
    last = marks.groupBy("tuple_id").agg(F.max_by(F.struct("type", "payload"), "seq").alias("r"))
    return last.where(F.col("r.type") == "SENT").select("tuple_id", F.col("r.payload").alias("payload"))


def wal_merge(survivor: DataFrame, killed: DataFrame) -> DataFrame:
    """Both logs as one: the killed task's records come after the survivor's."""
    end = survivor.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("end"))
    moved = killed.crossJoin(F.broadcast(end)).withColumn("seq", F.col("seq") + F.col("end")).drop("end")
    return survivor.unionByName(moved)


def delivery_stats(log: DataFrame) -> DataFrame:
    """Counts of records, and of received tuples whose last REC record doesn't say `Processed` in its JSON payload."""
    is_ = lambda t: F.count_if(F.col("type") == t)
    done = F.coalesce(F.get_json_object("payload", "$.Processed"), F.lit("false")) == "true"
    left = wal_received(log).agg(F.count_if(~done).alias("unprocessed"))
    return log.agg(is_("REC").alias("received"), is_("SENT").alias("sent"), is_("ACK").alias("acked")).crossJoin(left)


def read_wal(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of (type, tuple_id, payload); blank and unreadable lines are skipped."""
    schema = "type string, tuple_id string, payload string"
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).where("type is not null")
