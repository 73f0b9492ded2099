"""Placement and bookkeeping of a replicated file store, as queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: Slots of a ring; what is made for each slot is bounded by them, whatever the number of members or files.
SLOTS = 256


def _heads(members: DataFrame, n: int) -> DataFrame:
    """(slot, the first n members there, in order)."""
    first = members.withColumn("_k", F.row_number().over(W.partitionBy("slot").orderBy("addr"))).where(F.col("_k") <= n)
    return first.groupBy("slot").agg(F.sort_array(F.collect_list(F.struct("addr", "alive"))).alias("heads"))


def _ring(slots: DataFrame, *more: str) -> DataFrame:
    """One row: an array of the slots that have members, in order."""
    return slots.agg(F.sort_array(F.collect_list(F.struct("slot", "heads", *more))).alias("ring"))


def _onward(at: Column) -> Column:
    """The heads of the slots after the at-th of the ring, round to that one itself."""
    n = F.size("ring")
    return F.flatten(F.transform(F.sequence(F.lit(1), n), lambda k: F.get("ring", ((at + k) % n).cast("int"))["heads"]))


def ring_placement(files: DataFrame, members: DataFrame, replicas: int = 3) -> DataFrame:
    """files (name, slot), members (addr, slot, alive) -> the nodes that hold each file.

    The primary is the first live member at or after the file's slot, round the ring; the replicas are the next members
    of the ring, of which dead ones are skipped and not replaced. All files of a slot lie on the same nodes, so only the
    SLOTS places are worked out, from a few members of each slot, and files look theirs up.
    """
    live = members.where("alive").groupBy("slot").agg(F.min("addr").alias("_live"))
    tails = _heads(members.join(F.broadcast(live), "slot").where(F.col("addr") >= F.col("_live")), replicas).withColumnRenamed("heads", "tail")
    ring = _ring(_heads(members, replicas).join(tails, "slot", "left"), "tail").crossJoin(members.agg(F.count("*").alias("_n")))
    at = members.sparkSession.range(SLOTS).select(F.col("id").cast("int").alias("slot")).crossJoin(ring)
    able = F.filter("ring", lambda m: m["tail"].isNotNull())
    at = at.withColumn("_p", F.coalesce(F.get(F.filter(able, lambda m: m["slot"] >= F.col("slot")), F.lit(0)), F.get(able, F.lit(0)))).where("_p is not null")
    at = at.withColumn("_i", F.array_position(F.transform("ring", lambda m: m["slot"]), F.col("_p")["slot"]) - 1)
    nodes = F.slice(F.concat(F.col("_p")["tail"], _onward(F.col("_i"))), F.lit(1), F.least(F.lit(replicas), "_n").cast("int"))
    at = at.select("slot", F.posexplode(nodes).alias("rank", "_m")).where("_m.alive").select("slot", "rank", "_m.addr")
    return files.join(F.broadcast(at), "slot").select("name", "rank", "addr")


def in_range(x: Column, start: Column, end: Column) -> Column:
    """x in (start, end] on the ring; the whole ring if both are equal."""
    return F.when(start < end, (x > start) & (x <= end)).otherwise((x > start) | (x <= end))


def successors(members: DataFrame, n: int) -> DataFrame:
    """For each live member its next n - 1 live members round the ring: those of its slot, then the next slots' first ones."""
    live = members.where("alive")
    ring = _ring(_heads(live, n)).crossJoin(live.agg(F.count("*").alias("_n")))
    after = ring.select("ring", "_n", F.posexplode(F.transform("ring", lambda m: m["slot"])).alias("_i", "slot"))
    after = after.select("slot", F.least(F.lit(n), "_n").cast("int").alias("_k"), F.slice(F.transform(_onward(F.col("_i")), lambda m: m["addr"]), 1, n).alias("_after"))
    w = W.partitionBy("slot").orderBy("addr")
    own = live.withColumn("_own", F.array_compact(F.array(*[F.lead("addr", k).over(w) for k in range(1, n)]).cast("array<string>")))
    own = own.join(F.broadcast(after), "slot").where("_k > 1")
    found = own.select("addr", F.posexplode(F.slice(F.concat("_own", "_after"), F.lit(1), F.col("_k") - 1)).alias("_i", "next"))
    return found.select("addr", (F.col("_i") + 1).alias("rank"), "next")


def append_order(appends: DataFrame) -> DataFrame:
    """appends (file, append_id, client, client_ts, arrival): one row for each ID, numbered by each client's own times and else by arrival.

    A client's appends take, in the order of their times (as text), the places at which that client's appends arrived.
    """
    first = appends.groupBy("file", "append_id").agg(F.min_by(F.struct("client", "client_ts", "arrival"), "arrival").alias("a")).select("file", "append_id", "a.*")
    own = first.withColumn("_k", F.row_number().over(W.partitionBy("file", "client").orderBy("client_ts", "append_id")))
    places = first.select("file", "client", "arrival", F.row_number().over(W.partitionBy("file", "client").orderBy("arrival", "append_id")).alias("_k"), F.row_number().over(W.partitionBy("file").orderBy("arrival", "append_id")).alias("pos"))
    return own.drop("arrival").join(places.drop("arrival"), ["file", "client", "_k"]).drop("_k")


def replica_diff(here: DataFrame, there: DataFrame) -> DataFrame:
    """(file, append_id) on this replica only (push) or on the other only (pull)."""
    push = here.join(there, ["file", "append_id"], "left_anti").withColumn("action", F.lit("push"))
    return push.unionByName(there.join(here, ["file", "append_id"], "left_anti").withColumn("action", F.lit("pull")))


def member_merge(views: DataFrame) -> DataFrame:
    """views (addr, status, incarnation, heartbeat) of many nodes -> one row each.

    Gone (dead, left) beats all; then the higher incarnation; then suspect beats alive; then the higher heartbeat.
    """
    gone = F.col("status").isin("dead", "left").cast("int")
    rank = F.struct(gone, F.when(gone == 0, F.col("incarnation")), (F.col("status") == "suspect").cast("int"), F.col("heartbeat"), F.col("status"))
    best = views.groupBy("addr").agg(F.max_by(F.struct("status", "incarnation", "heartbeat"), rank).alias("m"))
    return best.select("addr", "m.*")


def liveness(members: DataFrame, now: Column, suspicion: bool = False, fail_s: float = 2, cleanup_s: float = 10) -> DataFrame:
    """members (addr, status, updated seconds) -> status and whether the row goes."""
    age, s = now - F.col("updated"), F.col("status")
    late = age > fail_s
    new = F.when((s == "alive") & late, F.lit("suspect" if suspicion else "dead")).when((s == "suspect") & late, F.lit("dead")).otherwise(s)
    return members.withColumns({"status": new, "removed": (s == "dead") & (age > cleanup_s)})
