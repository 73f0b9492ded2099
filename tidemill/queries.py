"""One query for each operator, over the driver's tables, with the same query in SQL."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.csvcells import cells, first_cells
from .functions.hashing import content_hash, fnv1a32, ring_slot
from .operators.core import dedup, filter_lines, final_count, running_count, transform_lines
from .operators.external import external
from .plans import control, store
from .plans.pipeline import chain, plan_batch
from .jobspec import parse_job
from .session import shared_dir
from .sources.lines import numbered, read_lines
from .sources.sinks import json_line, key_value, write_lines
from .streaming.runner import start
from .streaming.state import running_count_stream

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def quoted(c: Column | str) -> Column:
    return F.concat(F.lit('"'), F.replace(F.coalesce(c, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))


def event_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Events as numbered CSV lines `event_id,event_type,user_id,"props"`; event_id orders them."""
    e, n = table(spark, sf, "events"), F.col("event_id").cast("string")
    return e.select(
        F.concat(F.lit("leader-events.csv-"), n).alias("ID"),
        F.concat(F.lit("events.csv:"), n).alias("Key"),
        F.concat_ws(",", n, "event_type", F.col("user_id").cast("string"), quoted("props")).alias("Value"),
        F.col("ts").cast("timestamp").alias("Timestamp"),
        "event_id",
    )


def document_lines(spark: SparkSession, sf: str) -> DataFrame:
    return numbered(table(spark, sf, "documents"), F.concat(F.lit("doc"), F.col("doc_id").cast("string")), F.col("text"))


# Fixed patterns of strict CSV, as SQL text.
_OK = """'("([^"]|"")*"|[^",]*)(,("([^"]|"")*"|[^",]*))*'"""
_CELL = """',("(?:[^"]|"")*"|[^",]*)'"""
_NEEDS = r"""'^\\[.]$|[,"\r\n]|^[ \t\x0b\x0c\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]'"""
_EV = """ev AS (SELECT event_id, 'leader-events.csv-' || event_id AS id, 'events.csv:' || event_id AS k,
  event_id || ',' || event_type || ',' || user_id || ',"' || replace(props, '"', '""') || '"' AS v FROM events)"""
_LINES = """ln AS (SELECT doc_id, i, regexp_replace(parts[i], '\\r$', '') AS v FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM
  (SELECT doc_id, string_split(regexp_replace(text, '\\n$', ''), chr(10)) AS parts FROM documents WHERE length(text) > 0)))"""


def _cells(v: str) -> str:
    return f"CASE WHEN length({v}) > 0 AND regexp_full_match({v}, {_OK}) THEN list_transform(regexp_extract_all(',' || {v}, {_CELL}, 1), lambda c: CASE WHEN starts_with(c, '\"') THEN replace(substr(c, 2, length(c) - 2), '\"\"', '\"') ELSE c END) END"


def _first3(v: str) -> str:
    return f"coalesce(nullif(array_to_string(list_transform(({_cells(v)})[1:3], lambda c: CASE WHEN regexp_matches(c, {_NEEDS}) THEN '\"' || replace(c, '\"', '\"\"') || '\"' ELSE c END), ','), ''), {v})"


def _fnv(k: str) -> str:
    return f"""list_reduce(list_prepend(2166136261::BIGINT, list_transform(range(1, octet_length(encode({k})) + 1),
  lambda i: ('0x' || substr(hex(encode({k})), 2 * i - 1, 2))::BIGINT)), lambda h, b: (xor(h, b) * 16777619) % 4294967296)"""


_RC = "cast(row_number() OVER (PARTITION BY {k} ORDER BY event_id) AS VARCHAR)"
_FLAG = f"""WITH {_EV}, f AS (SELECT event_id, id, ({_cells('v')})[2] AS k FROM ev WHERE contains(v, 'r'))
  SELECT id AS "ID", k AS "Key", {_RC.format(k='k')} AS "Value" FROM f WHERE k IS NOT NULL"""
_ROW = ("ID", "Key", "Value")


@query(f"WITH {_LINES} SELECT 'leader-doc' || doc_id || '-' || i AS \"ID\", 'doc' || doc_id || ':' || i AS \"Key\", v AS \"Value\" FROM ln")
def source_lines(spark, sf):
    return document_lines(spark, sf).select(*_ROW)


@query(f"WITH {_LINES} SELECT 'doc' || doc_id || ':' || i AS \"Key\", v AS \"Value\" FROM ln WHERE contains(v, 'th')")
def filter_contains(spark, sf):
    return key_value(filter_lines(document_lines(spark, sf), "th"))


@query(f"WITH {_EV} SELECT id AS \"ID\", k AS \"Key\", v AS \"Value\" FROM ev")
def filter_empty_pattern(spark, sf):
    return filter_lines(event_lines(spark, sf), "").select(*_ROW)


@query("SELECT cast(p_partkey AS VARCHAR) AS \"Key\", p_brand || '%_.' AS \"Value\" FROM part WHERE contains(p_brand || '%_.', '#2') AND contains(p_brand || '%_.', '%_.')")
def filter_literal_metachar(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("Key"), F.concat("p_brand", F.lit("%_.")).alias("Value"))
    return filter_lines(filter_lines(p, "#2"), "%_.")


@query(f"WITH {_EV} SELECT id AS \"ID\", ({_cells('v')})[4] AS \"Key\", ({_cells('v')})[4] AS \"Value\" FROM ev WHERE contains(v, 'click')")
def filter_column(spark, sf):
    return filter_lines(event_lines(spark, sf), "click", 4).select(*_ROW)


@query(f"WITH {_LINES}, c AS (SELECT doc_id, i, ({_cells('v')})[3] AS c FROM ln) SELECT 'leader-doc' || doc_id || '-' || i AS \"ID\", c AS \"Key\", c AS \"Value\" FROM c WHERE c IS NOT NULL")
def filter_column_missing(spark, sf):
    return filter_lines(document_lines(spark, sf), "", 3).select(*_ROW)


@query(f"WITH {_EV} SELECT id AS \"ID\", k AS \"Key\", v AS \"Value\" FROM ev WHERE contains(v, 'view')")
def filter_bad_column_arg(spark, sf):
    return filter_lines(event_lines(spark, sf), "view", "x2").select(*_ROW)


@query(f"WITH {_EV} SELECT id AS \"ID\", k AS \"Key\", {_first3('v')} AS \"Value\" FROM ev")
def transform_first3(spark, sf):
    return transform_lines(event_lines(spark, sf)).select(*_ROW)


@query(f"WITH {_LINES} SELECT 'doc' || doc_id || ':' || i AS \"Key\", {_first3('v')} AS \"Value\" FROM ln")
def transform_requote(spark, sf):
    return key_value(transform_lines(document_lines(spark, sf)))


@query(f"WITH {_EV} SELECT id AS \"ID\", len({_cells('v')}) AS n, ({_cells('v')})[4] AS c4 FROM ev")
def csv_cells(spark, sf):
    return event_lines(spark, sf).select("ID", F.size(cells("Value")).cast("bigint").alias("n"), F.get(cells("Value"), F.lit(3)).alias("c4"))


@query("SELECT 'e' || event_id AS \"ID\", event_type AS \"Key\", cast(row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS VARCHAR) AS \"Value\" FROM events")
def running_count_by_type(spark, sf):
    e = table(spark, sf, "events").select(F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("ID"), F.col("event_type").alias("Key"), "event_id")
    return running_count(e, "event_id").select(*_ROW)


@query("SELECT event_type AS \"Key\", cast(count(*) AS VARCHAR) AS \"Value\" FROM events GROUP BY event_type")
def final_count_by_type(spark, sf):
    return final_count(table(spark, sf, "events").select(F.col("event_type").alias("Key")))


@query(_FLAG)
def pipeline_filter_aggregate(spark, sf):
    job = parse_job("submit 2 3 filter::r aggregate::2 events.csv out.json true false 100 30 40")
    return chain(event_lines(spark, sf), job).select(*_ROW)


@query(_FLAG.replace("[2]", "[3]").replace("'r'", "'ew'"))
def job_paths(spark, sf):
    """Stages named by paths, quotes round a pattern, and the column moving from the count to the filter."""
    job = parse_job('submit 2 3 "./bin/filter/filter::ew" ./bin/aggregate/aggregate::3 events.csv out.json true false 100 30 40')
    return chain(event_lines(spark, sf), job).select(*_ROW)


@query(_FLAG.replace('id AS "ID"', "event_id").replace('"Value" FROM f', '"Value" FROM f'))
def plan_batch_job(spark, sf):
    """The lines as text files, read and counted as a job in a batch; each line's number in its file orders it."""
    top = f"{shared_dir(spark)}/in"
    event_lines(spark, sf).orderBy("event_id").select("Value").write.text(top)
    job = parse_job(f"submit 2 3 filter::r aggregate::2 {top} out true false 0 30 40")
    lines = read_lines(spark, top).select("ID", F.get(cells("Value"), F.lit(0)).cast("bigint").alias("event_id"))
    return plan_batch(spark, job).join(lines, "ID").select("event_id", "Key", "Value")


@query("SELECT event_type AS \"Key\", cast(row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS VARCHAR) AS \"Value\", 'leader-events.csv-' || event_id AS \"ID\" FROM events")
def pipeline_transform_aggregate(spark, sf):
    """The keys are as the source has them, here the type, since transform leaves them alone."""
    e = event_lines(spark, sf).withColumn("Key", F.get(cells("Value"), F.lit(1)))
    return chain(e, parse_job("submit 2 3 transform aggregate in out true false 0 30 40")).select(*_ROW)


@query(f"""WITH {_EV}, f AS (SELECT event_id, ({_cells('v')})[3] AS k FROM ev WHERE contains(v, 'a')), t AS (SELECT event_id, k FROM f WHERE k IS NOT NULL)
  SELECT k AS "Key", {_RC.format(k='k')} AS "Value" FROM t""")
def pipeline_three_stage(spark, sf):
    return key_value(running_count(transform_lines(filter_lines(event_lines(spark, sf), "a", 3)), "event_id"))


@query(f"SELECT event_id, {_fnv('event_type || event_id')} AS h, cast({_fnv('event_type || event_id')} % 7 AS INTEGER) AS idx FROM events")
def route_index(spark, sf):
    k = F.concat("event_type", F.col("event_id").cast("string"))
    return table(spark, sf, "events").select("event_id", fnv1a32(k).alias("h"), control.route_index(k, 7).alias("idx"))


@query(f"SELECT cast({_fnv('cast(user_id AS VARCHAR)')} % 5 AS INTEGER) AS idx, count(*) AS n FROM events GROUP BY 1")
def route_balance(spark, sf):
    return table(spark, sf, "events").groupBy(control.route_index(F.col("user_id").cast("string"), 5).alias("idx")).agg(F.count("*").alias("n"))


@query("SELECT event_id, cast(('0x' || right(sha1(event_type || event_id), 2)) AS INTEGER) AS slot, sha256(props) AS content FROM events")
def hashes(spark, sf):
    return table(spark, sf, "events").select("event_id", ring_slot(F.concat("event_type", F.col("event_id").cast("string"))).alias("slot"), content_hash("props").alias("content"))


@query(f"WITH {_EV} SELECT id AS \"ID\", k AS \"Key\", v AS \"Value\" FROM ev")
def dedup_by_id(spark, sf):
    e = event_lines(spark, sf)
    return dedup(e.unionByName(e.where("event_id % 3 = 0"))).select(*_ROW)


def _wal(spark, sf, seed: int = 0) -> DataFrame:
    """A log made of events: each is a REC, SENT or ACK of one of 500 tuples."""
    kind = F.element_at(F.array(F.lit("REC"), F.lit("SENT"), F.lit("ACK")), (F.pmod(F.col("event_id") + F.col("user_id") + seed, F.lit(3)) + 1).cast("int"))
    return table(spark, sf, "events").select(F.col("event_id").alias("seq"), kind.alias("type"), F.concat(F.lit("t"), (F.col("user_id") % 500).cast("string")).alias("tuple_id"), F.col("props").alias("payload"))


def _wal_sql(seed: int = 0) -> str:
    return f"SELECT event_id AS seq, ['REC', 'SENT', 'ACK'][(event_id + user_id + {seed}) % 3 + 1] AS type, 't' || (user_id % 500) AS tuple_id, props AS payload FROM events"


_PENDING = "SELECT tuple_id, payload FROM (SELECT *, row_number() OVER (PARTITION BY tuple_id ORDER BY seq DESC) AS rn FROM {l} WHERE type IN ('SENT', 'ACK')) WHERE rn = 1 AND type = 'SENT'"


@query(f"WITH l AS ({_wal_sql()}) {_PENDING.format(l='l')}")
def wal_pending(spark, sf):
    return control.wal_pending(_wal(spark, sf))


@query(f"WITH l AS ({_wal_sql()}) SELECT tuple_id, payload FROM (SELECT *, row_number() OVER (PARTITION BY tuple_id ORDER BY seq DESC) AS rn FROM l WHERE type = 'REC') WHERE rn = 1")
def wal_received(spark, sf):
    return control.wal_received(_wal(spark, sf))


@query(f"WITH a AS ({_wal_sql()}), b AS ({_wal_sql(1)}), l AS (SELECT * FROM a UNION ALL SELECT seq + (SELECT max(seq) FROM a), type, tuple_id, payload FROM b) {_PENDING.format(l='l')}")
def wal_merge(spark, sf):
    return control.wal_pending(control.wal_merge(_wal(spark, sf), _wal(spark, sf, 1)))


@query(f"WITH l AS ({_wal_sql()}) SELECT count(*) FILTER (type = 'REC') AS received, count(*) FILTER (type = 'SENT') AS sent, count(*) FILTER (type = 'ACK') AS acked, (SELECT count(*) FROM (SELECT arg_max(seq, seq) AS seq FROM l WHERE type = 'REC' GROUP BY tuple_id) WHERE seq % 4 <> 0) AS unprocessed FROM l")
def delivery_stats(spark, sf):
    done = F.when(F.col("seq") % 4 == 0, "true").otherwise("false")
    return control.delivery_stats(_wal(spark, sf).withColumn("payload", F.concat(F.lit('{"Processed":'), done, F.lit("}"))))


@query("""SELECT 'vm' || (user_id % 7) AS node, event_id // 50 // 2 AS slice, cast(coalesce(sum(octet_length(encode(props))) FILTER (event_id % 3 = 0), 0) AS BIGINT) AS bytes_in,
  cast(coalesce(sum(octet_length(encode(props))) FILTER (event_id % 3 <> 0), 0) AS BIGINT) AS bytes_out, coalesce(sum(octet_length(encode(props))) FILTER (event_id % 3 = 0), 0) / 2.0::DOUBLE AS rate_in,
  coalesce(sum(octet_length(encode(props))) FILTER (event_id % 3 <> 0), 0) / 2.0::DOUBLE AS rate_out FROM events GROUP BY 1, 2""")
def bandwidth(spark, sf):
    """Bytes a node took in and gave out in each two seconds, 50 events a second."""
    way = F.when(F.col("event_id") % 3 == 0, "in").otherwise("out")
    m = table(spark, sf, "events").select(F.concat(F.lit("vm"), (F.col("user_id") % 7).cast("string")).alias("node"), F.floor(F.col("event_id") / 50).alias("t"), way.alias("direction"), F.octet_length("props").cast("bigint").alias("bytes"))
    return control.bandwidth(m, 2.0)


def _metrics(spark, sf) -> DataFrame:
    u, i = F.col("user_id"), F.col("event_id")
    m = table(spark, sf, "events").select((u % 3).cast("int").alias("stage"), (F.floor(u / 3) % 4).cast("int").alias("task"), (F.floor(i / 500) * 2).cast("bigint").alias("t"), i)
    return m.groupBy("stage", "task", "t").agg(F.count("*").alias("received"))


_METRICS = "m AS (SELECT cast(user_id % 3 AS INTEGER) AS stage, cast(user_id // 3 % 4 AS INTEGER) AS task, event_id // 500 * 2 AS t, count(*) AS received FROM events GROUP BY 1, 2, 3)"
_RATE = f"""{_METRICS}, d AS (SELECT *, received - lag(received) OVER w AS d, t - lag(t) OVER w AS dt FROM m WINDOW w AS (PARTITION BY stage, task ORDER BY t)),
  r AS (SELECT stage, task, t, received, CASE WHEN d IS NULL OR dt <= 0 THEN received / 2.0::DOUBLE WHEN d < 0 THEN received / dt::DOUBLE ELSE d / dt::DOUBLE END AS rate FROM d)"""
_STAGES = f"{_RATE}, s AS (SELECT stage, t, sum(rate) AS rate, count(*) AS tasks, sum(rate) / count(*) AS avg_rate FROM r GROUP BY stage, t)"


@query(f"WITH {_RATE} SELECT stage, task, t, received, rate FROM r")
def stage_throughput(spark, sf):
    return control.throughput(_metrics(spark, sf))


@query(f"WITH {_STAGES} SELECT stage, t, rate, tasks, avg_rate FROM s")
def stage_rates(spark, sf):
    return control.stage_rates(control.throughput(_metrics(spark, sf)))


@query(f"WITH {_STAGES} SELECT stage, t, tasks, CASE WHEN avg_rate < 5 AND tasks > 1 THEN -1 WHEN avg_rate > 9 THEN 1 ELSE 0 END AS delta FROM s")
def autoscale_decision(spark, sf):
    return control.scale_decision(control.stage_rates(control.throughput(_metrics(spark, sf))), 5, 9).select("stage", "t", "tasks", "delta")


@query("SELECT cast(a.s AS INTEGER) AS from_stage, cast(x.t AS INTEGER) AS from_task, cast(a.s + 1 AS INTEGER) AS to_stage, cast(y.t AS INTEGER) AS to_task FROM range(3) a(s), range(4) x(t), range(4) y(t)")
def topology_edges(spark, sf):
    return control.topology_edges(control.tasks(spark, 4, 4))


@query("SELECT cast(s AS INTEGER) AS stage, cast(t AS INTEGER) AS task, 'vm' || ((s * 4 + t) % 3 + 2) AS worker FROM range(3) a(s), range(4) b(t)")
def round_robin_assignment(spark, sf):
    return control.round_robin(control.tasks(spark, 3, 4), ["vm2", "vm3", "vm4"])


@query("SELECT 0 AS stage, t AS task, 'task-0-' || t AS task_id, row_number() OVER (ORDER BY 'task-0-' || t) - 1 AS idx FROM range(12) b(t)")
def route_order(spark, sf):
    t = control.tasks(spark, 1, 12).withColumn("task_id", F.format_string("task-%d-%d", "stage", "task"))
    return control.route_order(t).select("stage", F.col("task").cast("bigint").alias("task"), "task_id", F.col("idx").cast("bigint").alias("idx"))


@query("SELECT event_id, (row_number() OVER (ORDER BY event_id) - 1) // 100 AS second FROM events")
def rate_schedule(spark, sf):
    """The second in which each line leaves a source of 100 lines a second."""
    e = table(spark, sf, "events").select("event_id", F.lit("all").alias("Key"))
    return running_count(e, "event_id").select("event_id", F.floor((F.col("Value").cast("bigint") - 1) / 100).alias("second"))


def _members(spark, sf) -> DataFrame:
    s = table(spark, sf, "supplier").select(F.concat(F.lit("vm"), F.col("s_suppkey").cast("string"), F.lit(":8080")).alias("addr"), (F.col("s_suppkey") % 4 != 0).alias("alive"))
    return s.select("addr", ring_slot("addr").alias("slot"), "alive")


_RING = "m AS (SELECT 'vm' || s_suppkey || ':8080' AS addr, cast(('0x' || right(sha1('vm' || s_suppkey || ':8080'), 2)) AS INTEGER) AS slot, s_suppkey % 4 <> 0 AS alive FROM supplier)"


@query(f"""WITH {_RING}, o AS (SELECT *, row_number() OVER (ORDER BY slot, addr) - 1 AS i, count(*) OVER () AS n FROM m),
  f AS (SELECT p_name || p_partkey AS name, cast(('0x' || right(sha1(p_name || p_partkey), 2)) AS INTEGER) AS slot FROM part),
  p AS (SELECT f.name, arg_min(o.i, (CASE WHEN o.slot >= f.slot THEN 0 ELSE 1000000000 END) + o.i) AS i FROM f, o WHERE o.alive GROUP BY f.name)
  SELECT p.name, cast(r.k AS INTEGER) AS rank, o.addr FROM p, range(3) r(k), o WHERE o.i = (p.i + r.k) % o.n AND r.k < o.n AND o.alive""")
def ring_placement(spark, sf):
    name = F.concat("p_name", F.col("p_partkey").cast("string"))
    return store.ring_placement(table(spark, sf, "part").select(name.alias("name"), ring_slot(name).alias("slot")), _members(spark, sf))


@query(f"""WITH {_RING}, o AS (SELECT *, row_number() OVER (ORDER BY slot, addr) - 1 AS i, count(*) OVER () AS n FROM m WHERE alive)
  SELECT a.addr, cast(r.k AS INTEGER) AS rank, b.addr AS next FROM o a, range(1, 3) r(k), o b WHERE b.i = (a.i + r.k) % a.n AND r.k < a.n""")
def ring_successors(spark, sf):
    return store.successors(_members(spark, sf), 3)


@query("SELECT event_id, CASE WHEN 200 < 40 THEN (user_id % 256 > 200 AND user_id % 256 <= 40) ELSE (user_id % 256 > 200 OR user_id % 256 <= 40) END AS inside FROM events")
def ring_range(spark, sf):
    return table(spark, sf, "events").select("event_id", store.in_range(F.col("user_id") % 256, F.lit(200), F.lit(40)).alias("inside"))


_APP = "ap AS (SELECT 'f' || (user_id % 20) AS file, 'a' || (event_id % 4000) AS append_id, 'c' || (event_id % 3) AS client, md5(props || event_id) AS client_ts, event_id AS arrival FROM events)"


def _appends(spark, sf) -> DataFrame:
    i, u = F.col("event_id"), F.col("user_id")
    s = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    return table(spark, sf, "events").select(s("f", u % 20).alias("file"), s("a", i % 4000).alias("append_id"), s("c", i % 3).alias("client"), F.md5(F.concat("props", i.cast("string"))).alias("client_ts"), i.alias("arrival"))


@query(f"""WITH {_APP}, one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file, append_id ORDER BY arrival) AS rn FROM ap) WHERE rn = 1),
  own AS (SELECT *, row_number() OVER (PARTITION BY file, client ORDER BY client_ts, append_id) AS k FROM one),
  pl AS (SELECT file, client, row_number() OVER (PARTITION BY file, client ORDER BY arrival, append_id) AS k, row_number() OVER (PARTITION BY file ORDER BY arrival, append_id) AS pos FROM one)
  SELECT own.file, own.client, own.append_id, own.client_ts, pl.pos FROM own JOIN pl USING (file, client, k)""")
def append_order(spark, sf):
    return store.append_order(_appends(spark, sf)).select("file", "client", "append_id", "client_ts", F.col("pos").cast("bigint").alias("pos"))


@query(f"""WITH {_APP}, a AS (SELECT DISTINCT file, append_id FROM ap WHERE arrival % 5 <> 0), b AS (SELECT DISTINCT file, append_id FROM ap WHERE arrival % 7 <> 0)
  SELECT file, append_id, 'push' AS action FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT file, append_id, 'pull' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def replica_diff(spark, sf):
    a = _appends(spark, sf)
    part = lambda m: a.where(f"arrival % {m} <> 0").select("file", "append_id").distinct()
    return store.replica_diff(part(5), part(7))


_VIEWS = "v AS (SELECT 'vm' || (user_id % 50) AS addr, ['alive', 'suspect', 'alive', 'alive', 'dead', 'left'][CASE WHEN event_id % 97 = 0 THEN 5 WHEN event_id % 89 = 0 THEN 6 ELSE event_id % 3 + 1 END] AS status, event_id % 11 AS incarnation, event_id % 1009 AS heartbeat FROM events)"


@query(f"""WITH {_VIEWS}, r AS (SELECT *, row_number() OVER (PARTITION BY addr ORDER BY (status IN ('dead', 'left'))::INT DESC, CASE WHEN status IN ('dead', 'left') THEN 0 ELSE incarnation END DESC, (status = 'suspect')::INT DESC, heartbeat DESC, status DESC) AS rn FROM v)
  SELECT addr, status FROM r WHERE rn = 1""")
def member_merge(spark, sf):
    i = F.col("event_id")
    names = F.array(*map(F.lit, ("alive", "suspect", "alive", "alive", "dead", "left")))
    at = F.when(i % 97 == 0, 5).when(i % 89 == 0, 6).otherwise(i % 3 + 1).cast("int")
    v = table(spark, sf, "events").select(F.concat(F.lit("vm"), (F.col("user_id") % 50).cast("string")).alias("addr"), F.element_at(names, at).alias("status"), (i % 11).alias("incarnation"), (i % 1009).alias("heartbeat"))
    return store.member_merge(v).select("addr", "status")


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 AND event_id % 7 > 2 THEN 'dead' WHEN event_id % 2 = 0 THEN 'alive' ELSE 'dead' END AS status, event_id % 2 = 1 AND event_id % 13 > 10 AS removed FROM (SELECT event_id FROM events WHERE event_id % 2 = 0 OR event_id % 7 >= 0)")
def member_liveness(spark, sf):
    i = F.col("event_id")
    m = table(spark, sf, "events").select("event_id", F.when(i % 2 == 0, "alive").otherwise("dead").alias("status"), (100 - F.when(i % 2 == 0, i % 7).otherwise(i % 13)).alias("updated"))
    return store.liveness(m, F.lit(100)).select("event_id", "status", "removed")


@query("SELECT 'events.csv:' || event_id AS \"Key\", event_type AS \"Value\" FROM events")
def sink_key_value(spark, sf):
    """Written as JSON lines in two runs, the second appending, and read back."""
    e = event_lines(spark, sf).join(table(spark, sf, "events").select("event_id", "event_type"), "event_id").withColumn("Value", F.col("event_type"))
    out = f"{shared_dir(spark)}/out"
    write_lines(e.where("event_id % 2 = 0"), out, "errorifexists")
    write_lines(e.where("event_id % 2 <> 0"), out)
    return spark.read.schema("Key string, Value string").json(out)


@query("SELECT '{\"Key\":\"' || page_id || '\",\"Value\":\"' || replace(replace(url, '\\', '\\\\'), '\"', '\\\"') || '\"}' AS line FROM pages")
def sink_json_text(spark, sf):
    return json_line(table(spark, sf, "pages").select(F.col("page_id").cast("string").alias("Key"), F.col("url").alias("Value")))


def _streamed(spark: SparkSession, df: DataFrame, plan, parts: int = 2) -> DataFrame:
    """What a bounded stream over df, in as many files as parts, leaves in its sink after a stop and a restart half way."""
    top = shared_dir(spark)
    for i in range(parts):
        df.where(F.pmod(F.hash("ID"), F.lit(parts)) == i).write.mode("append").json(f"{top}/in")
        s = spark.readStream.schema("ID string, Key string, Value string, Timestamp timestamp").json(f"{top}/in")
        q = start(plan(s), f"{top}/out", f"{top}/state-{uuid.UUID(int=0).hex}")
        q.awaitTermination()
    return spark.read.schema("Key string, Value string").json(f"{top}/out")


@query("SELECT event_type AS \"Key\", cast(row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS VARCHAR) AS \"Value\" FROM events")
def stream_running_count(spark, sf):
    e = event_lines(spark, sf).select("ID", F.get(cells("Value"), F.lit(1)).alias("Key"), "Value", "Timestamp")
    return _streamed(spark, e, running_count_stream)


@query("SELECT event_type AS \"Key\", cast(row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS VARCHAR) AS \"Value\" FROM events")
def stream_exactly_once(spark, sf):
    """Every tuple is sent twice; the counts are those of one delivery."""
    e = event_lines(spark, sf).select("ID", F.get(cells("Value"), F.lit(1)).alias("Key"), "Value", "Timestamp")
    return _streamed(spark, e.unionByName(e), lambda s: running_count_stream(dedup(s)))


@query(f"WITH {_EV} SELECT id AS \"ID\", k AS \"Key\", v AS \"Value\" FROM ev")
def external_operator(spark, sf):
    return external(event_lines(spark, sf), "python3", os.path.join(os.path.dirname(__file__), "operators", "echo_operator.py")).select(*_ROW)
