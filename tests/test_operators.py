import random
import time

import pytest
from pyspark.sql import functions as F

from tidemill.functions.csvcells import cells, first_cells
from tidemill.functions.hashing import fnv1a32, ring_slot
from tidemill.jobspec import parse_job, parse_op, tokenize
from tidemill.model import StageOp
from tidemill.operators import core
from tidemill.operators.external import external, parse_envelope
from tidemill.plans import control, store
from tidemill.plans.pipeline import plan_batch
from tidemill.session import shared_dir
from tidemill.sources.lines import list_files, read_lines
from tidemill.sources.rated import RatedLines
from tidemill.sources.sinks import write_lines
from tidemill.streaming.runner import live_decisions, live_rates, plan_stream, run_job, start, stop_job

TUPLE = "ID string, Key string, Value string, Timestamp timestamp"

VECTORS = [
    ("a,b,c,d", ["a", "b", "c", "d"], "a,b,c"),
    ("a, b,c,d", ["a", " b", "c", "d"], 'a," b",c'),
    ('"x,1",y', ["x,1", "y"], '"x,1",y'),
    ('"a""q",z,', ['a"q', "z", ""], '"a""q",z,'),
    ('"",b', ["", "b"], ",b"),
    ('""', [""], '""'),
    (",,", ["", "", ""], ",,"),
    (",", ["", ""], ","),
    (" ", [" "], '" "'),
    ("\ta,b", ["\ta", "b"], '"\ta",b'),
    ("\\.,b", ["\\.", "b"], '"\\.",b'),
    ('a,b,"c ""x"" , d",e', ["a", "b", 'c "x" , d', "e"], 'a,b,"c ""x"" , d"'),
    ("", None, ""),
    ('a"b,c', None, 'a"b,c'),
    ('"open,b', None, '"open,b'),
    ('"a"b,c', None, '"a"b,c'),
]


def strict(line):
    """Cells by a plain state machine; None if malformed."""
    if not line:
        return None
    out, i = [], 0
    while True:
        if i < len(line) and line[i] == '"':
            cell, i = "", i + 1
            while True:
                if i >= len(line):
                    return None
                if line[i] != '"':
                    cell, i = cell + line[i], i + 1
                elif line[i + 1 : i + 2] == '"':
                    cell, i = cell + '"', i + 2
                else:
                    i += 1
                    break
            if i < len(line) and line[i] != ",":
                return None
        else:
            end = line.find(",", i)
            end = len(line) if end < 0 else end
            cell, i = line[i:end], end
            if '"' in cell:
                return None
        out.append(cell)
        if i >= len(line):
            return out
        i += 1


def values(spark, lines):
    return spark.createDataFrame([(i, v) for i, v in enumerate(lines)], "i int, v string")


def test_csv_vectors(spark):
    got = values(spark, [v[0] for v in VECTORS]).select("i", cells("v").alias("c"), first_cells("v").alias("t")).orderBy("i").collect()
    assert [(r.c, r.t) for r in got] == [(c, t) for _, c, t in VECTORS]


def test_csv_random_lines(spark):
    rng = random.Random(5)
    lines = ["".join(rng.choice('ab",  \n') for _ in range(rng.randrange(12))) for _ in range(800)]
    got = values(spark, lines).select("i", cells("v").alias("c")).orderBy("i").collect()
    assert [r.c for r in got] == [strict(x) for x in lines]


def test_long_and_null_lines(spark):
    wide, deep = "a," * 50_000 + '"' + 'x""' * 50_000 + '"', '"' + "y" * 200_000 + '",b,c,d'
    got = values(spark, [wide, deep, None]).select("i", F.size(cells("v")).alias("n"), first_cells("v").alias("t")).orderBy("i").collect()
    assert [(r.n, r.t[:5]) for r in got] == [(50_001, "a,a,a"), (4, "yyyyy"), (None, "")]


def test_hashes(spark):
    got = values(spark, ["", "a", ",", "a,b,c,d", None, "vm1:8080"]).select("i", fnv1a32("v").alias("h"), ring_slot("v").alias("s")).orderBy("i").collect()
    assert [r.h for r in got[:5]] == [2166136261, 3826002220, 688690635, 3678505679, 2166136261]
    assert got[5].s == 13


def test_job_text():
    assert tokenize('a "b c" ""  d') == ["a", "b c", "d"]
    assert parse_op("filter::") == StageOp("filter", ("",)) and parse_op("filter") == StageOp("filter")
    job = parse_job("submit 2 3 filter:: aggregate::7 in out true false 100 30 40")
    assert job.ops == (StageOp("filter", ("", "7")), StageOp("aggregate")) and job.tasks == 3
    assert parse_job("submit 2 3 filter::x::4 aggregate::7 in out true false 0 30 40").ops[0].args == ("x", "4")
    assert parse_job("1 3 transform extra in out true false 0 1 2").stages == 1
    for bad in ("submit 2 3 filter aggregate::7 in out true false 1 2 3", "submit 1 3 in out true", "submit 3 3 transform in out true false 1 2 3", "submit 1 1 transform in out yes false 1 2 3", "submit 1 1 transform in out true false -1 2 3"):
        with pytest.raises(ValueError):
            parse_job(bad)


def test_jobs_by_paths():
    job = parse_job("submit 2 3 ./bin/filter/filter:: ./bin/aggregate/aggregate::7 ./in/d1.csv output.txt true false 100 30 40")
    assert job.ops == (StageOp("./bin/filter/filter", ("", "7")), StageOp("./bin/aggregate/aggregate")) and job.rate == 100
    job = parse_job('submit 2 3 "./bin/filter/filter::JANEY DR" ./bin/aggregate/aggregate::3 ./in/d3.csv out.txt true false 100 40 50')
    assert job.ops[0].args == ("JANEY DR", "3") and not job.ops[1].args
    assert all(core.stage(op.name) for op in job.ops) and core.stage("./bin/own_tool") is None
    assert parse_job("submit 2 1 ./my_filter ./aggregate_all::2::x in out true false 0 1 2").ops == (StageOp("./my_filter", ("2",)), StageOp("./aggregate_all", ("x",)))


def test_line_source(spark, tmp_path):
    (tmp_path / "f1.csv").write_bytes(b"x,a\ny,b\r\nx,c\n\nx,d\n")
    (tmp_path / "empty.csv").write_bytes(b"")
    got = read_lines(spark, str(tmp_path)).orderBy("Key").collect()
    assert [(r.Key, r.Value, r.ID) for r in got] == [(f"f1.csv:{i}", v, f"leader-f1.csv-{i}") for i, v in enumerate(["x,a", "y,b", "x,c", "", "x,d"], 1)]


def test_lines_of_a_file_read_in_splits(spark, tmp_path):
    lines = [f"line {i} " + "x" * (i % 90) for i in range(3000)]
    (tmp_path / "big.txt").write_text("\n".join(lines))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in before:
            spark.conf.set(k, "4k")
        df = read_lines(spark, str(tmp_path))
        assert df.rdd.getNumPartitions() > 8
        assert {r.Key: r.Value for r in df.collect()} == {f"big.txt:{i}": v for i, v in enumerate(lines, 1)}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_listing_and_appending_to_what_is_there(spark, tmp_path):
    (tmp_path / "a.txt").write_text("abc")
    assert [(r.name, r.size) for r in list_files(spark, str(tmp_path)).collect()] == [("a.txt", 3)]
    df = spark.createDataFrame([("k", "v")], "Key string, Value string")
    with pytest.raises(FileNotFoundError):
        write_lines(df, str(tmp_path / "none"), "existing")
    write_lines(df, str(tmp_path / "some"), "errorifexists")
    write_lines(df, str(tmp_path / "some"), "existing")
    assert spark.read.json(str(tmp_path / "some")).count() == 2


def test_shared_folder_is_asked_for_on_a_cluster(spark):
    assert shared_dir(spark) != shared_dir(spark)

    class Cluster:
        conf = {"spark.checkpoint.dir": None}
        sparkContext = type("Context", (), {"master": "spark://host:7077"})  # noqa: N815

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Cluster)


def test_ring_against_a_plain_walk(spark):
    rng = random.Random(4)
    for many, slots in ((40, 6), (3, 256), (1, 256), (2, 1), (60, 256)):
        members = [(f"n{i}", rng.randrange(slots), rng.random() < 0.7) for i in range(many)]
        ring = sorted((s, a, up) for a, s, up in members)
        m = spark.createDataFrame(members, "addr string, slot int, alive boolean")
        want = set()
        for f in range(256):
            at = next((i for i, x in enumerate(ring) if x[2] and x[0] >= f), next((i for i, x in enumerate(ring) if x[2]), None))
            if at is not None:
                want |= {(f, k, ring[(at + k) % many][1]) for k in range(min(3, many)) if ring[(at + k) % many][2]}
        files = spark.range(256).select(F.col("id").alias("name"), F.col("id").cast("int").alias("slot"))
        assert {tuple(r) for r in store.ring_placement(files, m).collect()} == want
        live = [x for x in ring if x[2]]
        want = {(x[1], k, live[(i + k) % len(live)][1]) for i, x in enumerate(live) for k in range(1, min(4, len(live)))}
        assert {tuple(r) for r in store.successors(m, 4).collect()} == want


def test_filter_and_count(spark):
    df = spark.createDataFrame([("1", "k", "x,1,%"), ("2", None, "y,2"), ("3", "k", None), ("4", "k", 'x"')], "ID string, Key string, Value string")
    assert {r.ID for r in core.filter_lines(df, "").collect()} == {"1", "2", "3", "4"}
    assert [r.ID for r in core.filter_lines(df, "%").collect()] == ["1"]
    assert {(r.Key, r.Value) for r in core.filter_lines(df, "", "2").collect()} == {("1", "1"), ("2", "2")}
    assert core.filter_lines(df, "x", "0").count() == 2 and core.filter_lines(df, "x", "two").count() == 2
    with pytest.raises(ValueError):
        core.filter_lines(df)
    assert sorted((r.Key, r.Value) for r in core.running_count(df).collect()) == [("", "1"), ("k", "1"), ("k", "2"), ("k", "3")]
    assert core.final_count(df.limit(0)).count() == 0


def test_running_count_goes_by_line_and_blocks(spark):
    df = spark.range(2000).select(F.concat(F.lit("leader-f-"), F.col("id") + 1).alias("ID"), F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 50).cast("string")).alias("Key"), F.lit("").alias("Value"), F.col("id").alias("n"))
    want, seen = {}, {}
    for i in range(2000):
        k = "hot" if i % 3 == 0 else str(i % 50)
        seen[k] = seen.get(k, 0) + 1
        want[f"leader-f-{i + 1}"] = (k, str(seen[k]))
    for got in (core.running_count(df, "n", 64), core.running_count(df, width=64), core.running_count(df)):
        assert {r.ID: (r.Key, r.Value) for r in got.collect()} == want
    ids = ["leader-b-2", "leader-a-10", "leader-a-9#10", "leader-a-9#2", "leader-a-9#2#1", "other", None]
    got = core.running_count(spark.createDataFrame([(i, "k", "") for i in ids], "ID string, Key string, Value string")).collect()
    order = [r.ID for r in sorted(got, key=lambda r: int(r.Value)) if r.ID and r.ID.startswith("leader")]
    assert len(got) == 7 and order == ["leader-a-9#2", "leader-a-9#2#1", "leader-a-9#10", "leader-a-10", "leader-b-2"]


def test_dropped_messages(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("ID"))
    assert core.drop_messages(df, 0).count() == 1000 and core.drop_messages(df, 1.5).count() == 0
    assert 400 < core.drop_messages(df, 0.5, 3).count() == core.drop_messages(df, 0.5, 3).count() < 600


def test_envelopes():
    assert parse_envelope("no json") == parse_envelope('{"OutputTuples": []}') == parse_envelope('{"OriginalTupleId": "a"}') == []
    two = parse_envelope('{"OriginalTupleId": "a", "OutputTuples": [{"ID": "a", "Key": "k", "Value": "1"}, {"ID": "a", "Key": "k", "Value": "2"}]}')
    assert [t[0] for t in two] == ["a#0", "a#1"]
    assert parse_envelope('{"OriginalTupleId": "a", "OutputTuples": [5, null, {"Key": 7}]}') == [("a#2", "7", "", None)]


def test_external_drops_fans_out_and_fails(spark, tmp_path):
    op = tmp_path / "op.py"
    op.write_text("import json,sys\nfor l in sys.stdin:\n t=json.loads(l)\n v=t['Value']\n if v=='none': continue\n print(json.dumps({'OriginalTupleId':t['ID'],'OutputTuples':[t]*int(v)}))\n")
    df = spark.createDataFrame([("1", "k", "2", None), ("2", "k", "none", None), ("3", "k", "0", None), ("4", "k", "1", None)], TUPLE)
    assert sorted(r.ID for r in external(df, "python3", str(op)).collect()) == ["1#0", "1#1", "4"]
    op.write_text("import sys,time\nfor l in sys.stdin: time.sleep(30)\n")
    with pytest.raises(Exception, match="said nothing"):
        external(df, "python3", str(op), timeout=1).collect()
    op.write_text("raise SystemExit(3)")
    with pytest.raises(FileNotFoundError):
        external(df, "no-such-program-here")
    with pytest.raises(Exception):  # noqa: B017
        external(df.withColumn("Value", F.lit("bad")), "python3", str(op)).collect()


def job_text(src, dest, once="true"):
    return f"submit 2 3 filter:: aggregate::1 {src} {dest} {once} false 0 30 40"


def test_job_as_batch_and_stream_with_restart(spark, tmp_path):
    src, dest, state = tmp_path / "in", tmp_path / "out", tmp_path / "state"
    src.mkdir()
    (src / "a.csv").write_text("x,1\ny,2\nx,3\n")
    job = parse_job(job_text(src, dest))
    read = lambda: sorted((r.Key, r.Value) for r in spark.read.schema("Key string, Value string").json(str(dest)).collect())
    run_job(spark, job, str(state)).awaitTermination()
    assert read() == [("x", "1"), ("x", "2"), ("y", "1")]
    assert read() == sorted((r.Key, r.Value) for r in plan_batch(spark, job).collect())
    (src / "b.csv").write_text("x,9\n")
    run_job(spark, job, str(state)).awaitTermination()
    assert read() == [("x", "1"), ("x", "2"), ("x", "3"), ("y", "1")]


def test_one_job_at_a_time_and_what_it_reports(spark, tmp_path):
    src = tmp_path / "in.txt"
    src.write_text("".join(f"k{i % 3},{i}\n" for i in range(400)))
    job = parse_job(f"submit 2 2 ./bin/filter:: ./bin/aggregate::1 {src} {tmp_path / 'o1'} true true 40 1 3")
    first = run_job(spark, job, str(tmp_path / "s1"))
    try:
        end = time.time() + 90
        while live_rates(spark, first, job).where("received > 0").count() < 2 and time.time() < end:
            time.sleep(1)
        rates = live_decisions(spark, first, job).where("received > 0").collect()
        assert {r.stage for r in rates} == {0, 1} and all(r.rate > 0 and r.delta in (-1, 0, 1) for r in rates)
        second = run_job(spark, parse_job(f"submit 1 2 transform {src} {tmp_path / 'o2'} true false 40 1 3"), str(tmp_path / "s2"))
        assert not first.isActive and second.isActive and second.name == "tidemill"
    finally:
        assert stop_job(spark) == 1
    assert stop_job(spark) == 0
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")
    got = spark.read.schema("Key string, Value string").json(str(tmp_path / "o1")).collect()
    per_key = {k: sorted(int(r.Value) for r in got if r.Key == k) for k in {r.Key for r in got}}
    assert got and all(v == list(range(1, len(v) + 1)) for v in per_key.values())


def test_crash_before_commit_leaves_no_trace(spark, tmp_path):
    src, dest, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    src.mkdir()
    (src / "a.csv").write_text("x,1\nx,2\n")
    df = plan_stream(spark, parse_job(job_text(src, dest)))

    def crash(batch, n):
        batch.count()
        raise RuntimeError("crash")

    with pytest.raises(Exception, match="crash"):
        df.writeStream.foreachBatch(crash).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    start(df, dest, state).awaitTermination()
    assert sorted(r.Value for r in spark.read.schema("Key string, Value string").json(dest).collect()) == ["1", "2"]


def test_rated_source(spark, tmp_path):
    f = tmp_path / "r.txt"
    f.write_text("".join(f"line {i}\n" for i in range(30)))
    spark.dataSource.register(RatedLines)
    q = spark.readStream.format("rated_lines").option("path", str(f)).option("rate", "20").load().writeStream.format("memory").queryName("rated").start()
    try:
        end = time.time() + 60
        while spark.table("rated").count() < 30 and time.time() < end:
            time.sleep(0.5)
    finally:
        q.stop()
    assert sorted(r.Key for r in spark.table("rated").collect()) == sorted(f"r.txt:{i}" for i in range(1, 31))


def test_wal_files(spark, tmp_path):
    (tmp_path / "wal").write_text('{"type":"REC","tuple_id":"a","payload":"1"}\n\nnot json\n{"type":"ACK","tuple_id":"a"}\n')
    assert sorted(r.type for r in control.read_wal(spark, str(tmp_path)).collect()) == ["ACK", "REC"]


def test_routing_keeps_all_rows(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("k"))
    got = {r.i: r["count"] for r in df.groupBy(control.route_index("k", 7).alias("i")).count().collect()}
    assert sum(got.values()) == 1000 and set(got) <= set(range(7))
