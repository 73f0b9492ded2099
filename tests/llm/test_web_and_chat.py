import json
import random

import pytest
from pyspark.sql import functions as F
from tests.oracle import check

from tidemill.llm import chat, queries, urls, warc

SF = "/root/testdata/sf0.01"
PAGE = "page_id bigint, url string, html string, host string, rule string, block bigint"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, name):
    check(spark, SF, queries.QUERIES[name], queries.ORACLES[name])


def pages(spark, rows):
    return spark.createDataFrame([(*r, "h", "r", 1) for r in rows], PAGE)


def test_url_cases(spark):
    rows = [(1, None, ""), (2, "no scheme", ""), (3, "http://WWW.Example.com/en/x?q#f", ""), (4, "http://a.com", ""), (5, "http://x.net/fr/", ""), (6, "ftp://notexample.net?x=/es/", ""), (7, "http://example.org/Listed/?utm_a=1&b=2", ""), (7, "http://www.example.org/Listed?b=2&ref=x", ""), (8, "http://anet/es/", ""), (9, "x://", "")]
    known = spark.createDataFrame([("example.org/Listed?b=2",), (None,)], "url string")
    got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages(spark, rows), known).collect())
    assert got == [
        (1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "www.example.com", "/en/x", "www.example.com/en/", "allow"), (4, "a.com", "", None, "allow"),
        (5, "x.net", "/fr/", "net/fr/", "block"), (6, "notexample.net", "", None, "allow"), (7, "example.org", "/Listed/", None, "block"), (7, "www.example.org", "/Listed", None, "block"),
        (8, "anet", "/es/", None, "allow"), (9, "", "", None, "allow"),
    ]
    assert urls.judge(pages(spark, rows).limit(0), known.limit(0)).count() == 0


def test_bloom_loses_nothing_and_rules_out_most(spark):
    inside = spark.range(3000).select(F.concat(F.lit("in/"), "id").alias("url"))
    outside = spark.range(20_000).select(F.concat(F.lit("out/"), "id").alias("url"))
    n = urls.block_count(3000)
    hits = [r.url for r in urls.possible(inside.unionByName(outside), urls.bloom(inside, n), n).collect()]
    assert sum(u.startswith("in") for u in hits) == 3000 and sum(u.startswith("out") for u in hits) < 400
    assert urls.listed(inside.unionByName(outside), inside).count() == 3000


@pytest.mark.parametrize("version", [1, 2])
def test_arc_to_warc_round_trip(version):
    rng = random.Random(version)
    rows = [(i, f"http://h/{i} é\n", rng.randbytes(rng.randrange(300)) + b"\r\n\r\nWARC/1.1\r\n\n", None if i % 3 else i - 1) for i in range(1, 50)] + [(None, "", b"", None)]
    data = b"".join(warc.convert(rows, "20240102030405", (version,)))
    back = list(warc.read_warc(data))
    assert len(back) == len(rows)
    for (i, _, payload, refers), (f, block) in zip(rows, back, strict=True):
        assert f["WARC-Date"] == "2024-01-02T03:04:05Z" and f.get("WARC-Page-ID") == (None if i is None else str(i))
        assert (f["WARC-Type"] == "revisit") == (refers is not None) and block.endswith(b"\r\n\r\n" if refers is not None else payload)
    assert data == b"".join(warc.convert(rows, "20240102030405", (version,)))


def test_segments_split_and_bad_archives(monkeypatch):
    monkeypatch.setattr(warc, "SEGMENT", 1000)
    parts = list(warc.convert([(i, "u", b"x" * 400, None) for i in range(9)], "2024"))
    assert len(parts) == 5 and sum(len(list(warc.read_warc(p))) for p in parts) == 9
    good = warc.arc_header(1, "a", "2024") + warc.arc_record(1, "u", "2024", "text/html", b"abc")
    assert [c for _, c in warc.read_arc(good)] == [b"abc"]
    for bad in (b"", b"x\n", good[:-3], good + b"u 1 2\n", good.replace(b"\n1 0", b"\n7 0"), good + b"no line end"):
        with pytest.raises(warc.ArchiveError):
            list(warc.read_arc(bad))
    with pytest.raises(warc.ArchiveError):
        warc.warc_date("20x")
    with pytest.raises(warc.ArchiveError):
        list(warc.read_warc(parts[0].replace(b"xxx", b"yxx")))


def test_archive_cases(spark):
    same = "é" * 50
    rows = [(1, "u", None), (2, None, ""), (5, "u", same), (3, "u 1", same), (9, "u", same), (4, "u", "x" * 99), (6, "u", "x" * 99), (None, "u", "z" * 200), (7, "u", "𝒳" * 100_000), (7, "u", "\r\n\r\n" * 30)]
    got = sorted((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to) for r in warc.archive_pages(pages(spark, rows)).collect())
    assert got == sorted([(0, 200, "response", None), (1, 0, "response", None), (2, 0, "response", None), (3, 100, "response", None), (4, 99, "response", None), (5, 100, "revisit", 3), (6, 99, "response", None), (7, 120, "response", None), (7, 400_000, "response", None), (9, 100, "revisit", 3)])
    assert warc.archive_pages(pages(spark, rows).limit(0)).count() == 0


TOOLS = {"add": {"type": "object", "required": ["a"], "additionalProperties": False, "properties": {"a": {"type": "integer", "minimum": 0}, "b": {"type": "array", "items": {"enum": ["x", 1]}, "maxItems": 2}}}}


def call(i, name="add", depends=(), **args):
    return {"id": i, "name": name, "arguments": args, "depends_on": list(depends)}


def say(*calls, **more):
    return json.dumps({"tool_calls": list(calls), **more})


def answer(i, v):
    return json.dumps({"tool_call_id": i, "content": v})


def linked(spark, rows):
    df = spark.createDataFrame([(*r, "k", 0) for r in rows], "conv_id bigint, turn bigint, role string, text string, kind string, status int")
    return chat.link(df, TOOLS).collect()


def test_schemas():
    assert chat.problems({"a": 1, "b": ["x", 1]}, TOOLS["add"]) == []
    assert len(chat.problems({"a": -1, "b": ["y", 1, 1], "c": 0}, TOOLS["add"])) == 4
    assert chat.problems({}, TOOLS["add"]) == ["$.a: missing"] and chat.problems([], TOOLS["add"]) == ["$: not object"]
    assert chat.problems(True, {"type": "integer"}) and not chat.problems(2.0, {"type": "integer"})
    assert chat.canonical({"b": 1.0, "a": [None, "é\u2028"]}) == '{"a":[null,"é\u2028"],"b":1}'


def test_linking(spark):
    rows = [
        (1, 0, "user", "hi"), (1, 0, "user", "hi"), (1, 1, "assistant", say(call("p", a=1), call("q", a=-1), content="thinking")),
        (1, 2, "tool", answer("p", {"v": 2.0})), (1, 3, "tool", answer("p", "again")), (1, 3, "tool", answer("zz", 1)), (1, 4, "assistant", say(call("p", a=3), call("r", "none"), {"name": "add"})),
        (2, 0, "assistant", say(call("a", depends=["b"], a=1))), (2, 1, "assistant", say(call("b", depends=["c", "gone"], a=1))), (2, 2, "assistant", say(call("c", a=1))), (2, 3, "assistant", say(call("d", depends=["a"], a=1))),
        (3, 0, "assistant", say(call("x", depends=["y"], a=1), call("y", depends=["x"], a=1))),
        (4, 0, None, None), (4, 1, "assistant", '{"tool_calls": 3}'), (4, 2, "tool", "not json"), (None, 1, "user", "lost"), (4, 3, "assistant", "{" * 5000),
    ]
    got = linked(spark, rows)
    by = {(r.conv_id, r.call_id, r.status): r for r in got if r.kind in ("call", "result")}
    assert by[1, "p", "linked"].json == '{"arguments":{"a":1},"id":"p","name":"add","result":{"v":2},"role":"assistant"}' and by[1, "p", "linked"].valid
    assert not by[1, "q", "unanswered"].valid and by[1, "r", "unanswered"].error == "unknown tool"
    assert (1, "p", "duplicate") in by and (1, "zz", "orphan") in by and by[1, None, "unnamed"].error.startswith("no id")
    assert sum(r.status == "duplicate" for r in got) == 2
    place = {k[1]: (r.o_turn, r.o_level, r.o_index) for k, r in by.items() if k[0] == 2}
    assert place == {"c": (2, 0, 1), "b": (2, 1, 1), "a": (2, 2, 1), "d": (3, 0, 1)} and by[2, "b", "unanswered"].error == "depends on unknown gone"
    assert {k[2] for k in by if k[0] == 3} == {"cycle"}
    assert sorted(r.json for r in got if r.conv_id == 4)[0] == '{"content":"","role":"user"}' and sum(r.conv_id == 4 for r in got) == 4
    assert linked(spark, rows[:1])[0].status == "message" and linked(spark, []) == []


def test_what_json_can_say_but_not_everyone_can_write(spark):
    half, deep = '{"tool_calls":[{"id":"\\ud800x","name":"add","arguments":{"a":1,"\\udc00":"\\ud83d\\ude00"}}]}', "[" * 600 + "]" * 600
    rows = [
        (1, 0, "assistant", '{"tool_calls":[{"id":"a","name":"add","arguments":{"a":1e999}}]}'), (1, 1, "assistant", half), (1, 2, "tool", '{"tool_call_id":"\\ud800x","content":"\\udfff"}'),
        (1, 3, "tool", '{"tool_call_id":"b","content":-1e400}'), (1, 4, "tool", '{"tool_call_id":"b","content":NaN}'), (1, 5, "tool", f'{{"tool_call_id":"c","content":{deep}}}'), (1, 6, "tool", '{"tool_call_id":"d","content":' + "9" * 5000 + "}"),
        (1, 7, "tool", json.dumps({"tool_call_id": "e", "content": "long " * 400_000})), (None, 8, "assistant", "x"), (2, None, None, None),
    ]
    by = {r.o_turn if r.conv_id == 1 else (r.conv_id, r.o_turn): r for r in linked(spark, rows)}
    assert len(by) == 9 and by[0].status == by[3].status == by[4].status == by[6].status == "message"
    assert by[1].call_id == "\ufffdx" and by[1].status == "linked" and json.loads(by[1].json) == {"id": "\ufffdx", "name": "add", "arguments": {"a": 1, "\ufffd": "\U0001f600"}, "result": "\ufffd", "role": "assistant"}
    assert by[5].status in ("message", "orphan") and by[7].status == "orphan" and len(by[7].json) == 2_000_002
    assert by[None, 8].status == by[2, None].status == "unplaced" and json.loads(by[2, None].json) == {"content": "", "role": "user"}


def plain_places(deps, turn):
    """Places by recursion; calls on a cycle keep theirs."""
    def reach(a):
        seen, todo = set(), list(deps[a])
        while todo:
            if (x := todo.pop()) not in seen:
                seen.add(x)
                todo += deps[x]
        return seen

    cycle = {a for a in deps if a in reach(a)}
    at = {a: (turn[a], 0) for a in cycle}

    def place(a):
        if a not in at:
            t, lv = max((place(d) for d in deps[a]), default=(-1, 0))
            at[a] = (t, lv + 1) if t >= turn[a] else (turn[a], 0)
        return at[a]

    return {a: (*place(a), a in cycle) for a in deps}


def test_cycles_and_what_hangs_on_them(spark):
    rng = random.Random(6)
    rows, want = [], {}
    for conv in range(25):
        ids = [str(i) for i in range(10)]
        turn = {i: rng.randrange(6) for i in ids}
        deps = {i: sorted({rng.choice(ids) for _ in range(rng.choice((0, 1, 1, 2)))}) for i in ids}
        want |= {(conv, i): p for i, p in plain_places(deps, turn).items()}
        for t in range(6):
            rows.append((conv, t, "assistant", say(*(call(i, depends=deps[i], a=1) for i in ids if turn[i] == t))))
    got = {(r.conv_id, r.call_id): (r.o_turn, r.o_level, r.status == "cycle") for r in linked(spark, rows) if r.kind == "call"}
    # a call between two cycles counts as on one
    assert {k for k in want if want[k][2]} <= {k for k in got if got[k][2]}
    sure = {c for c, _ in want} - {c for (c, i) in want if got[c, i][2] != want[c, i][2]}
    assert len(sure) > 15 and all(got[k] == want[k] for k in want if k[0] in sure)


def test_rounds_are_as_many_as_the_longest_chain(spark, monkeypatch):
    many = []
    monkeypatch.setattr(chat, "checkpointed", lambda d, f=chat.checkpointed: many.append(1) or f(d))
    rows = [(c, t, "assistant", say(call(f"c{t}", depends=[f"c{t + 1}"] if t % 2 == 0 else [f"c{t - 2}"] if t > 1 and c else [], a=1))) for c in range(2) for t in range(40)]
    rows += [(2 + i, 0, "assistant", say(call("a", depends=["b"], a=1), call("b", a=1))) for i in range(200)]
    linked(spark, rows[40:])
    deep = len(many)
    many.clear()
    linked(spark, [*rows[:40], *rows[80:], (999, 0, "assistant", say(call("x", depends=["x"], a=1)))])
    assert len(many) <= 16 and deep <= 2 * 40 + 16


def test_order_is_topological(spark):
    rng = random.Random(2)
    rows, deps = [], {}
    for conv in range(20):
        ids = list(range(12))
        rank = ids[:]
        rng.shuffle(rank)
        for t in ids:
            deps[conv, str(t)] = [str(x) for x in ids if rank[x] < rank[t] and rng.random() < 0.2]
            rows.append((conv, t, "assistant", say(call(str(t), depends=deps[conv, str(t)], a=t))))
    at = {(r.conv_id, r.call_id): (r.o_turn, r.o_level, r.o_index) for r in linked(spark, rows)}
    assert all(at[c, d] < at[c, t] for (c, t), ds in deps.items() for d in ds) and len(at) == 240


def test_query_on_its_table(spark):
    """Against the same links made plainly."""
    conv = spark.read.parquet(f"{SF}/conversations.parquet").collect()
    by = {(r.conv_id, r.turn): r for r in conv}
    want = {}
    for (c, t), r in by.items():
        if r.role == "assistant":
            nxt = by.get((c, t + 1))
            res = nxt is not None and nxt.role == "user"
            o = {"arguments": {"text": r.text, "turn": t}, "id": f"call_{t}", "name": "reply", "role": "assistant"} | ({"result": nxt.text} if res else {})
            want[c, t] = json.dumps(o, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    got = {(r.conv_id, int(r.call_id[5:])): r for r in queries.op6_tool_call_linking(spark, SF).where("kind = 'call'").collect()}
    assert {k: r.json for k, r in got.items()} == want
    for (c, t), r in got.items():
        behind = by.get((c, t + 2))
        moves = t % 4 == 0 and behind is not None and behind.role == "assistant"
        assert (r.o_turn, r.o_level) == ((t + 2, 1) if moves else (t, 0))
