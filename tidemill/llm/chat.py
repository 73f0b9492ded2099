"""Chat formatting: link tool calls with their results, order them, check their arguments, write canonical JSON.

A message is (conv_id, turn, role, text). An assistant's text may be a JSON object with `tool_calls`, each
{id, name, arguments, depends_on}; a tool's text is a JSON object with `tool_call_id` and `content`. Any other text is
plain content. Calls and results meet by a hash join on (conv_id, id): neither a conversation nor a tool is ever
gathered in one task, so one that holds a third of the rows is no trouble.

Order: (o_turn, o_level, o_index) sorts each conversation topologically. A call stands at its own turn unless one of
the calls that it depends on stands at that turn or later; then it moves to the latest of those, a level further. Only
between the first and the last turn of such backward dependencies can a conversation's calls move or stand on a cycle.
There, calls are placed once all they depend on are, round by round, as many rounds as the longest chain there; no
round can place a call on a cycle. Of those that are left, whom none of the others waits for isn't on a cycle and is placed
after it; the others keep their turn, with the status `cycle`. A result stands a level after its call, or at its own turn if that's later.

Defined cases: null text is empty; null role is `user`; rows with a null conv_id or turn can't be ordered and come back as
messages with the status `unplaced`; rows that repeat one entirely count once; of calls with one id in a conversation the
first by turn and place counts, later ones have the status `duplicate`; of results likewise; a result without a call is an
`orphan`; a call without a result is `unanswered`; dependencies on unknown ids are noted as errors. Text that isn't JSON, or
has numbers beyond a double's range or deeper levels than can be read, is plain content; in JSON's strings, halves of
surrogate pairs become U+FFFD. Texts may be of any length: each is read by itself.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed, tidy

PARTS = "conv_id bigint, turn bigint, o_index bigint, kind string, call_id string, name string, body string, error string, depends array<string>"


def canonical(value) -> str:
    """Keys in order, no white space, no escapes beyond JSON's own; whole floats as integers; NaN and infinities refused."""

    def plain(v):
        if isinstance(v, float) and math.isfinite(v) and v == int(v) and abs(v) < 2**53:
            return int(v)
        if isinstance(v, dict):
            return {str(k): plain(x) for k, x in v.items()}
        return [plain(x) for x in v] if isinstance(v, list) else v

    return json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


# JSON schema's type names.
_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def problems(value, schema: dict, at: str = "$") -> list[str]:
    """What breaks the schema: type, enum, required, properties, additionalProperties, items, bounds and lengths."""
    kind, out = schema.get("type"), []
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    if kind == "number":
        ok = number
    elif kind == "integer":
        ok = number and (isinstance(value, int) or value.is_integer())
    else:
        ok = kind is None or isinstance(value, _TYPES[kind])
    if not ok:
        return [f"{at}: not {kind}"]
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{at}: not one of the values")
    if number and value < schema.get("minimum", -math.inf) or number and value > schema.get("maximum", math.inf):
        out.append(f"{at}: out of bounds")
    if isinstance(value, (str, list)):
        what = "Length" if isinstance(value, str) else "Items"
        if not schema.get(f"min{what}", 0) <= len(value) <= schema.get(f"max{what}", math.inf):
            out.append(f"{at}: wrong length")
    if isinstance(value, list) and "items" in schema:
        out += [p for i, x in enumerate(value) for p in problems(x, schema["items"], f"{at}[{i}]")]
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        out += [f"{at}.{k}: unknown" for k in sorted(value) if k not in known and schema.get("additionalProperties", True) is False]
        out += [p for k in sorted(known) if k in value for p in problems(value[k], known[k], f"{at}.{k}")]
    return out


_HALF = re.compile("[\ud800-\udfff]")


def _finite(text: str) -> float:
    v = float(text)
    if not math.isfinite(v):
        raise ValueError(text)
    return v


def _whole(v):
    """v without halves of surrogate pairs, which UTF-8 can't say."""
    if isinstance(v, str):
        return _HALF.sub("\ufffd", v)
    if isinstance(v, dict):
        return {_whole(k): _whole(x) for k, x in v.items()}
    return [_whole(x) for x in v] if isinstance(v, list) else v


def _refuse(constant: str):
    raise ValueError(constant)


def _object(text: str) -> dict | None:
    if not text.lstrip().startswith("{"):
        return None
    try:
        v = json.loads(text, parse_constant=_refuse, parse_float=_finite)
        v = _whole(v) if isinstance(v, dict) else None
        canonical(v)  # levels that can be read but not written
        return v
    except (ValueError, RecursionError):
        return None


def parts_of(conv: int, turn: int, role: str, text: str, schemas: dict[str, dict]) -> list[tuple]:
    """Rows of PARTS for one message: the message itself, or each of its calls, or a result."""
    v = _object(text) if role in ("assistant", "tool") else None
    if v is not None and role == "tool" and isinstance(v.get("tool_call_id"), str):
        return [(conv, turn, 0, "result", v["tool_call_id"], None, canonical(v.get("content")), None, [])]
    calls = v.get("tool_calls") if v is not None and role == "assistant" else None
    if not isinstance(calls, list):
        return [(conv, turn, 0, "message", None, None, canonical({"content": text, "role": role}), None, [])]
    rows = []
    if v.get("content"):
        rows.append((conv, turn, 0, "message", None, None, canonical({"content": v["content"], "role": role}), None, []))
    for i, c in enumerate(calls, 1):
        c = c if isinstance(c, dict) else {}
        name, args = c.get("name"), c.get("arguments", {})
        if isinstance(args, str):
            args = a if (a := _object(args)) is not None else args
        errors = [] if isinstance(c.get("id"), str) else ["no id"]
        errors += problems(args, schemas[name]) if isinstance(name, str) and name in schemas else ["unknown tool"]
        depends = sorted({d for d in c.get("depends_on") or [] if isinstance(d, str)}) if isinstance(c.get("depends_on"), list) else []
        rows.append((conv, turn, i, "call", c.get("id") if isinstance(c.get("id"), str) else None, name if isinstance(name, str) else None, canonical(args), "; ".join(errors) or None, depends))
    return rows


def parts(messages: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in PARTS.split(", ")]
        for b in batches:
            rows = [p for r in zip(b["conv_id"], b["turn"], b["role"], b["text"], strict=True) for p in parts_of(*map(int, r[:2]), *r[2:], schemas)]
            yield pd.DataFrame(rows, columns=names)

    m = messages.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return m.where("conv_id is not null and turn is not null").distinct().mapInPandas(run, PARTS)


def _unplaced(messages: DataFrame) -> DataFrame:
    """Rows of PARTS of the messages that have no place."""
    role, text = F.coalesce("role", F.lit("user")), F.coalesce("text", F.lit(""))
    m = messages.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), role.alias("role"), text.alias("content"))
    m = m.where("conv_id is null or turn is null").distinct()
    none = lambda kind: F.lit(None).cast(kind)
    return m.select("conv_id", "turn", F.lit(0).cast("bigint").alias("o_index"), F.lit("message").alias("kind"), none("string").alias("call_id"), none("string").alias("name"), F.to_json(F.struct("content", "role")).alias("body"), F.lit("no place").alias("error"), none("array<string>").alias("depends"))


def _first(df: DataFrame) -> DataFrame:
    """Adds dup: whether an earlier row has the same conv_id and call_id."""
    key = df.groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "o_index", "body")).alias("_f"))
    return df.join(key, ["conv_id", "call_id"]).withColumn("dup", F.struct("turn", "o_index", "body") != F.col("_f")).drop("_f")


_ON = ["conv_id", "on"]
_CALL = ["conv_id", "call_id"]


def _peel(edges: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """edges (conv_id, call_id, turn, on, on_turn, t, l), t and l null where the call `on` isn't placed yet -> (places, edges left)."""
    done = []
    while True:
        ready = edges.groupBy(*_CALL, "turn").agg(F.count_if(F.col("t").isNull()).alias("_wait"), F.max(F.struct("t", "l")).alias("d")).where("_wait = 0")
        later = F.col("d.t") >= F.col("turn")
        new = checkpointed(ready.select(*_CALL, F.when(later, F.col("d.t")).otherwise(F.col("turn")).alias("o_turn"), F.when(later, F.col("d.l") + 1).otherwise(0).cast("bigint").alias("o_level")))
        if new.isEmpty():
            return done, edges
        done.append(new)
        if len(done) % 16 == 0:  # a plan of bounded size
            done = [checkpointed(reduce(DataFrame.unionByName, done))]
        edges = checkpointed(_filled(edges.join(new, _CALL, "left_anti"), new))


def _filled(edges: DataFrame, placed: DataFrame) -> DataFrame:
    at = placed.select("conv_id", F.col("call_id").alias("on"), F.col("o_turn").alias("_t"), F.col("o_level").alias("_l"))
    return edges.join(at, _ON, "left").withColumns({"t": F.coalesce("t", "_t"), "l": F.coalesce("l", "_l")}).drop("_t", "_l")


def _levels(calls: DataFrame) -> DataFrame:
    """calls (conv_id, call_id, turn, depends) -> conv_id, call_id, o_turn, o_level, cycle for those that may move."""
    known = calls.select("conv_id", F.col("call_id").alias("on"), F.col("turn").alias("on_turn"))
    edges = checkpointed(calls.select(*_CALL, "turn", F.explode("depends").alias("on")).join(known, _ON))
    span = checkpointed(edges.where("on_turn >= turn").groupBy("conv_id").agg(F.min("turn").alias("_lo"), F.max("on_turn").alias("_hi")))
    edges = edges.join(span, "conv_id").where("turn >= _lo and turn <= _hi and on_turn >= _lo").drop("_lo", "_hi")
    edges = checkpointed(edges)
    waits = edges.select("conv_id", F.col("call_id").alias("on")).distinct().withColumn("_w", F.lit(True))
    free = F.col("_w").isNull()
    edges = edges.join(waits, _ON, "left").withColumns({"t": F.when(free, F.col("on_turn")), "l": F.when(free, F.lit(0).cast("bigint"))}).drop("_w")
    done, left = _peel(checkpointed(edges))
    ring = left.where("t is null")
    many = ring.count()
    while many:  # who waits and is waited for
        ring = checkpointed(ring.join(ring.select("conv_id", F.col("on").alias("call_id")).distinct(), _CALL, "left_semi"))
        before, many = many, ring.count()
        if before == many:
            break
    ring = ring.select(*_CALL, "turn").distinct().select(*_CALL, F.col("turn").alias("o_turn"), F.lit(0).cast("bigint").alias("o_level"))
    if many:
        ring = checkpointed(ring)
        more, _ = _peel(checkpointed(_filled(left.join(ring, _CALL, "left_anti"), ring)))
        done += more
    out = ring.withColumn("cycle", F.lit(True))
    for d in done:
        out = out.unionByName(d.withColumn("cycle", F.lit(False)))
    return out


def link(messages: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """messages -> conv_id, o_turn, o_level, o_index, kind, call_id, status, valid, error, json.

    One row for each message, call (with its result inside) and orphan.
    """
    with tidy(messages.sparkSession):
        return _link(messages, schemas)


def _link(messages: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    p = checkpointed(parts(messages, schemas))
    named = _first(p.where("kind = 'call' and call_id is not null"))
    calls = named.where("not dup")
    results = _first(p.where("kind = 'result'"))
    answer = results.where("not dup").select("conv_id", "call_id", F.col("turn").alias("r_turn"), F.col("body").alias("r_body"))
    moved = _levels(calls.select("conv_id", "call_id", "turn", "depends"))
    unknown = calls.select("conv_id", "call_id", F.explode("depends").alias("on")).join(calls.select("conv_id", F.col("call_id").alias("on")), ["conv_id", "on"], "left_anti")
    unknown = unknown.groupBy("conv_id", "call_id").agg(F.concat(F.lit("depends on unknown "), F.array_join(F.sort_array(F.collect_set("on")), ", ")).alias("_u"))
    c = calls.join(answer, ["conv_id", "call_id"], "left").join(moved, ["conv_id", "call_id"], "left").join(unknown, ["conv_id", "call_id"], "left")
    status = F.when(F.coalesce("cycle", F.lit(False)), "cycle").when(F.col("r_body").isNull(), "unanswered").otherwise("linked")
    quote = lambda c: F.substring(F.to_json(F.array(c)), F.lit(2), F.length(F.to_json(F.array(c))) - 2)
    text = F.concat(F.lit('{"arguments":'), "body", F.lit(',"id":'), quote(F.col("call_id")), F.lit(',"name":'), F.coalesce(quote(F.coalesce("name", F.lit(""))), F.lit("null")), F.when(F.col("r_body").isNotNull(), F.concat(F.lit(',"result":'), "r_body")).otherwise(""), F.lit(',"role":"assistant"}'))
    cols = ["conv_id", "o_turn", "o_level", "o_index", "kind", "call_id", "status", "valid", "error", "json"]
    err = F.nullif(F.concat_ws("; ", "error", "_u"), F.lit(""))
    linked = c.withColumns({"status": status, "json": text, "error": err}).withColumns({"valid": F.col("error").isNull(), "o_turn": F.coalesce("o_turn", "turn"), "o_level": F.coalesce("o_level", F.lit(0)).cast("bigint")})
    none = F.lit(None).cast("string")

    def rest(d: DataFrame, status: str) -> DataFrame:
        return d.withColumns({"status": F.lit(status), "valid": F.col("error").isNull(), "json": F.col("body"), "o_turn": F.col("turn"), "o_level": F.lit(0).cast("bigint")})

    out = [linked, rest(_unplaced(messages), "unplaced"), rest(p.where("kind = 'message'"), "message"), rest(named.where("dup"), "duplicate"), rest(p.where("kind = 'call' and call_id is null"), "unnamed"), rest(results.where("dup"), "duplicate")]
    lost = results.where("not dup").join(calls.select("conv_id", "call_id"), ["conv_id", "call_id"], "left_anti").withColumn("error", F.coalesce("error", none))
    out.append(rest(lost, "orphan"))
    res = out[0].select(*cols)
    for o in out[1:]:
        res = res.unionByName(o.select(*cols))
    return res
