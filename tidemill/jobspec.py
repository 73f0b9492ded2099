"""Text of a job command -> JobSpec."""

from __future__ import annotations

import re

from .model import JobSpec, StageOp

_WORD = re.compile(r'(?:"[^"]*"?|[^ \t"])+')
_COUNT = re.compile(r"[+-]?\d+")


def tokenize(line: str) -> list[str]:
    """Words of a command; double quotes group, there are no escapes, and empty words vanish."""
    return [bare for word in _WORD.findall(line) if (bare := word.replace('"', ""))]


def builtin(name: str) -> str:
    """The name by which a stage of this package is known: the last part of a path, without an extension."""
    return re.split(r"[/\\]", name)[-1].split(".")[0] or name


def parse_op(text: str) -> StageOp:
    name, *args = text.split("::")
    return StageOp(name, tuple(args))


def fuse(ops: list[StageOp]) -> list[StageOp]:
    """Give an aggregate's column to the filter just before it, which then projects that column.

    Stages are told by their paths: any that holds `filter`, any that holds `aggregate`. A filter that already has a column
    keeps it; the aggregate's argument goes either way. The filter of this package would take the column for its pattern
    if it had none: that is an error here.
    """
    out = list(ops)
    for i, (before, op) in enumerate(zip(ops, ops[1:], strict=False)):
        if "filter" not in before.name or "aggregate" not in op.name or not op.args:
            continue
        if not before.args and builtin(before.name) == "filter":
            raise ValueError("filter needs a pattern before aggregate::n; write 'filter::' for every line")
        if len(out[i].args) < 2:
            out[i] = StageOp(before.name, (*out[i].args, op.args[0]))
        out[i + 1] = StageOp(op.name, op.args[1:])
    return out


def _flag(word: str) -> bool:
    if word.lower() not in ("true", "false"):
        raise ValueError(f"expected true or false, not {word!r}")
    return word.lower() == "true"


def parse_job(line: str) -> JobSpec:
    """`[command] stages tasks op.. src dest exactly_once autoscale rate low high`. Surplus ops are ignored.

    The command is any word that isn't a number; it says nothing.
    """
    words = tokenize(line)
    if words and not _COUNT.fullmatch(words[0]):
        words = words[1:]
    if len(words) < 10:
        raise ValueError("usage: [command] <stages> <tasks> <op>.. <src> <dest> <exactly_once> <autoscale> <rate> <lw> <hw>")
    n, tasks = int(words[0]), int(words[1])
    ops, (src, dest, once, scale, rate, low, high) = words[2:-7], words[-7:]
    if n < 1 or tasks < 1:
        raise ValueError("stages and tasks start at 1")
    if len(ops) < n:
        raise ValueError(f"{n} stages need {n} operators, not {len(ops)}")
    if int(rate) < 0:
        raise ValueError("the rate is 0 (no limit) or more")
    return JobSpec(tuple(fuse([parse_op(x) for x in ops[:n]])), tasks, src, dest, _flag(once), _flag(scale), int(rate), int(low), int(high))
