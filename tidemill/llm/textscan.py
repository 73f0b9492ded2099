"""Words of Arrow string columns, found and hashed for many texts at once with numpy.

A word is a run of bytes other than the six of ASCII white space. Its hash is a polynomial, modulo 2^64, over random
64-bit values of its bytes, mixed at the end. Texts are taken in groups of about GROUP bytes; a longer text is a group of
its own, hashed part by part, so what is held beyond a few words each of 8 bytes is bounded by the group.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

GROUP = 1 << 19
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_rng = np.random.default_rng(20240229)
BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: By byte, its lower case: A to Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, n of them at least."""
    if len(_powers[0]) < n:
        m = max(n, GROUP + (1 << 17))
        for k, base in enumerate((_BASE, _INVERSE)):
            step = np.full(m, base, np.uint64)
            step[0] = 1
            _powers[k] = np.multiply.accumulate(step)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def hash_runs(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, rank: np.ndarray | None = None) -> np.ndarray:
    """A hash of values[s:e] for each run; with ranks, bytes of value 0 that don't raise the rank are as if not there."""
    n = len(values)
    up, down = powers(n + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(values * (up[:n] if rank is None else up[rank]), out=total[1:])
        h = (total[ends] - total[starts]) * (down[starts] if rank is None else down[rank[starts]])
    return mix(h)


def small_batches(spark, rows: int = 1000) -> None:
    """Let Spark hand Python at most so many rows at a time in this session: whole texts and sets are wide rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


@dataclass
class Group:
    """Texts first .. last - 1 of a batch. Words lie in data at starts .. ends; text i has words at[i - first] .. at[i - first + 1]."""

    first: int
    last: int
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    at: np.ndarray


def column(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = texts.buffers()
    off = np.frombuffer(off, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), off


def groups(texts: pa.Array) -> Iterator[Group]:
    data, off = column(texts)
    i, n = 0, len(texts)
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + GROUP, side="right")) - 1)
        part = data[off[i] : off[j]]
        word = ~SPACE[part]
        begin = word.copy()
        begin[1:] &= ~word[:-1]
        cut = off[i + 1 : j] - off[i]
        cut = cut[cut < len(part)]
        begin[cut] = word[cut]  # a text starts a word, whatever the text before ends with
        starts = np.flatnonzero(begin)
        stop = word.copy()
        stop[:-1] &= ~word[1:]
        last = cut[cut > 0] - 1
        stop[last] = word[last]
        ends = np.flatnonzero(stop) + 1
        yield Group(i, j, part, starts, ends, np.searchsorted(starts, off[i : j + 1] - off[i]))
        i = j


def word_hashes(g: Group, table: np.ndarray = LOWER) -> np.ndarray:
    """Hashes of a group's words, their bytes taken through the table first."""
    out, k, n = [], 0, len(g.starts)
    value = BYTE[table]
    while k < n:  # parts of a long text; nearly always one
        m = max(k + 1, int(np.searchsorted(g.ends, g.starts[k] + 2 * GROUP, side="right")))
        a, b = g.starts[k], g.ends[m - 1]
        out.append(hash_runs(value[g.data[a:b]], g.starts[k:m] - a, g.ends[k:m] - a))
        k = m
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def combine(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of each k neighbours of h, in order."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        acc = np.zeros(n, np.uint64)
        for i in range(k):
            acc = acc * np.uint64(_BASE) + h[i : i + n]
            acc ^= acc >> np.uint64(29)
    return mix(acc)
