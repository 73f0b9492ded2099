"""Scores of texts by a causal self-attention model over subword ids, beside a base of word counts.

The model. Subwords are pieces of a public SentencePiece vocabulary, made of the lower-cased words between white space.
The commonest of all training texts are the model's ids; one more stands for the others, which share its probability by
their counts. The next id is drawn in two steps, its class and then the class's member, each by a softmax. One head of
causal attention, with a bias for each distance, looks at up to CONTEXT + STRIDE ids; what it returns is added to the log
odds of both steps, which the id before gives them. All parts sum to one, so a score is a logarithm of a probability.

What the tables of the id before hold comes from all training texts, whole ones: Spark counts their words, and each
distinct word, once, gives the pairs of ids inside it; from a word's last id to the next word's first, or to the end, the
table has how often the one ends words and the other begins them. The driver gets a row for each pair of the model's ids at most.
The attention's weights learn in numpy, by hand-written gradients and Adam, from all windows of all training texts, each once.
Windows are dealt to shards by hashes of their texts; each shard's task goes on from the same weights, by ever smaller steps,
and the mean of what the shards arrive at, by their windows, is the model's. Shards and their order don't depend on the
cluster. The weights that all start from are the driver's, who learnt them from some windows that begin with words drawn by a
hash of the text; that is where learning begins, and no window is left out by it.

Scoring. Windows overlap: each begins CONTEXT ids before the ids that it scores, and each id is scored once. Windows of
many texts go through masked attention together. Queries, keys and values depend on an id alone, so they are tables.

The base is exact. All tasks get the counts of the commonest words, COMMON of them at most; of its other words a text hands
on its numbers, which meet their counts in a join; so texts are never shuffled, and no task holds more than a batch of them.
Common words are told by 64-bit hashes.

Null text is empty: no word, just the end. Null ids are kept, and their text form is taken as empty for the fold. Rows
that repeat an id each get their scores, and each counts. With no training rows the model is uniform. Other columns are left out.
"""

from __future__ import annotations

import copy
import math
import random
import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_dir, tidy
from . import textscan
from .pieces import load

IDS, DIM, CONTEXT, STRIDE = 2047, 24, 8, 16
STEPS, BATCH, RATE, DISCOUNT = 500, 192, 0.01, 0.75
WINDOW = CONTEXT + STRIDE
#: Of so many windows as many are drawn for the weights to start from.
WINDOWS = 96_000
#: Windows of a shard, about, how many of them a step takes, and its first rate; windows of one text that go to a shard together.
SHARD, SHARD_BATCH, SHARD_RATE, TOGETHER = 200_000, 768, 0.005, 1024
#: Windows that go through attention, and targets through the softmax of classes, before the next do.
FEW, ROWS = 128, 2048
#: From so many rows on, an id's are summed by a product.
OFTEN = 24
#: Rows by which shards' weights come to the driver.
SUMS = 16
#: Words before a drawn window's first new one, and from that on: so many mostly have ids enough, and the second numbers always.
NEAR_WORDS = ((6, 10), (CONTEXT + 1, STRIDE))
#: Characters of a window's new ids, about.
WINDOW_CHARS = 4 * STRIDE
#: Words that a task remembers, and bytes of a text that it cuts at once.
WORDS_HELD, CUT = 500_000, 1 << 20
#: Bytes of texts that go through the model together.
PART = 1 << 21
#: Words whose counts all tasks get.
COMMON = 1 << 20
#: Bound of scores before the exponential, in 32 bits.
MOST = np.float32(60)
HELD_OUT = 2
#: Spark's seed of its 64-bit hash.
SEED = 42


def fold(doc_id: str) -> int:
    return zlib.crc32(doc_id.encode()) % 7


class Subwords:
    """Ids of lower-cased words; a word's ids don't depend on what stands beside it."""

    def __init__(self, model: bytes):
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.size = self.sp.get_piece_size()

    def words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of words."""
        # white space inside a word beyond ASCII stays there
        got = self.sp.encode([w.decode("utf-8", "replace") for w in words], num_threads=1) if words else []
        at = np.zeros(len(got) + 1, np.int64)
        np.cumsum([len(g) for g in got], out=at[1:])
        flat = np.fromiter(chain.from_iterable(got), np.int32, int(at[-1]))
        return flat, at


def expand(flat: np.ndarray, at: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs flat[at[i]:at[i + 1]] of each i of which, end to end, with their offsets."""
    sizes = np.diff(at)[which]
    out = np.zeros(len(which) + 1, np.int64)
    np.cumsum(sizes, out=out[1:])
    return flat[np.repeat(at[:-1][which] - out[:-1], sizes) + np.arange(out[-1])], out


def shifted(ids: np.ndarray, at: np.ndarray, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Inputs (the start, then the ids) and targets (the ids, then the end) of texts ids[at[i]:at[i + 1]], end to end."""
    sizes = np.diff(at) + 1
    first = at[:-1] + np.arange(len(sizes))
    x = np.full(len(ids) + len(sizes), start, np.int32)
    y = np.full(len(x), end, np.int32)
    begins, ends = np.zeros(len(x), bool), np.zeros(len(x), bool)
    begins[first] = True
    x[~begins] = ids
    ends[first + sizes - 1] = True
    y[~ends] = ids
    return x, y


def slide(x: np.ndarray, y: np.ndarray, at: np.ndarray, none: int, chosen=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(inputs, targets, text) of the windows of shifted texts, or of those that chosen(text, place in it) says."""
    sizes = np.diff(at) + 1
    many = -(-sizes // STRIDE)
    ends = np.cumsum(many)
    text = np.repeat(np.arange(len(sizes)), many)
    # texts stand CONTEXT and more places apart, and each begins a stride; so windows are strides and what stands before them
    gap = -(-CONTEXT // STRIDE)
    stride = np.arange(len(text)) + gap * (text + 1)
    y_at = np.repeat((ends - many) * STRIDE - np.cumsum(sizes) + sizes, sizes) + np.arange(len(x))
    all_x = np.full((len(text) + gap * len(sizes)) * STRIDE, none, x.dtype)
    all_x[y_at + np.repeat(gap * STRIDE * np.arange(1, len(sizes) + 1), sizes)] = x
    all_y = np.full(len(text) * STRIDE, -1, y.dtype)
    all_y[y_at] = y
    all_y = all_y.reshape(-1, STRIDE)
    if chosen is not None:
        some = chosen(text, np.arange(len(text)) - np.repeat(ends - many, many))
        text, stride, all_y = text[some], stride[some], all_y[some]
    if not len(text):
        return np.zeros((0, WINDOW), x.dtype), all_y, text
    return np.lib.stride_tricks.sliding_window_view(all_x, WINDOW)[stride * STRIDE - CONTEXT], all_y, text


class Room:
    """Arrays that are used again and again, so that memory isn't handed back and asked for in between."""

    def __init__(self):
        self.held: dict[str, np.ndarray] = {}

    def of(self, name: str, *shape: int) -> np.ndarray:
        """Of this shape, with whatever it held before."""
        size = math.prod(shape)
        if name not in self.held or self.held[name].size < size:
            self.held[name] = np.empty(size, np.float32)
        return self.held[name][:size].reshape(shape)


class Model:
    """Numbers: 0 .. n - 1 the common ids, n all others, n + 1 the end, n + 2 the start, n + 3 nothing.

    Targets stand in the order of their counts, and a class is `width` neighbours there: place // width of them.
    """

    def __init__(self, size: int, sample: list[np.ndarray]):
        """sample: ids of texts, all of which are learnt from."""
        ids = np.concatenate(sample) if sample else np.zeros(0, np.int32)
        at = np.concatenate([[0], np.cumsum([len(t) for t in sample])]).astype(np.int64)
        self._number(size, np.bincount(ids, minlength=size))
        x, y = shifted(self.number[ids], at, self.start, self.end)
        joint = np.zeros((self.n + 3, self.n + 2), np.float32)
        np.add.at(joint, (x, y), 1)
        self._learn(joint, *slide(x, y, at, self.none)[:2])

    @classmethod
    def of(cls, size: int, count: np.ndarray, pairs, drawn, rest) -> Model:
        """count: of each id of the vocabulary. pairs(model): the counts of numbers given the number before.

        drawn(model): windows to start from; rest(model): the weights after all windows, and how many these were.
        """
        self = cls.__new__(cls)
        self._number(size, count)
        self._learn(pairs(self), *drawn(self), rest)
        return self

    def _number(self, size: int, count: np.ndarray) -> None:
        self.size = size
        common = np.argsort(-count, kind="stable")[:IDS]
        common = common[count[common] > 0]
        n = self.n = len(common)
        self.other, self.end, self.start, self.none = n, n + 1, n + 2, n + 3
        self.number = np.full(size, n, np.int32)
        self.number[common] = np.arange(n)
        # of an id that is none of the common ones, its share of those by counts; 0 for common ones
        rest = self.number == n
        self.outside = np.zeros(size, np.float32)
        self.outside[rest] = np.log((count[rest] + 0.5) / (count[rest] + 0.5).sum())

    def _learn(self, joint: np.ndarray, all_x: np.ndarray, all_y: np.ndarray, rest=None) -> None:
        n = self.n
        self._classes(joint)
        rng = np.random.default_rng(11)
        r = lambda spread, *shape: rng.normal(0, spread, shape).astype(np.float32)
        self.p = {
            "e": r(0.3, n + 4, DIM), "q": r(0.3, DIM, DIM), "k": r(0.3, DIM, DIM), "v": r(0.3, DIM, DIM),
            "o": r(0.05, DIM, self.classes), "m": r(0.05, self.classes * self.width, DIM), "d": np.zeros(WINDOW, np.float32),
        }
        if len(all_x):
            self._train(all_x, all_y, rng)
        if rest:
            self.p, self.learnt = rest(self)
        self._tables()

    def _classes(self, joint: np.ndarray) -> None:
        """Places of targets, and the log odds that the id before gives to classes and to their members.

        Absolute discounts; what they free goes to how many different ids each one follows.
        """
        n = self.n
        self.width = w = math.isqrt(n + 1) + 1
        self.classes = c = -(-(n + 2) // w)
        order = np.argsort(-joint.sum(0, dtype=np.float64), kind="stable")
        self.place = np.empty(n + 2, np.int32)
        self.place[order] = np.arange(n + 2)
        follows = np.zeros(c * w, np.float32)
        follows[: n + 2] = ((joint > 0).sum(0) + 0.5)[order]
        follows = follows.reshape(c, w)
        per_class = follows.sum(1)
        within, prior = follows / per_class[:, None], per_class / per_class.sum()
        self.given = np.empty((n + 3, c), np.float32)
        self.member = np.empty((c, n + 3, w), np.float32)
        for lo in range(0, n + 3, 256):
            part = np.zeros((min(256, n + 3 - lo), c * w), np.float32)
            part[:, : n + 2] = joint[lo : lo + 256][:, order]
            part = part.reshape(-1, c, w)
            kinds, mine = (part > 0).sum(2), part.sum(2)
            total, any_ = mine.sum(1, keepdims=True), (mine > 0).sum(1, keepdims=True)
            self.given[lo : lo + 256] = np.log(np.where(total > 0, (np.maximum(mine - DISCOUNT, 0) + DISCOUNT * any_ * prior) / np.maximum(total, 1), prior))
            p = np.where(mine[:, :, None] > 0, (np.maximum(part - DISCOUNT, 0) + DISCOUNT * kinds[:, :, None] * within) / np.maximum(mine, 1e-9)[:, :, None], within)
            # the last class's places that no target has
            self.member[:, lo : lo + 256] = np.log(np.maximum(p, 1e-30)).transpose(1, 0, 2)
        self.member.reshape(c, n + 3, w)[-1, :, n + 2 - (c - 1) * w :] = -1e4

    def _bias(self) -> np.ndarray:
        """Of each scored place against each place of its window: by distance, and none of what follows."""
        i, j = np.arange(CONTEXT, WINDOW)[:, None], np.arange(WINDOW)[None, :]
        return np.where(j <= i, self.p["d"][np.clip(i - j, 0, WINDOW - 1)], np.float32(-1e4))

    def _by_class(self, place: np.ndarray) -> tuple[np.ndarray, list[tuple[int, slice]]]:
        """An order of targets' places by class, and the classes with their rows in it."""
        c = (place // self.width).astype(np.uint8)
        by = np.argsort(c, kind="stable")
        cuts = np.searchsorted(c[by], np.arange(self.classes + 1)).tolist()
        return by, [(k, slice(a, b)) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a]

    def _train(self, all_x: np.ndarray, all_y: np.ndarray, rng: np.random.Generator) -> None:
        # every window once, dealt out at random, and again from the first on if there are few
        order, steps = rng.permutation(len(all_x)), round(STEPS * max(1, len(all_x) / WINDOWS))
        self._descend(all_x, all_y, (order[np.arange((step - 1) * BATCH, step * BATCH) % len(order)] for step in range(1, steps + 1)), lambda step: RATE)

    def go_on(self, all_x: np.ndarray, all_y: np.ndarray) -> int:
        """Learn from each of these windows once, by ever smaller steps; how many there were."""
        order = np.random.default_rng(13).permutation(len(all_x))
        steps = -(-len(order) // SHARD_BATCH)
        self._descend(all_x, all_y, np.array_split(order, steps) if steps else [], lambda step: SHARD_RATE * (1 - (step - 1) / steps))
        return len(order)

    def _descend(self, all_x: np.ndarray, all_y: np.ndarray, picks: Iterable[np.ndarray], rate: Callable[[int], float]) -> None:
        moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        room = Room()
        for step, pick in enumerate(picks, 1):
            for name, value in self._gradient(all_x[pick].astype(np.int64), all_y[pick], room).items():
                m, s2 = moment[name]
                m += np.float32(0.1) * (value - m)
                s2 += np.float32(0.01) * (value * value - s2)
                self.p[name] -= np.float32(rate(step) / (1 - 0.9**step)) * m / (np.sqrt(s2 * np.float32(1 / (1 - 0.99**step))) + np.float32(1e-8))

    def _gradient(self, x: np.ndarray, y: np.ndarray, room: Room | None = None) -> dict[str, np.ndarray]:
        """Of the mean loss of these windows' targets. Queries, keys and values depend on an id alone: they and their gradients are tables.

        Attention goes through the windows a few at a time, there and back, so that what it needs stays in the cache.
        """
        p, w, e, room = self.p, self.width, self.p["e"], room or Room()
        queries, both = e @ (p["q"] / np.float32(math.sqrt(DIM))), e @ np.hstack([p["k"], p["v"]])
        new, bias, few = x[:, CONTEXT:], self._bias(), [slice(lo, lo + FEW) for lo in range(0, len(x), FEW)]
        s, h = room.of("s", len(x), STRIDE, WINDOW), room.of("h", len(x), STRIDE, DIM)
        for i in few:
            kv, some = both.take(x[i], axis=0), s[i]
            np.matmul(queries.take(new[i], axis=0), kv[:, :, :DIM].transpose(0, 2, 1), out=some)
            some += bias
            hidden = x[i] == self.none
            short = np.flatnonzero(hidden.any(1))
            some[short] -= np.float32(1e4) * hidden[short][:, None, :]
            np.minimum(some, MOST, out=some)
            np.exp(some, out=some)
            np.matmul(some, kv[:, :, DIM:], out=h[i])
        total = (s.reshape(-1, WINDOW) @ np.ones(WINDOW, np.float32)).reshape(len(x), STRIDE)
        h /= total[:, :, None]
        real = np.flatnonzero(y >= 0)
        share = np.float32(1 / max(1, len(real)))
        place = self.place[y.reshape(-1)[real]]
        by, classes = self._by_class(place)
        real, place = real[by], place[by]
        before = np.minimum(new.reshape(-1)[real], self.start)
        hr = h.reshape(-1, DIM).take(real, axis=0, out=room.of("hr", len(real), DIM), mode="clip")
        dr, ones = room.of("dr", len(real), DIM), np.ones(max(self.classes, w), np.float32)

        def loss(z: np.ndarray, goal: np.ndarray) -> np.ndarray:
            np.minimum(z, MOST, out=z)
            np.exp(z, out=z)
            z *= (share / (z @ ones[: z.shape[1]]))[:, None]
            z[np.arange(len(z)), goal] -= share
            return z

        g = {"o": np.zeros_like(p["o"].T), "m": np.zeros_like(p["m"])}
        for lo in range(0, len(real), ROWS):
            i = slice(lo, lo + ROWS)
            z = hr[i] @ p["o"]
            z += self.given.take(before[i], axis=0)
            z = loss(z, place[i] // w)
            g["o"] += z.T @ hr[i]
            np.matmul(z, p["o"].T, out=dr[i])
        for c, rows in classes:
            mine, some = p["m"][c * w : (c + 1) * w], hr[rows]
            z = some @ mine.T
            z += self.member[c].take(before[rows], axis=0)
            z = loss(z, place[rows] - c * w)
            np.matmul(z.T, some, out=g["m"][c * w : (c + 1) * w])
            dr[rows] += z @ mine
        g["o"] = g["o"].T
        along, scale = room.of("along", total.size), 1 / total.reshape(-1)[real]
        dr *= scale[:, None]
        along[:] = 0
        along[real] = np.einsum("ij,ij->i", dr, hr)
        dh = room.of("dh", len(x), STRIDE, DIM)
        dh[:] = 0
        dh.reshape(-1, DIM)[real] = dr
        along = along.reshape(total.shape)
        dq, dkv, dbias = room.of("dq", len(x), STRIDE, DIM), room.of("dkv", len(x), WINDOW, 2 * DIM), np.zeros((STRIDE, WINDOW), np.float32)
        for i in few:
            kv = both.take(x[i], axis=0)
            ds = dh[i] @ kv[:, :, DIM:].transpose(0, 2, 1)
            ds -= along[i][:, :, None]
            ds *= s[i]
            dbias += ds.sum(0)
            np.matmul(ds, kv[:, :, :DIM], out=dq[i])
            np.matmul(ds.transpose(0, 2, 1), queries.take(new[i], axis=0), out=dkv[i, :, :DIM])
            np.matmul(s[i].transpose(0, 2, 1), dh[i], out=dkv[i, :, DIM:])
        i, j = np.arange(CONTEXT, WINDOW)[:, None], np.arange(WINDOW)[None, :]
        g["d"] = np.bincount(np.clip(i - j, 0, WINDOW - 1).ravel(), weights=(dbias * (j <= i)).ravel(), minlength=WINDOW).astype(np.float32)
        dq = self._by_id(new, dq) / np.float32(math.sqrt(DIM))
        dkv = self._by_id(x, dkv)
        dk, dv = dkv[:, :DIM], dkv[:, DIM:]
        g["q"], g["k"], g["v"] = e.T @ dq, e.T @ dk, e.T @ dv
        g["e"] = dq @ p["q"].T + dk @ p["k"].T + dv @ p["v"].T
        return g

    def _by_id(self, x: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Sums of rows by their id. Those of ids with many rows are products, which are faster."""
        x, rows = x.reshape(-1), rows.reshape(-1, rows.shape[-1])
        by = np.argsort(x.astype(np.uint16 if self.none < 1 << 16 else np.int64), kind="stable")
        x = x[by]
        cuts = np.append(np.flatnonzero(np.diff(x, prepend=-1)), len(x))
        first, sizes = cuts[:-1], np.diff(cuts)
        out, often = np.zeros((self.n + 4, rows.shape[1]), np.float32), sizes >= OFTEN
        some = np.flatnonzero(~often)
        if len(some):
            at = np.append(0, np.cumsum(sizes[some]))
            out[x[first[some]]] = np.add.reduceat(rows.take(by[np.repeat(~often, sizes)], axis=0), at[:-1], axis=0)
        ones = np.ones(sizes.max(initial=0), np.float32)
        for i, n in zip(first[often].tolist(), sizes[often].tolist(), strict=True):
            np.matmul(ones[:n], rows.take(by[i : i + n], axis=0), out=out[x[i]])
        return out

    def _tables(self) -> None:
        """Queries, keys and values by id. A last key dimension hides places that hold nothing."""
        e = self.p["e"]
        pad = np.zeros((len(e), 1))
        pad[self.none] = -1e4
        self.q = np.hstack([e @ self.p["q"] / math.sqrt(DIM), np.ones((len(e), 1))]).astype(np.float32)
        self.k = np.hstack([e @ self.p["k"], pad]).astype(np.float32)
        self.v, self.o = np.hstack([e @ self.p["v"], np.ones((len(e), 1), np.float32)]), self.p["o"]
        self.ones = np.ones(max(self.classes, self.width), np.float32)
        self.m = np.ascontiguousarray(self.p["m"].reshape(self.classes, self.width, DIM).transpose(0, 2, 1))
        self.bias = self._bias()
        # what attention returns is a mean of values; only if odds could pass the exponential's range must they be held below it
        most = lambda u, axis: float(np.sqrt((u**2).sum(axis)).max())
        self.steep = most(self.v[:, :DIM], 1) * max(most(self.o, 0), most(self.m, 1)) > MOST
        del self.p

    def windows(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(inputs, targets, text) of the windows of texts ids[at[i]:at[i + 1]], whose ends are targets too; -1 is no target."""
        x, y = shifted(ids, at, self.start, self.end)
        return slide(x, y, at, self.none)

    def score(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        """log10 probability of each text of vocabulary ids, its end included."""
        out = sums(self.outside[ids].astype(np.float64), at)
        number = self.number[ids]
        for lo, hi in self._blocks(at):
            x, y, text = self.windows(number[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
            for w in range(0, len(x), 2048):
                got = self._windows(x[w : w + 2048], y[w : w + 2048])
                out[lo:hi] += np.bincount(text[w : w + 2048], weights=got, minlength=hi - lo)
        return out / math.log(10)

    @staticmethod
    def _blocks(at: np.ndarray) -> Iterator[tuple[int, int]]:
        lo, n = 0, len(at) - 1
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + 200_000, side="right")) - 1)
            yield lo, hi
            lo = hi

    def _windows(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Of each window the sum of its targets' log probabilities."""
        new, h = x[:, CONTEXT:], np.empty((len(x), STRIDE, DIM + 1), np.float32)
        for lo in range(0, len(x), FEW):
            i = slice(lo, lo + FEW)
            s = self.q.take(new[i], axis=0) @ self.k.take(x[i], axis=0).transpose(0, 2, 1)
            s += self.bias
            np.minimum(s, MOST, out=s)  # far above what training reaches; then no row's maximum is needed
            np.exp(s, out=s)
            np.matmul(s, self.v.take(x[i], axis=0), out=h[i])
        real = np.flatnonzero(y >= 0)
        place = self.place[y.reshape(-1)[real]]
        by, classes = self._by_class(place)
        real, place = real[by], place[by]
        h, before = h.reshape(-1, DIM + 1).take(real, axis=0), np.minimum(new.reshape(-1)[real], self.start)
        h = h[:, :DIM] / h[:, DIM:]  # the last value is 1 everywhere, so its sum is that of the weights
        lp, kind = np.empty(len(real), np.float32), place // self.width
        for lo in range(0, len(real), ROWS):
            i = slice(lo, lo + ROWS)
            lp[i] = self._softmax(h[i] @ self.o, self.given.take(before[i], axis=0), kind[i])
        for c, rows in classes:
            lp[rows] += self._softmax(h[rows] @ self.m[c], self.member[c].take(before[rows], axis=0), place[rows] - c * self.width)
        return np.bincount(real // STRIDE, weights=lp, minlength=len(x))

    def _softmax(self, z: np.ndarray, more: np.ndarray, goal: np.ndarray) -> np.ndarray:
        z += more
        if self.steep:
            np.minimum(z, MOST, out=z)
        hit = z[np.arange(len(z)), goal]
        np.exp(z, out=z)
        return hit - np.log(z @ self.ones[: z.shape[1]])


def sums(v: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of v[at[i]:at[i + 1]]."""
    return np.add.reduceat(np.append(v, 0.0), np.minimum(at[:-1], len(v))) * (np.diff(at) > 0) if len(at) > 1 else np.zeros(0)


_GAP = re.compile(rb"[\x20\x09-\x0D]")


def words_of(text: bytes) -> Iterator[list[bytes]]:
    """The lower-cased words of a text, some at a time."""
    at = 0
    while len(text) - at > CUT:
        gap = _GAP.search(text, at + CUT)
        end = gap.start() if gap else len(text)
        yield text[at:end].lower().split()
        at = end
    yield text[at:].lower().split() if at else text.lower().split()


class Slots(dict):
    """Numbers of words, in the order in which they are met."""

    def __init__(self):
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        self.new.append(word)
        return n

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of the words of texts, end to end, and their offsets)."""
        parts, sizes = [], []
        for t in texts:
            size = 0
            for words in words_of(t):
                parts.append(np.fromiter(map(self.__getitem__, words), np.int32, len(words)))
                size += len(words)
            sizes.append(size)
        return np.concatenate(parts) if parts else np.zeros(0, np.int32), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


class Cutter:
    """Slots of words with their names and ids."""

    def __init__(self, subwords: Subwords):
        self.subwords = subwords
        self.forget()

    def forget(self) -> None:
        self.slots, self.names, self.flat, self.at = Slots(), [], np.zeros(0, np.int32), np.zeros(1, np.int64)

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """(slots, offsets, words met for the first time); afterwards flat and at have the ids of all slots."""
        if len(self.slots) > WORDS_HELD:
            self.forget()
        slots, at = self.slots.of(texts)
        new, self.slots.new = self.slots.new, []
        self.names += new
        flat, offsets = self.subwords.words(new)
        self.flat, self.at = np.concatenate([self.flat, flat]), np.concatenate([self.at, self.at[-1] + offsets[1:]])
        return slots, at, new


def _parts(b: pa.RecordBatch, texts: int) -> Iterator[pa.RecordBatch]:
    """Rows whose texts have about PART bytes together."""
    _, at = textscan.column(b.column(texts))
    lo = 0
    while lo < b.num_rows:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + PART, side="right")) - 1)
        yield b.slice(lo, hi - lo)
        lo = hi


def _bytes(texts: pa.Array) -> list[bytes]:
    return texts.cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary()).to_pylist()


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text) -> (w, c): words and how often they occur, many texts at a time."""
    slots, count = Slots(), np.zeros(0, np.int64)

    def held() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(slots), pa.binary()), pa.array(count)], ["w", "c"])

    for b in batches:
        for part in _parts(b, 0):
            got, _ = slots.of(_bytes(part.column(0)))
            count = np.concatenate([count, np.zeros(len(slots) - len(count), np.int64)])
            count += np.bincount(got, minlength=len(count))
            if len(slots) > WORDS_HELD:
                yield held()
                slots, count = Slots(), np.zeros(0, np.int64)
    yield held()


def _wide(size: int) -> type:
    """Of a window's ids. There size + 1 is the end, size + 2 the start and size + 3 nothing."""
    return np.uint16 if size + 4 <= 1 << 16 else np.uint32


def _draw(vocabulary, share: float):
    """(key, text) -> (w): a share of the windows of texts, each with the first word of its new ids drawn at random."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        subwords = Subwords(vocabulary.value)
        end, start, none = (subwords.size + k for k in (1, 2, 3))
        for b in batches:
            for part in _parts(b, 1):
                left: list[tuple[list[bytes], int]] = []
                for key, text in zip(part.column(0).to_pylist(), _bytes(part.column(1)), strict=True):
                    r = random.Random(key)
                    many = share * (1 + len(text) / WINDOW_CHARS)
                    many = int(many) + (r.random() < many % 1)
                    if many:
                        words = list(chain.from_iterable(words_of(text)))
                        left += [(words, r.randrange(len(words) + 1)) for _ in range(many)]
                rows, ids = [], {}
                for before, after in NEAR_WORDS:
                    new = [w for w in dict.fromkeys(chain.from_iterable(words[max(0, o - before) : o + after] for words, o in left)) if w not in ids]
                    flat, at = subwords.words(new)
                    ids.update((w, flat[i:j].tolist()) for w, i, j in zip(new, at[:-1].tolist(), at[1:].tolist(), strict=True))
                    short = []
                    for words, o in left:
                        a = [i for w in words[max(0, o - before) : o] for i in ids[w]]
                        c = [i for w in words[o : o + after] for i in ids[w]]
                        if len(a) <= CONTEXT and o > before or len(c) < STRIDE and o + after < len(words):
                            short.append((words, o))
                            continue
                        a = [none] * CONTEXT + [start] + a if o <= before else a
                        c += ([end] if o + after >= len(words) else []) + [none] * STRIDE
                        rows.append(np.array(a[-CONTEXT - 1 :] + c[:STRIDE], _wide(subwords.size)).tobytes())
                    left = short
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["w"])

    return run


def _every(vocabulary, model, shards: int):
    """(key, text) -> (shard, key, part, w): all windows of texts, each once, as `unpacked` reads them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, cutter = model.value, Cutter(Subwords(vocabulary.value))
        for b in batches:
            for part in _parts(b, 1):
                slots, at, _ = cutter.of(_bytes(part.column(1)))
                ids, cuts = expand(cutter.flat, cutter.at, slots)
                cuts, number, keys = cuts[at], m.number[ids], part.column(0).to_pylist()
                for lo, hi in m._blocks(cuts):
                    x, y, text = m.windows(number[cuts[lo] : cuts[hi]], cuts[lo : hi + 1] - cuts[lo])
                    w = np.hstack([x[:, : CONTEXT + 1], np.where(y < 0, m.none, y)]).astype(np.int16)
                    first = np.searchsorted(text, np.arange(hi - lo + 1)).tolist()
                    rows = [(keys[lo + t], k, w[i : min(i + TOGETHER, first[t + 1])].tobytes()) for t in range(hi - lo) for k, i in enumerate(range(first[t], first[t + 1], TOGETHER))]
                    key, nth, raw = zip(*rows, strict=True)
                    shard = [zlib.crc32(b"%d %d" % at) % shards for at in zip(key, nth, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(key, pa.int64()), pa.array(nth, pa.int32()), pa.array(raw, pa.binary())], ["shard", "key", "part", "w"])

    return run


def unpacked(s: np.ndarray, m: Model) -> tuple[np.ndarray, np.ndarray]:
    """(inputs, targets) of windows' numbers: their inputs and one more, the last target."""
    x, y = s[:, :-1], s[:, CONTEXT + 1 :]
    return np.where(x == m.end, np.int16(m.none), x), np.where(y == m.none, np.int16(-1), y)


def _shards(model):
    """(shard, w), shard by shard -> (shard, n, p): the weights after a shard's windows, and how many these were."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def learnt() -> pa.RecordBatch:
            m = copy.copy(model.value)
            m.p = {k: v.copy() for k, v in m.p.items()}
            n = m.go_on(*unpacked(np.frombuffer(b"".join(held), np.int16).reshape(-1, WINDOW + 1), m))
            p = np.concatenate([v.ravel() for v in m.p.values()])
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([n], pa.int64()), pa.array([p.tobytes()], pa.binary())], ["shard", "n", "p"])

        now, held = None, []
        for b in batches:
            for shard, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if held and shard != now:
                    yield learnt()
                    held = []
                now = shard
                held.append(w)
        if held:
            yield learnt()

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(g, n, p), g by g -> (g, n, p): sums of n and of weights times n, in 64 bits."""
    now, many, total = None, 0, None
    out = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([many], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["g", "n", "p"])
    for b in batches:
        for g, n, p in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if total is not None and g != now:
                yield out()
                total = None
            v = n * np.frombuffer(p, np.float32).astype(np.float64)
            now, many, total = g, n + (many if total is not None else 0), v if total is None else total + v
    if total is not None:
        yield out()


def all_windows(train: DataFrame, vocabulary, model: Model, shards: int) -> tuple[dict[str, np.ndarray], int]:
    """The mean of what the weights become in each shard of all windows of train (key, text), and how many these are.

    A shard is dealt and ordered by hashes of texts, so every cluster learns the same.
    """
    m = train.sparkSession.sparkContext.broadcast(model)
    rows = train.mapInArrow(_every(vocabulary, m, shards), "shard int, key bigint, part int, w binary")
    rows = rows.repartition(shards, "shard").sortWithinPartitions("shard", "key", "part").select("shard", "w")
    each = rows.mapInArrow(_shards(m), "shard int, n bigint, p binary").select((F.col("shard") % SUMS).alias("g"), "shard", "n", "p")
    sums_ = each.repartition(SUMS, "g").sortWithinPartitions("g", "shard").select("g", "n", "p").mapInArrow(_added, "g int, n bigint, p binary").collect()
    if not sums_:
        return model.p, 0
    many = sum(r.n for r in sums_)
    flat = sum(np.frombuffer(r.p, np.float64) for r in sorted(sums_, key=lambda r: r.g)) / many
    cuts = np.cumsum([v.size for v in model.p.values()])[:-1]
    return {k: f.reshape(v.shape).astype(np.float32) for (k, v), f in zip(model.p.items(), np.split(flat, cuts), strict=True)}, many


def share_of_windows(texts: int, chars: int) -> float:
    n = texts + chars / WINDOW_CHARS
    return min(1.0, (WINDOWS / n) ** 0.75) if n else 1.0


def _ids(vocabulary):
    """(w, c) -> (y, c): ids of words and how often they occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        subwords = Subwords(vocabulary.value)
        count = np.zeros(subwords.size, np.int64)
        for b in batches:
            flat, at = subwords.words(b.column(0).to_pylist())
            np.add.at(count, flat, np.repeat(b.column(1).to_numpy(), np.diff(at)))
        y = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(y.astype(np.int32)), pa.array(count[y])], ["y", "c"])

    return run


def _pairs(vocabulary, number, n: int):
    """(w, c) -> (h, c): pairs of the model's numbers inside words, and how often they occur. A word begins after n + 3 and ends with n + 3."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        subwords, of = Subwords(vocabulary.value), number.value
        for b in batches:
            flat, at = subwords.words(b.column(0).to_pylist())
            x, y = shifted(of[flat], at, n + 3, n + 3)
            c = np.repeat(b.column(1).to_numpy(), np.diff(at) + 1)
            u, which = np.unique(x.astype(np.int64) * (n + 4) + y, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(np.bincount(which, weights=c, minlength=len(u)).astype(np.int64))], ["h", "c"])

    return run


def joint_of(inside: np.ndarray, n: int, ends: int) -> np.ndarray:
    """Counts of numbers given the number before, from pairs inside words and `ends` texts.

    inside[x, n + 3] is how often x ends a word, inside[n + 3, y] how often y begins one. What follows a word's end, or a
    text's start, is a word's beginning or the text's end, as often as these occur.
    """
    joint = np.zeros((n + 3, n + 2), np.float32)
    joint[: n + 1, : n + 1] = inside[: n + 1, : n + 1]
    begins = np.append(inside[n + 3, : n + 1], ends).astype(np.float64)
    begins /= max(1.0, begins.sum())
    for x in range(n + 1):
        joint[x] += inside[x, n + 3] * begins
    joint[n + 2] = ends * begins
    return joint


def learn(counts: DataFrame, windows: DataFrame, train: DataFrame, shards: int, vocabulary, ends: int) -> Model:
    """counts (w, c) of all words, windows (w) to start from, all texts (key, text), how many shards to deal them to and their number."""
    spark, size = counts.sparkSession, Subwords(vocabulary.value).size
    count = np.zeros(size, np.int64)
    got = counts.mapInArrow(_ids(vocabulary), "y int, c bigint").groupBy("y").agg(F.sum("c").alias("c")).toArrow()
    count[got.column("y").to_numpy()] = got.column("c").to_numpy()

    def joint(m: Model) -> np.ndarray:
        number = spark.sparkContext.broadcast(m.number)
        sums_ = counts.mapInArrow(_pairs(vocabulary, number, m.n), "h bigint, c bigint").groupBy("h").agg(F.sum("c").alias("c"))
        got = sums_.select(F.col("h").cast("int").alias("h"), F.col("c").cast("float").alias("c")).toArrow()
        inside = np.zeros((m.n + 4) ** 2, np.float32)
        inside[got.column("h").to_numpy()] = got.column("c").to_numpy()
        return joint_of(inside.reshape(m.n + 4, m.n + 4), m.n, ends)

    def drawn(m: Model) -> tuple[np.ndarray, np.ndarray]:
        number = np.concatenate([m.number, [m.other, m.end, m.start, m.none]]).astype(np.int16)
        raw = np.frombuffer(b"".join(sorted(windows.toArrow().column("w").to_pylist())), _wide(size))  # in an order that no cluster changes
        return unpacked(number[raw].reshape(-1, WINDOW + 1), m)

    return Model.of(size, count, joint, drawn, lambda m: all_windows(train, vocabulary, m, shards))


SCORED = "k bigint, doc_id {}, held_out boolean, n bigint, known bigint, base double, score double, rare array<struct<w:binary,c:bigint>>"
_RARE = pa.list_(pa.struct([("w", pa.binary()), ("c", pa.int64())]))


def _score(model, vocabulary, common, ends: int, log: float):
    """(doc_id, held_out, text) -> what SCORED says: base counts the end and the common words, and rare are the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lm, cutter, (hashes, logs) = model.value, Cutter(Subwords(vocabulary.value)), common.value
        k = TaskContext.get().partitionId() << 40
        gain = np.zeros(0)  # of each slot: log10(count + 1) of a common word, else -1

        for b in batches:
            for part in _parts(b, 2):
                slots, at, new = cutter.of(_bytes(part.column(2)))
                gain = gain[: len(cutter.slots) - len(new)]  # none if the cutter forgot
                h = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in new), np.uint64, len(new)).view(np.int64)
                place = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                gain = np.concatenate([gain, np.where(hashes[place] == h, logs[place], -1.0)])
                mine = gain[slots]
                n, there = np.diff(at) + 1, mine > 0
                base = sums(np.maximum(mine, 0), at) + math.log10(ends + 1) - n * log
                ids, cuts = expand(cutter.flat, cutter.at, slots)
                score = lm.score(ids, cuts[at])
                # the others, of each text once
                where = np.flatnonzero(mine < 0)
                pair, many = np.unique(np.searchsorted(at, where, side="right") * (1 << 32) + slots[where], return_counts=True)
                text, slot = (pair >> 32) - 1, pair & 0xFFFFFFFF
                rare = pa.StructArray.from_arrays([pa.array([cutter.names[i] for i in slot.tolist()], pa.binary()), pa.array(many, pa.int64())], ["w", "c"])
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(part.num_rows + 1)), pa.int32()), rare)
                keys = k + np.arange(part.num_rows)
                k += part.num_rows
                cols = [pa.array(keys), part.column(0), part.column(1), pa.array(n), pa.array((sums(there * 1.0, at) + (ends > 0)).astype(np.int64)), pa.array(base), pa.array(score), lists.cast(_RARE)]
                yield pa.RecordBatch.from_arrays(cols, ["k", "doc_id", "held_out", "n", "known", "base", "score", "rare"])

    return run


def common_words(counts: DataFrame, most: int = COMMON) -> DataFrame:
    """Words of counts (w, c) that occur often enough for there to be `most` of them, or fewer."""
    level = lambda c: F.floor(F.log2(c) * 8).cast("int")
    many, least = 0, 1 << 20
    for r in counts.groupBy(level(F.col("c")).alias("v")).agg(F.count("*").alias("n")).orderBy(F.desc("v")).collect():  # 512 levels at most
        many += r.n
        if many > most:
            break
        least = r.v
    return counts.where(level(F.col("c")) >= least)


def score_documents(docs: DataFrame, vocabulary: bytes | None = None) -> DataFrame:
    """docs (doc_id, text, ..) -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark, top, kind = docs.sparkSession, shared_dir(docs.sparkSession), dict(docs.dtypes)["doc_id"]
    textscan.small_batches(spark)
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    d = d.withColumn("held_out", F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == HELD_OUT)

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{top}/{name}")
        return spark.read.schema(df.schema).parquet(f"{top}/{name}")

    with tidy(spark):
        pieces = spark.sparkContext.broadcast(vocabulary or load())
        train = d.where("not held_out")
        ends, chars = train.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text").cast("bigint")), F.lit(0))).first()
        counts = kept(train.select("text").mapInArrow(_counts, "w binary, c bigint").groupBy("w").agg(F.sum("c").alias("c")), "counts")
        total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
        total, distinct = total + ends, distinct + (ends > 0)
        keyed = train.select(F.xxhash64("doc_id", "text").alias("key"), "text")
        windows = keyed.mapInArrow(_draw(pieces, share_of_windows(ends, chars)), "w binary")
        shards = 1 + int((ends + chars / WINDOW_CHARS) / SHARD)
        model = spark.sparkContext.broadcast(learn(counts, windows, keyed, shards, pieces, ends))
        common = common_words(counts)
        got = common.select(F.xxhash64("w").alias("h"), F.log10(F.col("c") + 1).alias("l")).orderBy("h").toArrow()
        table = (np.append(got.column("h").to_numpy(), np.iinfo(np.int64).max), np.append(got.column("l").to_numpy(), -1.0))
        score = _score(model, pieces, spark.sparkContext.broadcast(table), ends, math.log10(total + distinct + 1))
        scored = kept(d.select("doc_id", "held_out", "text").mapInArrow(score, SCORED.format(kind)), "scored")
        words = scored.select("k", F.explode("rare").alias("r")).select("k", F.col("r.w").alias("w"), F.col("r.c").alias("many"))
        more = words.join(counts, "w").groupBy("k").agg(F.sum("many").alias("_n"), F.sum(F.col("many") * F.log10(F.col("c") + 1)).alias("_s"))
        more = kept(more, "more")
    at = lambda c, v: (F.col(c) + F.coalesce(F.col(v), F.lit(0)))
    return scored.join(more, "k", "left").select("doc_id", "held_out", F.col("n").alias("n_tokens"), at("known", "_n").alias("n_known"), F.lit(total).cast("bigint").alias("train_tokens"), at("base", "_s").alias("base_score"), "score")
