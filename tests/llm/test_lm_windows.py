import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.test_lm import DOC, small
from tidemill.llm import lm
from tidemill.llm.pieces import load


def table():
    rng = np.random.default_rng(6)
    words = ["".join(rng.choice(list("abcdefghij"), rng.integers(1, 7))) for _ in range(300)]
    texts = [" ".join(rng.choice(words, rng.integers(0, 60))) for _ in range(400)] + ["zebra crossing " * 20_000, None, ""]
    rows = [(i, t, "c", 0, 0.0) for i, t in enumerate(texts)]
    return rows + rows[:9]


def test_every_window_is_learnt_from(spark, monkeypatch):
    """Few windows to start from, and all of them in the end, whatever the table's partitions."""
    monkeypatch.setattr(lm, "STEPS", 3)
    monkeypatch.setattr(lm, "WINDOWS", 20)
    monkeypatch.setattr(lm, "SHARD", 700)
    monkeypatch.setattr(lm, "SUMS", 2)
    made = []
    monkeypatch.setattr(lm, "learn", lambda *a, f=lm.learn: made.append(f(*a)) or made[-1])
    rows, s = table(), lm.Subwords(load())
    df = spark.createDataFrame(rows, DOC)
    scores = [[r.score for r in sorted(lm.score_documents(df.repartition(n)).collect(), key=lambda r: r.doc_id)] for n in (2, 7)]
    many = sum(-(-(sum(len(s.sp.encode(w)) for w in (t or "").split()) + 1) // lm.STRIDE) for i, t, *_ in rows if lm.fold(str(i)) != lm.HELD_OUT)
    assert [m.learnt for m in made] == [many, many] and many > 4 * lm.SHARD
    assert all((getattr(made[0], k) == getattr(made[1], k)).all() for k in ("q", "k", "v", "o", "m", "bias")) and scores[0] == pytest.approx(scores[1], rel=1e-6)


def test_windows_of_shards_are_those_that_are_scored(monkeypatch):
    monkeypatch.setattr(lm, "STEPS", 3)
    monkeypatch.setattr(lm, "TOGETHER", 2)
    s = lm.Subwords(load())
    texts = [b"the cat sat on the mat " * 40, b"", b"dog", b"zebra " * 15]
    flat, at = s.words([w for t in texts for w in t.split()])
    cuts = at[np.cumsum([0, *(len(t.split()) for t in texts)])]
    m = lm.Model(s.size, [flat[a:b] for a, b in zip(cuts, cuts[1:], strict=False)])
    held = lambda v: type("B", (), {"value": v})
    b = pa.RecordBatch.from_arrays([pa.array([5, -7, 9, 5]), pa.array([t.decode() for t in texts])], ["key", "text"])
    got = pa.Table.from_batches(lm._every(held(load()), held(m), 3)(iter([b]))).to_pylist()
    x, y = lm.unpacked(np.frombuffer(b"".join(r["w"] for r in got), np.int16).reshape(-1, lm.WINDOW + 1), m)
    want = m.windows(m.number[flat], cuts)
    assert (x == want[0]).all() and (y == want[1]).all()
    assert {r["shard"] for r in got} <= {0, 1, 2} and len({(r["key"], r["part"]) for r in got if r["key"] != 5}) == sum(r["key"] != 5 for r in got)


def test_gradient_by_differences(monkeypatch):
    """Each weight's, against what a small change of it does to the loss."""
    monkeypatch.setattr(lm, "STEPS", 30)
    kept = []
    monkeypatch.setattr(lm.Model, "_tables", lambda self, f=lm.Model._tables: kept.append({k: v.copy() for k, v in self.p.items()}) or f(self))
    m, rng = small(), np.random.default_rng(2)
    ids = rng.integers(0, 12, 90).astype(np.int32)
    at = np.array([0, 40, 41, 90])
    x, y, _ = m.windows(m.number[ids], at)
    m.p = {k: v.copy() for k, v in kept[0].items()}
    g = m._gradient(x.astype(np.int64), y)

    def loss(p):
        m.p = {k: v.copy() for k, v in p.items()}
        lm.Model._tables(m)
        return -m._windows(x, y).sum() / (y >= 0).sum()

    for name, v in g.items():
        way = np.sign(v) * (rng.random(v.shape) < 0.5).astype(np.float32)
        more, less = ({k: u + np.float32(sign * 2e-3) * way if k == name else u for k, u in kept[0].items()} for sign in (1, -1))
        assert (loss(more) - loss(less)) / 4e-3 == pytest.approx(float((v * way).sum()), rel=0.03, abs=1e-4), name


def test_a_step_keeps_its_memory(monkeypatch):
    """A step uses what the last one did, and attention a few windows at a time; else the time goes to fetching memory."""
    monkeypatch.setattr(lm, "STEPS", 1)
    kept = []
    monkeypatch.setattr(lm.Model, "_tables", lambda self, f=lm.Model._tables: kept.append({k: v.copy() for k, v in self.p.items()}) or f(self))
    m, rng = small(), np.random.default_rng(3)
    m.p, many = kept[0], 16 * lm.SHARD_BATCH
    x, y, _ = m.windows(m.number[rng.integers(0, 50, many * lm.STRIDE - 1)], np.array([0, many * lm.STRIDE - 1]))
    m.go_on(x[: lm.SHARD_BATCH], y[: lm.SHARD_BATCH])

    def most(n):
        tracemalloc.start()
        m.go_on(x[:n], y[:n])
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return peak

    assert most(many) - most(lm.SHARD_BATCH) < 1 << 19  # no more for many steps than for one
    assert most(many) < 17 << 20
    tracemalloc.start()
    lm.Model._tables(m)
    m._windows(x[:2048], y[:2048])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 9 << 20


def test_sums_by_id():
    """Of ids with no row, a few and many."""
    m, rng = small(), np.random.default_rng(8)
    for x in (rng.permutation(np.repeat([0, 1, 5, 9], [1, lm.OFTEN - 1, lm.OFTEN, 300])), np.zeros(90, int), np.arange(3), np.zeros(0, int)):
        rows = rng.random((len(x), 5), np.float32)
        want = np.zeros((m.n + 4, 5))
        np.add.at(want, x, rows)
        assert m._by_id(x, rows) == pytest.approx(want, rel=1e-5)
