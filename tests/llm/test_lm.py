import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tidemill.llm import lm, queries
from tidemill.llm.pieces import load

SF = "/root/testdata/sf0.01"
DOC = "doc_id bigint, text string, chunk string, h int, score double"


def plain_base(texts):
    """(tokens, known, N, base score) of each id by plain counting."""
    words = {i: (t or "").encode().lower().split() for i, t in texts.items()}
    train = [i for i in texts if zlib.crc32(str(i).encode()) % 7 != 2]
    count, ends = Counter(w for i in train for w in words[i]), len(train)
    n, v = sum(count.values()) + ends, len(count) + (ends > 0)
    out = {}
    for i, ws in words.items():
        c = [count[w] for w in ws] + [ends]
        out[i] = (len(c), sum(x > 0 for x in c), n, sum(math.log10((x + 1) / (n + v + 1)) for x in c))
    return out


def check(got, texts):
    want = plain_base(texts)
    assert len(got) == len(texts)
    for r in got:
        tokens, known, n, base = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (tokens, known, n) and r.base_score == pytest.approx(base, rel=1e-9)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2) and r.score < 0


def test_base_of_a_table_and_held_out_score(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    got = queries.op2_lm_scoring(spark, SF).collect()
    check(got, {r.doc_id: r.text for r in df.collect()})


def test_held_out_score(spark):
    """With enough texts to learn from, the model knows more of others than counts of words do."""
    held = [r for r in queries.op2_lm_scoring(spark, SF.replace("0.01", "0.1")).collect() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_cases(spark, monkeypatch):
    monkeypatch.setattr(lm, "STEPS", 5)
    texts = {1: None, 2: "", 3: "The the  THE\tcat", 4: "É é cat", 5: "cat " * 60_000, 2000: "the dog", 1 << 40: "dog zebra", -7: "the", 11: "only held out?"}
    rows = [(i, t, "c", 0, 0.0) for i, t in texts.items()]
    got = lm.score_documents(spark.createDataFrame(rows, DOC)).collect()
    check(got, texts)
    assert lm.score_documents(spark.createDataFrame(rows, DOC).limit(0)).count() == 0
    twice = lm.score_documents(spark.createDataFrame([rows[2], rows[2], (None, "x", "c", 0, 0.0)], DOC)).collect()
    assert len(twice) == 3 and len({r.score for r in twice if r.doc_id == 3}) == 1


def small():
    rng = np.random.default_rng(0)
    return lm.Model(50, [rng.integers(0, 12, rng.integers(0, 60)).astype(np.int32) for _ in range(80)])


def test_probabilities_sum_to_one(monkeypatch):
    """Over all continuations of a text by one id, and its end."""
    monkeypatch.setattr(lm, "STEPS", 30)
    m = small()
    for prefix in ([], [3], [5, 40, 1], list(range(12)) * 4):
        def score(extra):
            x, y, text = m.windows(m.number[np.array(prefix + extra, np.int32)] if prefix + extra else np.zeros(0, np.int32), np.array([0, len(prefix) + len(extra)]))
            per = []
            for k in range(len(x)):
                for j in range(lm.STRIDE):
                    if y[k, j] >= 0:
                        one = np.full_like(y[k : k + 1], -1)
                        one[0, j] = y[k, j]
                        per.append(m._windows(x[k : k + 1], one)[0])
            return per

        here = len(prefix)
        total = sum(math.exp(score([i])[here] + m.outside[i]) for i in range(50)) + math.exp(score([])[here])
        assert total == pytest.approx(1, abs=2e-3)


def test_each_id_is_scored_once_and_sees_no_later_one(monkeypatch):
    monkeypatch.setattr(lm, "STEPS", 30)
    m = small()
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 50, 400).astype(np.int32)
    at = np.array([0, 0, 1, 17, 33, 400])
    x, y, text = m.windows(m.number[ids], at)
    assert [(y[text == i] >= 0).sum() for i in range(5)] == (np.diff(at) + 1).tolist()
    together = m.score(ids, at)
    alone = [m.score(ids[a:b], np.array([0, b - a]))[0] for a, b in zip(at, at[1:], strict=False)]
    assert together == pytest.approx(alone, rel=1e-5) and together[4] < together[3] < together[0]
    # a change of a later input leaves what is scored before as it was
    w = x[5:6].copy()
    only = np.full((1, lm.STRIDE), -1)
    only[0, 3] = 2
    first = m._windows(w, only)
    w[0, lm.CONTEXT + 4 :] = 1
    assert m._windows(w, only) == pytest.approx(first, rel=1e-6)


def test_gradients_are_those_of_the_loss(monkeypatch):
    """Training lowers the loss; without it, scores are those of the tables."""
    rng = np.random.default_rng(5)
    # the next id repeats the one three before, which a table of the id before can't know
    texts = []
    for _ in range(150):
        t = rng.integers(0, 8, 3).tolist()
        while len(t) < 50:
            t.append(t[-3])
        texts.append(np.array(t, np.int32))
    got = {}
    for steps in (0, 400):
        monkeypatch.setattr(lm, "STEPS", steps)
        m = lm.Model(20, texts[:120])
        got[steps] = sum(m.score(t, np.array([0, len(t)]))[0] for t in texts[120:])
    assert got[400] > 0.6 * got[0]


def test_a_window_by_hand(monkeypatch):
    """A text's score from the model's tables, one place after another in plain Python."""
    monkeypatch.setattr(lm, "STEPS", 30)
    m = small()
    ids = np.array([3, 5, 40, 1, 1, 7], np.int32)
    x = [m.start, *m.number[ids].tolist()]
    y = [*m.number[ids].tolist(), m.end]
    total = float(m.outside[ids].sum())
    for i in range(len(x)):
        weight = [math.exp(sum(float(a) * float(b) for a, b in zip(m.q[x[i]], m.k[x[j]], strict=True)) + float(m.bias[i, j + lm.CONTEXT])) for j in range(i + 1)]
        h = [sum(w * float(m.v[x[j]][d]) for j, w in enumerate(weight)) / sum(weight) for d in range(lm.DIM)]
        kind, member = divmod(int(m.place[y[i]]), m.width)
        one = [float(m.given[x[i], c]) + sum(h[d] * float(m.o[d, c]) for d in range(lm.DIM)) for c in range(m.classes)]
        two = [float(m.member[kind, x[i], k]) + sum(h[d] * float(m.m[kind, d, k]) for d in range(lm.DIM)) for k in range(m.width)]
        total += one[kind] - math.log(sum(map(math.exp, one))) + two[member] - math.log(sum(map(math.exp, two)))
    assert m.score(ids, np.array([0, len(ids)]))[0] == pytest.approx(total / math.log(10), rel=1e-4)


def test_words_are_cut_alike_everywhere(monkeypatch):
    s = lm.Subwords(load())
    cutter = lm.Cutter(s)
    for cut in (lm.CUT, 5):
        monkeypatch.setattr(lm, "CUT", cut)
        slots, at, _ = cutter.of([b"The cat", b"", b" cat\x0bthe\x1cx the\n", b"x"])
        assert at.tolist() == [0, 2, 2, 5, 6] and slots[0] == slots[4] and slots[1] == slots[2]
        ids, cuts = lm.expand(cutter.flat, cutter.at, slots)
        assert ids[: cuts[2]].tolist() == s.sp.encode("the") + s.sp.encode("cat")
    monkeypatch.setattr(lm, "WORDS_HELD", 2)
    slots, at, new = cutter.of([b"x the cat"])
    assert slots.tolist() == [0, 1, 2] and new == [b"x", b"the", b"cat"]


def test_all_training_texts_are_counted(spark, monkeypatch):
    """More texts than windows are drawn from, and a very long one: the tables are those of plain counts of all of them."""
    monkeypatch.setattr(lm, "STEPS", 3)
    monkeypatch.setattr(lm, "COMMON", 40)  # most words meet their counts in the join
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abcdefghij"), rng.integers(1, 7))) for _ in range(300)]
    texts = [" ".join(rng.choice(words, rng.integers(0, 9))) for _ in range(6000)] + ["zebra crossing " * 5000, None]
    rows = [(i, t, "c", 0, 0.0) for i, t in enumerate(texts)]
    made, tables = [], []
    monkeypatch.setattr(lm, "learn", lambda *a, f=lm.learn: made.append(f(*a)) or made[-1])
    monkeypatch.setattr(lm, "joint_of", lambda *a, f=lm.joint_of: tables.append(f(*a)) or tables[-1])
    check(lm.score_documents(spark.createDataFrame(rows, DOC)).collect(), dict(enumerate(texts)))
    (m,), (joint,) = made, tables
    s = lm.Subwords(load())
    train = [(t or "").split() for i, t in enumerate(texts) if lm.fold(str(i)) != lm.HELD_OUT]
    cut = {w: m.number[s.sp.encode(w)].tolist() for t in train for w in t}
    inside, first, last = Counter(), Counter(), Counter()
    for t in train:
        for w in t:
            inside.update(zip(cut[w], cut[w][1:], strict=False))
            first[cut[w][0]] += 1
            last[cut[w][-1]] += 1
    first[m.end] = len(train)
    for x in [*range(m.n + 1), m.start]:
        out = last[x] if x != m.start else len(train)
        want = [inside[x, y] + out * first[y] / sum(first.values()) for y in range(m.n + 2)]
        assert joint[x] == pytest.approx(want, rel=1e-4, abs=1e-6)
    assert all(m.number[i] < m.n for i in s.sp.encode("zebra crossing"))


def test_windows_are_drawn_from_all_texts_and_grow():
    many = [lm.share_of_windows(0, c) * c / lm.WINDOW_CHARS for c in (10**6, 10**8, 10**10, 10**12)]
    assert many[0] == 10**6 / lm.WINDOW_CHARS and many == sorted(set(many))
    text = "the cat sat on the mat and ran " * 4000
    run = lm._draw(type("B", (), {"value": load()}), 0.25)
    b = pa.RecordBatch.from_arrays([pa.array([5, -7, 9]), pa.array([text, text, ""])], ["key", "text"])
    drawn = [np.frombuffer(w, np.uint16).tolist() for x in run(iter([b])) for w in x.column(0).to_pylist()]
    assert abs(len(drawn) / (2 * len(text) / lm.WINDOW_CHARS) - 0.25) < 0.01
    s = lm.Subwords(load())
    ids = [i for w in text.split() for i in s.sp.encode(w)]
    whole = ",".join(map(str, [s.size + 3] * 9 + [s.size + 2, *ids, s.size + 1] + [s.size + 3] * 40))
    assert all(len(w) == lm.WINDOW + 1 and ",".join(map(str, w)) in whole for w in drawn)


def test_attention_adds_to_what_the_id_before_knows(spark, monkeypatch):
    """Held-out texts of a table with the attention's part of the odds, and without it."""
    made = []
    monkeypatch.setattr(lm, "learn", lambda *a, f=lm.learn: made.append(f(*a)) or made[-1])
    held = [r for r in queries.op2_lm_scoring(spark, SF).collect() if r.held_out]
    (m,) = made
    whole = sum(r.score for r in held)
    m.o, m.m = m.o * 0, m.m * 0
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    cutter = lm.Cutter(lm.Subwords(load()))
    slots, at, _ = cutter.of([texts[r.doc_id].encode() for r in held])
    ids, cuts = lm.expand(cutter.flat, cutter.at, slots)
    without = m.score(ids, cuts[at]).sum()
    print("held-out log10 with and without attention", whole, without, "base", sum(r.base_score for r in held))
    assert whole > without
