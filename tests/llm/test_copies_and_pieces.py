import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece

from tidemill.llm import pieces, queries, setsketch

SF = "/root/testdata/sf0.01"
DOC = "doc_id bigint, text string, id string, n string, key int, comp int"


def docs(spark, rows):
    return spark.createDataFrame([(*r, "i", "n", 0, 0) for r in rows], DOC)


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def plain_groups(texts, percent):
    """Groups by all pairs that share a shingle."""
    sets = {i: shingles(t) for i, t in texts.items()}
    where = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            where[x].append(i)
    both = Counter()
    for ids in where.values():
        both.update((a, b) for k, a in enumerate(ids) for b in ids[k + 1 :])
    top = {i: i for i in texts}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for (a, b), n in both.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            a, b = sorted((find(a), find(b)))
            top[b] = a
    return {i: (len(sets[i]), find(i)) for i in texts}


def grouped(spark, rows, percent=85):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in setsketch.group_documents(docs(spark, rows), percent).collect()}


@pytest.mark.parametrize("percent", [85, 80])
def test_groups_of_a_table_are_brute_force(spark, percent):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in df.collect()}
    got = setsketch.group_documents(df, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == plain_groups(texts, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_chains_and_crowds(spark):
    """Versions that drift so that only neighbours are linked, and a crowd of near copies around one text."""
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(10**6)}"
    rows, n = [], 0
    base = [word() for _ in range(120)]
    for _ in range(40):  # a drifting chain
        rows.append((n := n + 1, " ".join(base)))
        base = base[3:] + [word() for _ in range(3)]
    crowd = [word() for _ in range(150)]
    for _ in range(120):
        c = crowd[:]
        for _ in range(rng.randrange(3)):
            c[rng.randrange(len(c))] = word()
        rows.append((n := n + 1, " ".join(c)))
    rng.shuffle(rows)
    got = grouped(spark, rows)
    assert got == plain_groups(dict(rows), 85) and len({c for _, c in got.values()}) < 20


def test_cases(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "One two"), (5, "one\ttwo "), (6, "one two three"), (8, "É a b c d"), (7, "é a b c d"), (9, "a b c d e " * 30_000), (10, "A B c d e " * 29_000), (11, "a\xa0b c d e f"), (12, "x y z u v w"), (12, "x y z u v w"), (None, "one two"), (13, "x y z u v w"), (14, "p q r s t"), (14, "one two")]
    got = setsketch.group_documents(docs(spark, rows), 85).collect()
    by = {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id != 14}
    assert by == {None: (1, 4), 1: (0, 1), 2: (0, 2), 3: (0, 3), 4: (1, 4), 5: (1, 4), 6: (1, 6), 7: (1, 7), 8: (1, 8), 9: (5, 9), 10: (5, 9), 11: (1, 11), 12: (2, 12), 13: (2, 12)}
    assert len(got) == 17 and setsketch.group_documents(docs(spark, rows).limit(0)).count() == 0
    kept = setsketch.drop_near_copies(docs(spark, rows[:13]))
    assert kept.columns == docs(spark, rows).columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 4, 6, 7, 8, 9, 11, 12]


def test_repeated_and_null_ids(spark):
    """Rows are documents of their own; ids only name groups."""
    a, b = "a b c d e f g h i j k l m n o p q r s t", "A1 B1 C1 D1 E1 F1 G1 H1 I1 J1 K1 L1 M1 N1 O1 P1 Q1 R1 S1 T1 U1 V1 W1 X1 Y1 Z1 a2 b2 c2 d2"
    rows = [(5, a), (5, b), (6, b + " e2"), (7, b + " e2"), (None, b), (None, "x y z"), (None, "x y z"), (None, None), (9, ""), (9, ""), (3, a + " u"), (3, a + " u"), (4, a + " u")]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in setsketch.group_documents(docs(spark, rows), 85).collect()), key=repr)
    want = [(5, 16, 3, False), (5, 26, 5, True), (6, 27, 5, False), (7, 27, 5, False), (None, 26, 5, False), (None, 1, None, True), (None, 1, None, True), (None, 0, None, True), (9, 0, 9, True), (9, 0, 9, True), (3, 17, 3, True), (3, 17, 3, True), (4, 17, 3, False)]
    assert got == sorted(want, key=repr)
    df = docs(spark, rows).selectExpr("*", "doc_id AS _x", "text AS _id")
    kept = setsketch.drop_near_copies(df, 85)
    assert kept.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted([(5, b), (None, "x y z"), (None, None), (9, ""), (9, ""), (3, a + " u")], key=repr)


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(3)
    a, b = (rng.integers(0, 2**63, n, dtype=np.uint64) for n in (700, 300))
    ra, rb = setsketch.registers(a), setsketch.registers(b)
    assert (setsketch.merge(ra, rb) == setsketch.registers(np.concatenate([a, b]))).all()
    for n, both in ((500, 450), (500, 250), (40, 36), (3000, 0)):
        got = []
        for _ in range(40):
            s = rng.integers(0, 2**63, 2 * n - both, dtype=np.uint64)
            x, y = s[:n], s[n - both :]
            got.append(setsketch.estimate(setsketch.registers(x)[None], setsketch.registers(y)[None], np.array([n]), np.array([n]))[0])
        assert abs(np.mean(got) - both / (2 * n - both)) < 0.03
    for percent in (50, 80, 85, 100):
        rows, bands = setsketch.rows_of(percent)
        assert (1 - (percent / 100) ** rows) ** bands <= 1e-6 and rows * bands <= setsketch.M


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(300)] + [(1000, x) for x in range(1001, 1200)] + [(rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(150)]
    top = {v: v for e in edges for v in e}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        top[b] = a
    got = {r.id: r.comp for r in setsketch.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {v: find(v) for e in edges for v in e if e[0] != e[1]}


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)


@pytest.fixture(scope="module")
def machine():
    return pieces.Transducer(pieces.load())


def test_encodes_and_decodes_as_the_library(library, machine):
    rng = random.Random(1)
    letters = "  \n\tabcdeeétnsSTH▁.,日本𝒳ﬁ0123<>x\xa0\x00"
    texts = ["", " ", "  ", "▁", "<s>", "<0x0A>", "a" * 5000, " " * 700, "x" + " " * 1_000_000 + "y", " " * 37 + "the" + " " * 23, "𝒳" * 99, "the " * 4000]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randrange(30))) for _ in range(3000)]
    for t in texts:
        ids = library.encode(t)
        assert machine.encode_ids(t) == ids, t
        assert machine.decode(ids) == library.decode(ids)
    ids = [rng.randrange(3, 400) for _ in range(2000)]
    assert machine.decode(ids).encode()


def test_unigram_model_takes_the_cheapest_path():
    """A small model, against all ways to cut a text."""

    def message(*parts):
        out = b""
        for n, v in parts:
            if isinstance(v, int):
                out += bytes([n << 3, v])
            elif isinstance(v, float):
                out += bytes([n << 3 | 5]) + pieces.struct.pack("<f", v)
            else:
                out += bytes([n << 3 | 2, len(v)]) + v
        return out

    scores = {"▁": -1.0, "a": -2.0, "b": -2.25, "ab": -3.5, "▁a": -2.5, "ba": -5.0, "bab": -5.5}
    data = message((1, message((1, b"<unk>"), (2, 0.0), (3, 2))), *[(1, message((1, p.encode()), (2, s))) for p, s in scores.items()], (2, message((3, 1))), (3, message((3, 1), (4, 0), (5, 1))))
    t = pieces.Transducer(data)

    def ways(w):
        return [[]] if not w else [[w[:k], *rest] for k in range(1, len(w) + 1) if w[:k] in scores for rest in ways(w[k:])]

    rng = random.Random(2)
    for _ in range(200):
        w = "▁" + "".join(rng.choice("ab") for _ in range(rng.randrange(9)))
        cost = lambda p: -sum(scores[x] for x in p)
        assert abs(cost(t.path(w)) - min(map(cost, ways(w)))) < 1e-9
    assert t.encode_ids("x") == [1, 0]


def test_query_is_the_library_on_every_text(spark, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.op5_sentencepiece(spark, SF).collect():
        ids = library.encode(texts[r.doc_id])
        assert (r.n_pieces, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<i4").tobytes()).hexdigest())
        assert r.round_trip and r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_piece_rows(spark):
    d = docs(spark, [(1, None), (2, ""), (3, "a▁b"), (3, "é" * 100_000), (None, " x")])
    got = pieces.encode_documents(d, pieces.load())
    assert sorted((r.doc_id or 0, r.n_pieces == len(r.ids), r.round_trip) for r in got.collect()) == [(0, True, True), (1, True, True), (2, True, True), (3, True, True), (3, True, True)]
    assert sorted(r.text for r in pieces.decode_rows(got, pieces.load()).collect()) == sorted(["", "", "a b", "é" * 100_000, " x"])
    assert pieces.digest_documents(d.limit(0), pieces.load()).count() == 0
    with pytest.raises(ValueError):
        pieces.Model(b"\x1a\x06\x12\x04abcd")


def test_crowd_beyond_small_buckets(spark, monkeypatch):
    """More edits than the threshold allows for most: groups by prefixes of sets, with small buckets left to them too."""
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(60)}"
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(150):
        c = base[:]
        for _ in range(rng.randrange(1, 7)):
            c[rng.randrange(len(c))] = word()
        if rng.random() < 0.4:
            del c[: rng.randrange(1, 6)]
        rows.append((i, " ".join(c)))
    want = plain_groups(dict(rows), 85)
    assert len({c for _, c in want.values()}) > 5
    for small in (24, 0, 10_000):
        monkeypatch.setattr(setsketch, "SMALL", small)
        assert grouped(spark, rows) == want
