import hashlib
import random

from pyspark.sql import functions as F

from tidemill.llm import licenses, simhash

DOC = "doc_id bigint, text string, doc string, k string, fingerprint string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], DOC)


def edited(text, following):
    n = len(text)
    return text[: n - n // 2] + following[: n // 2]


def corpus():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 9)))
    rows = [(i, " ".join(word() for _ in range(rng.randrange(1, 120)))) for i in range(300)]
    rows += [(70_000, rows[0][1]), (1 << 40, "𝒳é one two"), ((1 << 40) + 70_000, ""), (-5, None), (9_000_000_000_000_000_000, "w " * 50_000)]
    return rows


def test_edits_follow_the_next_document(spark):
    rows = corpus()
    got = {r.doc_id: r for r in simhash.fingerprint_documents(docs(spark, rows)).collect()}
    plain = sorted((i, t or "") for i, t in rows)
    assert got.keys() == {i for i, _ in plain}
    by_text = {}
    for (i, t), (_, n) in zip(plain, plain[1:] + plain[:1], strict=True):
        r = got[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited(t, n).encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert by_text.setdefault(t, r.fingerprint) == r.fingerprint and len(r.fingerprint) == 32
        if edited(t, n) == t:
            assert r.near_edited == 1
    many = [got[i] for i in range(300) if got[i].n_chars > 200]
    assert sum(r.near_edited for r in many) / len(many) > sum(r.near_next for r in many) / len(many) + 0.08


def test_repeated_and_null_ids(spark):
    """Each row comes back; its next document is that of the next larger id, whose least text counts."""
    rows = [(1, "aa bb cc dd"), (1, "aa bb cc dd"), (1, "aa bb cc dd"), (2, "zz yy"), (2, "ee ff gg hh"), (5, None), (None, "no id here"), (None, "no id here"), (None, "")]
    got = simhash.fingerprint_documents(docs(spark, rows), 3, F.col("doc_id") < 3).collect()
    follow = {1: "ee ff gg hh", 2: "", 5: "aa bb cc dd", None: "aa bb cc dd"}
    want = sorted((str(i), len(t or ""), hashlib.sha256(edited(t or "", follow[i]).encode()).hexdigest()) for i, t in rows)
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in got) == want
    print_of = {r.n_chars: r.fingerprint for r in got if r.n_chars in (5, 11)}
    bits = lambda a, b: (int(a, 16) ^ int(b, 16)).bit_count()
    for r in got:
        if r.doc_id == 1:
            ahead = next(x.fingerprint for x in got if x.doc_id == 2 and x.edited_sha256 == hashlib.sha256(edited("ee ff gg hh", "").encode()).hexdigest())
            assert r.near_next == 1 - bits(r.fingerprint, ahead) / 128 and r.near_edited == 1 - bits(r.fingerprint, r.edited_fingerprint) / 128
        assert (r.neighbours == 0) if r.doc_id in (1, 2) else r.neighbours is None
    assert len(print_of) == 2
    lone = simhash.fingerprint_documents(docs(spark, [(None, "one two"), (None, "one two")])).collect()
    assert [(r.n_chars, r.near_next) for r in lone] == [(7, None)] * 2


def test_likeness_and_neighbours_are_brute_force(spark):
    """All columns of a table's query from its fingerprints alone, compared each with each."""
    rng = random.Random(9)
    base = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    rows = []
    for i in range(120):
        c = base[:]
        for _ in range(rng.randrange(3)):
            c[rng.randrange(400)] = f"w{rng.randrange(10**6)}"
        rows.append((i * 5, " ".join(c)))
    got = {r.doc_id: r for r in simhash.fingerprint_documents(docs(spark, rows), 3, F.col("doc_id") % 20 == 0).collect()}
    fps = {i: int(r.fingerprint, 16) for i, r in got.items()}
    ids = sorted(got)
    for i, j in zip(ids, ids[1:] + ids[:1], strict=True):
        assert got[i].near_next == 1 - (fps[i] ^ fps[j]).bit_count() / 128
        assert got[i].near_edited == 1 - (fps[i] ^ int(got[i].edited_fingerprint, 16)).bit_count() / 128
        near = sum(0 < (fps[i] ^ f).bit_count() <= 3 for f in set(fps.values()))
        assert got[i].neighbours == (near if i % 20 == 0 else None)
    assert sum(r.neighbours or 0 for r in got.values()) > 5


def test_votes_by_hand(spark):
    df = spark.createDataFrame([(1, "aa bb aa c")], "i int, t string")
    f = simhash.fingerprints(df, ["i"], "t").first()
    hs = {r.w: (r.a, r.b) for r in spark.createDataFrame([("aa",), ("bb",), ("c",)], "w string").select("w", F.xxhash64("w").alias("a"), F.xxhash64("w", F.lit(1)).alias("b")).collect()}
    for k, got in enumerate((f.f0, f.f1)):
        want = 0
        for bit in range(64):
            score = sum(w * (1 if (hs[t][k] >> bit) & 1 else -1) for t, w in (("aa", 8), ("bb", 4), ("c", 1)))
            want |= (score >= 0) << bit
        assert got % 2**64 == want


def test_within_radius_is_brute_force(spark):
    rng = random.Random(1)
    fps = []
    for _ in range(40):
        x = rng.getrandbits(128)
        fps += [x, x, *(x ^ sum(1 << b for b in rng.sample(range(128), k)) for k in (1, 2, 3, 4, 6))]
    sign = lambda v: v - (1 << 64) if v >> 63 else v
    df = spark.createDataFrame([(sign(x >> 64), sign(x % 2**64)) for x in fps], "f0 bigint, f1 bigint")
    for radius in (0, 3):
        got = {(r.a, r.b, r.distance) for r in simhash.within_radius(df, radius).collect()}
        want = {frozenset((a, b)) for a in fps for b in fps if a != b and (a ^ b).bit_count() <= radius}
        assert {frozenset((int(a, 16), int(b, 16))) for a, b, _ in got} == want and len(got) == len(want)
    q = simhash.within_radius(df, 3, df.limit(1)).collect()
    assert {int(r.b, 16) for r in q} == {x for x in fps if x != fps[0] and (x ^ fps[0]).bit_count() <= 3}


def test_empty_table(spark):
    none = docs(spark, []).limit(0)
    assert simhash.fingerprint_documents(none).count() == 0 and licenses.scan_documents(none).count() == 0


def test_licenses(spark):
    filler = " ".join(f"w{i}" for i in range(300))
    gpl = licenses.NOTICES["gpl"]
    rows = [
        (1, f"{filler} Licensed under CC BY-NC 4.0. {filler}"),
        (2, f"{filler}\n{gpl.upper()}"),
        (3, gpl.replace("redistribute", "share")),
        (4, filler), (5, ""), (6, None), (7, "Licensed under"),
        (8, f"{licenses.NOTICES['mit']} {filler * 20} {licenses.NOTICES['apache-2.0']}"),
        (8, "second row of this id"),
    ]
    got = {r.doc_id: (r.licenses, r.containment) for r in licenses.scan_documents(docs(spark, rows)).collect()}
    want = {i: ([], 0.0) for i in range(4, 8)} | {1: (["cc-by-nc-4.0"], 1.0), 2: (["gpl"], 1.0), 8: (["apache-2.0", "mit"], 1.0)}
    assert {k: v for k, v in got.items() if k != 3} == want
    assert got[3][0] == ["gpl"] and 0.8 <= got[3][1] < 1


def contained(text, notice):
    """The largest share of the notice's shingles in any run of shingles of its window length."""
    import re

    grams = lambda t: [tuple(w[i : i + 5]) for w in [re.findall("[a-z0-9]+", (t or "").lower())] for i in range(len(w) - 4)]
    s, t = grams(text), set(grams(notice))
    return len(t & set(s)) / len(t)


def test_licenses_of_a_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in df.collect()}
    got = {r.doc_id: r.licenses for r in licenses.scan_documents(df).collect()}
    assert got == {i: sorted(n for n, x in licenses.NOTICES.items() if contained(t, x) >= 0.8) for i, t in texts.items()}


def test_license_lines_found_by_plain_search(spark):
    lines = {"Released under the MIT License.": "mit-short", "Licensed under the Apache License, Version 2.0": "apache-2.0"}
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.collect()] + [(-1, "a b This work is licensed under the Apache License, Version 2.0. c")]
    got = {r.doc_id: r.licenses for r in licenses.scan_documents(docs(spark, rows)).collect()}
    for line, name in lines.items():
        want = {i for i, t in rows if line in (t or "")}
        assert want and want <= {i for i, x in got.items() if name in x}
    assert got[-1] == ["apache-2.0"]


def test_no_notice_is_found_in_a_siblings_line(spark):
    line = "This work is licensed under the GNU General Public License, version {}."
    rows = [(2, f"a b {line.format(2)} c d"), (3, f"a b {line.format(3)} c d")]
    got = {r.doc_id: r.licenses for r in licenses.scan_documents(docs(spark, rows)).collect()}
    assert got == {2: ["gpl-2.0-short"], 3: ["gpl-3.0-short"]}
    assert not [(a, b) for a, x in licenses.NOTICES.items() for b, y in licenses.NOTICES.items() if a != b and contained(x, y) >= licenses.CONTAINED]
