import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tidemill.llm import decontaminate as D
from tidemill.llm import queries
from tidemill.llm import toxicity as X

SF = "/root/testdata/sf0.1"
DOC = "doc_id bigint, text string, item_id string, score string, h int"


def docs(spark, rows):
    return spark.createDataFrame([(*r, "i", "s", 0) for r in rows], DOC)


ITEM = "Anna buys 12 apples and 7 pears at the market for 30 dollars. How many fruits does Anna carry home in the end?"
PLAIN = "the quick brown fox jumps over a lazy dog while nobody is looking at the old red barn"


def benchmark(spark):
    return spark.createDataFrame([(1, ITEM, "x"), (2, PLAIN, "x"), (3, "too short", "x"), (None, PLAIN, "x"), (4, None, "x")], "item_id bigint, text string, doc_id string")


def read(text):
    """A text's template tokens with their surfaces, by the operator."""
    (g,) = D.textscan.groups(pa.array([text]))
    h, lit, place = D.template(g)
    names = {1: D.NUM, 2: D.UNIT, 3: D.NAME}
    surface = D.surfaces(g, place)
    assert [x > 3 for x in h.tolist()] == lit.tolist()
    return [(names.get(x, s), s) for x, s in zip(h.tolist(), surface, strict=True)], h


def test_templates():
    got, _ = read("Anna met Bob, who ran 5.5 km in twenty min.\nThen -- 3rd place! ÉTÉ Été (Née) Zoë's")
    assert got == [("anna", "anna"), ("met", "met"), (D.NAME, "bob"), ("who", "who"), ("ran", "ran"), (D.NUM, "55"), (D.UNIT, "km"), ("in", "in"), (D.NUM, "twenty"), (D.UNIT, "min"), ("then", "then"), (D.NUM, "3rd"), ("place", "place"), ("été", "été"), (D.NAME, "été"), (D.NAME, "née"), (D.NAME, "zoës")]


def test_tokens_hash_alike_wherever_they_stand():
    """In any group, beside any text, and in the parts of a text that is longer than a group."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("ab,é.C5") for _ in range(rng.randrange(1, 7)))
    texts = [" ".join(word() for _ in range(rng.randrange(0, 30))) for _ in range(200)] + ["", None, "x" * 1_200_000 + " ab é", "ab é " * 300_000]
    alone = {}
    for g in D.textscan.groups(pa.array(texts)):
        h, _, place = D.template(g) if len(g.starts) else ([], [], np.zeros(0, int))
        plain = D.textscan.word_hashes(g)
        at = np.searchsorted(place, g.at)
        for i in range(g.first, g.last):
            words = [w for w in (texts[i] or "").encode().lower().split()]
            mine = plain[g.at[i - g.first] : g.at[i - g.first + 1]]
            assert len(words) == len(mine)
            for w, x in zip(words[:2000], mine[:2000].tolist(), strict=True):
                assert alone.setdefault(w, x) == x
            if i < 200 and texts[i]:
                assert read(texts[i])[1].tolist() == h[at[i - g.first] : at[i - g.first + 1]].tolist()
    assert len(set(alone.values())) == len(alone)


def test_found_items(spark):
    rng = random.Random(4)
    noise = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    other = ITEM.replace("12", "45").replace(" 7 ", " 9 ").replace("does Anna", "does Peter").replace("30", "99")
    torn = PLAIN.replace("lazy", "sleepy")
    rows = [(1, f"{noise(50)} {ITEM} {noise(50)}"), (2, f"{noise(9)}. {other}"), (3, noise(300)), (4, ""), (5, None), (6, torn), (7, PLAIN.upper() + "!"), (8, "the quick brown fox jumps " + noise(30)), (9, f"{PLAIN} {noise(5000)} {ITEM}\n" * 3), (9, noise(4)), (10, PLAIN), (10, PLAIN)]
    got = {r.doc_id: r for r in D.judge(docs(spark, rows), benchmark(spark)).collect()}
    assert {i: r["items"] for i, r in got.items()} == {1: [1], 2: [1], 3: [], 4: [], 5: [], 6: [2], 7: [2], 8: [], 9: [1, 2], 10: [2]}
    assert [i for i, r in got.items() if r.changed] == [2] and got[1].share > 0.9 and 0.5 <= got[6].share < 1
    kept = D.drop_contaminated(docs(spark, rows), benchmark(spark))
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 8] and kept.columns == docs(spark, rows).columns
    assert D.judge(docs(spark, rows), benchmark(spark).limit(0)).where("contaminated").count() == 0
    assert D.judge(docs(spark, []).limit(0), benchmark(spark)).count() == 0


def test_items_without_a_window(spark):
    """Short ones, and those dense in numbers, units and names, are found by their exact tokens."""
    items = spark.createDataFrame([(1, "Too short!"), (2, "Compute 3 + 4 * 5 - 6 km"), (3, "1 2 3 4 5 6 7 8 9 10"), (4, "?!"), (5, "one"), (6, "alpha beta gamma delta")], "item_id bigint, text string")
    rows = [(1, "it was TOO short, they said"), (2, "too long and short"), (3, "well: compute 3 4 5 6 km now"), (4, "compute 3 4 5 7 km now"), (5, "0 1 2 3 4 5 6 7 8 9 10 11"), (6, "5 6 7 8 9 11 12"), (7, "1 2 3 4"), (8, ""), (9, "short"), (10, "alpha beta gamma delta"), (11, "alpha beta gamma"), (None, "too short"), (None, "fine"), (12, "alpha beta gamma delta"), (12, "fine")]
    got = {r.doc_id: r["items"] for r in D.judge(docs(spark, rows), items).collect()}
    assert got == {1: [1], 2: [], 3: [2], 4: [], 5: [3], 6: [3], 7: [], 8: [], 9: [], 10: [6], 11: [], 12: [6], None: [1]}
    kept = [(r.doc_id, r.text) for r in D.drop_contaminated(docs(spark, rows), items).collect()]
    assert sorted(kept, key=repr) == sorted([r for r in rows if r[0] in (2, 4, 7, 8, 9, 11) or r == (None, "fine")], key=repr)


def test_recall_of_items_with_other_parameters(spark):
    """Every item of a table, its numbers and names changed alike wherever they stand, amid other words."""
    rng = random.Random(12)
    noise = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    items, rows = [], []
    for k, r in enumerate(spark.read.parquet(f"{SF}/benchmark.parquet").collect()):
        names = ["Anna", "Bob", "Cid"]
        words = [str(rng.randrange(2, 99)) if i % 5 == 3 else rng.choice(names) if i % 11 == 6 else w for i, w in enumerate(r.text.split())]
        items.append((r.item_id, " ".join(words)))
        swap = dict(zip(names, rng.sample(["Dora", "Eve", "Finn", "Gil"], 3), strict=True))
        new = " ".join(swap.setdefault(w, str(100 + len(swap))) if w.isdigit() else swap.get(w, w) for w in words)
        rows += [(2 * k, f"{noise(30)}\n{new}\n{noise(30)}"), (2 * k + 1, noise(80))]
    got = {r.doc_id: r for r in D.judge(docs(spark, rows), spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    found = sum(i in got[2 * k]["items"] and got[2 * k].changed for k, (i, _) in enumerate(items))
    print("recall", found, "of", len(items))
    assert found >= 0.9 * len(items) and not any(got[2 * k + 1]["items"] for k in range(len(items)))


def test_slots_must_agree():
    item, good, bad = "Bob gave x to Bob and y to Cid", "Tom gave x to Tom and y to Ann", "Tom gave x to Ann and y to Tom"
    t = {k: read("so " + v + " for the sake of it") for k, v in (("i", item), ("g", good), ("b", bad))}
    surface = lambda k, at: [x[1] for x in t[k][0][at : at + 5]]

    def hits(d):
        return [(k, k, t[d][1][k : k + 5].tolist(), surface(d, k), surface("i", k), len(t["i"][0])) for k in range(len(t["i"][0]) - 4)]

    assert D.spans(hits("g"))[:2] == (1.0, "changed") and D.spans(hits("i"))[:2] == (1.0, "exact")
    assert D.spans(hits("b"))[0] < 1


def test_query_finds_every_copied_item(spark):
    """Brute force: an item whose text stands in a document."""
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    got = {r.doc_id: r["items"] for r in queries.op1_decontamination(spark, SF).collect()}
    norm = lambda t: " ".join(filter(None, (re.sub(r"[^\w]|_", "", x) for x in t.lower().split())))
    items = {i: (t, norm(t)) for i, t in items.items()}
    for i, t in texts.items():
        n = None
        for k, (whole, plain) in items.items():
            if whole in t:
                assert k in got[i]
            elif k in got[i]:
                n = n or norm(t)
                # found in other clothes: much of it stands there word for word
                w = plain.split()
                assert sum(" ".join(w[j : j + 5]) in n for j in range(len(w) - 4)) >= 0.3 * (len(w) - 4)
    assert got.keys() == texts.keys() and sum(map(bool, got.values())) > 200


def toxic_corpus(n=600):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice(["ba", "ko", "mi", "ru", "te", "su"]) for _ in range(rng.randrange(1, 5)))
    rows = []
    for i in range(n):
        w = [word() for _ in range(rng.randrange(8, 60))]
        toxic = i % 5 == 0
        if toxic:
            w[rng.randrange(len(w))] = rng.choice(["idiot", "zorgal", "zorgen", "zorgu"])
        rows.append((i, " ".join(w) + ".", int(toxic)))
    return rows


def test_learns_words_and_beginnings(spark):
    rows = toxic_corpus()
    d = docs(spark, [r[:2] for r in rows] + [(9000, None), (9001, ""), (9002, "ba ko idiot " * 40_000), (1, rows[1][1])])
    labels = spark.createDataFrame([(r[0], r[2], "t") for r in rows] + [(None, 1, "t"), (3, None, "t")], "doc_id bigint, toxic int, text string")
    model = X.model_for(d, labels)
    assert {"idiot", "zorg"} <= set(model[0]) or any(k.startswith("zor") for k in model[0])
    got = X.score_documents(d, model).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) + 4 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert all(by[i].predicted == y for i, _, y in rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert by[9000].predicted == by[9001].predicted == 0 and by[9002].predicted == 1
    kept = X.drop_toxic(d, labels)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if not r.predicted}
    assert X.score_documents(d.limit(3), X.model_for(d, labels.limit(0))).where("predicted = 1").count() == 0
    assert X.score_documents(docs(spark, []).limit(0), model).count() == 0


def test_grammar():
    lex = X.Lexicon({"idiot": 6.0})
    top = lambda t: X.features(t, lex)[0]
    assert top("an idiot") == 6 and top("you are an IDIOT!") == 7.5 and top("you? idiot") == 6
    assert top("not an idiot") < 6 and top("he said so. idiot") == 6 and top("she said you idiots") < top("you idiots")
    assert top("we will kill it") == X.THREAT and top("to kill time") == 0 and top("") == 0
    assert X.features("idiot. idiot. fine.", lex)[2] == 2


def plain_weight(clause):
    """The best reading of a clause by trying them all."""
    best = 0.0

    def go(i, at, modal, target, negation, report, total):
        nonlocal best
        if i == len(clause):
            best = max(best, total)
            return
        place, symbol, weight = clause[i]
        near = lambda since: since is not None and place - since <= X.REACH
        if symbol in (X.TARGET, X.NEGATION, X.REPORT, X.MODAL):
            now = {X.TARGET: target, X.NEGATION: negation, X.REPORT: report, X.MODAL: modal} | {symbol: place}
            go(i + 1, place, now[X.MODAL], now[X.TARGET], now[X.NEGATION], now[X.REPORT], total)
            return
        go(i + 1, place, modal, target, negation, report, total)  # plain
        if symbol == X.INSULT or near(modal):
            w = weight * (X.FACTORS["negation"] if near(negation) else 1) * (X.FACTORS["report"] if near(report) else 1)
            modal = None if symbol == X.VERB else modal
            for use in (False, True):
                if not use or near(target):
                    go(i + 1, place, modal, None if use else target, None if near(negation) else negation, report, total + w * (X.FACTORS["target"] if use else 1))

    go(0, -1, None, None, None, None, 0.0)
    return best


def test_shortest_paths_are_the_best_of_all_readings():
    rng = random.Random(3)
    for _ in range(400):
        clause, place = [], -1
        for _ in range(rng.randrange(8)):
            place += rng.choice((1, 1, 2, 3, 6, 7, 8))
            symbol = rng.choice((X.INSULT, X.INSULT, X.TARGET, X.NEGATION, X.REPORT, X.MODAL, X.VERB))
            clause.append((place, symbol, rng.choice((0.1, 2.0, 5.0)) if symbol == X.INSULT else X.THREAT if symbol == X.VERB else 0.0))
        assert X.clause_weight(clause) == pytest.approx(plain_weight(clause))
    # a target that two insults could use goes to the heavier one
    assert X.clause_weight([(0, X.TARGET, 0.0), (1, X.INSULT, 1.0), (2, X.INSULT, 4.0)]) == 1 + 4 * X.FACTORS["target"]


def test_a_null_id_is_held_out(spark):
    got = X.score_documents(docs(spark, [(None, "idiot"), (None, None)]), ({"idiot": 6.0}, [-3.0, 1.0, 1.0])).collect()
    assert [r.held_out for r in got] == [True, True] and [r.predicted for r in got] == [1, 0]


def test_held_out_accuracy(spark):
    """On rows that the model hasn't seen."""
    got = {r.doc_id: r for r in queries.op7_toxicity(spark, SF).where("held_out").collect()}
    y = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r.doc_id in got}
    assert sum(got[i].predicted == t for i, t in y.items()) / len(y) > 0.95
    toxic = [got[i].predicted for i, t in y.items() if t]
    assert sum(toxic) / len(toxic) > 0.85
