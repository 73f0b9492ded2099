"""Toxicity by a weighted finite-state pattern grammar.

A lexicon reads a token and gives its symbol - insult, target, negation, report, modal, verb or plain - and its weight.
Five transducers, each of states and arcs, read the symbols of a clause:

    insult    an insult is read as a hit or as plain
    threat    a verb within reach of a modal is read as a hit, which uses the modal up, or as plain
    target    a hit within reach of a target may use it up and weighs more, or leaves it
    negation  a hit within reach of a negation uses it up and weighs less
    report    a hit within reach of a report weighs less

What one writes the next reads: they are composed, once, into one machine, whose arcs have the product of the factors by
which they weigh a hit. Each clause is searched by shortest path in the tropical semiring, where an arc costs its factor
times the token's weight, negated. What is used up is missed later, so the best reading of a clause is a choice among
paths. A clause's score is its best path's weight. A text's score is a logistic function of its best clause and of the sum of all.

What is learned, from a sample of at most TRAIN_DOCS labelled rows: the insults, as words or beginnings of words with
their log odds, and the logistic function. Of the sample the driver gets each text's distinct words, and then its best clause and sum.
Copies in the sample count once, so that the words of a much-copied text don't pass for insults. Only the text is an input.

Null text is empty text, which has the score of no clauses; a null doc_id has an empty text form, whose fold is held out.
Rows that repeat a doc_id each get their score; labels that contradict each other train as toxic. Nulls in labels don't
train. An empty table of labels gives a score of NO_MODEL for all. Extra columns are left out.
"""

from __future__ import annotations

import heapq
import math
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import cache, reduce
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_dir
from . import textscan

TRAIN_DOCS = 4000
#: An insult begins words by so many letters, and its texts are toxic by so many nats more than chance explains.
LEAST_PREFIX, MOST_PREFIX, LEAST_GAIN, DECAY = 3, 12, 14.0, 0.6
NO_MODEL = 0.1
#: Words that many clauses have between a negation, report or target and the insult that it reaches.
REACH = 6
FACTORS = {"target": 1.25, "negation": 0.6, "report": 0.6}
THREAT = 4.0

PLAIN, INSULT, TARGET, NEGATION, REPORT, MODAL, VERB, HIT = range(8)
# Closed classes of words in the four languages of the tables.
WORDS = {
    TARGET: "you your you're they them their he she him her du dich dir ihr euch sie er tu te toi vous votre il elle ils tú usted ustedes él ella ellos vosotros",
    NEGATION: "not no never nor without isn't aren't don't doesn't cannot can't nicht kein keine keinen nie niemals non ne pas jamais sans nunca jamás sin",
    REPORT: "said says say wrote writes claimed claims quoted quote reported according called sagte sagt schrieb behauptet laut dit disait écrit selon prétend dijo dice escribió según afirma",
    MODAL: "will gonna going i'll we'll should werde werden vais allons voy vamos",
    VERB: "kill hurt destroy beat attack murder stab shoot töten schlagen vernichten tuer frapper détruire matar golpear destruir",
}
_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|[.!?;:\n]")
_ENDS = frozenset(".!?;:\n")


class Lexicon:
    """The token transducer: a trie whose nodes may carry a symbol for whole words and a weight for insults that begin so."""

    def __init__(self, insults: dict[str, float]):
        self.root: dict = {}
        for symbol, words in WORDS.items():
            for w in words.split():
                self._node(w)["#"] = (symbol, THREAT if symbol == VERB else 0.0)
        for prefix, weight in insults.items():
            self._node(prefix)["*"] = weight
        self.cache: dict[str, tuple[int, float]] = {}

    def _node(self, word: str) -> dict:
        node = self.root
        for c in word:
            node = node.setdefault(c, {})
        return node

    def read(self, token: str) -> tuple[int, float]:
        got = self.cache.get(token)
        if got is None:
            node, weight = self.root, 0.0
            for c in token:
                node = node.get(c)
                if node is None:
                    break
                weight = max(weight, node.get("*", 0.0))
            got = (INSULT, weight) if weight else (node or {}).get("#", (PLAIN, 0.0))
            if len(self.cache) > 200_000:
                self.cache.clear()
            self.cache[token] = got
        return got


class Machine:
    """A transducer. arcs[state][symbol]: the ways to read a symbol, each (next state, symbol written, factor); state 0 starts and all end."""

    def __init__(self, arcs: list[list[list[tuple[int, int, float]]]]):
        self.arcs = arcs

    def then(self, other: Machine) -> Machine:
        """The composition: what this machine writes is what the other reads."""
        number: dict[tuple[int, int], int] = {(0, 0): 0}
        arcs = []
        for a, b in (todo := [(0, 0)]):  # grows as states are reached
            out: list[list[tuple[int, int, float]]] = []
            for ways in self.arcs[a]:
                joint = []
                for next_a, middle, f in ways:
                    for next_b, symbol, g in other.arcs[b][middle]:
                        state = (next_a, next_b)
                        if state not in number:
                            number[state] = len(number)
                            todo.append(state)
                        joint.append((number[state], symbol, f * g))
                out.append(joint)
            arcs.append(out)
        return Machine(arcs)


def _reach(opens: int, ways) -> Machine:
    """States 0 .. REACH: for how many more tokens what the symbol `opens` said holds. ways(symbol, state, next state): special arcs, if any."""
    arcs = []
    for s in range(REACH + 1):
        down = max(0, s - 1)
        arcs.append([ways(x, s, down) or [(REACH if x == opens else down, x, 1.0)] for x in range(HIT + 1)])
    return Machine(arcs)


def insult_machine() -> Machine:
    return Machine([[[(0, HIT, 1.0), (0, PLAIN, 1.0)] if x == INSULT else [(0, x, 1.0)] for x in range(HIT + 1)]])


def threat_machine() -> Machine:
    return _reach(MODAL, lambda x, s, down: x == VERB and ([(0, HIT, 1.0)] if s else []) + [(down, PLAIN, 1.0)])


def target_machine() -> Machine:
    return _reach(TARGET, lambda x, s, down: x == HIT and s and [(0, HIT, FACTORS["target"]), (down, HIT, 1.0)])


def negation_machine() -> Machine:
    return _reach(NEGATION, lambda x, s, down: x == HIT and s and [(0, HIT, FACTORS["negation"])])


def report_machine() -> Machine:
    return _reach(REPORT, lambda x, s, down: x == HIT and s and [(down, HIT, FACTORS["report"])])


class Grammar:
    """The five machines as one, and its shortest paths."""

    def __init__(self):
        self.machine = reduce(Machine.then, (threat_machine(), target_machine(), negation_machine(), report_machine()), insult_machine())
        # by state, the states after 0, 1, .. plain tokens; after REACH of them nothing holds any more
        step = [a[PLAIN][0][0] for a in self.machine.arcs]
        self.after = [list(accumulate(range(REACH), lambda s, _: step[s], initial=s)) for s in range(len(step))]

    def weight(self, symbols: list[tuple[int, int, float]]) -> float:
        """(place, symbol, weight) of a clause's tokens that aren't plain -> the weight of the best path."""
        arcs, after = self.machine.arcs, self.after
        best, last = {0: 0.0}, -1
        for place, symbol, weight in symbols:
            gap = min(place - last - 1, REACH)
            now: dict[int, float] = {}
            for state, cost in best.items():
                for to, wrote, factor in arcs[after[state][gap]][symbol]:
                    c = cost - factor * weight if wrote == HIT else cost
                    if c < now.get(to, math.inf):
                        now[to] = c
            best, last = now, place
        return -min(best.values())


def clause_weight(symbols: list[tuple[int, int, float]]) -> float:
    return grammar().weight(symbols)


@cache
def grammar() -> Grammar:
    return Grammar()


def features(text: str, lexicon: Lexicon) -> tuple[float, float, int]:
    """(best clause, log of 1 + the sum of clauses, number of clauses that weigh)."""
    read, cache, weight_of, found, clause, weigh = lexicon.read, lexicon.cache, grammar().weight, [], [], False
    for place, token in enumerate(_TOKEN.findall(text.lower())):
        if token in _ENDS:
            if weigh:
                found.append(weight_of(clause))
            if clause:
                clause, weigh = [], False
            continue
        symbol, weight = cache.get(token) or read(token)
        if symbol:
            clause.append((place, symbol, weight))
            weigh = weigh or symbol in (INSULT, VERB)
    if weigh:
        found.append(weight_of(clause))
    return (max(found, default=0.0), math.log1p(sum(found)), sum(w > 0 for w in found))


def words_of(text: str) -> set[str]:
    return {t for t in _TOKEN.findall(text.lower()) if t not in _ENDS}


def learn_insults(texts: list[tuple[set[str], int]]) -> dict[str, float]:
    """Beginnings of words that tell toxic texts, chosen one by one by their gain over those chosen before.

    Whatever stands beside known insults again and again - the other words of a passage that was copied - gains little.
    """
    where: tuple[dict[str, list[int]], dict[str, list[int]]] = (defaultdict(list), defaultdict(list))  # other texts, toxic ones
    many = [0, 0]
    seen: dict[int, int] = {}
    for n, (tokens, toxic) in enumerate(sorted(texts, key=lambda t: (sorted(t[0]), t[1]))):  # no order of rows changes what counts as a copy
        # copies share the smallest hashes of their long words
        least = sorted(zlib.crc32(t.encode()) for t in tokens if len(t) >= 8)[:4]
        shared = Counter(seen[h] for h in least if h in seen)
        if len(least) == 4 and max(shared.values(), default=0) >= 2:
            continue
        seen.update((h, n) for h in least if h not in seen)
        many[toxic] += 1
        for t in tokens:
            where[toxic][t].append(n)
    if not all(many):
        return {}
    base = many[1] / sum(many)

    held: Counter = Counter()  # chosen beginnings by toxic text; what such a text adds to later ones decays with them

    def gain(p: float, n: int) -> float:
        """Nats by which p toxic and n other texts are likelier than at the base rate; 0 if they aren't more toxic."""
        rate = p / max(1, p + n)
        return 0.0 if rate <= base else p * math.log(rate / base) + (n * math.log((1 - rate) / (1 - base)) if n else 0.0)

    words: dict[str, set[str]] = defaultdict(set)
    for token in where[1]:
        for k in range(LEAST_PREFIX, min(len(token), MOST_PREFIX) + 1):
            words[token[:k]].add(token)
    words = {p: w for p, w in words.items() if gain(len(set().union(*(where[1][t] for t in w))), 0) >= LEAST_GAIN}
    for token in where[0]:  # what begins so and stands in other texts counts as well
        for k in range(LEAST_PREFIX, min(len(token), MOST_PREFIX) + 1):
            if token[:k] in words:
                words[token[:k]].add(token)

    def texts_of(p: str) -> tuple[set[int], set[int]]:
        """Toxic texts and others that hold words beginning with p."""
        return tuple(set().union(*(where[y].get(t, ()) for t in words[p])) for y in (1, 0))

    def value(p: str) -> tuple[float, int, str]:
        pos, neg = texts_of(p)
        return (gain(sum(DECAY ** held[n] for n in pos), len(neg)), len(p), p)  # of beginnings with the same texts, the longest

    heap = [(-v[0], -v[1], v[2]) for v in map(value, words) if v[0] >= LEAST_GAIN]
    heapq.heapify(heap)
    out: dict[str, float] = {}
    while heap:
        g, _, p = heapq.heappop(heap)
        words[p] = {t for t in words[p] if not any(t[:k] in out for k in range(LEAST_PREFIX, len(t) + 1))}
        now = value(p)[0]
        if now < LEAST_GAIN:
            continue
        if now < -g:  # a chosen one has explained part of it
            heapq.heappush(heap, (-now, -len(p), p))
            continue
        pos, neg = texts_of(p)
        held.update(pos)
        out[p] = math.log((len(pos) + 0.5) / (many[1] + 1)) - math.log((len(neg) + 0.5) / (many[0] + 1))
    return out


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.02, rounds: int = 50) -> np.ndarray:
    """Logistic regression by Newton's method, the slopes held by a ridge. Texts that show nothing get the base rate."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.full(len(x), 1 / len(x))
    b, pen = np.zeros(a.shape[1]), np.diag([1e-6] + [ridge * 0.05] * x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (w * p * (1 - p) + 1e-9)[:, None]) + pen, a.T @ (w * (y - p)) - pen @ b)
        b = b + np.clip(step, -2, 2)
        if abs(step).max() < 1e-8:
            break
    return b


def train(labelled: list[tuple[str, int]]) -> tuple[dict[str, float], list[float]] | None:
    """(insults, coefficients); None if one of the classes is missing."""
    if len({y for _, y in labelled}) < 2:
        return None
    insults = learn_insults([(words_of(t), y) for t, y in labelled])
    lexicon = Lexicon(insults)
    x = np.array([features(t, lexicon)[:2] for t, _ in labelled])
    return insults, fit(x, np.array([y for _, y in labelled])).tolist()


def scorer(model: tuple[dict[str, float], list[float]] | None):
    if model is None:
        return lambda text: (NO_MODEL, 0)
    lexicon, (b0, b1, b2) = Lexicon(model[0]), model[1]

    def score(text: str) -> tuple[float, int]:
        top, total, n = features(text, lexicon)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, b0 + b1 * top + b2 * total)))), n

    return score


def fold(doc_id, parts: int):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(t, y): texts and labels to learn from: rows whose crc32 of the id leaves a remainder by 5; bounded as the module says.

    Which rows is decided by a hash of their id, so the sample is the same on any cluster.
    """
    y = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("_y"))
    y = y.where(fold(F.col("doc_id"), 5) != 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_DOCS)
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    d = d.join(F.broadcast(y), "doc_id").select(F.xxhash64("doc_id").alias("_h"), "doc_id", F.xxhash64("t").alias("_x"), "t", (F.col("_y") > 0).cast("int").alias("y"))
    # rows that repeat an id may be more than the bound: their keys tell which stay, and texts are never sorted
    last = d.select("_h", "doc_id", "_x").orderBy("_h", "doc_id", "_x").limit(TRAIN_DOCS).agg(F.max(F.struct("_h", "doc_id", "_x")).alias("m"))
    return d.join(F.broadcast(last), F.struct("_h", "doc_id", "_x") <= F.col("m")).select("t", "y")


def model_for(docs: DataFrame, labels: DataFrame):
    """train, with the texts left where they are: they hand over their words, and then what the grammar finds in them."""
    spark, path = docs.sparkSession, f"{shared_dir(docs.sparkSession)}/sample"
    sample(docs, labels).write.parquet(path)
    rows = spark.read.schema("t string, y int").parquet(path)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(["\n".join(sorted(words_of(t))) for t in b.column(0).to_pylist()], pa.string()), b.column(1)], ["w", "y"])

    got = sorted(tuple(r) for r in rows.mapInArrow(words, "w string, y int").collect())  # in an order that no cluster changes
    if len({y for _, y in got}) < 2:
        return None
    insults = learn_insults([(set(w.split("\n")) - {""}, y) for w, y in got])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(insults)
        for b in batches:
            f = [features(t, lexicon) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in f], pa.float64()) for k in (0, 1)] + [b.column(1)], ["top", "total", "y"])

    x = np.array(sorted(tuple(r) for r in rows.mapInArrow(found, "top double, total double, y int").collect()))
    return insults, fit(x[:, :2], x[:, 2]).tolist()


def score_documents(docs: DataFrame, model) -> DataFrame:
    """docs (doc_id, text, ..) -> doc_id, held_out, score, predicted, toxic_clauses."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer(model)
        for b in batches:
            got = [score(b.column(2)[i].as_py() or "") for i in range(b.num_rows)]
            s = np.array([g[0] for g in got])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype("int32")), pa.array([g[1] for g in got], pa.int64())], ["doc_id", "held_out", "score", "predicted", "toxic_clauses"])

    textscan.small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    d = docs.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "text")
    return d.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int, toxic_clauses bigint")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that aren't predicted toxic, all their columns as they are."""
    textscan.small_batches(docs.sparkSession)
    model, at = model_for(docs, labels), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer(model)
        for b in batches:
            text = b.column(at)
            yield b.filter(pa.array([score(text[i].as_py() or "")[0] < 0.5 for i in range(b.num_rows)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
