"""Benchmark decontamination by template windows.

Tokens between white space lose their ASCII punctuation and become lower-case literals, or typed placeholders:
numbers, units, and names - capitalised tokens that don't begin a sentence. They are read for many texts at once. Windows of WINDOW template tokens with
LITERALS literals or more are hashed. Windows of documents meet those of the benchmark in a hash join; before it, a
bitmap of the benchmark's hashes, of a fixed size that no benchmark changes, keeps most windows out of the shuffle.

Windows that agree in item and, but for a few places, in offset are one passage. The values that its slots take in item
and document must map one to one, type by type: then the passage is the item, exact or with other parameters.
Slots that contradict each other are left out, and what they cover doesn't count. A document that holds COVERED of an
item's tokens this way is contaminated by it.

An item without such a window - of fewer tokens, or dense in numbers, units or names - is found by its exact tokens: in
windows of WINDOW of them, or all in one if they are fewer. An item without any token is never found.

Null texts are empty. Rows that repeat a doc_id are judged each, and reported and dropped together; rows with a null id are
reported together, and of them only those go that hold an item. Null ids of items are dropped; an
empty benchmark finds nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed
from . import textscan
from .leaving import without

WINDOW, LITERALS, COVERED, DRIFT = 5, 3, 0.5, 3
BITMAP_BITS = 1 << 23

NUM, UNIT, NAME = "<num>", "<unit>", "<name>"
# Number words and units.
NUMBERS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen".split()
UNITS = "mm cm m km inch inches foot feet yard yards mile miles mg g kg ton tons ounce ounces pound pounds lb lbs ml l litre litres liter liters gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years mph cent cents dollar dollars euro euros usd eur percent % $ € £".split()

#: Bytes of a token that count: letters, digits, $, % and all beyond ASCII.
KEPT = np.array([chr(b).isalnum() and b < 128 or b in b"$%" or b >= 128 for b in range(256)])
_DIGIT = np.array([48 <= b <= 57 for b in range(256)])
_ENDS = np.array([b in b".!?:" for b in range(256)])
_P = np.uint64(0x9E3779B97F4A7C15)
_CODE = {NUM: np.uint64(1), UNIT: np.uint64(2), NAME: np.uint64(3)}


def lowered(data: np.ndarray) -> np.ndarray:
    """Lower case of A to Z and, in UTF-8, of the Latin letters from U+00C0 to U+00DE."""
    out = textscan.LOWER[data]
    if len(data) > 1:
        second = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][second] += 32
    return out


def _fixed(words: list[str]) -> np.ndarray:
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    word = ~textscan.SPACE[data]
    starts, ends = np.flatnonzero(np.diff(word, prepend=False) & word), np.flatnonzero(np.diff(word, append=False) & word) + 1
    return np.sort(textscan.hash_runs(textscan.BYTE[data], starts, ends))


_NUMBERS, _UNITS = _fixed(NUMBERS), _fixed(UNITS)


def _among(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    at = np.searchsorted(known, h)
    return known[np.minimum(at, len(known) - 1)] == h


def template(g: textscan.Group) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, literal, place) of the group's template tokens; place is the word's index. Placeholders are the small codes."""
    return _read(g)[:3]


def _read(g: textscan.Group) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """template, and the hashes of all tokens as they are.

    A token is a number if its first counted byte is a digit or it's a number word; a name if, within a sentence, it has
    a capital first and a small letter later; a unit if it's listed.
    """
    low, kept = lowered(g.data), KEPT[g.data]
    rank = np.cumsum(kept)
    rank = np.concatenate([rank - kept, rank[-1:]])
    there = rank[g.ends] > rank[g.starts]
    place = np.flatnonzero(there)
    s, e = g.starts[place], g.ends[place]
    out = []
    for k in range(0, len(s), 1 << 17):  # parts, for the sake of long texts
        a, b = s[k], e[min(k + (1 << 17), len(s)) - 1]
        part = np.where(kept[a:b], textscan.BYTE[low[a:b]], np.uint64(0))
        out.append(textscan.hash_runs(part, s[k : k + (1 << 17)] - a, e[k : k + (1 << 17)] - a, rank[a:b] - rank[a]))
    h = np.concatenate(out) if out else np.zeros(0, np.uint64)
    # where sentences begin: after an end of one, at a line's or text's start
    starts = np.zeros(len(g.starts), bool)
    starts[1:] = _ENDS[g.data[g.ends[:-1] - 1]]
    lines = np.concatenate([[0], np.cumsum(g.data == 10)])
    starts[1:] |= lines[g.starts[1:]] > lines[g.ends[:-1]]
    starts[g.at[:-1][g.at[:-1] < len(starts)]] = True
    # the first counted byte: the kept one whose rank is that of the start
    where = np.flatnonzero(kept)
    first = where[rank[s]]
    capital = low[first] != g.data[first]
    two = np.minimum(first + 1, len(g.data) - 1)
    capital |= (g.data[first] == 0xC3) & (low[two] != g.data[two])
    small = np.concatenate([[0], np.cumsum(((g.data >= 97) & (g.data <= 122)) | ((g.data >= 0x9F) & (g.data <= 0xBF)))])
    number = _DIGIT[g.data[first]] | _among(h, _NUMBERS)
    unit = ~number & _among(h, _UNITS)
    name = ~number & ~unit & capital & ~starts[place] & (small[e] > small[s])
    h = exact = np.maximum(h, np.uint64(16))
    for what, code in ((number, _CODE[NUM]), (unit, _CODE[UNIT]), (name, _CODE[NAME])):
        h = np.where(what, code, h)
    return h, h > np.uint64(3), place, exact


def surfaces(g: textscan.Group, words: np.ndarray) -> list[str]:
    """The counted bytes of words, in lower case."""
    out = []
    for s, e in zip(g.starts[words], g.ends[words], strict=True):
        d = g.data[s:e]
        out.append(lowered(d)[KEPT[d]].tobytes().decode("utf-8", "replace"))
    return out


def bitmap_of(places: np.ndarray) -> bytes:
    bits = np.zeros(BITMAP_BITS // 8, np.uint8)
    np.bitwise_or.at(bits, places >> 3, (1 << (places & 7)).astype(np.uint8))
    return bits.tobytes()


def within(h: np.ndarray, bits: np.ndarray) -> np.ndarray:
    k = h & np.uint64(BITMAP_BITS - 1)
    return (bits[k >> np.uint64(3)] >> (k & np.uint64(7)).astype(np.uint8)) & 1 == 1


Known = tuple[np.ndarray, np.ndarray, list[int]]


def _hashes(h: np.ndarray, w: np.ndarray, size: int, kind: int) -> np.ndarray:
    """Of the windows h[i:i + size], i in w."""
    with np.errstate(over="ignore"):
        acc = np.full(len(w), kind, np.uint64)
        for k in range(size):
            acc = textscan.mix(acc * _P + h[w + k])
    return acc


def windows(g: textscan.Group, known: Known | None = None) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray, int, int]]:
    """(text, place in its template, hash, token hashes, words, length of the template, kind) of each window that counts; kind is 0 or an exact one's size.

    Those are windows of the template with enough literals; of texts that have none, windows of exact tokens. known: bitmaps
    of the tokens and of the windows that the benchmark holds, and the sizes of its exact windows; then windows that it can't
    hold are left out, and exact ones are looked for in all texts.
    """
    if not len(g.starts):
        return
    h, literal, place, exact = _read(g)
    at = np.searchsorted(place, g.at)  # template tokens of each text
    text = np.repeat(np.arange(g.last - g.first), np.diff(at))
    n = max(0, len(h) - WINDOW + 1)
    lit = np.concatenate([[0], np.cumsum(literal)])
    enough = (text[:n] == text[WINDOW - 1 :]) & (lit[WINDOW:] - lit[:-WINDOW] >= LITERALS) if n else np.zeros(0, bool)
    found = []
    if known is None:
        w = np.flatnonzero(enough)
        found.append((h, 0, w, _hashes(h, w, WINDOW, 0)))
        bare = np.ones(g.last - g.first, bool)
        bare[text[w]] = False
        size = np.minimum(np.diff(at), WINDOW)
        for k in range(1, WINDOW + 1):
            w = np.flatnonzero((bare & (size == k))[text])
            w = w[w + k <= at[text[w] + 1]]
            found.append((exact, k, w, _hashes(exact, w, k, k)))
    else:
        ok = ~literal | within(h, known[0])
        good = np.concatenate([[0], np.cumsum(ok)])
        w = np.flatnonzero(enough & (good[WINDOW:] - good[:-WINDOW] == WINDOW)) if n else np.zeros(0, np.int64)
        found.append((h, 0, w, _hashes(h, w, WINDOW, 0)))
        for k in known[2]:
            w = np.arange(len(h))
            w = w[w + k <= at[text + 1]]
            found.append((exact, k, w, _hashes(exact, w, k, k)))
        found = [(t, k, w[hit], acc[hit]) for t, k, w, acc in found for hit in (within(acc, known[1]),)]
    for tokens, kind, w, acc in found:
        size = kind or WINDOW
        for x, v in zip(w.tolist(), acc.view(np.int64).tolist(), strict=True):
            t = int(text[x])
            yield g.first + t, int(x - at[t]), v, tokens[x : x + size], place[x : x + size], int(at[t + 1] - at[t]), kind


def spans(hits: list[tuple[int, int, list[int], list[str], list[str], int]]) -> tuple[float, str, int, int] | None:
    """The best passage of one item in one document.

    hits are (place in document, place in item, the window's template, document's surfaces, item's surfaces, item's
    length); the result is (share of the item that it covers, exact or changed, first and last place in the document).
    """
    hits = sorted(hits, key=lambda h: (h[0] - h[1], h[0]))
    best = None
    i = 0
    while i < len(hits):
        j = i + 1
        while j < len(hits) and (hits[j][0] - hits[j][1]) - (hits[j - 1][0] - hits[j - 1][1]) <= DRIFT:
            j += 1
        there: dict = {}
        back: dict = {}
        covered, same, places = set(), True, []
        for d, p, temp, mine, other, _ in sorted(hits[i:j], key=lambda h: h[1]):
            pairs = [(t, b, a) for t, a, b in zip(temp, mine, other, strict=True) if 0 < t <= 3]
            if any(there.get((t, b), a) != a or back.get((t, a), b) != b for t, b, a in pairs):
                continue  # contradicts what stands before
            there.update(((t, b), a) for t, b, a in pairs)
            back.update(((t, a), b) for t, b, a in pairs)
            covered.update(range(p, p + len(temp)))
            same = same and all(a == b for _, b, a in pairs)
            places += [d, d + len(temp)]
        share = len(covered) / hits[i][5]
        if covered and (best is None or share > best[0]):
            best = (share, "exact" if same else "changed", min(places), max(places))
        i = j
    return best


_WINDOW_SCHEMA = "_id bigint, _x bigint, at int, h bigint, template array<bigint>, surface array<string>, n int, kind int"


def _emit(known: tuple[bytes, bytes, list[int]] | None):
    """(id, hash of the text, text) -> its windows. known: the benchmark's bitmaps of tokens and of windows, and sizes of exact windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if known is None else (*(np.frombuffer(k, np.uint8) for k in known[:2]), known[2])
        for b in batches:
            rows = []
            for g in textscan.groups(b.column(2)):
                for i, at, h, temp, words, n, kind in windows(g, bits):
                    rows.append((b.column(0)[i].as_py(), b.column(1)[i].as_py(), at, h, temp.view(np.int64).tolist(), surfaces(g, words), n, kind))
                if len(rows) >= 20_000:
                    yield _batch(rows)
                    rows = []
            yield _batch(rows)

    return run


_ARROW = pa.schema([("_id", pa.int64()), ("_x", pa.int64()), ("at", pa.int32()), ("h", pa.int64()), ("template", pa.list_(pa.int64())), ("surface", pa.list_(pa.string())), ("n", pa.int32()), ("kind", pa.int32())])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = zip(*rows, strict=True) if rows else [[]] * len(_ARROW)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _ARROW, strict=True)], schema=_ARROW)


def template_windows(df: DataFrame, id_: str, known: tuple[bytes, bytes, list[int]] | None = None) -> DataFrame:
    return df.select(F.col(id_).cast("bigint").alias("_id"), _x(df).alias("_x"), "text").mapInArrow(_emit(known), _WINDOW_SCHEMA)


def _x(df: DataFrame):
    return F.xxhash64(F.coalesce(df["text"], F.lit("")))


def _found(docs: DataFrame, benchmark: DataFrame, covered: float) -> DataFrame:
    """(doc_id, _x, item_id, share, kind, first, last), for rows of docs by id and their text's hash."""
    textscan.small_batches(docs.sparkSession)
    items = template_windows(benchmark.where("item_id is not null"), "item_id")
    # at most BITMAP_BITS distinct places of each come to the driver, whatever the benchmark's size
    rows = items.select(F.explode("template").alias("h"))
    tokens, places = (d.select(F.col("h").bitwiseAND(F.lit(BITMAP_BITS - 1)).cast("int").alias("p")).distinct().toArrow()["p"].to_numpy() for d in (rows, items))
    sizes = [r.kind for r in items.where("kind > 0").select("kind").distinct().collect()]  # of exact windows, WINDOW at most
    w = template_windows(docs, "doc_id", (bitmap_of(tokens), bitmap_of(places), sizes))
    b = items.select(F.col("_id").alias("item_id"), "h", F.col("_x").alias("_ix"), F.col("at").alias("iat"), F.col("template").alias("itemplate"), F.col("surface").alias("isurface"), F.col("n").alias("in"))
    hits = w.join(b, "h").where(F.col("template") == F.col("itemplate"))
    hits = hits.groupBy("_id", "_x", "item_id", "_ix").agg(F.collect_list(F.struct("at", "iat", "template", "surface", "isurface", "in")).alias("hits"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            rows = []
            for r in x.to_pylist():
                got = spans([tuple(h.values()) for h in r["hits"]])
                if got and got[0] >= covered:
                    rows.append((r["_id"], r["_x"], r["item_id"], *got))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.string(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([q[k] for q in rows], t) for k, t in enumerate(kinds)], ["doc_id", "_x", "item_id", "share", "kind", "first", "last"])

    return hits.mapInArrow(run, "doc_id bigint, _x bigint, item_id bigint, share double, kind string, first int, last int")


def find(docs: DataFrame, benchmark: DataFrame, covered: float = COVERED) -> DataFrame:
    """(doc_id, item_id, share, kind, first, last) of each item that a document holds; places count template tokens."""
    found = _found(docs, benchmark, covered)
    return found.groupBy("doc_id", "item_id").agg(F.max(F.struct("share", "kind", "first", "last")).alias("b")).select("doc_id", "item_id", "b.*")


def judge(docs: DataFrame, benchmark: DataFrame, covered: float = COVERED) -> DataFrame:
    """One row for each doc_id: contaminated, items (ids in order), share (the best), changed (found with other parameters only)."""
    found = find(docs, benchmark, covered)
    every = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.lit(None).cast("struct<item_id:bigint,share:double,kind:string>").alias("f"))
    every = every.unionByName(found.select("doc_id", F.struct("item_id", "share", "kind").alias("f")))
    # rows that repeat an id add a null each, which a set leaves out
    g = every.groupBy("doc_id").agg(F.sort_array(F.collect_set("f")).alias("f"))
    return g.select("doc_id", (F.size("f") > 0).alias("contaminated"), F.transform("f", lambda x: x["item_id"]).alias("items"), F.coalesce(F.array_max(F.transform("f", lambda x: x["share"])), F.lit(0.0)).alias("share"), ((F.size("f") > 0) & ~F.exists("f", lambda x: x["kind"] == "exact")).alias("changed"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, covered: float = COVERED) -> DataFrame:
    """The rows of docs that hold no item, all their columns as they are."""
    bad = _found(docs, benchmark, covered)
    bad = checkpointed(bad.select(F.coalesce("doc_id", "_x").alias("_key"), F.col("doc_id").isNull().alias("_none")).distinct())
    key = F.coalesce(docs["doc_id"].cast("bigint"), _x(docs))
    return without(docs, bad, key, docs["doc_id"].isNull() == bad["_none"])
