"""Near-duplicates by SetSketch: registers, bands, a likelihood estimate, exact verification and linked groups.

A text's set is its distinct shingles of five words (a run of bytes but ASCII white space, A to Z in lower case); a
shorter text's whole sequence is its one shingle, and a text without words has none and is linked with nothing. Each of M
registers holds the truncated logarithm, to base B, of the least of as many exponential variates as the set has
members: sketches of parts merge by the larger register, and registers of like sets are like.

1. Documents with the same set, by 128 bits of digest, are one class, and classes go on; links tell them by 64 bits.
2. Registers in bands of rows find who may be alike. The rows are chosen so that a pair at the threshold is missed with
   probability MISSED at most.
3. In a band's bucket all are paired with its most central member, not all with all. The pair's joint likelihood of its
   registers' order estimates the similarity; who lies SIGMAS deviations or more below the threshold is left out.
4. Full sets, made from the texts again, verify each pair: 100 * intersection >= percent * union, in integers.
5. Verified links make groups. What then is in one bucket and different groups is compared across groups: in buckets of SMALL members
   or fewer each with each, in larger ones - crowds of copies that differ too much - by an exact prefix join, whose work
   doesn't grow with the square of a crowd. So no link between groups goes unseen.

Nothing of size is collected. Hot keys: equal sets collapse before any join, and joins on buckets, hubs and classes are
of two plain tables, which Spark splits where a key is hot. What is cut from its lineage is written to the shared folder
and goes when it has been read.

Null text is empty. Rows that repeat a doc_id are documents of their own, each with its text; so are rows with a null id,
which count in their groups but name none: a group without ids has a null component_id, and its rows are kept. The empty
table gives the empty table. Other columns are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import checkpointed, discard, shared_dir, tidy
from . import textscan
from .leaving import without

WORDS, M, B, MISSED, SIGMAS = 5, 256, 1.2, 1e-6, 6.0
#: Ids whose texts are wanted are sent to all tasks if they are so many at most, 16 bytes each; else texts meet them in a shuffle.
SENT = 500_000
#: Counters by which a crowd's shingles are put in order, rarest first, and about how many of its sets they count.
COUNTERS, COUNTED = 1 << 18, 1000
#: Members of a bucket that are compared each with each; what larger ones hold is found by prefixes.
SMALL = 24
_rng = np.random.default_rng(7)
_A = _rng.integers(0, 1 << 63, M, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_C = _rng.integers(0, 1 << 63, M, dtype=np.uint64) * np.uint64(2)
#: Registers from 0 to 255 hold least variates from B ** TOP down.
TOP = 14


def sets(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(place, sorted distinct shingle hashes) of each text."""
    for g in textscan.groups(texts):
        h = textscan.word_hashes(g)
        for i in range(g.first, g.last):
            w = h[g.at[i - g.first] : g.at[i - g.first + 1]]
            if len(w) >= WORDS:
                yield i, np.unique(textscan.combine(w, WORDS))
            elif len(w):
                # as long as it is, so that it can't be taken for a shingle of five
                yield i, textscan.combine(np.append(w, np.uint64(len(w))), len(w) + 1)
            else:
                yield i, w


def registers(s: np.ndarray) -> np.ndarray:
    """M registers of a set that isn't empty."""
    least = np.full(M, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(0, len(s), 64):  # small blocks stay in the processor's cache
            np.minimum(least, (s[k : k + 64, None] * _A + _C).min(axis=0), out=least)
    e = -np.log1p(-np.minimum((least >> np.uint64(11)) * 2.0**-53 + 2.0**-54, 1 - 2.0**-53))
    return np.clip(np.floor(TOP - np.log(e) / math.log(B)), 0, 255).astype(np.uint8)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum(a, b)


def rows_of(percent: int) -> tuple[int, int]:
    """(rows, bands): the longest bands that miss a pair at the threshold with probability MISSED at most."""
    t = percent / 100
    for r in range(M, 1, -1):
        if (1 - t**r) ** (M // r) <= MISSED:
            return r, M // r
    return 1, M


def _p(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-np.clip(x, 0, 1) * (B - 1) / B) / math.log(B)


_GRID = np.linspace(0, 1, 201)


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Jaccard similarities of pairs of rows of registers by maximum likelihood of their order, the sizes known."""
    more, less = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
    u = (na / (na + nb))[:, None]
    v = 1 - u
    j = _GRID[None, :] * np.minimum(u / v, v / u)
    up, down = _p(u - v * j), _p(v - u * j)
    eps = 1e-12
    like = more * np.log(up + eps) + less * np.log(down + eps) + (M - more - less) * np.log(np.maximum(1 - up - down, eps))
    return j[np.arange(len(a)), like.argmax(1)]


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, x, text) -> (id, x, size of its set, digest of it, registers)."""
    for b in batches:
        for k in range(0, b.num_rows, 1024):
            part = b.slice(k, 1024)
            n, c, d, regs = [], [], [], []
            for _, s in sets(part.column(2)):
                c_, d_ = _digest(s)
                n.append(len(s))
                c.append(c_)
                d.append(d_)
                regs.append(registers(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(c, pa.int64()), pa.array(d, pa.int64()), pa.array(regs, pa.binary())], ["id", "x", "n", "c", "d", "regs"])


def _bands(rows: int, bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x.slice(k, 1024) for x in batches for k in range(0, x.num_rows, 1024)):
            r = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(-1, M)[:, : rows * bands].reshape(-1, bands, rows).astype(np.uint64)
            key = np.full(r.shape[:2], 0x9E3779B97F4A7C15, np.uint64)
            with np.errstate(over="ignore"):
                key += np.arange(bands, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)
                for k in range(rows):
                    key = textscan.mix(key ^ (r[:, :, k] + np.uint64(1)) * np.uint64(0x2545F4914F6CDD1D))
            c = np.repeat(b.column(0).to_numpy(), bands)
            yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1).view(np.int64)), pa.array(c), pa.array(np.repeat(b.column(2).to_numpy(), bands))], ["key", "c", "n"])

    return run


def _likely(percent: int):
    t = percent / 100
    least = t - SIGMAS * math.sqrt(t * (1 - t) / M)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 2048):
                p = b.slice(k, 2048)
                a, c = (np.frombuffer(b"".join(p.column(i).to_pylist()), np.uint8).reshape(-1, M) for i in (3, 5))
                na, nc = (p.column(i).to_numpy().astype(float) for i in (2, 4))
                yield p.select([0, 1]).filter(pa.array(estimate(a, c, na, nc) >= least))

    return run


def _digest(s: np.ndarray) -> tuple[int, int]:
    d = xxhash.xxh3_128_intdigest(s.tobytes())
    return (d >> 64) - (1 << 63), (d & ((1 << 64) - 1)) - (1 << 63)


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(c, text) -> (c, set) of texts, each class once in a task."""
    met: set[int] = set()
    for b in batches:
        for k in range(0, b.num_rows, 1024):
            part = b.slice(k, 1024)
            c = part.column(0).to_pylist()
            new = [i for i, v in enumerate(c) if not (v in met or met.add(v))]
            part = part.take(pa.array(new, pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x.tobytes() for _, x in sets(part.column(1))], pa.binary())], ["c", "s"])


def _counters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(set) -> (counter, sum): a task's shingles by counter."""
    sums = np.zeros(COUNTERS, np.int64)
    for b in batches:
        for k in range(0, b.num_rows, 256):
            h = np.frombuffer(b"".join(b.column(0).slice(k, 256).to_pylist()), np.uint64)
            sums += np.bincount((h & np.uint64(COUNTERS - 1)).view(np.int64), minlength=COUNTERS)
    at = np.flatnonzero(sums)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(sums[at])], ["p", "n"])


def _prefixes(counts, percent: int):
    """(c, set, comp) -> (h, c, n, i, comp): the shingles at whose place i a common one may be the first of enough.

    The order, by counter and hash, is the same for all sets.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many = counts.value
        for b in batches:
            out = []
            for k in range(b.num_rows):
                h = np.frombuffer(b.column(1)[k].as_buffer(), np.uint64)
                c = many[h & np.uint64(COUNTERS - 1)]
                order = np.lexsort((h, c))
                i = np.flatnonzero(100 * (len(h) - np.arange(len(h))) >= percent * len(h))
                out.append((h[order[i]].view(np.int64), np.full(len(i), k), i, np.full(len(i), len(h))))
            h, k, i, n = (np.concatenate(v) for v in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 4
            yield pa.RecordBatch.from_arrays([pa.array(h), b.column(0).take(pa.array(k)), pa.array(n), pa.array(i), b.column(2).take(pa.array(k))], ["h", "c", "n", "i", "comp"])

    return run


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                s, t = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(100 * both >= percent * (len(s) + len(t) - both))
            yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> (id, comp), the smallest id that each end reaches; by large stars and small stars in turn.

    A round leaves each id pointing to a smaller one of its group. Least neighbours come from partial minima, and are read
    again, so that the join which hands them to edges is of two plain tables and Spark splits a hub's. It ends when a round changes no edge, after a logarithm of the longest path, mostly three.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            e = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = e.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        e = e.join(checkpointed(least), "a")
        if large:
            out = e.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = e.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(e.where("a <> m").select("a", F.col("m").alias("b")))
        return out.where("a > b").distinct()

    # every edge points from the larger to the smaller id
    e = checkpointed(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct())
    mark = lambda d: d.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40)))).first()
    before = mark(e)
    while before[0]:
        e = checkpointed(star(star(e, True), False))
        now = mark(e)
        if now == before:
            break
        before = now
    ends = e.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("comp"))
    return ends.unionByName(e.select(F.col("b").alias("id"), F.col("b").alias("comp")).distinct())


class Search:
    """The steps over one table of documents; what they share is written once to the shared folder."""

    def __init__(self, docs: DataFrame, percent: int):
        spark = self.spark = docs.sparkSession
        textscan.small_batches(spark)
        self.percent, (self.rows, self.bands) = percent, rows_of(percent)
        self.top = shared_dir(spark)
        self.docs = rows_of_documents(docs)
        # a row's x is a hash of its id and text
        self.sketches = self.kept(self.docs.mapInArrow(_sketch, "id bigint, x bigint, n bigint, c bigint, d bigint, regs binary"), "sketches")
        # one sketch of each class: equal sets have equal sketches
        same = self.sketches.where("n > 0").groupBy("c", "d").agg(F.min("id").alias("least"), F.count("*").alias("many"), F.min("n").alias("n"), F.min("x").alias("x"), F.min("regs").alias("regs"))
        self.classes = self.kept(same, "classes")
        keys = self.classes.select("c", "regs", "n").mapInArrow(_bands(self.rows, self.bands), "key bigint, c bigint, n bigint")
        shared = self.kept(keys.groupBy("key").agg(F.count("*").alias("members")).where("members > 1"), "shared")
        buckets = self.kept(keys.join(shared, "key"), "keys")
        score = self.kept(buckets.groupBy("c").agg(F.sum("members").alias("score")), "scores")
        self.buckets = self.kept(buckets.join(score, "c"), "buckets")
        self.drop("shared", "keys", "scores")

    def kept(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.top}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.top}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            discard(self.spark, f"{self.top}/{name}")

    def stars(self) -> DataFrame:
        """Pairs (a, b) of each bucket's members with its most central one, whose buckets have most members."""
        hubs = self.buckets.groupBy("key").agg(F.max(F.struct("score", F.col("c").alias("hub"), F.col("n").alias("m"))).alias("h")).select("key", "h.hub", "h.m")
        return _pairs(self.buckets.join(checkpointed(hubs), "key").where((F.col("c") != F.col("hub")) & self.sized("n", "m")), "c", "hub")

    def sized(self, n: str, m: str):
        """Whether sets of these sizes can be linked."""
        return 100 * F.least(n, m) >= self.percent * F.greatest(n, m)

    def mixed(self, comp: DataFrame) -> DataFrame:
        """(key, c, n, comp, members) of buckets that hold more than one group."""
        m = self.buckets.select("key", "c", "n", "members").join(comp, "c", "left").withColumn("comp", F.coalesce("comp", "c"))
        mixed = m.groupBy("key").agg(F.min("comp").alias("_a"), F.max("comp").alias("_z")).where("_a <> _z").select("key")
        return m.join(checkpointed(mixed), "key")

    def across(self, comp: DataFrame) -> DataFrame:
        """Pairs of members of one bucket in different groups: all of them in small buckets, and in others all that can be linked."""
        m = self.kept(self.mixed(comp), "mixed")
        few = m.where(F.col("members") <= SMALL)
        other = few.select("key", F.col("c").alias("b"), F.col("comp").alias("_other"), F.col("n").alias("m"))
        small = few.withColumnRenamed("c", "a").join(other, "key").where(F.expr("a < b and comp <> _other") & self.sized("n", "m")).select("a", "b")
        return small.unionByName(self.crowded(m.where(F.col("members") > SMALL).select("c", "comp").distinct())).distinct()

    def crowded(self, crowd: DataFrame) -> DataFrame:
        """Pairs of a crowd (c, comp) across groups that may be linked, found by prefixes of their sets; exact.

        Shingles are ordered by how many of these sets hold them, rarest first, as counters of some of the sets tell: any order
        gives the same pairs, if it's the same for all; a bad one only costs more. Two sets with an overlap of `need` have a first common shingle, at place i of one and j
        of the other, and hold no more than n - i and m - j from there on. So only places go on from which enough can
        follow. To test a hot shingle's places pair by pair would take the square of a crowd: places are tested against
        the earliest one of each set size first, and only those that pass meet the sets of that size.
        """
        t = self.percent
        crowd = self.kept(crowd, "crowd")
        held = self.kept(self.set_table(crowd, "crowd").join(crowd, "c").select("c", "s", "comp"), "held")
        some = held.where(F.pmod(F.xxhash64("c"), F.lit(1 << 30)) < round(min(1.0, COUNTED / max(1, held.count())) * (1 << 30)))
        sums = some.select("s").mapInArrow(_counters, "p int, n bigint").groupBy("p").agg(F.sum("n").alias("n")).toArrow()
        counts = np.zeros(COUNTERS, np.int64)
        counts[sums.column("p").to_numpy()] = sums.column("n").to_numpy()
        rows = held.mapInArrow(_prefixes(self.spark.sparkContext.broadcast(counts), t), "h bigint, c bigint, n bigint, i bigint, comp bigint")
        rows = self.kept(rows, "prefixes")
        early = self.kept(rows.groupBy("h", F.col("n").alias("m")).agg(F.min("i").alias("j"), F.min("comp").alias("_a"), F.max("comp").alias("_z")), "early")
        # overlap >= percent of the union: (100 + percent) * overlap >= percent * (n + m)
        enough = lambda rest: (100 + t) * rest >= t * (F.col("n") + F.col("m"))
        able = rows.join(early, "h").where(enough(F.least(F.col("n") - F.col("i"), F.col("m") - F.col("j"))) & ((F.col("_a") != F.col("comp")) | (F.col("_z") != F.col("comp"))))
        able = able.select("h", "m", "n", "i", "comp", F.col("c").alias("_c"))
        other = rows.select("h", F.col("n").alias("m"), F.col("i").alias("j"), F.col("comp").alias("_other"), "c")
        found = able.join(other, ["h", "m"]).where((F.col("comp") != F.col("_other")) & enough(F.least(F.col("n") - F.col("i"), F.col("m") - F.col("j"))))
        return found.select(F.least("c", "_c").alias("a"), F.greatest("c", "_c").alias("b"))

    def set_table(self, wanted: DataFrame, name: str) -> DataFrame:
        """(c, s) of classes (c): full sets, made from the texts again."""
        w = self.kept(wanted.select("c").join(self.classes.select("c", "x"), "c"), f"wanted-{name}")
        w = F.broadcast(w) if w.count() <= SENT else w
        s = self.docs.select("x", "text").join(w, "x").select("c", "text").mapInArrow(_set_rows, "c bigint, s binary")
        return self.kept(s.dropDuplicates(["c"]), f"sets-{name}")

    def verified(self, pairs: DataFrame, name: str) -> DataFrame:
        """Those of pairs (a, b) that are linked."""
        r = self.classes.select("c", "n", "regs")
        side = lambda v: r.select(F.col("c").alias(v), F.col("n").alias(f"n{v}"), F.col("regs").alias(f"r{v}"))
        sized = pairs.join(side("a"), "a").join(side("b"), "b")
        likely = self.kept(sized.select("a", "b", "na", "ra", "nb", "rb").mapInArrow(_likely(self.percent), "a bigint, b bigint"), f"likely-{name}")
        ends = likely.select(F.col("a").alias("c")).unionByName(likely.select(F.col("b").alias("c"))).distinct()
        s = self.set_table(ends, name)
        both = likely.join(s.select(F.col("c").alias("a"), F.col("s").alias("sa")), "a").join(s.select(F.col("c").alias("b"), F.col("s").alias("sb")), "b")
        links = self.kept(both.select("a", "b", "sa", "sb").mapInArrow(_verify(self.percent), "a bigint, b bigint"), f"links-{name}")
        self.drop(f"likely-{name}", f"wanted-{name}", f"sets-{name}")
        return links

    def groups(self) -> DataFrame:
        """(c, comp) of classes that are linked with another."""
        tested = self.kept(self.stars(), "stars")
        links = self.verified(tested, "stars")
        comp = checkpointed(components(links).withColumnRenamed("id", "c"))
        pairs = self.kept(self.across(comp).join(tested, ["a", "b"], "left_anti"), "across")
        if not pairs.isEmpty():
            more = self.verified(pairs, "across")
            if not more.isEmpty():
                comp = checkpointed(components(links.unionByName(more)).withColumnRenamed("id", "c"))
        self.drop("buckets", "stars", "across", "mixed", "crowd", "wanted-crowd", "sets-crowd", "held", "prefixes", "early")
        return comp

    def named(self) -> DataFrame:
        """(c, d, root, component_id) of classes of more than one document or linked with another; component_id is null without ids."""
        comp = self.groups()
        of = self.classes.select("c", "d", "least", "many").join(comp, "c", "left").where("many > 1 or comp is not null")
        of = self.kept(of.withColumn("root", F.coalesce("comp", "c")), "rooted")
        least = self.kept(of.groupBy("root").agg(F.min("least").alias("component_id")), "least")
        return self.kept(of.join(least, "root").select("c", "d", "root", "component_id"), "named")


def rows_of_documents(docs: DataFrame) -> DataFrame:
    """(id, x, text): x is a hash of the id and the text."""
    d = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    return d.select("id", F.xxhash64("id", "text").alias("x"), "text")


def _pairs(d: DataFrame, one: str, other: str) -> DataFrame:
    return d.select(F.least(one, other).alias("a"), F.greatest(one, other).alias("b")).distinct()


def _grouped(docs: DataFrame, percent: int) -> DataFrame:
    """(id, x, n, component_id, root) of each row; root, of rows that may have company, tells groups apart."""
    if not 1 <= percent <= 100:
        raise ValueError("percent is 1 to 100")
    with tidy(docs.sparkSession):
        f = Search(docs, percent)
        named = f.named()
        return f.sketches.select("id", "x", "n", "c", "d").join(named, ["c", "d"], "left").select("id", "x", "n", F.when(F.col("root").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"), "root")


def group_documents(docs: DataFrame, percent: int = 85) -> DataFrame:
    """docs (doc_id, text, ..) -> doc_id, n_shingles, component_id, kept."""
    g = _grouped(docs, percent)
    return g.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_copies(docs: DataFrame, percent: int = 80) -> DataFrame:
    """One row of each group of linked documents, with all its columns as they are: that of the smallest doc_id.

    Where rows of a group repeat that id, or none has one, it is the row whose id and text have the least hash; rows that
    repeat id and text are one. Rows without words are linked with nothing and all stay.
    """
    with tidy(docs.sparkSession):
        top = shared_dir(docs.sparkSession)

        def kept(df: DataFrame, name: str) -> DataFrame:
            df.write.parquet(f"{top}/{name}")
            return docs.sparkSession.read.schema(df.schema).parquet(f"{top}/{name}")

        rows = _grouped(docs, percent).where("root is not null").groupBy("root", "id", "x").agg(F.count("*").alias("many"))
        rows = kept(rows, "rows")
        first = kept(rows.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("_none"), "id", "x", "many")).alias("f")).select("root", "f.x", "f.many"), "first")
        others = kept(rows.join(first.where("many = 1"), ["root", "x"], "left_anti").select(F.col("id").alias("_id"), F.col("x").alias("_key")), "others")
        again = first.where("many > 1").select(F.col("x").alias("_x"))
        some = not again.isEmpty()
    x = F.xxhash64(docs["doc_id"].cast("bigint"), F.coalesce(docs["text"], F.lit("")))
    left = without(docs, others, x, docs["doc_id"].cast("bigint").eqNullSafe(others["_id"]))
    if not some:
        return left
    name = max(docs.columns, key=len) + "_"  # no column of docs is called so
    one = docs.withColumn(name, x).join(again.withColumnRenamed("_x", name), name, "left_semi").dropDuplicates([name])
    return left.unionByName(one.drop(name))
