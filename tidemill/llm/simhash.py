"""Document fingerprints by SimHash, in DataFrame functions only.

A term is a lower-cased word between white space; each occurrence votes with the square of the word's length, at most
`MAX_LEN` letters, so that the short function words of a language don't outvote its content. 128 bits are two 64-bit
hashes. Bits i and i + 32 of a hash are counted in one bigint, so 128 bits take 64 plain sums with map-side partials,
and nothing is ever kept per document but those sums. A count is exact below 2^31 of weight, over ten million words;
a text beyond that is refused with an error, since its counts would run into each other.

Null text is empty text; a text without words has the fingerprint of no votes (all ones: ties set a bit). Rows that
repeat a doc_id are documents of their own, also where the text is the same: the next document of each is that of the
next larger id, of which, if it has several rows, the least text counts. A row with a null id stands after the last, so
its next is the first document; where no row has an id, it has none, an empty text takes its part, and near_next is null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import shared_dir, tidy

MAX_LEN = 12
BITS = 128
_PAIR = 0x0000000100000001
#: Ids that share all but so many low bits are neighbours in one task.
NEAR_BITS, STEP_BITS = 8, 16


def term_rows(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """One row for each word, with its two hashes and weight; a text without words gives one row without a weight."""
    words = F.split(F.lower(F.col(text)), r"[\x20\x09-\x0D]+")
    df = df.select(*keys, F.explode(words).alias("_w"))
    weight = F.pow(F.least(F.length("_w"), F.lit(MAX_LEN)), 2).cast("bigint")
    return df.select(*keys, F.xxhash64("_w").alias("_h0"), F.xxhash64("_w", F.lit(1)).alias("_h1"), weight.alias("_t"))


def votes(terms: DataFrame, keys: list[str]) -> DataFrame:
    sums = [F.sum((F.shiftrightunsigned(h, i).bitwiseAND(F.lit(_PAIR))) * F.col("_t")).alias(f"{h}_{i}") for h in ("_h0", "_h1") for i in range(32)]
    return terms.groupBy(*keys).agg(F.sum("_t").alias("_all"), *sums)


def _word(h: str) -> Column:
    """The 64 bits of one hash: a bit is set if at least half of the weight votes for it."""
    low = lambda i: F.col(f"{h}_{i}").bitwiseAND(F.lit(0xFFFFFFFF))
    high = lambda i: F.shiftrightunsigned(f"{h}_{i}", 32)
    bit = lambda n, i: F.when(n * 2 >= F.col("_all"), F.lit(1 << i if i < 63 else -(1 << 63)).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    bits = reduce(Column.bitwiseOR, [bit(low(i), i) for i in range(32)] + [bit(high(i), i + 32) for i in range(32)])
    return F.when(F.col("_all") < 1 << 31, bits).when(F.col("_all").isNotNull(), F.raise_error(F.lit("a text is too long for its votes")).cast("bigint")).otherwise(F.lit(-1).cast("bigint"))


def fingerprints(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys and f0, f1: the fingerprint's two halves as bigints."""
    return votes(term_rows(df, keys, text), keys).select(*keys, _word("_h0").alias("f0"), _word("_h1").alias("f1"))


def as_hex(f0: str, f1: str) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(f0), 16, "0"), F.lpad(F.hex(f1), 16, "0")))


def distance(a: tuple[str, str], b: tuple[str, str]) -> Column:
    return F.bit_count(F.col(a[0]).bitwiseXOR(F.col(b[0]))) + F.bit_count(F.col(a[1]).bitwiseXOR(F.col(b[1])))


def likeness(a: tuple[str, str], b: tuple[str, str]) -> Column:
    """1 for equal fingerprints, about 0.5 for unrelated ones."""
    return F.lit(1.0) - distance(a, b) / F.lit(float(BITS))


def _turned(fps: DataFrame, radius: int, prefix: str) -> DataFrame:
    """Distinct fingerprints as {prefix}0, {prefix}1, once for each block, with the block's number, its value and all blocks."""
    if not 0 <= radius <= 15:
        raise ValueError("the radius is 0 to 15")
    cuts = [BITS * i // (radius + 1) for i in range(radius + 2)]
    bits = F.concat(F.lpad(F.conv(F.hex("f0"), 16, 2), 64, "0"), F.lpad(F.conv(F.hex("f1"), 16, 2), 64, "0"))
    d = fps.select("f0", "f1").distinct().withColumn("_bits", bits)
    blocks = F.array(*[F.substring("_bits", a + 1, b - a) for a, b in zip(cuts, cuts[1:], strict=False)])
    d = d.withColumn("_all", blocks)
    return d.select(F.col("f0").alias(f"{prefix}0"), F.col("f1").alias(f"{prefix}1"), F.col("_all").alias(f"_{prefix}"), F.posexplode("_all").alias("_k", "_v"))


def near_pairs(fps: DataFrame, radius: int = 3, queries: DataFrame | None = None) -> DataFrame:
    """(a0, a1, b0, b1, distance): all distinct fingerprints (f0, f1) b within the radius of each query fingerprint a, itself not.

    Fingerprints are cut into radius + 1 blocks, and a table for each block holds the fingerprint turned so that the
    block leads. Two fingerprints within the radius agree in a block, so equality joins on (block, value) find all
    of them. The distance decides within the join, and so does which of the blocks that agree comes first: no pair
    leaves it twice, and of a block that many share only what is near. Both sides are plain tables, which Spark splits
    where a value is hot. Equal fingerprints count once, so groups of copies make no pairs. Without queries, each pair
    comes once, a before b.
    """
    a, b = _turned(fps if queries is None else queries, radius, "a"), _turned(fps, radius, "b")
    same = F.col("a0").eqNullSafe(F.col("b0")) & F.col("a1").eqNullSafe(F.col("b1"))
    order = ~same if queries is not None else (F.struct("a0", "a1") < F.struct("b0", "b1"))
    # no block before this one agrees
    first = reduce(lambda x, y: x & y, [(F.col("_k") <= i) | (F.get("_a", F.lit(i)) != F.get("_b", F.lit(i))) for i in range(radius + 1)])
    found = a.join(b.withColumnsRenamed({"_k": "_k2", "_v": "_v2"}), (F.col("_k") == F.col("_k2")) & (F.col("_v") == F.col("_v2")) & order & first & (distance(("a0", "a1"), ("b0", "b1")) <= radius))
    return found.select("a0", "a1", "b0", "b1", distance(("a0", "a1"), ("b0", "b1")).alias("distance"))


def within_radius(fps: DataFrame, radius: int = 3, queries: DataFrame | None = None) -> DataFrame:
    """near_pairs as text: (a, b, distance)."""
    return near_pairs(fps, radius, queries).select(as_hex("a0", "a1").alias("a"), as_hex("b0", "b1").alias("b"), "distance")


def _after(groups: DataFrame, bits: int) -> DataFrame:
    """groups (g, m) -> (g, nm): m of the next g in order, and of the first after the last.

    Each task orders groups that share all but STEP_BITS low bits; the rest go up a level as one row each.
    """
    if bits <= STEP_BITS:
        w = W.orderBy("g")  # at most 2^16 rows, whatever the input
        every = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
        return groups.select("g", F.coalesce(F.lead("m").over(w), F.first("m").over(every)).alias("nm"))
    t = groups.withColumn("u", F.shiftright("g", STEP_BITS))
    t = t.withColumn("nm", F.lead("m").over(W.partitionBy("u").orderBy("g")))
    up = _after(groups.groupBy(F.shiftright("g", STEP_BITS).alias("g")).agg(F.min("m").alias("m")), bits - STEP_BITS)
    return t.join(up.select(F.col("g").alias("u"), F.col("nm").alias("_up")), "u").select("g", F.coalesce("nm", "_up").alias("nm"))


def with_next(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text), each id once -> doc_id, text, next_id, next_text: the next document by doc_id; after the last, the first.

    One shuffle of the texts: neighbours by id meet in a bucket, and only the first document of a bucket goes to the
    bucket before it.
    """
    d = docs.withColumn("_b", F.shiftright("doc_id", NEAR_BITS))
    w = W.partitionBy("_b").orderBy("doc_id")
    d = d.withColumns({"_id": F.lead("doc_id").over(w), "_text": F.lead("text").over(w), "_i": F.row_number().over(w)})
    heads = d.where("_i = 1").select("_b", "doc_id", "text")
    after = _after(heads.select(F.col("_b").alias("g"), F.col("doc_id").alias("m")), 64 - NEAR_BITS)
    links = after.select(F.col("g").alias("_b"), F.col("nm").alias("_hid"))
    first = heads.select(F.col("doc_id").alias("_hid"), F.col("text").alias("_htext"))
    links = links.join(first, "_hid")
    d = d.join(links, "_b")
    return d.select("doc_id", "text", F.coalesce("_id", "_hid").alias("next_id"), F.when(F.col("_id").isNull(), F.col("_htext")).otherwise(F.col("_text")).alias("next_text"))


def rows_with_next(docs: DataFrame, kept) -> DataFrame:
    """with_next for any rows, with how many rows are the same (many) and whether the row stands for its id (head).

    Rows whose id is null or repeated go their own way, beside the others. kept(df, name) writes a table and reads it.
    """
    again = kept(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("_n")).where("_n > 1").select("doc_id"), "again")
    one = {"many": F.lit(1).cast("bigint"), "head": F.lit(True)}
    if again.isEmpty() and docs.where("doc_id is null").isEmpty():
        return with_next(docs).withColumns(one)
    some = kept(docs.where("doc_id is null").unionByName(docs.join(again, "doc_id", "left_semi")).groupBy("doc_id", "text").agg(F.count("*").alias("many")), "some")
    heads = some.where("doc_id is not null").groupBy("doc_id").agg(F.min("text").alias("text"))
    linked = kept(with_next(docs.where("doc_id is not null").join(again, "doc_id", "left_anti").unionByName(heads)), "linked")
    of = linked.join(again, "doc_id", "left_semi").withColumnRenamed("text", "_least")
    repeated = some.join(of, "doc_id").withColumn("head", F.col("text") == F.col("_least")).drop("_least")
    first = linked.join(linked.agg(F.min("doc_id").alias("doc_id")), "doc_id", "left_semi").select(F.col("doc_id").alias("next_id"), F.col("text").alias("next_text"))
    lone = some.where("doc_id is null").join(F.broadcast(first), how="left").withColumn("head", F.lit(False))  # one row
    return linked.join(again, "doc_id", "left_anti").withColumns(one).unionByName(repeated).unionByName(lone)


def fingerprint_documents(docs: DataFrame, radius: int = 3, queries: Column | None = None) -> DataFrame:
    """docs (doc_id, text, ..) -> doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, neighbours.

    The edited text has its last half, rounded down, replaced by as much of the next document's beginning. neighbours is
    how many other fingerprints lie within the radius of that of a row for which the condition `queries` holds; else null.
    """
    spark, top = docs.sparkSession, shared_dir(docs.sparkSession)

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{top}/{name}")
        return spark.read.schema(df.schema).parquet(f"{top}/{name}")

    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    with tidy(spark):
        d = rows_with_next(base, kept)
        n = F.char_length("text")
        half = F.floor(n / 2).cast("int")
        edited = F.concat(F.substring("text", F.lit(1), n - half), F.when(half > 0, F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), half)).otherwise(F.lit("")))
        own = ["doc_id", "next_id", "many", "head", "n_chars", "edited_sha256", "_x"]
        d = d.select("doc_id", "next_id", "many", "head", n.cast("bigint").alias("n_chars"), "text", edited.alias("_edited"))
        both = F.array(F.struct(F.lit(0).alias("k"), F.col("text").alias("t")), F.struct(F.lit(1).alias("k"), F.col("_edited").alias("t")))
        d = d.select(*own[:-2], F.sha2("_edited", 256).alias("edited_sha256"), F.xxhash64("text").alias("_x"), F.explode(both).alias("_s")).select(*own, "_s.k", F.col("_s.t").alias("t"))
        f = fingerprints(d, [*own, "k"], "t")
        of = lambda k, c: F.max(F.when(F.col("k") == k, F.col(c)))
        f = kept(f.groupBy(*own).agg(of(0, "f0").alias("f0"), of(0, "f1").alias("f1"), of(1, "f0").alias("e0"), of(1, "f1").alias("e1")), "fingerprints")
        asked = F.lit(False) if queries is None else F.coalesce(queries, F.lit(False))
        near = kept(near_pairs(f, radius, f.where(asked)).groupBy("a0", "a1").agg(F.count("*").alias("neighbours")), "near")
    following = f.where("head").select(F.col("doc_id").alias("next_id"), F.col("f0").alias("n0"), F.col("f1").alias("n1"))
    f = f.join(following, "next_id", "left")
    f = f.join(near, (F.col("f0") == F.col("a0")) & (F.col("f1") == F.col("a1")), "left")
    f = f.withColumn("neighbours", F.when(asked, F.coalesce("neighbours", F.lit(0))))
    f = f.withColumn("_r", F.explode(F.sequence(F.lit(1).cast("bigint"), "many")))
    return f.select(
        "doc_id", "n_chars", "edited_sha256",
        as_hex("f0", "f1").alias("fingerprint"), as_hex("e0", "e1").alias("edited_fingerprint"),
        likeness(("f0", "f1"), ("e0", "e1")).alias("near_edited"), likeness(("f0", "f1"), ("n0", "n1")).alias("near_next"), "neighbours",
    )
