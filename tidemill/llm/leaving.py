"""Rows of a table of texts without those that some keys name; texts that stay aren't shuffled, however many keys there are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of 64 bits that all tasks get, at most; a few keys a word leave few texts to compare.
BITS = 1 << 20


def without(docs: DataFrame, gone: DataFrame, key: Column, also: Column) -> DataFrame:
    """Rows of docs but those that match a row of gone: its bigint _key is theirs, and also holds.

    gone is read more than once, so it has to be written. Its keys set bits; a text whose bit is clear stays where it is,
    and any other, a key's or one of another with the same bit, meets gone in a join.
    """
    name = max([*docs.columns, *gone.columns], key=len) + "_"  # no column is called so
    place = lambda h: h.bitwiseAND(F.lit(BITS - 1))
    bit = lambda h: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned(h, 58).cast("int"))
    h = F.xxhash64("_key")
    bits = gone.select(place(h).alias(f"{name}at"), bit(h).alias("_bit")).groupBy(f"{name}at").agg(F.bit_or("_bit").alias(f"{name}bits"))
    h = F.xxhash64(key)
    marked = docs.join(F.broadcast(bits), place(h) == F.col(f"{name}at"), "left")
    hit = F.coalesce(F.col(f"{name}bits").bitwiseAND(bit(h)), F.lit(0)) != 0
    stay, meet = (marked.where(w).select(*(docs[c] for c in docs.columns)) for w in (~hit, hit))
    return stay.unionByName(meet.join(gone, (key == gone["_key"]) & also, "left_anti"))
