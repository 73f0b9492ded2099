"""Routing hashes with the values that other systems expect."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of 32-bit FNV-1a.
FNV_SEED, FNV_PRIME, FNV_MOD = 2166136261, 16777619, 4294967296


def fnv1a32(s: Column | str) -> Column:
    """32-bit FNV-1a over UTF-8 bytes as a bigint; a null is an empty string. No step passes 2^57."""
    h = F.hex(F.encode(F.coalesce(F.col(s) if isinstance(s, str) else s, F.lit("")), "UTF-8"))
    n = F.length(h) / 2
    at = F.when(n > 0, F.sequence(F.lit(1), n.cast("int"))).otherwise(F.array().cast("array<int>"))
    byte = lambda i: F.conv(F.substring(h, i * 2 - 1, F.lit(2)), 16, 10).cast("bigint")
    return F.aggregate(at, F.lit(FNV_SEED).cast("bigint"), lambda a, i: (a.bitwiseXOR(byte(i)) * F.lit(FNV_PRIME)) % F.lit(FNV_MOD))


def ring_slot(s: Column | str) -> Column:
    """SHA-1 modulo 256."""
    return F.conv(F.right(F.sha1(s), F.lit(2)), 16, 10).cast("int")


def content_hash(s: Column | str) -> Column:
    return F.sha2(s, 256)
