"""URL filters: rules by host and path, then a list of URLs behind a blocked Bloom filter.

The list's canonical URLs set eight bits each, one in each bigint of a 512-bit block; a block is a row. Distinct
canonical URLs of the table meet their block by a hash join, and only those whose bits are all set go on to an exact
hash join with the list, which removes the false positives. Nothing of either side is collected, and no side is
broadcast unless Spark finds it small at run time. Distinct URLs are made with map-side partials, so a URL that many
pages share is one row; the blocked URLs, no more than the list's, are salted for the join back to the pages.

A null URL, or one without `://`, has an empty host and path, fits no rule and is never listed. Repeated rows each
get their verdict. Columns of the input with other names are left out of the result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values: (verdict, host and path) of the query's rules.
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MOST_RULES, LANES, BITS_PER_URL, SALTS = 1000, 8, 24, 16


def rest(url: Column) -> Column:
    """What follows the first `://`; null if there is none."""
    return F.when(F.instr(url, "://") > 0, F.substring(url, F.locate("://", url) + 3, F.length(url)))


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(rest(url), r"^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without `www.`, path without a final slash, and the query without utm_* and ref, its parts in order.

    Null if the URL has no host.
    """
    query = F.regexp_extract(rest(url), r"^[^?#]*\?([^#]*)", 1)
    parts = F.array_sort(F.filter(F.split(query, "&"), lambda p: ~p.rlike(r"^(utm_[^=]*|ref)?(=|$)")))
    h = F.regexp_replace(host(url), r"^www\.", "")
    q = F.array_join(parts, "&")
    return F.when(h != "", F.concat(h, F.regexp_replace(path(url), r"/$", ""), F.when(q != "", F.concat(F.lit("?"), q)).otherwise("")))


def rule(h: Column, p: Column, rules: list[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; nulls if none does. Rules of one length are tried in order of text."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"{len(rules)} rules; {MOST_RULES} are allowed")

    def fits(text: str) -> Column:
        name, _, tail = text.partition("/")
        return ((h == name) | h.endswith(f".{name}")) & p.startswith(f"/{tail}")

    ordered = sorted(rules, key=lambda r: (-len(r[1]), r[1]))
    pick = lambda k: F.coalesce(*[F.when(fits(r[1]), F.lit(r[k])) for r in ordered], F.lit(None).cast("string"))
    return pick(1), pick(0)


def _masks(c: str) -> list[Column]:
    """One bit for each bigint of a block."""
    return [F.expr(f"shiftleft(1L, cast(xxhash64({c}, {i + 1}) & 63 as int))").alias(f"l{i}") for i in range(LANES)]


def bloom(urls: DataFrame, blocks: int) -> DataFrame:
    """urls (url) -> (block, l0 .. l7); a block without a URL has no row."""
    d = urls.select(F.pmod(F.xxhash64("url"), F.lit(blocks)).alias("block"), *_masks("url"))
    return d.groupBy("block").agg(*[F.bit_or(f"l{i}").alias(f"l{i}") for i in range(LANES)])


def possible(urls: DataFrame, table: DataFrame, blocks: int) -> DataFrame:
    """Those of urls (url) that the Bloom table can't rule out."""
    m = [f"m{i}" for i in range(LANES)]
    d = urls.select("url", F.pmod(F.xxhash64("url"), F.lit(blocks)).alias("block"), *[c.alias(n) for c, n in zip(_masks("url"), m, strict=True)])
    set_ = [F.col(f"l{i}").bitwiseAND(F.col(f"m{i}")) == F.col(f"m{i}") for i in range(LANES)]
    return d.join(table, "block").where(reduce(Column.__and__, set_)).select("url")


def block_count(urls: int) -> int:
    return max(1, -(-urls * BITS_PER_URL // (64 * LANES)))


def listed(urls: DataFrame, known: DataFrame) -> DataFrame:
    """Distinct url of urls (url) that known (url) holds."""
    known = known.where("url is not null").distinct()
    n = block_count(known.count())
    hits = possible(urls.where("url is not null").distinct(), bloom(known, n), n)
    return hits.join(known, "url", "left_semi")


def judge(pages: DataFrame, known: DataFrame, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """pages (page_id, url, ..), known (url, canonical) -> page_id, host, path, rule, verdict, listed.

    A rule's verdict stands; where none fits, listed URLs are blocked and others allowed.
    """
    p = pages.select("page_id", F.col("url").alias("_url"))
    p = p.select("page_id", host(F.col("_url")).alias("host"), path(F.col("_url")).alias("path"), canonical(F.col("_url")).alias("url"))
    found = listed(p.select("url"), known).select("url", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"), F.lit(True).alias("_hit"))
    p = p.withColumn("_salt", F.pmod(F.xxhash64("page_id", "host", "path"), F.lit(SALTS)).cast("int")).join(found, ["url", "_salt"], "left")
    name, verdict = rule(F.col("host"), F.col("path"), rules)
    hit = F.coalesce("_hit", F.lit(False))
    return p.select("page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, F.when(hit, "block").otherwise("allow")).alias("verdict"), hit.alias("listed"))
