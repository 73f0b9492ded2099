"""License scan in DataFrame functions only.

Texts become lower-case runs of ASCII letters and digits, and those overlapping shingles of five. Windows of shingles
overlap by half. A template of m shingles takes windows of L, the first power of two from 2 m on, so each place where
it could stand lies whole in a window; then a window that holds c of the template is at least c m / (L + m - c m) like
it. With L < 4 m and c = 0.8, that is above 0.19, and 64 bands of one MinHash each collide with probability
1 - 0.81^64 > 0.999998. Collisions are checked by exact containment of the template's shingles.

Windows that share no shingle with any template can't collide with one; they are left out before any MinHash.

A null or empty text has no license. Repeated rows give repeated results of one document id once. Ties between
templates are all returned, in order of name. Templates of fewer than five words are refused.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Notices by which public licenses are named in texts. Each is cut to what tells it from its siblings, so that
# none is held to CONTAINED by another's text.
NOTICES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "apache-2.0-body": "Apache License Version 2.0, January 2004",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-nd-4.0": "Licensed under CC BY-ND 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "cc0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "gpl-2.0-short": "GNU General Public License, version 2",
    "gpl-3.0-short": "GNU General Public License, version 3",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "mit-short": "Released under the MIT License.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}

SHINGLE, BANDS, CONTAINED = 5, 64, 0.8
#: Templates are held in the plan; more shingles than this are refused rather than grow it.
MOST_SHINGLES = 50_000


def words(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits, in order; an empty text has none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda w: w != "")


def _staged(df: DataFrame, text: str) -> DataFrame:
    """Adds _s, the shingles of the text; the word hashes are computed once, in a projection of their own."""
    pair = lambda a, b: F.xxhash64(a, b)
    cut = lambda c, at, less: F.slice(c, F.lit(at), F.greatest(F.size(c) - less, F.lit(0)))
    df = df.withColumn("_h", F.transform(words(F.col(text)), lambda w: F.xxhash64(w)))
    df = df.withColumn("_two", F.zip_with(cut("_h", 1, 1), cut("_h", 2, 1), pair))
    df = df.withColumn("_four", F.zip_with(cut("_two", 1, 2), cut("_two", 3, 2), pair))
    df = df.withColumn("_s", F.zip_with(cut("_four", 1, 1), cut("_h", 5, 4), pair))
    # the condition is always true; the optimizer moves no filter below it, where the shingles would be made once more
    df = df.withColumn("_s", F.when(F.monotonically_increasing_id() >= 0, F.col("_s")))
    return df.drop("_h", "_two", "_four")


def _signature(s: Column) -> Column:
    """One minimum for each band."""
    seeded = lambda i: lambda x: F.xxhash64(x, F.lit(i))
    return F.array(*[F.array_min(F.transform(s, seeded(i))) for i in range(BANDS)])


def templates(spark, notices: dict[str, str]) -> DataFrame:
    """(license, _t distinct shingles, _len window length)."""
    for name, text in notices.items():
        if len(re.findall("[a-z0-9]+", text.lower())) < SHINGLE:
            raise ValueError(f"{name}: a template has {SHINGLE} words or more")
    df = _staged(spark.createDataFrame(sorted(notices.items()), "license string, _text string"), "_text")
    return df.select("license", F.array_distinct("_s").alias("_t"), F.pow(2, F.ceil(F.log2(2 * F.size("_s")))).cast("int").alias("_len"))


def scan(docs: DataFrame, notices: dict[str, str] = NOTICES, contained: float = CONTAINED) -> DataFrame:
    """docs (doc_id, text, ..) -> (doc_id, license, containment): the best window of each pair that holds enough."""
    t = templates(docs.sparkSession, notices)
    known = t.collect()  # bounded by what the caller passes in
    every = sorted({x for r in known for x in r._t})
    lengths = sorted({r._len for r in known})
    if len(every) > MOST_SHINGLES:
        raise ValueError(f"{len(every)} template shingles; {MOST_SHINGLES} are allowed")
    some = F.array(*[F.lit(x).cast("bigint") for x in every])
    d = _staged(docs.select(F.col("doc_id"), F.col("text").alias("_text")), "_text").select("doc_id", "_s")
    d = d.where(F.arrays_overlap("_s", some))
    # where each window of each length starts; the last may be shorter
    last = lambda n: F.greatest(F.floor((F.size("_s") - 1) / (n // 2)).cast("int"), F.lit(0))
    at = lambda n: lambda i: F.struct(F.lit(n).alias("n"), (i * (n // 2)).alias("at"))
    starts = F.flatten(F.array(*[F.transform(F.sequence(F.lit(0), last(n)), at(n)) for n in lengths]))
    d = d.select("doc_id", "_s", F.explode(starts).alias("_w"))
    d = d.select("doc_id", F.col("_w.n").alias("_len"), F.slice("_s", F.col("_w.at") + 1, F.col("_w.n")).alias("_win"))
    d = d.withColumn("_win", F.when(F.monotonically_increasing_id() >= 0, F.col("_win")))
    d = d.where(F.arrays_overlap("_win", some))
    found = d.select("doc_id", "_len", "_win", F.posexplode(_signature(F.col("_win"))).alias("_k", "_v"))
    bands = t.select("license", "_len", "_t", F.posexplode(_signature(F.col("_t"))).alias("_k", "_v"))
    hits = found.join(F.broadcast(bands), ["_len", "_k", "_v"])
    hits = hits.select("doc_id", "license", (F.size(F.array_intersect("_win", "_t")) / F.size("_t")).alias("containment"))
    return hits.where(F.col("containment") >= contained).groupBy("doc_id", "license").agg(F.max("containment").alias("containment"))


def scan_documents(docs: DataFrame, notices: dict[str, str] = NOTICES, contained: float = CONTAINED) -> DataFrame:
    """One row for each doc_id: licenses (names in order, maybe none) and the best containment (0: none)."""
    hits = scan(docs, notices, contained).select("doc_id", F.struct("license", "containment").alias("h"))
    every = docs.select("doc_id", F.lit(None).cast("struct<license:string,containment:double>").alias("h")).unionByName(hits)
    g = every.groupBy("doc_id").agg(F.sort_array(F.collect_set("h")).alias("h"))  # at most one for each template
    return g.select("doc_id", F.transform("h", lambda x: x["license"]).alias("licenses"), F.coalesce(F.array_max(F.transform("h", lambda x: x["containment"])), F.lit(0.0)).alias("containment"))
