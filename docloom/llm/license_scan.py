"""Operator 10, license scans with DataFrame functions only.

Words are lower-cased runs of letters and digits, shingles are five words. A template of m
shingles is looked for in overlapping windows: one starts every s = max(1, m // 4) shingles
and is m + s - 1 long, so wherever a copy stands, some window holds all of it. A window that
holds 80 % of a template's shingles has a Jaccard similarity to it of JACCARD at least.
Windows and templates get BANDS min-hashes, a band each; a template is retrieved if one
band agrees, which fails with probability (1 - JACCARD) ** BANDS, under one in ten
thousand, at the least similarity and far less for better copies. For the templates that
are retrieved, the share of the template's distinct shingles that the window holds is
counted exactly, text by text.

Documents that hold none of a set of words are passed over first. The set is such that
without any of its words more than 20 % of a template's shingles are missing, so nothing is
lost by that. Texts are dealt by document once and the windows made and hashed in place,
so what is shuffled is the texts that are left, never their windows.

Edge cases: a null text is an empty text; texts under five words have no match; repeated
rows are scanned alike; an empty table gives an empty result; templates need five words;
only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.common import written

SIZE = 5
CONTAINED = 0.8
#: Least similarity of a window that holds CONTAINED of a template: .8 m / (m + .25 m + .2 m).
JACCARD = 0.55
BANDS = 12
#: Texts that are worked on together, up to 1024 parts; beyond that 16 times as many.
PART_DOCS = 256
#: Notices of public licenses (fixed values).
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "MIT": "Released under the MIT License.",
    "MIT header": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


def template_words(text: str) -> list[str]:
    return re.sub(r"[\W_]+", " ", text.lower()).split()


def template_shingles(text: str) -> list[str]:
    """Distinct shingles of a template, in order."""
    w = template_words(text)
    return list(dict.fromkeys(" ".join(w[k : k + SIZE]) for k in range(len(w) - SIZE + 1)))


def needed_words(text: str) -> list[str]:
    """Words without which more than a fifth of the template's shingles are missing."""
    shingles = template_shingles(text)
    chosen: list[str] = []
    for word in sorted(set(template_words(text)), key=lambda w: (-len(w), w)):
        missing = sum(any(c in s.split() for c in chosen) for s in shingles)
        if len(shingles) - missing < CONTAINED * len(shingles) - 1e-9:
            break
        chosen.append(word)
    return chosen


def words(text: Column) -> Column:
    clean = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))
    return F.filter(F.split(clean, " "), lambda w: w != "")


def shingles(docs: DataFrame) -> DataFrame:
    """(doc_id, t, pos, sh) of texts dealt by document, which is how the rows stay dealt."""
    w = docs.select("doc_id", "t", words(F.col("text")).alias("w")).where(F.size("w") >= SIZE)
    parts = [F.col("w")[F.col("pos") + k] for k in range(SIZE)]
    return (
        w.select("doc_id", "t", "w", F.explode(F.sequence(F.lit(0), F.size("w") - SIZE)).alias("pos"))
        .select("doc_id", "t", "pos", F.concat_ws(" ", *parts).alias("sh"))
    )


def stride(m: int) -> int:
    return max(1, m // 4)


def minhash(k: int) -> Column:
    """The k-th hash of a shingle, from its digest ``d``."""
    return F.min(F.xxhash64("d", F.lit(k)))


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """(doc_id, n_licenses, licenses, containment) of every document.

    ``licenses`` has the names of the templates found, in order and joined by ``;``;
    ``containment`` is the best share of a template's shingles in a window, 0 if none.
    """
    spark: SparkSession = docs.sparkSession
    known = {name: template_shingles(text) for name, text in templates.items()}
    sizes = sorted({len(s) for s in known.values() if s})
    rows = [(name, len(s), x) for name, s in sorted(known.items()) for x in s]
    table = spark.createDataFrame(rows, "name string, m int, sh string")  # the templates' shingles: bounded by the parameter

    # The least hash of each band, for templates and for windows.
    mins = [minhash(k).alias(f"h{k}") for k in range(BANDS)]
    bands = F.explode(F.array(*[F.struct(F.lit(k).alias("band"), F.col(f"h{k}").alias("h")) for k in range(BANDS)]))
    table = table.withColumn("d", F.xxhash64("sh"))
    wanted = table.groupBy("name", "m").agg(*mins).select("name", "m", bands.alias("b")).select("name", "m", "b.*")

    text = F.lower(F.coalesce(F.col("text"), F.lit("")))
    some = None
    for word in sorted({w for t in templates.values() for w in needed_words(t)}):
        some = text.contains(word) if some is None else some | text.contains(word)
    # Only these texts are dealt out, once; all of a document's windows are then made where it is.
    near = written(docs.select("doc_id", F.xxhash64("text").alias("t"), "text").where(some), "near")
    n = near.count()
    near = near.repartition(max(1, min(n // PART_DOCS, 1024), n // (16 * PART_DOCS)), "doc_id", "t")
    base = shingles(near).withColumn("d", F.xxhash64("sh"))
    # A window agrees in a band only if it holds the shingle that is least there in a template,
    # so only shingles within a window's length of such a one are hashed.
    least = table.groupBy("name", "m").agg(*[F.min_by("d", F.xxhash64("d", F.lit(k))).alias(f"d{k}") for k in range(BANDS)])
    least = least.select(F.explode(F.array(*[f"d{k}" for k in range(BANDS)])).alias("d")).distinct().withColumn("hit", F.lit(True))
    reach = max(n + stride(n) - 1 for n in sizes)
    in_text = Window.partitionBy("doc_id", "t").orderBy("pos")
    at = F.when(F.col("hit"), F.col("pos"))
    before = F.last(at, True).over(in_text.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(at, True).over(in_text.rowsBetween(0, Window.unboundedFollowing))
    close = (
        base.select("doc_id", "t", "pos", "d").join(F.broadcast(least), "d", "left").withColumns({"before": before, "after": after})
        .where((F.col("pos") - F.col("before") < reach) | (F.col("after") - F.col("pos") < reach))
    )
    m, s, pos = F.col("m"), F.col("s"), F.col("pos")
    every = F.explode(F.array(*[F.struct(F.lit(n).alias("m"), F.lit(stride(n)).alias("s")) for n in sizes]))
    first = F.greatest(F.lit(0), F.ceil((pos - m - s + 2) / s).cast("int"))
    spread = (
        close.select("doc_id", "t", "pos", "d", every.alias("e"))
        .select("doc_id", "t", "pos", "d", "e.*")
        .select("doc_id", "t", "d", "m", F.explode(F.sequence(first, F.floor(pos / s).cast("int"))).alias("win"))
    )
    windows = spread.groupBy("doc_id", "t", "m", "win").agg(*mins).select("doc_id", "t", "m", "win", bands.alias("b")).select("doc_id", "t", "m", "win", "b.*")
    retrieved = written(windows.join(F.broadcast(wanted), ["m", "band", "h"]).select("doc_id", "t", "name", "win").distinct(), "retrieved")

    # Exact containment: distinct shingles of the template at positions of the window.
    hits = base.join(F.broadcast(table.drop("d")), "sh").withColumn("s", F.greatest(F.lit(1), F.floor(m / 4).cast("int")))
    held = hits.select("doc_id", "t", "name", "m", "sh", F.explode(F.sequence(first, F.floor(pos / s).cast("int"))).alias("win"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("doc_id", "t", "name", "win")]
    shares = (
        held.join(retrieved.withColumnsRenamed({c: f"_{c}" for c in ("doc_id", "t", "name", "win")}), same, "left_semi")
        .groupBy("doc_id", "t", "name", "m", "win")
        .agg((F.count_distinct("sh") / m).alias("share"))
    )
    found = written(
        shares.where(F.col("share") >= CONTAINED)
        .groupBy("doc_id", "t")
        .agg(F.array_sort(F.collect_set("name")).alias("names"), F.max("share").alias("containment"))
        .select(F.col("doc_id").alias("_id"), F.col("t").alias("_t"), "names", "containment"),
        "licenses",
    )
    out = docs.select("doc_id", F.xxhash64("text").alias("t")).join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("t") == F.col("_t")), "left")
    return out.select(
        F.col("doc_id"),
        F.coalesce(F.size("names"), F.lit(0)).cast("long").alias("n_licenses"),
        F.coalesce(F.array_join("names", ";"), F.lit("")).alias("licenses"),
        F.coalesce("containment", F.lit(0.0)).alias("containment"),
    )


def oracle() -> str:
    """The same in DuckDB, over every window, without bands."""
    values = ", ".join(
        f"('{name}', {len(s)}, '{x}')" for name, s in sorted((n, template_shingles(t)) for n, t in TEMPLATES.items()) for x in s
    )
    return rf"""
WITH tpl(name, m, sh) AS (VALUES {values}),
w AS (
  SELECT doc_id, list_filter(string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' '), lambda x: x <> '') AS w
  FROM documents),
b AS (SELECT doc_id, w, unnest(range(0, len(w) - {SIZE - 1})) AS pos FROM w WHERE len(w) >= {SIZE}),
s AS (SELECT doc_id, pos, array_to_string(w[pos + 1 : pos + {SIZE}], ' ') AS sh FROM b),
h AS (
  SELECT doc_id, name, m, s.sh,
         unnest(range(greatest(0, CAST(ceil((pos - m - greatest(1, m // 4) + 2) / greatest(1, m // 4)) AS BIGINT)), pos // greatest(1, m // 4) + 1)) AS win
  FROM s JOIN tpl ON s.sh = tpl.sh),
c AS (SELECT doc_id, name, m, win, count(DISTINCT sh) / m AS share FROM h GROUP BY doc_id, name, m, win HAVING count(DISTINCT sh) / m >= {CONTAINED}),
f AS (SELECT doc_id, list_sort(list(DISTINCT name)) AS names, max(share) AS containment FROM c GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(len(names), 0) AS BIGINT) AS n_licenses, coalesce(array_to_string(names, ';'), '') AS licenses,
       coalesce(containment, 0.0) AS containment
FROM documents LEFT JOIN f USING (doc_id)
"""
