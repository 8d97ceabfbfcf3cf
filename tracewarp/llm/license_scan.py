"""License scans: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies, in SQL functions only.

A text's words are its runs of letters and digits, A-Z lower-cased; shingles are five words. Templates fall into classes by
length; a class with at most n words has windows of n + s - 1 + n // 5 words that start every s = max(1, n // 4) words of every
text, so an occurrence of any of its templates lies inside a window and the window has few words more. If at least
``containment`` of a template's shingles are in a window, their Jaccard similarity is at least a bound that follows from
these numbers, and ``bands`` of one minimum each miss it with a probability of at most ``miss``.

A window and a template share a band's minimum only if the template's minimal shingle of that band is in the window. So
the minima of all templates' bands are an index of shingles: all shingles of all texts are looked up there, and the windows that
hold one get their bands, which join the templates' bands. Other windows can't share a band with any template. Templates,
index and bands are tables; they are broadcast where they have at most ``BROADCAST`` values.

Defined results: null, empty and short texts match nothing; texts of any length are scanned whole; a text can match several
templates; the best window of each template is returned, the first one among equals; repeated rows give one result a doc_id
and text; an empty table gives none. Templates need five words at least. Columns other than doc_id and text aren't read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, bound, written

WORDS, BROADCAST = 5, 1 << 20

#: Opening passages and notices of public licences.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "MIT": "Released under the MIT License.",
    "MIT-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software',
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "BSD-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
}


def words(text: Column) -> Column:
    low = ascii_lower(F.coalesce(text, F.lit("")))
    return F.filter(F.split(low, r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles(array: Column) -> Column:
    """XXH64 of every five words in a row; none if there are fewer."""

    def body(w):
        every = F.sequence(F.lit(0), F.size(w) - WORDS)
        return F.when(F.size(w) >= WORDS, F.transform(every, lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(WORDS))))).otherwise(F.expr("cast(array() as array<bigint>)"))

    return bound(array, body)


def classes(most: int) -> list[int]:
    """The largest lengths, in words, of the classes of templates up to ``most`` words."""
    tops = [WORDS]
    while tops[-1] < most:
        tops.append(max(tops[-1] + 1, tops[-1] * 5 // 4))
    return tops


def shape(n: int) -> tuple[int, int]:
    """(words in a window, words between two starts) for a class of at most n words."""
    step = max(1, n // 4)
    return n + step - 1 + n // 5, step


def least_similarity(n: int, top: int, containment: float) -> float:
    """The Jaccard similarity of window and template, of n words in a class, that a containment guarantees."""
    window, _ = shape(top)
    m, w = n - WORDS + 1, window - WORDS + 1
    both = math.ceil(containment * m)
    return both / (m + w - both)


def _send(df: DataFrame, values: int) -> DataFrame:
    return F.broadcast(df) if values <= BROADCAST else df


def scan(docs: DataFrame, templates: dict[str, str] | None = None, containment: float = 0.8, miss: float = 1e-6) -> DataFrame:
    """doc_id, template, containment, first_word, windows (that match) for each template found in a text of docs."""
    spark = docs.sparkSession
    given = spark.createDataFrame(sorted((templates or TEMPLATES).items()), "template string, text string")
    known = given.select("template", words(F.col("text")).alias("w")).select("template", F.size("w").alias("n"), F.array_distinct(shingles(F.col("w"))).alias("s"))
    known = written(known, "license-templates")
    if short := [r["template"] for r in known.where(F.col("n") < WORDS).select("template").collect()]:
        raise ValueError(f"templates of fewer than {WORDS} words: {short}")
    most, total, shortest = known.agg(F.max("n"), F.sum(F.size("s")), F.min("n")).first()
    tops = classes(most)
    floors = [WORDS, *(t + 1 for t in tops[:-1])]
    similarity = min(least_similarity(n, top, containment) for low, top in zip(floors, tops, strict=True) if top >= shortest for n in range(low, top + 1))
    bands = math.ceil(math.log(miss) / math.log(1 - similarity))
    table = F.broadcast(spark.createDataFrame([(c, *shape(t)) for c, t in enumerate(tops)], "wc int, width int, step int"))  # a row a class

    of_class = F.size(F.filter(F.array(*map(F.lit, tops)), lambda t: t < F.col("n")))
    known = known.select("template", "s", of_class.alias("class"))
    smallest = lambda s, i: F.array_min(F.transform(s, lambda h: F.struct(F.xxhash64(F.lit(i), h).alias("v"), h.alias("h"))))
    index = known.select("template", "class", F.posexplode(F.array(*(smallest(F.col("s"), i) for i in range(bands)))).alias("band", "x"))
    index = written(index.select("template", "class", "band", F.col("x.v").alias("v"), F.col("x.h").alias("h")), "license-index")
    entries = index.count()

    texts = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("tx"), shingles(words(F.col("text"))).alias("s"))
    every = texts.select("doc_id", "tx", F.posexplode("s").alias("place", "h"))
    probes = _send(index.select("h", F.col("class").alias("wc")).distinct().join(table, "wc"), entries)
    met = every.join(probes, "h").select("doc_id", "tx", "wc", "width", "step", "place")
    first = F.greatest(F.ceil((F.col("place") - F.col("width") + WORDS) / F.col("step")).cast("int"), F.lit(0))
    starts = met.select("doc_id", "tx", "wc", "width", F.explode(F.sequence(first, F.floor(F.col("place") / F.col("step")).cast("int"))).alias("k"), "step")
    window = F.struct(F.col("wc"), (F.col("k") * F.col("step")).alias("start"), (F.col("width") - WORDS + 1).alias("size"))
    asked = written(starts.groupBy("doc_id", "tx").agg(F.collect_set(window).alias("windows")), "license-places")

    asked = asked.select(F.col("doc_id").alias("id"), F.col("tx").alias("hash"), "windows")
    found = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("tx"), "text").join(asked, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("tx") == F.col("hash")))
    cut = lambda s: F.transform("windows", lambda x: F.struct(x["wc"].alias("class"), x["start"].alias("start"), F.slice(s, x["start"] + 1, x["size"]).alias("w")))
    found = found.select("doc_id", "tx", F.explode(bound(shingles(words(F.col("text"))), cut)).alias("x")).select("doc_id", "tx", "x.*")
    minimum = lambda i: F.array_min(F.transform("w", lambda h: F.xxhash64(F.lit(i), h)))
    minima = F.array(*map(minimum, range(bands)))
    banded = found.select("doc_id", "tx", "class", "start", "w", F.posexplode(minima).alias("band", "v"))
    retrieved = banded.join(_send(index.drop("h"), entries), ["class", "band", "v"]).groupBy("doc_id", "tx", "class", "start", "template").agg(F.first("w").alias("w"))
    checked = retrieved.join(_send(known.select("template", "s"), total), "template")
    checked = checked.withColumn("containment", F.size(F.array_intersect("s", "w")) / F.size("s")).where(F.col("containment") >= containment)
    best = F.max(F.struct("containment", (-F.col("start")).alias("back")))
    out = checked.groupBy("doc_id", "tx", "template").agg(best.alias("best"), F.countDistinct("start").alias("windows"))
    return out.select("doc_id", "template", F.col("best.containment").alias("containment"), (-F.col("best.back")).cast("long").alias("first_word"), "windows")


def op6_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
