"""License scans: MinHash bands over overlapping text windows, exact shingle containment; DataFrame operations only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventspark.llm.common import materialize
from eventspark.llm.decontam import ascii_words

# License notices as they stand in public texts.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT": "Released under the MIT License.",
    "MIT-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


def default_templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(TEMPLATES.items()), "template string, text string")


def _shingles(words: Column, k: int) -> Column:
    """Hashes of the k-word shingles in order; fewer words make one, none make none."""
    whole = F.when(F.size(words) > 0, F.array(F.xxhash64(F.array_join(words, " ")))).otherwise(F.array().cast("array<bigint>"))
    last = F.size(words) - k
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.concat_ws(" ", *[F.get(words, i + F.lit(j)) for j in range(k)])))).otherwise(whole)


def _salted(s: Column, salt: int) -> Column:
    return F.transform(s, lambda x: F.xxhash64(F.lit(salt), x))


def scan_licenses(docs: DataFrame, templates: DataFrame, k: int = 5, num: int = 4, den: int = 5, bands: int = 24, rows: int = 1, id_col: str = "doc_id", text_col: str = "text", template_col: str = "template", template_text: str = "text", seed: int = 101, anchor_rows: int = 20_000) -> DataFrame:
    """Matches: id, ``of`` (hash of the text), ``template``, ``containment``, ``at`` (first word of the best window's
    first shared shingle, from 0).

    A template matches where a window of the text holds ``num/den`` or more of its distinct k-word shingles.
    Templates are classed by their number of shingles n in [s, 2s). Windows of a class are 4s shingles long and
    start every 2s, so each stretch of 2s shingles lies whole in a window. A matching window and its template have a
    Jaccard similarity of (num/den) s / (4s + s (1 - num/den)) or more, 0.19 for 4/5; with 24 bands of one row they
    collide with a probability of 0.993 or more in the worst case, and 0.99998 for n near 2s. A template whose text
    comes entire has 0.25 to 0.5. Windows and templates with an equal band are verified on all shingles.

    Before, texts without any template shingle are set aside, which loses no match: up to ``anchor_rows`` distinct
    shingles by a set shipped with the scan, beyond them by a semi join on the shingles. Words are letters and digits, A-Z lower-cased. Null and word-less texts and templates, and rows
    of templates without a name, match nothing. Repeated rows are scanned once for each.
    """
    t = templates.select(F.col(template_col).cast("string").alias("template"), ascii_words(F.col(template_text)).alias("w"))
    t = t.select("template", F.array_distinct(_shingles(F.col("w"), k)).alias("ts")).where("template is not null and size(ts) > 0")
    t = t.withColumn("n", F.size("ts")).withColumn("class", F.floor(F.log2(F.col("n") + 0.5)).cast("int"))
    t = materialize(t, "license-templates")
    classes = [r["class"] for r in t.select("class").distinct().collect()]
    own = t.select(F.explode("ts").alias("x")).distinct()
    kept = [r["x"] for r in own.limit(anchor_rows + 1).collect()]
    # Words, shingles and the test on them stay apart: inlined into each other they would be made anew for each word.
    base = docs.select(F.col(id_col).alias(id_col), F.xxhash64(text_col).alias("of"), ascii_words(F.col(text_col)).alias("w"))
    base = base.select(id_col, "of", _shingles(F.col("w"), k).alias("s"))
    if len(kept) <= anchor_rows:
        near = base.select(id_col, "of", F.when(F.exists("s", lambda x: x.isin(kept)), F.col("s")).alias("s"))
    else:
        each = base.select(id_col, "of", F.explode(F.array_distinct("s")).alias("x")).join(own, "x", "left_semi")
        held = materialize(each.select(F.col(id_col).alias("__id"), F.col("of").alias("__of")).distinct(), "license-held")
        near = base.join(held, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("of") == F.col("__of")), "left_semi")
    near = materialize(near, "license-near").where("size(s) > 0")
    n_hash = bands * rows
    by_class = []
    for c in classes:
        win, hop = 4 << c, 2 << c
        starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("s") - win + hop - 1), F.lit(hop))
        by_class.append(near.select(id_col, "of", F.lit(c).alias("class"), F.explode(starts).alias("start"), "s").withColumn("ws", F.slice("s", F.col("start") + 1, win)).drop("s").where(F.size("ws") > 0))
    if not by_class:
        return base.select(id_col, "of", F.lit("").alias("template"), F.lit(0.0).alias("containment"), F.lit(0).alias("at")).where("false")
    windows = reduce(DataFrame.unionByName, by_class)

    def banded(df: DataFrame, s: str) -> DataFrame:
        return df.withColumn("mh", F.array(*[F.array_min(_salted(F.col(s), seed + j)) for j in range(n_hash)])).withColumn("b", F.explode(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.struct(b.alias("band"), F.xxhash64(F.slice("mh", b * rows + 1, rows)).alias("key"))))).drop("mh")

    tb = banded(t, "ts").select("class", "b.band", "b.key", "template")
    wb = banded(windows, "ws").select(id_col, "of", "class", "start", "ws", "b.band", "b.key")
    hits = wb.join(tb, ["class", "band", "key"]).select(id_col, "of", "start", "ws", "template").distinct()
    shared = hits.join(t.select("template", "ts", "n"), "template").withColumn("both", F.size(F.array_intersect("ws", "ts"))).where(F.col("both") * den >= F.col("n") * num)
    first = F.array_min(F.filter(F.transform("ws", lambda x, i: F.when(F.array_contains(F.col("ts"), x), i)), lambda i: i.isNotNull()))
    best = shared.groupBy(id_col, "of", "template").agg(F.max(F.struct((F.col("both") / F.col("n")).alias("containment"), (-(F.col("start") + first)).alias("at"))).alias("x"))
    return best.select(id_col, "of", "template", "x.containment", (-F.col("x.at")).cast("int").alias("at"))


def licenses_of(docs: DataFrame, templates: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """One row per document: id, ``n_licenses``, ``licenses`` (template names, sorted, comma-joined), ``matches``."""
    found = scan_licenses(docs, templates, id_col=id_col, text_col=text_col, **kw)
    per = found.groupBy(id_col, "of").agg(F.array_sort(F.collect_list(F.struct("template", "containment", "at"))).alias("matches"))
    per = per.select(F.col(id_col).alias("__id"), F.col("of").alias("__of"), "matches")
    left = docs.select(F.col(id_col).alias(id_col), F.xxhash64(text_col).alias("of"))
    out = left.join(per, left[id_col].eqNullSafe(per["__id"]) & (left["of"] == per["__of"]), "left")
    matches = F.coalesce("matches", F.array().cast("array<struct<template:string,containment:double,at:int>>"))
    return out.select(id_col, F.size(matches).cast("long").alias("n_licenses"), F.array_join(F.transform(matches, lambda m: m["template"]), ",").alias("licenses"), matches.alias("matches"))
