"""License scans, with DataFrame functions only: sparse TF-IDF cosine of headers and licence files to templates, then
inheritance from the nearest ancestor directory that holds a licence file.

Units of a text are its lines and its paragraphs (between blank lines), so a notice on one line and one over several are
both found, anywhere in the text. Words are runs of letters and digits, lower-cased. The templates' collection gives
the inverse document frequencies; numbers and everyday words count as if every template held them. A unit that holds none of a template's telling words, chosen so that the rest of
the template has a share below THRESHOLD of its length, cannot reach the threshold (Cauchy-Schwarz); only units with
such a word are taken apart, and of these only units whose length leaves room for the threshold are measured, which leaves the
result as it is. All of it happens within a row; only paths and licences are shuffled.

Defined results: null and empty texts have no licence of their own and may inherit; a null path counts as empty;
rows of the same path share the path's best match, unless a key says that each row is a document of its own, which then
shares the path for inheritance only; of equal cosines the first licence by name counts; a directory's
licence is its licence files' best; without one up to the root the licence is null. Extra columns are not read.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, functions as F

from cindersift.storage import written

THRESHOLD = 0.6
#: Licence and notice.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    # Of licence files.
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
)
TEMPLATES += tuple((name, f"SPDX-License-Identifier: {name}") for name in sorted({name for name, _ in TEMPLATES}))
#: The clauses of two licences begin alike; what only the longer one holds.
THIRD_CLAUSE = r"(?i)\bneither\s+the\s+names?\s+of\b"
#: Everyday words.
COMMON = frozenset("a an and any are as at by can do either except fee file following for form forms free from general in into is it later may me met not of on option or person terms that the their this to under use was with without work you your".split())
LICENCE_FILE = r"(?i)^(?:licen[cs]e|copying|unlicense)(?:[.-][^/]*)?$"


def _words(text: str) -> list[str]:
    return re.findall(r"[0-9a-z]+", text.lower())


class Vectors:
    """TF-IDF vectors of the templates: a bounded constant, in the plan as one literal."""

    def __init__(self, templates=TEMPLATES, threshold: float = THRESHOLD):
        self.names = [name for name, _ in templates]
        self.threshold = threshold
        bags = [_words(text) for _, text in templates]
        vocabulary = sorted(set().union(*bags))
        df = {w: len(bags) if w in COMMON or w.isdigit() else sum(w in b for b in bags) for w in vocabulary}
        self.idf = {w: math.log((1 + len(bags)) / (1 + df[w])) + 1 for w in vocabulary}
        self.unseen = math.log(1 + len(bags)) + 1
        raw = [{w: b.count(w) * self.idf[w] for w in set(b)} for b in bags]
        self.unit = [{w: v / math.sqrt(sum(x * x for x in r.values())) for w, v in r.items()} for r in raw]
        telling: set[str] = set()
        for u in self.unit:
            rest = 1.0
            for w, v in sorted(u.items(), key=lambda x: (x[0] in COMMON, -x[1], x[0])):
                if rest < threshold * threshold * 0.999:
                    break
                telling.add(w)
                rest -= v * v
        self.telling = sorted(telling)

    def literals(self) -> tuple[Column, Column, Column]:
        """Maps from a template word to its idf, to its idf times its weight in each template, and to the squared weights."""
        words = F.array(*map(F.lit, self.idf))
        tables = [F.array(*[F.array(*[F.lit(f(i, u.get(w, 0.0))) for u in self.unit]) for w, i in self.idf.items()]) for f in (lambda i, x: i * x, lambda i, x: x * x)]
        return F.map_from_arrays(words, F.array(*map(F.lit, self.idf.values()))), *[F.map_from_arrays(words, t) for t in tables]


def _named(files: DataFrame, path_col: str, text_col: str, key_col: str | None) -> tuple[DataFrame, list[str]]:
    """The files as path, text and, of rows that count one by one, key and the text's hash; and the names of what a match belongs to."""
    own = [] if key_col is None else [F.col(key_col).alias("key"), F.xxhash64(text_col).alias("hash")]
    return files.select(F.coalesce(F.col(path_col), F.lit("")).alias("path"), *own, F.col(text_col).alias("text")), ["path"] if key_col is None else ["path", "key", "hash"]


def matched(files: DataFrame, vectors: Vectors | None = None, *, path_col: str = "path", text_col: str = "text", key_col: str | None = None) -> DataFrame:
    """(path, own, cosine): the best licence of each path that has a unit over the threshold; with a key, of each (path, key, hash)."""
    v = vectors or Vectors()
    files, names = _named(files, path_col, text_col, key_col)
    telling = F.array(*map(F.lit, v.telling))
    # Cutting at everything else is much cheaper than searching for any of the words.
    cut = lambda text: F.split(F.lower(text), "[^0-9a-z]+")
    rows = files.where(F.arrays_overlap(cut(F.col("text")), telling))
    # A paragraph of one line is that line.
    units = F.concat(F.split("text", "\n"), F.filter(F.split("text", r"\n[ \t\r]*\n"), lambda p: F.contains(p, F.lit("\n"))))
    units = rows.select(*names, F.rlike("text", F.lit(THIRD_CLAUSE)).alias("third"), F.explode(F.array_distinct(F.filter(units, lambda u: F.arrays_overlap(cut(u), telling)))).alias("unit"))
    idf, weights, squares = v.literals()
    known = F.array(*map(F.lit, v.idf))
    zero = F.array_repeat(F.lit(0.0), len(v.names))
    words = F.array_remove(cut(F.col("unit")), "")
    add = lambda table: lambda t, w: F.zip_with(t, F.element_at(table, w), lambda a, b: a + b)
    # By Cauchy-Schwarz the squared cosine is at most what the unit's words cover of the template's squared length.
    covered = F.aggregate(F.array_intersect(F.array_distinct(words), known), zero, add(squares))
    words = units.where(F.array_max(covered) >= v.threshold**2 * 0.999).select(*names, "third", F.sort_array(words).alias("words"))
    words = words.withColumn("dots", F.aggregate(F.filter("words", lambda w: F.array_contains(known, w)), zero, add(weights)))
    # Equal words are neighbours, so one pass has each word's count.
    start = F.struct(F.lit("").alias("word"), F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("sum"))

    def closed(acc: Column) -> Column:
        weight = acc["n"] * F.coalesce(F.element_at(idf, acc["word"]), F.lit(v.unseen))
        return acc["sum"] + weight * weight

    def step(acc: Column, w: Column) -> Column:
        same = acc["word"] == w
        return F.struct(w.alias("word"), F.when(same, acc["n"] + 1).otherwise(F.lit(1)).cast("long").alias("n"), F.when(same, acc["sum"]).otherwise(closed(acc)).alias("sum"))

    # The length divides all products alike, so it stays outside the choice (inside, it would be measured for each template).
    most = F.array_min(F.zip_with("dots", F.array(*map(F.lit, v.names)), lambda d, name: F.struct((-F.round(d, 9)).alias("d"), name.alias("own"))))
    named = F.when(F.col("third") & (F.col("m.own") == "BSD-2-Clause"), "BSD-3-Clause").otherwise(F.col("m.own"))
    scored = words.select(*names, "third", most.alias("m"), F.sqrt(F.aggregate("words", start, step, closed)).alias("norm"))
    scored = scored.select(*names, F.struct(F.round(F.col("m.d") / F.col("norm"), 9).alias("c"), named.alias("own")).alias("b")).where(-F.col("b.c") >= v.threshold)
    return scored.groupBy(*names).agg(F.min("b").alias("b")).select(*names, F.col("b.own").alias("own"), (-F.col("b.c")).alias("cosine"))


def _directory(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def scanned(files: DataFrame, vectors: Vectors | None = None, *, path_col: str = "path", text_col: str = "text", key_col: str | None = None) -> DataFrame:
    """(path, own, cosine, licence, inherited_from), after the key if there is one: one row per input row; the licence is the own or the inherited one."""
    # Written, as three branches read it: the texts are looked at once.
    own = written(matched(files, vectors, path_col=path_col, text_col=text_col, key_col=key_col), "licences")
    rows, names = _named(files, path_col, text_col, key_col)
    theirs = own.select(*[F.col(c).alias(f"_{c}") for c in names], "own", "cosine")
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in names]  # a key may be null
    paths = rows.drop("text").join(theirs, same, "left").drop(*[f"_{c}" for c in names])
    paths = paths.withColumn("dir", _directory(F.col("path")))
    holders = paths.where(F.col("own").isNotNull() & F.rlike(F.regexp_extract("path", r"([^/]*)$", 1), F.lit(LICENCE_FILE)))
    holders = holders.groupBy(F.col("dir").alias("holder")).agg(F.min(F.struct((-F.col("cosine")).alias("c"), "own")).alias("h")).select("holder", F.col("h.own").alias("theirs"))
    # Each directory once, with all its ancestors (itself, ..., the root ""): the deepest holder is the nearest.
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    dirs = paths.where("own is null").select("dir").distinct().select("dir", F.posexplode(F.when(F.col("dir") == "", F.array(F.lit(""))).otherwise(above)).alias("depth", "holder"))
    nearest = dirs.join(holders, "holder").groupBy("dir").agg(F.max(F.struct("depth", "holder", "theirs")).alias("n"))
    out = paths.join(nearest, "dir", "left")
    inherits = F.col("own").isNull()
    return out.select(*([] if key_col is None else [F.col("key").alias(key_col)]), "path", "own", "cosine", F.coalesce("own", F.col("n.theirs")).alias("licence"), F.when(inherits, F.col("n.holder")).alias("inherited_from"))
