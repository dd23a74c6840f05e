"""Licence scan by sparse TF-IDF cosine and directory inheritance (operator 1, built-ins only).

Lines (headers) and, in licence files, whole texts are compared with short templates as TF-IDF vectors,
runs of up to ``RUN`` lines with the licences' standard notices, and whole licence files with the
licences' full texts, which count before all others. How many documents contain each template word is
counted over all documents; words of no template of the kind weigh as if no document had them. A file without a licence of its own inherits that of its nearest ancestor
directory with a licence file, found by joining the ancestors of each directory.
"""

from __future__ import annotations

import math
import pkgutil
import re
from collections import Counter
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contraluz.llm.common import checkpointed

THRESHOLD = 0.6
TEXT_THRESHOLD = 0.85  # of full texts: long prose shares the frequent words of any of them
RUN = 12
LICENCE_FILE = r"(?i)^(licen[cs]e|copying|unlicense)([-._].*)?$"
WORD = "[^a-z0-9]+"

# Short forms of public licences' names, notices and opening sentences.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy"
     " of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "The MIT License (MIT)"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"
     " and associated documentation files, to deal in the Software without restriction"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("ISC", "Licensed under the ISC License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC0-1.0", "Released under CC0 1.0 Universal public domain dedication."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]

_GNU = ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU"
 " {0} as published by the Free Software Foundation; either version {1} of the License, or (at your"
 " option) any later version.")
NOTICES = [
    ("GPL-1.0", _GNU.format("General Public License", "1")),
    ("GPL-2.0", _GNU.format("General Public License", "2")),
    ("GPL-3.0", _GNU.format("General Public License", "3")),
    ("LGPL-2.0", _GNU.format("Library General Public License", "2")),
    ("LGPL-2.1", _GNU.format("Lesser General Public License", "2.1")),
    ("LGPL-3.0", _GNU.format("Lesser General Public License", "3")),
    ("AGPL-3.0", _GNU.format("Affero General Public License", "3")),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file'
     " except in compliance with the License. You may obtain a copy of the License at"
     " http://www.apache.org/licenses/LICENSE-2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy"
     " of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("MPL-1.1", 'The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License");'
     " you may not use this file except in compliance with the License. You may obtain a copy of the License"
     " at http://www.mozilla.org/MPL/"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"
     ' and associated documentation files (the "Software"), to deal in the Software without restriction,'
     " including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense,"
     " and/or sell copies of the Software"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without"
     " fee is hereby granted, provided that the above copyright notice and this permission notice appear in"
     " all copies."),
]
TEXTS = [
    "Apache-2.0", "MIT", "BSD-3-Clause", "ISC", "GPL-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1",
    "LGPL-3.0", "MPL-1.1", "MPL-2.0", "CC0-1.0", "Artistic-1.0", "GFDL-1.2", "GFDL-1.3",
]  # files of licence_texts


@cache
def template_kinds() -> dict[str, list[tuple[str, str]]]:
    """Names and texts of the templates by what they are compared with."""
    full = [(n, (pkgutil.get_data(__package__, f"licence_texts/{n}.txt") or b"").decode()) for n in TEXTS]
    return {"short": TEMPLATES, "run": NOTICES, "text": full}


def words_of(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.filter(F.split(F.lower(text), WORD), lambda w: w != "")


def template_words(templates: list[tuple[str, str]]) -> list[Counter]:
    return [Counter(w for w in re.split(WORD, text.lower()) if w) for _, text in templates]


class Weights:
    """Template vectors under the corpus's document frequencies; bounded by the templates."""

    def __init__(self, templates: list[tuple[str, str]], documents: int, found: dict[str, int]) -> None:
        self.names = [name for name, _ in templates]
        counted = template_words(templates)
        self.vocabulary = sorted({w for t in counted for w in t})
        self.unknown = math.log(1 + documents) + 1
        self.idf = {
            w: math.log((1 + documents) / (1 + found.get(w, 0))) + 1 for w in self.vocabulary
        }
        self.vectors = []
        for counts in counted:
            raw = {w: n * self.idf[w] for w, n in counts.items()}
            norm = math.sqrt(sum(v * v for v in raw.values()))
            self.vectors.append({w: v / norm for w, v in raw.items()})

    def anchors(self, threshold: float) -> list[str]:
        """Words of which every text that reaches the threshold has one.

        A text without any of a template's heaviest words has at most the norm of the rest as its
        cosine; enough words are taken to bring that below the threshold for every template.
        """
        chosen: set[str] = set()
        for vector in self.vectors:
            rest = 1 - sum(v * v for w, v in vector.items() if w in chosen)
            for w, v in sorted(vector.items(), key=lambda x: (-x[1], x[0])):
                if rest < threshold**2 - 1e-9:
                    break
                if w not in chosen:
                    chosen.add(w)
                    rest -= v * v
        return sorted(chosen)

    def fewest(self, threshold: float) -> int:
        """How many different template words a text needs to reach the threshold."""

        def needed(vector: dict[str, float]) -> int:
            mass = 0.0
            for i, v in enumerate(sorted(vector.values(), reverse=True), 1):
                mass += v * v
                if mass >= threshold**2 - 1e-9:
                    return i
            return len(vector)

        return min(map(needed, self.vectors))


def corpus_weights(files: DataFrame, text: str = "text") -> dict[str, Weights]:
    kinds = template_kinds()
    vocabulary = sorted({w for templates in kinds.values() for t in template_words(templates) for w in t})
    held = F.array_intersect(F.split(F.lower(F.col(text)), WORD), F.lit(vocabulary))
    rows = (
        files.select(F.explode(F.array_append(held, F.lit(""))).alias("w"))
        .groupBy("w")
        .agg(F.count("*").alias("n"))
        .collect()  # a row for each template word, and one for all documents with a text
    )
    found = {row["w"]: row["n"] for row in rows}
    documents = found.pop("", 0)
    return {kind: Weights(templates, documents, found) for kind, templates in kinds.items()}


def _runs(files: DataFrame, weights: Weights, threshold: float) -> DataFrame:
    """``(path, whole, s)`` of the runs of 2 to ``RUN`` lines, in texts that may hold a notice.

    A run starts at a line with a template word: without a line that has none it is nearer to all.
    """
    likely = files.where(F.arrays_overlap(F.split(F.lower("text"), WORD), F.lit(weights.anchors(threshold))))
    lines = F.split("text", "\n")
    spans = F.transform(F.sequence(F.lit(1), F.size(lines)), lambda i: F.slice(lines, i, RUN))
    spans = likely.select("path", F.explode(spans).alias("span")).where(F.size("span") > 1)
    begun = spans.where(F.arrays_overlap(F.split(F.lower(F.col("span")[0]), WORD), F.lit(weights.vocabulary)))
    size = F.explode(F.sequence(F.lit(2), F.size("span")))
    return begun.select("path", "span", size.alias("n")).select(
        "path", F.lit(False).alias("whole"), F.array_join(F.slice("span", F.lit(1), F.col("n")), " ").alias("s")
    )


def _statements(files: DataFrame, weights: dict[str, Weights], threshold: float) -> DataFrame:
    """``(path, whole, kind, s, sid)`` of the lines, runs and licence files' texts that may be licences."""
    line = F.explode(F.split(F.col("text"), "\n"))
    lines = files.select("path", F.lit(False).alias("whole"), line.alias("s"))
    texts = files.where("is_licence_file").select("path", F.lit(True).alias("whole"), F.col("text").alias("s"))

    def likely(rows: DataFrame, kind: str) -> DataFrame:
        own, least = weights[kind], _threshold(kind, threshold)
        words = rows.withColumn("words", F.split(F.lower("s"), WORD))
        found = words.where(F.arrays_overlap("words", F.lit(own.anchors(least))))
        if kind != "short":
            known = F.size(F.array_intersect("words", F.lit(own.vocabulary)))
            found = found.where(known >= own.fewest(least))
        joined = F.array_join(F.filter("words", lambda w: w != ""), " ")
        return found.select("path", "whole", F.lit(kind).alias("kind"), joined.alias("s"))

    runs = _runs(files, weights["run"], threshold)
    found = likely(lines.unionAll(texts), "short").unionAll(likely(runs, "run")).unionAll(likely(texts, "text"))
    return found.withColumn("sid", F.sha2("s", 256))


def _threshold(kind: str, threshold: float) -> float:
    return max(threshold, TEXT_THRESHOLD) if kind == "text" else threshold


def _matches(statements: DataFrame, weights: Weights, threshold: float) -> DataFrame:
    """``(sid, licence, score)`` of the distinct statements at or above the threshold."""
    distinct = statements.groupBy("sid").agg(F.first("s").alias("s"))
    counted = (
        distinct.select("sid", F.explode(F.split("s", " ")).alias("w"))
        .groupBy("sid", "w")
        .agg(F.count("*").alias("tf"))
    )
    rows = [
        (w, weights.idf[w], [vector.get(w, 0.0) for vector in weights.vectors])
        for w in weights.vocabulary
    ]
    known = statements.sparkSession.createDataFrame(rows, "w string, idf double, v array<double>")
    joined = counted.join(F.broadcast(known), "w", "left")  # the templates' own words
    weight = F.col("tf") * F.coalesce("idf", F.lit(weights.unknown))
    cosines = joined.groupBy("sid").agg(
        F.sum(weight * weight).alias("n2"),
        *[F.sum(F.coalesce(weight * F.col("v")[i], F.lit(0.0))).alias(f"d{i}") for i in range(len(weights.names))],
    )
    scores = [
        F.struct(
            F.round(F.col(f"d{i}") / F.sqrt("n2"), 6).alias("score"), F.lit(-i).alias("place")
        )
        for i in range(len(weights.names))
    ]
    best = cosines.select("sid", F.array_max(F.array(*scores)).alias("b"))
    names = F.lit(weights.names)
    return best.where(F.col("b.score") >= threshold).select(
        "sid", names[-F.col("b.place")].alias("licence"), F.col("b.score").alias("score")
    )


def directory_of(path: Column) -> Column:
    """All before the last slash; '' for a path without one."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def ancestors(directory: Column) -> Column:
    """The directory and those above it, as (depth, directory), the root '' at depth 0."""
    parts = F.split(directory, "/")
    below = F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda i: F.struct(
            i.alias("depth"), F.array_join(F.slice(parts, F.lit(1), i), "/").alias("directory")
        ),
    )
    root = F.array(F.struct(F.lit(0).alias("depth"), F.lit("").alias("directory")))
    return F.concat(root, F.filter(below, lambda a: a["directory"] != ""))


def scan(
    files: DataFrame, path: str = "path", text: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """``(path, own_licence, own_score, licence, origin, inherited_from)``, one row a path.

    ``origin`` is ``statement`` (a line or run of lines), ``licence file`` (its whole text matches best),
    ``inherited`` or null where no licence applies. A licence file that matches a full text has that
    licence, else the best score wins; ties go to the template that is listed first; a directory with several licence files takes the best of them. Rows that repeat
    a path are one file. Null paths are left out; null and empty texts match nothing and inherit.
    """
    named = files.where(F.col(path).isNotNull()).select(
        F.col(path).alias("path"),
        F.col(text).alias("text"),
        F.regexp_extract(F.col(path), r"([^/]*)$", 1).rlike(LICENCE_FILE).alias("is_licence_file"),
    )
    weights = corpus_weights(named)
    statements = checkpointed(_statements(named, weights, threshold))
    matches = None
    for kind, own in weights.items():
        of_kind = _matches(statements.where(F.col("kind") == kind), own, _threshold(kind, threshold))
        of_kind = of_kind.withColumn("kind", F.lit(kind))
        matches = of_kind if matches is None else matches.unionAll(of_kind)
    order = F.struct(
        F.col("kind") == "text", "score", F.negative(F.col("place")), F.negative(F.col("whole").cast("int"))
    )
    listed = [name for templates in template_kinds().values() for name, _ in templates]
    places = {name: i for i, name in reversed(list(enumerate(listed)))}
    rank = F.create_map(*[F.lit(x) for pair in places.items() for x in pair])
    own = (
        statements.select("path", "whole", "kind", "sid")
        .join(matches, ["kind", "sid"])
        .withColumn("place", rank[F.col("licence")])
        .groupBy("path")
        .agg(F.max_by(F.struct("licence", "score", "whole"), order).alias("own"))
    )
    each = named.groupBy("path").agg(F.max("is_licence_file").alias("is_licence_file"))
    held = checkpointed(
        each.join(own, "path", "left").select(
            "path", directory_of(F.col("path")).alias("directory"), "is_licence_file", "own.*"
        )
    )
    given = (
        held.where(F.col("is_licence_file") & F.col("licence").isNotNull())
        .withColumn("place", rank[F.col("licence")])
        .groupBy("directory")
        .agg(F.max_by("licence", F.struct("score", F.negative(F.col("place")))).alias("given"))
    )
    above = (
        held.where("licence is null")
        .select("directory")
        .distinct()
        .withColumn("a", F.explode(ancestors(F.col("directory"))))
        .select(F.col("directory").alias("below"), "a.*")
        .join(given, "directory")
        .groupBy("below")
        .agg(F.max_by(F.struct("given", "directory"), "depth").alias("near"))
    )
    out = held.join(above, held["directory"] == above["below"], "left")
    inherited = F.col("licence").isNull() & F.col("near").isNotNull()
    return out.select(
        "path",
        F.col("licence").alias("own_licence"),
        F.col("score").alias("own_score"),
        F.coalesce("licence", "near.given").alias("licence"),
        F.when(F.col("whole"), "licence file")
        .when(F.col("licence").isNotNull(), "statement")
        .when(inherited, "inherited")
        .alias("origin"),
        F.when(inherited, F.col("near.directory")).alias("inherited_from"),
    )
