"""Licence scans: sentences, header blocks and whole licence files are matched to templates by TF-IDF cosine, SPDX identifiers
are read as they stand, and files inherit from the nearest ancestor directory."""

from __future__ import annotations

import re
from collections import Counter
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.session import Scratch

#: Licence names and notices in common use.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License version 3"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD License"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
)
_GNU_FIRST = "This {what} is free software; you can redistribute it and/or modify it under the terms of the GNU {name} Public License as published by the Free Software Foundation; either version {version} of the License, or (at your option) any later version."
_GNU_REST = "This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} Public License for more details. You should have received a copy of the GNU {name} Public License along with this {what}. If not, see <https://www.gnu.org/licenses/>."
_GNU = (("GPL-2.0", "program", "General", "2"), ("GPL-3.0", "program", "General", "3"), ("LGPL-2.1", "library", "Lesser General", "2.1"), ("LGPL-3.0", "library", "Lesser General", "3"), ("AGPL-3.0", "program", "Affero General", "3"))
_MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
_APACHE = "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
_APACHE_REST = "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
#: Standard file headers, their first paragraphs, and titles of licence files.
HEADERS = (
    *((n, _GNU_FIRST.format(what=w, name=k, version=v)) for n, w, k, v in _GNU),
    *((n, _GNU_FIRST.format(what=w, name=k, version=v) + " " + _GNU_REST.format(what=w, name=k)) for n, w, k, v in _GNU),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("MPL-2.0", _MPL),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("Apache-2.0", _APACHE),
    ("Apache-2.0", _APACHE + _APACHE_REST),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
)
#: Whole licences, each named as its file.
TEXTS = Path(__file__).parent / "licence_texts"
TERM = "[a-z0-9]+(?:[.-][a-z0-9]+)*"
CUE = "(?i)licen[cs]e|copyright|spdx|permission is hereby|public domain|creative commons|redistribution"
LEAST_COSINE = 0.7
#: What stands before each line of a comment, and a leading comment: one in marks of both ends, or lines with a mark each.
MARKS = "(?m)^[ \\t]*(?:#+!?|/{2,}|/\\*+|\\*+/?|;+|--|<!--|%+|dnl\\b)|\\*/|-->"
CLOSED = "(?s)^\\s*(?:#![^\\n]*\\n\\s*)?(/\\*.*?\\*/|<!--.*?-->)"
NO_MARK = "(?m)^(?![ \\t\\r]*(?:#|//|;|--|%|dnl\\b|$))"
SPDX = "(?i)SPDX-License-Identifier:[ \\t]*([a-z0-9.+() -]+)"
LICENCE_FILE = "(?i)(^|/)(licen[cs]e|copying|notice)[^/]*$"


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def notices(files: DataFrame, path_col: str, text_col: str) -> DataFrame:
    """``path, notice``: of texts with a licence's cue words, the sentences, lines and paragraphs that have some, the leading comment, and all of a licence file."""
    text = F.col(text_col)
    cued = files.filter(text.rlike(CUE)).select(F.col(path_col).alias("path"), text.alias("text"), F.split(text, "\\n|(?<=[.!?])[ \\t]+", -1).alias("parts"))
    paragraphs = F.split(F.regexp_replace("text", MARKS, ""), "\\n[ \\t\\r]*\\n", -1)
    leading = F.array(F.regexp_extract("text", CLOSED, 1), F.get(F.split("text", NO_MARK, 2), F.lit(0)))
    whole = F.when(F.col("path").rlike(LICENCE_FILE), F.array("text")).otherwise(F.array().cast("array<string>"))
    units = F.array_distinct(F.concat("parts", paragraphs, leading, whole))
    return cued.select("path", F.explode(F.filter(units, lambda x: x.rlike(CUE))).alias("notice"))


def identified(files: DataFrame, path_col: str, text_col: str) -> DataFrame:
    """``path, licence, cosine``: the licences that SPDX identifiers name, with the cosine 1; exceptions and the words for none are left out."""
    names = F.create_map(*[F.lit(x) for name in sorted({n for n, _ in _templates()}) for x in (name.lower(), name)])
    stated = files.select(F.col(path_col).alias("path"), F.explode(F.regexp_extract_all(F.col(text_col), F.lit(SPDX), F.lit(1))).alias("stated"))
    ids = F.regexp_extract_all(F.regexp_replace("stated", "(?i)\\bWITH +[^ ()]+", ""), F.lit("[A-Za-z0-9][A-Za-z0-9.+-]*"), F.lit(0))
    ids = stated.select("path", F.explode(ids).alias("id")).filter(~F.lower("id").isin("and", "or", "none", "noassertion"))
    ids = ids.withColumn("id", F.regexp_replace("id", "(?i)-only$|-or-later$|[+]$|[.]$", ""))
    return ids.select("path", F.coalesce(F.try_element_at(names, F.lower("id")), F.col("id")).alias("licence"), F.lit(1.0).alias("cosine"))


def _templates() -> list[tuple[str, str]]:
    return [*TEMPLATES, *HEADERS, *((at.stem, at.read_text()) for at in sorted(TEXTS.glob("*.txt")))]


def matched(units: DataFrame) -> DataFrame:
    """``path, licence, cosine``: the best template of each path's notices.

    Terms weigh their count times ln((1 + notices) / (1 + notices with it)) + 1. The templates' terms, a fixed set, have their
    own weights; others, which no template shares, only lengthen a notice's vector and weigh as if never seen.
    """
    spark = units.sparkSession
    counted = [(i, name, term, n) for i, (name, text) in enumerate(_templates()) for term, n in Counter(re.findall(TERM, text.lower())).items()]
    terms = spark.createDataFrame(pa.table(dict(zip(("template", "licence", "term", "tf"), map(list, zip(*counted, strict=True)), strict=True))))
    vocabulary = terms.select("term").distinct()
    n = units.count()
    seen = units.select(F.explode(F.array_distinct(_terms(F.col("notice")))).alias("term")).join(F.broadcast(vocabulary), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = vocabulary.join(seen, "term", "left").select("term", (F.log(F.lit(1.0 + n) / (1 + F.coalesce("df", F.lit(0)))) + 1).alias("idf"))
    idf = spark.createDataFrame(idf.collect(), idf.schema)  # as many rows as the templates have terms
    rare = F.log(F.lit(1.0 + n)) + 1
    weights = terms.join(F.broadcast(idf), "term")
    weights = weights.withColumn("w", F.col("tf") * F.col("idf"))
    weights = weights.withColumn("w", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("template"))))

    # a notice's digest is its key: many files have the same one, and whole texts would be written once for each of their terms
    units = units.withColumn("key", F.unhex(F.sha2(F.col("notice").cast("binary"), 256)))
    texts = units.groupBy("key").agg(F.min("notice").alias("notice"))
    tf = texts.select("key", F.explode(_terms(F.col("notice"))).alias("term")).groupBy("key", "term").agg(F.count(F.lit(1)).alias("tf"))
    tf = tf.join(F.broadcast(idf), "term", "left").withColumn("v", F.col("tf") * F.coalesce("idf", rare))
    lengths = tf.groupBy("key").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("length"))
    dots = tf.join(F.broadcast(weights.select("template", "licence", "term", "w")), "term").groupBy("key", "template", "licence").agg(F.sum(F.col("v") * F.col("w")).alias("dot"))
    best = dots.join(lengths, "key").withColumn("cosine", F.round(F.col("dot") / F.col("length"), 6)).filter(F.col("cosine") >= LEAST_COSINE)
    best = best.groupBy("key").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "licence")).alias("b"))
    best = Scratch(spark, "licences").keep(best.select("key", F.col("b.licence").alias("licence"), (-F.col("b.c")).alias("cosine")), "notices")
    found = units.select("path", "key").join(best, "key").groupBy("path").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "licence")).alias("b"))
    return found.select("path", F.col("b.licence").alias("licence"), (-F.col("b.c")).alias("cosine"))


def scan(files: DataFrame, path_col: str = "path", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: ``path, licence, cosine, origin, from_dir`` and the columns named in ``keep``, ``kept_`` before a name that clashes with these.

    A file's SPDX identifiers come before what it resembles: all that it states, also those of a compound expression, are its licence, by name, joined by commas.
    ``origin`` is ``own`` if the file has a notice, header or text that matches a template or an SPDX identifier, ``inherited`` if it takes the licence of the nearest
    ancestor directory with a licence file (its first by path if it has several), else null. Null texts have no notice; rows
    with a null path neither have a licence nor give one. Rows that share a path share its licence. An empty table gives
    an empty table.
    """
    scratch = Scratch(files.sparkSession, "scan")
    units = scratch.keep(notices(files, path_col, text_col).filter("path is not null"), "units")
    spdx = identified(files, path_col, text_col).filter("path is not null")
    own = matched(units).withColumn("stated", F.lit(None).cast("string")).unionByName(spdx.withColumn("stated", F.col("licence")))
    own = own.groupBy("path").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "licence")).alias("b"), F.array_sort(F.collect_set("stated")).alias("stated"))
    licence = F.when(F.size("stated") > 0, F.array_join("stated", ", ")).otherwise(F.col("b.licence"))
    own = scratch.keep(own.select("path", licence.alias("licence"), (-F.col("b.c")).alias("cosine")), "own")
    parent = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    given = own.filter(F.col("path").rlike(LICENCE_FILE)).withColumn("dir", parent)
    given = given.groupBy("dir").agg(F.min(F.struct("path", "licence")).alias("first")).select("dir", F.col("first.licence").alias("licence"))

    named = files.select(F.col(path_col).alias("path"), F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in keep]).alias("kept"))
    rows = named.join(own.select(F.col("path").alias("p"), F.col("licence").alias("own_licence"), "cosine"), F.col("path") == F.col("p"), "left").drop("p").withColumn("dir", parent)
    # directories, not files, look for their ancestors
    dirs = rows.filter("path is not null").select("dir").distinct()
    steps = F.split("dir", "/", -1)
    folders = F.transform(F.sequence(F.lit(1), F.size("steps")), lambda k: F.array_join(F.slice("steps", 1, k), "/"))
    folders = F.array_distinct(F.concat(F.array(F.lit("")), folders))  # the top folder, of which relative paths say nothing
    above = dirs.withColumn("steps", steps).select("dir", F.posexplode(folders).alias("depth", "above"))
    near = above.join(given.select(F.col("dir").alias("above"), "licence"), "above").groupBy("dir").agg(F.max(F.struct("depth", "above", "licence")).alias("near"))
    near = scratch.keep(near.select(F.col("dir").alias("d"), F.col("near.above").alias("near_dir"), F.col("near.licence").alias("near_licence")), "near")
    rows = rows.join(near, F.col("dir") == F.col("d"), "left")
    has, heir = F.col("own_licence").isNotNull(), F.col("own_licence").isNull() & F.col("near_licence").isNotNull() & F.col("path").isNotNull()
    taken = {"path", "licence", "cosine", "origin", "from_dir"}
    return rows.select(
        *[F.col("kept")[c].alias(f"kept_{c}" if c in taken else c) for c in keep],
        "path",
        F.when(has, F.col("own_licence")).when(heir, F.col("near_licence")).alias("licence"),
        "cosine",
        F.when(has, F.lit("own")).when(heir, F.lit("inherited")).alias("origin"),
        F.when(heir, F.col("near_dir")).alias("from_dir"),
    )
