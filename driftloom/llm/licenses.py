"""Licence scan of a file tree, in DataFrame operations.

Header blocks, paragraphs and lines that speak of licences, and licence files,
become sparse TF-IDF vectors over the vocabulary of the licence templates (titles,
notices and characteristic paragraphs of licence texts), weighed by the templates'
inverse document frequencies; the template of greatest cosine names the licence if
the cosine reaches a threshold.  Files without one inherit from the nearest
directory above them whose licence file has one.

Null and empty paths or texts match nothing.  Repeated rows are scanned as one and
each keeps its row.  Of equal cosines a line counts before a paragraph,
then the earlier place, then the licence first in alphabet.  Very long texts are scanned whole.  Columns of
the input that have the name of a result column are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, join_hot

#: Titles, notices and characteristic paragraphs by licence identifier, with the licence's class.
TEMPLATES = {
    "MIT": ("permissive", [
        "MIT License",
        "The MIT License (MIT)",
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ]),
    "ISC": ("permissive", [
        "ISC License",
        "SPDX-License-Identifier: ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ]),
    "Apache-2.0": ("permissive", [
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
        "Licensed under the Apache License, Version 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
        "\"License\" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document.",
        "\"Licensor\" shall mean the copyright owner or entity authorized by the copyright owner that is granting the License.",
    ]),
    "BSD-2-Clause": ("permissive", [
        "BSD 2-Clause License",
        "Released under the BSD 2-Clause License.",
        "SPDX-License-Identifier: BSD-2-Clause",
    ]),
    "BSD-3-Clause": ("permissive", [
        "BSD 3-Clause License",
        "Released under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ]),
    "GPL-2.0": ("copyleft", [
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
        "This work is licensed under the GNU General Public License, version 2.",
        "SPDX-License-Identifier: GPL-2.0",
        "SPDX-License-Identifier: GPL-2.0-or-later",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change free software--to make sure the software is free for all its users.",
    ]),
    "GPL-3.0": ("copyleft", [
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "This work is licensed under the GNU General Public License, version 3.",
        "SPDX-License-Identifier: GPL-3.0",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "The GNU General Public License is a free, copyleft license for software and other kinds of works.",
        "The licenses for most software and other practical works are designed to take away your freedom to share and change the works. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change all versions of a program--to make sure it remains free software for all its users.",
    ]),
    "LGPL-2.1": ("copyleft", [
        "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
        "SPDX-License-Identifier: LGPL-2.1",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ]),
    "LGPL-3.0": ("copyleft", [
        "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "SPDX-License-Identifier: LGPL-3.0",
        "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below.",
    ]),
    "AGPL-3.0": ("copyleft", [
        "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
        "SPDX-License-Identifier: AGPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software.",
    ]),
    "MPL-2.0": ("copyleft", [
        "Mozilla Public License Version 2.0",
        "SPDX-License-Identifier: MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    ]),
    "CC-BY-4.0": ("attribution", [
        "Licensed under CC BY 4.0.",
        "Creative Commons Attribution 4.0 International License.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ]),
    "CC-BY-SA-4.0": ("copyleft", [
        "Licensed under CC BY-SA 4.0.",
        "Creative Commons Attribution-ShareAlike 4.0 International License.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ]),
    "CC-BY-NC-4.0": ("noncommercial", [
        "Licensed under CC BY-NC 4.0.",
        "Creative Commons Attribution-NonCommercial 4.0 International License.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ]),
    "CC0-1.0": ("permissive", [
        "Released under CC0 1.0.",
        "Creative Commons CC0 1.0 Universal",
        "This work is dedicated to the public domain.",
    ]),
    "Unlicense": ("permissive", [
        "This is free and unencumbered software released into the public domain.",
    ]),
    "Proprietary": ("proprietary", [
        "All rights reserved.",
        "Confidential and proprietary. All rights reserved.",
    ]),
}
#: What a passage about licences has at least one of.
CUES = ("licen", "copyright", "rights reserved", "spdx", "public domain", "creative commons", "permission is hereby", "permission to use", "redistribution and use", "free software", "released under", "terms and conditions")
LEAST_COSINE = 0.6
LICENCE_FILE = r"(?i)^(licen[cs]e|copying|notice|unlicense)([.-].*)?$"
#: Signs of a comment at the start of a line.
COMMENT = r"(?m)^[ \t]*(?:/?\*+/?|//+|#+|;+|%+|--+|<!--|\.\.|rem\b)[ \t]?"
SCAN = "path string, at int, licence string, class string, cosine double"


def terms_of(text: Column) -> Column:
    """Lower-case words with versions whole: ``by``, ``nc``, ``2.0``."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}.]+|\.(?=[^\p{N}]|$)"), lambda w: w != "")


def template_vectors(spark: SparkSession) -> tuple[DataFrame, float]:
    """(term, notice, licence, class, idf, tw) with ``tw`` of unit length in each notice, and the weight of unknown words.

    The size is that of TEMPLATES, so these rows may be broadcast.
    """
    rows = [(f"{name}/{i}", name, kind, text) for name, (kind, texts) in TEMPLATES.items() for i, text in enumerate(texts)]
    named = spark.createDataFrame(rows, "notice string, licence string, class string, text string")
    counts = named.select("notice", "licence", "class", F.explode(terms_of(F.col("text"))).alias("term")).groupBy("notice", "licence", "class", "term").agg(F.count("*").alias("tf"))
    df = counts.groupBy("term").agg(F.count("*").alias("df"))
    idf = (F.log(F.lit(len(rows) + 1.0) / (F.col("df") + 1.0)) + 1.0).alias("idf")
    weighed = counts.join(df.select("term", idf), "term").withColumn("w", F.col("tf") * F.col("idf"))
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("notice")))
    # a word of no template weighs half as much as one of a single template
    return weighed.select("term", "notice", "licence", "class", "idf", (F.col("w") / length).alias("tw")), (math.log((len(rows) + 1.0) / 2.0) + 1.0) / 2


def _has_cue(text: Column) -> Column:
    lowered = F.lower(text)
    out = F.lit(False)
    for cue in CUES:
        out = out | lowered.contains(cue)
    return out


def passages(files: DataFrame) -> DataFrame:
    """(path, at, passage): lines with a cue, each with the line after it, and whole paragraphs, comment signs removed.

    ``at`` is the line, for a paragraph -1 - its number.  Whole files go through;
    only passages with a cue are kept.
    """
    plain = files.filter(_has_cue(F.col("text"))).select("path", F.regexp_replace("text", COMMENT, "").alias("plain"))
    lines = plain.select("path", F.split("plain", "\n").alias("l")).select("path", F.posexplode(F.transform("l", lambda x, i: F.struct(x.alias("one"), F.concat_ws(" ", x, F.try_element_at("l", i + 2)).alias("two")))).alias("at", "s"))
    lines = lines.filter(_has_cue(F.col("s.one"))).select("path", "at", F.explode(F.array("s.one", "s.two")).alias("passage"))
    blocks = plain.select("path", F.posexplode(F.split("plain", r"\n[ \t\r]*\n\s*")).alias("k", "passage")).select("path", (-1 - F.col("k")).alias("at"), "passage")
    return lines.unionByName(blocks.filter(_has_cue(F.col("passage")))).distinct()


def scan(files: DataFrame) -> DataFrame:
    """Rows (path, at, licence, class, cosine): the best match of each file of ``files`` (path, text).

    ``at`` is the line, or -1 - n for the n-th paragraph.  One narrow pass over the
    texts; only passages with a cue are taken apart.  An empty table gives none.
    """
    named = files.select("path", "text").filter(F.col("path").isNotNull() & F.col("text").isNotNull())
    goal, outside = template_vectors(files.sparkSession)
    words = goal.groupBy("term").agg(F.first("idf").alias("idf"))
    units = passages(named).withColumn("unit", F.xxhash64("passage"))
    terms = units.select("path", "at", "unit", F.explode(terms_of(F.col("passage"))).alias("term")).groupBy("path", "at", "unit", "term").agg(F.count("*").alias("tf"))
    weighed = terms.join(F.broadcast(words), "term", "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(outside)))
    # the length of a passage and its products with every template in one exchange by passage
    mine = F.collect_list(F.when(F.col("idf").isNotNull(), F.struct("term", "w"))).alias("mine")  # at most the vocabulary's size
    whole = weighed.groupBy("path", "at", "unit").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), mine)
    dots = (whole.select("path", "at", "unit", "norm", F.explode("mine").alias("m")).select("path", "at", "unit", "norm", "m.term", "m.w")
            .join(F.broadcast(goal), "term").groupBy("path", "at", "unit", "norm", "licence", "class", "notice").agg(F.sum(F.col("w") * F.col("tw")).alias("dot")))
    scored = dots.withColumn("cosine", F.round(F.col("dot") / F.col("norm"), 9)).filter(F.col("cosine") >= LEAST_COSINE)
    best = scored.groupBy("path").agg(F.min(F.struct((-F.col("cosine")).alias("c"), F.when(F.col("at") < 0, F.lit(1 << 30) - F.col("at")).otherwise(F.col("at")).alias("order"), "licence", "class", "at")).alias("b"))
    return best.select("path", F.col("b.at").cast("int").alias("at"), "b.licence", "b.class", (-F.col("b.c")).alias("cosine"))


def parent(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/")


def inherit(files: DataFrame, found: DataFrame) -> DataFrame:
    """Every row of ``files`` with its own licence, or that of the nearest directory above it.

    Directories, not files, are joined to their ancestors; ancestors with very many
    directories below them and directories with very many files are joined by
    broadcast.  ``inherited_from`` is the licence file's directory; files without
    either get ``unknown``.
    """
    tables = Scratch(files.sparkSession, "licences")
    names = ("licence", "licence_class", "cosine", "inherited_from")
    base = files.drop("text", *names)
    found = tables.keep(found, "found")
    at = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.when(F.col("dir") == "", 0).otherwise(F.size(at))), lambda n: F.array_join(F.slice(at, F.lit(1), n), "/"))
    declared = (found.filter(F.element_at(F.split("path", "/"), -1).rlike(LICENCE_FILE)).select(parent(F.col("path")).alias("up"), "licence", "class", "path")
                .groupBy("up").agg(F.min_by(F.struct("licence", "class"), "path").alias("d")))
    dirs = tables.keep(base.filter("path is not null").groupBy(parent(F.col("path")).alias("dir")).agg(F.count("*").alias("n")), "dirs")
    pairs = dirs.select("dir", F.posexplode(above).alias("depth", "up"))
    stats = tables.keep(pairs.groupBy("up").agg(F.count("*").alias("n")).join(declared, "up"), "above")
    near = join_hot(pairs, stats, "up").groupBy("dir").agg(F.max_by(F.struct("up", "d"), "depth").alias("near"))
    near = tables.keep(dirs.join(near, "dir"), "near")
    homed = base.withColumn("dir", parent(F.col("path")))
    given = join_hot(homed.select("path", "dir").distinct(), near, "dir").select("path", "near")
    own = found.select("path", F.col("licence").alias("__own"), F.col("class").alias("__class"), F.col("cosine").alias("__cosine"))
    marks = tables.keep(given.join(own, "path", "full").select("path", "near", "__own", "__class", "__cosine"), "marks")
    return (base.join(marks, "path", "left")
            .withColumns({"licence": F.coalesce("__own", "near.d.licence", F.lit("unknown")), "licence_class": F.coalesce("__class", "near.d.class", F.lit("unknown")),
                          "cosine": F.col("__cosine"), "inherited_from": F.when(F.col("__own").isNull(), F.col("near.up"))})
            .drop("__own", "__class", "__cosine", "near"))


def document_path(doc_id: Column, source: Column) -> Column:
    """Documents as a tree: the digits of the id name directories; an id ending in 0 is its directory's licence file."""
    text = F.lpad(F.coalesce(doc_id.cast("string"), F.lit("none")), 4, "0")
    digits = F.split(F.substring(text, F.lit(1), F.length(text) - 1), "")
    dirs = F.array_join(F.filter(digits, lambda c: c != ""), "/")
    leaf = F.when(doc_id % 10 == 0, F.lit("LICENSE")).otherwise(F.concat(F.lit("doc-"), text, F.lit(".txt")))
    return F.concat_ws("/", F.coalesce(source, F.lit("none")), dirs, leaf)
