"""Licences of files: TF-IDF cosine to templates, then inheritance from the nearest licensed folder.

Header units and whole texts of files that hold a notice are compared with
licence templates as sparse term vectors; document frequencies are counted over
all files. A header unit is a notice line, or a paragraph of a text or comment
with the comment marks taken off and its lines joined, so a wrapped header is
one unit. A licence file is known by its title paragraph or, if it is short, as
a whole. Where two licences come out alike, nothing is claimed. A file without
a licence of its own takes that of the nearest folder above it that has a
licence file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import text_of
from foliant.session import settle

_DISCLAIMER = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, "
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE "
    "LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS "
    "OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, "
    "OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD2 = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution."
)
_BSD3 = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
    "without specific prior written permission."
)
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal "
    "in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies "
    "of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
)
_MIT_REST = (
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", "
    "WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND "
    "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
    "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice "
    "and this permission notice appear in all copies."
)


def _free_software(what: str, name: str, version: str, mark: str) -> str:
    return (
        f"This {what} is free software{mark} you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software "
        f"Foundation{',' if mark == ':' else ';'} either version {version} of the License, or (at your option) any later version."
    )


_GPL, _LGPL, _AGPL = "General Public License", "Lesser General Public License", "Affero General Public License"
# Names, usual notices and short texts of common licences.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", _MIT),
    ("MIT", f"{_MIT} {_MIT_REST}"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", _free_software("program", _GPL, "2", ";")),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", _free_software("program", _GPL, "3", ":")),
    ("LGPL-2.1", "Licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-2.1", _free_software("library", _LGPL, "2.1", ";")),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", _free_software("program", _LGPL, "3", ":")),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", _free_software("program", _AGPL, "3", ":")),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-2-Clause", _BSD2),
    ("BSD-3-Clause", f"{_BSD2} {_BSD3}"),
    ("BSD-3-Clause", _BSD3),
    ("BSD-2-Clause", f"{_BSD2} {_DISCLAIMER}"),
    ("BSD-3-Clause", f"{_BSD2} {_BSD3} {_DISCLAIMER}"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("ISC", "Licensed under the ISC License."),
    ("ISC", _ISC),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    *((name, f"SPDX-License-Identifier: {name}") for name in (
        "MIT", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "MPL-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0", "ISC", "Unlicense")),
    *((name, f"SPDX-License-Identifier: {name}-{how}") for name in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0") for how in ("only", "or-later")),
)
# The title paragraphs of whole licence texts.
TITLES = (
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("CC0-1.0", "CC0 1.0 Universal"),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International Public License"),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International Public License"),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International Public License"),
)
#: Every template has one of these; a unit without any is not compared.
ANCHOR = r"(?i)licen[sc]e|public domain|hereby granted|free software|copyright|\bCC[ -]?(BY|0)|redistribution and use|neither the name"
#: Marks at the start of a comment's line.
MARKS = r"^[ \t]*(?:/\*+|\*+/?|//+|#+|--+|;+|%+|<!--|[\x22]{3}|[\x27]{3})?[ \t]*"
#: A text of so many characters with a licence's title in it is that licence's text, and so a licence file whatever its name is.
FULL_CHARS = 4000
#: What the best licence of a unit must be ahead of the second one.
MARGIN = 0.02
#: So many template terms are sent to every task; more are joined by a shuffle.
VOCABULARY_LIMIT = 1 << 16
FILE_NAMES = r"(?i)^(licen[sc]e|copying|notice|unlicense)([.-][A-Za-z0-9.-]*)?$"


def template_table(spark: SparkSession) -> DataFrame:
    rows = [(n, t, False) for n, t in TEMPLATES] + [(n, t, True) for n, t in TITLES]
    return spark.createDataFrame(rows, "licence string, template string, title boolean")


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9]+(?:[.-][a-z0-9]+)*"), F.lit(0))


def _weights(templates: DataFrame, docs: DataFrame, text_col: str) -> tuple[DataFrame, float]:
    """``(term, idf)`` of the templates' terms, from all documents, and the weight of any other term."""
    vocabulary = settle(templates.select(F.explode(terms(F.col("template"))).alias("term")).distinct())
    if vocabulary.count() <= VOCABULARY_LIMIT:
        vocabulary = F.broadcast(vocabulary)
    seen = (
        docs.select(F.explode(F.array_distinct(terms(text_of(text_col)))).alias("term")).join(vocabulary, "term", "left_semi")
        .groupBy("term").agg(F.count("*").alias("df"))
    )
    n = docs.count()
    idf = F.log((F.lit(n) + 1) / (F.coalesce("df", F.lit(0)) + 1)) + 1
    other = docs.sparkSession.range(1).select(F.log(F.lit(n) + 1) + 1).first()[0]
    return settle(vocabulary.join(seen, "term", "left").select("term", idf.alias("idf"))), float(other)


def _vectors(units: DataFrame, key: list[str], text: Column, idf: DataFrame, other: float) -> DataFrame:
    """``key, term, w``: unit-length sparse vectors; terms outside the templates only lengthen a vector."""
    tf = units.select(*key, F.explode(terms(text)).alias("term")).groupBy(*key, "term").agg(F.count("*").alias("tf"))
    w = tf.join(idf, "term", "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(other)))
    norm = w.groupBy(*key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return w.filter(F.col("idf").isNotNull()).join(norm, key).select(*key, "term", (F.col("w") / F.col("norm")).alias("w"))


def own_licences(
    docs: DataFrame, path: Column, id_col: str = "doc_id", text_col: str = "text", templates: DataFrame | None = None,
    threshold: float = 0.6,
) -> DataFrame:
    """``(doc, path, licence, score, whole)``: the best template of each file that has one at ``threshold`` or above.

    ``whole``: the text as a whole is a licence, not only a unit of it.
    ``templates`` has ``licence, template`` and, if titles are among them, ``title``.
    """
    spark = docs.sparkSession
    templates = template_table(spark) if templates is None else templates
    title = F.coalesce("title", F.lit(False)) if "title" in templates.columns else F.lit(False)
    templates = templates.select(F.xxhash64("licence", "template").alias("t"), "licence", "template", title.alias("title")).distinct()
    idf, other = _weights(templates, docs, text_col)
    text = text_of(text_col)
    rows = docs.select(F.col(id_col).alias("doc"), F.coalesce(path.cast("string"), F.lit("")).alias("path"), text.alias("text"))
    held = rows.filter(F.col("text").rlike(ANCHOR))
    lines = F.split("text", "\n", -1)
    bare = F.array_join(F.transform(lines, lambda x: F.regexp_replace(x, MARKS, "")), "\n")
    parts = F.concat(lines, F.transform(F.split(bare, "\n\n+", -1), lambda x: F.replace(x, F.lit("\n"), F.lit(" "))))
    units = settle(
        held.select("doc", "path", (F.length("text") >= FULL_CHARS).alias("long"), F.explode(F.concat(
            F.transform(F.array_distinct(F.filter(parts, lambda x: x.rlike(ANCHOR))), lambda x: F.struct(F.lit(False).alias("whole"), x.alias("unit"))),
            F.array(F.struct(F.lit(True).alias("whole"), F.col("text").alias("unit"))),
        )).alias("u")).select("doc", "path", "long", "u.whole", "u.unit", F.xxhash64("u.unit").alias("h"))
    )
    # Equal units of many files are compared once.
    distinct = units.select("h", "unit").dropDuplicates(["h"])
    mine = _vectors(distinct, ["h"], F.col("unit"), idf, other)
    theirs = _vectors(templates, ["t", "licence", "title"], F.col("template"), idf, other).withColumnRenamed("w", "tw")
    cosine = mine.join(theirs, "term").groupBy("h", "licence", "title", "t").agg(F.round(F.sum(F.col("w") * F.col("tw")), 6).alias("score"))
    per = cosine.groupBy("h", "licence").agg(F.max(F.struct("score", "title")).alias("m"))
    # At most one entry for each licence of the templates.
    ranked = per.groupBy("h").agg(F.sort_array(F.collect_list(F.struct((-F.col("m.score")).alias("s"), "licence", F.col("m.title").alias("title")))).alias("r"))
    first, second = F.get("r", F.lit(0)), F.get("r", F.lit(1))
    best = ranked.filter((-first["s"] >= threshold) & (F.round(F.coalesce(second["s"], F.lit(0.0)) - first["s"], 6) >= MARGIN)).select(
        "h", first["licence"].alias("licence"), (-first["s"]).alias("score"), first["title"].alias("title"))
    return (
        units.select("doc", "path", "long", "whole", "h").join(best, "h").groupBy("doc", "path")
        .agg(F.min(F.struct((-F.col("score")).alias("s"), "licence")).alias("m"), F.max(F.col("whole") | (F.col("title") & F.col("long"))).alias("whole"))
        .select("doc", "path", F.col("m.licence").alias("licence"), (-F.col("m.s")).alias("score"), "whole")
    )


def _folder(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def licences(
    docs: DataFrame, path: Column, id_col: str = "doc_id", text_col: str = "text", templates: DataFrame | None = None,
    threshold: float = 0.6,
) -> DataFrame:
    """``(id, path, licence, origin, score, from_folder)`` for every row of ``docs``.

    ``origin`` is ``own`` (a notice in the file), ``inherited`` (from the
    nearest folder above with a licence file: one with such a name and a
    licence in it, or one whose whole text is a licence), or null. Of several
    licence files in a folder the best score counts, then the first path.
    Null and empty texts have no licence of their own, a null path lies in the
    root folder, rows that agree in id and path share a licence, very long
    texts are cut into units like any other, an empty table gives no rows, and
    other columns are ignored.
    """
    own = settle(own_licences(docs, path, id_col, text_col, templates, threshold))
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    files = own.filter(F.col("whole") | name.rlike(FILE_NAMES)).withColumn("folder", _folder(F.col("path")))
    of_folder = files.groupBy("folder").agg(F.min(F.struct((-F.col("score")).alias("s"), "path", "licence")).alias("m")).select(
        "folder", F.col("m.licence").alias("licence"), (-F.col("m.s")).alias("score")
    )
    ids = docs.select(F.col(id_col).alias("id"), F.coalesce(path.cast("string"), F.lit("")).alias("path")).withColumn("folder", _folder(F.col("path")))
    # Each distinct folder is joined with its ancestors once; files then take the answer of their folder.
    steps = F.split("folder", "/", -1)
    up = F.transform(F.sequence(F.lit(0), F.size(steps)), lambda k: F.array_join(F.slice(steps, 1, k), "/"))
    chain = ids.select("folder").distinct().select("folder", F.explode(F.array_distinct(up)).alias("above"))
    near = (
        chain.join(of_folder.withColumnRenamed("folder", "above"), "above").groupBy("folder")
        .agg(F.max_by(F.struct("above", "licence", "score"), F.length("above")).alias("n"))
    )
    o = own.select(F.col("doc").alias("_doc"), F.col("path").alias("_path"), F.struct("licence", "score").alias("own"))
    all_ = ids.join(near, "folder", "left").join(o, F.col("id").eqNullSafe(F.col("_doc")) & (F.col("path") == F.col("_path")), "left")
    mine = F.col("own").isNotNull()
    return all_.select(
        F.col("id").alias(id_col), "path", F.coalesce("own.licence", "n.licence").alias("licence"),
        F.when(mine, "own").when(F.col("n").isNotNull(), "inherited").alias("origin"), F.coalesce("own.score", "n.score").alias("score"),
        F.when(~mine, F.col("n.above")).alias("from_folder"),
    )
