"""Licence scan, with DataFrame functions only.

Every line and every paragraph of a text is a possible header, and a whole text a possible licence file, known by its
title or by its body; they are compared with templates by the cosine of sparse TF-IDF vectors. Files without a title
or header of their own inherit the licence of the nearest directory above them that holds a licence file, by joins on
directory paths.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelweft.llm.common import durable, table
from pixelweft.llm.line_dedup import row_keys

# Public notices, header paragraphs and licence texts.
_PERMISSION = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
    "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
    "subject to the following conditions:"
)
_AS_IS = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE "
    "OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_START = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_TWO = (
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_AS_IS = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE "
    "ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS "
    "OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF "
    "THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_ISC_AS_IS = (
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
    "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
    "PERFORMANCE OF THIS SOFTWARE."
)
_GPL = (
    "This {0} is free software: you can redistribute it and/or modify it under the terms of the {1} as published by the Free Software Foundation, either version {2} of the License, or (at your option) any later version. "
    "This {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {1} for more details."
)
_APACHE = (
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
    "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
    "See the License for the specific language governing permissions and limitations under the License."
)
_MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."

_GNU, _LESSER, _AFFERO = "GNU General Public License", "GNU Lesser General Public License", "GNU Affero General Public License"

#: Licence and notice: what a line or a paragraph of a file is compared with, and a whole text of one paragraph.
TEMPLATES: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-2.0", "This program is free software under the GNU General Public License, version 2"),
    ("LGPL-2.1", "This library is free software under the GNU Lesser General Public License, version 2.1"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0"),
    ("Proprietary", "All rights reserved"),
    ("MIT", _PERMISSION),
    ("Apache-2.0", _APACHE),
    ("GPL-3.0", _GPL.format("program", _GNU, 3)),
    ("GPL-2.0", _GPL.format("program", _GNU, 2)),
    ("LGPL-3.0", _GPL.format("library", _LESSER, 3)),
    ("LGPL-2.1", _GPL.format("library", _LESSER, 2.1)),
    ("AGPL-3.0", _GPL.format("program", _AFFERO, 3)),
    ("MPL-2.0", _MPL),
    ("ISC", _ISC),
    *((x, f"SPDX-License-Identifier: {x}") for x in ("Apache-2.0", "MIT", "GPL-3.0-only", "GPL-2.0-only", "LGPL-2.1-only", "BSD-3-Clause", "BSD-2-Clause", "MPL-2.0", "ISC", "CC0-1.0")),
]
#: Licence and text: what only a whole text is compared with. Longer licences may be given to ``scan``.
FILE_TEMPLATES: list[tuple[str, str]] = [
    ("MIT", f"MIT License Copyright (c) {_PERMISSION} The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_AS_IS}"),
    ("BSD-2-Clause", f"BSD 2-Clause License Copyright (c) All rights reserved. {_BSD_START} {_BSD_TWO} {_BSD_AS_IS}"),
    ("BSD-3-Clause", f"BSD 3-Clause License Copyright (c) All rights reserved. {_BSD_START} {_BSD_TWO} {_BSD_THIRD} {_BSD_AS_IS}"),
    ("ISC", f"ISC License Copyright (c) {_ISC} {_ISC_AS_IS}"),
]
#: Licence and title, which is what a licence file begins with: fixed values.
TITLES: list[tuple[str, str]] = [
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("GPL-1.0", "GNU GENERAL PUBLIC LICENSE Version 1, February 1989"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.0", "GNU LIBRARY GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("GFDL-1.2", "GNU Free Documentation License Version 1.2, November 2002"),
    ("GFDL-1.3", "GNU Free Documentation License Version 1.3, 3 November 2008"),
    ("MPL-1.1", "Mozilla Public License Version 1.1"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("EPL-2.0", "Eclipse Public License - v 2.0"),
    ("CC0-1.0", "CC0 1.0 Universal"),
    ("CC-BY-4.0", "Attribution 4.0 International"),
    ("CC-BY-SA-4.0", "Attribution-ShareAlike 4.0 International"),
    ("CC-BY-NC-4.0", "Attribution-NonCommercial 4.0 International"),
    ("MIT", "MIT License"),
    ("ISC", "ISC License"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
]
#: Least cosines of headers, of titles and of bodies.
SIMILARITY, TITLE_SIMILARITY, FILE_SIMILARITY = 0.6, 0.8, 0.85
#: A title is one of the first paragraphs of a file (those with words), so many, and has at most so many characters.
TITLE_PLACES, TITLE_LENGTH = 2, 400
WORD = "[^a-z0-9]+"
#: What stands between paragraphs: a line that is blank.
PARAGRAPH = "\n[ \\t\\r]*\n"


def template_words(text: str) -> list[str]:
    return [w for w in re.split(WORD, text.lower()) if w]


def vectors(templates: list[tuple[str, str]], df: dict[str, int], n_docs: int) -> list[tuple[int, str, dict[str, float]]]:
    """Number, licence and unit vector of each template."""
    out = []
    for i, (licence, text) in enumerate(templates):
        words = template_words(text)
        w = {t: words.count(t) * idf(df.get(t, 0), n_docs) for t in dict.fromkeys(words)}
        norm = math.sqrt(sum(x * x for x in w.values()))
        out.append((i, licence, {t: x / norm for t, x in w.items()}))
    return out


def idf(df: int, n_docs: int) -> float:
    return math.log((1 + n_docs) / (1 + df)) + 1


def markers(unit_vectors: list[tuple[int, str, dict[str, float]]], similarity: float, df: dict[str, int]) -> list[str]:
    """Words of which a text must hold one to reach the similarity: what is left of each template
    without them weighs less than that. They are the template's rarest, so that few texts hold one."""
    found = set()
    for _, _, w in unit_vectors:
        rest = 1.0
        for t, x in sorted(w.items(), key=lambda item: (df.get(item[0], 0), -item[1], item[0])):
            if rest < similarity * similarity:
                break
            found.add(t)
            rest -= x * x
    return sorted(found)


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), WORD), lambda w: w != "")


def scan(
    files: DataFrame, path: str, text: str, templates: list[tuple[str, str]] | None = None, similarity: float = SIMILARITY, file_templates: list[tuple[str, str]] | None = None,
    titles: list[tuple[str, str]] | None = None, title_similarity: float = TITLE_SIMILARITY, file_similarity: float = FILE_SIMILARITY,
) -> DataFrame:
    """Rows (row, path, header, header_score, file_licence, file_score, licence, basis, inherited_from) for
    each row; ``row`` is a pair of hashes of path and text.

    header is the licence of the line or paragraph that is most similar to a template, where the cosine is at least ``similarity``. file_licence is that of a licence
    file: of the title, one of its first two paragraphs with words that has at most 400 characters, where one is at least ``title_similarity`` to a template of titles;
    else of the whole text, where it is at least ``file_similarity`` to a file template, or, if it is one paragraph, to a template. Ties go to the first template. licence is that
    of a title or file template (basis 'file'), else the header (basis 'header'), else that of the nearest licence file in the file's directory or one above it (basis 'inherited'), else null
    (basis 'none'). Among the licence files of a directory the most similar decides, then the first
    path. Document frequencies of all words are counted over all files. Null texts have no words; a null
    path is in no directory. Rows that repeat both path and text are all returned, with the same result. An empty table gives an empty result. Other columns are not looked at.
    """
    spark = files.sparkSession
    own = templates is None
    kinds = {
        "notice": (TEMPLATES if own else templates, similarity),
        "body": ((FILE_TEMPLATES if own else []) if file_templates is None else file_templates, file_similarity),
        "title": ((TITLES if own else []) if titles is None else titles, title_similarity),
    }
    rows = files.select(F.col(path).alias("path"), F.col(text).alias("text")).withColumn("row", F.struct(*row_keys("path", "text")))

    vocabulary = sorted({w for known, _ in kinds.values() for _, t in known for w in template_words(t)})
    terms = F.array_append(F.array_distinct(F.split(F.lower(F.coalesce("text", F.lit(""))), WORD)), F.lit("*"))
    seen = rows.select(F.explode(terms).alias("term")).where("term != ''")
    frequencies = durable(seen.groupBy("term").agg(F.count("*").alias("df")), "document_frequencies")
    df = {r["term"]: r["df"] for r in frequencies.where(F.col("term").isin([*vocabulary, "*"])).collect()}  # a row for each template word
    n_docs = df.pop("*", 0)
    weights = {kind: vectors(known, df, n_docs) for kind, (known, _) in kinds.items()}

    needed = sorted({m for kind, (_, least) in kinds.items() for m in markers(weights[kind], least, df)})
    marked = F.lower("text").rlike(f"(?:^|[^a-z0-9])(?:{'|'.join(needed)})(?:[^a-z0-9]|$)")
    hits = durable(rows.where(marked).dropDuplicates(["row"]), "marked_files")
    paragraphs = F.split("text", PARAGRAPH)
    lines = hits.select("row", F.lit("part").alias("kind"), F.posexplode(F.split("text", "\n")).alias("unit", "text"))
    # paragraphs of one line are lines
    several = hits.select("row", F.lit("part").alias("kind"), F.posexplode(paragraphs).alias("unit", "text")).where(F.col("text").contains("\n"))
    heads = F.slice(F.filter(paragraphs, lambda p: F.lower(p).rlike("[a-z0-9]")), 1, TITLE_PLACES)
    heads = hits.select("row", F.lit("title").alias("kind"), F.posexplode(heads).alias("unit", "text")).where(F.length("text") <= TITLE_LENGTH)
    whole = hits.select("row", F.when(F.col("text").rlike(PARAGRAPH), "whole").otherwise("only").alias("kind"), F.lit(0).alias("unit"), "text")
    units = lines.unionByName(several.withColumn("unit", -1 - F.col("unit"))).unionByName(heads).where(marked).unionByName(whole)
    by = ["row", "kind", "unit"]
    counts = units.select(*by, F.explode(tokens(F.col("text"))).alias("term")).groupBy(*by, "term").agg(F.count("*").alias("tf"))
    idfs = frequencies.select("term", (F.log((1 + F.lit(n_docs)) / (1 + F.col("df"))) + 1).alias("idf"))
    weighed = counts.join(idfs.hint("merge"), "term").select(*by, "term", (F.col("tf") * F.col("idf")).alias("w"))
    weighed = durable(weighed, "file_terms")

    norms = weighed.groupBy(*by).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    table_ = spark.createDataFrame([(kind, i, lic, t, x) for kind, known in weights.items() for i, lic, w in known for t, x in w.items()], "of string, template int, licence string, term string, x double")
    compared = F.expr("(kind = 'part' and of = 'notice') or (kind = 'title' and of = 'title') or (kind in ('whole', 'only') and of = 'body') or (kind = 'only' and of = 'notice')")
    # the templates' words: as many rows as the caller's templates have
    dots = weighed.join(F.broadcast(table_), "term").where(compared).groupBy(*by, "of", "template", "licence").agg(F.sum(F.col("w") * F.col("x")).alias("dot"))
    least = F.when(F.col("kind") == "part", similarity).when(F.col("kind") == "title", title_similarity).otherwise(file_similarity)
    near = dots.join(norms.hint("merge"), by).select(*by, "of", "template", "licence", (F.col("dot") / F.col("norm")).alias("cos")).where(F.col("cos") >= least)
    first = F.struct((-F.round("cos", 9)).alias("c"), "of", "template", "licence")
    best = lambda *k: F.min(F.when(F.col("kind").isin(*k), first))
    found = near.groupBy("row").agg(best("part").alias("h"), best("title").alias("t"), best("whole", "only").alias("b"))
    found = durable(found.select("row", "h", F.coalesce("t", "b").alias("f")), "licences")

    directory = F.when(F.col("path").contains("/"), F.regexp_extract("path", "^(.*)/[^/]*$", 1)).otherwise("")
    named = rows.select("row", "path", directory.alias("dir")).join(found.hint("merge"), "row", "left")
    holders = hits.select("row", "path", directory.alias("dir")).join(found.where("f is not null").hint("merge"), "row")
    of_dir = holders.where("dir is not null").groupBy("dir").agg(F.min(F.struct(F.col("f.c"), "path", F.col("f.licence"))).alias("d"))
    # each directory and those above it, nearest first; all end at the root, ''
    parts = F.split("dir", "/")
    above = F.when(F.col("dir") == "", F.array(F.lit(""))).otherwise(F.transform(F.sequence(F.size(parts), F.lit(0), F.lit(-1)), lambda n: F.array_join(F.slice(parts, 1, n), "/")))
    dirs = rows.select(directory.alias("dir")).where("dir is not null").distinct()
    nearest = dirs.select(F.col("dir").alias("start"), F.posexplode(above).alias("up", "dir")).join(of_dir.hint("merge"), "dir")
    nearest = nearest.groupBy("start").agg(F.min(F.struct("up", "d")).alias("n")).select(F.col("start").alias("dir"), F.col("n.d").alias("d"))
    # a table, so that Spark can split a directory with very many files
    placed = named.join(durable(nearest, "nearest_licences").hint("merge"), "dir", "left")
    file = F.when(F.col("f.of") != "notice", F.col("f.licence"))
    inherits = file.isNull() & F.col("h").isNull() & F.col("d").isNotNull()
    return placed.select(
        "row", "path",
        F.col("h.licence").alias("header"), (-F.col("h.c")).alias("header_score"),
        F.col("f.licence").alias("file_licence"), (-F.col("f.c")).alias("file_score"),
        F.coalesce(file, "h.licence", "d.licence").alias("licence"),
        F.when(file.isNotNull(), "file").when(F.col("h").isNotNull(), "header").when(inherits, "inherited").otherwise("none").alias("basis"),
        F.when(inherits, F.col("d.path")).alias("inherited_from"),
    )


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a tree of files. They carry no paths: each source is a directory with one for
    each language below, and hundreds of ids below that; ids ending in 0 or 1 lie higher up."""
    docs = table(spark, sf_dir, "documents")
    last = F.pmod("doc_id", F.lit(10))
    source, lang = F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none"))
    folder = F.when(last == 0, source).when(last == 1, F.concat_ws("/", source, lang)).otherwise(F.concat_ws("/", source, lang, F.floor(F.col("doc_id") / 100).cast("string")))
    return docs.select("doc_id", "text", F.concat_ws("/", folder, F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias("path"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence of every document, its basis and scores, where documents are laid out as a tree of files.

    A null text has no words and can only inherit; a null id, source or language stands as 'none' in the path; repeated rows are all returned; an
    empty table gives an empty result.
    """
    files = document_files(spark, sf_dir)
    found = scan(files, "path", "text")
    ids = F.when(F.element_at(F.split("path", "/"), -1) != "none", F.element_at(F.split("path", "/"), -1)).cast("long")
    return found.select(
        ids.alias("doc_id"), "path", "licence", "basis", F.round("header_score", 6).alias("header_score"),
        F.round("file_score", 6).alias("file_score"), "inherited_from",
    )


def oracle() -> str:
    quoted = lambda t: t.replace("'", "''")
    known = [("notice", TEMPLATES), ("body", FILE_TEMPLATES), ("title", TITLES)]
    values = ", ".join(f"('{of}', {i}, '{lic}', '{quoted(t)}')" for of, templates in known for i, (lic, t) in enumerate(templates))
    return f"""
WITH files AS (
  SELECT doc_id, coalesce(text, '') AS text,
         CASE doc_id % 10 WHEN 0 THEN coalesce(source, 'none') WHEN 1 THEN coalesce(source, 'none') || '/' || coalesce(lang, 'none')
              ELSE coalesce(source, 'none') || '/' || coalesce(lang, 'none') || '/' || CAST(doc_id // 100 AS VARCHAR) END AS dir
  FROM documents),
f AS (SELECT *, dir || '/' || CAST(doc_id AS VARCHAR) AS path FROM files),
t AS (SELECT * FROM (VALUES {values}) v(of, template, licence, notice)),
tw AS (SELECT of, template, licence, unnest(regexp_split_to_array(lower(notice), '[^a-z0-9]+')) AS term FROM t),
tc AS (SELECT of, template, licence, term, count(*) AS tf FROM tw WHERE term <> '' GROUP BY ALL),
vocab AS (SELECT DISTINCT term FROM tc),
paragraphs AS (SELECT doc_id, unnest(range(len(ps))) AS i, unnest(ps) AS p FROM (SELECT doc_id, regexp_split_to_array(text, '\\n[ \\t\\r]*\\n') AS ps FROM f)),
worded AS (SELECT doc_id, p, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS i FROM paragraphs WHERE regexp_matches(lower(p), '[a-z0-9]')),
units AS (
  SELECT doc_id, CASE WHEN regexp_matches(text, '\\n[ \\t\\r]*\\n') THEN 'whole' ELSE 'only' END AS kind, 0 AS unit, text FROM f
  UNION ALL SELECT doc_id, 'title', i, p FROM worded WHERE i <= {TITLE_PLACES} AND length(p) <= {TITLE_LENGTH}
  UNION ALL SELECT doc_id, 'part', -1 - i, p FROM paragraphs WHERE contains(p, chr(10))
  UNION ALL SELECT doc_id, 'part', unnest(range(len(string_split(text, chr(10))))), unnest(string_split(text, chr(10))) FROM f),
uw AS (SELECT doc_id, kind, unit, unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) AS term FROM units),
uc AS (SELECT doc_id, kind, unit, term, count(*) AS tf FROM uw WHERE term <> '' GROUP BY ALL),
n AS (SELECT count(*) AS n FROM f),
idf AS (SELECT term, ln((1 + (SELECT n FROM n)) / (1.0 + count(doc_id))) + 1 AS idf
        FROM (SELECT term FROM vocab UNION SELECT term FROM uc) LEFT JOIN (SELECT DISTINCT doc_id, term FROM uc WHERE kind IN ('whole', 'only')) USING (term) GROUP BY term),
tx AS (SELECT of, template, licence, term, tf * idf AS x FROM tc JOIN idf USING (term)),
tn AS (SELECT of, template, licence, term, x / sqrt(sum(x * x) OVER (PARTITION BY of, template)) AS x FROM tx),
ux AS (SELECT doc_id, kind, unit, uc.term, tf * idf AS w FROM uc JOIN idf USING (term)),
norm AS (SELECT doc_id, kind, unit, sqrt(sum(w * w)) AS norm FROM ux GROUP BY ALL),
dots AS (SELECT doc_id, kind, unit, of, template, licence, sum(w * x) AS dot FROM ux JOIN tn USING (term) GROUP BY ALL),
near AS (SELECT doc_id, kind, of, template, licence, round(dot / norm, 9) AS c FROM dots JOIN norm USING (doc_id, kind, unit)
         WHERE dot / norm >= CASE kind WHEN 'part' THEN {SIMILARITY} WHEN 'title' THEN {TITLE_SIMILARITY} ELSE {FILE_SIMILARITY} END
           AND ((kind = 'part' AND of = 'notice') OR (kind = 'title' AND of = 'title') OR (kind IN ('whole', 'only') AND of = 'body') OR (kind = 'only' AND of = 'notice'))),
h AS (SELECT doc_id, licence, c FROM near WHERE kind = 'part' QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY c DESC, template) = 1),
w AS (SELECT doc_id, of, licence, c FROM near WHERE kind <> 'part' QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY kind <> 'title', c DESC, of, template) = 1),
own AS (SELECT doc_id, licence FROM w WHERE of <> 'notice'),
d AS (SELECT dir, w.licence, path FROM w JOIN f USING (doc_id) QUALIFY row_number() OVER (PARTITION BY dir ORDER BY c DESC, path) = 1),
dirs AS (SELECT DISTINCT dir AS start FROM f),
near_dir AS (SELECT start, licence, path FROM dirs JOIN d ON start = d.dir OR starts_with(start, d.dir || '/')
             QUALIFY row_number() OVER (PARTITION BY start ORDER BY length(d.dir) DESC) = 1)
SELECT f.doc_id, f.path, coalesce(own.licence, h.licence, nd.licence) AS licence,
       CASE WHEN own.licence IS NOT NULL THEN 'file' WHEN h.licence IS NOT NULL THEN 'header' WHEN nd.licence IS NOT NULL THEN 'inherited' ELSE 'none' END AS basis,
       round(h.c, 6) AS header_score, round(w.c, 6) AS file_score,
       CASE WHEN own.licence IS NULL AND h.licence IS NULL THEN nd.path END AS inherited_from
FROM f LEFT JOIN own USING (doc_id) LEFT JOIN h USING (doc_id) LEFT JOIN w USING (doc_id) LEFT JOIN near_dir nd ON nd.start = f.dir
"""
