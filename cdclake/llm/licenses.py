"""Licences of files, in DataFrame functions only.

Lines, paragraphs, comments and whole licence files are compared with templates by the cosine
of their TF-IDF vectors, which are kept sparse: one row per term. Each licence has several
templates: its sentence, title, usual header, SPDX line and text. A file that states no
licence has that of the nearest directory above it that holds a licence file, found by joins
of paths.
"""

import math
import re
from functools import reduce
from operator import or_
from pathlib import Path

from pyspark.sql import functions as F

from cdclake.llm.common import checkpointed

# Identifiers and the sentences that name them. The SQL knows only these.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without "
                    "modification, are permitted under the BSD 3-Clause License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0, Creative Commons Attribution.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0": "Licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This file is subject to the terms of the Mozilla Public License, version 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
# More of each licence: identifier, name, other names of it, SPDX identifiers. Those that are
# not in TEMPLATES are here so that their texts are not taken for those of a close relative.
NAMES = [
    ("AGPL-3.0", "GNU Affero General Public License", ["version 3"], ["AGPL-3.0", "AGPL-3.0-only",
                                                                      "AGPL-3.0-or-later"]),
    ("Apache-2.0", "Apache License", ["", "Version 2.0", "2.0"], ["Apache-2.0"]),
    ("BSD-2-Clause", "BSD 2-Clause License", [""], ["BSD-2-Clause"]),
    ("BSD-3-Clause", "BSD 3-Clause License", [""], ["BSD-3-Clause"]),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International License", [""], ["CC-BY-4.0"]),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International License", [""],
     ["CC-BY-NC-4.0"]),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International License", [""],
     ["CC-BY-SA-4.0"]),
    ("GPL-2.0", "GNU General Public License", ["version 2"], ["GPL-2.0", "GPL-2.0-only",
                                                              "GPL-2.0-or-later"]),
    ("GPL-3.0", "GNU General Public License", ["version 3"], ["GPL-3.0", "GPL-3.0-only",
                                                              "GPL-3.0-or-later"]),
    ("LGPL-2.1", "GNU Lesser General Public License", ["version 2.1"],
     ["LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later"]),
    ("LGPL-3.0", "GNU Lesser General Public License", ["version 3"],
     ["LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later"]),
    ("MIT", "MIT License", [""], ["MIT"]),
    ("MPL-2.0", "Mozilla Public License", ["Version 2.0", "v. 2.0"], ["MPL-2.0"]),
    ("Unlicense", "Unlicense", [""], ["Unlicense"]),
]
PHRASES = ["{}", "The {}", "Licensed under the {}", "Released under the {}",
           "This project is licensed under the {}", "This work is licensed under the {}",
           "This project is licensed under the {} - see the LICENSE file for details"]
# Headers over several lines; titles that differ from the name; {} is a name of NAMES.
GNU = ("This program is free software: you can redistribute it and/or modify it under the terms of "
       "the {0} as published by the Free Software Foundation, either {1} of the License, or (at "
       "your option) any later version. This program is distributed in the hope that it will be "
       "useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or "
       "FITNESS FOR A PARTICULAR PURPOSE. See the {0} for more details. You should have received a "
       "copy of the {0} along with this program. If not, see <https://www.gnu.org/licenses/>.")
COMMONS = ("This work is licensed under the {0}. To view a copy of this license, visit "
           "http://creativecommons.org/licenses/{1}/4.0/ or send a letter to Creative Commons, PO "
           "Box 1866, Mountain View, CA 94042, USA.")
HEADERS = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not "
     "use this file except in compliance with the License. You may obtain a copy of the License at "
     "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
     "writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
     "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for "
     "the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. "
     "2.0. If a copy of the MPL was not distributed with this file, You can obtain one at "
     "https://mozilla.org/MPL/2.0/."),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("MIT", "The MIT License (MIT)"), ("BSD-3-Clause", "New BSD License"),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International Public License"),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International Public License"),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International Public License"),
]
LEAST = 0.8
# Licence texts share so many words that one needs more to be told from others: texts of other
# families (Boost, NCSA) score up to 0.86, the MIT text without its last paragraph 0.88.
LONG, LEAST_LONG = 120, 0.87
TERM = "[a-z0-9]+(?:[.-][a-z0-9]+)*"
ANCHOR = r"(?i)licen[sc]|spdx|copyright|public domain|redistribution"
# One of these is in every lower-cased text that matches ANCHOR; found without a pattern.
HINTS = ("licens", "licenc", "spdx", "copyright", "public domain", "redistribution")
LICENCE_FILE = r"(?i)^(un)?licen[sc]es?([._-].*)?$|^copying([._-].*)?$|^notice([._-].*)?$"
# A line that is a comment by its start, and comments that have an end of their own.
COMMENT_LINE = r"[ \t]*(?:#|//|/?\*|--|;|%|(?i:dnl|rem)\b)"
COMMENT = r"/\*[\s\S]*?(?:\*/|\z)|<!--[\s\S]*?(?:-->|\z)|\"{3}[\s\S]*?(?:\"{3}|\z)"


def library():
    """All templates as pairs (licence, text)."""
    found = list(TEMPLATES.items()) + HEADERS
    for licence, name, versions, ids in NAMES:
        found += [(licence, phrase.format(", ".join(filter(None, [name, version]))))
                  for version in versions for phrase in PHRASES]
        found += [(licence, f"SPDX-License-Identifier: {i}") for i in ids]
        if name.startswith("GNU"):
            found += [(licence, GNU.format(name, versions[0]))]
        if name.startswith("Creative"):
            found += [(licence, COMMONS.format(name, licence[3:-4].lower()))]
    texts = sorted((Path(__file__).parent / "licence_texts").glob("*.txt"))
    return found + [(p.stem.split("@")[0], p.read_text(encoding="utf-8")) for p in texts]


def terms(text):
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def speaks(text, lowered):
    """Whether a text speaks of a licence; the pattern runs only where a hint is."""
    return reduce(or_, [lowered.contains(h) for h in HINTS]) & text.rlike(ANCHOR)


def weights(templates):
    """Rows (licence, number, term, weight) of the unit vectors of templates (licence, text), the
    weight of each term in any text by its rarity among the templates, and that of a term in
    none of them."""
    counted = []
    for _, text in templates:
        own = {}
        counted.append(own)
        for term in re.findall(TERM, text.lower()):
            own[term] = own.get(term, 0) + 1
    total = len(templates)
    vocabulary = sorted({t for own in counted for t in own})
    idf = {t: round(math.log((1 + total) / (1 + sum(t in own for own in counted))) + 1, 6)
           for t in vocabulary}
    rows = []
    for number, (name, own) in enumerate(zip([name for name, _ in templates], counted)):
        length = math.sqrt(sum((n * idf[t]) ** 2 for t, n in own.items()))
        rows += [(name, number, t, n * idf[t] * idf[t] / length) for t, n in sorted(own.items())]
    return rows, idf, round(math.log(1 + total) + 1, 6)


def matches(statements, keys, templates=None, least=LEAST):
    """The best licence of each statement (columns `keys` and `statement`) with its score, that
    of the nearest of its templates, if it reaches `least` (LEAST_LONG for templates of over LONG
    terms); of equal scores the alphabetically first licence. `templates` are pairs (licence,
    text)."""
    spark = statements.sparkSession
    templates = templates or library()
    rows, idf, unknown = weights(templates)
    # Two tables with a row per term of the templates: as small as these are.
    dots = spark.createDataFrame(rows, "licence string, template int, term string, gain double")
    rarity = spark.createDataFrame(list(idf.items()), "term string, idf double")
    counted = (statements.select(*keys, F.explode(terms(F.col("statement"))).alias("term"))
               .groupBy(*keys, "term").agg(F.count("*").alias("n")))
    weighed = counted.join(F.broadcast(rarity), "term", "left").withColumn(
        "w", F.col("n") * F.coalesce("idf", F.lit(unknown)))
    length = weighed.groupBy(*keys).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    # No template can be nearer than the share of a statement that is in any template.
    known = F.sum(F.when(F.col("idf").isNotNull(), F.col("w") * F.col("w")).otherwise(0))
    near = weighed.groupBy(*keys).agg(
        known.alias("known"), F.sum(F.col("w") * F.col("w")).alias("all")).where(
            F.col("known") >= F.col("all") * (least * least - 1e-4)).select(*keys)
    dot = (weighed.join(near, keys, "left_semi").join(F.broadcast(dots), "term").groupBy(*keys, "licence", "template")
           .agg(F.sum(F.col("n") * F.col("gain")).alias("dot")))
    long = [number for number, (_, text) in enumerate(templates)
            if len(re.findall(TERM, text.lower())) > LONG]
    enough = F.when(F.col("template").isin(long), F.lit(max(least, LEAST_LONG))).otherwise(least)
    scored = (dot.join(length, keys).withColumn("score", F.round(F.col("dot") / F.col("length"), 6))
              .where(F.col("score") >= enough))
    return scored.groupBy(*keys).agg(F.min_by("licence", F.struct(
        -F.col("score"), "licence")).alias("licence"), F.max("score").alias("score"))


def blocks(text):
    """Array of the lines, paragraphs, runs of comment lines and closed comments of a text."""
    runs = F.regexp_replace(text, f"(?m)^(?!{COMMENT_LINE}).*$", "\x00")
    return F.concat(F.split(text, "\n", -1), F.split(text, r"\n[ \t\r]*\n", -1),
                    F.split(runs, "\x00", -1), F.regexp_extract_all(text, F.lit(COMMENT), F.lit(0)))


def scan(files, templates=None, least=LEAST):
    """path, licence, score, origin and directory of every different path of `files`.

    `files` has path and text. A statement is a line, a paragraph, a run of comment lines or a
    comment of a file that speaks of a licence, and a licence file (by its name) as a whole;
    the best one counts, of equal ones the licence
    first in the alphabet. `origin` is `stated` for a file's own licence, `inherited` for
    that of the nearest directory above (`directory`) with a licence file, else `none`, with
    NULLs. Of several licence files in a directory that with the best score counts. A NULL
    path is left out, a NULL or empty text states nothing; of rows that share a path all
    statements count. Other columns play no part.
    """
    text, statement = F.col("text"), F.explode("statements").alias("statement")
    holds = F.element_at(F.split("path", "/"), -1).rlike(LICENCE_FILE)
    none = F.array().cast("array<string>")
    lines = F.when(speaks(text, F.col("low")), F.array_distinct(F.filter(
        blocks(text), lambda block: block.rlike(ANCHOR)))).otherwise(none)
    # Texts are read once; all that follows needs only their paths and statements.
    files = checkpointed(
        files.where("path IS NOT NULL").select("path", F.coalesce("text", F.lit("")).alias("text"))
        .withColumn("low", F.lower("text")).select("path", F.concat(
            lines, F.when(holds, F.array(text)).otherwise(none)).alias("statements")))
    # Dealt out by statement once: what follows counts within one and moves nothing.
    statements = (files.select("path", statement).withColumn("number", F.xxhash64("statement"))
                  .repartition("path", "number").distinct())
    found = matches(statements, ["path", "number"], templates, least)
    stated = found.groupBy("path").agg(
        F.min_by("licence", F.struct(-F.col("score"), "licence")).alias("licence"),
        F.max("score").alias("score"))

    def above(path):
        return F.regexp_replace(path, "/?[^/]*$", "")

    held = (stated.withColumn("name", F.element_at(F.split("path", "/"), -1))
            .where(F.col("name").rlike(LICENCE_FILE)).select(
                above(F.col("path")).alias("directory"), "licence", "score")
            .groupBy("directory").agg(
                F.min_by("licence", F.struct(-F.col("score"), "licence")).alias("licence"),
                F.max("score").alias("score")))
    # Each directory that has files, with all directories above it: bounded by their depth.
    own = files.select(above(F.col("path")).alias("own")).distinct()
    parts = F.split("own", "/")
    chain = own.select("own", F.explode(F.transform(
        F.sequence(F.lit(0), F.when(F.col("own") == "", F.lit(0)).otherwise(F.size(parts))),
        lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("directory")).distinct()
    nearest = chain.join(held, "directory").groupBy("own").agg(F.max_by(
        F.struct("directory", "licence", "score"), F.length("directory")).alias("from"))
    paths = files.select("path", above(F.col("path")).alias("own")).distinct()
    joined = (paths.join(stated, "path", "left").join(nearest, "own", "left"))
    mine = F.col("licence").isNotNull()
    inherited = ~mine & F.col("from").isNotNull()
    return joined.select(
        "path", F.coalesce("licence", "from.licence").alias("licence"),
        F.coalesce("score", "from.score").alias("score"),
        F.when(mine, "stated").when(inherited, "inherited").otherwise("none").alias("origin"),
        F.when(inherited, F.col("from.directory")).alias("directory"))


# What `document_files` and `scan` compute, over DuckDB's view of the documents.
def sql():
    rows, idf, unknown = weights(list(TEMPLATES.items()))
    dots = ", ".join(f"('{a}', '{t}', {g!r}::DOUBLE)" for a, _, t, g in rows)
    rare = ", ".join(f"('{t}', {w!r}::DOUBLE)" for t, w in idf.items())
    anchor = ANCHOR.replace("(?i)", "")
    return f"""
WITH dots(licence, term, gain) AS (VALUES {dots}), rare(term, idf) AS (VALUES {rare}),
files AS (SELECT doc_id, coalesce(text, '') AS text,
  CASE WHEN len(regexp_split_to_array(coalesce(text, ''), '[ \\n]+')) <= 40
    AND regexp_matches(coalesce(text, ''), '{anchor}', 'i')
    THEN concat(coalesce(source, '-'), '/', coalesce(lang, '-'), '/LICENSE.', doc_id)
    ELSE concat(coalesce(source, '-'), '/', coalesce(lang, '-'), '/text/', doc_id) END AS path
  FROM documents WHERE doc_id IS NOT NULL),
lines AS (SELECT path, unnest(string_split(text, chr(10))) AS statement FROM files),
statements AS (SELECT DISTINCT path, statement FROM (
  SELECT * FROM lines WHERE regexp_matches(statement, '{anchor}', 'i')
  UNION ALL SELECT path, text FROM files WHERE path LIKE '%/LICENSE.%')),
counted AS (SELECT path, statement, term, count(*) AS n FROM (
  SELECT path, statement, unnest(regexp_extract_all(lower(statement), '{TERM}')) AS term
  FROM statements) GROUP BY ALL),
lengths AS (SELECT path, statement, sqrt(sum((n * coalesce(idf, {unknown!r}::DOUBLE)) ** 2)) AS l
  FROM counted LEFT JOIN rare USING (term) GROUP BY ALL),
scores AS (SELECT path, licence, max(s) AS score FROM (
  SELECT c.path, licence, round(sum(n * gain) / l, 6) AS s
  FROM counted c JOIN dots USING (term)
  JOIN lengths g ON c.path = g.path AND c.statement = g.statement
  GROUP BY c.path, c.statement, licence, l) WHERE s >= {LEAST} GROUP BY ALL),
stated AS (SELECT path, arg_min(licence, (-score, licence)) AS licence, max(score) AS score
  FROM scores GROUP BY path),
held AS (SELECT regexp_replace(path, '/[^/]*$', '') AS directory,
  arg_min(licence, (-score, licence)) AS licence, max(score) AS score
  FROM stated WHERE path LIKE '%/LICENSE.%' GROUP BY ALL),
own AS (SELECT path, regexp_replace(path, '/[^/]*$', '') AS d FROM files),
near AS (SELECT path, arg_max(struct_pack(directory, licence, score), length(directory)) AS f
  FROM own JOIN held ON d = directory OR starts_with(d, directory || '/') GROUP BY path)
SELECT o.path, coalesce(s.licence, f.licence) AS licence, coalesce(s.score, f.score) AS score,
  CASE WHEN s.licence IS NOT NULL THEN 'stated' WHEN f IS NOT NULL THEN 'inherited'
    ELSE 'none' END AS origin,
  CASE WHEN s.licence IS NULL THEN f.directory END AS directory
FROM own o LEFT JOIN stated s USING (path) LEFT JOIN near USING (path)"""


def document_files(docs):
    """Documents as files: a short text that speaks of a licence is the licence file of its
    source and language, any other text a file one directory below."""
    text = F.col("text")
    folder = F.concat_ws("/", F.coalesce("source", F.lit("-")), F.coalesce("lang", F.lit("-")))
    short = speaks(text, F.col("low")) & (F.size(F.split(text, "[ \n]+", -1)) <= 40)
    docs = docs.select("doc_id", "source", "lang", F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("low", F.lower("text"))
    return docs.where("doc_id IS NOT NULL").select(F.when(
        short, F.concat(folder, F.lit("/LICENSE."), F.col("doc_id"))).otherwise(
            F.concat(folder, F.lit("/text/"), F.col("doc_id"))).alias("path"), "text")
