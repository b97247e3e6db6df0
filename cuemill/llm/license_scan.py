"""Licence scans: sparse TF-IDF cosine of notices (lines and blocks) and licence files to templates, then inheritance along paths.

DataFrame operations only."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: (licence, text). A licence may have several.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT license. Permission is hereby granted, free of charge, to any person obtaining a copy"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This program is free software under the terms of the GNU General Public License, version 2."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD 3-Clause license."),
    ("BSD-2-Clause", "Use of this source code is governed by a BSD 2-Clause license."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "Copyright. All rights reserved. No part may be reproduced without permission."),
)
#: Notices of several lines and whole texts, (licence, text); those in the folder are added to them. Titles stand for the
#: licences whose text is not there.
LONG = (
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    *((f"{short}-{v}.0", f"This {what} is free software: you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License as published by the Free Software Foundation, either version {v} of the License, or (at your option) any later version.")
      for short, what, kind, v in (("GPL", "program", "", 2), ("GPL", "program", "", 3), ("LGPL", "library", "Lesser ", 3), ("AGPL", "program", "Affero ", 3))),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International Public License"),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International Public License"),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International Public License"),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
)
FOLDER = Path(__file__).with_name("licences")
#: Lines that may be notices.
NOTICE = r"(?i)licen[cs]e|copyright|spdx|public domain|all rights reserved"
#: Blocks that may be: besides, opening words of full texts.
NOTICE_BLOCK = NOTICE + r"|permission\s+is\s+hereby\s+granted|redistribution\s+and\s+use|free\s+software|unencumbered"
#: What opens a comment's line and closes it.
COMMENT, CLOSED = r"^\s*(?:#+|//+|/\*+|\*+/?|--+|;+|%+|<!--)", r"(?:\*+/|-->)\s*$"
TERM = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
#: Least cosine of a match; least share of a file's words that makes its notice a licence file's.
LEAST, FILE_SHARE = 0.6, 0.2
LICENCE_FILE = r"(?i)^(licen[cs]e|copying|unlicense)([.-].*)?$"


def _template_rows(spark: SparkSession, templates: tuple) -> DataFrame:
    rows = [F.struct(F.lit(n).alias("licence"), F.lit(i).alias("template"), F.lit(t).alias("unit")) for i, (n, t) in enumerate(templates)]
    return spark.range(1).select(F.inline(F.array(*rows)))


def _terms(unit: Column) -> Column:
    return F.regexp_extract_all(F.lower(unit), F.lit(TERM), F.lit(0))


def _basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def long_templates() -> tuple:
    """LONG and the full texts of the folder, a BSD-2-Clause without the third clause of BSD-3-Clause among them."""
    full = tuple((f.stem, f.read_text()) for f in sorted(FOLDER.glob("*.txt")))
    two = tuple(("BSD-2-Clause", t[: t.index("3. ")] + t[t.index("THIS SOFTWARE IS PROVIDED") :]) for n, t in full if n == "BSD-3-Clause")
    return (*LONG, *full, *two)


def _blocks(text: Column) -> Column:
    """Blocks of several lines: runs of lines that all are comments or all are not, cut at blank ones, without marks."""
    lines = F.split(F.regexp_replace(text, "\x01", " "), "\n", -1)
    bare = lambda x: F.regexp_replace(F.regexp_replace(x, COMMENT, ""), CLOSED, "")
    blank = lambda x: ~bare(x).rlike(r"\S")
    cut = lambda x, y: blank(x) | blank(y) | (x.rlike(COMMENT) != y.rlike(COMMENT))
    marked = F.zip_with(lines, F.concat(F.array(F.lit("")), lines), lambda x, y: F.when(x.isNull(), "").when(cut(x, y), F.concat(F.lit("\x01"), bare(x))).otherwise(bare(x)))
    return F.filter(F.transform(F.split(F.array_join(marked, "\n"), "\x01", -1), lambda b: F.trim(b, F.lit(" \t\r\n"))), lambda b: b.contains("\n"))


def notices(files: DataFrame) -> DataFrame:
    """(path, id, unit, share, long) of files(path, text): every distinct line that may be a notice; long, every block of
    several lines that may be one, and of licence files by name the whole text and all blocks. share: the unit's words
    over the text's. id: SHA-256 of the unit, which stands for it where rows are dealt out by term."""
    text = F.coalesce("text", F.lit(""))
    named = F.coalesce(_basename(F.col("path")).rlike(LICENCE_FILE), F.lit(False))
    lines = F.array_distinct(F.filter(F.split(text, "\n", -1), lambda x: x.rlike(NOTICE)))
    blocks = F.filter(_blocks(text), lambda x: named | x.rlike(NOTICE_BLOCK))
    unit = lambda a, long: F.transform(a, lambda x: F.struct(x.alias("unit"), F.lit(long).alias("long")))
    long = F.array_distinct(F.concat(F.when(named, F.array(text)).otherwise(F.array().cast("array<string>")), blocks))
    units = F.when(named | text.rlike(NOTICE_BLOCK), F.concat(unit(lines, False), unit(long, True)))
    found = files.select("path", text.alias("t"), F.inline(units))
    count = lambda c: F.regexp_count(c, F.lit(common.WORD))
    return found.select("path", F.sha2("unit", 256).alias("id"), "unit", (count(F.col("unit")) / F.greatest(count(F.col("t")), F.lit(1))).alias("share"), "long")


def score_notices(units: DataFrame, templates: tuple = TEMPLATES, least: float = LEAST, longer: tuple = ()) -> DataFrame:
    """(id, long, licence, score) of the distinct units(id, unit, long): the template of the greatest cosine, at least
    `least`. Long units are held against longer templates besides.

    Weights are tf * idf, idf being ln((1 + n) / (1 + df)) + 1 over all distinct units that are not long and templates;
    terms in none have df 0. Scores are rounded to six places, ties go to the smaller name. Units without terms match
    nothing."""
    spark = units.sparkSession
    distinct = units.select("id", "long", "unit").dropDuplicates(["id", "long"])
    wanted = _template_rows(spark, (*templates, *longer)).withColumn("for_long", F.col("template") >= len(templates))
    unit_terms = distinct.select("id", "long", F.explode(_terms(F.col("unit"))).alias("term")).groupBy("id", "long", "term").agg(F.count("*").alias("tf"))
    template_terms = wanted.select("licence", "template", "for_long", F.explode(_terms(F.col("unit"))).alias("term")).groupBy("licence", "template", "for_long", "term").agg(F.count("*").alias("tf"))
    known = unit_terms.where("NOT long").select("term").unionByName(template_terms.where("NOT for_long").select("term"))
    df = known.groupBy("term").agg(F.count("*").alias("df"))
    size = distinct.where("NOT long").agg(F.count("*").alias("c")).select((F.col("c") + F.lit(len(templates))).alias("n"))
    idf = F.log((1 + F.col("n")) / (1 + F.coalesce("df", F.lit(0)))) + 1
    weighted = lambda t: t.join(df, "term", "left").join(F.broadcast(size)).withColumn("w", F.col("tf") * idf).drop("tf", "df", "n")
    unit_weights = weighted(unit_terms)
    template_weights = weighted(template_terms).withColumnRenamed("w", "v")
    unit_norms = unit_weights.groupBy("id", "long").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("u"))
    template_norms = template_weights.groupBy("template").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("t"))
    # As many rows as the templates have terms, whatever the corpus.
    fixed = F.broadcast(template_weights.join(template_norms, "template"))
    dots = unit_weights.join(fixed, "term").where("long OR NOT for_long").groupBy("id", "long", "licence", "template", "t").agg(F.sum(F.col("w") * F.col("v")).alias("dot"))
    scored = dots.join(unit_norms, ["id", "long"]).select("id", "long", "licence", F.round(F.col("dot") / (F.col("u") * F.col("t")), 6).alias("score"))
    best = scored.groupBy("id", "long").agg(F.min(F.struct((-F.col("score")).alias("s"), "licence")).alias("b"))
    return best.select("id", "long", "b.licence", (-F.col("b.s")).alias("score")).where(F.col("score") >= least)


def ancestors(path: Column) -> Column:
    """Directories above a path, the nearest last: of /a/b/c, '', /a and /a/b."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda k: F.array_join(F.slice(parts, 1, k), "/"))


def scan_licences(files: DataFrame, templates: tuple = TEMPLATES, least: float = LEAST, file_share: float = FILE_SHARE) -> DataFrame:
    """(path, licence, score, origin, from_dir) of the distinct paths of files(path, text).

    A file has the licence of its best notice (origin `own`; ties: the smaller name). One without takes that of the
    nearest directory above it that has a licence file (`inherited`): a file named as such, or whose notice makes up
    file_share of its words; of several the best score, then the smaller licence. Others have nulls. Null paths and
    texts match nothing; files that repeat a path are one file with all their notices."""
    found = common.cut(notices(files.where("path is not null")))
    matched = found.drop("unit").join(score_notices(found, templates, least, long_templates()), ["id", "long"])
    own = matched.groupBy("path").agg(
        F.min(F.struct((-F.col("score")).alias("s"), "licence")).alias("b"), F.max("share").alias("share")
    ).select("path", "b.licence", (-F.col("b.s")).alias("score"), "share")
    own = common.cut(own)
    whole = own.where(_basename(F.col("path")).rlike(LICENCE_FILE) | (F.col("share") >= file_share))
    given = whole.groupBy(F.element_at(ancestors(F.col("path")), -1).alias("dir")).agg(
        F.min(F.struct((-F.col("score")).alias("s"), "licence")).alias("g")
    ).select("dir", F.col("g.licence").alias("dir_licence"), (-F.col("g.s")).alias("dir_score"))
    paths = files.where("path is not null").select("path").distinct().join(own.drop("share"), "path", "left")
    # Directories, not files, are looked up level by level.
    dirs = paths.where("licence is null").select(F.element_at(ancestors(F.col("path")), -1).alias("home")).distinct()
    levels = dirs.select("home", F.posexplode(ancestors(F.concat("home", F.lit("/x")))).alias("level", "dir"))
    nearest = levels.join(given, "dir").groupBy("home").agg(
        F.max_by(F.struct("dir", "dir_licence", "dir_score"), "level").alias("d")
    )
    out = paths.withColumn("home", F.element_at(ancestors(F.col("path")), -1)).join(nearest, "home", "left")
    inherits = F.col("licence").isNull() & F.col("d.dir_licence").isNotNull()
    return out.select(
        "path",
        F.coalesce("licence", F.col("d.dir_licence")).alias("licence"),
        F.coalesce("score", F.col("d.dir_score")).alias("score"),
        F.when(F.col("licence").isNotNull(), F.lit("own")).when(inherits, F.lit("inherited")).alias("origin"),
        F.when(inherits, F.col("d.dir")).alias("from_dir"),
    )


def document_path() -> Column:
    """documents have no path: source, language, hundred of the id, id."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("none"))
    hundred = F.coalesce(F.expr("doc_id div 100").cast("string"), F.lit("none"))
    return F.concat(F.lit("/"), part("source"), F.lit("/"), part("lang"), F.lit("/"), hundred, F.lit("/"), part("doc_id"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as files of made-up paths, with their licences, own or inherited; see document_path() and scan_licences()."""
    docs = common.table(spark, sf_dir, "documents")
    files = docs.select("doc_id", "text", document_path().alias("path"))
    scanned = scan_licences(files.select("path", "text"))
    return files.select("doc_id", "path").join(scanned, "path").select(
        "doc_id", "path", "licence", "score", "origin", "from_dir"
    )


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


ORACLE = f"""
WITH files AS (
  SELECT doc_id, coalesce(text, '') AS t,
    '/' || coalesce(source, 'none') || '/' || coalesce(lang, 'none') || '/' || coalesce(CAST(doc_id // 100 AS VARCHAR), 'none')
      AS home,
    coalesce(CAST(doc_id AS VARCHAR), 'none') AS base
  FROM documents
), found AS (
  SELECT DISTINCT home, base, t, unit FROM (
    SELECT home, base, t, unnest(string_split(t, chr(10))) AS unit FROM files
  ) WHERE regexp_matches(unit, '{NOTICE}')
), noted AS (
  SELECT home, base, unit,
    len(regexp_extract_all(unit, '[^ \\t\\n\\x0b\\f\\r]+')) / greatest(len(regexp_extract_all(t, '[^ \\t\\n\\x0b\\f\\r]+')), 1) AS share
  FROM found
), templates(licence, template, unit) AS (
  VALUES {", ".join(f"({_quoted(n)}, {i}, {_quoted(t)})" for i, (n, t) in enumerate(TEMPLATES))}
), units AS (SELECT DISTINCT unit FROM noted),
ut AS (SELECT unit, term, count(*) AS tf FROM (
  SELECT unit, unnest(regexp_extract_all(lower(unit), '{TERM}')) AS term FROM units) GROUP BY ALL),
tt AS (SELECT licence, template, term, count(*) AS tf FROM (
  SELECT licence, template, unnest(regexp_extract_all(lower(unit), '{TERM}')) AS term FROM templates) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM (SELECT term FROM ut UNION ALL SELECT term FROM tt) GROUP BY term),
idf AS (SELECT term, ln((1 + (SELECT count(*) FROM units) + {len(TEMPLATES)}) / (1 + df)) + 1 AS idf FROM df),
uw AS (SELECT unit, term, tf * idf AS w FROM ut JOIN idf USING (term)),
tw AS (SELECT licence, template, term, tf * idf AS v FROM tt JOIN idf USING (term)),
un AS (SELECT unit, sqrt(sum(w * w)) AS u FROM uw GROUP BY unit),
tn AS (SELECT template, sqrt(sum(v * v)) AS n FROM tw GROUP BY template),
scored AS (
  SELECT unit, licence, round(sum(w * v) / (any_value(u) * any_value(n)), 6) AS score
  FROM uw JOIN tw USING (term) JOIN un USING (unit) JOIN tn USING (template) GROUP BY unit, licence, template
), best AS (
  SELECT unit, licence, score FROM (
    SELECT *, row_number() OVER (PARTITION BY unit ORDER BY score DESC, licence) AS r FROM scored) WHERE r = 1 AND score >= {LEAST}
), own AS (
  SELECT home, base, licence, score, share FROM (
    SELECT home, base, licence, score, max(share) OVER (PARTITION BY home, base) AS share,
      row_number() OVER (PARTITION BY home, base ORDER BY score DESC, licence) AS r
    FROM noted JOIN best USING (unit)) WHERE r = 1
), given AS (
  SELECT home, licence, score FROM (
    SELECT home, licence, score, row_number() OVER (PARTITION BY home ORDER BY score DESC, licence) AS r
    FROM own WHERE share >= {FILE_SHARE}) WHERE r = 1
)
SELECT f.doc_id, f.home || '/' || f.base AS path, coalesce(o.licence, g.licence) AS licence, coalesce(o.score, g.score) AS score,
  CASE WHEN o.licence IS NOT NULL THEN 'own' WHEN g.licence IS NOT NULL THEN 'inherited' END AS origin,
  CASE WHEN o.licence IS NULL AND g.licence IS NOT NULL THEN f.home END AS from_dir
FROM files f LEFT JOIN own o ON f.home = o.home AND f.base = o.base LEFT JOIN given g ON f.home = g.home
"""
