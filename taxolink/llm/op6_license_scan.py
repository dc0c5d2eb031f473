"""Operator 6, licence scans by sparse TF-IDF cosine and inheritance along paths.

Every line of a text that names a licence (``CUE``), and every sentence, also where it runs over lines, is a header; it is compared with
the notices, titles and SPDX lines of known licences by the cosine of TF-IDF vectors, and must have the words that tell the licence from
others.  A file whose whole text is close to a licence's text or is hardly more than a notice, or whose name is that of a
licence file, is a licence file and speaks for its directory.  In SPDX lines only the identifiers count, each as one term.  A document without a header of its own inherits from the nearest ancestor
directory that has a licence file.  Only DataFrame functions are used.

How it runs at scale: document frequencies are counted over all documents, for the terms of notices and headers; words
are counted within a partition before they are shuffled, and then meet that vocabulary.  Vectors exist for headers only.  Inheritance is resolved
once per distinct directory, by equi-joins on its ancestors' paths; the root is above all others.  A directory with a third of all documents is
one row until the last, narrow join, where hot directories, like hot ancestors before, are joined apart (``join_hot``).

Null and empty texts have no header; long ones are read whole; an empty table gives no rows; other columns are not read.  A null path has no directory
and inherits nothing.  Between licences with equal scores the
smaller name wins; between licence files of a directory the higher score, then the smaller name.  Rows that repeat an id and
path are rows of their own with the same result as their twins (texts are told apart by their hash).
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taxolink.llm.common import broadcast_if_small, join_hot, staged, table

#: Fixed values: notices and titles of known licences, as (license, words that a header must have, notice).
NOTICES = [
    ("Apache-2.0", "apache 2", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "apache 2", "Apache License Version 2.0, January 2004"),
    ("Apache-2.0", "apache 2", "Apache License 2.0"),
    ("Apache-2.0", "apache 2", "This file is licensed to you under the Apache License, Version 2.0 (the \"License\");"),
    ("BSD-2-Clause", "bsd 2", "BSD 2-Clause License"),
    ("BSD-2-Clause", "simplified bsd", "Simplified BSD License"),
    ("BSD-3-Clause", "bsd", "Use of this source code is governed by a BSD-style license. BSD 3-Clause License."),
    ("BSD-3-Clause", "bsd style", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "bsd 3", "BSD 3-Clause License"),
    ("BSD-3-Clause", "new bsd", "New BSD License"),
    ("BSD-3-Clause", "neither endorse promote", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("CC0-1.0", "cc0", "Dedicated to the public domain under CC0 1.0 Universal license."),
    ("CC0-1.0", "cc0", "CC0 1.0 Universal"),
    ("EPL-1.0", "eclipse public 1", "Eclipse Public License - v 1.0"),
    ("EPL-1.0", "eclipse public 1", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0"),
    ("EPL-2.0", "eclipse public 2", "Eclipse Public License - v 2.0"),
    ("EPL-2.0", "eclipse public 2", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at"),
    ("ISC", "isc", "ISC License"),
    ("ISC", "isc", "Licensed under the ISC license."),
    ("ISC", "fee notice appear", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MIT", "mit", "Released under the MIT License."),
    ("MIT", "mit", "MIT License"),
    ("MIT", "mit", "The MIT License (MIT)"),
    ("MIT", "mit", "Licensed under the MIT license."),
    ("MIT", "deal restriction sublicense", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MPL-2.0", "mozilla 2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "mozilla 2", "Mozilla Public License Version 2.0"),
    ("Unlicense", "unencumbered", "This is free and unencumbered software released into the public domain."),
    ("Unlicense", "unlicense", "The Unlicense"),
]  # fmt: skip
#: Creative Commons 4.0 and the GNU licences have the same notices for each name and version.
for _id, _name in (("BY", ""), ("BY-SA", "-ShareAlike"), ("BY-NC", "-NonCommercial"), ("BY-ND", "-NoDerivatives"), ("BY-NC-SA", "-NonCommercial-ShareAlike"), ("BY-NC-ND", "-NonCommercial-NoDerivatives")):
    _words = f"attribution 4 {_name.replace('-', ' ').lower()}"
    NOTICES += [(f"CC-{_id}-4.0", f"cc 4 {_id.replace('-', ' ').lower()}", f"Licensed under CC {_id} 4.0.")]
    NOTICES += [(f"CC-{_id}-4.0", _words, t.format(_name)) for t in ("Creative Commons Attribution{} 4.0 International License", "Creative Commons Attribution{} 4.0 International Public License", "This work is licensed under a Creative Commons Attribution{} 4.0 International License.")]
for _id, _name, _short, _version, _date in (("GPL", "", "GPL", "2", "June 1991"), ("GPL", "", "GPL", "3", "29 June 2007"), ("LGPL", "Lesser ", "LGPL", "2.1", "February 1999"), ("LGPL", "Lesser ", "LGPL", "3", "29 June 2007"), ("AGPL", "Affero ", "AGPL", "3", "19 November 2007")):
    _license = f"{_id}-{_version if '.' in _version else _version + '.0'}"
    _words = f"{_name.lower()}general public {_version.replace('.', ' ')}"
    _notices = (
        "This work is licensed under the GNU {}General Public License, version {}.", "GNU {}General Public License Version {}, " + _date, "GNU {}General Public License v{} or later", "under the terms of the GNU {}General Public License version {} as published by the Free Software Foundation",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version.",
    )  # fmt: skip
    NOTICES += [(_license, _words.replace("public 3", "public v3").replace("public 2", "public v2") if " v{}" in t else _words, t.format(_name, _version)) for t in _notices]
    NOTICES += [(_license, f"{_short}v{_version}".lower().replace(".", " "), f"Licensed under the {_short}v{_version}")]
#: SPDX identifiers: those of the licences, and the GNU ones' endings.
SPDX = {i: n for n in sorted({n for n, *_ in NOTICES}) for i in ([n, f"{n}-only", f"{n}-or-later"] if "GPL" in n else [n])}
#: Whole texts by license.
TEXTS = Path(__file__).parent / "licenses"
#: (license, whether it is a whole text, words a unit must have, text)
TEMPLATES = [
    *((name, False, words, text) for name, words, text in NOTICES),
    *((name, False, i.lower().replace("-", "zz").replace(".", "zz"), f"SPDX-License-Identifier: {i}") for i, name in SPDX.items()),
    *((f.stem, True, "", f.read_text(encoding="utf-8")) for f in sorted(TEXTS.glob("*.txt"))),
]
#: What a header contains.
CUE = r"(?i)licen[cs]e|copyright|spdx|public domain|gpl|creative commons|cc0|permission (is hereby granted|to use)|neither the name"
#: File names that make a licence file.
FILE_NAME = r"(?i)(^|/)(licen[cs]e|copying|unlicense)(\.[a-z]+)?$"
#: Cosine that a header, a whole file that is hardly more than a notice, and a whole licence text must reach.
HEADER, WHOLE, TEXT = 0.6, 0.6, 0.8


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def spdx_terms(text: Column) -> Column:
    """SPDX lines from their tag on, with each identifier as one term and without operators; other texts unchanged."""
    line = F.regexp_extract(text, r"(?i)spdx-license-identifier:[^\n]*", 0)
    bare = F.regexp_replace(line, r"\b(OR|AND|WITH)\b", " ")
    return F.when(line == "", text).otherwise(F.regexp_replace(bare, r"(?<=[A-Za-z0-9])[-.](?=[A-Za-z0-9])", "zz"))


def headers(files: DataFrame) -> DataFrame:
    """``key, unit, text`` of the parts of ``files(key, text)`` that are compared: each header, and the whole text as unit -1."""
    cued = files.where(F.col("text").rlike(CUE))
    lines = F.split("text", r"(?i)\n|(?<=[.;:!?])(?<!(?:identifier|icen[cs]e):)\s+", -1)
    # Sentences that run over lines, within paragraphs; marks of comments between the lines are no terms.
    blocks = F.filter(F.split("text", r"\n[^\p{L}\p{N}\n]*(?=\n)", -1), lambda b: b.rlike(r"\n") & b.rlike(CUE))
    sentences = F.filter(F.flatten(F.transform(blocks, lambda b: F.split(b, r"(?i)(?<=[.;:!?])(?<!(?:identifier|icen[cs]e):)\s+", -1))), lambda x: x.rlike(r"\n"))
    each = cued.select("key", F.posexplode(F.concat(lines, sentences)).alias("unit", "part")).where(F.col("part").rlike(CUE)).select("key", "unit", spdx_terms(F.col("part")).alias("text"))
    return each.unionByName(cued.select("key", F.lit(-1).alias("unit"), "text"))


def template_table(spark: SparkSession, templates: list[tuple[str, bool, str, str]]) -> DataFrame:
    rows = [(i, *t) for i, t in enumerate(templates)]
    return spark.createDataFrame(rows, "template int, license string, is_text boolean, words string, text string").withColumn("text", F.when(F.col("is_text"), F.col("text")).otherwise(spdx_terms(F.col("text"))))


def cosines(spark: SparkSession, units: DataFrame, files: DataFrame, templates: list[tuple[str, bool, str, str]]) -> DataFrame:
    """``key, unit, is_text, license, score``: the best notice and the best whole text of each unit, by TF-IDF over the documents ``files``."""
    split = lambda df, *by: df.select(*by, F.explode(terms(F.col("text"))).alias("term")).groupBy(*by, "term").agg(F.count("*").alias("tf"))  # noqa: E731
    unit_tf = staged(spark, split(units, "key", "unit"), "unit_terms")
    of = ("template", "license", "is_text", "words")
    notice_tf = staged(spark, split(template_table(spark, templates), *of), "template_terms")
    vocabulary = staged(spark, unit_tf.select("term").unionByName(notice_tf.select("term")).distinct(), "vocabulary")
    words = files.select(F.explode(F.array_distinct(terms(F.col("text")))).alias("term"))
    # Counted first, so each map task sends a word once; the vocabulary then picks what it needs.
    df = words.groupBy("term").agg(F.count("*").alias("df")).join(vocabulary, "term", "left_semi")
    n = files.count()
    idf = staged(spark, vocabulary.join(df, "term", "left").select("term", (F.log((F.lit(n) + 1) / (F.coalesce("df", F.lit(0)) + 1)) + 1).alias("idf")), "idf")
    weigh = lambda tf: tf.join(idf, "term").withColumn("w", F.col("tf") * F.col("idf"))  # noqa: E731
    u, t = weigh(unit_tf), weigh(notice_tf)
    norm = lambda df, name, *by: df.groupBy(*by).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias(name))  # noqa: E731
    # Templates are a short list that the driver holds; their vectors are broadcast if counted small.  Whole texts are compared with whole files only.
    must = F.array_contains(F.split("words", r"\s+"), F.col("term"))
    tw = t.select("term", "template", "is_text", F.col("w").alias("tw"), must.cast("int").alias("must"))
    fits = (F.col("u.term") == F.col("t.term")) & (~F.col("is_text") | (F.col("unit") < 0))
    dots = u.alias("u").join(broadcast_if_small(tw).alias("t"), fits).groupBy("key", "unit", "template").agg(F.sum(F.col("w") * F.col("tw")).alias("dot"), F.sum("must").alias("has"))
    norms = t.groupBy(*of).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("tn"), F.sum(must.cast("int")).alias("needs"))
    scored = dots.join(broadcast_if_small(norms), "template").where("has = needs").join(norm(u, "un", "key", "unit"), ["key", "unit"]).withColumn("score", F.round(F.col("dot") / F.col("tn") / F.col("un"), 6))
    best = scored.groupBy("key", "unit", "is_text").agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("b"))
    return best.select("key", "unit", "is_text", F.col("b.license").alias("license"), (-F.col("b.s")).alias("score"))


def directory(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def ancestors(folder: Column) -> Column:
    """``[(path, depth)]`` of a directory and everything above it, up to the root, whose path is empty."""
    parts = F.when(folder == "", F.array().cast("array<string>")).otherwise(F.split(folder, "/"))
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, F.lit(1), i), "/").alias("above"), i.alias("depth")))


def scan_licenses(spark: SparkSession, files: DataFrame, templates: list[tuple[str, bool, str, str]] = TEMPLATES, header: float = HEADER, whole: float = WHOLE, whole_text: float = TEXT) -> DataFrame:
    """``doc_id, path, license, basis, score`` of ``files(doc_id, path, text)``; basis is header, file, inherited or none."""
    key = F.struct("doc_id", "path", F.xxhash64("text").alias("h"))
    files = files.select("doc_id", "path", F.coalesce("text", F.lit("")).alias("text"))
    keyed = files.select(key.alias("key"), "text")
    found = cosines(spark, headers(keyed), keyed, templates)
    named = F.coalesce(F.col("key.path").rlike(FILE_NAME), F.lit(False))
    best = found.groupBy("key").agg(
        F.min(F.when((F.col("unit") >= 0) & (F.col("score") >= header), F.struct((-F.col("score")).alias("s"), "license"))).alias("own"),
        F.min(F.when((F.col("unit") < 0) & (F.col("score") >= F.when(F.col("is_text"), whole_text).otherwise(whole)), F.struct((-F.col("score")).alias("s"), "license"))).alias("all"),
    )
    whole_file = F.col("all").isNotNull()
    best = staged(spark, best.select("key", F.when(whole_file, F.lit("file")).when(F.col("own").isNotNull(), F.lit("header")).alias("basis"), F.when(whole_file, F.col("all")).otherwise(F.col("own")).alias("b"), (whole_file | (named & F.col("own").isNotNull())).alias("speaks")).where("b is not null"), "licensed")
    speakers = staged(spark, best.where("speaks and key.path is not null").groupBy(directory(F.col("key.path")).alias("above")).agg(F.min("b").alias("b")), "speakers")
    rows = staged(spark, files.select(key.alias("key"), F.when(F.col("path").isNotNull(), directory(F.col("path"))).alias("folder")), "rows")
    folders = staged(spark, rows.where("folder is not null").groupBy("folder").agg(F.count("*").alias("n")), "folders")
    above = staged(spark, folders.select("folder", F.inline(ancestors(F.col("folder")))), "above")
    inherited = staged(spark, join_hot(spark, above, speakers, ["above"]).groupBy("folder").agg(F.max_by("b", "depth").alias("inherited")), "inherited")
    got = join_hot(spark, rows.join(best.drop("speaks"), "key", "left"), inherited, ["folder"], "left", folders)
    chosen = F.coalesce("b", "inherited")
    return got.select(
        "key.doc_id",
        "key.path",
        chosen["license"].alias("license"),
        F.when(F.col("basis").isNotNull(), F.col("basis")).when(F.col("inherited").isNotNull(), F.lit("inherited")).otherwise(F.lit("none")).alias("basis"),
        F.round(-chosen["s"], 4).alias("score"),
    )


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as files ``source/lang/doc_id.txt``."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.coalesce("source", F.lit("_")), F.coalesce("lang", F.lit("_")), F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("_")), F.lit(".txt")))
    return scan_licenses(spark, docs.select(F.col("doc_id").cast("long").alias("doc_id"), path.alias("path"), "text"))


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _sql_form(text: str) -> str:
    """``spdx_terms`` of a template."""
    line = re.search(r"(?i)spdx-license-identifier:[^\n]*", text)
    return re.sub(r"(?<=[A-Za-z0-9])[-.](?=[A-Za-z0-9])", "zz", re.sub(r"\b(OR|AND|WITH)\b", " ", line[0])) if line else text


#: The whole query.  What the patterns above say by looking around is said by marks: chr(1) keeps what follows a tag's colon, chr(2) ends a block.
ORACLE_SQL = rf"""
WITH files AS MATERIALIZED (
  SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text, coalesce(source, '_') || '/' || coalesce(lang, '_') || '/' || coalesce(CAST(doc_id AS VARCHAR), '_') || '.txt' AS path FROM documents),
cued AS (SELECT k, text, regexp_replace(text, '(?i)((?:identifier|icen[cs]e):)', '' || chr(1), 'g') AS kept FROM files WHERE regexp_matches(text, {_quoted(CUE)})),
lines AS (SELECT k, unnest(string_split(regexp_replace(kept, '([.;:!?])[ 	
]+', '' || chr(10), 'g'), chr(10))) AS part FROM cued),
blocks AS (SELECT k, unnest(string_split(regexp_replace(kept, '
[^\p{{L}}\p{{N}}
]*
', chr(2) || chr(10), 'g'), chr(2))) AS block FROM cued),
sentences AS (SELECT k, unnest(string_split(regexp_replace(block, '([.;:!?])[ 	
]+', '' || chr(2), 'g'), chr(2))) AS part FROM blocks WHERE contains(block, chr(10)) AND regexp_matches(block, {_quoted(CUE)})),
parts AS (SELECT k, part FROM lines UNION ALL SELECT k, part FROM sentences WHERE contains(part, chr(10))),
spdx AS (SELECT k, part, regexp_extract(part, '(?i)spdx-license-identifier:[^
]*') AS line FROM parts WHERE regexp_matches(part, {_quoted(CUE)})),
units AS MATERIALIZED (
  SELECT k, row_number() OVER () AS unit, CASE WHEN line = '' THEN part ELSE regexp_replace(regexp_replace(regexp_replace(line, '(OR|AND|WITH)', ' ', 'g'),
    '([A-Za-z0-9])[-.]([A-Za-z0-9])', 'zz', 'g'), '([A-Za-z0-9])[-.]([A-Za-z0-9])', 'zz', 'g') END AS text FROM spdx
  UNION ALL SELECT k, -1, text FROM cued),
given AS (SELECT * FROM (VALUES {{templates}}) AS v(template, license, is_text, words, text)),
u_tf AS (SELECT k, unit, term, count(*) AS tf FROM (SELECT k, unit, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS term FROM units) GROUP BY ALL),
t_tf AS (SELECT template, license, is_text, words, term, count(*) AS tf FROM (SELECT template, license, is_text, words, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS term FROM given) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+'))) AS term FROM files) GROUP BY term),
idf AS (SELECT term, ln(((SELECT count(*) FROM files) + 1) / (coalesce(df, 0) + 1)) + 1 AS idf FROM (SELECT term FROM u_tf UNION SELECT term FROM t_tf) LEFT JOIN df USING (term)),
u AS (SELECT u_tf.*, tf * idf AS w FROM u_tf JOIN idf USING (term)),
t AS (SELECT t_tf.*, tf * idf AS w, list_contains(string_split(words, ' '), term) AS must FROM t_tf JOIN idf USING (term)),
un AS (SELECT k, unit, sqrt(sum(w * w)) AS un FROM u GROUP BY ALL),
tn AS (SELECT template, license, is_text, sqrt(sum(w * w)) AS tn, count(*) FILTER (must) AS needs FROM t GROUP BY ALL),
dots AS (SELECT k, unit, template, sum(u.w * t.w) AS dot, count(*) FILTER (must) AS has FROM u JOIN t ON u.term = t.term AND (NOT is_text OR unit < 0) GROUP BY ALL),
scored AS (SELECT k, unit, is_text, license, round(dot / tn / un, 6) AS score FROM dots JOIN tn USING (template) JOIN un USING (k, unit) WHERE has = needs),
own AS (SELECT k, score, license, row_number() OVER (PARTITION BY k ORDER BY score DESC, license) AS n FROM scored WHERE unit >= 0 AND score >= {HEADER}),
whole AS (SELECT k, score, license, row_number() OVER (PARTITION BY k ORDER BY score DESC, license) AS n FROM scored WHERE unit < 0 AND score >= CASE WHEN is_text THEN {TEXT} ELSE {WHOLE} END),
best AS (
  SELECT files.k, doc_id, path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder, coalesce(whole.license, own.license) AS license, CASE WHEN whole.k IS NOT NULL THEN whole.score ELSE own.score END AS score,
    CASE WHEN whole.k IS NOT NULL THEN 'file' WHEN own.k IS NOT NULL THEN 'header' END AS basis
  FROM files LEFT JOIN own ON own.k = files.k AND own.n = 1 LEFT JOIN whole ON whole.k = files.k AND whole.n = 1),
speakers AS (
  SELECT folder AS above, license, score, row_number() OVER (PARTITION BY folder ORDER BY score DESC, license) AS n FROM best WHERE basis = 'file' OR (basis = 'header' AND regexp_matches(path, {_quoted(FILE_NAME)}))),
above AS (SELECT folder, unnest(range(len(string_split(folder, '/')) + 1)) AS depth FROM (SELECT DISTINCT folder FROM best)),
inherited AS (
  SELECT a.folder, s.license, s.score, row_number() OVER (PARTITION BY a.folder ORDER BY depth DESC) AS n
  FROM above a JOIN speakers s ON s.n = 1 AND s.above = array_to_string(string_split(a.folder, '/')[1:depth], '/'))
SELECT doc_id, path, coalesce(best.license, i.license) AS license, coalesce(basis, CASE WHEN i.folder IS NOT NULL THEN 'inherited' ELSE 'none' END) AS basis, round(CASE WHEN basis IS NOT NULL THEN best.score ELSE i.score END, 4) AS score
FROM best LEFT JOIN inherited i ON i.folder = best.folder AND i.n = 1
""".replace("{templates}", ", ".join(f"({i}, {_quoted(name)}, {is_text}, {_quoted(words)}, {_quoted(_text)})" for i, (name, is_text, words, _text) in enumerate((n, t, w, x if t else _sql_form(x)) for n, t, w, x in TEMPLATES)))
