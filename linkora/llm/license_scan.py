"""Operator 4: licence scans. Sparse TF-IDF cosine of header lines and licence files to templates, then inheritance by path joins.

A header is a line with one of the TRIGGER words. Its terms are its lower-cased runs of letters and digits; a term's weight is its
count times ln((N + 1) / (df + 1)) + 1 over all distinct headers and templates. A header has the licence of the template with the
largest cosine if that is `least` or more; a file has the licence of its best header (ties: the first name). The whole text of a licence
file is compared with the full texts in `licences` too, weighted over these; the best of `WHOLE` or more goes before its headers. A file named LICENSE,
LICENCE, COPYING or NOTICE gives its licence to its directory; a file without an own licence inherits that of the nearest directory
at or above its own. The comment block that a file begins with is compared with the full texts in the same way, without its comment marks.

Edge cases: null and empty texts have no header but may inherit; a null path inherits nothing. Of several licence files in a directory
the first licence by name counts. Repeated rows are each returned. Extra columns are carried along; those with the names of the four
results are replaced. An empty table gives an empty one. Texts of any length are read whole, once.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, table, write_table

# Notices by SPDX identifier.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software, MIT license."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, version 3 or later."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms are permitted under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0, no copyright license needed."),
    ("LicenseRef-Proprietary", "Copyright. All rights reserved."),
    ("Unlicense", "This is free and unencumbered software released into the public domain, The Unlicense."),
]
TEMPLATES += [(name, f"SPDX-License-Identifier: {name}") for name in dict.fromkeys(n for n, _ in TEMPLATES if not n.startswith("LicenseRef"))]
TRIGGER = "licen[cs]e|copyright|spdx|public domain|all rights reserved"
LICENCE_FILE = "(^|/)(LICENSE|LICENCE|COPYING|NOTICE)([.-][^/]*)?$"
TERMS = "filter(split(regexp_replace(lower(line), '[^a-z0-9]+', ' '), ' '), x -> x <> '')"


WHOLE = 0.85
_WORD = re.compile("[a-z0-9]+")


class FullTexts:
    """TF-IDF vectors of the full licence texts; a word that none of them has weighs most."""

    def __init__(self) -> None:
        # Read on the driver and sent with the function: executors need no files.
        texts = {p.stem: Counter(_WORD.findall(p.read_text().lower())) for p in sorted((Path(__file__).parent / "licences").glob("*.txt"))}
        df = Counter(w for c in texts.values() for w in c)
        self.rare = math.log(len(texts) + 1) + 1
        self.idf = {w: math.log((len(texts) + 1) / (n + 1)) + 1 for w, n in df.items()}
        self.vectors = {name: self.unit(c) for name, c in texts.items()}

    def unit(self, counts: Counter) -> dict[str, float]:
        v = {w: n * self.idf.get(w, self.rare) for w, n in counts.items()}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / size for w, x in v.items()}

    def best(self, text: str | None) -> tuple[float, str | None]:
        v = self.unit(Counter(_WORD.findall((text or "").lower())))
        return max(((sum(x * t.get(w, 0.0) for w, x in v.items()), name) for name, t in self.vectors.items()), default=(0.0, None))


# What a comment line begins with.
MARK = r"[ \t]*(?://+|#+|/\*+|\*+/?|--|;+|%+)"
_MARK = re.compile(MARK)


def leading_comment(text: str) -> str:
    """The comment block that a text begins with, without its marks."""
    out = []
    for line in text.split("\n"):
        if not (m := _MARK.match(line)):
            break
        out.append(line[m.end() :])
    return "\n".join(out)


def whole_licences(files: DataFrame, fid: str) -> DataFrame:
    """(fid, path, body) -> (fid, whole) of the licence files, and of the leading comments of other files, that are a known licence as a whole."""
    full = FullTexts()

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [full.best(t if own else leading_comment(t)) for t, own in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.record_batch({fid: batch.column(0), "whole": pa.array([name if score >= WHOLE else None for score, name in found], pa.string())})

    wanted = files.where("body is not null").select(fid, "body", F.col("path").rlike(LICENCE_FILE).alias("own"))
    return wanted.mapInArrow(make, f"{fid} long, whole string").where("whole is not null").distinct()


def scan(files: DataFrame, least: float = 0.6) -> DataFrame:
    """files (path, text, ...) -> the same columns without text, and n_headers, own_license, license, inherited_from."""
    spark = files.sparkSession
    files = files.drop("n_headers", "own_license", "license", "inherited_from")
    fid, at_dir = free_name(files, "fid"), free_name(files, "dir")
    carried = [F.col(f"`{c}`") for c in files.columns if c != "text"]
    # One pass over the texts: header lines, and the bodies that are compared as a whole.
    lines_of = F.filter(F.split("text", "\n", -1), lambda x: F.lower(x).rlike(TRIGGER))
    body = F.when(F.col("path").rlike(LICENCE_FILE) | F.col("text").rlike("^" + MARK), F.col("text"))
    found = write_table(files.select(*carried, F.xxhash64("path", "text").alias(fid), F.struct(lines_of.alias("lines"), body.alias("body")).alias(seen := free_name(files, "seen"))))
    files = found.select(*carried, fid)
    headers = found.select(fid, F.explode(F.col(f"{seen}.lines")).alias("line"))
    lines = headers.select("line").distinct()
    # A row for each fixed template: bounded, so it may be broadcast.
    templates = spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(TEMPLATES)], "tid int, name string, line string")
    corpus = lines.select("line", F.lit(None).cast("int").alias("tid")).unionByName(templates.select("line", "tid"))
    counts = corpus.select("line", "tid", F.explode(F.expr(TERMS)).alias("term")).groupBy("line", "tid", "term").agg(F.count("*").alias("tf"))
    df = counts.groupBy("term").agg(F.count("*").alias("df"))
    total = corpus.agg(F.count("*").alias("n"))
    weights = counts.join(df, "term").join(F.broadcast(total)).withColumn("w", F.col("tf") * (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1)).select("line", "tid", "term", "w")
    mine, theirs = weights.where("tid is null").drop("tid"), weights.where("tid is not null").select("tid", "term", F.col("w").alias("v"))
    norms = mine.groupBy("line").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("a"))
    norms_t = theirs.groupBy("tid").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("b"))
    dots = mine.join(F.broadcast(theirs), "term").groupBy("line", "tid").agg(F.sum(F.col("w") * F.col("v")).alias("dot"))
    scored = dots.join(norms, "line").join(F.broadcast(norms_t), "tid").join(F.broadcast(templates.select("tid", "name")), "tid")
    best = scored.withColumn("score", F.col("dot") / (F.col("a") * F.col("b"))).where(F.col("score") >= least).groupBy("line").agg(F.min(F.struct((-F.col("score")).alias("s"), "name")).alias("best"))
    own = headers.distinct().join(best, "line", "left").groupBy(fid).agg(F.count("*").alias("n_headers"), F.min("best").alias("best")).select(fid, "n_headers", F.col("best.name").alias("own_license"))
    whole = whole_licences(found.select(fid, "path", F.col(f"{seen}.body").alias("body")), fid).withColumnRenamed("whole", taken := free_name(files, "whole"))
    named = files.join(own, fid, "left").join(whole, fid, "left").withColumn("own_license", F.coalesce(taken, "own_license")).drop(taken).withColumn("n_headers", F.coalesce("n_headers", F.lit(0).cast("long"))).drop(fid)
    named = named.withColumn(at_dir, F.regexp_extract("path", "^(.*)/", 1))
    given = named.where(F.col("own_license").isNotNull() & F.col("path").rlike(LICENCE_FILE)).groupBy(F.col(at_dir).alias("at")).agg(F.min("own_license").alias("given"))
    # Directories, not files, look for an ancestor: a directory with very many files is one row.
    parts = F.split(at_dir, "/")
    ups = named.where(F.col("own_license").isNull() & F.col(at_dir).isNotNull()).select(at_dir).distinct().select(at_dir, F.explode(F.sequence(F.lit(0), F.size(parts))).alias("depth")).withColumn("at", F.when(F.col("depth") == 0, "").otherwise(F.array_join(F.slice(parts, 1, F.greatest("depth", F.lit(1))), "/")))
    nearest = ups.join(given, "at").groupBy(at_dir).agg(F.max(F.struct("depth", "at", "given")).alias("up")).select(at_dir, F.col("up.at").alias("up_at"), F.col("up.given").alias("up_given"))
    out = named.join(nearest, at_dir, "left")
    free = F.col("own_license").isNull()
    return out.withColumn("license", F.when(free, F.col("up_given")).otherwise(F.col("own_license"))).withColumn("inherited_from", F.when(free, F.col("up_at"))).drop(at_dir, "up_at", "up_given")


def documents_as_files(docs: DataFrame) -> DataFrame:
    """A path for each document: source, then directories of 1024 and of 32 documents; the first of each directory is its LICENSE."""
    d = F.col("doc_id").cast("long")
    top, sub = F.concat(F.col("source"), F.lit("/d"), F.floor(d / 1024).cast("string")), F.concat(F.lit("/s"), (F.floor(d / 32) % 32).cast("string"))
    path = F.when(d % 1024 == 0, F.concat(top, F.lit("/LICENSE"))).when(d % 32 == 0, F.concat(top, sub, F.lit("/LICENSE"))).otherwise(F.concat(top, sub, F.lit("/f"), d.cast("string"), F.lit(".txt")))
    return docs.select(d.alias("doc_id"), path.alias("path"), "text")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents_as_files(table(spark, sf_dir, "documents")))


OP4_SQL = (
    """
WITH files AS (SELECT doc_id, coalesce(text, '') AS text, CASE WHEN doc_id % 1024 = 0 THEN source || '/d' || (doc_id // 1024) || '/LICENSE'
  WHEN doc_id % 32 = 0 THEN source || '/d' || (doc_id // 1024) || '/s' || (doc_id // 32 % 32) || '/LICENSE'
  ELSE source || '/d' || (doc_id // 1024) || '/s' || (doc_id // 32 % 32) || '/f' || doc_id || '.txt' END AS path FROM documents),
raw AS (SELECT DISTINCT doc_id, path, unnest(string_split(text, chr(10))) AS line FROM files),
headers AS (SELECT * FROM raw WHERE regexp_matches(lower(line), '"""
    + TRIGGER
    + """')),
templates(tid, name, line) AS (VALUES """
    + ", ".join(f"({i}, '{n}', '{t}')" for i, (n, t) in enumerate(TEMPLATES))
    + r"""),
corpus AS (SELECT DISTINCT line, CAST(NULL AS INTEGER) AS tid FROM headers UNION ALL SELECT line, tid FROM templates),
terms AS (SELECT line, tid, unnest(string_split(regexp_replace(lower(line), '[^a-z0-9]+', ' ', 'g'), ' ')) AS term FROM corpus),
counts AS (SELECT line, tid, term, count(*) AS tf FROM terms WHERE term <> '' GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM counts GROUP BY term),
weights AS (SELECT line, tid, term, tf * (ln(((SELECT count(*) FROM corpus) + 1) / (df + 1)) + 1) AS w FROM counts JOIN df USING (term)),
na AS (SELECT line, sqrt(sum(w * w)) AS a FROM weights WHERE tid IS NULL GROUP BY line),
nb AS (SELECT tid, sqrt(sum(w * w)) AS b FROM weights WHERE tid IS NOT NULL GROUP BY tid),
dots AS (SELECT m.line, t.tid, sum(m.w * t.w) AS dot FROM weights m JOIN weights t ON m.term = t.term AND m.tid IS NULL AND t.tid IS NOT NULL GROUP BY ALL),
scored AS (SELECT dots.line, name, dot / (a * b) AS score FROM dots JOIN na USING (line) JOIN nb USING (tid) JOIN (SELECT tid, name FROM templates) USING (tid)),
best AS (SELECT line, name, score FROM scored WHERE score >= 0.6 QUALIFY row_number() OVER (PARTITION BY line ORDER BY score DESC, name) = 1),
own AS (SELECT doc_id, count(*) AS n_headers, first(name ORDER BY score DESC NULLS LAST, name) AS own_license FROM headers LEFT JOIN best USING (line) GROUP BY doc_id),
named AS (SELECT files.doc_id, path, coalesce(n_headers, 0) AS n_headers, own_license, regexp_extract(path, '^(.*)/', 1) AS dir FROM files LEFT JOIN own USING (doc_id)),
given AS (SELECT dir AS up, min(own_license) AS given FROM named WHERE own_license IS NOT NULL AND path LIKE '%/LICENSE' GROUP BY dir),
inherit AS (SELECT n.doc_id, up, given FROM named n JOIN given g ON n.own_license IS NULL AND (n.dir = g.up OR starts_with(n.dir, g.up || '/'))
  QUALIFY row_number() OVER (PARTITION BY n.doc_id ORDER BY length(up) DESC) = 1)
SELECT doc_id, path, n_headers, own_license, coalesce(own_license, given) AS license, up AS inherited_from FROM named LEFT JOIN inherit USING (doc_id)
"""
)
