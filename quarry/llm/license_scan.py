"""Licence detection and inheritance, in DataFrame operations only.

Runs of consecutive lines, blocks of lines (headers) and whole licence files are compared with templates as sparse
TF-IDF vectors. A file takes the template nearest to one of these; a file without one takes the licence of the nearest
directory above it that has a licence file.

No run is left out for its words alone. A text has a cosine of c or more to a unit vector only if the squares of the
weights of the terms that they share add up to c * c (Cauchy and Schwarz); texts that have less are passed over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import spool

#: Names of licence files (a fixed value).
LICENCE_FILE = r"(?i)^(licen[cs]e|copying|unlicense)([.\-_].*)?$"
#: Notices by licence.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
]
#: SPDX identifiers by licence; a tag is read as it is written, since single words like MIT occur in other texts.
SPDX = {
    "Apache-2.0": ["Apache-2.0"], "MIT": ["MIT"], "GPL-3.0": ["GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later", "GPL-3.0+"], "GPL-2.0": ["GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-2.0+"],
    "BSD": ["BSD-2-Clause", "BSD-3-Clause"], "CC-BY-NC-4.0": ["CC-BY-NC-4.0"], "CC-BY-4.0": ["CC-BY-4.0"], "MPL-2.0": ["MPL-2.0"], "ISC": ["ISC"], "Unlicense": ["Unlicense"],
}
SPDX_TAG = r"(?i)SPDX-License-Identifier:\s*([^\n]*)"
_GPL = "GNU General Public License as published by the Free Software Foundation, either version {} of the License"
#: Further notices, and titles of licences, with idf of their own: the notices above keep theirs.
FURTHER = [
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-3.0", _GPL.format(3)),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-2.0", _GPL.format(2)),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International"),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International"),
]
#: Lines of a run: a notice is found in up to so many lines.
RUN = 8


def known_templates(spark: SparkSession) -> DataFrame:
    """tno, license, text, kind of all templates; each kind has idf of its own."""
    rows = [(i, *t, kind) for kind, some in enumerate((TEMPLATES, FURTHER)) for i, t in enumerate(some, 1000 * kind)]
    return spark.createDataFrame(rows, "tno int, license string, text string, kind int")


def tokens_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^a-z0-9.]+"), lambda t: F.trim(t, F.lit(".")) != "")


def terms_of(text: Column) -> Column:
    return F.transform(tokens_of(text), lambda t: F.rtrim(t, F.lit(".")))


def template_vectors(templates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """kind, term, license, tno, w (unit vectors), and kind, term, idf; from templates(tno, license, text, kind), a fixed small set."""
    terms = templates.select("kind", "tno", "license", F.explode(terms_of(F.col("text"))).alias("term"))
    counts = terms.groupBy("kind", "tno", "license", "term").agg(F.count(F.lit(1)).alias("tf"))
    n = templates.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    idf = counts.groupBy("kind", "term").agg(F.count_distinct("tno").alias("df")).join(n, "kind").select("kind", "term", (F.log((1.0 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    weighted = counts.join(idf, ["kind", "term"]).withColumn("x", F.col("tf") * F.col("idf"))
    norms = weighted.groupBy("tno").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    return weighted.join(norms, "tno").select("kind", "term", "license", "tno", (F.col("x") / F.col("norm")).alias("w")), idf


def may_be_near(unit: Column, vectors: DataFrame, threshold: float) -> Column:
    """False for the terms of texts that are provably further than threshold from every template."""
    squares: dict[int, dict[str, float]] = {}
    for r in vectors.collect():
        squares.setdefault(r.tno, {})[r.term] = r.w * r.w
    every = F.array(*(F.lit(t) for t in sorted(set().union(*squares.values()))))
    held = F.array(*(F.array(*(F.struct(F.lit(t).alias("term"), F.lit(s).alias("square")) for t, s in some.items())) for some in squares.values()))
    least = (threshold - 2e-6) ** 2  # cosines are rounded to 6 places

    def any_template(shared: Column) -> Column:
        return F.exists(held, lambda t: F.aggregate(t, F.lit(0.0), lambda a, x: a + F.when(F.array_contains(shared, x["term"]), x["square"]).otherwise(0.0)) >= least)

    return F.coalesce(F.get(F.transform(F.array(F.array_intersect(unit, every)), any_template), F.lit(0)), F.lit(False))


def _units(base: DataFrame, vectors: DataFrame, threshold: float) -> DataFrame:
    """fid, uid, terms of the runs of lines, the blocks of lines and, of licence files, the whole texts, as far as they may be near a template."""
    def tells(unit: Column) -> Column:
        return may_be_near(unit, vectors, threshold)

    name = F.regexp_extract("path", r"([^/]*)$", 1)
    whole = F.when(name.rlike(LICENCE_FILE), F.array(terms_of(F.col("text")))).otherwise(F.array().cast("array<array<string>>"))
    # a block ends before a line without a letter or digit
    blocks = F.transform(F.split(F.lower("text"), r"\n[^a-z0-9\n]*\n[^a-z0-9]*"), terms_of)
    lines = F.filter(F.transform(F.split("text", "\n"), terms_of), lambda line: F.size(line) > 0)
    near = base.where(tells(terms_of(F.col("text"))))
    near = spool(near.select("fid", lines.alias("lines"), F.filter(F.concat(blocks, F.coalesce(whole, F.array())), tells).alias("longer")))

    def runs(_: Column, i: Column) -> Column:
        ends = F.sequence(F.lit(1), F.least(F.lit(RUN), F.size("lines") - i))
        return F.filter(F.transform(ends, lambda n: F.flatten(F.slice("lines", i + 1, n))), tells)

    found = near.select("fid", F.explode(F.concat(F.flatten(F.transform("lines", runs)), F.col("longer"))).alias("terms"))
    return found.select("fid", F.sha2(F.array_join("terms", " ").cast("binary"), 256).alias("uid"), "terms")


def scan(files: DataFrame, templates: DataFrame, threshold: float = 0.7, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text") -> DataFrame:
    """Per row of files: doc_id, path, own_license, similarity, license, inherited_from.

    templates(tno, license, text) may have a kind; each kind has idf of its own.
    own_license: that of the template with the largest cosine, at least threshold, to a run of 1 to RUN lines (lines
    without a letter or digit don't count), to a block of lines between such, or to the whole text of a licence file, or
    that of an SPDX tag (similarity 1); of equal ones the first by name. license: own_license, or that of the nearest directory above the file (its own
    included) with a licence file that has a licence; of several there the largest cosine, then the first by name.
    inherited_from is that directory ('' is the root). Whole texts are searched. Null texts have no licence of their
    own, null paths inherit nothing. Ids with their paths name a file; repeated rows each give a row. An empty table
    gives an empty result; columns other than those named are ignored.
    """
    base = files.select(F.col(id_col).alias("doc_id"), F.col(path_col).alias("path"), F.col(text_col).alias("text"))
    # a file's name for joins: nulls are values of their own
    base = base.withColumn("fid", F.to_json(F.struct("doc_id", "path"), {"ignoreNullFields": "false"}))
    templates = templates if "kind" in templates.columns else templates.withColumn("kind", F.lit(0))
    vectors, idf = map(spool, template_vectors(templates))  # the templates' own terms: a fixed small set
    kinds = F.broadcast(templates.groupBy("kind").agg((F.log(1.0 + F.count(F.lit(1))) + 1).alias("unseen")))

    tags = base.where(F.col("text").rlike(SPDX_TAG)).select("fid", F.explode(F.flatten(F.transform(F.regexp_extract_all("text", F.lit(SPDX_TAG), 1), lambda t: F.split(F.lower(t), r"[^a-z0-9.+\-]+")))).alias("id"))
    ids = base.sparkSession.createDataFrame([(i.lower(), name) for name, some in SPDX.items() for i in some], "id string, license string")
    tagged = tags.join(F.broadcast(ids), "id").select("fid", F.lit(-1.0).alias("minus"), "license")

    units = spool(_units(base, vectors, threshold))
    terms = units.dropDuplicates(["uid"]).select("uid", F.explode("terms").alias("term"))
    counts = terms.groupBy("uid", "term").agg(F.count(F.lit(1)).alias("tf")).crossJoin(kinds).join(F.broadcast(idf), ["kind", "term"], "left")
    counts = counts.withColumn("x", F.col("tf") * F.coalesce("idf", "unseen"))
    norms = counts.groupBy("uid", "kind").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    dots = counts.join(F.broadcast(vectors), ["kind", "term"]).groupBy("uid", "kind", "tno", "license").agg(F.sum(F.col("x") * F.col("w")).alias("dot"))
    near = dots.join(norms, ["uid", "kind"]).withColumn("cosine", F.round(F.col("dot") / F.col("norm"), 6)).where(F.col("cosine") >= threshold)
    best = F.min(F.struct((-F.col("cosine")).alias("minus"), F.col("license").alias("license"))).alias("b")
    known = spool(near.groupBy("uid").agg(best).select("uid", "b.minus", "b.license"))
    own = units.select("fid", "uid").join(known, "uid").select("fid", "minus", "license").union(tagged).groupBy("fid").agg(F.min(F.struct("minus", "license")).alias("b"))
    own = spool(own.select("fid", F.col("b.license").alias("own_license"), (-F.col("b.minus")).alias("similarity")))

    folder = F.regexp_replace("path", r"/?[^/]*$", "")
    with_own = spool(base.select("fid", "doc_id", "path", folder.alias("dir")).join(own, "fid", "left").drop("fid"))
    at = with_own.where(F.col("own_license").isNotNull() & F.regexp_extract("path", r"([^/]*)$", 1).rlike(LICENCE_FILE))
    chosen = F.min(F.struct((-F.col("similarity")).alias("minus"), F.col("own_license").alias("license")))
    licensed = spool(at.groupBy("dir").agg(chosen.alias("b")).select(F.col("dir").alias("__dir"), F.col("b.license").alias("dir_license")))

    # directories, far fewer than files, look for the nearest licensed one at or above them
    steps = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(steps)), lambda i: F.array_join(F.slice(steps, 1, i), "/"))
    upward = with_own.where("dir IS NOT NULL").select("dir").distinct().select("dir", F.posexplode(F.array_distinct(above)).alias("depth", "up"))
    nearest = upward.join(licensed, F.col("up") == F.col("__dir")).groupBy("dir").agg(F.max(F.struct("depth", "up", "dir_license")).alias("n"))
    nearest = spool(nearest.select(F.col("dir").alias("__at"), F.col("n.up").alias("up"), F.col("n.dir_license").alias("dir_license")))
    found = with_own.join(nearest, F.col("dir") == F.col("__at"), "left")
    alone = F.col("own_license").isNull()
    return found.select("doc_id", "path", "own_license", "similarity", F.coalesce("own_license", "dir_license").alias("license"), F.when(alone, F.col("up")).alias("inherited_from"))
