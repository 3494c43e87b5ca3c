"""Licences of files, from their headers, licence files and directories.

Method: sparse TF-IDF cosine of headers and licence files to templates, then
inheritance from the nearest ancestor directory by joins on paths. Everything
is DataFrame operations.

Terms are weighted by their frequency over all lines of all files. A line is
only compared with the templates with which it shares a distinctive term: one
of those without which the rest of a template is too short to reach the
threshold. So what is not compared can not be similar, and nothing is lost.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm.common import keep, query, table

NEAR = 0.8
#: The share of its words that makes a file without a telling name a licence file.
WHOLE = 0.5
WORD = r"[a-z0-9]+(?:[.+-][a-z0-9]+)*"
LICENCE_NAME = r"(?i)^(licen[cs]e|copying|notice|unlicense)([.-].*)?$"
#: Fixed texts: usual statements of public licences, by SPDX identifier; a licence may have several.
TEMPLATES = (
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0 Universal."),
    ("EPL-2.0", "Licensed under the Eclipse Public License, Version 2.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "Released under the ISC License."),
    ("LGPL-2.1", "Licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("MPL-2.0", "Licensed under the Mozilla Public License, Version 2.0."),
    ("Proprietary", "All rights reserved."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)


def _words(line: Column) -> Column:
    return F.regexp_extract_all(F.lower(line), F.lit(WORD), 0)


def _literals(values: list) -> Column:
    return F.array(*(F.lit(v) for v in values))


def term_weights(texts: DataFrame, terms: list[str]) -> tuple[dict[str, float], float]:
    """Return the IDF of each template term over all lines of all texts, and that of a term found in no line."""
    lines = F.split("text", "\n", -1)
    counted = texts.select(F.size(lines).alias("lines"), F.transform(lines, lambda line: F.array_intersect(_words(line), _literals(terms))).alias("hits"))
    # One scan: the row without a term counts the lines.
    rows = counted.select("lines", F.explode(F.concat(F.flatten("hits"), F.array(F.lit(None).cast("string")))).alias("term"))
    found = {r["term"]: r for r in rows.groupBy("term").agg(F.count("*").alias("df"), F.sum("lines").alias("lines")).collect()}
    total = found[None]["lines"] if None in found else 0
    idf = {t: math.log((1 + total) / (1 + (found[t]["df"] if t in found else 0))) + 1 for t in terms}
    return idf, math.log(1 + total) + 1


def _weighted(templates: tuple[tuple[str, str], ...], idf: dict[str, float], near: float) -> list[tuple]:
    """Rows ``(number, licence, size, weights, length, distinctive)`` of the templates."""
    rows = []
    for number, (licence, text) in enumerate(templates):
        words = re.findall(WORD, text.lower())
        weights = {t: n * idf[t] for t, n in Counter(words).items()}
        length = math.sqrt(sum(w * w for w in weights.values()))
        rest, distinctive = length**2, []
        for term in sorted(weights, key=lambda t: (-weights[t], t)):
            if rest < (near * length) ** 2 * (1 - 1e-9):
                break
            distinctive.append(term)
            rest -= weights[term] ** 2
        rows.append((number, licence, len(words), weights, length, distinctive))
    return rows


def _cosine(window: Column, idf: Column, most: float) -> Column:
    """Cosine of a window's TF-IDF vector with that of the template in the row."""
    weight = lambda term: F.coalesce(idf[term], F.lit(most))
    dot = F.aggregate(window, F.lit(0.0), lambda sum_, term: sum_ + F.coalesce(F.col("weights")[term], F.lit(0.0)) * weight(term))
    own = F.aggregate(
        F.array_distinct(window),
        F.lit(0.0),
        lambda sum_, term: sum_ + F.pow(F.size(F.filter(window, lambda other: other == term)) * weight(term), F.lit(2.0)),
    )
    return F.round(F.coalesce(dot / (F.sqrt(own) * F.col("length")), F.lit(0.0)), 6)


def matches(files: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, near: float = NEAR) -> DataFrame:
    """Return the licence of each line of ``files(path, text)`` that states one.

    ``(path, line, licence, score, size, words)``: the best window of the line,
    by score, then licence; ``size`` words of it, of ``words`` of the whole file.
    """
    spark = files.sparkSession
    terms = sorted({t for _, text in templates for t in re.findall(WORD, text.lower())})
    idf, most = term_weights(files, terms)
    rows = _weighted(templates, idf, near)
    by_number = spark.createDataFrame(rows, "number int, licence string, size int, weights map<string, double>, length double, distinctive array<string>")
    weights = F.create_map(*chain.from_iterable((F.lit(t), F.lit(w)) for t, w in idf.items()))
    distinctive = sorted({t for row in rows for t in row[5]})
    telling = "(?i)(" + "|".join(re.escape(t) for t in distinctive) + ")"
    lines = (
        files.where(F.col("text").rlike(telling))
        .select("path", F.size(_words(F.col("text"))).alias("words"), F.posexplode(F.split("text", "\n", -1)).alias("line", "content"))
        .where(F.col("content").rlike(telling))
        .withColumn("tokens", _words(F.col("content")))
    )
    shared = by_number.select("number", F.explode("distinctive").alias("term"))
    pairs = (
        lines.select("path", "line", "words", "tokens", F.explode(F.array_intersect("tokens", _literals(distinctive))).alias("term"))
        .join(F.broadcast(shared), "term")  # a row for each term of the given templates
        .groupBy("path", "line", "words", "tokens")
        .agg(F.collect_set("number").alias("numbers"))
        .select("path", "line", "words", "tokens", F.explode("numbers").alias("number"))
        .join(F.broadcast(by_number.drop("distinctive")), "number")
    )
    last = F.greatest(F.size("tokens") - F.col("size"), F.lit(0))
    windows = pairs.select("*", F.explode(F.sequence(F.lit(0), last)).alias("at"))
    window = F.slice("tokens", F.col("at") + 1, F.col("size"))
    scored = windows.select("path", "line", "words", "licence", "size", _cosine(window, weights, most).alias("score")).where(F.col("score") >= near)
    first = scored.groupBy("path", "line", "words", "score", "licence").agg(F.max("size").alias("size"))
    order = F.struct(-F.col("score"), "licence")
    top = first.groupBy("path", "line", "words").agg(F.max("score").alias("score"), F.min_by(F.struct("licence", "size"), order).alias("best"))
    return top.select("path", "line", "best.licence", "score", "best.size", "words")


def directory(path: Column) -> Column:
    """The directory of a path, without its last slash; that of a name alone is empty."""
    return F.regexp_replace(F.regexp_replace(path, r"[^/]*$", ""), r"/+$", "")


def ancestors(folder: Column) -> Column:
    """A directory and those above it, the nearest first, down to the empty one."""
    parts = F.split(folder, "/", -1)
    return F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def scan(
    files: DataFrame,
    path_col: str = "path",
    text_col: str = "text",
    templates: tuple[tuple[str, str], ...] = TEMPLATES,
    near: float = NEAR,
) -> DataFrame:
    """Return ``(path, licence, score, origin, inherited_from)`` for every path.

    ``origin`` is ``file`` for a licence file, ``header`` for another file that
    states its licence, ``directory`` for one that inherits the licence of the
    nearest directory at or above its own that has a licence file, else null.
    Of several licences in a file, or licence files in a directory, the best
    score counts, then the first licence by name.

    Null or empty text: states nothing, may inherit. A null path: no row. Rows
    that share a path are one file. Other columns are ignored. No rows give no
    rows.
    """
    rows = files.where(F.col(path_col).isNotNull()).select(
        F.col(path_col).cast("string").alias("path"), F.coalesce(text_col, F.lit("")).alias("text")
    )
    found = matches(rows, templates, near)
    per_file = found.groupBy("path").agg(
        F.min_by(F.struct("licence", "score"), F.struct(-F.col("score"), "licence")).alias("best"),
        F.sum("size").alias("size"),
        F.max("words").alias("words"),
    )
    name = F.regexp_extract("path", r"[^/]*$", 0)
    whole = name.rlike(LICENCE_NAME) | (F.col("size") >= F.col("words") * WHOLE)
    stated = keep(per_file.select("path", "best.licence", "best.score", F.when(whole, "file").otherwise("header").alias("origin")), "licences")
    holders = (
        stated.where("origin = 'file'")
        .groupBy(directory(F.col("path")).alias("holder"))
        .agg(F.min_by(F.struct("licence", "score"), F.struct(-F.col("score"), "licence")).alias("given"))
    )
    paths = rows.select("path").distinct()
    # Inheritance is between directories, so a directory of very many files is one row here.
    folders = paths.select(directory(F.col("path")).alias("folder")).distinct()
    above = folders.select("folder", F.posexplode(ancestors(F.col("folder"))).alias("far", "holder"))
    inherited = keep(
        above.join(holders, "holder").groupBy("folder").agg(F.min(F.struct("far", "holder", "given")).alias("from")).select("folder", "from.holder", "from.given"),
        "licence-folders",
    )
    own = paths.join(stated, "path", "left").withColumn("folder", directory(F.col("path")))
    # Files with a licence of their own need no directory; the others meet a written table, so a large directory is split.
    heirs = own.where("licence is null").select("path", "folder").join(inherited, "folder", "left")
    return own.where("licence is not null").select(
        "path", "licence", "score", "origin", F.lit(None).cast("string").alias("inherited_from")
    ).union(
        heirs.select(
            "path",
            "given.licence",
            "given.score",
            F.when(F.col("given").isNotNull(), "directory").alias("origin"),
            F.col("holder").alias("inherited_from"),
        )
    )


@query()
def op5_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence of every document, taken as a file named by its id in a directory for its source and language."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")), F.col("doc_id").cast("string"))
    found = scan(docs.where("doc_id is not null").select(path.alias("path"), "text"))
    return found.select(F.regexp_extract("path", r"[^/]*$", 0).cast("long").alias("doc_id"), "licence", "score", "origin", "inherited_from")
