"""Licence scan: sparse TF-IDF cosine of notices to templates, then inheritance along directories.

Every line of every file is a possible notice. Lines that share a telling word
with a template are compared with all templates by the cosine of their TF-IDF
vectors; document frequencies are counted over all lines of the corpus. The best
notice names the file's licence. A file that is little more than a notice is the
licence file of its directory; files without a notice of their own take the
licence of the nearest directory above them that has one.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from episodica.llm.shared import staged

# The notices that the scan knows.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released into the public domain under CC0 1.0."),
    ("proprietary", "All rights reserved."),
)
#: Smallest cosine of a notice, and the largest number of words besides notices in a licence file.
THRESHOLD = 0.7
FILE_WORDS = 40
TERM = "[a-z0-9]+(?:[.-][a-z0-9]+)*"


def _terms(column: str) -> str:
    return f"regexp_extract_all(lower({column}), '{TERM}', 0)"


def _template_terms(spark) -> DataFrame:
    rows = spark.createDataFrame([(k, name, text) for k, (name, text) in enumerate(TEMPLATES)], "template int, licence string, notice string")
    terms = rows.select("template", "licence", F.explode(F.expr(_terms("notice"))).alias("term"))
    return terms.groupBy("template", "licence", "term").agg(F.count(F.lit(1)).alias("tf"))


def _telling(rows: list, df: dict[str, int], total: int, threshold: float) -> list[str]:
    """Words of which a line that reaches the threshold holds at least one; as rare ones as possible.

    A line with other words only has at most the cosine of the template's part in these words, so the most frequent words are left
    out as long as that stays below the threshold for every template.
    """
    weight = {(r["template"], r["term"]): (r["tf"] * (math.log((total + 1) / (df.get(r["term"], 0) + 1)) + 1)) ** 2 for r in rows}
    whole: dict[int, float] = {}
    for (k, _), v in weight.items():
        whole[k] = whole.get(k, 0.0) + v
    left, telling = dict.fromkeys(whole, 0.0), []
    for term in sorted({w for _, w in weight}, key=lambda w: (-df.get(w, 0), w)):
        grown = {k: left[k] + weight.get((k, term), 0.0) for k in whole}
        if all(grown[k] < (threshold * 0.999) ** 2 * whole[k] for k in whole):
            left = grown
        else:
            telling.append(term)
    return telling


def notices(files: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(path, licence, score, notice_words) of the best notice of each file that has one; ``files`` has (path, text).

    A term's document frequency is the number of lines that hold it, over all files; idf = ln((lines + 1) / (df + 1)) + 1. Terms
    that no template holds weigh as much as an unseen one. Equal scores: the licence that sorts first.
    """
    spark = files.sparkSession
    templates = _template_terms(spark)  # a fixed list: about a hundred rows
    vocabulary = sorted({r["term"] for r in templates.select("term").distinct().collect()})
    words = F.array(*map(F.lit, vocabulary))
    lines = files.select("path", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("line", "notice"))
    lines = lines.select("path", "line", F.expr(_terms("notice")).alias("terms"))
    known = lines.select("path", "line", "terms", F.array_intersect(F.array_distinct("terms"), words).alias("known")).where(F.size("terms") > 0)
    counts = known.select(F.explode(F.concat(F.array(F.lit("")), "known")).alias("term")).groupBy("term").count().collect()
    df = {r["term"]: r["count"] for r in counts}
    total = df.pop("", 0)
    idf = F.create_map(*[x for w in vocabulary for x in (F.lit(w), F.log(F.lit((total + 1) / (df.get(w, 0) + 1))) + 1)])
    unseen = F.log(F.lit(float(total + 1))) + 1

    telling = _telling(templates.collect(), df, total, threshold)
    some = known.where(F.arrays_overlap("known", F.array(*map(F.lit, telling))))
    some = some.select("path", "line", F.size("terms").alias("n"), F.explode("terms").alias("term"))
    some = some.groupBy("path", "line", "n", "term").agg(F.count(F.lit(1)).alias("tf"))
    some = some.withColumn("w", F.col("tf") * F.coalesce(F.element_at(idf, F.col("term")), unseen))
    some = staged(some, "terms")
    norms = some.groupBy("path", "line", "n").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    weights = templates.withColumn("v", F.col("tf") * F.element_at(idf, F.col("term"))).drop("tf")
    lengths = weights.groupBy("template").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("length"))
    weights = F.broadcast(weights.join(lengths, "template"))  # the fixed list again
    dots = some.join(weights, "term").groupBy("path", "line", "template", "licence", "length").agg(F.sum(F.col("w") * F.col("v")).alias("dot"))
    scored = dots.join(norms, ["path", "line"]).select("path", "line", "n", "licence", (F.col("dot") / (F.col("norm") * F.col("length"))).alias("score"))
    passed = scored.where(F.col("score") >= threshold)
    per_line = passed.select("path", "line", "n").distinct()
    first = passed.select("path", F.round("score", 6).alias("score"), "licence")
    best = first.groupBy("path").agg(F.max("score").alias("score")).join(first, ["path", "score"]).groupBy("path", "score").agg(F.min("licence").alias("licence"))
    return best.join(per_line.groupBy("path").agg(F.sum("n").alias("notice_words")), "path").select("path", "licence", "score", "notice_words")


def scan(files: DataFrame, threshold: float = THRESHOLD, file_words: int = FILE_WORDS) -> DataFrame:
    """Each row of ``files`` (path, text, more columns kept) with licence, score, origin and licence_dir.

    origin: ``own`` for a notice in the file, ``inherited`` from the directory licence_dir, null for neither. Of several licence
    files in a directory the best score counts, then the licence that sorts first. Defined cases: null or empty texts have no
    notice and may inherit; a null path has neither; rows that share a path are one file for inheritance and share the best notice.
    """
    named = files.where("path IS NOT NULL")
    own = staged(notices(named.select("path", "text"), threshold), "notices")
    sizes = named.join(own.select("path", "notice_words"), "path", "left_semi").groupBy("path").agg(F.max(F.size(F.expr(_terms("text")))).alias("words"))
    holders = own.join(sizes, "path").where(F.col("words") <= F.col("notice_words") + file_words)
    holders = holders.select(F.regexp_replace("path", "/[^/]*$", "").alias("licence_dir"), F.struct(-F.col("score"), F.col("licence")).alias("s"))
    holders = holders.groupBy("licence_dir").agg(F.min("s").alias("s")).select("licence_dir", F.col("s.licence").alias("dir_licence"))

    here = F.regexp_replace("path", "/[^/]*$", "")
    dirs = named.select(here.alias("dir")).distinct()
    steps = F.split("dir", "/")
    above = dirs.select("dir", F.explode(F.transform(F.sequence(F.lit(1), F.size(steps)), lambda k: F.array_join(F.slice(steps, 1, k), "/"))).alias("licence_dir"))
    nearest = above.join(holders, "licence_dir").groupBy("dir").agg(F.max_by(F.struct("licence_dir", "dir_licence"), F.length("licence_dir")).alias("up"))
    out = files.withColumn("_l_dir", here).join(own.select(F.col("path").alias("_l_path"), F.col("licence").alias("_l_own"), F.col("score").alias("_l_score")),
                                               F.col("path") == F.col("_l_path"), "left")
    out = out.join(nearest.select(F.col("dir").alias("_l_at"), F.col("up").alias("_l_up")), F.col("_l_dir") == F.col("_l_at"), "left")
    kept = [c for c in files.columns if c not in ("licence", "score", "origin", "licence_dir")]
    alone = F.col("_l_own").isNotNull()
    return out.select(*kept, F.coalesce("_l_own", "_l_up.dir_licence").alias("licence"), F.col("_l_score").alias("score"),
                      F.when(alone, "own").when(F.col("_l_up").isNotNull(), "inherited").alias("origin"),
                      F.when(~alone, F.col("_l_up.licence_dir")).alias("licence_dir"))


def document_files(docs: DataFrame) -> DataFrame:
    """The sample documents as files of a tree: some right below their source, some below its language, the rest in folders there."""
    n, part = F.col("doc_id").cast("long"), lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    lang = F.when(n % 7 == 0, None).otherwise(part("lang"))
    folder = F.when((n % 7 == 0) | (n % 3 == 0), None).otherwise(F.floor(n / 1000).cast("string"))
    path = F.concat_ws("/", F.lit(""), part("source"), lang, folder, F.concat(n.cast("string"), F.lit(".txt")))
    return docs.select(n.alias("doc_id"), F.when(n.isNotNull(), path).alias("path"), F.col("text").cast("string").alias("text"))
