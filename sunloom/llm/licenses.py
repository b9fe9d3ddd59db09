"""Licence notices by a trained paragraph classifier, in DataFrame functions alone.

A paragraph is a line of a text. `fit` trains a logistic regression over hashed word n-grams (1 to 3 words) on the notices in
`TEMPLATES` and variations of them, against an unknown class of everyday sentences about licences and lines of the corpus. Its
probabilities are calibrated: a temperature chosen on variations that training did not see. A line counts as a notice of its likeliest
family if the unknown class has less than `MOST_UNKNOWN` and the words of the line agree with a template of that family. Corpus lines that
read like a template are no examples of the unknown class.

Features are only n-grams with a telling word: one of the templates that corpus lines rarely have. A line without any has no
features, so it is scored as what it is, a line like all others without: unknown (`fit` checks that it is). Only lines with a telling
word take part in the scoring, which keeps the pass over all texts cheap without changing a result.

Defined cases: null and empty texts have no notices. A notice that stands in a text twice counts twice and names its family once.
Families are in alphabetical order. Repeated rows get the same result each. All columns but the text are kept; one named like the
output gives way to it. An empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sunloom.llm.common import packed, run_folder, staged, unpacked

#: Short public notices, (family, text).
TEMPLATES = [
    ("agpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public "
                 "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("agpl-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
            "conditions are met:"),
    ("bsd", "Released under the BSD 3-Clause License."),
    ("bsd", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("bsd", "SPDX-License-Identifier: BSD-3-Clause"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("cc0", "To the extent possible under law, the author has dedicated all copyright to this work to the public domain under CC0 1.0."),
    ("gpl-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License "
                "as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
                "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License."),
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
            "files, to deal in the Software without restriction."),
    ("mit", "SPDX-License-Identifier: MIT"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("proprietary", "Copyright. All rights reserved. No part of this work may be reproduced without prior written permission."),
    ("proprietary", "All rights reserved."),
]
#: Sentences that use the words of licences and are none.
OTHERS = [
    "He lost his driving license last year.", "The license of the shop was renewed by the city.", "You need permission to enter the building.",
    "The general public was not admitted.", "The software is free for students.", "She works for a foundation that funds free schools.",
    "Our library is open to the public.", "The commons passed a new law.", "A creative person wrote this work.", "The source of the river is in the hills.",
    "The warranty covers the battery for two years.", "All rights and duties pass to the buyer.", "The version of the story was reserved for later.",
    "Apache helicopters flew over the hills.", "He studied at MIT and later moved to Berkeley.", "The mozilla project began in 1998.",
    "The terms of the contract were published.", "A copy of the file was found in the archive.", "They may modify the plan without prior notice.",
    "The author has a copyright claim against the paper.", "Is the program free of charge?", "The fishing license costs ten dollars under the new rules.",
]
UNKNOWN = "unknown"
HASH_SIZE = 1 << 14
MOST_UNKNOWN = 0.5
LEAST_OVERLAP = 0.6
#: A template of so many words at most must stand in the line whole.
SHORT = 3
#: Variations of each template; lines of the corpus at most, and lines without features, in the unknown class.
VARIATIONS, CORPUS_LINES, BLANK_LINES = 40, 4_000, 1_000
#: A word of a template is telling if at most this share of the corpus lines has it.
COMMON_SHARE = 0.002
TEMPERATURES = (0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0)


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits; a point between digits belongs to them."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"\d+(?:\.\d+)+|[\p{L}\p{N}]+"), F.lit(0))


def _runs(tokens: Column, n: int) -> Column:
    """n-grams as texts."""
    last = F.greatest(F.size(tokens) - (n - 1), F.lit(0))
    return F.transform(F.slice(tokens, F.lit(1), last), lambda _, i: F.array_join(F.slice(tokens, i + 1, n), " "))


def _pairs(tokens: Column) -> Column:
    """Distinct words and pairs of neighbouring words."""
    return F.array_distinct(F.concat(_runs(tokens, 1), _runs(tokens, 2)))


def telling_runs(tokens: Column, telling: list[str]) -> Column:
    """Distinct n-grams of 1 to 3 words that have a telling word."""
    known = F.array(*[F.lit(t) for t in telling]) if telling else F.array().cast("array<string>")
    runs = F.concat(*[_runs(tokens, n) for n in (1, 2, 3)])
    return F.array_distinct(F.filter(runs, lambda r: F.arrays_overlap(F.split(r, " "), known)))


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


@dataclass
class Model:
    classifier: object
    hashing: HashingTF
    families: list[str]
    telling: list[str]
    temperature: float


def _examples(spark: SparkSession, corpus: DataFrame) -> tuple[DataFrame, list[str]]:
    """(family, tokens, part) of all training lines, part 0 is for calibration; and the families in order."""
    families = sorted({f for f, _ in TEMPLATES} | {UNKNOWN})
    known = spark.createDataFrame(TEMPLATES, "family string, line string").select("family", words(F.col("line")).alias("all"), "line")
    # a variation drops about a tenth of the words, chosen by a hash, and stands among words that belong to no notice
    varied = known.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(VARIATIONS - 1))))
    kept = F.filter(F.transform("all", lambda w, i: F.when((F.pmod(F.xxhash64(w, i, F.col("k"), F.col("line")), F.lit(100)) >= 10) | (F.col("k") == 0), w)),
                    lambda w: w.isNotNull())
    around = F.pmod(F.xxhash64("k", "line"), F.lit(4))
    varied = varied.select("family", F.concat(F.when(around == 1, F.array(F.lit("notice"))).otherwise(F.array().cast("array<string>")), kept).alias("tokens"),
                           F.pmod(F.col("k"), F.lit(4)).alias("part"))
    others = spark.createDataFrame([(t, k) for t in OTHERS for k in range(4)], "line string, part int").select(
        F.lit(UNKNOWN).alias("family"), words(F.col("line")).alias("tokens"), "part")
    plain = corpus.select(F.lit(UNKNOWN).alias("family"), "tokens", F.pmod(F.xxhash64("tokens"), F.lit(4)).alias("part"))
    # lines without any telling word belong to the unknown class, also where the corpus is small
    silent = spark.range(BLANK_LINES).select(F.lit(UNKNOWN).alias("family"), F.array().cast("array<string>").alias("tokens"), F.pmod("id", F.lit(4)).alias("part"))
    rows = [varied, others, plain, silent]
    return reduce(DataFrame.unionByName, [r.withColumn("part", F.col("part").cast("int")) for r in rows]), families


def corpus_sample(docs: DataFrame, text_col: str) -> DataFrame:
    """Token lists of lines of the corpus, CORPUS_LINES or a few more, by the order of a hash, without lines that read like a template.

    A line with a mark, or that shares LEAST_OVERLAP of its words and pairs (at least three) or a template's with a template, is left out: it
    may be a notice.
    """
    marks = ("licen", "copyright", "permission", "spdx", "redistribut")
    total = docs.count()
    share = min(1.0, CORPUS_LINES / 4 / max(total, 1))
    few = docs.where(F.pmod(F.xxhash64(text_col), F.lit(1_000_000)) < F.lit(int(share * 1_000_000) + 1))
    found = few.select(F.explode(lines(F.col(text_col))).alias("line")).where("line <> ''")
    for mark in marks:
        found = found.where(~F.lower("line").contains(mark))
    tokens = found.select(F.slice(words(F.col("line")), 1, 200).alias("tokens")).where(F.size("tokens") > 0).distinct()
    own = docs.sparkSession.createDataFrame([(t,) for _, t in TEMPLATES], "line string").select(_pairs(words(F.col("line"))).alias("of"))
    shared = F.size(F.array_intersect("pairs", "of"))
    like = (shared >= 3) & (shared >= LEAST_OVERLAP * F.least(F.size("pairs"), F.size("of")))
    plain = tokens.withColumn("pairs", _pairs(F.col("tokens"))).join(F.broadcast(own), like, "left_anti")
    return plain.select("tokens").orderBy(F.xxhash64("tokens")).limit(CORPUS_LINES)


def fit(docs: DataFrame, folder: str, text_col: str = "text") -> Model:
    spark = docs.sparkSession
    corpus = staged(corpus_sample(docs, text_col), folder, "lines")
    n = corpus.count()
    common = corpus.select(F.explode(F.array_distinct("tokens")).alias("word")).groupBy("word").count().where(F.col("count") > max(COMMON_SHARE * n, 3))
    own = spark.createDataFrame(TEMPLATES, "family string, line string").select(F.explode(words(F.col("line"))).alias("word")).distinct()
    # single letters and bare numbers tell nothing
    telling = sorted(r.word for r in own.where("length(word) > 1 AND word NOT RLIKE '^[0-9.]+$'").join(F.broadcast(common), "word", "left_anti").collect())
    examples, families = _examples(spark, corpus)
    hashing = HashingTF(inputCol="runs", outputCol="features", numFeatures=HASH_SIZE, binary=True)
    number = F.array_position(F.array(*[F.lit(f) for f in families]), F.col("family")).cast("double") - 1
    rows = hashing.transform(examples.select(number.alias("label"), telling_runs(F.col("tokens"), telling).alias("runs"), "part"))
    rows = staged(rows.select("label", "features", "part"), folder, "examples")
    classifier = LogisticRegression(regParam=1e-3, maxIter=60, family="multinomial").fit(rows.where("part > 0"))
    raw = classifier.transform(rows.where("part = 0")).select(F.col("label").cast("int").alias("label"), vector_to_array("rawPrediction").alias("raw"))
    losses = raw.agg(*[F.avg(-F.log(F.greatest(F.element_at(_softmax(F.col("raw"), t), F.col("label") + 1), F.lit(1e-12)))).alias(str(k))
                       for k, t in enumerate(TEMPERATURES)]).first()
    temperature = TEMPERATURES[min(range(len(TEMPERATURES)), key=lambda k: (losses[k] if losses[k] is not None else 0.0, abs(TEMPERATURES[k] - 1)))]
    model = Model(classifier, hashing, families, telling, temperature)
    empty = _probabilities(spark.createDataFrame([([],)], "tokens array<string>"), model).select(_best("probability", families).alias("best")).first()["best"]
    if empty.family != UNKNOWN:
        raise ValueError("the classifier takes a line without telling words for a notice")
    return model


def _softmax(raw: Column, temperature: float) -> Column:
    top = F.array_max(raw)
    powers = F.transform(raw, lambda x: F.exp((x - top) / temperature))
    return F.transform(powers, lambda p: p / F.aggregate(powers, F.lit(0.0), lambda a, b: a + b))


def _probabilities(rows: DataFrame, model: Model) -> DataFrame:
    """`rows` (with tokens) plus the calibrated probability of each class."""
    coded = model.hashing.transform(rows.withColumn("runs", telling_runs(F.col("tokens"), model.telling)))
    found = model.classifier.transform(coded).withColumn("probability", _softmax(vector_to_array("rawPrediction"), model.temperature))
    return found.drop("runs", "features", "rawPrediction", "prediction")


def _best(probability: str, families: list[str]) -> Column:
    """The likeliest class and its probability."""
    at = F.array_position(probability, F.array_max(probability)).cast("int")
    return F.struct(F.element_at(F.array(*[F.lit(f) for f in families]), at).alias("family"), F.array_max(probability).alias("sure"))


def notices(docs: DataFrame, model: Model, folder: str, text_col: str = "text", out: str = "notices") -> DataFrame:
    """`docs` without texts, with `out`: an array of (family, probability, overlap) of the confirmed notices in order of the lines."""
    spark = docs.sparkSession
    names = [c for c in docs.columns if c not in (text_col, out)]
    known = F.array(*[F.lit(t) for t in model.telling])
    some = F.filter(F.transform(lines(F.col(text_col)), lambda x, i: F.struct(i.alias("at"), words(x).alias("tokens"))),
                    lambda x: F.arrays_overlap(x["tokens"], known))
    rows = staged(docs.select(F.monotonically_increasing_id().alias("_row"), packed(names), some.alias("_lines")), folder, "telling")
    told = rows.where(F.size("_lines") > 0).select("_row", F.explode("_lines").alias("_line")).select("_row", F.col("_line.at").alias("_at"), F.col("_line.tokens").alias("tokens"))
    # few rows, much work each: spread them, by the keys that the comparison groups by
    told = told.repartition("_row", "_at")
    scored = _probabilities(told, model).withColumn("_best", _best("probability", model.families))
    scored = scored.where(F.element_at("probability", model.families.index(UNKNOWN) + 1) < MOST_UNKNOWN).where(F.col("_best.family") != UNKNOWN)
    # the templates: a fixed list
    own = spark.createDataFrame(TEMPLATES, "family string, line string").select(
        F.col("family").alias("_family"), _pairs(words(F.col("line"))).alias("_of"), (F.size(words(F.col("line"))) <= SHORT).alias("_short"))
    runs = _pairs(F.col("tokens"))
    overlap = F.size(F.array_intersect(runs, F.col("_of"))) / F.when(F.col("_short"), F.size("_of")).otherwise(F.least(F.size(runs), F.size("_of")))
    compared = scored.join(F.broadcast(own), F.col("_best.family") == F.col("_family")).withColumn("_overlap", overlap)
    compared = compared.where(F.col("_overlap") >= F.when(F.col("_short"), 1.0).otherwise(LEAST_OVERLAP)).groupBy("_row", "_at").agg(
        F.max("_best.family").alias("family"), F.max("_best.sure").alias("probability"), F.max("_overlap").alias("overlap"))
    item = F.struct(F.col("_at").alias("line"), "family", "probability", "overlap")
    per_row = compared.groupBy("_row").agg(F.array_sort(F.collect_list(item)).alias("_notices"))
    none = F.array().cast("array<struct<line: int, family: string, probability: double, overlap: double>>")
    found = rows.select("_row", "packed").join(per_row, "_row", "left")
    return found.select(*unpacked(names), F.coalesce(F.col("_notices"), none).alias(out))


def scan(docs: DataFrame, text_col: str = "text", out: str = "notices") -> DataFrame:
    """Train on the corpus and look for notices in it."""
    folder = run_folder(docs.sparkSession, "licences")
    return notices(docs, fit(docs.select(text_col), folder, text_col), folder, text_col, out)
