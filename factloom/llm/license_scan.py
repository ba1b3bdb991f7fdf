"""Licence scans with a trained paragraph classifier.

Paragraphs are word uni- and bigrams, hashed into sparse vectors; a multinomial logistic
regression tells the licence families from each other and from everything else. It is
trained on the notices below, their sentences and shortened variants, and on a bounded
sample of paragraphs that have nothing in common with any notice. Held-out paragraphs
calibrate it: a temperature for the probabilities, and the probability below which a
paragraph is of the unknown class. A predicted family counts only if the paragraph also
shares enough word bigrams with a notice of that family.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.binding import let
from factloom.llm.common import ascii_lower, cut_words
from factloom.staging import stage

NONE = "none"
FEATURES = 1 << 14
# Paragraphs without a licence to train on and to calibrate with, taken by hash.
SAMPLE = 4000
# Share of a paragraph's bigrams, or of a notice's, that must be common to confirm.
COMMON = 0.5

# Usual licence notices of each family, in their own words.
NOTICES = {
    "agpl": [
        "This program is licensed under the GNU Affero General Public License, version 3.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Released under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "cc": [
        "Licensed under CC BY-NC 4.0.",
        "Licensed under CC BY 4.0.",
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
    ],
    "mit": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "SPDX-License-Identifier: MIT",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, you can obtain one at https://mozilla.org/MPL/2.0/",
    ],
    "proprietary": [
        "Copyright, all rights reserved. No part of this publication may be reproduced without prior written permission.",
        "Proprietary and confidential. Unauthorized copying of this file, via any medium, is strictly prohibited.",
    ],
    "public_domain": [
        "This is free and unencumbered software released into the public domain.",
        "Released under CC0 1.0 Universal Public Domain Dedication.",
        "SPDX-License-Identifier: Unlicense",
    ],
}

# Sentences that speak of licences without giving one.
MENTIONS = [
    "A driving license is required to rent a car in most countries.",
    "The city granted a license to the new restaurant last week.",
    "He read the software license and did not agree with its terms.",
    "The general public was not allowed to enter the library.",
    "Please include a copy of your passport with the application.",
    "The version of the program that was released in the spring had errors.",
    "Students from MIT released a report under the direction of their teacher.",
    "The apache helicopter was licensed to fly under new rules.",
    "The foundation published the terms of the work in public.",
    "Creative people in the commons enjoyed an international evening.",
]


def words_of(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


def words(text: Column) -> Column:
    """Words of letters and digits of ASCII; a classifier of English notices needs no others."""
    return cut_words(ascii_lower(text), "[^a-z0-9]+")


def bigrams(held: Column) -> Column:
    pairs = F.zip_with(
        F.slice(held, 1, F.greatest(F.size(held) - 1, F.lit(0))),
        F.slice(held, 2, F.size(held)),
        lambda a, b: F.concat_ws(" ", a, b),
    )
    return F.when(F.size(held) < 2, F.array().cast("array<string>")).otherwise(pairs)


def bigrams_of(text: str) -> set[str]:
    held = words_of(text)
    return {f"{a} {b}" for a, b in zip(held, held[1:], strict=False)}


def variants(notice: str) -> list[str]:
    """The notice, its sentences, and what is left if each third of its words is missing."""
    held = notice.split()
    parts = [s for s in re.split(r"(?<=[.;])\s+", notice) if len(s.split()) >= 5]
    less = [" ".join(w for k, w in enumerate(held) if k % 3 != j) for j in range(3) if len(held) >= 9]
    ends = [" ".join(held[: len(held) * 2 // 3]), " ".join(held[len(held) // 3 :])]
    return list(dict.fromkeys([notice, *parts, *less, *(e for e in ends if len(e.split()) >= 5)]))


def paragraphs(docs: DataFrame) -> DataFrame:
    """``(doc_id, _row, _paragraph)``: the lines that have a word."""
    return docs.select(
        "doc_id", F.explode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("_paragraph")
    ).filter(F.rlike("_paragraph", F.lit("[A-Za-z0-9]")))


def featured(df: DataFrame) -> DataFrame:
    """Add ``features`` of ``_paragraph``: which uni- and bigrams it has."""
    terms = let(words(F.col("_paragraph")), lambda held: F.concat(held, bigrams(held)))
    hashing = HashingTF(numFeatures=FEATURES, binary=True, inputCol="_terms", outputCol="features")
    return hashing.transform(df.withColumn("_terms", terms)).drop("_terms")


@dataclass
class Classifier:
    model: LogisticRegressionModel
    families: list[str]
    temperature: float
    threshold: float


def training_rows(spark: SparkSession, docs: DataFrame, sample: int) -> DataFrame:
    """``(_paragraph, label, _fold)``: the notices, and of ``sample`` different paragraphs
    those that have no word pair of a notice."""
    families = [NONE, *NOTICES]
    known = [(v, float(families.index(f))) for f, notices in NOTICES.items() for n in notices for v in variants(n)]
    known += [(m, 0.0) for m in MENTIONS]
    told = F.array(*[F.lit(b) for b in sorted(set().union(*(bigrams_of(t) for t, label in known if label)))])
    # The least hashes of different paragraphs: the same sample however the table is split.
    # Hashes alone are shuffled; the texts of those below the bound are read again.
    hashed = paragraphs(docs).select("_paragraph", F.xxhash64("_paragraph").alias("_hash"))
    least = hashed.select("_hash").distinct().orderBy("_hash").limit(sample)
    bound = least.agg(F.max("_hash")).first()[0]
    other = hashed.filter(F.col("_hash") <= F.lit(bound)).select("_paragraph").distinct().filter(
        ~F.arrays_overlap(let(words(F.col("_paragraph")), bigrams), told)
    )
    rows = spark.createDataFrame(known, "_paragraph string, label double").unionAll(
        other.select("_paragraph", F.lit(0.0).alias("label"))
    )
    fold = F.when(F.col("label") > 0, F.lit(0)).otherwise(F.pmod(F.xxhash64(F.lit(1), "_paragraph"), F.lit(4)))
    return stage(rows.withColumn("_fold", fold.cast("int")).coalesce(1), "training")


def train(docs: DataFrame, sample: int = SAMPLE, miss: float = 0.001) -> Classifier:
    """Train and calibrate; ``sample`` bounds the paragraphs of ``docs`` that are used.

    ``miss`` is the share of held-out paragraphs that may pass as a licence.
    """
    rows = featured(training_rows(docs.sparkSession, docs, sample))
    learner = LogisticRegression(maxIter=60, regParam=1e-3, family="multinomial")
    model = learner.fit(rows.filter("_fold <> 1").coalesce(1))
    held = model.transform(rows.filter("_fold = 1 or label > 0")).select("rawPrediction", "label").collect()
    raw = np.array([r.rawPrediction.toArray() for r in held])
    label = np.array([int(r.label) for r in held])

    def log_probability(temperature: float) -> np.ndarray:
        z = raw / temperature
        z = z - z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))

    grid = [2.0 ** (k / 4) for k in range(-8, 9)]
    loss = [-log_probability(t)[np.arange(len(label)), label].mean() for t in grid]
    temperature = grid[int(np.argmin(loss))]
    licence = np.exp(log_probability(temperature))[:, 1:].max(axis=1)
    other = np.sort(licence[label == 0])
    allowed = math.floor(miss * len(other))
    threshold = max(0.5, float(other[len(other) - 1 - allowed]) if len(other) else 0.5)
    return Classifier(model, [NONE, *NOTICES], temperature, threshold)


def classified(found: DataFrame, learned: Classifier) -> DataFrame:
    """The paragraphs of ``found`` that are a licence, with ``family`` and ``probability``."""
    rows = learned.model.transform(featured(found))
    raw = F.transform(vector_to_array("rawPrediction"), lambda v: v / learned.temperature)
    families = F.array(*[F.lit(f) for f in learned.families])

    def chances(z: Column) -> Column:
        top = F.array_max(z)
        parts = F.transform(z, lambda v: F.exp(v - top))
        return let(parts, lambda e: F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, x: a + x)))

    def likeliest(chance: Column) -> Column:
        def told(licence: Column) -> Column:
            place = F.array_position(chance, licence).cast("int") - 1
            return F.struct(licence.alias("probability"), F.get(families, place).alias("family"))

        return let(F.array_max(F.slice(chance, 2, len(learned.families) - 1)), told)

    # A list of one prediction or none, not a filter: the optimizer would merge that with the
    # confirmation, and compare each paragraph with all notices instead of the few predicted.
    predicted = F.array(let(let(raw, chances), likeliest))
    rows = rows.select(
        *found.columns, F.inline(F.filter(predicted, lambda b: b["probability"] >= learned.threshold))
    )

    def confirmed(held: Column) -> Column:
        some = F.lit(False)
        for family, notices in NOTICES.items():
            for notice in notices:
                own = sorted(bigrams_of(notice))
                common = F.size(F.array_intersect(held, F.array(*[F.lit(b) for b in own])))
                needed = F.greatest(F.lit(1.0), COMMON * F.least(F.size(held), F.lit(len(own))))
                some = some | ((F.col("family") == family) & (common >= needed))
        return some

    return rows.filter(let(F.array_distinct(let(words(F.col("_paragraph")), bigrams)), confirmed))


def scan_licences(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``(doc_id, n_licences, families, probability)`` of every row of ``docs``.

    ``n_licences`` counts paragraphs with a confirmed licence, ``families`` lists their
    families (sorted, comma-joined), ``probability`` is the largest. Null and empty
    texts, and texts without a licence, have 0, an empty list and 0; rows with a null
    doc_id get the licences of all of them together, as do rows that repeat a doc_id;
    other columns are not looked at; an empty table gives an empty result.
    """
    docs = docs.select("doc_id", "text")
    found = classified(paragraphs(docs), train(docs, sample))
    of_doc = found.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("_n"),
        F.array_join(F.sort_array(F.collect_set("family")), ",").alias("_families"),
        F.max("probability").alias("_probability"),
    )
    of_doc = of_doc.withColumnRenamed("doc_id", "_doc")
    rows = docs.select("doc_id").join(of_doc, F.col("doc_id").eqNullSafe(F.col("_doc")), "left")
    return rows.select(
        "doc_id",
        F.coalesce("_n", F.lit(0)).cast("long").alias("n_licences"),
        F.coalesce("_families", F.lit("")).alias("families"),
        F.coalesce("_probability", F.lit(0.0)).alias("probability"),
    )
