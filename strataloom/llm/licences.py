"""Licence scans by a trained paragraph classifier, scored in DataFrame operations only.

A multinomial logistic regression on sparse word n-grams is trained on the driver from the fixed notices below, their
wordings and counter-examples. It is exported as a table of n-gram weights; paragraphs with a cue word are split into
n-grams, joined to that table and summed. The probability is calibrated by a temperature that is fitted on notices none
of whose wordings were trained on; below a threshold, or if no template of the predicted family is contained well
enough, the paragraph's family is unknown.

A paragraph is a line, and beside its lines a wrapped paragraph: lines that follow each other up to a blank line or to
one that ends a sentence, read as one. Every notice and template of a family has a cue word, as CUES lists the words
without which none of them can be confirmed; so paragraphs without one need no score.

Defined results: a null text has no paragraphs; a paragraph without a cue word gives no row, nor does one without
n-grams of the model; rows may repeat and are all reported; an empty table gives no row.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

# Names and customary notices of public licences.
NOTICES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "Apache License Version 2.0, January 2004",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT license. See LICENSE for details.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction.',
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, subject to the following conditions:",
        "SPDX-License-Identifier: MIT",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "This software is distributed under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Licensed under the BSD 2-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "Licensed under the GPLv3.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "Licensed under the LGPLv2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc0": ["Released into the public domain under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related rights to this work."],
    "proprietary": ["All rights reserved.", "Copyright 2021 Example Corporation. All rights reserved. Unauthorized copying of this file is strictly prohibited.", "This document is proprietary and confidential."],
}
COUNTER = [
    "He renewed his driver's license at the office last week.",
    "The restaurant lost its liquor license after the inspection.",
    "The court held that the copyright claim was filed too late.",
    "A fishing license is required on this lake from May to September.",
    "The warranty covers parts and labour for two years from purchase.",
    "They apply for a license to export the machines.",
    "Artistic license allows the poet to bend the rules of grammar.",
    "The park is open to the general public, version of the map at the gate.",
    "Apache helicopters were seen over the valley.",
    "The new software version 2.0 is faster than version 1.0.",
    "Software as a service changes how a license is sold.",
    "The terms of the agreement were read to all persons present.",
]
FAMILIES = sorted(NOTICES)
UNKNOWN = "unknown"
CUES = r"(?i)licen[sc]|copyright|creative commons|public domain|rights reserved|spdx|permission is hereby|redistribution|apache|gnu|gpl|mozilla|\bcc[ -]?(?:by|0)|confidential"
TOKEN = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
#: Least calibrated probability, and least share of a template's n-grams that confirms a prediction.
LEAST_PROBABILITY, LEAST_TEMPLATE = 0.5, 0.6
DECAY, ROUNDS = 1e-4, 300


def tokens(text: str) -> list[str]:
    return re.findall(TOKEN, text.lower())


def ngrams(words: list[str]) -> list[str]:
    """Distinct n-grams of one to three words, in order."""
    return list(dict.fromkeys(" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)))


def wordings() -> list[tuple[str, int, int]]:
    """(text, class, fold): each notice as it is and in other surroundings, all in one fold; the last class is unknown."""
    frames = ["{}", "Copyright (c) 2020 The Authors. {}", "{} See the file for details.", "# {}", "Note: {}", "{} You may obtain a copy of it on request."]
    out = [(frame.format(notice), k, i % 3) for k, family in enumerate(FAMILIES) for i, notice in enumerate(NOTICES[family]) for frame in frames]
    return out + [(frame.format(text), len(FAMILIES), i % 3) for i, text in enumerate(COUNTER) for frame in frames]


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _regress(x: np.ndarray, y: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    w, b = np.zeros((x.shape[1], classes)), np.zeros(classes)
    target = np.eye(classes)[y]
    for _ in range(ROUNDS):
        err = _softmax(np.einsum("ij,jk->ik", x, w) + b) - target
        w -= 4 * (np.einsum("ij,ik->jk", x, err) / len(x) + DECAY * w)
        b -= 4 * err.mean(axis=0)
    return w, b


class Model:
    """n-gram weights by class, intercepts and the temperature."""

    def __init__(self, rows: list[tuple[str, int, int]]):
        grams = sorted({g for text, _, _ in rows for g in ngrams(tokens(text))})
        self.index = {g: i for i, g in enumerate(grams)}
        x = np.stack([self.vector(text) for text, _, _ in rows])
        y, fold = np.array([k for _, k, _ in rows]), np.array([f for _, _, f in rows])
        classes = len(FAMILIES) + 1
        w, b = _regress(x[fold < 2], y[fold < 2], classes)
        logits = np.einsum("ij,jk->ik", x[fold == 2], w) + b
        self.temperature = min((0.5, 0.7, 1.0, 1.5, 2.0, 3.0), key=lambda t: -np.log(_softmax(logits / t)[np.arange(len(logits)), y[fold == 2]] + 1e-12).mean())
        self.w, self.b = _regress(x, y, classes)

    def vector(self, text: str) -> np.ndarray:
        """Equal parts for the text's n-grams that the model has, of length 1."""
        out = np.zeros(len(self.index))
        known = [self.index[g] for g in ngrams(tokens(text)) if g in self.index]
        out[known] = 1 / math.sqrt(max(len(known), 1))
        return out

    def predict(self, text: str) -> tuple[int, float]:
        p = _softmax(((self.vector(text) @ self.w + self.b) / self.temperature)[None])[0]
        return int(p.argmax()), float(p.max())


_model: list[Model] = []


def model() -> Model:
    if not _model:
        _model.append(Model(wordings()))
    return _model[0]


#: A line feed inside a wrapped paragraph: after a line that ends no sentence, before one that isn't blank.
_WRAP = r"(?<=[^\s.!?:;])[ \t\r]*\n(?=[ \t]*\S)"


def paragraphs(text: Column) -> Column:
    """array of (kind, paragraph, n_lines, text): every line, and every wrapped paragraph of two lines or more, each by its place among its kind."""
    line = lambda x, i: F.struct(F.lit("line").alias("kind"), i.alias("paragraph"), F.lit(1).alias("n_lines"), x.alias("text"))
    wrapped = lambda x, i: F.struct(F.lit("wrapped").alias("kind"), i.alias("paragraph"), F.size(F.split(x, "\x01")).alias("n_lines"), F.translate(x, "\x01", " ").alias("text"))
    joined = F.regexp_replace(F.translate(text, "\x01", " "), _WRAP, "\x01")
    return F.concat(F.transform(F.split(text, "\n", -1), line), F.filter(F.transform(F.split(joined, "\n", -1), wrapped), lambda p: p["n_lines"] > 1))


def scan(docs: DataFrame, fitted: Model | None = None) -> DataFrame:
    """(doc_id, kind, paragraph, n_lines, text, family, probability, template_share) of every paragraph with a cue and a known n-gram."""
    m = fitted or model()
    spark = docs.sparkSession
    classes = [*FAMILIES, UNKNOWN]
    templates = defaultdict(list)
    for family in FAMILIES:
        for notice in NOTICES[family]:
            templates[family].append(ngrams(tokens(notice)))
    grams = spark.createDataFrame([(g, [float(v) for v in m.w[i]]) for g, i in m.index.items()], "gram string, w array<double>")
    shapes = spark.createDataFrame([(f, t) for f, ts in templates.items() for t in ts], "family string, template array<string>").groupBy("family").agg(F.collect_list("template").alias("templates"))
    cue = F.col("text").rlike(CUES)
    each = docs.where(cue).select("doc_id", F.explode(paragraphs(F.col("text"))).alias("p")).select("doc_id", "p.kind", "p.paragraph", "p.n_lines", "p.text").where(cue).withColumn("row", F.monotonically_increasing_id())
    words = F.regexp_extract_all(F.lower("text"), F.lit(TOKEN), F.lit(0))
    runs = lambda n: F.expr(f"if(size(words) >= {n}, transform(sequence(1, size(words) - {n - 1}), i -> array_join(slice(words, i, {n}), ' ')), array())")
    held = common.durable(each.withColumn("words", words).withColumn("grams", F.array_distinct(F.concat(*[runs(n) for n in (1, 2, 3)]))).drop("words"))
    hits = held.select("row", F.explode("grams").alias("gram")).join(F.broadcast(grams), "gram")  # the model's n-grams: a few thousand
    sums = hits.groupBy("row").agg(F.count("*").alias("n"), *[F.sum(F.col("w")[k]).alias(f"z{k}") for k in range(len(classes))])
    logits = F.array(*[(F.col(f"z{k}") / F.sqrt("n") + F.lit(float(m.b[k]))) / F.lit(m.temperature) for k in range(len(classes))])
    scored = sums.select("row", logits.alias("z")).withColumn("top", F.array_max("z"))
    scored = scored.withColumn("probability", F.expr("1 / aggregate(z, 0D, (a, x) -> a + exp(x - top))")).withColumn("guess", F.get(F.array(*[F.lit(c) for c in classes]), F.expr("cast(array_position(z, top) - 1 as int)")))
    out = held.join(scored.select("row", "probability", "guess"), "row").join(F.broadcast(shapes), F.col("guess") == F.col("family"), "left")
    share = F.coalesce(F.expr("array_max(transform(templates, t -> size(array_intersect(t, grams)) / size(t)))"), F.lit(0.0))
    sure = (F.col("probability") >= LEAST_PROBABILITY) & (share >= LEAST_TEMPLATE)
    return out.select("doc_id", "kind", F.col("paragraph").cast("bigint").alias("paragraph"), F.col("n_lines").cast("bigint").alias("n_lines"), "text", F.when(sure, F.col("guess")).otherwise(UNKNOWN).alias("family"), "probability", share.alias("template_share"))


def op3_licence_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.documents(spark, sf_dir)).withColumn("probability", F.round("probability", 6))
