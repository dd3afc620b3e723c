"""Licence families of paragraphs.

A multinomial logistic regression over binary word 1- and 2-grams (sparse weights) is trained on
templates of each family, varied by leaving words out and by words around them, against
paragraphs of the corpus and near misses, which are the unknown class.  A temperature, fitted on
rows left out of the training, calibrates its probabilities.  A prediction that is sure enough is
confirmed by comparing the paragraph with the family's templates.

Paragraphs are the lines of a text, and blocks of short lines that were wrapped by hand.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from trajmill import scratch
from trajmill.llm.arrow import map_rows

#: Templates: the names, notices and opening clauses of public licences.
TEMPLATES = {
    "MIT": (
        "Released under the MIT License.", "Licensed under the MIT license.", "This project is licensed under the terms of the MIT license.", "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "SPDX-License-Identifier: Apache-2.0", "Released under the Apache 2.0 license.", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License version 2.", "SPDX-License-Identifier: GPL-3.0-or-later", "Released under the GPL.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
    ),
    "LGPL": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.", "Licensed under the LGPL.", "SPDX-License-Identifier: LGPL-2.1-only",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
    ),
    "AGPL": (
        "This program is licensed under the GNU Affero General Public License, version 3.", "Licensed under the AGPL.", "SPDX-License-Identifier: AGPL-3.0-only",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
    ),
    "BSD": (
        "Use of this source code is governed by a BSD-style license.", "Licensed under the BSD 3-Clause License.", "Released under the BSD license.", "SPDX-License-Identifier: BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Released under the ISC License.", "SPDX-License-Identifier: ISC",
    ),
    "CC-BY": (
        "Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "Available under the Creative Commons Attribution licence.",
    ),
    "CC-BY-SA": (
        "Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Text is available under the Creative Commons Attribution-ShareAlike License.",
    ),
    "CC-BY-NC": (
        "Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Free for non-commercial use under CC BY-NC.",
    ),
    "public-domain": (
        "This is free and unencumbered software released into the public domain.", "Released under CC0 1.0 Universal.", "To the extent possible under law, the author has waived all copyright and related rights to this work.",
        "This work has been dedicated to the public domain.",
    ),
    "proprietary": (
        "All rights reserved.", "Copyright 2020 Example Inc. All rights reserved.", "No part of this publication may be reproduced or transmitted in any form without the prior written permission of the publisher.",
        "This document is proprietary and confidential; unauthorized copying is prohibited.",
    ),
}
UNKNOWN = "unknown"
#: Near misses that belong to the unknown class.
NEAR_MISSES = (
    "The driver showed a valid license to the officer.", "He released the record under a new label.", "The bill was licensed to a private company in 1998.", "Version 2.0 of the report was published in May.",
    "General public opinion was against the plan.", "Members reserved all seats on the train.", "The museum is open to the public.", "Permission to enter the site was granted yesterday.",
    "The work was distributed among the workers.", "The Apache helicopter landed near the base.", "A table was reserved under the name of Smith.", "The library lends books free of charge.",
    "Mozilla and other companies attended the meeting.", "Students at MIT built a robot.", "The foundation gave money for software courses.", "Creative writing is a common hobby.",
)
#: At most so many paragraphs of the corpus are read for the unknown class, those with the smallest hashes.
UNKNOWN_ROWS = 3000
#: Of a paragraph that is read for the unknown class, so many characters; scans read whole texts.
UNKNOWN_CHARS = 2000
VARIANTS = 12
VOCABULARY = 20_000
CONFIDENCE = 0.5
CONFIRMED = 0.6
WRAPPED = 100
_WORD = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")
_LINE = re.compile(r"[^\n]+")


def features(text: str) -> list[str]:
    """The different word 1- and 2-grams of a paragraph."""
    words = [w.lower() for w in _WORD.findall(text)]
    return list(dict.fromkeys([*words, *map(" ".join, zip(words, words[1:], strict=False))]))


def paragraphs(text: str) -> Iterator[tuple[int, int]]:
    """Start and end of the lines, and of blocks of at least two short lines, in code points."""
    block: list[tuple[int, int]] = []
    for line in _LINE.finditer(text):
        span = line.span()
        if not line[0].strip():
            continue
        yield span
        if block and (span[0] != block[-1][1] + 1 or span[1] - span[0] > WRAPPED):
            if len(block) > 1:
                yield block[0][0], block[-1][1]
            block = []
        if span[1] - span[0] <= WRAPPED:
            block.append(span)
    if len(block) > 1:
        yield block[0][0], block[-1][1]


def _variants() -> list[tuple[str, str]]:
    """The templates, and each with words left out and words of near misses around it."""
    random = np.random.default_rng(11)
    rows = [(family, text) for family, texts in TEMPLATES.items() for text in texts for _ in range(3)]
    for family, texts in TEMPLATES.items():
        for text in texts:
            words = text.split()
            for _ in range(VARIANTS):
                kept = [w for w in words if random.random() > 0.1] or words
                before, after = (NEAR_MISSES[random.integers(len(NEAR_MISSES))].split() for _ in range(2))
                rows.append((family, " ".join([*before[: random.integers(0, 5)], *kept, *after[: random.integers(0, 5)]])))
    return rows + [(UNKNOWN, text) for text in NEAR_MISSES for _ in range(VARIANTS)]


@dataclass(frozen=True)
class Classifier:
    """``weights`` of each n-gram that has any, the intercepts, and the temperature."""

    families: tuple[str, ...]
    weights: dict[str, np.ndarray]
    intercept: np.ndarray
    temperature: float

    def probabilities(self, grams: list[str]) -> np.ndarray:
        found = [w for w in map(self.weights.get, grams) if w is not None]
        logits = (self.intercept + (np.sum(found, axis=0) if found else 0.0)) / self.temperature
        shares = np.exp(logits - logits.max())
        return shares / shares.sum()


def similarity(family: str, grams: list[str]) -> float:
    """The largest share of a template's n-grams that the paragraph has."""
    have = set(grams)
    return max(len(have & t) / len(t) for t in _TEMPLATE_GRAMS[family])


_TEMPLATE_GRAMS = {family: [frozenset(features(t)) for t in texts] for family, texts in TEMPLATES.items()}


def train(corpus: DataFrame, text: str = "text") -> Classifier:
    """Fit on the templates and at most ``UNKNOWN_ROWS`` lines of ``corpus``; an empty corpus leaves the near misses.

    Corpus lines that name a licence are not taken for the unknown class.
    """
    spark: SparkSession = corpus.sparkSession
    lines = corpus.select(F.explode(F.split(text, "\n")).alias("line")).filter(~F.col("line").rlike(r"(?i)licen[cs]|rights reserved|copyright|public domain|\bCC[ -]?(BY|0)"))
    sample = lines.select(F.xxhash64("line").alias("h"), F.substring("line", 1, UNKNOWN_CHARS).alias("line")).orderBy("h").limit(UNKNOWN_ROWS)
    sample = scratch.materialize(sample, "licence-unknown")  # else every task would send its smallest rows to the driver
    unknown = [(UNKNOWN, r.line) for r in sample.collect()]  # bounded by UNKNOWN_ROWS
    families = (UNKNOWN, *TEMPLATES)
    rows = [(float(families.index(family)), features(t)) for family, t in [*_variants(), *unknown]]
    # Every fifth row is left out of the training and calibrates.
    labelled = spark.createDataFrame([(*r, i % 5 == 0) for i, r in enumerate(rows)], "label double, grams array<string>, left_out boolean")
    vocabulary = CountVectorizer(inputCol="grams", outputCol="features", binary=True, minDF=2.0, vocabSize=VOCABULARY).fit(labelled.filter("NOT left_out"))
    ready = scratch.materialize(vocabulary.transform(labelled.filter("NOT left_out")).select("label", "features"), "licence-training")
    fitted = LogisticRegression(family="multinomial", regParam=1e-3, elasticNetParam=0.5, maxIter=60, standardization=False).fit(ready)
    matrix, intercept = fitted.coefficientMatrix.toArray(), fitted.interceptVector.toArray()
    missing = len(families) - len(intercept)  # classes beyond the largest label seen
    matrix, intercept = np.pad(matrix, ((0, missing), (0, 0))), np.pad(intercept, (0, missing), constant_values=-20.0)
    used = np.flatnonzero(np.abs(matrix).sum(axis=0) > 0)
    weights = {vocabulary.vocabulary[i]: matrix[:, i].copy() for i in used}
    plain = Classifier(families, weights, intercept, 1.0)
    held = [(int(label), g) for i, (label, g) in enumerate(rows) if i % 5 == 0]
    return Classifier(families, weights, intercept, _temperature(plain, held))


def _temperature(plain: Classifier, held: list[tuple[int, list[str]]]) -> float:
    """The temperature under which rows left out are likeliest."""

    def loss(t: float) -> float:
        scaled = Classifier(plain.families, plain.weights, plain.intercept, t)
        return -sum(float(np.log(max(scaled.probabilities(g)[label], 1e-12))) for label, g in held)

    return min((0.4, 0.6, 0.8, 1.0, 1.25, 1.5, 2.0, 3.0), key=loss)


HIT = T.StructType(
    [
        T.StructField("start", T.LongType()),
        T.StructField("end", T.LongType()),
        T.StructField("family", T.StringType()),
        T.StructField("probability", T.DoubleType()),
        T.StructField("similarity", T.DoubleType()),
        T.StructField("confirmed", T.BooleanType()),
    ]
)


def scan_licenses(docs: DataFrame, classifier: Classifier, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, license, hits`` of every row.

    ``hits`` are the paragraphs of a known family, in text order; ``license`` is the family of the
    likeliest confirmed hit, or ``unknown``.  Null and empty texts have no hits.
    """
    sent = docs.sparkSession.sparkContext.broadcast(classifier)  # at most VOCABULARY n-grams
    schema = T.StructType(
        [T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("license", T.StringType()), T.StructField("hits", T.ArrayType(HIT))]
    )

    def start():
        model: Classifier = sent.value

        def scan(row: tuple) -> Iterator[tuple]:
            hits = []
            whole = row[1] or ""
            for first, end in sorted(paragraphs(whole)):
                grams = features(whole[first:end])
                shares = model.probabilities(grams)
                best = int(shares.argmax())
                if best and shares[best] >= CONFIDENCE:
                    family = model.families[best]
                    close = similarity(family, grams)
                    hits.append(dict(zip(HIT.names, (first, end, family, float(shares[best]), close, close >= CONFIRMED), strict=True)))
            sure = [h for h in hits if h["confirmed"]]
            yield row[0], max(sure, key=lambda h: h["probability"])["family"] if sure else UNKNOWN, hits

        return scan

    return map_rows(docs.select(F.col(doc_id), F.col(text)), start, schema)
