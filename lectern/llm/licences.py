"""Licence scan of whole texts, line by line and paragraph by paragraph, in DataFrame functions only.

1. Every line of every text is judged, each by itself and in its wrapped paragraph. A line goes on in the next one
   unless it ends a sentence or either has no words; of such a run, the lines from each one on that hold LONGEST
   more words (no template has more) are one unit, so that a notice is whole in one of them however it is
   wrapped. Parts of a unit (windows of WIDTHS words) are units too, so that a notice counts however long the line is
   that it stands in.
2. A softmax regression on sparse word 1- and 2-grams names the family or ``unknown``. Its vocabulary is that of the
   templates and everyday sentences; an n-gram weighs one by the root of the number of all n-grams of the unit, known or
   not, so that a word of a template makes no notice of a line of other words. It is trained from the
   templates (whole, by sentence and by parts) and, for ``unknown``, from everyday sentences
   and at most SAMPLE lines of the corpus (of the least hash) that hold an n-gram without
   which a first model names nothing, and that it calls unknown or that have hardly anything of any template.
3. Calibration: templates and unknown rows are dealt into FOLDS folds, whole templates with all their parts, and judged
   by models that have not seen their fold. From that come a temperature that minimises the log loss, and a
   threshold that at most FALSE_RATE of the unknown rows pass.
4. A prediction is confirmed by comparing the unit to the templates of its family: the share of a
   template's 2-grams that the unit has must reach CONFIRM. A line takes the result of the nearest confirmed
   unit that it is in (the one with the fewest lines where equally near, a whole line before its parts), but of several
   lines only where none of them is confirmed by itself; without one, its own. Parts count only if confirmed.

What cannot count is left out before n-grams are made, by two patterns and a bound that lose nothing. ``LicenceModel.needed``: from
the trained weights, a set of n-grams without any of which no text, whatever it says, reaches a family; a line
without them is unknown. ``distinctive``: of each template more 2-grams than the share that CONFIRM leaves open,
the longest ones; a text without any of them has no unit that step 4 confirms, and units of several lines
count only if confirmed. ``LicenceModel.possible``: a bound on what the known n-grams of a line can give any family; a
line under it is unknown. Weights and templates are tables of a fixed size, broadcast.

Result rows are the lines with a family other than ``unknown``.

Defined results: null and empty texts have no lines. A very long text is scanned whole. Paragraph numbers are those of lines, count from 0 and
include blank lines. Null and repeated ids are kept: rows of equal ids are told apart by the hash of their text only, equal
rows give equal results once each. Ties between families go to the smaller name. An empty table gives no
rows. Other columns are never read.
"""

from __future__ import annotations

import math
import re

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import materialise

SAMPLE, FALSE_RATE, CONFIRM, FOLDS = 500, 0.01, 0.6, 4
#: Places of the table of gains in which lines are looked up before they are judged.
PLACES = 4096
#: A line with less than this share of the 2-grams of any template is none of a licence, whatever the first model says.
STRANGE = 0.15
UNKNOWN = "unknown"

#: Notices of licence families as they are commonly written.
TEMPLATES = {
    "all-rights-reserved": (
        "All rights reserved.",
        "Copyright (c) 2020 by the author. All rights reserved.",
        "No part of this publication may be reproduced without the prior written permission of the publisher.",
        "No part of this book may be reproduced or transmitted in any form or by any means without permission in writing.",
        "Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential.",
    ),
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Released under the Apache License 2.0.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
        "This project is distributed under the terms of the Apache 2.0 license.",
    ),
    "bsd": (
        "Released under the BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Use of this source code is governed by a BSD-style license.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Distributed under the 2-clause BSD license.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    ),
    "cc": (
        "Licensed under CC BY 4.0.",
        "Licensed under CC BY-NC 4.0.",
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Released into the public domain under CC0 1.0.",
        "Text is available under the Creative Commons Attribution-ShareAlike License.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "Released under the GNU GPL, version 2 or later.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "You should have received a copy of the GNU General Public License along with this program.",
        "Distributed under the terms of the GNU Affero General Public License.",
    ),
    "mit": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "SPDX-License-Identifier: MIT",
        "This software may be modified and distributed under the terms of the MIT license.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Released under the Mozilla Public License 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
        "If a copy of the MPL was not distributed with this file, you can obtain one at http://mozilla.org/MPL/2.0/",
    ),
}
#: Everyday sentences that share words with notices and are none.
EVERYDAY = (
    "He showed the officer his driving license before he went on.",
    "The license fee for television was raised again this year.",
    "The museum was granted permission to build a new hall.",
    "She reserved a table for two under her own name.",
    "Human rights are a matter of public concern.",
    "The software was free of charge for schools.",
    "A copyright dispute between the two publishers went to court.",
    "The fishing license costs ten pounds and is valid for one season.",
    "All seats in the first row are reserved for members.",
    "Creative work needs time and permission to fail.",
    "The terms of the public offer were published on Monday.",
    "They released the new version of the program last week.",
    "The licensed guide led us through the old town.",
    "Without permission nobody may enter the building.",
    "You can find this file in the folder with the other documents.",
    "The notice was included in the list of all conditions.",
    "She obtained a copy of the letter from the office.",
    "The program is subject to change and the source is not known.",
    "This form of the word is used in the south.",
    "He was at the university and the institute of technology.",
    "The general came in person to see the work of the foundation.",
    "Any person may use the library, and there is no charge.",
    "Version two of the map is available at the town hall.",
    "The following week he was in London with a friend.",
)
_WORD = re.compile(r"[a-z0-9]+")
#: A line that ends a sentence.
_END = r"[.!?\u2026\u3002\uff01\uff1f][)\]\"'\u00bb\u201d\u2019]*\s*$"
LONGEST = max(len(_WORD.findall(t.lower())) for ts in TEMPLATES.values() for t in ts)
#: Words of a part; one begins at every half of that, so that a template is whole in one of at most four times its words or eight.
WIDTHS = [8 << k for k in range(((LONGEST - 2) // 4).bit_length() + 1)]


def grams(text: str) -> set[str]:
    words = _WORD.findall(text.lower())
    return set(words) | {f"{a} {b}" for a, b in zip(words, words[1:], strict=False)}


def gram_column(words: Column) -> Column:
    """The distinct word 1- and 2-grams of an array of words."""
    pairs = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(F.concat(words, F.when(F.size(words) > 1, pairs).otherwise(F.array().cast("array<string>"))))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1))


def pattern_of(some: list[str]) -> str:
    """A pattern for a lower-cased text that holds one of these n-grams, by first letters."""
    single = {g for g in some if " " not in g}
    by_letter: dict[str, list[str]] = {}
    for g in sorted(some):
        if g in single or not single & set(g.split()):
            by_letter.setdefault(g[0], []).append(g[1:].replace(" ", "[^a-z0-9]+"))
    return "(?<![a-z0-9])(?:" + "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in by_letter.items()) + ")(?![a-z0-9])"


def distinctive() -> list[str]:
    """Of each template its longest 2-grams, more than the share that a confirmed unit may lack."""
    out: set[str] = set()
    for *_, pairs in template_pairs():
        out.update(sorted(pairs, key=lambda g: (-len(g), g))[: math.floor((1 - CONFIRM) * len(pairs) + 1e-9) + 1])
    return sorted(out)


def template_pairs() -> list[tuple[str, str, set[str]]]:
    """Family, template and its 2-grams."""
    return [(f, t, {g for g in grams(t) if " " in g}) for f, ts in TEMPLATES.items() for t in ts]


def _rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text")).filter("text <> ''")


def lines(rows: DataFrame, gate: str) -> DataFrame:
    """doc_id, key, paragraph, words of every line with a match of the gate."""
    rows = rows.filter(F.lower("text").rlike(gate)).select("doc_id", "key", F.posexplode(F.split("text", "\n")).alias("paragraph", "line"))
    return rows.filter(F.lower("line").rlike(gate)).select("doc_id", "key", "paragraph", words_of(F.col("line")).alias("words"))


def parts(words: Column, places: Column, begin: Column) -> Column:
    """Parts of a unit that may be confirmed, starting in its first ``begin`` words: lines, part, words, covers."""
    gate = pattern_of(distinctive())

    def of(width: int) -> Column:
        at = F.sequence(F.lit(0), F.greatest(begin, F.lit(1)) - 1, F.lit(width // 2))
        at = F.filter(at, lambda k: F.concat_ws(" ", F.slice(words, k + 1, width)).rlike(gate))
        cut = F.transform(at, lambda k: _unit(F.slice(words, k + 1, width), F.array_distinct(F.slice(places, k + 1, width)), True))
        return F.when(F.size(words) > width, cut).otherwise(F.array().cast(UNITS))

    return F.concat(*map(of, WIDTHS))


UNITS = "array<struct<lines:int,part:boolean,words:array<string>,covers:array<int>>>"


def _unit(words: Column, covers: Column, part: bool) -> Column:
    return F.struct(F.size(covers).alias("lines"), F.lit(part).alias("part"), words.alias("words"), covers.alias("covers"))


def known_of(words: Column, vocabulary: list[str]) -> Column:
    """The distinct n-grams of an array of words that are in the vocabulary, which has the words of its 2-grams."""
    single = [g for g in vocabulary if " " not in g]
    count = F.greatest(F.size(words) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(words, 1, count), F.slice(words, 2, count), lambda a, b: F.when(a.isin(single) & b.isin(single), F.concat_ws(" ", a, b)))
    return F.array_distinct(F.concat(F.filter(words, lambda w: w.isin(single)), F.filter(pairs, lambda p: p.isin([g for g in vocabulary if " " in g]))))


def single(found: DataFrame, model: LicenceModel) -> DataFrame:
    """doc_id, key, paragraph, lines, part, words, covers of every line that the model may name, and of the parts of those
    that may have one confirmed."""
    found = found.withColumn("known", known_of(F.col("words"), sorted(model.vocabulary)))
    words, none = F.col("words"), F.array().cast(UNITS)
    near = (F.size(words) > WIDTHS[0]) & F.exists("known", lambda g: g.isin(distinctive()))
    some = F.when(near, parts(words, F.array_repeat("paragraph", F.size(words)), F.size(words))).otherwise(none)
    whole = F.when(model.possible(F.col("known"), words), F.array(_unit(words, F.array("paragraph"), False))).otherwise(none)
    return found.select("doc_id", "key", "paragraph", F.inline(F.concat(whole, some)))


def wrapped(rows: DataFrame) -> DataFrame:
    """As ``single``: every unit of several lines, and its parts in several lines, of the texts that can have a confirmed one."""
    texts = rows.filter(F.instr("text", "\n") > 0).filter(F.lower("text").rlike(pattern_of(distinctive()))).distinct()
    split = texts.select("doc_id", "key", F.posexplode(F.split("text", "\n")).alias("paragraph", "line"))
    split = split.select("doc_id", "key", "paragraph", words_of(F.col("line")).alias("words"), (~F.col("line").rlike(_END)).alias("on"))
    text = Window.partitionBy("doc_id", "key").orderBy("paragraph")
    begins = (F.size("words") == 0) | ~F.lag(F.col("on") & (F.size("words") > 0), 1, False).over(text)
    split = split.withColumn("begins", begins).withColumn("run", F.sum(F.col("begins").cast("int")).over(text.rowsBetween(Window.unboundedPreceding, 0)))
    split = split.withColumn("last", F.lead("begins", 1, True).over(text))
    # Every line of a run has a word, so that so many more lines are enough.
    ahead = Window.partitionBy("doc_id", "key", "run").orderBy("paragraph").rowsBetween(1, LONGEST)
    runs = split.filter("not (begins and last)").withColumn("next", F.collect_list(F.struct("paragraph", "words")).over(ahead)).filter("not last")
    start = F.struct(F.lit(0).alias("n"), F.array().cast("array<struct<paragraph:int,words:array<string>>>").alias("taken"))
    more = F.aggregate("next", start, lambda a, x: F.when(a["n"] >= LONGEST, a).otherwise(F.struct((a["n"] + F.size(x["words"])).alias("n"), F.concat(a["taken"], F.array(x)).alias("taken"))), lambda a: a["taken"])
    runs = runs.select("doc_id", "key", "paragraph", F.size("words").alias("begin"), F.concat(F.array(F.struct("paragraph", "words")), more).alias("unit"))
    runs = runs.select("doc_id", "key", "paragraph", "begin", F.flatten(F.transform("unit", lambda x: x["words"])).alias("words"), F.flatten(F.transform("unit", lambda x: F.array_repeat(x["paragraph"], F.size(x["words"])))).alias("places"), F.transform("unit", lambda x: x["paragraph"]).alias("covers"))
    some = F.filter(parts(F.col("words"), F.col("places"), F.col("begin")), lambda x: x["lines"] > 1)
    return runs.select("doc_id", "key", "paragraph", F.inline(F.concat(F.array(_unit(F.col("words"), F.col("covers"), False)), some)))


def _matrix(sets: list[set[str]], vocabulary: dict[str, int]) -> np.ndarray:
    x = np.zeros((len(sets), len(vocabulary)), np.float32)
    for k, s in enumerate(sets):
        at = [vocabulary[g] for g in s if g in vocabulary]
        x[k, at] = 1 / math.sqrt(max(1, len(s)))
    return x


def _fit(x: np.ndarray, y: np.ndarray, classes: int, steps: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Softmax regression by full-batch gradient steps with adapted rates; classes weigh alike."""
    weight = 1 / np.bincount(y, minlength=classes).clip(1)[y]
    weight = (weight / weight.sum()).astype(np.float32)
    target = np.eye(classes, dtype=np.float32)[y]
    w, b = np.zeros((x.shape[1], classes), np.float32), np.zeros(classes, np.float32)
    speed_w, speed_b = np.full_like(w, 1e-8), np.full_like(b, 1e-8)
    for _ in range(steps):
        e = (_softmax(x @ w + b) - target) * weight[:, None]
        dw, db = x.T @ e + 1e-4 * w, e.sum(axis=0)
        speed_w += dw**2
        speed_b += db**2
        w -= 0.5 * dw / np.sqrt(speed_w)
        b -= 0.5 * db / np.sqrt(speed_b)
    return w.astype(float), b.astype(float)


def _softmax(z):
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


class LicenceModel:
    """Weights of n-grams for each family and ``unknown``, temperature and threshold; ``held_out`` has what the models
    of the folds said of the rows that they had not seen: log loss, and shares right of notices and of others."""

    def __init__(self, background: list[set[str]]) -> None:
        self.families = sorted(TEMPLATES)
        self.classes = [*self.families, UNKNOWN]
        none = len(self.families)
        rows: list[tuple[set[str], int, int]] = []  # n-grams, class, fold
        for k, family in enumerate(self.families):
            for j, t in enumerate(TEMPLATES[family]):
                words = t.split()
                parts = {t, *re.split(r"(?<=[.:;])\s+", t), *(" ".join(words[a:b]) for a, b in ((0, len(words) * 3 // 4), (len(words) // 4, len(words))))}
                rows += [(grams(p), k, j % FOLDS) for p in sorted(parts) if grams(p)]
        rows += [(grams(t), none, j % FOLDS) for j, t in enumerate(EVERYDAY)]
        self.vocabulary = {g: i for i, g in enumerate(sorted(set().union(*(s for s, *_ in rows))))}
        # Background that has a template's 2-grams nearly whole may be a notice itself and teaches nothing.
        notices = [p for *_, p in template_pairs()]
        plain = [s for s in background if not any(n and len(n & s) >= 0.5 * len(n) for n in notices)]
        rows += [(s, none, j % FOLDS) for j, s in enumerate(plain)]
        x, y, fold = _matrix([s for s, *_ in rows], self.vocabulary), np.array([c for _, c, _ in rows]), np.array([f for *_, f in rows])
        z = np.zeros((len(rows), none + 1))
        for f in range(FOLDS):
            w, b = _fit(x[fold != f], y[fold != f], none + 1)
            z[fold == f] = x[fold == f] @ w + b
        # Classes weigh alike, as in training.
        weight = 1 / np.bincount(y, minlength=none + 1).clip(1)[y]
        loss, self.temperature = min((float(-(weight * np.log(_softmax(z / t)[np.arange(len(y)), y] + 1e-12)).sum() / weight.sum()), t) for t in (0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0))
        p = _softmax(z / self.temperature)
        passing = np.sort(1 - p[y == none, -1])
        self.threshold = float(max(0.5, passing[int((1 - FALSE_RATE) * (len(passing) - 1))]))
        named = np.where((1 - p[:, -1] >= self.threshold) & (p[:, :-1].max(axis=1) > p[:, -1]), p[:, :-1].argmax(axis=1), none)
        self.held_out = {"log_loss": loss, "notices": float((named == y)[y < none].mean()), "others": float((named == y)[y == none].mean())}
        self.weights, self.bias = _fit(x, y, none + 1)

    def needed(self) -> list[str]:
        """N-grams without any of which no set of n-grams is named: the fewest, by their best weight, for which the rest
        cannot bring any family over ``unknown``. With m known n-grams a family gains the sum of its weights over
        ``unknown`` by the root of m or more, at most the best such share of the largest weights that are left."""
        gain = self.weights[:, :-1] - self.weights[:, -1:]
        ahead = self.bias[:-1] - self.bias[-1]
        order = np.argsort(-gain.max(axis=1), kind="stable")
        root = np.sqrt(np.arange(1, len(order) + 1))

        def most(taken: int) -> float:
            rest = -np.sort(-gain[order[taken:]], axis=0)
            return float((ahead + np.maximum(0, (np.cumsum(rest, axis=0) / root[: len(rest), None]).max(axis=0, initial=0))).max())

        low, high = 0, len(order)
        while low < high:
            mid = (low + high) // 2
            low, high = (low, mid) if most(mid) < 0 else (mid + 1, high)
        name = sorted(self.vocabulary, key=self.vocabulary.__getitem__)
        return [name[i] for i in order[:low]]

    def possible(self, known: Column, words: Column) -> Column:
        """False only for words that ``predict`` calls unknown, whatever their order: what the known n-grams give each
        family over ``unknown``, by the root of the least number of n-grams that so many distinct words have, does not
        make up for the bias. The gains stand in a table at the hash of the n-gram, of equal places the best."""
        gain = self.weights[:, :-1] - self.weights[:, -1:]
        n = gain.shape[1]
        places: dict[int, np.ndarray] = {}
        for g, i in self.vocabulary.items():
            at = xxhash.xxh64_intdigest(g.encode(), seed=42) % PLACES
            places[at] = np.maximum(places[at], gain[i]) if at in places else gain[i]
        flat = np.zeros((PLACES, n))
        flat[list(places)] = list(places.values())
        table = F.split(F.lit(",".join(map(repr, flat.ravel().tolist()))), ",").cast("array<double>")
        zero = F.split(F.lit(",".join(["0"] * n)), ",").cast("array<double>")
        at = F.transform(known, lambda g: (F.pmod(F.xxhash64(g), F.lit(PLACES)) * n + 1).cast("int"))
        gains = F.aggregate(at, zero, lambda a, k: F.zip_with(a, F.slice(table, k, F.lit(n)), lambda x, y: x + y))
        ahead = F.split(F.lit(",".join(map(repr, (self.bias[:-1] - self.bias[-1]).tolist()))), ",").cast("array<double>")
        root = F.sqrt(F.greatest(2 * F.size(F.array_distinct(words)) - 1, F.lit(1)))
        return F.exists(F.zip_with(gains, ahead, lambda x, y: y * root + F.greatest(x, F.lit(0.0))), lambda x: x > -1e-6)

    def predict(self, s: set[str]) -> tuple[str, float]:
        """Family (or unknown) and probability, as the DataFrame form has them."""
        z = (_matrix([s], self.vocabulary).astype(float) @ self.weights + self.bias) / self.temperature
        p = _softmax(z)[0]
        k = int(p[:-1].argmax())
        return (self.families[k], float(p[k])) if 1 - p[-1] >= self.threshold and p[k] > p[-1] else (UNKNOWN, float(p[-1]))


def train(rows: DataFrame, sample: int = SAMPLE) -> LicenceModel:
    """The model, with at most ``sample`` lines of the corpus (rows with a column text) as background."""
    first = LicenceModel([])
    found = lines(rows, pattern_of(first.needed()))
    chosen = found.select(F.xxhash64("words").alias("order"), "words").orderBy("order", "words").limit(sample)
    near = sorted({frozenset(grams(" ".join(r["words"]))) for r in chosen.collect()}, key=sorted)
    pairs = [p for *_, p in template_pairs() if p]
    # Where it names one, it may be right, unless the line has hardly anything of any template.
    return LicenceModel([s for s in near if first.predict(set(s))[0] == UNKNOWN or max(len(p & s) / len(p) for p in pairs) < STRANGE])


def scan(docs: DataFrame, model: LicenceModel | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, paragraph, family, probability, template, similarity, confirmed for each line that is not unknown."""
    texts = _rows(docs, id_col, text_col)
    model = model or train(texts)
    rows = single(lines(texts, pattern_of(model.needed())), model).unionByName(wrapped(texts)).withColumn("unit", F.monotonically_increasing_id())
    rows = materialise(rows, "units")  # read twice; repeated rows are units of their own
    spark = docs.sparkSession
    names = [f"z{k}" for k in range(len(model.classes))]
    weights = spark.createDataFrame([(g, *map(float, model.weights[i])) for g, i in model.vocabulary.items()], "gram string, " + ", ".join(f"{n} double" for n in names))
    each = rows.select("unit", gram_column(F.col("words")).alias("grams")).select("unit", F.size("grams").alias("m"), F.explode("grams").alias("gram"))
    # The vocabulary is fixed by the templates (about a thousand rows): proven small.
    known = each.join(F.broadcast(weights), "gram")
    summed = known.groupBy("unit", "m").agg(*(F.coalesce(F.sum(n), F.lit(0.0)).alias(n) for n in names))
    z = [(F.lit(float(b)) + F.col(n) / F.sqrt(F.greatest("m", F.lit(1)))) / F.lit(model.temperature) for n, b in zip(names, model.bias, strict=True)]
    top = F.greatest(*z)
    summed = summed.withColumn("e", F.array(*[F.exp(x - top) for x in z]))
    total = F.aggregate("e", F.lit(0.0), lambda a, x: a + x)
    summed = summed.withColumn("p", F.transform("e", lambda x: x / total))
    n = len(model.families)
    best = F.array_max(F.slice("p", 1, n))
    family = F.element_at(F.array(*map(F.lit, model.families)), F.array_position(F.slice("p", 1, n), best).cast("int"))
    sure = (1 - F.col("p")[n] >= model.threshold) & (best > F.col("p")[n])
    named = summed.filter(sure).select("unit", family.alias("family"), best.alias("probability")).join(rows, "unit")
    pairs = [(f, t, len(s), g) for f, t, s in template_pairs() for g in sorted(s)]
    templates = spark.createDataFrame(pairs, "family string, template string, size int, gram string")
    shared = named.select("unit", "family", F.explode(gram_column(F.col("words"))).alias("gram")).join(F.broadcast(templates), ["family", "gram"]).groupBy("unit", "template", "size").agg(F.count(F.lit(1)).alias("n"))
    share = (F.col("n") / F.col("size")).alias("similarity")
    nearest = shared.select("unit", "template", share).groupBy("unit").agg(F.max(F.struct("similarity", "template")).alias("t"))
    out = named.alias("a").join(nearest.alias("b"), "unit", "left")
    similarity = F.coalesce(F.col("b.t.similarity"), F.lit(0.0))
    confirmed = similarity >= CONFIRM
    judged = out.select("a.doc_id", "a.key", F.col("a.paragraph").alias("start"), "a.lines", "a.part", "a.covers", "a.family", "a.probability", F.col("b.t.template").alias("template"), similarity.alias("similarity"), confirmed.alias("confirmed"))
    judged = judged.filter("lines = 1 and not part or confirmed").withColumn("paragraph", F.explode("covers"))
    alone = F.max(F.col("confirmed") & (F.col("lines") == 1)).over(Window.partitionBy("doc_id", "key", "paragraph"))
    judged = judged.withColumn("alone", alone).withColumn("taken", F.max("alone").over(Window.partitionBy("doc_id", "key", "covers"))).filter("lines = 1 or not taken")
    order = F.struct("confirmed", "similarity", -F.col("lines"), ~F.col("part"), "start", "probability", "family")
    best = judged.groupBy("doc_id", "key", "paragraph").agg(F.max_by(F.struct("family", "probability", "template", "similarity", "confirmed"), order).alias("best"))
    return best.select("doc_id", "paragraph", "best.*")


def op3_licences(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
