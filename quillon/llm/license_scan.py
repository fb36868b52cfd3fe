"""Licence scans by a trained paragraph classifier (DataFrame functions only).

Texts are cut into blocks at blank lines. Windows of up to WINDOW words are laid over each line of a
block, overlapping in long ones, so that a notice is found wherever it stands in a line and however
long that is; and over each line together with those that follow it, so that a wrapped notice is read
as a whole. Windows over several lines count only if they are confirmed. The features of a window are sparse word n-grams (words and pairs of
neighbours) out of a vocabulary of licence wordings: words that few documents of the corpus have (counted
over all of it) and the pairs that hold such a word. Other words are no features, so prose around a
notice does not weaken it.

A multinomial logistic regression over the families, "unknown" (wordings of other licences) and "none"
(licence words in ordinary sentences) is fitted on TEMPLATES, their parts and these wordings. It is
calibrated on what was left out: every third document of a family sets the temperature, and each third
of the families in turn is left out of the fit to see how likely a foreign licence is taken for a known
one. The least probability of a family is the one at which MOST_FOREIGN of the left-out families' wordings
would be confirmed as another family. What looks like a licence but stays below it is "unknown".

A predicted family is confirmed by comparison with its templates: enough n-grams in common, one of them
found in no other family.

Windows without a word of the vocabulary are "none" whatever the weights, so only the others are
scored: their n-grams are exploded, joined to the weight table (vocabulary times classes, a size that
the templates bound) and summed by window. A line counts once, by its most licence-like window.

Edge cases: null and empty texts have no lines and no licence. Long texts and long lines are read whole.
Rows repeated with one doc_id are scanned once and reported as often as they occur, the findings of
different texts under one id together. A null doc_id is an id like others. Ties between families go to
the name that sorts first. An empty table gives an empty result. Other columns are never looked at.
"""

from __future__ import annotations

import math
import re
from itertools import pairwise

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.session import materialize

#: Words in a window, and words from one window's start to the next one's.
WINDOW, STEP = 48, 24
#: A template word that a larger share of documents has is no feature by itself; so many documents without it are added to the corpus.
ORDINARY_SHARE, PRIOR_DOCS = 0.02, 1000
#: Share of a window's n-grams that a template must have, and of the template's that the window must have.
CONFIRM_SHARE, TEMPLATE_SHARE = 0.5, 0.25
#: Share of foreign licences that may be confirmed as a known one.
MOST_FOREIGN = 0.1
#: A window at least this likely to be ordinary text is not reported, not even as unknown.
MOST_ORDINARY = 0.2

NONE, UNKNOWN = "none", "unknown"
# Words that are ordinary in any corpus.
STOPWORDS = "a an and any are as at be but by for from if in is it its not of on or that the their this to was were which with you your".split()

# Wordings of well-known licences by family, a list of paragraphs for each kind of document.
TEMPLATES: dict[str, list[list[str]]] = {
    "agpl": [
        ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
        ["GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"],
        ["You should have received a copy of the GNU Affero General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."],
        ["SPDX-License-Identifier: AGPL-3.0-only", "Licensed under the GNU AGPLv3.", "Released under the AGPL-3.0 license."],
    ],
    "apache-2.0": [
        ["Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"],
        ["Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.", "See the License for the specific language governing permissions and limitations under the License."],
        ["Apache License Version 2.0, January 2004", "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form."],
        ["Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0", "Released under the Apache 2.0 license."],
    ],
    "bsd": [
        ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
        ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."],
        ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
        ["THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."],
        ["Released under the BSD 3-Clause License.", "This software is licensed under the BSD license.", "SPDX-License-Identifier: BSD-3-Clause", "BSD 2-Clause License"],
    ],
    "cc-by": [
        ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "This work is licensed under the Creative Commons Attribution 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/"],
        ["Licensed under CC BY 4.0.", "Content is available under the Creative Commons Attribution License.", "SPDX-License-Identifier: CC-BY-4.0"],
        ["This is an open access article distributed under the terms of the Creative Commons Attribution License, which permits unrestricted use, distribution, and reproduction in any medium, provided the original work is properly cited."],
    ],
    "cc-by-nc": [
        ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by-nc/4.0/"],
        ["Licensed under CC BY-NC 4.0.", "Content is available under CC BY-NC for noncommercial use only.", "SPDX-License-Identifier: CC-BY-NC-4.0"],
        ["This article is distributed under the terms of the Creative Commons Attribution-NonCommercial License, which permits non-commercial use, reproduction and distribution of the work without further permission."],
    ],
    "cc-by-sa": [
        ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by-sa/4.0/"],
        ["Licensed under CC BY-SA 4.0.", "Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply.", "SPDX-License-Identifier: CC-BY-SA-4.0"],
        ["If you remix, transform, or build upon the material, you must distribute your contributions under the same ShareAlike license as the original."],
    ],
    "epl-2.0": [
        ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"],
        ["Eclipse Public License - v 2.0", "THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE (\"AGREEMENT\"). ANY USE, REPRODUCTION OR DISTRIBUTION OF THE PROGRAM CONSTITUTES RECIPIENT'S ACCEPTANCE OF THIS AGREEMENT."],
        ["SPDX-License-Identifier: EPL-2.0", "Licensed under the Eclipse Public License, version 2.0."],
    ],
    "gpl": [
        ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
        ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."],
        ["You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
        ["This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-only", "SPDX-License-Identifier: GPL-2.0-or-later", "Released under the GPL v2."],
    ],
    "isc": [
        ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
        ["THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."],
        ["SPDX-License-Identifier: ISC", "Released under the ISC License.", "ISC License"],
    ],
    "lgpl": [
        ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."],
        ["You should have received a copy of the GNU Lesser General Public License along with this library.", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
        ["Licensed under the GNU Lesser General Public License, version 2.1.", "SPDX-License-Identifier: LGPL-2.1-only", "Released under the LGPL v3."],
    ],
    "mit": [
        ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"],
        ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
        ["THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.", "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."],
        ["Released under the MIT License.", "This project is licensed under the terms of the MIT license.", "SPDX-License-Identifier: MIT", "MIT License"],
    ],
    "mpl-2.0": [
        ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
        ["Mozilla Public License Version 2.0", "This Source Code Form is \"Incompatible With Secondary Licenses\", as defined by the Mozilla Public License, v. 2.0."],
        ["Released under the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0", "Licensed under the MPL 2.0."],
    ],
    "proprietary": [
        ["All rights reserved.", "Copyright (c) 2020 The Authors. All rights reserved.", "(c) Example Corporation, all rights reserved worldwide."],
        ["No part of this publication may be reproduced, stored in a retrieval system, or transmitted, in any form or by any means, without the prior written permission of the publisher.", "No part of this publication may be reproduced or distributed without prior written permission."],
        ["Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential.", "This document contains proprietary and confidential information."],
    ],
    "public-domain": [
        ["This work has been released into the public domain.", "The author has dedicated the work to the public domain by waiving all rights to the work worldwide."],
        ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "CC0 1.0 Universal Public Domain Dedication"],
        ["This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense", "SPDX-License-Identifier: CC0-1.0", "Released under CC0."],
    ],
}
# Notices of other licences, and licence words in ordinary sentences.
OTHERS: dict[str, list[str]] = {
    UNKNOWN: [
        "Licensed under the terms of the Example Vendor License Agreement.", "Released under the Foo Community License, version 7.",
        "The use of this material is governed by a separate licence agreement.", "This work is licensed under terms that are stated elsewhere.",
        "SPDX-License-Identifier: LicenseRef-Custom", "Copyright notice: see the licence file.", "Distributed under the Acme Open License 1.1.",
        "This font is released under its own licence.", "Covered by the Sample Public License.", "Use is subject to the licence terms of the vendor.",
        "The data are published under the Open Data Licence of the city.", "You may use this software under the terms of the License Agreement of its maker.",
    ],
    NONE: [
        "He got his driving license in May.", "The license of the pub was renewed by the council.", "They asked for permission to enter the garden.",
        "The warranty of the car covers two years.", "Civil rights were discussed at length.", "The source of the river lies in the hills.",
        "Public transport in the city is free of charge.", "A copy of the letter was sent to the author.", "The software runs on most machines.",
        "The conditions for growth are met in spring.", "All persons present agreed to the terms of the truce.", "The general spoke in public for an hour.",
        "Members of the commons voted on the law.", "The library is open to the public.", "The work was done under contract.", "An apache helicopter landed.",
        "The foundation gave the building its form.", "Version two of the story is longer.", "Distribution of food began at noon.", "The liability of the firm is limited by law.",
    ],
}


def words(text: str) -> list[str]:
    """Lower-case words and numbers."""
    return re.findall(r"[a-z0-9]+", text.lower())


def ngrams(tokens: list[str]) -> list[str]:
    """Distinct words and pairs of neighbours."""
    return list(dict.fromkeys([*tokens, *(f"{a} {b}" for a, b in pairwise(tokens))]))


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def _ngrams(tokens: Column) -> Column:
    pairs = F.zip_with(
        F.slice(tokens, F.lit(1), F.greatest(F.size(tokens) - 1, F.lit(0))),
        F.slice(tokens, F.lit(2), F.greatest(F.size(tokens) - 1, F.lit(0))),
        lambda a, b: F.concat(a, F.lit(" "), b),
    )
    return F.array_distinct(F.concat(tokens, pairs))


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _overlapping(parts: Column) -> Column:
    """Each part with the next one; a last part stands alone only if it is the only one."""
    pairs = F.zip_with(parts, F.slice(parts, F.lit(2), F.size(parts)), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    return F.slice(pairs, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1)))


def _windows(line: Column) -> Column:
    """Overlapping windows of a line, as texts; a line that is hardly longer than one is a window as a whole."""
    steps = _all(F.lower(line), f"(?:[a-z0-9]++[^a-z0-9]*+){{1,{STEP}}}")
    return F.when(F.size(_tokens(line)) <= WINDOW + STEP, F.array(line)).otherwise(_overlapping(steps))


def _wrapped(sizes: Column) -> Column:
    """How many of some lines, of these numbers of words, are needed for a window."""

    def one_more(seen: Column, size: Column) -> Column:
        full = seen["words"] >= WINDOW
        return F.struct((seen["words"] + F.when(full, 0).otherwise(size)).alias("words"), (seen["n"] + F.when(full, 0).otherwise(1)).alias("n"))

    return F.aggregate(sizes, F.struct(F.lit(0).alias("words"), F.lit(0).alias("n")), one_more, lambda seen: seen["n"])


def windows(docs: DataFrame, cues: Column) -> DataFrame:
    """doc_id, block (digest), lo and hi (lines), line (digest of these), single (on one line) and tokens of all windows with a cue.

    Long blocks and lines are cut by one pass of a pattern each, so the time grows with their length.
    """
    cut = F.array_distinct(F.split(F.coalesce("text", F.lit("")), r"\n\s*\n"))
    blocks = docs.select("doc_id", F.explode(cut).alias("text")).select("doc_id", F.md5("text").alias("block"), F.trim(F.col("text"), F.lit("\n")).alias("text"))
    # WINDOW lines at a time, each time with the WINDOW lines after them.
    groups = _all(F.col("text"), f"(?:[^\\n]++\\n?+){{1,{WINDOW}}}")
    pairs = F.zip_with(groups, F.slice(groups, F.lit(2), F.size(groups)), lambda a, b: F.struct(a.alias("own"), F.coalesce(b, F.lit("")).alias("next")))
    some = blocks.select("doc_id", "block", F.posexplode(pairs).alias("group", "lines")).filter(F.arrays_overlap(_tokens(F.col("lines.own")), cues))
    text = lambda c: F.split(F.trim(c, F.lit("\n")), "\n")
    both = some.select("doc_id", "block", "group", text(F.col("lines.own")).alias("own"), F.concat(text(F.col("lines.own")), F.filter(text(F.col("lines.next")), lambda x: x != "")).alias("lines"))
    heads = F.transform("lines", lambda x: F.regexp_extract(F.lower(x), f"^[^a-z0-9]*+((?:[a-z0-9]++[^a-z0-9]*+){{0,{WINDOW}}}+)", 1))
    both = both.select("doc_id", "block", "group", "own", heads.alias("heads"), F.transform("lines", F.md5).alias("digests"))
    each = F.transform("own", lambda x, i: F.struct(
        i.alias("i"), x.alias("text"), F.slice("heads", i + 1, F.lit(WINDOW)).alias("heads"), F.slice("digests", i + 1, F.lit(WINDOW)).alias("digests")
    ))
    begun = both.select("doc_id", "block", "group", F.explode(each).alias("s")).select("doc_id", "block", (F.col("group") * WINDOW + F.col("s.i")).alias("lo"), "s.text", "s.heads", "s.digests")
    begun = begun.filter(F.arrays_overlap(_tokens(F.col("text")), cues))
    begun = begun.withColumn("n", _wrapped(F.transform("heads", lambda h: F.size(_tokens(h)))))
    made = lambda text, n, single: F.struct(text.alias("text"), n.alias("n"), F.lit(single).alias("single"))
    alone = F.transform(_windows(F.col("text")), lambda w: made(w, F.lit(1), True))
    joined = F.array_join(F.slice("heads", F.lit(1), F.col("n")), " ")
    every = F.when(F.col("n") > 1, F.concat(alone, F.array(made(joined, F.col("n"), False)))).otherwise(alone)
    laid = begun.select("doc_id", "block", "lo", "digests", F.explode(every).alias("w"))
    words_of = F.when(F.col("w.single"), _tokens(F.col("w.text"))).otherwise(F.slice(_tokens(F.col("w.text")), 1, WINDOW))
    laid = laid.select("doc_id", "block", "lo", "digests", "w.n", "w.single", words_of.alias("tokens")).filter(F.arrays_overlap("tokens", cues))
    line = F.md5(F.array_join(F.slice("digests", F.lit(1), F.col("n")), ""))
    return laid.select("doc_id", "block", "lo", (F.col("lo") + F.col("n") - 1).alias("hi"), line.alias("line"), "single", "tokens")


class Model:
    """Weights (n-grams by classes), intercepts, temperature and the least probability of a family."""

    def __init__(self, vocabulary, classes, weights, intercepts, temperature, least):
        self.vocabulary, self.classes = vocabulary, classes
        self.weights, self.intercepts = weights, intercepts
        self.temperature, self.least = temperature, least

    @property
    def cues(self) -> list[str]:
        """The single words of the vocabulary: every pair in it holds one of them."""
        return [g for g in self.vocabulary if " " not in g]

    def probabilities(self, texts: list[str]) -> np.ndarray:
        return _softmax((_matrix([words(t) for t in texts], self.vocabulary) @ self.weights + self.intercepts) / self.temperature)


def _parts(text: str) -> list[list[str]]:
    """The words of a wording, and its halves if it is long."""
    tokens = words(text)
    half = len(tokens) // 2
    return [tokens, tokens[:half], tokens[half:]] if len(tokens) >= 16 else [tokens]


def _matrix(rows: list[list[str]], vocabulary: list[str]) -> np.ndarray:
    """Indicators of n-grams, of unit length."""
    at = {g: i for i, g in enumerate(vocabulary)}
    x = np.zeros((len(rows), len(vocabulary)))
    for i, tokens in enumerate(rows):
        x[i, [at[g] for g in ngrams(tokens) if g in at]] = 1.0
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1.0)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _descend(x: np.ndarray, y: np.ndarray, k: int, steps: int = 120) -> tuple[np.ndarray, np.ndarray]:
    """Multinomial logistic regression by gradient steps; a soft threshold keeps the weights sparse."""
    w, b = np.zeros((x.shape[1], k)), np.zeros(k)
    goal = np.eye(k)[y]
    seen = np.maximum(goal.sum(0), 1)
    balance = (len(y) / (len(np.unique(y)) * seen))[y][:, None]
    rate, shrink = 8.0, 2e-5
    for _ in range(steps):
        error = (_softmax(x @ w + b) - goal) * balance / len(y)
        w = w - rate * (x.T @ error + 1e-4 * w)
        w = np.sign(w) * np.maximum(np.abs(w) - rate * shrink, 0.0)
        b = b - rate * error.sum(0)
    b[goal.sum(0) == 0] = -1e3  # a class that was left out is never predicted
    return w, b


def ordinary_words(docs: DataFrame) -> set[str]:
    """STOPWORDS and template words that more than ORDINARY_SHARE of the documents have, counted over all of them."""
    own = sorted({w for ts in TEMPLATES.values() for d in ts for t in d for w in words(t)} | {w for ts in OTHERS.values() for t in ts for w in words(t)})
    found = F.array_intersect(_tokens(F.coalesce("text", F.lit(""))), F.array(*[F.lit(w) for w in own]))
    # At most one row for each word of the templates, whatever the size of the corpus.
    counted = docs.select(F.explode(found).alias("word")).groupBy("word").count().collect()
    total = docs.count()
    return {*STOPWORDS, *(r["word"] for r in counted if r["count"] > ORDINARY_SHARE * (total + PRIOR_DOCS))}


def train(ordinary: set[str], left_out: tuple[str, ...] = ()) -> Model:
    """A calibrated model of the families but those left out, with a vocabulary without ordinary words by themselves."""
    families = [f for f in sorted(TEMPLATES) if f not in left_out]
    classes = sorted([*families, UNKNOWN, NONE])
    rows, labels, held = [], [], []
    for family in families:
        for i, document in enumerate(TEMPLATES[family]):
            for text in document:
                for part in _parts(text):
                    rows.append(part)
                    labels.append(family)
                    held.append(i % 3 == 2)
    for name, texts in OTHERS.items():
        for i, text in enumerate(texts):
            rows.append(words(text))
            labels.append(name)
            held.append(i % 3 == 2)
    own = dict.fromkeys(g for t in rows for g in ngrams(t))
    vocabulary = [g for g in own if any(w not in ordinary for w in g.split(" "))]
    x, y, held = _matrix(rows, vocabulary), np.array([classes.index(f) for f in labels]), np.array(held)
    k = len(classes)
    w, b = _descend(x[~held], y[~held], k)
    z = x[held] @ w + b
    losses = {t: -np.log(_softmax(z / t)[np.arange(held.sum()), y[held]] + 1e-12).mean() for t in (0.1, 0.15, 0.25, 0.35, 0.5, 0.75, 1.0, 1.5)}
    temperature = min(losses, key=losses.get)
    inner = np.array([c not in (UNKNOWN, NONE) for c in classes])
    # Families left out of the fit in turn: how sure is the model of a wrong one that also looks like its templates?
    wrong, n_foreign = [], 0
    for turn in range(3):
        gone = [i for j, i in enumerate(np.flatnonzero(inner)) if j % 3 == turn]
        out = np.isin(y, gone)
        wt, bt = _descend(x[~out & ~held], y[~out & ~held], k)
        p = _softmax((x[out] @ wt + bt) / temperature)
        rest = _templates(vocabulary, [c for i, c in enumerate(classes) if inner[i] and i not in gone])
        best = [classes[i] for i in p.argmax(1)]
        grams = [set(vocabulary) & set(ngrams(rows[i])) for i in np.flatnonzero(out)]
        wrong += [v for v, f, g in zip(p.max(1), best, grams, strict=True) if any(_alike(g, t, own) for c, t, own in rest if c == f)]
        n_foreign += int(out.sum())
    steps = np.arange(0.2, 0.9, 0.02)
    least = next((t for t in steps if sum(v >= t for v in wrong) <= MOST_FOREIGN * n_foreign), 0.9)
    w, b = _descend(x, y, k)
    return Model(vocabulary, classes, w, b, temperature, float(least))


def fit(docs: DataFrame) -> Model:
    """A model for a corpus."""
    return train(ordinary_words(docs))


def _alike(grams: set[str], template: list[str], own: list[str]) -> bool:
    """Whether a window's n-grams confirm a template; scan_paragraphs() says the same in expressions."""
    common = len(grams.intersection(template))
    return common >= CONFIRM_SHARE * len(grams) and common >= TEMPLATE_SHARE * len(template) and not grams.isdisjoint(own)


def _templates(vocabulary: list[str], families: list[str]) -> list[tuple[str, list[str], list[str]]]:
    """Family, n-grams of a wording that are in the vocabulary, and those of them that no other family has."""
    known = set(vocabulary)
    grams = [(f, [g for g in ngrams(words(t)) if g in known]) for f in families for d in TEMPLATES[f] for t in d]
    owners: dict[str, set[str]] = {}
    for f, gs in grams:
        for g in gs:
            owners.setdefault(g, set()).add(f)
    for text in (t for ts in OTHERS.values() for t in ts):
        for g in ngrams(words(text)):
            owners.setdefault(g, set()).add(UNKNOWN)
    return [(f, gs, [g for g in gs if owners[g] == {f}]) for f, gs in grams]


def scan_paragraphs(docs: DataFrame, model: Model) -> DataFrame:
    """Findings: doc_id, block, lo and hi (lines of the block), line (digest of these), family, probability, similarity and confirmed."""
    spark = docs.sparkSession
    cues = F.array(*[F.lit(c) for c in model.cues])
    vocabulary = F.array(*[F.lit(g) for g in model.vocabulary])
    found = windows(docs, cues).withColumn("grams", F.array_intersect(_ngrams(F.col("tokens")), vocabulary)).drop("tokens")
    found = materialize(found.withColumn("window", F.md5(F.array_join(F.array_sort("grams"), "\n"))), "licence-windows")
    cut = materialize(found.groupBy("window").agg(F.first("grams").alias("grams")), "licence-grams")
    weights = spark.createDataFrame(
        [(g, [float(v) for v in row]) for g, row in zip(model.vocabulary, model.weights, strict=True)], "gram string, w array<double>"
    )
    k = len(model.classes)
    hits = cut.select("window", F.size("grams").alias("n"), F.explode("grams").alias("gram")).join(F.broadcast(weights), "gram")
    sums = hits.groupBy("window").agg(F.first("n").alias("n"), *[F.sum(F.col("w")[i]).alias(f"s{i}") for i in range(k)])
    logits = F.array(*[(F.col(f"s{i}") / F.sqrt("n") + float(model.intercepts[i])) / model.temperature for i in range(k)])
    e = F.transform(F.col("z"), lambda v: F.exp(v - F.array_max(F.col("z"))))
    p = F.transform(F.col("e"), lambda v: v / F.aggregate(F.col("e"), F.lit(0.0), lambda a, c: a + c))
    names = F.array(*[F.lit(c) for c in model.classes])
    scored = sums.withColumn("z", logits).withColumn("e", e).withColumn("p", p).select(
        "window",
        names[F.array_position("p", F.array_max("p")).cast("int") - 1].alias("best"),
        F.array_max("p").alias("probability"),
        F.col("p")[model.classes.index(NONE)].alias("ordinary"),
    ).filter((F.col("best") != NONE) & (F.col("ordinary") < MOST_ORDINARY))
    templates = spark.createDataFrame(_templates(model.vocabulary, [c for c in model.classes if c in TEMPLATES]), "best string, template array<string>, own array<string>")
    both = scored.join(cut, "window").join(F.broadcast(templates), "best", "left")
    common = F.size(F.array_intersect("grams", "template"))
    alike = (common / F.size("grams") >= CONFIRM_SHARE) & (common / F.size("template") >= TEMPLATE_SHARE) & F.arrays_overlap("grams", "own")
    compared = both.groupBy("window", "best", "probability").agg(
        F.max(F.coalesce(common / F.greatest(F.size("grams"), F.size("template")), F.lit(0.0))).alias("similarity"),
        F.coalesce(F.max(alike), F.lit(False)).alias("alike"),
    )
    sure = (F.col("probability") >= model.least) & F.col("alike")
    named = compared.select(
        "window", F.when(sure, F.col("best")).otherwise(UNKNOWN).alias("family"), "probability", "similarity", sure.alias("confirmed")
    )
    met = found.drop("grams").join(materialize(named, "licence-families").hint("merge"), "window").filter("confirmed or single").drop("window")
    # Windows that share a line belong together.
    order = Window.partitionBy("doc_id", "block").orderBy("lo", "hi")
    apart = F.coalesce(F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1)) < F.col("lo"), F.lit(True))
    met = met.withColumn("apart", apart).withColumn("island", F.sum(F.col("apart").cast("int")).over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    met = met.withColumn("some", F.max("confirmed").over(Window.partitionBy("doc_id", "block", "island"))).filter("confirmed or not some")
    best = F.struct(-F.col("probability"), F.col("hi") - F.col("lo"), F.col("lo"))
    kept = met.groupBy("doc_id", "block", "island", "family").agg(F.min_by(F.struct("lo", "hi", "line", "probability", "similarity", "confirmed"), best).alias("f"))
    return kept.select("doc_id", "block", "family", "f.*")


def scan(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """A row for each row of docs: doc_id, families, family, confirmed and n_paragraphs."""
    model = model or fit(docs)
    hits = scan_paragraphs(docs, model)
    by_doc = hits.groupBy("doc_id").agg(
        F.array_join(F.array_sort(F.collect_set("family")), ",").alias("families"),
        F.min_by("family", F.struct(~F.col("confirmed"), -F.col("probability"), F.col("family"))).alias("family"),
        F.max("confirmed").alias("confirmed"),
        F.count_distinct("line", "family").alias("n_paragraphs"),
    ).withColumnRenamed("doc_id", "id")
    return docs.select("doc_id").join(by_doc, F.col("doc_id").eqNullSafe(F.col("id")), "left").select(
        "doc_id",
        F.coalesce("families", F.lit("")).alias("families"),
        F.coalesce("family", F.lit(NONE)).alias("family"),
        F.coalesce("confirmed", F.lit(False)).alias("confirmed"),
        F.coalesce("n_paragraphs", F.lit(0)).cast("long").alias("n_paragraphs"),
    )
