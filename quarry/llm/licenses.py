"""Licence scan of paragraphs: sparse word n-gram logistic regression with a class for the unknown, confirmed by templates.

A multinomial model over word unigrams and bigrams is fitted on the driver, on pieces of well-known notices and on
sentences that only speak of licences. The unknown is a class of its own, and the probability from which a family
counts is the lowest above everything that the held-out unknown sentences reached. A prediction stands if the
paragraph holds enough of one of the family's notices, measured as the share of the notice's bigrams, and half of those
that tell it from other families' notices.

A paragraph is a line of text, or a window of adjacent lines: from each line on, every number of lines up to the one that
holds the longest notice, or to the next line without words. So notices wrapped over lines are found, also behind
comment marks and one after another. Only paragraphs with a telling bigram (gate()) are scored; what has none of them
lacks too many bigrams of every notice to be confirmed, so that no licence is lost by it. Of paragraphs that overlap and name one family the most similar stands, of equal ones a line alone
or else the one that starts last; windows that are part of a more similar one of another family don't. The main path is
a plan of SQL expressions over the model's table of n-grams, which depends on the notices only: no Python, and only what
was found is shuffled, by row.

Results on unusual input: null and empty texts have no licence. Paragraphs of any length are scored whole; rows
that share a doc_id, or have none, are reported each. An empty table gives an empty result.
"""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Notices by family.
NOTICES: dict[str, list[str]] = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "Released under the GNU General Public License, version 2.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "LGPL": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    ],
    "AGPL": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-only",
        "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    ],
    "BSD": [
        "Released under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ],
    "MPL": [
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    ],
    "CC-BY": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "CC-BY-SA": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC0": [
        "Released under the CC0 1.0 Universal public domain license dedication.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain under the Unlicense license.",
        "SPDX-License-Identifier: Unlicense",
    ],
    "Proprietary": [
        "Proprietary and confidential. All rights reserved. Unauthorized copying of this file, via any medium, is strictly prohibited.",
        "Copyright, all rights reserved. No part of this publication may be reproduced without prior written permission of the publisher.",
    ],
}
#: Sentences that speak of licences and grant none.
OTHER = [
    "The driver showed his license to the officer at the border.",
    "She applied for a fishing license and a permit last year.",
    "You need permission of the owner to enter the building.",
    "The copyright of the song was sold for a large sum.",
    "Which license should I choose for my project?",
    "The company bought a license for the new software version.",
    "An apache is a helicopter and the Apache web server is a program.",
    "The MIT is a university in Massachusetts where the public lecture was held.",
    "The general public may visit the free exhibition under the old city hall.",
    "A creative common room with free software for the public.",
    "The license plate of the car was reported to the police.",
    "Version 2.0 of the program was released under the new name.",
    "The terms of the agreement and the conditions of sale are in writing.",
    "His licence to practise medicine was revoked in the spring.",
    "The warranty covers repair without charge for two years.",
    "The distribution of the source files is described in the manual.",
    "Poetic license is permitted in works of fiction.",
    "The bar lost its liquor license after the inspection.",
]
UNKNOWN = "unknown"


def _words(text: str) -> list[str]:
    out, word = [], ""
    for c in text.lower() + " ":
        if c.isascii() and c.isalnum():
            word += c
        elif word:
            out.append(word)
            word = ""
    return out


def _grams(words: list[str]) -> list[str]:
    return list(dict.fromkeys(words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]))


def _pairs(text: str) -> list[str]:
    words = _words(text)
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


class Model:
    """families (the last is unknown), n-gram -> weight of each, bias, and the least probability that counts."""

    def __init__(self, rows: int = 2600, seed: int = 5, steps: int = 300):
        rng = random.Random(seed)
        self.families = [*NOTICES, UNKNOWN]
        filler = [w for s in OTHER for w in _words(s)]
        made = []
        for _ in range(rows):
            k = rng.randrange(len(self.families) + len(NOTICES) // 2)
            if k < len(NOTICES):
                notice = _words(rng.choice(NOTICES[self.families[k]]))
                if len(notice) > 14:
                    at = rng.randrange(len(notice) // 2)
                    notice = notice[at : at + rng.randint(12, len(notice))]
                words = [w for w in notice if rng.random() > 0.04]
                if rng.random() < 0.4:
                    words = [rng.choice(filler) for _ in range(rng.randint(1, 12))] + words + [rng.choice(filler) for _ in range(rng.randint(0, 8))]
                made.append((words, k))
            else:
                words = _words(rng.choice(OTHER))
                if rng.random() < 0.5:
                    words = rng.sample(words, len(words)) + [rng.choice(filler) for _ in range(rng.randint(0, 12))]
                made.append((words, len(NOTICES)))
        train, held = [m for i, m in enumerate(made) if i % 4], made[::4]
        vocabulary = sorted({g for words, _ in train for g in _grams(words)})
        at = {g: i for i, g in enumerate(vocabulary)}

        def matrix(rows):
            x = np.zeros((len(rows), len(vocabulary) + 1))
            for i, (words, _) in enumerate(rows):
                x[i, [at[g] for g in _grams(words) if g in at]] = 1
                x[i, -1] = 1
            return x

        x, y = matrix(train), np.eye(len(self.families))[[k for _, k in train]]
        w, speed = np.zeros((x.shape[1], len(self.families))), np.zeros((x.shape[1], len(self.families)))
        for _ in range(steps):  # gradient steps with momentum, ridge 1e-3
            z = x @ w
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            speed = 0.9 * speed - 0.3 * (x.T @ (p - y) / len(x) + 1e-3 * w)
            w = w + speed
        z = matrix(held) @ w
        p = np.exp(z - z.max(1, keepdims=True))
        p = p[:, :-1] / p.sum(1, keepdims=True)
        other = np.array([k == len(NOTICES) for _, k in held])
        self.least = float(max(0.5, p[other].max(initial=0) + 1e-6))
        self.accuracy = float(np.mean([(q.argmax() if q.max() >= self.least else len(NOTICES)) == k for q, (_, k) in zip(p, held, strict=True)]))
        keep = np.abs(w[:-1]).max(1) > 0.02
        self.weights = {g: [round(float(v), 5) for v in w[i]] for i, g in enumerate(vocabulary) if keep[i]}
        self.bias = [round(float(v), 5) for v in w[-1]]


_models: list[Model] = []


def model() -> Model:
    """Fitted once a process."""
    if not _models:
        _models.append(Model())
    return _models[0]


def _literal(value) -> str:
    """SQL of a constant, which the optimizer folds."""
    if isinstance(value, list):
        return "array(" + ", ".join(map(_literal, value)) + ")"
    return f"{value!r}D" if isinstance(value, float) else "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(value: str, name: str, body: str) -> str:
    """body, with name standing for value, which is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _others(family: str) -> set[str]:
    """The bigrams of other families' notices."""
    return {p for g in NOTICES if g != family for n in NOTICES[g] for p in _pairs(n)}


def _required(notice: str, others: set[str]) -> tuple[list[str], list[str]]:
    """All bigrams of a notice, and those that no other family has (all, where it has none)."""
    own = _pairs(notice)
    return own, [p for p in own if p not in others] or own


def gate(least_share: float) -> set[str]:
    """Bigrams such that every paragraph scan() can confirm has one of them.

    A confirmed paragraph holds at least k of a notice's n bigrams, so it has one of any n - k + 1. Of each notice those
    are taken that are longest, hence rare: of all its bigrams, or of the telling ones, whichever are rarer together.
    """
    chosen: set[str] = set()
    for family, notices in NOTICES.items():
        for notice in notices:
            own, telling = _required(notice, _others(family))
            least = next(k for k in range(1, len(own) + 1) if k / len(own) >= least_share)
            ways = [sorted(ps, key=lambda p: (-len(p), p))[: len(ps) - k + 1] for ps, k in ((own, least), (telling, (len(telling) + 1) // 2))]
            chosen |= set(min(ways, key=lambda ps: sum(0.5 ** len(p) for p in ps)))
    return chosen


def _gate_pattern(least_share: float) -> str:
    """A regular expression for a bigram of the gate in lower-cased text."""
    seconds: dict[str, list[str]] = {}
    for first, second in (p.split(" ") for p in sorted(gate(least_share))):
        seconds.setdefault(first, []).append(second)
    letters: dict[str, list[str]] = {}
    for first, after in seconds.items():
        letters.setdefault(first[0], []).append(f"{first[1:]}[^a-z0-9]+(?:{'|'.join(after)})")
    return "(?<![a-z0-9])(?:" + "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in letters.items()) + ")(?![a-z0-9])"


#: Words of a window of lines at least: the longest notice, and what its first line may hold before it.
WINDOW = max(len(_words(n)) for own in NOTICES.values() for n in own) + 20


def scan(docs: DataFrame, keep: list[str], least_share: float = 0.6) -> DataFrame:
    """keep, paragraph (its first line's number from 0), line, family, probability and similarity of every licence found."""
    m = model()
    quoted = _literal(_gate_pattern(least_share))
    texts = docs.select(*keep, F.col("text").cast("string").alias("_t")).where(F.expr(f"lower(_t) RLIKE {quoted}")).withColumn("_row", F.monotonically_increasing_id())
    lines = texts.withColumn("_l", F.expr("split(_t, '\\n', -1)")).withColumn("_c", F.expr("transform(_l, l -> size(filter(split(l, '[^A-Za-z0-9]+'), w -> w <> '')))"))
    # each window holds a word a line at least, so that WINDOW lines are enough
    step = f"(a, c) -> IF(a.done OR c = 0, named_struct('n', a.n, 'k', a.k, 'done', true), named_struct('n', a.n + c, 'k', a.k + 1, 'done', a.n + c >= {WINDOW}))"
    lengths = f"transform(_c, (c, i) -> IF(c = 0, 0, aggregate(slice(_c, i + 1, {WINDOW}), named_struct('n', 0, 'k', 0, 'done', false), {step}).k))"
    windows = "flatten(transform(_k, (k, i) -> transform(slice(sequence(1, greatest(k, 1)), 2, 1000), n -> named_struct('paragraph', i, 'last', i + n - 1, 'line', array_join(slice(_l, i + 1, n), '\\n')))))"
    single = "transform(_l, (l, i) -> named_struct('paragraph', i, 'last', i, 'line', l))"
    # one row per paragraph that the gate lets pass
    rows = lines.withColumn("_k", F.expr(lengths)).select(*keep, "_row", F.expr(f"inline(filter(concat({single}, {windows}), x -> lower(x.line) RLIKE {quoted}))"))
    words = rows.withColumn("_w", F.expr("filter(split(lower(line), '[^a-z0-9]+'), w -> w <> '')"))
    pairs = words.withColumn("_p", F.expr("array_distinct(zip_with(slice(_w, 1, greatest(size(_w) - 1, 0)), slice(_w, 2, greatest(size(_w) - 1, 0)), (a, b) -> concat(a, ' ', b)))"))
    # n-grams and weights as two texts: they fold into one constant map
    keys, values = "|".join(m.weights), "|".join(",".join(f"{v:g}" for v in w) for w in m.weights.values())
    table = f"map_from_arrays(split({_literal(keys)}, '[|]'), split({_literal(values)}, '[|]'))"
    hits = f"filter(transform(concat(array_distinct(_w), _p), g -> element_at({table}, g)), v -> v IS NOT NULL)"
    grams = pairs.withColumn("_v", F.expr(f"transform({hits}, v -> cast(split(v, ',') AS array<double>))"))
    sums = grams.withColumn("_z", F.expr(_let("_v", "vs", f"transform({_literal(m.bias)}, (b, c) -> b + aggregate(vs, 0D, (a, v) -> a + get(v, c)))")))
    top = sums.withColumn("_top", F.expr(_let("_z", "zs", "named_struct('zs', zs, 'best', array_max(transform(slice(zs, 1, size(zs) - 1), (z, c) -> named_struct('z', z, 'c', -c))))")))
    scored = top.withColumn("probability", F.expr(_let("_top", "t", "1 / aggregate(t.zs, 0D, (a, z) -> a + exp(least(z - t.best.z, 700D)))"))).where(F.col("probability") >= m.least)
    # of each notice all bigrams, and those that no other family has
    notices = _literal([[list(_required(n, _others(f))) for n in NOTICES[f]] for f in NOTICES])
    share = _let("_p", "ps", f"array_max(transform(get({notices}, -_top.best.c), n -> IF(2 * size(array_intersect(n[1], ps)) >= size(n[1]), size(array_intersect(n[0], ps)) / size(n[0]), 0D)))")
    named = scored.withColumn("family", F.expr(f"get({_literal(m.families)}, -_top.best.c)")).withColumn("similarity", F.expr(share))
    found = named.where(F.col("similarity") >= least_share)
    # the best of each row first
    row = F.struct((-F.col("similarity")).alias("s"), F.when(F.col("last") > F.col("paragraph"), 1).otherwise(0).alias("wide"), (-F.col("paragraph")).alias("p"), "paragraph", "last", "line", "family", "probability", "similarity")
    by_row = found.groupBy("_row").agg(*(F.first(c).alias(c) for c in keep), F.sort_array(F.collect_list(row)).alias("_f"))
    # a part of a better window of another family is no notice, nor is what overlaps it and names the same family
    part = "x.wide = 1 AND exists(a, y -> NOT y.part AND y.x.paragraph <= x.paragraph AND x.last <= y.x.last)"
    again = "exists(a, y -> y.x.family = x.family AND y.x.paragraph <= x.last AND x.paragraph <= y.x.last)"
    ranked = f"aggregate(_f, transform(slice(_f, 1, 0), x -> named_struct('x', x, 'part', false)), (a, x) -> IF({again}, a, concat(a, array(named_struct('x', x, 'part', {part})))))"
    best = by_row.select(*keep, F.explode(F.expr(f"filter({ranked}, y -> NOT y.part)")).alias("_y")).select(*keep, F.col("_y.x").alias("_x"))
    return best.select(*keep, *(F.col(f"_x.{c}").alias(c) for c in ("paragraph", "line", "family", "probability", "similarity")))
