"""Licence scans by a trained paragraph classifier: native DataFrame expressions, no Python on the rows.

A paragraph is a line of the text, or several that were one before it was wrapped (`WRAPPED`).  Its words (lower-cased letters, digits and inner dots) and pairs of words are the
features of a sparse multinomial logistic regression over the licence families and `unknown`.  It is fitted on the
driver on NOTICES (whole, in windows, and with words left out) and on sentences with NAMES against a bounded, hash-chosen sample of the corpus's
own lines, which stand for `unknown`.  Only features that the sample's lines hardly ever hold take part (pairs need a
word that few lines hold), so almost all weights are zero, and a line without any of them can't be a licence.  Half of
the examples are held out of the fit; they calibrate the probability that a line isn't `unknown` (Platt scaling of the margin).

A prediction counts if a notice or a name of its family confirms it: the share of the notice's pairs of words that the
line holds, or of the line's that the notice holds, must reach `agree` (a name of one word must be there).  Rows are scored by one projection without a
shuffle; the weights are a literal of fixed size.  Lines without a word or pair of words that has a weight are skipped
by one regular expression before they are cut into words.

Null and empty texts have no paragraphs.  Repeated rows are scored as rows of their own.  Families that tie go to the
alphabetically first.  Very long texts are scanned whole, paragraph by paragraph; an empty table gives no rows; other columns
don't matter, and a kept one with the name of an output gives way to it.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "unknown"
#: Notices by which works name their licence, and first sentences of the licences themselves.
NOTICES = {
    "agpl": [
        "This program is licensed under the GNU Affero General Public License, version 3.",
        "under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "SPDX-License-Identifier: Apache-2.0",
        "Released under the Apache 2.0 license.",
    ],
    "bsd": [
        "Released under the BSD License.",
        "Licensed under the 3-clause BSD license.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ],
    "cc0": [
        "Released under CC0 1.0.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work.",
        "This work is dedicated to the public domain.",
        "This is free and unencumbered software released into the public domain.",
        "SPDX-License-Identifier: CC0-1.0",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see http://www.gnu.org/licenses/.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "isc": [
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "SPDX-License-Identifier: ISC",
    ],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction,",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "proprietary": [
        "All rights reserved.",
        "Copyright (c) the authors. All rights reserved.",
        "No part of this publication may be reproduced without the prior written permission of the publisher.",
    ],
}
#: Names of the licences, short forms included.
NAMES = {
    "agpl": ["GNU Affero General Public License", "Affero GPL", "GNU AGPL", "AGPL", "AGPLv3", "AGPL-3.0"],
    "apache": ["Apache License", "Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 license", "Apache 2 license", "Apache-2.0", "Apache Software License"],
    "bsd": ["BSD License", "BSD 2-Clause License", "BSD 3-Clause License", "2-clause BSD license", "3-clause BSD license", "simplified BSD license", "new BSD license", "BSD-2-Clause", "BSD-3-Clause", "BSD-style license"],
    "cc-by": ["CC BY 4.0", "CC BY 3.0", "CC-BY license", "Creative Commons Attribution 4.0", "Creative Commons Attribution License", "Creative Commons Attribution 4.0 International License"],
    "cc-by-nc": ["CC BY-NC 4.0", "CC BY-NC 3.0", "CC-BY-NC license", "Creative Commons Attribution-NonCommercial 4.0", "Creative Commons Attribution-NonCommercial License"],
    "cc-by-sa": ["CC BY-SA 4.0", "CC BY-SA 3.0", "CC-BY-SA license", "Creative Commons Attribution-ShareAlike 4.0", "Creative Commons Attribution-ShareAlike License"],
    "cc0": ["CC0", "CC0 1.0", "CC0 1.0 Universal", "Creative Commons Zero", "public domain dedication", "Unlicense"],
    "gpl": ["GNU General Public License", "GNU General Public License v3", "GNU GPL", "GPLv2", "GPLv3", "GPL-2.0", "GPL-3.0", "GPL version 2", "GPL version 3", "GPL license"],
    "isc": ["ISC License", "ISC licence"],
    "lgpl": ["GNU Lesser General Public License", "GNU Library General Public License", "GNU LGPL", "LGPL", "LGPLv2.1", "LGPLv3", "LGPL-2.1", "LGPL-3.0"],
    "mit": ["MIT License", "MIT licence", "MIT-licensed", "under MIT", "Expat license"],
    "mpl": ["Mozilla Public License", "Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL 2.0", "MPL-2.0", "MPLv2"],
    "proprietary": ["proprietary license", "commercial license only", "confidential and proprietary"],
}
#: Sentences that name a licence, for training, and ones that only sound alike.
FRAMES = [
    "Licensed under the {}.", "Released under the {}.", "This project is licensed under the terms of the {}.", "Distributed under the {}.", "The code is available under the {}.", "License: {}",
    "This software is provided under {}", "See the {} for details.", "{}", "made available under the {} by its authors",
]
ALIKE = [
    "Licensed under the laws of the state.", "Released under the title of the first song.", "The driver's license was revoked.", "A license plate was found.", "This project is under construction.",
    "The copyright office is closed.", "public policy and general interest", "the attribution of the painting is disputed", "the author has died", "permission to enter is granted by the guard",
    "The commercial was released in spring.", "Version 2.0 of the plan is available.", "see the file for details", "the terms of the treaty", "an international agreement", "rights of all citizens",
]
SEPARATORS = r"[^\p{L}\p{N}.]+|\.+(?![\p{L}\p{N}])"


#: Widths that text is wrapped at, in letters: a line that the next one's first word would have made longer than the smaller goes on in it.
WIDTHS = (60, 120)
LIST_MARK = r"[-•][ \t]|[0-9]+[.)][ \t]"
#: A line and its end, where the text goes on in the next: by the length of that one's first word, which may be up to 20 letters.
WRAPPED = (
    rf"(?md)^(?=[^\n]{{{WIDTHS[0] - 20},{WIDTHS[1]}}}\n\S)(?=" + "|".join(rf"[^\n]{{{WIDTHS[0] - n},{WIDTHS[1]}}}\n\S{{{n}}}" for n in range(1, 21)) + rf")([^\n]*)\n(?!{LIST_MARK})"
)


def lines_of(text: Column) -> Column:
    """Paragraphs with a letter or digit, in lower case: lines, with wrapped ones joined up to a blank line, a list mark or a line that ends early."""
    joined = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), F.lit(WRAPPED), F.lit("$1 "))
    return F.filter(F.split(joined, "\n"), lambda x: x.rlike(r"[\p{L}\p{N}]"))


def words_of(line: Column) -> Column:
    return F.array_remove(F.split(line, SEPARATORS), "")


def pairs_of(words: Column) -> Column:
    two = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.concat_ws(" ", a, b))
    return F.when(F.size(words) > 1, F.slice(two, 1, F.greatest(F.size(words) - 1, F.lit(1)))).otherwise(F.array().cast("array<string>"))


@dataclass
class Model:
    families: list[str]  # UNKNOWN comes last
    bias: np.ndarray
    weights: dict[str, np.ndarray]  # of each feature, a number a family
    slope: float
    offset: float
    notices: dict[str, list[list[str]]]  # distinct pairs of words of each notice and name; the word of a name of one

    @property
    def hints(self) -> list[str]:
        """The words and pairs of words with a weight; a line without any of them can't be a licence."""
        return sorted(self.weights)


def _grams(words: list[str]) -> list[str]:
    return [*words, *(f"{a} {b}" for a, b in zip(words[:-1], words[1:], strict=True))]


def _examples(notices: dict[str, list[list[str]]], named: list[tuple[str, list[str]]]) -> list[tuple[str, list[str]]]:
    """Sentences with names; every notice whole, without each of its words, and in windows that hold most of it."""
    out = list(named)
    for family, own in sorted(notices.items()):
        for words in own:
            out += [(family, words)] * 3
            out += [(family, words[:i] + words[i + 1 :]) for i in range(len(words)) if len(words) > 3]
            n = max(3, 2 * len(words) // 3)
            out += [(family, words[i : i + n]) for i in range(0, len(words) - n + 1, 2)]
    return out


def _fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, classes: int, decay: float = 1e-4, rounds: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """Multinomial logistic regression by gradient descent with momentum; small weights are cut to zero at the end."""
    w, b = np.zeros((x.shape[1], classes)), np.zeros(classes)
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    target = np.eye(classes)[y]
    weight = weight / weight.sum()
    for _ in range(rounds):
        z = x @ w + b
        z -= z.max(1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(1, keepdims=True)
        d = (p - target) * weight[:, None]
        vw, vb = 0.9 * vw - 2.0 * (x.T @ d + decay * w), 0.9 * vb - 2.0 * d.sum(0)
        w, b = w + vw, b + vb
    w[np.abs(w) < 0.02] = 0
    return w, b


def _platt(margin: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset of the logistic curve of y over margin, with Platt's smoothed targets."""
    up, down = y.sum(), len(y) - y.sum()
    t = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    x = np.stack([margin, np.ones_like(margin)], 1)
    w = np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * np.maximum(p * (1 - p), 1e-9)[:, None]).T @ x + 1e-3 * np.eye(2)
        w -= np.clip(np.linalg.solve(h, x.T @ (p - t) + 1e-3 * (w - np.array([1.0, 0.0]))), -2, 2)
    return float(max(w[0], 1e-3)), float(w[1])


def train(
    docs: DataFrame, text_column: str = "text", lines: int = 2000, notices: dict[str, list[str]] | None = None, common: float = 0.002,
    names: dict[str, list[str]] | None = None, sample_words: int = 300,
) -> Model:
    """A model from NOTICES, NAMES in FRAMES, and at most `lines` paragraphs of the corpus, chosen by their hash; only these meet the driver.

    Of each paragraph of the sample the first `sample_words` words are learned from (scans read all words).

    Lines that equal or nearly hold a notice are left out of the sample.  Features that more than `common` of the
    sample's lines hold have no weight.
    """
    spark = docs.sparkSession
    known = notices or NOTICES
    called = names if names is not None else (NAMES if notices is None else {})
    flat = [(k, t) for k, own in sorted(known.items()) for t in own]
    flat += [("+" + k, f.format(t)) for k, own in sorted(called.items()) for t in own for f in FRAMES]
    flat += [("=" + k, t) for k, own in sorted(called.items()) for t in own] + [("-", t) for t in ALIKE]
    own = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(k).alias("family"), F.lit(t).alias("text")) for k, t in flat])).alias("n"))
    cut = own.select("n.family", words_of(F.lower("n.text")).alias("words")).collect()
    templates: dict[str, list[list[str]]] = {}
    named, bare, alike = [], [], []
    for r in cut:
        words = list(r["words"])
        kind, family = (r["family"][0], r["family"][1:]) if r["family"][0] in "+=-" else ("", r["family"])
        if kind == "+":
            named.append((family, words))
        elif kind == "=":
            bare.append((family, words))
        elif kind == "-":
            alike.append(words)
        else:
            templates.setdefault(family, []).append(words)

    chunks = docs.select(lines_of(F.col(text_column)).alias("l")).select(F.sum(F.size("l")).alias("n")).first()["n"] or 0
    share = min(1.0, lines / max(1, chunks))
    picked = (
        docs.select(F.explode(lines_of(F.col(text_column))).alias("line"))
        .where(F.pmod(F.xxhash64(F.lit(11), "line"), F.lit(1 << 24)) < share * (1 << 24)).select("line").distinct()
    )
    picked = picked.orderBy(F.xxhash64("line"), "line").limit(lines)  # exactly bounded, and the same whatever the partitions
    sample = sorted(list(r["words"]) for r in picked.select(F.slice(words_of(F.col("line")), 1, sample_words).alias("words")).collect())
    grams = {g for ws in templates.values() for w in ws for g in _grams(w)} | {g for _, w in named for g in _grams(w)}
    held = [{f"{a} {b}" for a, b in zip(w[:-1], w[1:], strict=True)} for ws in templates.values() for w in ws]
    pairs = [h for h in held if len(h) >= 2]
    background = []
    for words in sample:
        own_pairs = {f"{a} {b}" for a, b in zip(words[:-1], words[1:], strict=True)}
        if not any(2 * len(h & own_pairs) >= len(h) for h in pairs):
            background.append(words)
    seen = Counter(g for words in background for g in set(_grams(words)) & grams)
    rare = {w for w in grams if " " not in w and seen[w] <= 10 * common * len(background)}
    features = sorted(g for g in grams if seen[g] <= common * len(background) and rare & set(g.split(" ")))
    number = {g: i for i, g in enumerate(features)}
    families = [*sorted(templates), UNKNOWN]
    examples = _examples(templates, named)
    # the corpus's lines that hold some feature, and single words and pairs of the notices, are hard cases of unknown
    hard = [(UNKNOWN, w) for w in background] + [(UNKNOWN, w) for w in alike] * 3
    hard += [(UNKNOWN, [w]) for w in sorted({w for ws in templates.values() for t in ws if len(t) > 4 for w in t})]
    everything = examples + hard
    x = np.zeros((len(everything), len(features)))
    for row, (_, words) in zip(x, everything, strict=True):
        for g in _grams(words):
            if g in number:
                row[number[g]] = 1
    y = np.array([families.index(k) for k, _ in everything])
    counted = np.bincount(y, minlength=len(families)).astype(float)
    weight = np.where(y == len(families) - 1, 3.0, 1.0) / np.maximum(counted[y], 1)
    fold = np.arange(len(y)) % 2 == 0
    w, b = _fit(x[fold], y[fold], weight[fold], len(families))
    z = x[~fold] @ w + b
    margin = z[:, :-1].max(1) - z[:, -1]
    slope, offset = _platt(margin, (y[~fold] < len(families) - 1).astype(float))
    weights = {g: w[i] for g, i in number.items() if w[i].any()}
    distinct = {k: [sorted({f"{a} {b}" for a, b in zip(t[:-1], t[1:], strict=True)}) for t in ts] for k, ts in templates.items()}
    for family, words in bare:
        distinct.setdefault(family, []).append(sorted({f"{a} {b}" for a, b in zip(words[:-1], words[1:], strict=True)} or set(words)))
    return Model(families, b, weights, slope, offset, distinct)


def _pattern(grams: list[str]) -> str:
    """A regular expression that every line with one of the words or pairs of words matches (so may a few others)."""
    trie: dict = {}
    for gram in grams:
        node = trie
        for c in gram:
            node = node.setdefault(c, {})
        node[""] = {}

    def below(node: dict) -> str:
        symbols = {"": r"(?![\p{L}\p{N}])", " ": r"[^\p{L}\p{N}]+", ".": r"\."}
        ways = [symbols.get(c, c) + (below(n) if n else "") for c, n in sorted(node.items())]
        return ways[0] if len(ways) == 1 else f"(?:{'|'.join(ways)})"

    return r"(?<![\p{L}\p{N}])" + below(trie)


def _literal(values: list) -> str:
    """SQL for an array of numbers, or of words, which hold letters, digits, dots and spaces only."""
    if not values:
        return "cast(array() as array<string>)"
    return "array(" + ", ".join(f"'{v}'" if isinstance(v, str) else f"{v!r}D" for v in values) + ")"


OUTPUTS = ("n_paragraphs", "matches", "n_unconfirmed")


def scan(docs: DataFrame, model: Model, *keep: str, text_column: str = "text", least: float = 0.5, agree: float = 0.6) -> DataFrame:
    """The columns of `keep`, n_paragraphs and matches: line number, family, probability and agreement of every licence line.

    `matches` holds lines whose calibrated probability of being a licence is `least` or more and that a notice of
    the family confirms; n_unconfirmed counts the predicted lines that none confirms.
    """
    keep = tuple(c for c in keep if c not in OUTPUTS)  # a kept column of an output's name gives way to it
    own = [f"_c{i}" for i in range(len(keep))]  # kept columns may have the names of columns in between
    lines = docs.select(*[F.col(c).alias(o) for c, o in zip(keep, own, strict=True)], lines_of(F.col(text_column)).alias("_lines"))
    return _scanned(lines, model, own, least, agree).withColumnsRenamed(dict(zip(own, keep, strict=True)))


def _scanned(lines: DataFrame, model: Model, keep: list[str], least: float, agree: float) -> DataFrame:
    if not model.weights:
        none = F.array().cast("array<struct<line:int,family:string,probability:double,agreement:double>>")
        return lines.select(*keep, F.size("_lines").cast("long").alias("n_paragraphs"), none.alias("matches"), F.lit(0).cast("long").alias("n_unconfirmed"))
    hint = _pattern(model.hints)
    vocabulary = F.expr(_literal(model.hints))
    numbers = lambda x: [round(float(v), 6) for v in x]
    table = F.expr("map(" + ", ".join(f"'{g}', {_literal(numbers(model.weights[g]))}" for g in sorted(model.weights)) + ")")
    n = len(model.families) - 1

    hinted = F.filter(F.transform("_lines", lambda x, i: F.when(x.rlike(hint), F.struct(i.alias("line"), words_of(x).alias("words")))), lambda x: x.isNotNull())
    got = lines.select(*keep, F.size("_lines").cast("long").alias("n_paragraphs"), hinted.alias("_hinted"))
    features = F.transform("_hinted", lambda x: F.struct(x["line"].alias("line"), F.array_distinct(F.concat(x["words"], pairs_of(x["words"]))).alias("pairs"), F.greatest(F.lit(1), F.size(F.array_distinct(pairs_of(x["words"])))).alias("n"), F.array_intersect(F.concat(x["words"], pairs_of(x["words"])), vocabulary).alias("grams")))
    got = got.select(*keep, "n_paragraphs", F.filter(features, lambda x: F.size(x["grams"]) > 0).alias("_features"))
    logits = F.transform(
        "_features",
        lambda x: F.struct(
            x["line"].alias("line"), x["pairs"].alias("pairs"), x["n"].alias("n"),
            F.aggregate(x["grams"], F.expr(_literal(numbers(model.bias))), lambda acc, g: F.zip_with(acc, F.try_element_at(table, g), lambda a, b: a + b)).alias("z"),
        ),
    )
    got = got.select(*keep, "n_paragraphs", logits.alias("_logits"))
    top = F.transform(
        "_logits",
        lambda x: F.struct(
            x["line"].alias("line"), x["pairs"].alias("pairs"), x["n"].alias("n"),
            F.array_max(F.slice(x["z"], 1, n)).alias("best"), x["z"].alias("z"),
        ),
    )
    got = got.select(*keep, "n_paragraphs", top.alias("_top"))
    chosen = F.transform(
        "_top",
        lambda x: F.struct(
            x["line"].alias("line"), x["pairs"].alias("pairs"), x["n"].alias("n"),
            F.array_position(F.slice(x["z"], 1, n), x["best"]).cast("int").alias("k"),
            (1 / (1 + F.exp(-(model.slope * (x["best"] - F.get(x["z"], F.lit(n))) + model.offset)))).alias("p"),
        ),
    )
    got = got.select(*keep, "n_paragraphs", F.filter(chosen, lambda x: x["p"] >= least).alias("_chosen"))
    notices = F.expr("array(" + ", ".join("array(" + ", ".join(map(_literal, model.notices[k])) + ")" for k in model.families[:-1]) + ")")
    names = F.expr(_literal(model.families[:-1]))

    def agreement(pairs: Column, size: Column, k: Column) -> Column:
        share = lambda t: F.size(F.array_intersect(t, pairs)) / F.greatest(F.lit(1), F.least(F.size(t), size))
        return F.array_max(F.transform(F.get(notices, k - 1), share))

    confirmed = F.transform("_chosen", lambda x: F.struct(x["line"].alias("line"), F.get(names, x["k"] - 1).alias("family"), x["p"].alias("probability"), agreement(x["pairs"], x["n"], x["k"]).alias("agreement")))
    got = got.select(*keep, "n_paragraphs", confirmed.alias("_predicted"))
    return got.select(
        *keep, "n_paragraphs", F.filter("_predicted", lambda x: x["agreement"] >= agree).alias("matches"),
        F.size(F.filter("_predicted", lambda x: x["agreement"] < agree)).cast("long").alias("n_unconfirmed"),
    )


def digest(scanned: DataFrame, *keep: str) -> DataFrame:
    """A flat row a document: its families (sorted, comma-separated), the licence paragraphs and the best probability."""
    keep = tuple(c for c in keep if c not in (*OUTPUTS, "n_license_lines", "families", "probability"))
    families = F.array_sort(F.array_distinct(F.transform("matches", lambda x: x["family"])))
    best = F.coalesce(F.round(F.array_max(F.transform("matches", lambda x: x["probability"])), 6), F.lit(0.0))
    return scanned.select(
        *keep, "n_paragraphs", F.size("matches").cast("long").alias("n_license_lines"), F.array_join(families, ",").alias("families"),
        best.alias("probability"), "n_unconfirmed",
    )
