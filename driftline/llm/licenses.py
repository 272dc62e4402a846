"""Licence scans: TF-IDF cosine of headers and whole licence files to templates, then inheritance from directories."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .license_texts import FULL
from .shared import checked, materialize, spread

#: Least cosine of a match; a text of at most FILE_WORDS words that holds a match is a licence file of its directory, and
#: so is, at any length, one that matches a full licence text as a whole or has a licence file's name and holds a match.
LEAST_COSINE, FILE_WORDS = 0.6, 60
#: Names of licence files, but for those of source and data files.
FILE_NAME, CODE_NAME = r"(?i)(?:^|/)(?:licen[cs]es?|copying|notice)(?:[-_. ][^/]*)?$", r"(?i)\.(?:pyi?|c|cc|cpp|cs|h|hpp|java|kt|m?js|tsx?|go|rs|rb|sh|php|swift|scala|json|ya?ml|xml|css)$"
# The usual notices of common licences.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "SPDX-License-Identifier: Apache-2.0"],
    "MIT": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "SPDX-License-Identifier: MIT"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3", "SPDX-License-Identifier: GPL-3.0-only"],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2", "SPDX-License-Identifier: GPL-2.0-only"],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3.", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3", "SPDX-License-Identifier: LGPL-3.0-only"],
    "BSD-3-Clause": ["Released under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "SPDX-License-Identifier: BSD-3-Clause"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "SPDX-License-Identifier: MPL-2.0"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "Creative Commons Attribution 4.0 International Public License", "SPDX-License-Identifier: CC-BY-4.0"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "Creative Commons Attribution-ShareAlike 4.0 International Public License", "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Creative Commons Attribution-NonCommercial 4.0 International Public License", "SPDX-License-Identifier: CC-BY-NC-4.0"],
}


_TERM = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")
#: (license, whole text or not, counts of terms) of each template.
_COUNTED = [(name, False, Counter(_TERM.findall(t.lower()))) for name, texts in TEMPLATES.items() for t in texts]
_COUNTED += [(name, True, Counter({t: int(n) for n, ts in (g.split(":") for g in groups.split(";")) for t in ts.split(" ")})) for name, groups in FULL.items()]
_VOCABULARY = sorted({t for *_, c in _COUNTED for t in c})
#: Words of the longest run of lines that is compared beside single lines and whole blocks.
RUN_WORDS = 2 * max(sum(c.values()) for _, full, c in _COUNTED if not full)


class Scorer:
    """Cosines of texts to the templates. A term weighs (1 + ln count) * idf, by the texts that hold it; terms outside of
    the templates weigh as the rarest and add to a text's length only."""

    def __init__(self, seen: dict[str, int], total: int):
        total += len(_COUNTED)
        held = Counter(t for *_, c in _COUNTED for t in c)
        self.at = {t: i for i, t in enumerate(_VOCABULARY)}
        self.idf = np.array([math.log((1 + total) / (1 + seen.get(t, 0) + held[t])) + 1 for t in _VOCABULARY])
        self.rare = math.log(1 + total) + 1
        self.weights = np.zeros((len(_VOCABULARY), len(_COUNTED)))
        for k, (*_, counts) in enumerate(_COUNTED):
            for t, n in counts.items():
                self.weights[self.at[t], k] = (1 + math.log(n)) * self.idf[self.at[t]]
        self.weights /= np.sqrt((self.weights**2).sum(0))
        self.shares = self.weights**2
        self.names = [name for name, *_ in _COUNTED]
        self.full = np.array([full for _, full, _ in _COUNTED])

    def possible(self, terms: set[str]) -> np.ndarray:
        """Templates that a text of these terms can match: by Cauchy-Schwarz its cosine is at most the root of the share
        of the template's squared weight that lies on shared terms."""
        return self.shares[[self.at[t] for t in terms if t in self.at]].sum(0) >= LEAST_COSINE**2 - 1e-9

    def cosines(self, terms: list[str], counts: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Rows of ``counts`` over ``terms`` against the templates ``which``."""
        at = np.array([self.at.get(t, -1) for t in terms])
        w = np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0) * np.where(at < 0, self.rare, self.idf[at])
        return (w @ np.where(at[:, None] < 0, 0, self.weights[at][:, which])) / np.maximum(np.sqrt((w * w).sum(1)), 1e-300)[:, None]

    def top(self, units: list[list[str]], which: np.ndarray) -> tuple[float, str] | None:
        """The best (score, license) of the units' term lists against the templates ``which``."""
        best = None
        which = np.flatnonzero(which)
        for unit in units:
            if len(which) and unit:
                counts = Counter(unit)
                best = self.better(best, self.cosines(list(counts), np.array([list(counts.values())]), which), which)
        return best

    def better(self, best: tuple[float, str] | None, found: np.ndarray, which: np.ndarray) -> tuple[float, str] | None:
        own = [(round(float(x), 9), self.names[k]) for x, k in zip(found.max(0), which, strict=True)]
        return max([x for x in own if x[0] >= LEAST_COSINE] + ([best] if best else []), default=None)

    def runs(self, block: list[list[str]], which: np.ndarray) -> tuple[float, str] | None:
        """The best match among the runs of a block's lines: single lines, runs of at most RUN_WORDS words, the whole."""
        size = np.cumsum([0, *map(len, block)])
        best, first = None, 0
        while first < len(block):
            # Each run that begins in the first RUN_WORDS words of a span lies in the span.
            after = max(first + 1, int(np.searchsorted(size, size[first] + RUN_WORDS, side="right")) - 1)
            last = max(after, int(np.searchsorted(size, size[after - 1] + RUN_WORDS, side="right")) - 1)
            span = block[first:last]
            terms = {t: i for i, t in enumerate(dict.fromkeys(t for line in span for t in line))}
            some = np.flatnonzero(which & self.possible(set(terms)))
            if len(some):
                counts = np.zeros((len(span) + 1, len(terms)))
                for i, line in enumerate(span):
                    for t in line:
                        counts[i + 1, terms[t]] += 1
                sums = counts.cumsum(0)
                for i in range(after - first):
                    stop = max(i + 1, int(np.searchsorted(size, size[first + i] + RUN_WORDS, side="right")) - 1 - first)
                    best = self.better(best, self.cosines(list(terms), sums[i + 1 : stop + 1] - sums[i], some), some)
            first = after
        if size[-1] > RUN_WORDS:
            best = max(filter(None, (best, self.top([[t for line in block for t in line]], which))), default=None)
        return best

    def match(self, text: str) -> tuple[float, str, bool] | None:
        """The best (score, license, as a whole) of a text: whole against full licence texts, and runs of lines of its
        blocks (lines without a term stand between blocks) against notices."""
        text = text.lower()
        which = self.possible(set(_TERM.findall(text)))
        if not which.any():
            return None
        lines = [_TERM.findall(x) for x in text.split("\n")]
        whole = self.top([[t for line in lines for t in line]], which & self.full)
        best, block, which = None, [], which & ~self.full
        if which.any():
            for line in [*lines, []]:
                if line:
                    block.append(line)
                elif block:
                    best = max(filter(None, (best, self.runs(block, which))), default=None)
                    block = []
        found = max(filter(None, (best, whole)), default=None)
        return found and (*found, whole is not None and found[1] == whole[1])


def seen_terms(files: DataFrame, text: str) -> tuple[dict[str, int], int]:
    """How many texts hold each term of the templates, and how many texts there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = set(_VOCABULARY), Counter()
        for batch in batches:
            seen[""] += batch.num_rows
            for t in batch.column(0):
                seen.update(known.intersection(_TERM.findall((t.as_py() or "").lower())))
        yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names=["term", "n"])

    held = {r["term"]: r["n"] for r in files.select(text).mapInArrow(run, "term string, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    return held, held.pop("", 0)


def match_texts(files: DataFrame, key: str, path: str, text: str) -> DataFrame:
    """(__key, __path, words, license, score, whole) for every row: the best match of its whole text."""
    seen, total = seen_terms(files, f"`{text}`")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(seen, total)
        for batch in batches:
            found = [scorer.match(t.as_py() or "") or (None, None, False) for t in batch.column(3)]
            score, license_, whole = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(license_, pa.string()), pa.array(score, pa.float64()), pa.array(whole, pa.bool_())], names=["__key", "__path", "words", "license", "score", "whole"])

    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    words = F.size(F.filter(F.split(body, r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    types = dict(files.dtypes)
    return files.select(F.col(f"`{key}`").alias("__key"), F.col(f"`{path}`").alias("__path"), words.alias("words"), body.alias("text")).mapInArrow(run, f"__key {types[key]}, __path {types[path]}, words int, license string, score double, whole boolean")


def scan(files: DataFrame, key: str, path: str, text: str = "text") -> DataFrame:
    """(key, path, license, score, found) for every row: the licence of its own best match (found: header), else that
    of the nearest ancestor directory with a licence file (inherited), else null (none).

    Whole texts are looked at. A licence file is one by its name or by its text, see FILE_WORDS. Null texts and paths give no match of their own; in a directory with more
    than one licence file the best score counts, then the name; repeated rows are rows of their own; other columns are
    left out.
    """
    known = materialize(match_texts(spread(files), key, path, text).withColumn("__row", F.monotonically_increasing_id()), "own")
    parent = lambda p: F.when(p.contains("/"), F.regexp_replace(p, r"/[^/]*$", ""))
    named = F.col("__path").rlike(FILE_NAME) & ~F.col("__path").rlike(CODE_NAME)
    folders = known.filter(F.col("license").isNotNull() & (F.col("whole") | named | (F.col("words") <= FILE_WORDS)) & F.col("__path").contains("/")).groupBy(parent(F.col("__path")).alias("folder")).agg(F.max(F.struct("score", "license")).alias("best")).select("folder", F.col("best.license").alias("f_license"), F.col("best.score").alias("f_score"))
    folders = checked(materialize(folders, "folders"))
    steps = F.split(F.col("__path"), "/")
    bare = known.filter(F.col("license").isNull() & F.col("__path").isNotNull())
    above = bare.filter(F.size(steps) > 1).select("__row", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(steps) - 1), lambda i: F.array_join(F.slice(steps, F.lit(1), i), "/"))).alias("depth", "folder"))
    nearest = above.join(folders, "folder").groupBy("__row").agg(F.max(F.struct("depth", "f_license", "f_score")).alias("best")).select(F.col("__row").alias("__heir"), F.col("best.f_license").alias("h_license"), F.col("best.f_score").alias("h_score"))
    joined = known.join(nearest, F.col("__row") == F.col("__heir"), "left")
    found = F.when(F.col("license").isNotNull(), "header").when(F.col("h_license").isNotNull(), "inherited").otherwise("none")
    return joined.select(F.col("__key").alias(key), F.col("__path").alias(path), F.coalesce("license", "h_license").alias("license"), F.round(F.coalesce("score", "h_score"), 6).alias("score"), found.alias("found"))
