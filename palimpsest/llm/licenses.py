"""Operator 4, licence scans: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

Templates are short notices, standard headers and whole licence texts. Every line of every text, every block (a run of lines
without a blank one, all comments or all none) and the text as a whole are compared with every template. A vector holds the
distinct words, weighted by 1 + log(count) and by inverse line frequency, log((1 + lines) / (1 + lines with the word)) + 1, counted
over the whole corpus for all words. What reaches LEAST carries the template's licence; a text's own licence is that of its best
unit (ties: the licence that sorts first, then the first line, then the shorter unit). A file is a licence file if
licence lines hold at least half of its words, or its name says so; its licence holds for its directory, of several the best,
then that which sorts first. A file without a licence of its own inherits that of its nearest ancestor directory that has one,
found by joining the distinct directories' ancestors, not the files', so no directory is hot.

Defined cases: a null or empty text has no licence of its own; a null path is its own root without ancestors and inherits
nothing; repeated rows are judged row by row; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.session import stored

from .common import Memo, in_slices, per_batch
from .license_texts import TEXTS

LEAST = 0.6
#: Short forms of public licence notices.
TEMPLATES: dict[str, list[str]] = {
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0"],
    "BSD-2-Clause": ["Released under the BSD 2-Clause License.", "SPDX-License-Identifier: BSD-2-Clause"],
    "BSD-3-Clause": ["Released under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "Creative Commons Attribution 4.0 International License"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC0-1.0": ["Dedicated to the public domain under CC0 1.0.", "SPDX-License-Identifier: CC0-1.0"],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0"],
    "ISC": ["Released under the ISC License.", "SPDX-License-Identifier: ISC"],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-3.0"],
    "MIT": ["Released under the MIT License.", "SPDX-License-Identifier: MIT"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense"],
}
TEMPLATES = {name: [*short, *TEXTS.get(name, [])] for name, short in TEMPLATES.items()}
_COMMENT = re.compile(r"\s*(#|//|/?\*|--|;|%|<!--|rem\b)", re.I)
_WORD = re.compile(r"[a-z0-9]+(?:[.\-][a-z0-9]+)*")
_FILE_NAME = r"(?i)^(licen[cs]e|copying|notice|unlicense)(\..*)?$"


def line_words(line: str) -> set[str]:
    return set(_WORD.findall(line.lower()))


def weights(text: str) -> dict[str, float]:
    """1 + log(count) of each word."""
    return {w: 1 + math.log(n) for w, n in Counter(_WORD.findall(text.lower())).items()}


class Scanner:
    """Templates as sparse unit vectors over their vocabulary."""

    def __init__(self, templates: dict[str, list[str]], lines: int, counts: dict[str, int]):
        self.names = [name for name in sorted(templates) for _ in templates[name]]
        #: Whether a template is a header or a licence text, not a notice of one line.
        self.long = ["\n" in t for name in sorted(templates) for t in templates[name]]
        rows = [weights(t) for name in sorted(templates) for t in templates[name]]
        words = sorted(set().union(*rows))
        self.vocabulary = {w: i for i, w in enumerate(words)}
        self.lines, self.counts = lines, counts
        self.idf = np.array([self.idf_of(w) for w in words])
        self.matrix = np.zeros((len(rows), len(self.vocabulary)))
        for k, r in enumerate(rows):
            at = [self.vocabulary[w] for w in r]
            self.matrix[k, at] = self.idf[at] * list(r.values())
        self.matrix /= np.linalg.norm(self.matrix, axis=1, keepdims=True)
        self.squares = self.matrix**2
        #: Words of which a text needs one: without them, what is left of a template is shorter than LEAST.
        self.needed: set[str] = set()
        for row in self.squares:
            left = row.sum()
            for i in np.argsort(-row, kind="stable"):
                if left < LEAST**2 - 1e-9:
                    break
                self.needed.add(words[i])
                left -= row[i]

    def idf_of(self, word: str) -> float:
        return float(np.log((1 + self.lines) / (1 + self.counts.get(word, 0))) + 1)

    def may(self, words: Iterable[str]) -> bool:
        """Whether a text with these words, or a part of it, can reach a template."""
        at = [self.vocabulary[w] for w in words if w in self.vocabulary]
        return bool(at) and float(self.squares[:, at].sum(axis=1).max()) >= LEAST**2 - 1e-9

    def unit(self, text: str) -> tuple[str, bool, float, float, list[str], list[float]] | None:
        """Name of the best template, whether it is long, dot product with it, square of the norm over the templates' words, and the other words with
        their weights. None if the cosine is below LEAST though the other words be in every line."""
        words = weights(text)
        if not self.may(words):
            return None
        at = [self.vocabulary[w] for w in words if w in self.vocabulary]
        v = self.idf[at] * [x for w, x in words.items() if w in self.vocabulary]
        other = {w: x for w, x in words.items() if w not in self.vocabulary}
        dots, known = self.matrix[:, at] @ v, float((v**2).sum())
        k = int(dots.argmax())
        if dots[k] < (LEAST - 1e-9) * math.sqrt(known + sum(x * x for x in other.values())):
            return None
        return self.names[k], self.long[k], float(dots[k]), known, list(other), list(other.values())

    def best(self, text: str) -> tuple[str | None, float]:
        """Licence and score of one text, with the counts that this scanner has."""
        got = self.unit(text)
        if not got:
            return None, 0.0
        name, _, dot, known, other, x = got
        cos = dot / math.sqrt(known + sum((a * self.idf_of(w)) ** 2 for w, a in zip(other, x, strict=True)))
        return (name, round(cos, 6)) if cos >= LEAST else (None, 0.0)


def word_counts(files: DataFrame) -> DataFrame:
    """word, n: in how many lines of all texts each word is; the empty word has the number of lines."""

    def run(b: pa.RecordBatch) -> list[pa.RecordBatch]:
        out = []
        for s in in_slices(b, 0):
            _, lines, codes, starts, raw = _coded(s.column(0))
            place: dict[str, int] = {}
            held = [[place.setdefault(w, len(place)) for w in line_words(x)] for x in raw]
            size = np.array([len(x) for x in held], np.int64)
            first = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
            flat = np.array([i for x in held for i in x], np.int64)
            line = np.repeat(np.arange(lines), np.diff(starts))
            hit = np.flatnonzero(size[codes])
            n = size[codes[hit]]
            at = np.repeat(first[codes[hit]] - np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64), n) + np.arange(n.sum())
            pairs = np.unique(np.repeat(line[hit], n) * max(1, len(place)) + flat[at])
            counts = np.bincount(pairs % max(1, len(place)), minlength=len(place))[: len(place)]
            out.append(pa.RecordBatch.from_arrays([pa.array(["", *place], pa.string()), pa.array([lines, *counts.tolist()], pa.int64())], ["word", "n"]))
        return out

    return stored(per_batch(files.select("text"), run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "word-counts")


def _coded(texts: pa.Array) -> tuple[np.ndarray, int, np.ndarray, np.ndarray, list[str]]:
    """Where each text's lines start, lines, the place of each blank-separated word among the distinct ones, where each line's words start, and the distinct words."""
    by_text = pc.split_pattern(pc.fill_null(texts, ""), "\n")
    lines = by_text.flatten()
    by_line = pc.split_pattern(lines, " ")
    flat = by_line.flatten().dictionary_encode()
    starts = lambda x: x.offsets.to_numpy() - x.offsets[0].as_py()
    return starts(by_text), len(lines), flat.indices.to_numpy(), starts(by_line), flat.dictionary.to_numpy(zero_copy_only=False).tolist()


def blocks(lines: list[str]) -> list[tuple[int, int]]:
    """First line and end of each run of lines that are not blank and all comments, or all none."""
    out, kind = [], None
    for k, line in enumerate(lines):
        now = bool(_COMMENT.match(line)) if line.strip() else None
        if now is not None:
            if now == kind:
                out[-1] = (out[-1][0], k + 1)
            else:
                out.append((k, k + 1))
        kind = now
    return out


_UNIT = "kind int, block int, first int, n int, size int, name string, long boolean, dot double, known double, other array<string>, x array<double>"
_UNITS = f"file_id long, path string, n int, size int, units array<struct<{_UNIT}>>"


def units(files: DataFrame, scanner: Scanner) -> DataFrame:
    """file_id, path, n (lines), size (words), units that may reach a template: of kind 0 (lines), 1 (blocks), 2 (the text)."""
    shared = files.sparkSession.sparkContext.broadcast(scanner)  # bounded by the templates
    names = [x.split(" ")[0] for x in _UNIT.split(", ")]
    kinds = (*[pa.int32()] * 5, pa.string(), pa.bool_(), pa.float64(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.float64()))
    row = pa.list_(pa.struct(list(zip(names, kinds, strict=True))))

    def of_text(text: str, hot: np.ndarray, seen: Memo) -> list[dict]:
        if not shared.value.may(line_words(text)):
            return []
        lines = text.split("\n")
        size = [x.count(" ") + 1 for x in lines]
        runs = [(a, b) for a, b in blocks(lines) if hot[a:b].any()]
        asked = [(0, a, k, k + 1, lines[k]) for a, b in runs for k in range(a, b) if hot[k]]
        asked += [(1, a, a, b, "\n".join(lines[a:b])) for a, b in runs if b - a > 1]
        if len(lines) > 1:
            asked.append((2, 0, 0, len(lines), text))
        found = [(kind, block, a, b - a, sum(size[a:b]), *got) for kind, block, a, b, t in asked if (got := seen[t] if kind == 0 else shared.value.unit(t))]
        return [dict(zip(names, x, strict=True)) for x in found]

    def run(b: pa.RecordBatch) -> list[pa.RecordBatch]:
        out, seen = [], Memo(shared.value.unit, 50_000)
        for s in in_slices(b, 2):
            at, _, codes, starts, raw = _coded(s.column(2))
            needed = np.array([not shared.value.needed.isdisjoint(line_words(x)) for x in raw], bool)
            met = np.concatenate([[0], np.cumsum(needed[codes])])
            hot = met[starts[1:]] > met[starts[:-1]]
            may = [bool(hot[lo:hi].any()) for lo, hi in zip(at, at[1:], strict=False)]
            got = [of_text(t.as_py(), hot[lo:hi], seen) if m else [] for t, m, lo, hi in zip(s.column(2), may, at, at[1:], strict=False)]
            words = starts[at[1:]] - starts[at[:-1]]
            out.append(pa.RecordBatch.from_arrays([s.column(0), s.column(1), pa.array(np.diff(at), pa.int32()), pa.array(words, pa.int32()), pa.array(got, row)], ["file_id", "path", "n", "size", "units"]))
        return out

    return per_batch(files.select("file_id", "path", "text"), run, _UNITS)


#: Parts of a word's join.
SALT = 32


def scan(files: DataFrame, templates: dict[str, list[str]] = TEMPLATES) -> DataFrame:
    """file_id, path, licence, score, line_no (from 0), n_lines (with a licence), share (of words in them) of files(file_id, path, text)."""
    counted = word_counts(files)
    vocabulary = sorted(set().union(*(line_words(t) for ts in templates.values() for t in ts)))
    counts = dict(counted.filter(F.col("word").isin(["", *vocabulary])).collect())  # a row a template word
    lines = counts.pop("", None) or 0
    rows = stored(units(files, Scanner(templates, lines, counts)).withColumn("row", F.monotonically_increasing_id()), "licence-units")
    unit = rows.filter(F.size("units") > 0).select("row", F.posexplode("units").alias("u", "x")).select("row", "u", "x.*")
    # the norms' part of words that no template holds, by their own counts
    words = unit.select("row", "u", F.explode(F.arrays_zip("other", "x")).alias("w")).select("row", "u", F.col("w.other").alias("word"), F.col("w.x").alias("x"), F.pmod("row", F.lit(SALT)).cast("int").alias("part"))
    asked = counted.join(words.select("word").distinct(), "word", "left_semi").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    weight = F.col("x") * (F.log((1.0 + lines) / (1 + F.col("n"))) + 1)
    others = words.join(asked, ["word", "part"]).groupBy("row", "u").agg(F.sum(weight * weight).alias("others"))
    cos = F.col("dot") / F.sqrt(F.col("known") + F.coalesce("others", F.lit(0.0)))
    reached = unit.drop("other", "x").join(others, ["row", "u"], "left").withColumn("score", cos).filter(F.col("score") >= LEAST)
    # a block stands for its lines, and a text for its blocks, if it reaches a header or a licence text or more than they do
    c = F.col
    key = F.struct((-F.round("score", 6)).alias("s"), c("name"), c("first"), c("n"))
    at = lambda kind, x: F.max(F.when(c("kind") == kind, x))
    sums = lambda x: F.sum(F.when(c("kind") == 0, c(x)))
    of_block = reached.withColumn("whole", c("kind") == 2).groupBy("row", "block", "whole")
    of_block = of_block.agg(F.min(key).alias("key"), at(1, c("long")).alias("long1"), at(1, c("score")).alias("s1"), at(0, c("score")).alias("s0"), at(1, c("n")).alias("n1"), at(1, c("size")).alias("size1"), sums("n").alias("n0"), sums("size").alias("size0"), at(2, c("long")).alias("long2"), at(2, c("score")).alias("s2"))
    stands = c("s1").isNotNull() & (c("long1") | (c("s1") > F.coalesce("s0", F.lit(0.0))))
    of_block = of_block.withColumns({"held_n": F.when(stands, c("n1")).otherwise(c("n0")), "held": F.when(stands, c("size1")).otherwise(c("size0"))})
    of_row = of_block.groupBy("row").agg(F.min("key").alias("key"), F.sum("held_n").alias("held_n"), F.sum("held").alias("held"), F.max("long2").alias("long2"), F.max("s2").alias("s2"), F.max(F.greatest("s0", "s1")).alias("parts"))
    whole = c("s2").isNotNull() & (c("long2") | (c("s2") > F.coalesce("parts", F.lit(0.0))))
    found = of_row.select("row", c("key.name").alias("licence"), (-c("key.s")).alias("score"), c("key.first").alias("line_no"), "held_n", "held", whole.alias("whole"))
    own = lambda x, of_all: F.when(c("licence").isNull(), 0).when(c("whole"), of_all).otherwise(c(x))
    out = rows.drop("units").join(found, "row", "left")
    return out.select("file_id", "path", "licence", F.coalesce("score", F.lit(0.0)).alias("score"), "line_no", own("held_n", F.col("n")).cast("int").alias("n_lines"), (own("held", F.col("size")) / F.col("size")).alias("share"))


def directory(path: Column) -> Column:
    """What stands before a path's last slash; of a path without one, the empty root."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def inherit(scanned: DataFrame) -> DataFrame:
    """Adds origin (own, inherited or null) and directory; files without a licence get that of the nearest ancestor directory."""
    rows = scanned.withColumn("directory", directory(F.col("path")))
    is_file = (F.col("share") >= 0.5) | F.regexp_extract("path", r"[^/]*$", 0).rlike(_FILE_NAME)
    best = F.min(F.struct((-F.col("score")).alias("s"), F.col("licence").alias("l"))).alias("best")
    holders = rows.filter(F.col("licence").isNotNull() & is_file & F.col("path").isNotNull()).groupBy("directory").agg(best).select(F.col("directory").alias("ancestor"), F.col("best.l").alias("inherited"))
    parts = F.split("directory", "/")
    ancestors = rows.filter("path is not null").select("directory").distinct().select("directory", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("ancestor")).distinct()
    nearest = ancestors.join(holders, "ancestor").groupBy("directory").agg(F.max_by("inherited", F.length("ancestor")).alias("inherited"))
    out = rows.join(nearest, "directory", "left")
    origin = F.when(F.col("licence").isNotNull(), "own").when(F.col("inherited").isNotNull(), "inherited")
    return out.withColumn("origin", origin).withColumn("licence", F.coalesce("licence", "inherited")).drop("inherited")


def license_scan(files: DataFrame, templates: dict[str, list[str]] = TEMPLATES) -> DataFrame:
    """file_id, path, licence, origin, score, line_no, n_lines of each row of files(file_id, path, text)."""
    return inherit(stored(scan(files, templates), "licences")).select("file_id", "path", "licence", "origin", "score", "line_no", "n_lines")
