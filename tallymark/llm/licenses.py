"""Licence notices and texts in documents, by Dice's coefficient over word bigrams.

Texts are normalised (lower case, words of letters and digits, so line breaks, signs and case don't count) and compared
with licence templates: twice the shared distinct bigrams over the sum of both counts. A passage is any run of as many
words as the template has, wherever it begins, inside a line or over several, and every start is scored: from one start to
the next a bigram comes in and one goes out, so the distinct bigrams of all passages are sums over the places at which a
bigram is the last of its kind, and a template costs a text no more than its length.

Bounds on sizes prune candidates without losing any: a passage reaches the threshold only if it shares with the template
at least t * threshold / (2 - threshold) of the template's t bigrams; so a text meets only those templates of which it
holds so many bigrams, counted through lists of the templates of each bigram.

Templates are short notices, whole licence texts and, of texts over `LONG` words, also runs of `PIECE` words, one every
half of that: a quotation of one and a half such runs from anywhere in a long licence holds one whole. The table has a
fixed size and goes to every task.

Each document gives one row: the best licence (highest score, then smallest name), its score and how many licences reach
the threshold, or nulls and 0. Null and empty texts match nothing; repeated rows give repeated rows; an empty table gives
no rows; texts of any length are read whole. Columns beyond id and text are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W_]+")
#: Words of a text that is also known by its runs, and words of a run.
LONG, PIECE = 300, 150
THRESHOLD = 0.8

#: Short notices of common licences, as their stewards or common usage word them.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT License"),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software'),
    ("BSD-3-Clause", "Released under the 3-Clause BSD License"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "Licensed under the GNU General Public License v3.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
]



def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def licence_texts() -> list[tuple[str, str]]:
    """Whole licences: a row each in a file beside this one."""
    lines = Path(__file__).with_name("licence_texts.tsv").read_text(encoding="utf-8").splitlines()
    return [tuple(line.split("\t", 1)) for line in lines]


def runs_of(texts: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Of each long text its runs of PIECE words, one every half of that, and its last."""
    out = []
    for name, text in texts:
        own = words(text)
        if len(own) > LONG:
            starts = [*range(0, len(own) - PIECE, PIECE // 2), len(own) - PIECE]
            out += [(name, " ".join(own[s : s + PIECE])) for s in starts]
    return out


TEMPLATES += licence_texts()
TEMPLATES += runs_of(licence_texts())


class Matcher:
    """Templates as numbers of bigrams; scores texts."""

    def __init__(self, templates: list[tuple[str, str]], threshold: float):
        self.threshold, self.ratio = threshold, threshold / (2 - threshold)
        self.names = [name for name, _ in templates]
        split = [words(text) for _, text in templates]
        self.word = {w: i for i, w in enumerate(sorted({w for ws in split for w in ws}))}
        codes = [self._pairs(np.array([self.word[w] for w in ws], np.int64)) for ws in split]
        self.length = np.array([len(c) for c in codes])  # bigrams of a passage
        self.bigrams = np.unique(np.concatenate(codes))
        own = [np.searchsorted(self.bigrams, np.unique(c)) for c in codes]
        self.size = np.array([len(x) for x in own])
        self.inside = np.zeros((len(own), len(self.bigrams) + 1), bool)  # the last column: a bigram of no template
        for t, x in enumerate(own):
            self.inside[t, x] = True
        owner, bigram = np.nonzero(self.inside[:, :-1])
        order = np.argsort(bigram, kind="stable")
        self.templates = owner[order]
        self.first = np.searchsorted(bigram[order], np.arange(len(self.bigrams) + 1))
        self.few = self.size[self.size > 0].min() * self.ratio

    def _pairs(self, numbers: np.ndarray) -> np.ndarray:
        """Codes of pairs of neighbouring words; -1 if a word is in no template."""
        left, right = numbers[:-1], numbers[1:]
        return np.where((left < 0) | (right < 0), -1, left * len(self.word) + right)

    def best(self, text: str | None) -> tuple[str | None, float | None, int]:
        own = words(text)
        if len(own) < 2:
            return None, None, 0
        codes = self._pairs(np.fromiter((self.word.get(w, -1) for w in own), np.int64, len(own)))
        place = np.minimum(np.searchsorted(self.bigrams, codes), len(self.bigrams) - 1)
        place = np.where(self.bigrams[place] == codes, place, len(self.bigrams))
        known = np.unique(place[place < len(self.bigrams)])
        if len(known) < self.few:
            return None, None, 0
        lists = [self.templates[self.first[k] : self.first[k + 1]] for k in known.tolist()]
        shared = np.bincount(np.concatenate(lists), minlength=len(self.size))
        near = np.flatnonzero((shared >= self.ratio * self.size) & (self.size > 0))
        if not len(near):
            return None, None, 0
        numbers: dict[str, int] = {}
        every = np.fromiter((numbers.setdefault(w, len(numbers)) for w in own), np.int64, len(own))
        pair = every[:-1] * len(numbers) + every[1:]
        order = np.argsort(pair, kind="stable")
        again = pair[order][1:] == pair[order][:-1]
        before = np.full(len(pair), -1)  # where the same bigram was last
        before[order[1:][again]] = order[:-1][again]
        found: dict[str, float] = {}
        for t in near.tolist():
            score = self._highest(place, before, t)
            if score >= self.threshold:
                found[self.names[t]] = max(score, found.get(self.names[t], 0.0))
        if not found:
            return None, None, 0
        top = max(found.values())
        return min(n for n, v in found.items() if v == top), top, len(found)

    def _highest(self, place: np.ndarray, before: np.ndarray, t: int) -> float:
        """The best score of a template over all passages of the text."""
        n, length = len(place), int(self.length[t])
        starts = max(n - length, 0) + 1
        at = np.arange(n)
        low = np.maximum(np.maximum(before + 1, at - length + 1), 0)  # passages from here to `at` have it last there
        counts = []
        for some in (self.inside[t, place], slice(None)):
            change = np.bincount(low[some], minlength=n + 1) - np.bincount(at[some] + 1, minlength=n + 1)
            counts.append(np.cumsum(change)[:starts])
        return float((2 * counts[0] / (counts[1] + self.size[t])).max())


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, license, dice, n_licenses. No shuffle: each row is compared with the constant templates."""
    matcher = docs.sparkSession.sparkContext.broadcast(Matcher(TEMPLATES if templates is None else templates, threshold))
    picked = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = matcher.value.best
        for batch in batches:
            found = [best(text) for text in batch.column(1).to_pylist()]
            names, scores, counts = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(counts, pa.int64())], names=["id", "license", "dice", "n_licenses"])

    made = picked.mapInArrow(run, f"id {picked.schema['id'].dataType.simpleString()}, license string, dice double, n_licenses long")
    return made.select(F.col("id").alias(id_col), "license", F.round("dice", 6).alias("dice"), "n_licenses")


def oracle(templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD) -> str:
    """The same rows in DuckDB's SQL: sums of comings and goings of distinct bigrams by start."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({quote(a)}, {quote(b)})" for a, b in (TEMPLATES if templates is None else templates))
    split = lambda c: f"list_filter(string_split_regex(lower({c}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
    pairs = "list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])"
    ratio = threshold / (2 - threshold)
    return f"""
        with v as (select row_number() over () as t, license, {split('notice')} as w from (values {values}) v(license, notice)),
        t as (select t, license, greatest(len(w) - 1, 0) as pairs, {pairs} as pb from v),
        tb as materialized (select distinct t, unnest(pb) as b from t),
        size as (select t, license, any_value(pairs) as pairs, count(*) as n from t join tb using (t) group by 1, 2),
        d as materialized (select row_number() over () as r, doc_id, {split("coalesce(text, '')")} as w from documents),
        x as (select r, greatest(len(w) - 1, 0) as pairs, {pairs} as pb from d),
        p as materialized (select r, b, i, coalesce(lag(i) over (partition by r, b order by i), -1) as before from (select r, unnest(pb) as b, unnest(range(0, pairs)) as i from x)),
        near as (select r, t, license, size.pairs, n, greatest(x.pairs - size.pairs, 0) as latest from (select r, t, count(*) as shared from (select distinct r, b from p) join tb using (b) group by 1, 2) join size using (t) join x using (r) where shared >= {ratio} * n),
        e as (select near.r, near.t, greatest(before + 1, i - pairs + 1, 0) as low, i + 1 as high, case when tb.b is null then 0 else 1 end as own from near join p using (r) left join tb on tb.t = near.t and tb.b = p.b),
        c as (select r, t, s, sum(change) as d, sum(change * own) as o from (select r, t, low as s, 1 as change, own from e union all select r, t, high, -1, own from e) group by 1, 2, 3),
        u as (select r, t, s, sum(d) over z as every, sum(o) over z as shared from c window z as (partition by r, t order by s)),
        m as (select r, license, max(2.0 * shared / (every + n)) as dice from u join near using (r, t) where s <= latest group by 1, 2 having max(2.0 * shared / (every + n)) >= {threshold}),
        g as (select r, count(*) as n, max(dice) as dice from m group by r),
        l as (select m.r, min(license) as license from m join g using (r) where m.dice = g.dice group by m.r)
        select d.doc_id, l.license, round(g.dice, 6) as dice, coalesce(g.n, 0) as n_licenses from d left join g using (r) left join l using (r)"""
