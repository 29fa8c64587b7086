"""License scans: an exact set-similarity join between text blocks and license templates.

A block is a run of consecutive words, ``length`` of them: a quarter more than the template has, so notices that wrap over
lines are found and long texts do not match by chance.  Templates are sets of words, ordered by the number of documents of
the whole corpus that have each word, rarest first.  A block with at least ``need = ceil(threshold * |T|)`` words of T

* has one of T's ``|T| - need + 1`` rarest words (prefix filter; an index of those words names the templates to look at),
* lies in a stretch around that word that has ``need`` different words of T (length filter), and
* if the rarest word of T that the stretch has is T's p-th, p + need <= |T| (positional filter),

so blocks that fail a filter cannot match and all others are counted in full: no block is missed.  Templates of other
labels that T could be taken for make the words that T has and they lack necessary, and a block of T that lies within a
matching block of a template with all of T's words and more gives no label: of a family, the most special notice counts.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.shared import table
from tracelake.llm.vectext import buffers, pieces, span_hashes, word_spans

PERCENT = 80
#: Base phrases and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Notices that the method looks for, and their labels.
TEMPLATES = (
    ("all rights reserved", "reserved"),
    ("licensed under cc by 4 0", "cc-by"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("licensed under cc by nd 4 0", "cc-by-nd"),
    ("licensed under cc by nc sa 4 0", "cc-by-nc-sa"),
    ("licensed under cc by nc nd 4 0", "cc-by-nc-nd"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("licensed under the apache license version 2 0", "apache"),
    ("you may not use this file except in compliance with the license", "apache"),
    ("this work is licensed under the gnu general public license version 3", "gpl"),
    ("you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("you can redistribute it and or modify it under the terms of the gnu lesser general public license", "lgpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
)
_INSIDE = np.zeros(256, bool)
_INSIDE[48:58] = _INSIDE[65:91] = _INSIDE[97:123] = _INSIDE[128:] = True


def _hash_words(words: list[str]) -> np.ndarray:
    raw, offsets = buffers(pa.array(words, pa.large_string()))
    return span_hashes(raw, offsets[:-1], offsets[1:])


def rules(templates: tuple[tuple[str, str], ...], percent: int) -> list[tuple[str, set[str], int, int, set[str], list[int]]]:
    """For each template: its label, words, how many of them a block needs, the block's length, necessary words, and the templates that have all its words and more."""
    sets = [set(t.split()) for t, _ in templates]
    out = []
    for own, (text, label) in zip(sets, templates, strict=True):
        need = -(-percent * len(own) // 100)
        necessary = set().union(*[own - x for x, (_, other) in zip(sets, templates, strict=True) if other != label and len(own & x) >= need])
        out.append((label, own, need, -(-5 * len(text.split()) // 4), necessary, [k for k, x in enumerate(sets) if own < x]))
    return out


class TemplateIndex:
    """Templates with words in global order, and for each prefix word the templates that it leads to."""

    def __init__(self, templates: tuple[tuple[str, str], ...], frequency: dict[str, int], percent: int):
        self.rules = rules(templates, percent)
        words = sorted({w for _, own, *_ in self.rules for w in own})
        codes = _hash_words(words)
        order = np.argsort(codes)
        #: Hashes of all words of templates; a word's number is its place here.
        self.codes = codes[order]
        number = {words[k]: i for i, k in enumerate(order)}
        self.leads: dict[int, list[int]] = defaultdict(list)
        self.rank: list[dict[int, int]] = []
        self.necessary: list[set[int]] = []
        for t, (_, own, need, _, necessary, _) in enumerate(self.rules):
            ordered = [number[w] for w in sorted(own, key=lambda w: (frequency.get(w, 0), w))]
            self.rank.append({w: i for i, w in enumerate(ordered)})
            self.necessary.append({number[w] for w in necessary})
            for w in ordered[: len(ordered) - need + 1]:
                self.leads[w].append(t)
        self.prefix = np.zeros(len(words), bool)
        self.prefix[list(self.leads)] = True

    def numbers(self, h: np.ndarray) -> np.ndarray:
        """The number of each word of a text, -1 for words of no template."""
        if not len(self.codes):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.codes, h), len(self.codes) - 1)
        return np.where(self.codes[at] == h, at, -1)

    def blocks(self, text: np.ndarray) -> dict[int, dict[int, int]]:
        """For each template the starts of all matching blocks of a text, with the number of words that they share."""
        found: dict[int, dict[int, int]] = {}
        looked: dict[int, int] = {}
        for w in np.flatnonzero((text >= 0) & self.prefix[text]).tolist():
            for t in self.leads[int(text[w])]:
                _, own, need, length, _, _ = self.rules[t]
                last = max(0, len(text) - length)
                first, stop = max(looked.get(t, 0), w - length + 1), min(w, last) + 1  # starts of the blocks that have this word
                if first >= stop:
                    continue
                looked[t] = stop
                rank = self.rank[t]
                near = [rank.get(x) for x in text[first : stop - 1 + length].tolist()]
                have = set(near) - {None}
                if len(have) < need or min(have) + need > len(own):
                    continue
                self._slide(t, near, first, stop, found)
        return found

    def _slide(self, t: int, near: list, first: int, stop: int, found: dict) -> None:
        _, _, need, length, _, _ = self.rules[t]
        necessary = {self.rank[t][w] for w in self.necessary[t]}
        seen = Counter(x for x in near[:length] if x is not None)
        for s in range(first, stop):
            if s > first:
                gone, come = near[s - first - 1], near[s - first - 1 + length] if s - first - 1 + length < len(near) else None
                if gone is not None:
                    seen[gone] -= 1
                    if not seen[gone]:
                        del seen[gone]
                if come is not None:
                    seen[come] += 1
            if len(seen) >= need and necessary <= seen.keys():
                found.setdefault(t, {})[s] = len(seen)

    def labels(self, text: np.ndarray) -> tuple[set[str], float]:
        """The labels of a text (numbers of its words), and the largest containment among the blocks that give them."""
        found = self.blocks(text)
        out, best = set(), 0.0
        for t, starts in found.items():
            label, own, _, length, _, wider = self.rules[t]
            covers = [(sorted(found[x]), self.rules[x][3]) for x in wider if x in found]
            for s, shared in starts.items():
                end = min(len(text), s + length)
                # of a wider template's blocks the last one that begins no later reaches farthest
                if not any((k := bisect_right(at, s)) and min(len(text), at[k - 1] + size) >= end for at, size in covers):
                    out.add(label)
                    best = max(best, shared / len(own))
        return out, best


def word_documents(docs: DataFrame, words: list[str], text_col: str = "text") -> dict[str, int]:
    """For each of these words, how many rows of the whole table have it."""
    codes = _hash_words(words)
    order = np.argsort(codes)
    known = codes[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(known), np.int64)
        for batch in batches:
            raw, offsets = buffers(batch.column(0))
            for a, b in pieces(offsets):
                part = offsets[a : b + 1]
                starts, ends, first = word_spans(raw, part, _INSIDE)
                h = span_hashes(raw[int(part[0]) : int(part[-1])], starts, ends)
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                hit = np.flatnonzero(known[at] == h)
                row = np.searchsorted(first, hit, side="right") - 1
                pair = np.unique(row * len(known) + at[hit])
                total += np.bincount(pair % len(known), minlength=len(known))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(known))), pa.array(total)], names=["k", "n"])

    got = docs.select(F.col(text_col).cast("string")).mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()
    return {words[order[r.k]]: r.n for r in got}


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", templates: tuple[tuple[str, str], ...] = TEMPLATES, phrases: tuple[tuple[str, str], ...] = PHRASES, percent: int = PERCENT) -> DataFrame:
    """Per row: its words, the places of base phrases, and the labels of all templates that one of its blocks contains.

    ``score`` is the largest containment of a template that gives a label, 0 without one.  Null, empty and
    word-less texts have no places, no labels ('') and score 0; ids may be null or repeated; other columns are ignored.
    """
    frequency = word_documents(docs, sorted({w for t, _ in templates for w in t.split()}), text_col)
    index = docs.sparkSession.sparkContext.broadcast(TemplateIndex(templates, frequency, percent))
    coded = [(_hash_words(p.split()), label) for p, label in phrases]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = index.value
        for batch in batches:
            raw, offsets = buffers(batch.column(1))
            rows = batch.num_rows
            n_words, n_base = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
            lo, hi = np.full(rows, np.iinfo(np.int64).max), np.full(rows, -1)
            base: list[set[str]] = [set() for _ in range(rows)]
            more: list[set[str]] = [set() for _ in range(rows)]
            score = np.zeros(rows)
            for a, b in pieces(offsets):
                part = offsets[a : b + 1]
                data = raw[int(part[0]) : int(part[-1])]
                starts, ends, first = word_spans(raw, part, _INSIDE)
                h = span_hashes(data, starts, ends)
                n_words[a:b] = np.diff(first)
                for code, label in coded:
                    if len(h) < len(code):
                        continue
                    hit = h[: len(h) - len(code) + 1] == code[0]
                    for k in range(1, len(code)):
                        hit &= h[k : len(h) - len(code) + 1 + k] == code[k]
                    at = np.flatnonzero(hit)
                    row = np.searchsorted(first, at, side="right") - 1
                    inside = at + len(code) <= first[row + 1]
                    at, row = at[inside], row[inside]
                    np.add.at(n_base, a + row, 1)
                    np.minimum.at(lo, a + row, at - first[row])
                    np.maximum.at(hi, a + row, at - first[row])
                    for r in set(row.tolist()):
                        base[a + r].add(label)
                numbers = held.numbers(h)
                near = np.flatnonzero((numbers >= 0) & held.prefix[numbers]) if len(held.prefix) else []
                for r in np.unique(np.searchsorted(first, near, side="right") - 1).tolist():
                    more[a + r], score[a + r] = held.labels(numbers[first[r] : first[r + 1]])
            none = n_base == 0
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words), pa.array(n_base), pa.array(lo, mask=none), pa.array(hi, mask=none), pa.array([",".join(sorted(x)) for x in base], pa.string()), pa.array([",".join(sorted(x | y)) for x, y in zip(base, more, strict=True)], pa.string()), pa.array(score)],
                names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def op3_license_scan(spark, sf_dir: str) -> DataFrame:
    """License places and labels of every document."""
    return scan(table(spark, sf_dir, "documents"))


_A, _Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_P = ", ".join(f"([{', '.join(repr(w) for w in p.split())}], '{label}')" for p, label in PHRASES)
_RULES = rules(TEMPLATES, PERCENT)
_LIST = lambda words: "[" + ", ".join(repr(w) for w in sorted(words)) + "]::VARCHAR[]"
_T = ", ".join(f"({k}, {_LIST(own)}, {need}, {length}, {_LIST(necessary)}, '{label}')" for k, (label, own, need, length, necessary, _) in enumerate(_RULES))
_WIDER = ", ".join(f"({k}, {x})" for k, r in enumerate(_RULES) for x in r[5])
OP3_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, translate(coalesce(text, ''), '{_A}', '{_Z}') AS t FROM documents),
w AS (SELECT k, doc_id, regexp_extract_all(t, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM d),
p(words, label) AS (VALUES {_P}),
x AS (SELECT k, label, unnest(list_filter(range(1, len(w) + 1), lambda i: w[i:i + len(words) - 1] = words)) - 1 AS pos FROM w, p),
b AS (SELECT k, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list_distinct(list(label)) AS labels FROM x GROUP BY k),
m(t, words, need, size, necessary, label) AS (VALUES {_T}),
wider(t, x) AS (VALUES {_WIDER}),
c AS (SELECT k, w, m.* FROM w, m WHERE len(list_intersect(words, list_distinct(w))) >= need),
s AS (SELECT *, unnest(range(0, greatest(len(w) - size, 0) + 1)) AS s FROM c),
v AS (SELECT k, t, label, len(words) AS n, s, least(s + size, len(w)) AS e, len(list_intersect(words, w[s + 1:s + size])) AS shared FROM s WHERE len(list_intersect(words, w[s + 1:s + size])) >= need AND list_has_all(w[s + 1:s + size], necessary)),
j AS (SELECT k, label, shared::DOUBLE / n AS share FROM v WHERE NOT EXISTS (SELECT 1 FROM wider JOIN v AS o ON o.t = wider.x WHERE wider.t = v.t AND o.k = v.k AND o.s <= v.s AND o.e >= v.e)),
g AS (SELECT k, max(share) AS score, list_distinct(list(label)) AS labels FROM j GROUP BY k)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(array_to_string(list_sort(b.labels), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(g.labels, [])))), ','), '') AS labels,
       coalesce(score, 0)::DOUBLE AS score
FROM w LEFT JOIN b USING (k) LEFT JOIN g USING (k)
"""
