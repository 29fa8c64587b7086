"""Quality rules as a short-circuit cascade.

Every rule rejects or passes a text.  On a sample the cost (time a row) and the selectivity (share rejected) of each
rule are measured; rules then run in the order of rejections per cost, each only on the rows that all earlier ones
passed.  The order changes the work, never the verdict: a text is kept if no rule rejects it.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.shared import small_batches, table
from tracelake.llm.vectext import FOLDED, SPACE_SPLIT, buffers, mix64, pieces, span_hashes, window_hashes, word_spans

#: Cost and selectivity are estimated on about so many rows; they only set the order of the rules.
SAMPLE_ROWS = 2_000
#: The characters counted as symbols.
SYMBOLS = b"#*$%&|<>"

_CASED = FOLDED.copy()
_CASED[65:91] = mix64(np.arange(65, 91, dtype=np.uint64) + np.uint64(1 << 40))
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER_CASE = np.zeros(256, bool)
_LOWER_CASE[97:123] = True


class Texts:
    """A piece of an Arrow text column; what rules need is worked out once, when first asked for."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        self.raw = raw[int(offsets[0]) : int(offsets[-1])]
        self.offsets = offsets - offsets[0]
        self.rows = len(offsets) - 1
        self._spans = self._hashes = None

    def only(self, rows: np.ndarray) -> Texts:
        size = np.diff(self.offsets)[rows]
        offsets = np.concatenate([[0], np.cumsum(size)])
        at = np.repeat(self.offsets[rows] - offsets[:-1], size) + np.arange(offsets[-1])
        return Texts(self.raw[at], offsets)

    @property
    def spans(self):
        if self._spans is None:
            self._spans = word_spans(self.raw, self.offsets)
        return self._spans

    def count(self, mask: np.ndarray) -> np.ndarray:
        return np.diff(np.searchsorted(np.flatnonzero(mask), self.offsets))

    def n_words(self) -> np.ndarray:
        return np.diff(self.spans[2])

    def word_chars(self) -> np.ndarray:
        return self.count(SPACE_SPLIT[self.raw] & ((self.raw & 0xC0) != 0x80))

    def n_symbols(self) -> np.ndarray:
        return self.count(_IS_SYMBOL[self.raw])

    def shouted(self) -> np.ndarray:
        """Words of four or more A-Z and no a-z."""
        starts, ends, first = self.spans
        if not len(starts):
            return np.zeros(self.rows, np.int64)
        up, low = (np.concatenate([[0], np.cumsum(m[self.raw])]) for m in (_UPPER, _LOWER_CASE))
        hit = (up[ends] - up[starts] >= 4) & (low[ends] == low[starts])
        return np.diff(np.concatenate([[0], np.cumsum(hit)])[first])

    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """(lines with a word, those of them equal to an earlier one)."""
        n, dup = np.zeros(self.rows, np.int64), np.zeros(self.rows, np.int64)
        data = self.raw.tobytes()
        for i in range(self.rows):
            own = [x for x in data[self.offsets[i] : self.offsets[i + 1]].split(b"\n") if x.strip()]
            n[i], dup[i] = len(own), len(own) - len(set(own))
        return n, dup

    def n_repeat_words(self, size: int = 3) -> np.ndarray:
        """Words in windows of ``size`` words that the text has twice or more, the first included."""
        starts, ends, first = self.spans
        words = span_hashes(self.raw, starts, ends, _CASED)
        runs = window_hashes(words, size)
        out = np.zeros(self.rows, np.int64)
        for i in range(self.rows):
            lo, hi = int(first[i]), int(first[i + 1])
            if hi - lo <= size:
                continue
            own = runs[lo : hi - size + 1]
            order = np.argsort(own, kind="stable")
            same = own[order][1:] == own[order][:-1]
            if not same.any():
                continue
            twice = np.zeros(len(own), bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            covered = np.zeros(hi - lo, bool)
            for k in range(size):
                covered[k : k + len(own)] |= twice
            out[i] = covered.sum()
        return out


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Texts], np.ndarray]


def _shouts(t: Texts) -> np.ndarray:
    return 100 * t.shouted() > 30 * t.n_words()


def _repeated_lines(t: Texts) -> np.ndarray:
    n, dup = t.lines()
    return (n >= 5) & (100 * dup > 50 * n)


def _word_length(t: Texts) -> np.ndarray:
    n, chars = t.n_words(), t.word_chars()
    return (chars < 3 * n) | (chars > 10 * n)


#: The base rules that every text must pass.
BASE = (
    Rule("few_words", lambda t: t.n_words() < 50),
    Rule("repeated_words", lambda t: 100 * t.n_repeat_words() > 50 * t.n_words()),
)
#: The rules that the cascade adds.
ADDED = (
    Rule("symbols", lambda t: 100 * t.n_symbols() > 10 * t.n_words()),
    Rule("shouting", _shouts),
    Rule("repeated_lines", _repeated_lines),
    Rule("word_length", _word_length),
)


def order_rules(docs: DataFrame, rules: tuple[Rule, ...], text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """``rules`` by rejections per nanosecond among the rows that the rules before them leave.

    Measured on about ``sample_rows`` rows spread over the whole table: the time of each rule, and which sets of rules
    reject how many rows.  Ties keep the given order, as does an empty table.
    """
    small_batches(docs.sparkSession)
    total = docs.count()
    if not total:
        return list(rules)
    sample = docs.select(F.col(text_col).cast("string")).sample(min(1.0, sample_rows / total), seed=17)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(k, n): nanoseconds of rule k for k < 0 (as -1 - k), else rows that just the rules in the bits of k reject."""
        spent, sets = [0] * len(rules), Counter()
        for batch in batches:
            raw, offsets = buffers(batch.column(0))
            for a, b in pieces(offsets):
                bits = np.zeros(b - a, np.int64)
                for k, rule in enumerate(rules):
                    t = Texts(raw, offsets[a : b + 1])
                    began = time.perf_counter_ns()
                    bad = rule.rejects(t)
                    spent[k] += time.perf_counter_ns() - began
                    bits |= bad.astype(np.int64) << k
                sets.update(bits.tolist())
        yield pa.RecordBatch.from_arrays([pa.array([*range(-len(rules), 0), *sets], pa.int64()), pa.array([*spent[::-1], *sets.values()], pa.int64())], names=["k", "n"])

    got = {r.k: r.n for r in sample.mapInArrow(measure, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()}
    left, out = set(range(len(rules))), []
    while left:
        open_ = {k: n for k, n in got.items() if k >= 0 and not any(k >> r & 1 for r in out)}
        gain = {r: (sum(n for k, n in open_.items() if k >> r & 1) + 0.5) / max(1, got.get(-1 - r, 0)) for r in left}
        out.append(max(sorted(left), key=lambda r: gain[r]))
        left.discard(out[-1])
    return [rules[k] for k in out]


def passes(t: Texts, rules: list[Rule], among: np.ndarray | None = None) -> np.ndarray:
    """Which rows no rule rejects; each rule sees only the rows that are still in."""
    rows = np.arange(t.rows) if among is None else np.flatnonzero(among)
    here = t if among is None else t.only(rows)
    for rule in rules:
        if not len(rows):
            break
        bad = rule.rejects(here)
        if bad.any():
            rows = rows[~bad]
            here = here.only(np.flatnonzero(~bad))
    out = np.zeros(t.rows, bool)
    out[rows] = True
    return out


def keep_good(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = BASE + ADDED) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with all their columns; null and empty texts have no words and go."""
    ordered = order_rules(docs, rules, text_col)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = buffers(batch.column(at))
            kept = [passes(Texts(raw, offsets[a : b + 1]), ordered) for a, b in pieces(offsets)]
            yield batch.filter(pa.array(np.concatenate(kept) if kept else np.zeros(0, bool)))

    return docs.mapInArrow(run, docs.schema)


STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The base statistics of every row, ``base_failed``, and ``kept``: the verdict of the cascade on rows that did not fail."""
    ordered = order_rules(docs, ADDED, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = buffers(batch.column(1))
            parts = []
            for a, b in pieces(offsets):
                t = Texts(raw, offsets[a : b + 1])
                n, again = t.n_words(), t.n_repeat_words()
                failed = (n < 50) | (100 * again > 50 * n)
                parts.append((n, t.word_chars(), t.n_symbols(), t.lines()[1], again, failed, passes(t, ordered, ~failed)))
            cols = [np.concatenate(c) for c in zip(*parts, strict=True)] or [np.zeros(0, np.int64)] * 5 + [np.zeros(0, bool)] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, cols)], names=["doc_id", *STATS, "base_failed", "kept"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in STATS) + ", base_failed boolean, kept boolean")


def op4_quality_cascade(spark, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document."""
    return with_statistics(table(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
r AS (SELECT *, len(w) AS n, list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: w[i] || chr(10) || w[i + 1] || chr(10) || w[i + 2]) AS g FROM w),
u AS (SELECT *, row_number() OVER () AS k FROM r),
x AS (SELECT k, unnest(g) AS gram, unnest(range(1, len(g) + 1)) AS i FROM u),
y AS (SELECT k, i FROM x QUALIFY count(*) OVER (PARTITION BY k, gram) > 1),
z AS (SELECT k, count(DISTINCT p) AS n_repeat FROM (SELECT k, unnest([i, i + 1, i + 2]) AS p FROM y) GROUP BY k),
s AS (SELECT doc_id, n AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
             len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, len(l) AS n_lines,
             coalesce(n_repeat, 0) AS n_repeat_words,
             len(list_filter(w, lambda x: len(regexp_extract_all(x, '[A-Z]')) >= 4 AND NOT regexp_matches(x, '[a-z]'))) AS shouted
      FROM u LEFT JOIN z USING (k)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT (base_failed OR 100 * n_symbols > 10 * n_words OR 100 * shouted > 30 * n_words OR (n_lines >= 5 AND 100 * n_dup_lines > 50 * n_lines)
            OR word_chars < 3 * n_words OR word_chars > 10 * n_words) AS kept
FROM f
"""
