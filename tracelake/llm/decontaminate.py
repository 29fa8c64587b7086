"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

A test item of n distinct shingles is contained in a document when at least need = ceil(threshold * n) of them occur
there, so at most n - need are missing and one of its n - need + 1 smallest MinHash values *must* be among the
document's.  That bottom-k sketch is all that is indexed of an item: no contained item is lost, however long the
document.  Items are partitioned by size; a partition is skipped for documents that are too small to contain its
smallest item, and only document shingles below the partition's largest sketch value are looked up.

Items of up to ``BLOCK_BYTES`` bytes of text are one index that goes to every task.  More items stay tables: their sketch
values' upper halves go to every task as a filter, document shingles that pass it are joined with the sketches, and the
pairs found are confirmed on their texts.  Either way documents are read once or twice, however many items there are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.shared import Scratch, if_small, small_batches, table
from tracelake.llm.vectext import SHINGLE_WORDS, buffers, shingle_rows, signed

#: Items of up to so many bytes of text (measured) are broadcast as one index.
BLOCK_BYTES = 16 << 20
#: Upper halves of sketch values are broadcast, so many bytes of them at a time.
FILTER_BYTES = 64 << 20
PERCENT = 80
OUT = "doc_id long, item_id long, item_shingles long, shared_shingles long, containment double"

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


def exact_shingles(text: str | None, size: int) -> set[tuple[str, ...]]:
    words = _WORD.findall((text or "").translate(_LOWER))
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


class ContainmentIndex:
    """Bottom-k sketches of items, partitioned by powers of two of their shingle counts."""

    def __init__(self, items: list[tuple[int, str]], size: int, percent: int):
        self.size, self.percent, self.items, self.sets = size, percent, [], []
        raw, offsets = buffers(pa.array([t or "" for _, t in items], pa.large_string()))
        parts: dict[int, list[tuple[np.ndarray, int]]] = {}
        for i, runs, _ in shingle_rows(raw, offsets, size):
            own = np.unique(runs)
            if n := len(own):
                k = n - self.need(n) + 1
                parts.setdefault(n.bit_length(), []).append((own[:k], len(self.items)))
                self.items.append(items[i])
                self.sets.append(own)
        self.parts = []
        for sketches in parts.values():
            values = np.concatenate([s for s, _ in sketches])
            owner = np.concatenate([np.full(len(s), i) for s, i in sketches])
            order = np.argsort(values, kind="stable")
            self.parts.append((min(self.need(len(self.sets[i])) for _, i in sketches), values[order], owner[order]))

    def need(self, n: int) -> int:
        return -(-self.percent * n // 100)

    def candidates(self, own: np.ndarray) -> set[int]:
        found: set[int] = set()
        for least, values, owner in self.parts:
            if len(own) < least:
                continue
            probe = own[: np.searchsorted(own, values[-1], side="right")]
            lo, hi = np.searchsorted(values, probe, side="left"), np.searchsorted(values, probe, side="right")
            for a, b in zip(lo[hi > lo], hi[hi > lo], strict=True):
                found.update(owner[a:b].tolist())
        return found

    def contained(self, own: np.ndarray, text: str) -> Iterator[tuple[int, int, int]]:
        """(item_id, item's shingles, shared shingles), confirmed on the words themselves."""
        exact = None
        for i in sorted(self.candidates(own)):
            n = len(self.sets[i])
            if np.isin(self.sets[i], own, assume_unique=True).sum() < self.need(n):
                continue
            exact = exact_shingles(text, self.size) if exact is None else exact
            mine = exact_shingles(self.items[i][1], self.size)
            if len(mine & exact) >= self.need(len(mine)):
                yield self.items[i][0], len(mine), len(mine & exact)


def _index(items: DataFrame, size: int, percent: int, block_bytes: int):
    """The broadcast index of ``items`` (item, text), or None where they are too large for one."""
    small_batches(items.sparkSession)
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if total > block_bytes:
        return None
    return items.sparkSession.sparkContext.broadcast(ContainmentIndex([(r.item, r.text) for r in items.collect()], size, percent))


def _sketches(size: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, values = [], []
            for i, runs, _ in shingle_rows(*buffers(batch.column(1)), size):
                own = np.unique(runs)
                if len(own):
                    values.append(own[: len(own) + percent * -len(own) // 100 + 1])
                    keys.append(np.full(len(values[-1]), i))
            at = pa.array(np.concatenate(keys)) if keys else pa.array([], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array(signed(np.concatenate(values)) if values else np.zeros(0, np.int64))], names=["ikey", "value"])

    return run


def _passing(tops, size: int):
    """Shingles of texts (tkey, text) whose upper half is among the sorted ``tops``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = tops.value
        for batch in batches:
            keys, values = [], []
            for i, runs, _ in shingle_rows(*buffers(batch.column(1)), size):
                top = (runs >> np.uint64(32)).astype(np.uint32)
                at = np.minimum(np.searchsorted(known, top), len(known) - 1)
                hit = runs[known[at] == top]
                if len(hit):
                    values.append(np.unique(hit))
                    keys.append(np.full(len(values[-1]), i))
            at = pa.array(np.concatenate(keys)) if keys else pa.array([], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array(signed(np.concatenate(values)) if values else np.zeros(0, np.int64))], names=["tkey", "value"])

    return run


def _confirmed(size: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for i, (text, item) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                mine = exact_shingles(item.as_py(), size)
                shared = len(mine & exact_shingles(text.as_py(), size))
                if 100 * shared >= percent * len(mine):
                    kept.append((i, len(mine), shared))
            at, n, shared = (pa.array(list(x), pa.int64()) for x in (list(zip(*kept, strict=True)) or [[]] * 3))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), n, shared], names=["tkey", "ikey", "n", "shared"])

    return run


def contained_pairs(texts: DataFrame, items: DataFrame, size: int, percent: int, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """(tkey, ikey, n, shared) of the different texts of ``texts`` (tkey, text) and ``items`` (ikey, text) of which the one contains the other."""
    keep = Scratch(texts.sparkSession, "contained")
    named = keep.write(items.where("text is not null").select("ikey", "text").dropDuplicates(["ikey"]), "items")
    sketch = keep.write(named.mapInArrow(_sketches(size, percent), "ikey string, value long"), "sketches")
    tops = keep.write(sketch.select(F.shiftrightunsigned("value", 32).alias("top")).distinct(), "tops")
    rounds = -(-4 * tops.count() // filter_bytes) or 1
    hits = None
    for k in range(rounds):
        own = np.sort(np.asarray(tops.where(F.pmod("top", F.lit(rounds)) == k).toArrow().column(0)).astype(np.uint32))
        if not len(own):
            continue
        held = texts.sparkSession.sparkContext.broadcast(own)
        found = keep.write(texts.select("tkey", "text").mapInArrow(_passing(held, size), "tkey string, value long").distinct(), f"passing{k}")
        held.unpersist()
        hits = found if hits is None else hits.unionByName(found)
    if hits is None:
        hits = texts.sparkSession.createDataFrame([], "tkey string, value long")
    pairs = keep.write(hits.join(sketch, "value").select("tkey", "ikey").distinct(), "pairs")
    known = keep.write(texts.join(if_small(pairs.select("tkey").distinct(), 80), "tkey", "left_semi").select("tkey", "text").dropDuplicates(["tkey"]), "texts")
    both = pairs.join(known, "tkey").join(named.withColumnRenamed("text", "item"), "ikey").select("tkey", "ikey", "text", "item")
    out = keep.write(both.mapInArrow(_confirmed(size, percent), "tkey string, ikey string, n long, shared long"), "found")
    keep.keep_only("found")
    return out


def _asked(items: DataFrame, item_col: str, item_text: str) -> DataFrame:
    return items.select(F.col(item_col).cast("long").alias("item"), F.col(item_text).cast("string").alias("text"))


def keep_clean(docs: DataFrame, items: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", size: int = SHINGLE_WORDS, percent: int = PERCENT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` that contain no item, with all their columns; null and empty texts contain nothing."""
    asked = _asked(items, item_col, item_text)
    index = _index(asked, size, percent, block_bytes)
    if index is None:
        key = F.md5(F.col(text_col).cast("string"))
        found = contained_pairs(docs.select(key.alias("tkey"), F.col(text_col).cast("string").alias("text")), asked.select(F.md5("text").alias("ikey"), "text"), size, percent)
        dirty = found.select(F.col("tkey").alias("_dirty")).distinct()
        return docs.join(if_small(dirty, 80), key == F.col("_dirty"), "left_anti").select(docs.columns)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = index.value
        for batch in batches:
            clean = np.ones(batch.num_rows, bool)
            raw, offsets = buffers(batch.column(at))
            for i, runs, _ in shingle_rows(raw, offsets, size):
                if len(runs) and next(held.contained(np.unique(runs), batch.column(at)[i].as_py()), None):
                    clean[i] = False
            yield batch.filter(pa.array(clean))

    return docs.mapInArrow(run, docs.schema)


def contaminated(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", size: int = SHINGLE_WORDS, percent: int = PERCENT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row (doc_id, item_id, item_shingles, shared_shingles, containment) per document row and item it contains.

    Null, empty and white-space texts contain nothing and are contained in nothing; a text of fewer than ``size`` words
    is one shingle.  Null ids stay null; repeated rows give repeated results; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    asked = _asked(items, item_col, item_text)
    index = _index(asked, size, percent, block_bytes)
    if index is None:
        keyed, named = rows.withColumn("tkey", F.md5("text")), asked.withColumn("ikey", F.md5("text"))
        found = if_small(contained_pairs(keyed, named, size, percent), 100)
        return keyed.select("doc_id", "tkey").join(found, "tkey").join(named.select("item", "ikey"), "ikey").select("doc_id", F.col("item").alias("item_id"), F.col("n").alias("item_shingles"), F.col("shared").alias("shared_shingles"), (F.col("shared") / F.col("n")).alias("containment"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = index.value
        for batch in batches:
            found = []
            raw, offsets = buffers(batch.column(1))
            for i, runs, _ in shingle_rows(raw, offsets, size):
                if not len(runs):
                    continue
                for item, n, shared in held.contained(np.unique(runs), batch.column(1)[i].as_py()):
                    found.append((batch.column(0)[i].as_py(), item, n, shared, shared / n))
            cols = list(zip(*found, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["doc_id", "item_id", "item_shingles", "shared_shingles", "containment"])

    return rows.mapInArrow(search, OUT)


def op8_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    """Every document with every benchmark item that it contains."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_A, _Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Distinct shingles of a text column, as SQL.
SHINGLES_SQL = rf"""list_distinct(list_transform(range(1, greatest(len(w) - {SHINGLE_WORDS - 1}, least(len(w), 1)) + 1), lambda i: array_to_string(w[i:i + {SHINGLE_WORDS - 1}], ' ')))"""
WORDS_SQL = rf"""regexp_extract_all(translate(coalesce(text, ''), '{_A}', '{_Z}'), '[^\x20\x09-\x0D]+')"""
OP8_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, {WORDS_SQL} AS w FROM documents),
i AS (SELECT row_number() OVER () AS j, item_id, {WORDS_SQL} AS w FROM benchmark),
ds AS (SELECT k, unnest({SHINGLES_SQL}) AS g FROM d),
il AS (SELECT j, item_id, {SHINGLES_SQL} AS s FROM i),
it AS (SELECT j, unnest(s) AS g FROM il),
c AS (SELECT k, j, count(*) AS shared FROM ds JOIN it USING (g) GROUP BY k, j)
SELECT doc_id, item_id, len(s)::BIGINT AS item_shingles, shared::BIGINT AS shared_shingles, shared::DOUBLE / len(s) AS containment
FROM c JOIN d USING (k) JOIN il USING (j) WHERE 100 * shared >= {PERCENT} * len(s)
"""
