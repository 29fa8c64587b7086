"""MinHash near-duplicate detection with tensored banding.

Two small collections of ``M`` half keys (``K`` MinHash values each) are drawn per document; a table key combines one
half key of either collection, so ``M * M`` tables cost only ``2 * M * K`` MinHash values.  Two documents of Jaccard
similarity s meet in some table with probability (1 - (1 - s**K)**M)**2: 0.99998 at 0.85 for M = 16, K = 4, and 0.0006 at 0.2.

1. Each document's distinct 5-word shingles become hashes (Arrow batches); equal sets collapse to their smallest id.
2. Half keys that only one set has are dropped before any pair of half keys is formed.
3. In the tables of the diagonal (the i-th half key of either collection) members are paired with a bucket's smallest id
   only (a star, never all pairs).  Pairs are confirmed on the full texts' shingle sets and give links; links give components.
4. Half keys, then tables of the whole square, whose members are all in one component are dropped.  Members of what is
   left may be linked across components: exact filters (prefixes by the sizes of both sets, then parities) leave the pairs
   that can be similar enough, and every one is confirmed.  No candidate is dropped, and passages or templates shared by
   otherwise different texts make no pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.components import connected_components
from tracelake.llm.decontaminate import SHINGLES_SQL, WORDS_SQL
from tracelake.llm.shared import BROADCAST_BYTES, Scratch, if_small, small_batches, table, written
from tracelake.llm.vectext import SHINGLE_WORDS, buffers, mix64, shingle_rows, signed

M, K = 16, 4
PARITIES = 8  # longs of 64 bins each
SIDES = 1024  # a pivot's members are dealt over so many tasks at most
ROW = 32  # bytes of a row of a few numbers, for the sizes of broadcasts


def _signatures(size: int, m: int, k: int):
    n = 2 * m * k
    with np.errstate(over="ignore"):
        mult = mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)
        flip = mix64(mult)
        salt = mix64(np.arange(1, 2 * m + 1, dtype=np.uint64) * np.uint64(0xE7037ED1A0B428DB))
    side = np.repeat(np.array([0, 1], np.uint64), m)

    def half_keys(sets: list[np.ndarray]) -> np.ndarray:
        """The 2 * m half keys of each set; the lowest bit says which collection a half key is of."""
        every = np.concatenate(sets)
        cuts = np.cumsum([0] + [len(x) for x in sets[:-1]])
        low = np.empty((len(sets), n), np.uint64)
        for j in range(n):
            v = every ^ flip[j]
            v *= mult[j]
            low[:, j] = np.minimum.reduceat(v, cuts)
        key = np.broadcast_to(salt, (len(sets), 2 * m))
        for c in range(k):
            key = mix64(key ^ low.reshape(-1, 2 * m, k)[:, :, c])
        return (key & ~np.uint64(1)) | side

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = buffers(batch.column(1))
            rows = batch.num_rows
            count = np.zeros(rows, np.int64)
            prints = np.zeros((rows, 2), np.uint64)
            keys = np.zeros((rows, 2 * m), np.uint64)
            sets, at, held = [], [], 0
            with np.errstate(over="ignore"):
                for i, runs, _ in shingle_rows(raw, offsets, size):
                    if not len(runs):
                        continue
                    own = np.unique(runs)
                    count[i] = len(own)
                    prints[i, 0] = own.sum(dtype=np.uint64)
                    prints[i, 1] = mix64(own ^ np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64)
                    sets.append(own)
                    at.append(i)
                    held += len(own)
                    if held >= 100_000:
                        keys[at] = half_keys(sets)
                        sets, at, held = [], [], 0
                if sets:
                    keys[at] = half_keys(sets)
            flat = signed(keys.reshape(-1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(count), pa.array(signed(prints[:, 0])), pa.array(signed(prints[:, 1])), pa.ListArray.from_arrays(np.arange(0, 2 * m * (rows + 1), 2 * m, dtype=np.int32), pa.array(flat))],
                names=["id", "n_shingles", "f0", "f1", "half"],
            )

    return run


def _shingles(size: int):
    """Each text's shingles, and the parities of how many of them fall in each of 64 * PARITIES bins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(a, 256) for a in range(0, batch.num_rows, 256)):
                sets = [np.unique(runs) for _, runs, _ in shingle_rows(*buffers(part.column(1)), size)]
                bits = [np.packbits((np.bincount((x % np.uint64(64 * PARITIES)).astype(np.int64), minlength=64 * PARITIES) & 1).astype(bool)).view(np.int64) for x in sets]
                cuts = np.cumsum([0] + [len(x) for x in sets]).astype(np.int32)
                even = np.arange(0, PARITIES * (len(sets) + 1), PARITIES, dtype=np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(np.diff(cuts).astype(np.int64)), pa.ListArray.from_arrays(pa.array(cuts), pa.array(signed(np.concatenate(sets)))), pa.ListArray.from_arrays(pa.array(even), pa.array(np.concatenate(bits)))], names=["id", "component", "n", "shingles", "odd"])

    return run


def _confirm(size: int, percent: int):
    """Rows of one (pivot, side) come together, the pivot's own text first; yields the pairs whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, sets = None, []
        for batch in batches:
            pivots, sides, own, ids = (batch.column(c).to_pylist() for c in range(4))
            raw, offsets = buffers(batch.column(4))
            a, b = [], []
            for i, runs, _ in shingle_rows(raw, offsets, size):
                here = np.unique(runs)
                if (pivots[i], sides[i]) != group:
                    group, sets = (pivots[i], sides[i]), []
                if own[i] == 0:
                    sets.append(here)
                    continue
                for other in sets:
                    low, high = sorted((len(here), len(other)))
                    if low == 0 or 100 * low < percent * high:
                        continue
                    shared = len(np.intersect1d(here, other, assume_unique=True))
                    if 100 * shared >= percent * (low + high - shared):
                        a.append(pivots[i])
                        b.append(ids[i])
                        break
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def confirm_pairs(pairs: DataFrame, texts: DataFrame, size: int = SHINGLE_WORDS, percent: int = 85) -> DataFrame:
    """Of ``pairs`` (a, b) of ids in ``texts`` (id, text), those with 100 * intersection >= percent * union.

    ``pairs`` is a written table.  The members ``b`` of a pivot ``a`` are dealt over up to ``SIDES`` sides; each member's
    text travels once for each of its pivots, the pivot's once for each side, so a pivot with very many members is no
    single task's work.
    """
    dealt = pairs.withColumn("side", F.pmod(F.xxhash64("b"), F.lit(SIDES)))
    wanted = dealt.select(F.col("b").alias("id"), "a", "side", F.lit(1).alias("own")).unionByName(dealt.select(F.col("a").alias("id"), "a", "side", F.lit(0).alias("own")).distinct())
    few = 2 * pairs.count() * ROW <= BROADCAST_BYTES  # ``wanted`` is no table, counting it would make it twice
    rows = texts.join(F.broadcast(wanted) if few else wanted, "id").select("a", "side", "own", "id", "text")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "a", "side").sortWithinPartitions("a", "side", "own").mapInArrow(_confirm(size, percent), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, size: int = SHINGLE_WORDS, percent: int = 85, m: int = M, k: int = K) -> DataFrame:
    """(id_col, n_shingles, component_id, kept) for every row of ``docs``.

    Null, empty and white-space texts have no shingle and are linked with nothing.  A row with a null id gets a null
    component and is kept.  Rows that repeat an id share its component; the same id under different texts joins their
    links.  Other columns of ``docs`` are not looked at, whatever their names.  An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    keep = Scratch(docs.sparkSession, "near-dup")
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    texts = base.where("id is not null")
    sig = keep.write(base.mapInArrow(_signatures(size, m, k), "id long, n_shingles long, f0 long, f1 long, half array<long>"), "signatures")
    rows = keep.write(sig.drop("half"), "rows")
    some = sig.where("id is not null and n_shingles > 0")
    classes = keep.write(some.groupBy("f0", "f1", "n_shingles").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("half").alias("half")), "classes")
    keep.drop("signatures")
    copies = keep.write(classes.where("copies > 1").select("f0", "f1", "n_shingles", "rep"), "copies")
    member = rows.join(if_small(copies, ROW), ["f0", "f1", "n_shingles"], "left").select("id", "n_shingles", F.when(F.col("id").isNotNull() & (F.col("n_shingles") > 0), F.coalesce("rep", "id")).alias("rep"))
    member = keep.write(member, "member")
    keep.drop("rows", "copies")

    halves = classes.select(F.col("rep").alias("id"), F.posexplode("half").alias("at", "half"))
    common = keep.write(halves.groupBy("half").agg(F.count("*").alias("n")).where("n > 1").select("half"), "common")
    shared = keep.write(halves.join(if_small(common, ROW), "half"), "shared")
    keep.drop("common", "classes")

    # the diagonal's tables, by stars
    pairs = shared.withColumn("at", F.col("at") % m).groupBy("id", "at").agg(F.min("half").alias("l"), F.max("half").alias("r"), F.count("*").alias("n")).where("n = 2 and l <> r")
    keys = keep.write(pairs.select("id", F.xxhash64("at", "l", "r").alias("key")), "diagonal")
    pivots = keep.write(keys.groupBy("key").agg(F.min("id").alias("pivot"), F.max("id").alias("last")).where("pivot < last").select("key", "pivot"), "pivots")
    tried = keep.write(keys.join(if_small(pivots, ROW), "key").where("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct(), "tried")
    keep.drop("diagonal", "pivots")
    # rows of one id under several texts are one document
    several = keep.write(member.where("rep is not null").groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a <> b").select("id", "a"), "several")
    same = member.where("rep is not null").join(if_small(several, ROW), "id").select("a", F.col("rep").alias("b")).distinct()
    links = keep.write(same.unionByName(confirm_pairs(tried, texts, size, percent)), "links")
    labels = connected_components(links)
    keep.drop("tried", "several")

    left = across(shared, labels, m, keep)
    keep.drop("shared")
    if left.limit(1).count():
        more = keep.write(confirm_pairs(keep.write(prefix_pairs(left, texts, size, percent, keep), "pairs"), texts, size, percent), "more")
        if more.limit(1).count():
            labels = connected_components(links.unionByName(more))
    keep.keep_only("member")
    placed = member.join(if_small(labels, ROW), member.rep == labels.id, "left").select(member.id, "n_shingles", F.coalesce("component", "rep", member.id).alias("component"))
    return placed.select(F.col("id").alias(id_col), "n_shingles", F.col("component").alias("component_id"), (F.col("id").isNull() | (F.col("id") == F.col("component"))).alias("kept"))


def across(shared: DataFrame, labels: DataFrame, m: int, keep: Scratch) -> DataFrame:
    """(id, component) of the sets that meet a set of another component in some table.

    ``shared`` (id, at, half) has every half key that two sets have.  First half keys within one component go, then
    table keys; only sets with half keys of both collections left form table keys at all.
    """
    placed = keep.write(shared.join(if_small(labels, ROW), "id", "left").select("id", "half", F.coalesce("component", "id").alias("component")), "placed")
    mixed = keep.write(placed.groupBy("half").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("half"), "mixed")
    open_ = placed.join(if_small(mixed, ROW), "half").groupBy("id", "component").agg(F.collect_set("half").alias("half"))
    sides = open_.select("id", "component", F.filter("half", lambda h: h.bitwiseAND(1) == 0).alias("left"), F.filter("half", lambda h: h.bitwiseAND(1) == 1).alias("right"))
    keys = keep.write(sides.select("id", "component", F.explode("left").alias("l"), "right").select("id", "component", "l", F.explode("right").alias("r")).select("id", "component", F.xxhash64("l", "r").alias("key")), "square")
    tables = keep.write(keys.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key"), "tables")
    left = keep.write(keys.join(if_small(tables, ROW), "key").select("id", "component").distinct(), "left")
    keep.drop("placed", "mixed", "square", "tables")
    return left


def size_bands(most: int, ratio: float = 1.02) -> np.ndarray:
    """Lower ends of bands of set sizes: every size its own up to about 100, then steps of ``ratio``."""
    out = [1]
    while out[-1] <= most:
        out.append(max(out[-1] + 1, int(out[-1] * ratio)))
    return np.array(out)


def overlap(x, y, percent: int):
    """How many members sets of sizes x and y share at least, if 100 * intersection >= percent * union."""
    return -(-(x + y) * percent // (100 + percent))


def _prefixes(percent: int):
    """Rows of (id, n, component, shared shingles in global order) to one row for each prefix shingle and partner band.

    Sets of sizes x and y that are similar enough share one of the x - overlap(x, y) + 1 rarest shingles of the one and the
    y - overlap(x, y) + 1 rarest of the other.  As that depends on both sizes, a shingle is filed under both bands of
    sizes (``side``: 0 for sets of one band, else 1 from the lower and 2 from the higher one; 1 meets 2 only).  A template
    that many sets share is in none of these prefixes unless the sets are nearly similar enough.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = size_bands(1 << 10)
        for batch in batches:
            ids, sizes, components = (batch.column(c).to_pylist() for c in range(3))
            cuts, flat = batch.column(3).offsets.to_numpy(), np.asarray(batch.column(3).values).view(np.uint64)
            keys, owner, sides = [], [], []
            for i, n in enumerate(sizes):
                if bands[-1] <= 2 * n:
                    bands = size_bands(4 * n)
                own = np.searchsorted(bands, n, side="right") - 1
                lo = np.searchsorted(bands, -(-n * percent // 100), side="right") - 1
                hi = np.searchsorted(bands, n * 100 // percent, side="right") - 1
                mine = flat[cuts[i] : cuts[i + 1]]
                for band in range(lo, hi + 1):
                    least = max(int(bands[band]), -(-n * percent // 100))
                    first = n - overlap(n, least, percent) + 1 - (n - len(mine))  # those that no other set has come first
                    if first > 0:
                        low, high = min(own, band), max(own, band)
                        with np.errstate(over="ignore"):
                            keys.append(mix64(mine[:first] ^ mix64(np.uint64(low << 32 | high))))
                        owner.append(np.full(len(keys[-1]), i))
                        sides.append(np.full(len(keys[-1]), (own < band) + 2 * (own > band)))
            at = pa.array(np.concatenate(owner)) if owner else pa.array([], pa.int64())
            key = signed(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
            side = pa.array(np.concatenate(sides) if sides else np.zeros(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(key), side, *(batch.column(c).take(at) for c in (0, 1, 2, 4))], names=["key", "side", "id", "n", "component", "odd"])

    return run


def prefix_pairs(left: DataFrame, texts: DataFrame, size: int, percent: int, keep: Scratch) -> DataFrame:
    """All pairs (a, b) of ``left`` (id, component) in different components that can be similar enough.

    Exact filters.  Prefix: with shingles in one global order, rarest first, two sets that are similar enough share one of
    their first ones (``_prefixes``).  Only keys with several components are paired, and of those only rows outside the
    key's largest component with the rest, so a large component is never paired with itself.  Difference: sets of sizes
    x and y that are similar enough differ in at most (x + y) * (100 - percent) / (100 + percent) shingles, and each bin
    whose parity differs holds one of those.
    """
    sets = keep.write(texts.join(if_small(left, ROW), "id").select("id", "text", "component").mapInArrow(_shingles(size), "id long, component long, n long, shingles array<long>, odd array<long>"), "sets")
    one = ["id", "n", "odd"]  # an id may stand under several texts
    rows = sets.select("id", "n", F.xxhash64("odd").alias("odd"), F.explode("shingles").alias("h"))
    often = keep.write(rows.groupBy("h").agg(F.count("*").alias("df")).where("df > 1"), "often")
    ordered = rows.join(if_small(often, ROW), "h").groupBy(one).agg(F.transform(F.array_sort(F.collect_set(F.struct("df", "h"))), lambda x: x["h"]).alias("s"))
    prefix = keep.write(ordered.join(sets.select("id", "n", "component", F.xxhash64("odd").alias("odd"), F.col("odd").alias("bins")), one).select("id", "n", "component", "s", "bins").mapInArrow(_prefixes(percent), "key long, side long, id long, n long, component long, odd array<long>"), "prefixes")
    keep.drop("sets", "often")
    groups = prefix.groupBy("key", "component").agg(F.count("*").alias("rows"), F.min("side").alias("lo"), F.max("side").alias("hi"))
    mixed = keep.write(groups.groupBy("key").agg(F.max_by("component", "rows").alias("largest"), F.count("*").alias("components"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("components > 1 and (hi = 0 or lo < hi)").select("key", "largest"), "keys")
    some = keep.write(prefix.join(if_small(mixed, ROW), "key"), "some")
    keep.drop("prefixes", "keys")
    x, y = (rows.select("key", side.alias("side"), F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("component").alias(f"c{c}"), *[F.get("odd", F.lit(k)).alias(f"{c}{k}") for k in range(PARITIES)]) for c, rows, side in (("a", some.where("component <> largest"), F.pmod(-F.col("side"), F.lit(3))), ("b", some, F.col("side"))))
    differ = " + ".join(f"bit_count(a{k} ^ b{k})" for k in range(PARITIES))
    alike = f"ca <> cb and 100 * na >= {percent} * nb and 100 * nb >= {percent} * na and {100 + percent} * ({differ}) <= {100 - percent} * (na + nb)"
    return x.join(y, ["key", "side"]).where(alike).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` with one row of each group of near duplicates: that of the smallest id; of repeated rows one stays.

    Rows with a null id all stay.
    """
    found = written(near_duplicates(docs, id_col, text_col, **how), "near-dup-found")
    own = F.col(id_col)
    gone = written(found.where("not kept").select(own).distinct(), "near-dup-gone")
    left = docs.join(if_small(gone, ROW), id_col, "left_anti").select(docs.columns)
    again = written(found.where(own.isNotNull() & F.col("kept")).groupBy(own).agg(F.count("*").alias("n")).where("n > 1").select(own), "near-dup-again")
    if not again.limit(1).count():
        return left
    again = if_small(again, ROW)
    return left.join(again, id_col, "left_anti").select(docs.columns).unionByName(left.join(again, id_col, "left_semi").select(docs.columns).dropDuplicates([id_col, text_col]))


def op10_minhash_near_dup(spark, sf_dir: str) -> DataFrame:
    """The component of near duplicates of every document."""
    return near_duplicates(table(spark, sf_dir, "documents"))


OP10_SQL = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS k, doc_id, {WORDS_SQL} AS w FROM documents),
l AS (SELECT k, doc_id, {SHINGLES_SQL} AS s FROM d),
u AS (SELECT k, unnest(s) AS g FROM l),
c AS (SELECT a.k AS a, b.k AS b, count(*) AS shared FROM u a JOIN u b ON a.g = b.g AND a.k < b.k GROUP BY a.k, b.k),
e AS (SELECT x.doc_id AS a, y.doc_id AS b FROM c JOIN l x ON c.a = x.k JOIN l y ON c.b = y.k WHERE 100 * shared >= 85 * (len(x.s) + len(y.s) - shared)),
z AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT doc_id AS a, doc_id AS b FROM d WHERE doc_id IS NOT NULL UNION SELECT r.a, z.b FROM r JOIN z ON r.b = z.a),
m AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT l.doc_id, len(s)::BIGINT AS n_shingles, component_id, coalesce(l.doc_id = component_id, true) AS kept FROM l LEFT JOIN m ON l.doc_id = m.doc_id
"""
