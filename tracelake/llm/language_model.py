"""Language-model scoring with a probabilistic suffix tree over bytes.

A text is its tokens (A-Z lower-cased) joined by single spaces, then an end mark.  The tree keeps variable-length contexts
of up to ``DEPTH`` symbols: those that occur at least ``MIN_COUNT`` times in the training texts and whose next-symbol counts
diverge from what their suffix predicts: by at least ``MIN_GAIN`` nats, summed over the training texts, for each symbol
seen there, so that every number stored pays; a context is kept with all its suffixes.  In a
context seen t times before q different symbols, a symbol seen n times has probability (n + q * p) / (t + q), where p is what
the suffix gives it; below the root all symbols are alike.  Each symbol is predicted by the longest kept suffix of what
precedes it.  Counts cover all training texts and both bars are absolute, so the tree grows with the corpus.

The tree is made by joins, depth by depth, and stays a table.  To score, its rows go to every task if they take
``TREE_BYTES`` at most; a larger tree is cut into blocks by the two nearest symbols of a context, and the texts are gone
over once a block, so no task ever holds more than a block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.context_tree import CHUNK, Alphabet, GramCounts, contexts, gram_codes
from tracelake.llm.shared import Scratch, if_small, small_batches, table, written
from tracelake.llm.vectext import SPACE_SPLIT, buffers, pieces, signed, span_hashes, word_spans

DEPTH = 5
MIN_COUNT = 4
MIN_GAIN = 1.0
ALPHABET = 230  # all bytes but A-Z
#: A tree of more bytes (40 for a context and for each symbol seen in it) is scored with in blocks of that size.
TREE_BYTES = 48 << 20
#: Counts of so many of the most frequent words travel to every task (12 bytes each); rarer words are joined.
HEAD_WORDS = 400_000


def token_stream(alphabet: Alphabet, raw: np.ndarray, part: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, offsets) of rows: words with one space between, then the end mark."""
    lo, rel = int(part[0]), part - part[0]
    data = raw[lo : int(part[-1])]
    rows = len(part) - 1
    keep = SPACE_SPLIT[data]
    later = np.ones(len(starts), bool)
    later[first[:-1][np.diff(first) > 0]] = False
    gaps = starts[later] - 1
    keep[gaps] = True
    at = np.flatnonzero(keep)
    sym = alphabet.table[data[at]]
    sym[np.searchsorted(at, gaps)] = alphabet.table[0x20]
    size = np.diff(np.searchsorted(at, rel))
    offsets = np.concatenate([[0], np.cumsum(size + 1)])
    out = np.full(int(offsets[-1]), Alphabet.END, dtype=np.uint8)
    out[np.arange(len(sym)) + np.repeat(np.arange(rows), size)] = sym
    return out, offsets


def _counter(alphabet: Alphabet, depth: int):
    """(kind, key, n): kind 0 counts words by hash, kind 1 runs of symbols, kind 2 texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, grams, texts = GramCounts(2_000_000), GramCounts(2_000_000), 0

        def flush(kind: int, counts: GramCounts) -> pa.RecordBatch:
            keys, n = counts.take()
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind)), pa.array(keys), pa.array(n)], names=["kind", "key", "n"])

        for batch in batches:
            texts += batch.num_rows
            raw, offsets = buffers(batch.column(0))
            for a, b in pieces(offsets):
                part = offsets[a : b + 1]
                starts, ends, first = word_spans(raw, part)
                words.add(signed(span_hashes(raw[int(part[0]) : int(part[-1])], starts, ends)))
                sym, own = token_stream(alphabet, raw, part, starts, ends, first)
                for c in range(0, len(sym), 1 << 19):
                    # a slice with the symbols before it as context; its first texts' borders are kept
                    d, e = max(0, c - depth), min(len(sym), c + (1 << 19))
                    cut = np.unique(np.clip(own, d, e)) - d
                    code = gram_codes(sym[d:e], contexts(sym[d:e], cut, depth), alphabet.size)
                    grams.add(code[c - d :])
                for kind, counts in ((0, words), (1, grams)):
                    if counts.full():
                        yield flush(kind, counts)
        yield flush(0, words)
        yield flush(1, grams)
        yield pa.RecordBatch.from_arrays([pa.array([2]), pa.array([0]), pa.array([texts])], names=["kind", "key", "n"])

    return run


def _byte_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(256, np.int64)
    for batch in batches:
        raw, offsets = buffers(batch.column(0))
        total += np.bincount(raw[int(offsets[0]) : int(offsets[-1])], minlength=256)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(256)), pa.array(total)], names=["byte", "n"])


class Pairs:
    """A frozen map of non-negative integers to numbers, by open addressing: arrays are looked up at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(2 * len(keys)).bit_length())
        self.mask, self.shift = (1 << bits) - 1, np.uint64(64 - bits)
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.zeros(1 << bits, values.dtype)
        left, at = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.keys[at] < 0
            slot, first = np.unique(at[free], return_index=True)
            own = left[free][first]
            self.keys[slot], self.values[slot] = keys[own], values[own]
            rest = self.keys[at] != keys[left]
            left, at = left[rest], (at[rest] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).view(np.int64)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(found, values) for all keys."""
        at = self._slot(keys)
        held = self.keys[at]
        found = held == keys
        out = self.values[at]
        left = np.flatnonzero(~found & (held >= 0))
        at = at[left]
        while len(left):
            at = (at + 1) & self.mask
            held = self.keys[at]
            hit = held == keys[left]
            found[left[hit]] = True
            out[left[hit]] = self.values[at[hit]]
            on = ~hit & (held >= 0)
            left, at = left[on], at[on]
        return found, out


class SuffixTree:
    """A tree, or the block of it for contexts whose two nearest symbols fall in ``block`` of ``blocks``."""

    def __init__(self, alphabet: Alphabet, depth: int, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]], block: int = 0, blocks: int = 1):
        """A level: context codes, log10 of what each leaves to its suffix, and per symbol seen (context's row, symbol, log10 p)."""
        size = self.size = alphabet.size
        self.depth, self.block, self.blocks = depth, block, blocks
        self.uniform, self.each_other = -math.log10(size - 1), -math.log10(alphabet.others)
        parents, backs, names, seen, costs = [], [], [], [], []
        base, above = 0, (np.zeros(0, np.int64), np.zeros(0, np.int64))  # sorted codes of the level above, their ids
        for d, (code, back, row, sym, cost) in enumerate(levels):
            own = base + np.arange(len(code))
            base += len(code)
            parents.append(above[1][np.searchsorted(above[0], code % size ** (d - 1))] if d and len(code) else np.full(len(code), -1))
            names.append(code * (depth + 1) + d)
            backs.append(back)
            seen.append(own[row] * size + sym)
            costs.append(cost)
            order = np.argsort(code)
            above = (code[order], own[order])
        join = lambda xs, t: np.concatenate(xs).astype(t) if xs else np.zeros(0, t)
        self.parent, self.back = join(parents, np.int32), join(backs, np.float32)
        #: Ids by code and depth.  As a context is kept with all its suffixes, the longest kept one is found by bisection.
        self.node = Pairs(join(names, np.int64), np.arange(base, dtype=np.int32))
        self.seen = Pairs(join(seen, np.int64), join(costs, np.float32))

    def costs(self, sym: np.ndarray, ctx: list[np.ndarray]) -> np.ndarray:
        """log10 of each symbol's probability after its context; 0 for positions of other blocks."""
        out = np.zeros(len(sym), np.float64)
        live = np.arange(len(sym))
        if self.blocks > 1:
            live = np.flatnonzero(block_of(ctx[0].astype(np.int64), ctx[1].astype(np.int64), self.size, self.blocks) == self.block)
        out[live[sym[live] == Alphabet.OTHER]] = self.each_other
        if not len(self.parent):
            out[live] += self.uniform
            return out
        code = np.zeros(len(live), np.int64)
        for c in reversed(ctx):
            code *= self.size
            code += c[live]
        powers = self.size ** np.arange(self.depth + 1, dtype=np.int64)
        node, low, high = np.zeros(len(live), np.int64), np.zeros(len(live), np.int64), np.full(len(live), self.depth)
        for _ in range(self.depth.bit_length()):
            mid = (low + high + 1) >> 1
            hit, at = self.node.get(code % powers[mid] * (self.depth + 1) + mid)
            np.copyto(node, at, where=hit)
            low = np.where(hit, mid, low)
            high = np.where(hit, high, np.maximum(mid - 1, low))
        sym = sym[live]
        while len(live):
            hit, cost = self.seen.get(node * self.size + sym)
            out[live[hit]] += cost[hit]
            live, node, sym = live[~hit], node[~hit], sym[~hit]
            out[live] += self.back[node]
            node = self.parent[node].astype(np.int64)
            done = node < 0
            out[live[done]] += self.uniform
            live, node, sym = live[~done], node[~done], sym[~done]
        return out

    def sums(self, sym: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        out, ctx = np.zeros(len(offsets) - 1), contexts(sym, offsets, self.depth)
        for a in range(0, len(sym), CHUNK):
            b = min(len(sym), a + CHUNK)
            cost = self.costs(sym[a:b].astype(np.int64), [c[a:b] for c in ctx])
            rows = np.arange(np.searchsorted(offsets, a, side="right") - 1, np.searchsorted(offsets, b - 1, side="right"))
            begin, end = np.maximum(offsets[rows], a), np.minimum(offsets[rows + 1], b)
            some = end > begin
            out[rows[some]] += np.add.reduceat(cost, begin[some] - a)
        return out


def block_of(near, next_, size: int, blocks: int):
    """The block of contexts with these two nearest symbols; of columns as of arrays."""
    return (near * size + next_) % blocks


class Model:
    """What was learned: the tree as a table, and the counts of frequent words."""

    def __init__(self, alphabet: Alphabet, depth: int, tree: DataFrame, tree_bytes: int, head: np.ndarray, head_n: np.ndarray, total: int, distinct: int, ends: int):
        self.alphabet, self.depth, self.tree, self.tree_bytes, self.head, self.head_n = alphabet, depth, tree, tree_bytes, head, head_n
        self.total, self.distinct, self.ends = total, distinct, ends

    def base(self, n: np.ndarray) -> np.ndarray:
        return np.log10(n + 0.1) - math.log10(self.total + 0.1 * (self.distinct + 1))

    def block(self, block: int = 0, blocks: int = 1) -> SuffixTree:
        """One block of the tree, collected: contexts of less than two symbols are in all of them."""
        a = self.alphabet.size
        rows = self.tree
        if blocks > 1:
            rows = rows.where((F.col("depth") < 2) | (block_of(F.pmod("ctx", F.lit(a)), F.pmod(F.expr(f"ctx div {a}"), F.lit(a)), a, blocks) == block))
        got = rows.toArrow()
        depth, ctx, back = (np.asarray(got.column(c)) for c in ("depth", "ctx", "back"))
        lists = [got.column(c).combine_chunks() for c in ("sym", "cost")]
        cuts = np.asarray(lists[0].offsets)
        sym, cost = (np.asarray(x.values) for x in lists)
        owner = np.repeat(np.arange(len(ctx)), np.diff(cuts))
        levels = []
        for d in range(self.depth + 1):
            own = np.flatnonzero(depth == d)
            mine = np.flatnonzero(depth[owner] == d)
            levels.append((ctx[own], back[own], np.searchsorted(own, owner[mine]), sym[mine].astype(np.int64), cost[mine]))
        return SuffixTree(self.alphabet, self.depth, levels, block, blocks)


def fit(train: DataFrame, text_col: str = "text", *, depth: int = DEPTH, min_count: int = MIN_COUNT, min_gain: float = MIN_GAIN, head_words: int = HEAD_WORDS) -> tuple[Model, DataFrame]:
    """(model, counts (key, n) of the words beside the ``head_words`` most frequent ones) learned from all rows of ``train``."""
    small_batches(train.sparkSession)
    rows = train.select(F.col(text_col).cast("string").alias("text"))
    seen = np.zeros(256, np.int64)
    for r in rows.mapInArrow(_byte_counts, "byte long, n long").groupBy("byte").agg(F.sum("n").alias("n")).collect():
        seen[r.byte] = r.n
    seen[[0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0
    seen[0x20] += 1
    alphabet = Alphabet.of_counts(seen, ALPHABET)
    if alphabet.table[0x20] == Alphabet.OTHER:
        raise AssertionError("the space is always listed")
    counts = written(rows.mapInArrow(_counter(alphabet, depth), "kind long, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")), "lm-counts")
    words = counts.where("kind = 0").select("key", "n")
    size = words.agg(F.count("*").alias("v"), F.sum("n").alias("n")).first()
    ends = counts.where("kind = 2").agg(F.sum("n")).first()[0] or 0
    total, distinct = (size.n or 0) + ends, size.v + (ends > 0)

    # the most frequent words: all with a count of at least the cut, which is the smallest that keeps to head_words
    cut, held = 1, 0
    for r in words.groupBy(F.least("n", F.lit(1 << 20)).alias("n")).agg(F.count("*").alias("v")).orderBy(F.desc("n")).toLocalIterator():
        if held + r.v > head_words:
            cut = r.n + 1
            break
        held += r.v
    head = words.where(F.col("n") >= cut).toArrow()
    keys, n = (np.asarray(head.column(c)) for c in ("key", "n"))
    order = np.argsort(keys)
    tree = tree_table(counts.where("kind = 1").select("key", "n"), alphabet.size, depth, min_count, min_gain)
    size = tree.agg(F.sum(40 + 40 * F.size("sym"))).first()[0] or 0
    return Model(alphabet, depth, tree, size, keys[order], n[order], total, distinct, ends), words.where(F.col("n") < cut)


def tree_table(grams: DataFrame, a: int, depth: int, min_count: int, min_gain: float) -> DataFrame:
    """(depth, ctx, back, sym, cost) of the contexts kept, from the counts (key, n) of runs of depth + 1 symbols."""
    keep = Scratch(grams.sparkSession, "suffix-tree")
    runs, levels = [grams], []
    for d in range(depth - 1, -1, -1):  # each level's counts from the longer ones'
        runs.append(keep.write(runs[-1].groupBy(F.pmod("key", F.lit(a ** (d + 1))).alias("key")).agg(F.sum("n").alias("n")), f"runs{d}"))
    for d, own in enumerate(reversed(runs)):
        seen = own.groupBy(F.expr(f"key div {a}").alias("ctx")).agg(F.sum("n").alias("t"), F.collect_list(F.struct(F.pmod("key", F.lit(a)).cast("int").alias("s"), "n")).alias("e")).where(F.col("t") >= (min_count if d else 1))
        if d:
            above = levels[-1].select(F.col("ctx").alias("_suffix"), F.map_from_arrays("sym", "p").alias("_p"))
            seen = seen.join(if_small(above, 400), F.pmod("ctx", F.lit(a ** (d - 1))) == F.col("_suffix"))
            below = lambda x: F.element_at("_p", x["s"])
        else:
            below = lambda x: F.lit(1.0 / (a - 1))
        q = F.size("e")
        e = F.transform("e", lambda x: F.struct(x["s"].alias("s"), x["n"].alias("n"), below(x).alias("b")))
        seen = seen.withColumn("e", e)
        gain = F.aggregate("e", F.lit(0.0), lambda z, x: z + x["n"] * F.log(x["n"] / F.col("t") / x["b"]))
        p = F.transform("e", lambda x: (x["n"] + q * x["b"]) / (F.col("t") + q))
        levels.append(keep.write(seen.select("ctx", F.log10(q / (F.col("t") + q)).alias("back"), F.transform("e", lambda x: x["s"]).alias("sym"), p.alias("p"), (gain / q).alias("gain")), f"level{d}"))
    out, longer = None, None
    for d in range(depth, -1, -1):
        kept = levels[d]
        if d:
            if longer is not None:
                kept = kept.join(if_small(longer, 32), "ctx", "left").where((F.col("gain") >= min_gain) | F.col("wanted")).drop("wanted")
            else:
                kept = kept.where(F.col("gain") >= min_gain)
            kept = keep.write(kept, f"kept{d}")
            longer = keep.write(kept.select(F.pmod("ctx", F.lit(a ** (d - 1))).alias("ctx"), F.lit(True).alias("wanted")).distinct(), f"longer{d}")
        rows = kept.select(F.lit(d).alias("depth"), "ctx", "back", "sym", F.transform("p", lambda x: F.log10(x)).alias("cost"))
        out = rows if out is None else out.unionByName(rows)
    tree = keep.write(out, "tree")
    keep.keep_only("tree")
    return tree


def _tree_only(alphabet: Alphabet, held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = buffers(batch.column(1))
            total = []
            for a, b in pieces(offsets):
                part = offsets[a : b + 1]
                total.append(held.value.sums(*token_stream(alphabet, raw, part, *word_spans(raw, part))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(total) if total else np.zeros(0))], names=["_row", "score"])

    return run


def score(docs: DataFrame, model: Model, rare: DataFrame, *, text_col: str = "text", keep: list[str] = (), tree_bytes: int = TREE_BYTES) -> DataFrame:
    """``keep`` columns of every row with n_tokens, n_known, train_tokens, base_score and score.

    Frequent words are looked up in the broadcast head (at most ``HEAD_WORDS``); every other distinct word of a text is
    joined with the table of rare words and its share of the base score added up by row.  Null, empty and white-space
    texts are one end mark.  ``keep`` must not name a result column.
    """
    if clash := {"n_tokens", "n_known", "train_tokens", "base_score", "score"} & set(keep):
        raise ValueError(f"kept columns clash with results: {', '.join(sorted(clash))}")
    context = docs.sparkSession.sparkContext
    blocks = max(1, -(-model.tree_bytes // tree_bytes))
    alphabet, known_words = model.alphabet, (model.head, model.head_n)
    frozen = (model.total, model.distinct, model.ends)
    held = context.broadcast((Model(alphabet, model.depth, None, 0, *known_words, *frozen), model.block(0, blocks)))
    rows = docs.select(*[F.col(c) for c in keep], F.col(text_col).cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, tree = held.value
        line = TaskContext.get().partitionId() << 40
        unknown = float(m.base(np.zeros(1))[0])
        end = float(m.base(np.array([m.ends]))[0])
        for batch in batches:
            raw, offsets = buffers(batch.column(batch.num_columns - 1))
            n_tokens, known, base, total, tails = [], [], [], [], []
            for a, b in pieces(offsets):
                part = offsets[a : b + 1]
                starts, ends, first = word_spans(raw, part)
                h = signed(span_hashes(raw[int(part[0]) : int(part[-1])], starts, ends))
                at = np.minimum(np.searchsorted(m.head, h), max(0, len(m.head) - 1))
                hit = m.head[at] == h if len(m.head) else np.zeros(len(h), bool)
                gain = np.full(len(h), unknown)
                gain[hit] = m.base(m.head_n[at[hit]])
                sums = np.concatenate([[0.0], np.cumsum(gain)])
                hits = np.concatenate([[0], np.cumsum(hit)])
                n_tokens.append(np.diff(first) + 1)
                known.append(np.diff(hits[first]) + (m.ends > 0))
                base.append(np.diff(sums[first]) + end)
                total.append(tree.sums(*token_stream(m.alphabet, raw, part, starts, ends, first)))
                rest = np.flatnonzero(~hit)
                tails.append((h[rest], np.searchsorted(rest, first)))
            n = batch.num_rows
            values = np.concatenate([t for t, _ in tails]) if tails else np.zeros(0, np.int64)
            cuts = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(c) for _, c in tails]))]) if tails else np.zeros(1, np.int64)
            cols = [np.concatenate(c) if c else np.zeros(0) for c in (n_tokens, known, base, total)]
            own = [] if blocks > 1 else [pa.array(line + np.arange(n))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], *own, pa.array(cols[0].astype(np.int64)), pa.array(cols[1].astype(np.int64)), pa.array(cols[2]), pa.array(cols[3]), pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(values))],
                names=[*batch.schema.names[:-1], *["_row"] * len(own), "n_tokens", "_known", "_base", "score", "_tail"],
            )
            line += n

    ddl = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]] + ["_row long, n_tokens long, _known long, _base double, score double, _tail array<long>"])
    if blocks > 1:  # row numbers must stay what they are from block to block
        rows = written(rows.withColumn("_row", F.monotonically_increasing_id()), "lm-texts").select(*keep, "_row", "_text")
        ddl = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-2]] + ["_row long, n_tokens long, _known long, _base double, score double, _tail array<long>"])
    scored = written(rows.mapInArrow(run, ddl), "lm-scored")
    if blocks > 1:
        parts = [scored.select("_row", "score")]
        for block in range(1, blocks):
            held_block = context.broadcast(model.block(block, blocks))
            parts.append(written(rows.select("_row", "_text").mapInArrow(_tree_only(alphabet, held_block), "_row long, score double"), "lm-block"))
            held_block.unpersist()
        sums = reduce(DataFrame.unionByName, parts).groupBy("_row").agg(F.sum("score").alias("score"))
        scored = scored.drop("score").join(sums, "_row")
    tail = scored.select("_row", F.explode("_tail").alias("key"))
    unknown = float(model.base(np.zeros(1))[0])
    norm = math.log10(model.total + 0.1 * (model.distinct + 1))
    more = tail.join(rare, "key").groupBy("_row").agg(F.count("*").alias("_n"), F.sum(F.log10(F.col("n") + 0.1) - norm - unknown).alias("_gain"))
    kept = [F.col(c) for c in keep]
    return scored.drop("_tail").join(more, "_row", "left").select(*kept, "n_tokens", (F.col("_known") + F.coalesce("_n", F.lit(0))).alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"), (F.col("_base") + F.coalesce("_gain", F.lit(0.0))).alias("base_score"), "score")


HELD_OUT = "pmod(crc32(cast(doc_id as string)), 10) = 0"


def op9_suffix_tree_lm(spark, sf_dir: str) -> DataFrame:
    """Scores of every document, by a model learned from nine tenths of them."""
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(F.expr(HELD_OUT), F.lit(False))
    model, rare = fit(docs.where(~held))
    return score(docs.select("doc_id", held.alias("held_out"), "text"), model, rare, keep=["doc_id", "held_out"])
