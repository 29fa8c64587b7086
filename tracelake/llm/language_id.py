"""Language identification by prediction by partial matching (PPM).

For each language a variable-order byte context tree with frozen counts gives every byte a probability: the longest
context that the language has seen predicts a byte it has seen there with n / (t + q) (t symbols seen, q of them
different), and escapes with q / (t + q) to the next shorter context, whose distribution is renormalised over the bytes
not yet ruled out; below the root all bytes are alike.  The summed code lengths of a whole text decide.  The languages'
trees are laid over one another in one array, so a batch of texts is scored for all of them by a few array gathers.

Bytes are those of the text with A-Z lower-cased.  Every byte that the sample has is a symbol of its own; those that it
does not have are one class, within which all are alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm.context_tree import Alphabet, ContextTree, GramCounts, contexts, gram_codes
from tracelake.llm.shared import Scratch, small_batches, table
from tracelake.llm.vectext import buffers, pieces

DEPTH = 3
#: The classifier is fitted on at most so many whole labelled texts of each language, those first in a fixed hash order.
SAMPLE_PER_LANG = 800
ALPHABET = 230  # all bytes but A-Z
SLICE = 256  # contexts whose probabilities are worked out at once
#: A text that needs more than so many times the bits a byte of its language's training texts is in no learned language.
SLACK = 2.0


class PPM:
    """Frozen statistics of all languages, and scoring."""

    def __init__(self, langs: list[str], alphabet: Alphabet, grams: dict[str, tuple[np.ndarray, np.ndarray]], depth: int = DEPTH):
        self.langs, self.alphabet = langs, alphabet
        a = alphabet.size
        wanted = [np.unique(np.concatenate([(g // a) % a**d for g, _ in grams.values()] or [np.zeros(0, np.int64)])) for d in range(depth + 1)]
        tree = self.tree = ContextTree(a, wanted)
        seen = np.zeros((len(tree.parent), a, len(langs)), np.float32)
        for k, lang in enumerate(langs):
            codes, n = grams[lang]
            for d in range(depth + 1):
                node = tree.place(d, (codes // a) % a**d)
                ok = node >= 0
                np.add.at(seen, (node[ok], (codes % a)[ok], k), n[ok])
        p = np.zeros_like(seen)
        # in slices and in place: the driver holds two arrays of the tree's size, not six
        for part in (slice(at, min(at + SLICE, x.stop)) for x in tree.layers() for at in range(x.start, x.stop, SLICE)):
            n = seen[part]
            below = np.full((1, a, 1), 1.0 / (a - 1), np.float32) if part.start == 0 else p[tree.parent[part]]
            total, kinds = n.sum(axis=1, keepdims=True), (n > 0).sum(axis=1, keepdims=True)
            rest = np.where(n > 0, 0, below)
            spare = rest.sum(axis=1, keepdims=True)
            with np.errstate(divide="ignore", invalid="ignore"):
                own = np.where(n > 0, n / (total + kinds), (kinds / (total + kinds)) * rest / spare)
            p[part] = np.where(total > 0, own, below)  # a context that the language never saw predicts as its suffix does
        del seen
        bits = np.negative(np.log2(np.maximum(p, np.float32(1e-30), out=p), out=p), out=p)
        bits[:, Alphabet.OTHER] += np.log2(alphabet.others)
        tree.costs = bits
        #: Bits a byte of the training texts of each language under their own language.
        self.usual = np.zeros(len(langs))
        for k, lang in enumerate(langs):
            codes, n = grams[lang]
            spent = tree.costs[tree.place(depth, codes // a), codes % a, k].astype(np.float64)
            self.usual[k] = (n * spent).sum() / max(1, n.sum())

    def code_lengths(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits of each text under each language."""
        out = np.zeros((len(offsets) - 1, len(self.langs)))
        for a, b in pieces(offsets):
            part = offsets[a : b + 1]
            out[a:b] = self.tree.sums(self.alphabet.table[raw[int(part[0]) : int(part[-1])]], part - part[0])
        return out


def fit(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text", key_col: str = "doc_id", *, per_lang: int = SAMPLE_PER_LANG, depth: int = DEPTH) -> PPM:
    """Fit on at most ``per_lang`` whole texts of each language: those with the smallest hash of key and text.

    The table of languages (their number is that of distinct labels) is broadcast.  Candidates, about 4 * ``per_lang`` rows
    of a language, are picked by their hash alone in one scan of the texts and written; ranks and counts come from those.
    Only counts of byte runs come to the driver: their number is bounded by the sample.  Rows with a null language or text
    are not learned from.
    """
    small_batches(labelled.sparkSession)
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.col(key_col).cast("string").alias("key"))
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"))
    low = rows.withColumn("h", F.xxhash64("key", "text")).join(F.broadcast(counts), "lang").where((F.col("h").cast("double") / 2.0**64 + 0.5) * F.col("n") <= 4 * per_lang)
    keep = Scratch(labelled.sparkSession, "languages")
    low = keep.write(low.select("lang", "text", "h"), "low")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", F.xxhash64("text", F.lit(1))))
    picked = keep.write(low.withColumn("r", rank).where(F.col("r") <= per_lang).select("lang", "text"), "picked")

    def bytes_seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(256, np.int64)
        for batch in batches:
            raw, offsets = buffers(batch.column(0))
            total += np.bincount(raw[int(offsets[0]) : int(offsets[-1])], minlength=256)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(256)), pa.array(total)], names=["byte", "n"])

    counts = np.zeros(256, np.int64)
    for r in picked.select("text").mapInArrow(bytes_seen, "byte long, n long").groupBy("byte").agg(F.sum("n").alias("n")).collect():
        counts[r.byte] = r.n
    alphabet = Alphabet.of_counts(counts, ALPHABET)
    grams_of = _gram_counter(alphabet, depth)
    rows = picked.mapInArrow(grams_of, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    names = rows.column("lang").combine_chunks().dictionary_encode() if rows.num_rows else None
    langs = sorted(names.dictionary.to_pylist()) if names is not None else []
    gram, n = (np.asarray(rows.column(c)) for c in ("gram", "n"))
    grams = {}
    for lang in langs:
        mine = np.asarray(names.indices) == names.dictionary.to_pylist().index(lang)
        grams[lang] = (gram[mine], n[mine])
    keep.keep_only()
    return PPM(langs, alphabet, grams, depth)


def _gram_counter(alphabet: Alphabet, depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, GramCounts] = {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for lang in sorted(set(langs)):
                mine = batch.column(1).filter(pa.array([x == lang for x in langs]))
                raw, offsets = buffers(mine)
                for a, b in pieces(offsets):
                    part = offsets[a : b + 1]
                    sym = alphabet.table[raw[int(part[0]) : int(part[-1])]]
                    held.setdefault(lang, GramCounts()).add(gram_codes(sym, contexts(sym, part - part[0], depth), alphabet.size))
        for lang, counts in held.items():
            codes, n = counts.take()
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(n)], names=["lang", "gram", "n"])

    return run


def predict(docs: DataFrame, model: PPM, *, text_col: str = "text", keep: list[str] = (), pred_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """``keep`` columns of every row of ``docs`` with the predicted language and its posterior (all languages alike likely before).

    A text that is null or has no letter is ``und`` with score 0, as is every text where no language was learned.
    Equal code lengths go to the language that sorts first.  ``keep`` must not name ``pred_col`` or ``score_col``.
    """
    if clash := {pred_col, score_col} & set(keep):
        raise ValueError(f"kept columns clash with results: {', '.join(sorted(clash))}")
    held = docs.sparkSession.sparkContext.broadcast(model)
    kept = [F.col(c) for c in keep]
    rows = docs.select(*kept, F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("_letters"), F.col(text_col).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ppm = held.value
        names = pa.array([*ppm.langs, "und"], pa.string())
        for batch in batches:
            n, wide = batch.num_rows, batch.num_columns
            letters = np.asarray(batch.column(wide - 2))
            best, score = np.full(n, len(ppm.langs)), np.zeros(n)
            if ppm.langs and n:
                bits = ppm.code_lengths(*buffers(batch.column(wide - 1)))
                gap = bits - bits.min(axis=1, keepdims=True)
                score = np.where(letters, 1 / np.exp2(-np.minimum(gap, 1000)).sum(axis=1), 0)
                best = np.where(letters, bits.argmin(axis=1), best)
            yield pa.RecordBatch.from_arrays([*batch.columns[: wide - 2], names.take(pa.array(best)), pa.array(score)], names=[*batch.schema.names[: wide - 2], pred_col, score_col])

    kinds = rows.schema.fields[: len(kept)]
    ddl = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kinds] + [f"`{pred_col}` string", f"`{score_col}` double"])
    return rows.mapInArrow(run, ddl)


def keep_known(docs: DataFrame, model: PPM, text_col: str = "text", least: float = 0.5, slack: float = SLACK) -> DataFrame:
    """The rows of ``docs`` whose text has a letter and, under the model, one language of posterior ``least`` or more that codes it well.

    The posterior only ranks the learned languages; that a text is in none of them shows in its bits a byte, which may be
    ``slack`` times those of the language's training texts at most.  Null, empty and letterless texts go (a letter is what
    Unicode calls one, as in ``predict``).  Where no language was learned nothing can be judged, so texts with a letter stay.
    Equal texts share their fate; other columns are kept as they are.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ppm = held.value
        for batch in batches:
            column = batch.column(at)
            keep = np.array([any(map(str.isalpha, x or "")) for x in map(pa.StringScalar.as_py, column)], dtype=bool)
            if ppm.langs and batch.num_rows:
                raw, offsets = buffers(column)
                bits = ppm.code_lengths(raw, offsets)
                gap = bits - bits.min(axis=1, keepdims=True)
                keep &= bits.min(axis=1) <= slack * ppm.usual[bits.argmin(axis=1)] * np.diff(offsets)
                keep &= 1 / np.exp2(-np.minimum(gap, 1000)).sum(axis=1) >= least
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


HELD_OUT = "pmod(crc32(cast(doc_id as string)), 4) = 2"


def op2_ppm_language_id(spark, sf_dir: str) -> DataFrame:
    """The language of every document, by models learned from three quarters of the labelled ones."""
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(F.expr(HELD_OUT), F.lit(False))
    model = fit(docs.where(~held))
    return predict(docs.select("doc_id", held.alias("held_out"), "text"), model, keep=["doc_id", "held_out"])
