from __future__ import annotations

import math
import random
import re
import string
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from plain import LOWER, lower_words, prose, shingles, words
from hypothesis import given, settings
from hypothesis import strategies as st
from tracelake.llm import decontaminate, language_id, language_model, license_scan, quality, vectext


# --- shared primitives

@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aAbBé \n\t\x0b1", max_size=40)), max_size=8))
def test_words_and_shingles_match_plain_python(texts):
    raw, offsets = vectext.buffers(pa.array(texts, pa.string()))
    seen = {}
    for i, runs, n in vectext.shingle_rows(raw, offsets):
        w = lower_words(texts[i])
        assert n == len(w)
        plain = [tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))] if w else []
        assert len(plain) == len(runs)
        for p, h in zip(plain, runs.tolist(), strict=True):
            assert seen.setdefault(h, p) == p
            assert seen[h] == p
    assert len(set(seen.values())) == len(seen)


def test_pieces_do_not_matter():
    text = prose(1, 3000)
    raw, offsets = vectext.buffers(pa.array([text]))
    s, e, _ = vectext.word_spans(raw, offsets)
    assert np.array_equal(vectext.span_hashes(raw, s, e), vectext.span_hashes(raw, s, e, limit=64))


# --- quality rules

def plain_quality(text):
    t = text or ""
    w = words(t)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if words(x)]
    n, chars, symbols, dup = len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines))
    failed = n < 50 or 100 * len(covered) > 50 * n
    shouted = sum(len(re.findall("[A-Z]", x)) >= 4 and not re.search("[a-z]", x) for x in w)
    bad = 100 * symbols > 10 * n or 100 * shouted > 30 * n or (len(lines) >= 5 and 100 * dup > 50 * len(lines)) or chars < 3 * n or chars > 10 * n
    return (n, chars, symbols, dup, len(covered), failed, not failed and not bad)


JUNK = [(20, "AAAA BBBB! " * 60), (21, " ".join(f"w{k}###" for k in range(80))), (22, " ".join(f"w{k}" for k in range(80))), (23, "a b c " * 40), (24, "\n".join(["same line of words here ok"] * 3 + [prose(9, 90)]))]


def test_quality(frame, odd_rows):
    rows = odd_rows + JUNK
    got = sorted(map(repr, map(tuple, quality.with_statistics(frame(rows)).collect())))
    assert got == sorted(repr((r[0], *plain_quality(r[1]))) for r in rows)
    kept = quality.keep_good(frame(rows))
    assert kept.columns == frame([]).columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r[0]) for r in rows if plain_quality(r[1])[-1])


def test_quality_order_changes_nothing(frame, odd_rows):
    t = quality.Texts(*vectext.buffers(pa.array([r[1] for r in odd_rows + JUNK])))
    rules = list(quality.BASE + quality.ADDED)
    assert np.array_equal(quality.passes(t, rules), quality.passes(t, rules[::-1]))
    assert quality.with_statistics(frame([])).collect() == [] and quality.keep_good(frame([])).collect() == []


def test_quality_leaves_good_labelled_documents_alone(spark, sf):
    kept = {r.doc_id for r in quality.op4_quality_cascade(spark, sf).collect() if r.kept}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    long = {r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if len(words(r.text)) >= 50}
    assert all((r.doc_id in kept) == bool(r.quality) for r in labels if r.doc_id in long)


# --- language identification

def test_language_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in language_id.op2_ppm_language_id(spark, "/root/testdata/sf0.01").collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert {r.doc_id for r in held} == {i for i, r in got.items() if r.held_out}
    assert sum(got[r.doc_id].lang_pred == r.lang for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_ppm_code_lengths_match_plain_python():
    texts = {"x": "abab abac", "y": "bbba cab"}
    alphabet = language_id.Alphabet(sorted({ord(c) for t in texts.values() for c in t}))
    grams = {}
    for lang, t in texts.items():
        sym = alphabet.table[np.frombuffer(t.encode(), np.uint8)]
        codes, n = np.unique(language_id.gram_codes(sym, language_id.contexts(sym, np.array([0, len(sym)]), 3), alphabet.size), return_counts=True)
        grams[lang] = (codes, n)
    model = language_id.PPM(sorted(texts), alphabet, grams)
    raw, offsets = vectext.buffers(pa.array(["abca bb", "", "zab"]))
    got = model.code_lengths(raw, offsets)

    def plain(train, text):
        pad = [0, 0, 0]
        seq = pad + alphabet.table[np.frombuffer(train.encode(), np.uint8)].tolist()
        counts = {}
        for i in range(3, len(seq)):
            for d in range(4):
                counts.setdefault(tuple(seq[i - d : i]), Counter())[seq[i]] += 1

        def p(ctx, s):
            below = (lambda x: p(ctx[1:], x)) if ctx else (lambda x: 1 / (alphabet.size - 1))
            c = counts.get(ctx)
            if not c:
                return below(s)
            t, q = sum(c.values()), len(c)
            if s in c:
                return c[s] / (t + q)
            return q / (t + q) * below(s) / sum(below(x) for x in range(alphabet.size) if x not in c)

        own = pad + alphabet.table[np.frombuffer(text.encode(), np.uint8)].tolist()
        return sum(-math.log2(p(tuple(own[i - 3 : i]), own[i])) + (math.log2(alphabet.others) if own[i] == alphabet.OTHER else 0) for i in range(3, len(own)))

    for i, text in enumerate(["abca bb", "", "zab"]):
        for k, lang in enumerate(sorted(texts)):
            assert math.isclose(got[i, k], plain(texts[lang], text), rel_tol=1e-4, abs_tol=1e-4)


def test_language_odd_rows(frame, odd_rows):
    model = language_id.fit(frame(odd_rows))
    got = language_id.predict(frame(odd_rows), model, keep=["doc_id", "kept"]).collect()
    assert len(got) == len(odd_rows)
    assert all(r.lang_pred == "und" and r.score == 0 for r in got if r.doc_id in (1, 2, 3))
    kept = language_id.keep_known(frame(odd_rows), model)
    assert kept.columns == frame([]).columns and {1, 2, 3}.isdisjoint(r.doc_id for r in kept.collect())
    with pytest.raises(ValueError):
        language_id.predict(frame([]).withColumnRenamed("id", "score"), model, keep=["score"])
    none = language_id.fit(frame([]))
    assert {r.doc_id for r in language_id.keep_known(frame(odd_rows), none).collect()}.isdisjoint({1, 2, 3})
    assert {r.lang_pred for r in language_id.predict(frame(odd_rows), none, keep=["doc_id"]).collect()} == {"und"}


def test_stage_rejects_unlearned_languages_and_keeps_clean_text(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id < 600")
    good = quality.keep_good(docs).select("doc_id", "text", "lang")
    r = random.Random(7)
    strange = ["tämä on suomenkielinen teksti joka ei kuulu tunnettuihin kieliin lainkaan ja sen pitäisi poistua " * 5, "привет как дела это русский текст " * 12, " ".join("".join(r.choice(string.ascii_lowercase) for _ in range(r.randrange(3, 9))) for _ in range(90)), "日本語の文章はここで学習されていない言語の例です。" * 12, "²²² ½½ 123 " * 40]
    rows = good.unionByName(spark.createDataFrame([(-1 - k, x, None) for k, x in enumerate(strange)], good.schema))
    got = {x.doc_id for x in pipeline.known_language(spark, rows, "").collect()}
    assert got == {x.doc_id for x in good.collect()}


# --- licences

def plain_licence(text, templates=None):
    templates = license_scan.TEMPLATES if templates is None else templates
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    w = pattern.findall((text or "").translate(LOWER))
    places = [(i, label) for p, label in license_scan.PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    base = {label for _, label in places}
    sets, found = [set(t.split()) for t, _ in templates], []
    for k, (own, (template, label)) in enumerate(zip(sets, templates, strict=True)):
        need, size = math.ceil(0.8 * len(own) - 1e-9), math.ceil(1.25 * len(template.split()))
        must = {x for other, (_, name) in zip(sets, templates, strict=True) if name != label and len(own & other) >= need for x in own - other}
        for s in range(max(0, len(w) - size) + 1):
            block = set(w[s : s + size])
            if len(own & block) >= need and must <= block:
                found.append((k, s, min(s + size, len(w)), len(own & block) / len(own), label))
    kept = [f for f in found if not any(sets[f[0]] < sets[x[0]] and x[1] <= f[1] and x[2] >= f[2] for x in found)]
    at = [i for i, _ in places]
    return (len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | {f[4] for f in kept})), max((f[3] for f in kept), default=0.0))


NOTICES = [(30, "Released under the MIT-License.\nMIT license; mit LICENSE"), (31, "GNU General\nPublic License, version 3"), (32, "Licensed under CC BY-NC 4.0. all rights reserved"), (33, "apache license apache license"), (34, "This work is licensed under GNU general public license version 3"), (35, "mit\x00license 4"), (36, "alle rechte, all rights\nreserved"), (37, "Licensed under CC BY 4.0"), (38, "x licensed under cc by-sa 4.0 y"), (39, "Licensed under CC BY-NC-SA 4.0"), (40, "Licensed under CC BY 4.0.\nLicensed under CC BY-NC 4.0."),
           (41, "Redistribution and use in source and binary forms, with or without\n modification, are permitted provided that"), (42, "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by"), (43, "Permission is hereby granted, free of charge, to any person obtaining\n * a copy of this software and associated"), (44, prose(1, 3000) + " all of the rights that are reserved")]


def test_licence(frame, odd_rows):
    rows = odd_rows + NOTICES
    got = sorted(map(repr, map(tuple, license_scan.scan(frame(rows)).collect())))
    assert got == sorted(repr((r[0], *plain_licence(r[1]))) for r in rows)
    assert license_scan.scan(frame([])).collect() == []
    labels = {r.doc_id: r.labels for r in license_scan.scan(frame(NOTICES)).collect()}
    assert {k: labels[k] for k in (32, 37, 38, 39, 40, 41, 42, 43, 44)} == {32: "cc-by-nc,reserved", 37: "cc-by", 38: "cc-by-sa", 39: "cc-by-nc-sa", 40: "cc-by,cc-by-nc", 41: "bsd", 42: "gpl", 43: "mit", 44: ""}


def test_hundreds_of_templates(frame):
    r = random.Random(3)
    pool = [f"t{k}" for k in range(400)]
    templates = tuple((" ".join(r.choice(pool[:40] if k % 3 else pool) for _ in range(r.randrange(2, 25))), f"l{k % 90}") for k in range(300))
    rows = []
    for k in range(60):
        own = templates[r.randrange(300)][0].split()
        for _ in range(r.randrange(3)):
            own[r.randrange(len(own))] = "other"
        rows.append((k, " ".join(r.choice(pool) for _ in range(60)) + " " + "\n".join(own) + " " + " ".join(r.choice(pool[:40]) for _ in range(80))))
    got = {x.doc_id: (x.labels, x.score) for x in license_scan.scan(frame(rows), templates=templates).collect()}
    assert got == {k: plain_licence(t, templates)[-2:] for k, t in rows}
    assert sum(bool(labels) for labels, _ in got.values()) > 30


# --- decontamination

def test_contamination(spark, frame, odd_rows):
    item, short = prose(50, 30), "only four words here"
    w = item.split()
    rows = odd_rows + [(40, f"{prose(51, 2000)} {item} {prose(52, 2000)}"), (41, f"{prose(53, 50)} {' '.join(w[:27])} {prose(54, 50)}"), (42, f"{prose(55, 50)} {' '.join(w[:15])} {prose(56, 50)}"), (43, short.upper()), (44, f"x {short}")]
    items = spark.createDataFrame([(1, item, "e"), (2, short, "e"), (3, None, "e"), (4, "", "e"), (5, item, "e"), (None, prose(3, 90), "e")], "item_id long, text string, doc_id string")
    want = []
    for r in rows:
        for i, t, _ in items.collect():
            s = shingles(t)
            if s and 100 * len(s & shingles(r[1])) >= 80 * len(s):
                want.append((r[0], i, len(s), len(s & shingles(r[1]))))
    for blocks in (1 << 24, 64):
        got = [tuple(r)[:4] for r in decontaminate.contaminated(frame(rows), items, block_bytes=blocks).collect()]
        assert sorted(map(repr, got)) == sorted(map(repr, want))
    clean = decontaminate.keep_clean(frame(rows), items)
    assert sorted(map(repr, decontaminate.keep_clean(frame(rows), items, block_bytes=64).collect())) == sorted(map(repr, clean.collect()))
    dirty = {repr(x[0]) for x in want}
    assert sorted(repr(r.doc_id) for r in clean.collect()) == sorted(repr(r[0]) for r in rows if repr(r[0]) not in dirty or r[1] is None or not any(repr(r[0]) == repr(x[0]) for x in want) or (r[0] is None and not shingles(r[1])))
    assert decontaminate.contaminated(frame([]), items).collect() == [] == decontaminate.contaminated(frame([]), items, block_bytes=64).collect()
    pairs = [decontaminate.contained_pairs(frame(rows).selectExpr("md5(text) AS tkey", "text"), items.selectExpr("md5(text) AS ikey", "text"), 5, 80, bytes_).collect() for bytes_ in (1 << 20, 100)]
    assert sorted(map(repr, pairs[0])) == sorted(map(repr, pairs[1])) != []
    assert decontaminate.contaminated(frame(rows), items.limit(0)).collect() == []


def test_contamination_of_the_whole_table(spark, sf):
    items = [(r.item_id, shingles(r.text)) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = set()
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        own = shingles(r.text)
        want |= {(r.doc_id, i) for i, s in items if s and 100 * len(s & own) >= 80 * len(s)}
    got = [(r.doc_id, r.item_id) for r in decontaminate.op8_benchmark_decontamination(spark, sf).collect()]
    assert len(got) == len(set(got)) and set(got) == want


# --- language model

def test_base_score_is_exact(frame, odd_rows):
    rows = odd_rows
    for head in (10**6, 3, 0):
        model, rare = language_model.fit(frame(rows[:10]), head_words=head)
        got = language_model.score(frame(rows), model, rare, keep=["doc_id"]).collect()
        counts = Counter()
        for r in rows[:10]:
            counts.update([*lower_words(r[1]), None])
        n, v = sum(counts.values()), len(counts)
        want = []
        for r in rows:
            t = [*lower_words(r[1]), None]
            want.append((str(r[0]), len(t), sum(counts[x] > 0 for x in t), n, sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in t)))
        key = lambda x: x[:4]
        for g, w in zip(sorted(((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got), key=key), sorted(want, key=key), strict=True):
            assert g[:4] == w[:4] and math.isclose(g[4], w[4], rel_tol=1e-9)
        assert all(r.score <= 0 for r in got)


def plain_tree(texts, alphabet, depth, min_count, min_gain):
    """log10 p(symbol | symbols before) of a suffix tree grown as its definition says."""
    sequences = [[0] * depth + [int(alphabet.table[b]) for b in " ".join(lower_words(t)).encode()] + [1] for t in texts]
    counts = {}
    for s in sequences:
        for i in range(depth, len(s)):
            for d in range(depth + 1):
                counts.setdefault(tuple(s[i - d : i]), Counter())[s[i]] += 1
    often = {c: n for c, n in counts.items() if not c or sum(n.values()) >= min_count}

    def p(tree, ctx, s):
        if ctx not in tree:
            return p(tree, ctx[1:], s) if ctx else 1 / (alphabet.size - 1)
        n, below = tree[ctx], p(tree, ctx[1:], s) if ctx else 1 / (alphabet.size - 1)
        return (n[s] + len(n) * below) / (sum(n.values()) + len(n))

    gain = lambda c: sum(k * math.log(k / sum(often[c].values()) / p(often, c[1:], s)) for s, k in often[c].items()) / len(often[c])
    kept = {c[k:] for c in often if c and gain(c) >= min_gain for k in range(len(c) + 1)} | {()}
    tree = {c: often[c] for c in kept}

    def score(text):
        s = [0] * depth + [int(alphabet.table[b]) for b in " ".join(lower_words(text)).encode()] + [1]
        return sum(math.log10(p(tree, tuple(s[i - depth : i]), s[i])) - (math.log10(alphabet.others) if s[i] == alphabet.OTHER else 0) for i in range(depth, len(s)))

    return score, len(tree)


def test_suffix_tree_against_plain_python(frame, odd_rows):
    train = [(k, prose(k % 7, 40 + k)) for k in range(30)] + [(99, "zebra quilt"), (100, None)]
    model, rare = language_model.fit(frame(train), depth=4, min_count=6, min_gain=1.5)
    score, size = plain_tree([t for _, t in train], model.alphabet, 4, 6, 1.5)
    assert model.tree.count() == size > 50
    rows = [r for r in odd_rows if len(r[1] or "") < 10_000] + [(50, prose(3, 60)), (51, "ZEBRA  quilt\tßß"), (52, prose(77, 50))]
    for tree_bytes in (1 << 30, model.tree_bytes // 5):
        got = language_model.score(frame(rows), model, rare, keep=["doc_id", "text"], tree_bytes=tree_bytes).collect()
        assert len(got) == len(rows)
        assert all(math.isclose(r.score, score(r.text), rel_tol=1e-5, abs_tol=1e-4) for r in got)
    with pytest.raises(ValueError):
        language_model.score(frame(rows).withColumnRenamed("id", "score"), model, rare, keep=["score"])


def test_tree_predicts_held_out_text_better_than_words_alone(spark):
    got = language_model.op9_suffix_tree_lm(spark, "/root/testdata/sf0.01").where("held_out").selectExpr("sum(score) AS tree", "sum(base_score) AS base").first()
    assert got.tree > got.base


def test_empty_model(frame, odd_rows):
    model, rare = language_model.fit(frame([]))
    assert len(language_model.score(frame(odd_rows), model, rare, keep=["doc_id"]).collect()) == len(odd_rows)
    assert language_model.score(frame([]), model, rare).collect() == []


def test_language_model_is_built_in_little_memory():
    """The driver builds it: at most four arrays of the tree's size at once (the old way took over seven)."""
    import tracemalloc

    from tracelake.llm.language_id import ALPHABET, PPM, Alphabet

    alphabet, rng = Alphabet.of_counts(np.full(256, 9), ALPHABET), np.random.default_rng(5)
    square = alphabet.size**2
    grams = {}
    for lang in "abcd":
        codes = np.unique(rng.integers(0, square, 40)[:, None] * square + rng.integers(0, square, (40, 60)))
        grams[lang] = (codes, rng.integers(1, 9, len(codes)))
    tracemalloc.start()
    try:
        model = PPM(list("abcd"), alphabet, grams)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 4 * model.tree.costs.nbytes
    assert np.isfinite(model.tree.costs).all() and (model.usual > 0).all()
