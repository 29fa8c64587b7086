from __future__ import annotations

import itertools
import random

import pytest
from plain import prose, shingles
from tracelake.llm import components, near_dup
from tracelake.llm.components import connected_components


def brute(rows, percent=85):
    """{id: component} by comparing all pairs."""
    sets, parent = {}, {}
    for r in rows:
        if r[0] is not None:
            sets.setdefault(r[0], []).append(shingles(r[1]))
            parent[r[0]] = r[0]

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, sa), (b, sb) in itertools.combinations(sets.items(), 2):
        if any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sa for y in sb):
            p, q = sorted((find(a), find(b)))
            parent[q] = p
    return {i: find(i) for i in sets}


def edited(text, k, seed):
    r = random.Random(seed)
    w = text.split()
    for _ in range(k):
        w[r.randrange(len(w))] = f"edit{r.randrange(10**6)}"
    return " ".join(w)


def check(frame, rows):
    got = near_dup.near_duplicates(frame(rows)).collect()
    want = brute(rows)
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert r.component_id == want[r.doc_id], r
            assert r.kept == (r.component_id == r.doc_id)
    counts = sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles) for r in got)
    assert counts == sorted((r[0] is None, r[0] or 0, len(shingles(r[1]))) for r in rows)


def test_odd_rows(frame, odd_rows):
    check(frame, odd_rows)


def test_empty(frame):
    assert near_dup.near_duplicates(frame([])).collect() == []
    assert near_dup.keep_one(frame([])).collect() == []


def test_groups_chains_and_borders(frame):
    rows = []
    base = prose(10, 200)
    for k in range(60):  # near copies from almost equal to just unlike
        rows.append((k, edited(base, k // 8, k)))
    chain = prose(11, 150)
    for k in range(100, 130):  # a chain: neighbours are alike, the ends are not
        chain = edited(chain, 1, k)
        rows.append((k, chain))
    shared = prose(12, 40)
    for k in range(200, 240):  # one passage in otherwise different texts
        rows.append((k, f"{prose(k, 60)} {shared} {prose(k + 1000, 60)}"))
    for k in range(300, 330):
        rows.append((k, prose(13, 30)))  # exact copies
    check(frame, rows)


def test_keep_one(frame, odd_rows):
    kept = near_dup.keep_one(frame(odd_rows))
    ids = sorted((r.doc_id is not None, r.doc_id or 0) for r in kept.collect())
    want = brute(odd_rows)
    assert [i for known, i in ids if known] == sorted(i for i, c in want.items() if i == c)
    assert sum(not known for known, _ in ids) == 2
    assert kept.columns == frame(odd_rows).columns


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(0, 40)] + [(100, 90), (90, 95), (7, 7), (None, 3), (200, 201), (201, 202), (202, 200)], "a long, b long")
    got = {r.id: r.component for r in connected_components(edges).collect()}
    assert got == {k: 0 for k in range(41)} | {90: 90, 95: 90, 100: 90, 200: 200, 201: 200, 202: 200}


@pytest.mark.parametrize("most", [8 << 20, 0])
def test_components_by_either_join(spark, monkeypatch, most):
    """Labels sent to every task and labels that are joined give the same; few labels take few tasks where partitions are many."""
    monkeypatch.setattr(components, "BROADCAST_BYTES", most)
    rng = random.Random(3)
    pairs = [(0, k) for k in range(1, 300)] + [(k, k + 1) for k in range(1000, 1012)] + [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(120)]
    want = {k: k for p in pairs for k in p if p[0] != p[1]}
    while any(want.get(a, a) != want.get(b, b) for a, b in pairs):
        for a, b in pairs:
            want[a] = want[b] = min(want[a], want[b])
    held = {"spark.sql.shuffle.partitions": "20", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in held}
    tracker, group = spark.sparkContext.statusTracker(), f"components-{most}"
    spark.sparkContext.setJobGroup(group, "")
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        labels = connected_components(spark.createDataFrame(pairs, "a long, b long"))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert {r.id: r.component for r in labels.collect()} == want
    stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
    tasks = sum(i.numCompletedTasks for s in stages if (i := tracker.getStageInfo(s)))
    rounds = int(labels.inputFiles()[0].rsplit("/", 2)[1].removeprefix("labels")) + 1
    if most:
        assert tasks < 100 + 60 * rounds


def test_whole_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = brute(rows)
    got = {r.doc_id: r.component_id for r in near_dup.op10_minhash_near_dup(spark, sf).collect()}
    assert got == want


def test_pipeline_stage_links_from_80_percent_on(spark, frame):
    pipeline = pytest.importorskip("corpus_pipeline")
    rows = []
    for k in range(0, 40, 2):  # pairs around the border, most of them between 0.80 and 0.85
        text = prose(400 + k, 300)
        rows += [(k, text), (k + 1, edited(text, 5 + k % 12, k))]
    want, close = brute(rows, 80), brute(rows, 85)
    assert len(set(want.values())) < len(set(close.values()))
    assert sorted(r.doc_id for r in pipeline.near_duplicates(spark, frame(rows), "").collect()) == sorted(set(want.values()))


@pytest.mark.parametrize("place", [13, 7])
def test_templated_texts_make_no_pairs(spark, place):
    """Notices that differ in one number: shared shingles are in no prefix that matters, whether the set is small or larger."""
    from tracelake.llm.shared import Scratch

    for length in (13, 56):
        w = [f"w{k}" for k in range(length)]
        rows = [(k, " ".join(w[:place] + [f"n{k}"] + w[place:])) for k in range(3000)]
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        texts = docs.selectExpr("doc_id AS id", "text")
        left = docs.selectExpr("doc_id AS id", "doc_id AS component")
        assert near_dup.prefix_pairs(left, texts, 5, 85, Scratch(spark, "t")).count() == 0


def test_prefix_pairs_lose_nothing(spark):
    r = random.Random(11)
    texts = {}
    for k in range(240):  # families of many sizes around the threshold
        w = prose(k % 9, 12 + 9 * (k % 13)).split()
        cut = r.randrange(0, 1 + len(w) // 20)
        w = w[cut:] + [f"x{k}"] * r.randrange(2)
        texts[k] = edited(" ".join(w), r.randrange(0, 2), k)
    sets = {k: shingles(t) for k, t in texts.items()}
    want = {(a, b) for a, b in itertools.combinations(texts, 2) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])}
    from tracelake.llm.shared import Scratch

    docs = spark.createDataFrame(list(texts.items()), "id long, text string")
    for component in ("id", "id % 3"):
        got = {(x.a, x.b) for x in near_dup.prefix_pairs(docs.selectExpr("id", f"{component} AS component"), docs, 5, 85, Scratch(spark, "t")).collect()}
        assert {p for p in want if component == "id" or p[0] % 3 != p[1] % 3} <= got
    assert len(want) > 50


def test_size_bands():
    bands = near_dup.size_bands(10_000).tolist()
    assert bands[:60] == list(range(1, 61)) and bands[-1] > 10_000 and all(a < b for a, b in zip(bands, bands[1:], strict=False))
    for x in range(1, 60):
        for y in range(1, 60):
            t = near_dup.overlap(x, y, 85)
            assert 100 * t >= 85 * (x + y - t) and 100 * (t - 1) < 85 * (x + y - t + 1)
