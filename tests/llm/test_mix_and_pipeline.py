from __future__ import annotations

import math

import duckdb
import pytest
from plain import prose, words
from tracelake.llm import mixing
from tracelake.llm import queries as catalogue


def plain_targets(sizes):
    """Water filling by repetition."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(order)}
    left, open_, out = sum(sizes.values()), set(order), {}
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not full:
            return out | share
        for s in full:
            out[s] = 3 * sizes[s]
            left -= out[s]
        open_ -= full
    return out


def test_mix(frame, odd_rows):
    rows = odd_rows + [(100 + k, prose(k, 20 + k), "en", f"s{k % 5}") for k in range(60)] + [(200, prose(5, 30), "en", ""), (201, None, "en", "zero"), (202, prose(6, 5), "en", "tiny")]
    got = mixing.mixed(frame(rows)).collect()
    again = mixing.mixed(frame(rows[::-1])).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again)) and len(got) == len(rows)
    source = {}
    for r in rows:
        s = r[3] if len(r) > 3 else "a"
        source[s] = source.get(s, 0) + len(words(r[1]))
    want = plain_targets(source)
    sizes = {v: 0 for v in want.values()}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        near = min(want.values(), key=lambda t: abs(t - r.target))
        assert math.isclose(near, r.target, rel_tol=1e-9, abs_tol=1e-9)
        sizes[near] += r.taken
    assert sum(r.taken for r in got) == sum(source.values())
    assert all(abs(taken - target) <= 2 * len(want) for target, taken in sizes.items() if list(want.values()).count(target) == 1)


def test_mix_schedule_is_in_virtual_time(frame, odd_rows):
    _, copies = mixing.schedule(frame(odd_rows))
    rows = sorted(copies.collect(), key=lambda r: r.position)
    assert [r.finish for r in rows] == sorted(r.finish for r in rows)
    assert all(a.position + a.words == b.position for a, b in zip(rows, rows[1:], strict=False))


def test_mix_of_nothing(frame):
    assert mixing.mixed(frame([])).collect() == []
    assert [r.taken for r in mixing.mixed(frame([(1, None), (2, "")])).collect()] == [0, 0]


def test_keep_mixed(frame, odd_rows):
    got = mixing.keep_mixed(frame(odd_rows))
    assert "taken" in got.columns and len(got.columns) == len(set(got.columns))
    assert all(r.taken > 0 for r in got.collect())


def test_pipeline_stages_against_brute_force(spark, sf):
    pipeline = pytest.importorskip("corpus_pipeline")
    from test_near_dup import brute
    from test_text_ops import plain_quality

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    first = pipeline.quality_rules(spark, docs, sf)
    rows = [r for r in docs.collect() if plain_quality(r.text)[-1]]
    assert sorted(map(repr, first.collect())) == sorted(map(repr, rows))
    second = pipeline.known_language(spark, first, sf)
    assert sorted(map(repr, second.collect())) == sorted(map(repr, rows))  # all are in a known language
    third = pipeline.near_duplicates(spark, second, sf)
    group = brute([(r.doc_id, r.text) for r in rows], 80)
    rows = [r for r in rows if group[r.doc_id] == r.doc_id]
    assert sorted(map(repr, third.collect())) == sorted(map(repr, rows))
    from plain import shingles

    fourth = pipeline.decontamination(spark, third, sf)
    items = [shingles(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rows = [r for r in rows if not any(s and 100 * len(s & shingles(r.text)) >= 80 * len(s) for s in items)]
    assert sorted(map(repr, fourth.collect())) == sorted(map(repr, rows))
    assert third.columns == fourth.columns == names
    last = pipeline.source_mix(spark, fourth, sf).collect()
    assert sum(r.taken for r in last) == sum(len(words(r.text)) for r in rows)
    assert {r.doc_id for r in last} <= {r.doc_id for r in rows}
    whole = pipeline.run(spark, sf).collect()
    assert sorted(map(repr, whole)) == sorted(map(repr, last))


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_against_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = catalogue.queries()[name](spark, sf)
    columns = sorted(df.columns)
    want = con.execute(catalogue.oracle_sql()[name])
    order = [d[0] for d in want.description]
    assert sorted(order) == columns
    rows = [tuple(r[order.index(c)] for c in columns) for r in want.fetchall()]
    assert sorted(map(repr, rows)) == sorted(repr(tuple(r)) for r in df.select(*columns).collect())


def test_pipeline_stages_on_odd_rows_and_no_rows(spark, frame, odd_rows, sf):
    pipeline = pytest.importorskip("corpus_pipeline")
    for rows in (odd_rows + [(300 + k, prose(k, 80), None, None) for k in range(5)], []):
        docs = frame(rows)
        names = docs.columns
        for name, stage in pipeline.STAGES:
            out = stage(spark, docs, sf)
            got = out.collect()
            if name == "source_mix":
                assert set(names) - {"size"} <= set(out.columns) and len(set(out.columns)) == len(out.columns)
            else:
                assert out.columns == names and {repr(r) for r in got} <= {repr(r) for r in docs.collect()}
            if not rows:
                assert got == []
            if name == "near_dedup" and rows:
                assert sorted(r.doc_id for r in got if r.doc_id in (4, 5)) == [4]


def test_keep_mixed_against_mixed(frame, odd_rows):
    rows = [r for r in odd_rows if r[0] not in (4, None)] + [(400 + k, prose(k, 30 + k), "en", f"s{k % 3}") for k in range(30)]
    want = {r.doc_id: r.taken for r in mixing.mixed(frame(rows)).collect() if r.taken}
    assert {r.doc_id: r.taken for r in mixing.keep_mixed(frame(rows)).collect()} == want


def test_sizes_of_parts_do_not_matter(frame, odd_rows, monkeypatch):
    rows = odd_rows + [(400 + k, prose(k, 30 + k), "en", f"s{k % 3}") for k in range(30)]
    want = sorted(map(repr, mixing.mixed(frame(rows)).collect()))
    monkeypatch.setattr(mixing, "PART_ROWS", 0.001)
    assert sorted(map(repr, mixing.mixed(frame(rows)).collect())) == want
