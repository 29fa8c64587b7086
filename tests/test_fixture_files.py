"""Files that the executors write: several parts and table files, nulls, block sizes, and what the driver is sent."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql.classic.dataframe import DataFrame
from tracelake import fixture_files as W
from tracelake import queries as catalogue
from tracelake.plans.api import open_mf4
from tracelake.sources import blocks as B


def table(folder, name, *files):
    os.makedirs(folder / f"{name}.parquet")
    for k, t in enumerate(files):
        pq.write_table(t, folder / f"{name}.parquet" / f"part-{k}.parquet", row_group_size=1000)
    return str(folder)


def events(first, n):
    at = np.arange(first, first + n)
    return pa.table({"event_id": at, "ts": pa.array(at * 1000, pa.timestamp("us")), "value": at / 7})


@pytest.fixture
def several(tmp_path, monkeypatch):
    """A table of three files, the largest in the middle, that becomes many parts."""
    monkeypatch.setattr(W, "PART_BYTES", 20_000)
    return table(tmp_path, "events", events(0, 700), events(700, 5000), events(5700, 1300))


@pytest.mark.parametrize("name", ["samples_long", "scan_dl_equal", "scan_dl_offsets", "scan_dl_spanning", "scan_dz_deflate", "scan_dz_transposed", "scan_hl_dl_dz", "scan_filtered", "samples_ns"])
def test_many_parts_in_the_order_of_files(spark, several, name):
    """Records lie in the order of the table's files by name, however Spark deals them out."""
    df = catalogue.queries()[name](spark, several)
    if name.startswith("samples"):
        got = df.where("channel = 'value'").select("record_index", "value_num").orderBy("record_index").collect()
        assert [tuple(r) for r in got] == [(k, k / 7) for k in range(7000)]
    else:
        lo, hi = (1750, 5250) if name == "scan_filtered" else (0, 7000)
        assert sorted((r.event_id, r.value) for r in df.collect()) == [(k, k / 7) for k in range(lo, hi)]


@pytest.mark.parametrize("name", ["conv_in_file", "raw_read", "scan_unsorted_two_groups", "scan_vlsd_text", "scan_vlsd_hl_dl_dz", "scan_vlsd_unsorted", "scan_dt_events"])
def test_the_driver_gets_sizes_only(spark, tmp_path, monkeypatch, name):
    """Making a file of 6000 rows sends the driver no column of a table and no more rows than there are parts."""
    keys = np.arange(6000)
    table(tmp_path, "events", events(0, 6000))
    table(tmp_path, "orders", pa.table({"o_orderkey": keys, "o_custkey": keys, "o_totalprice": keys / 4}))
    table(tmp_path, "lineitem", pa.table({"l_orderkey": keys, "l_linenumber": pa.array(keys % 7, pa.int32()), "l_quantity": keys / 2}))
    table(tmp_path, "documents", pa.table({"doc_id": keys, "text": [f"text {k} " * 9 for k in keys], "lang": ["en"] * 6000}))
    seen = []

    def counted(method):
        def run(self, *args):
            out = method(self, *args)
            seen.append(out.num_rows if isinstance(out, pa.Table) else len(out))
            return out

        return run

    for m in ("toArrow", "collect", "toPandas"):
        monkeypatch.setattr(DataFrame, m, counted(getattr(DataFrame, m)))
    df = catalogue.queries()[name](spark, str(tmp_path))
    assert seen and max(seen) <= 6000 // W.BUCKET + 1
    assert df.count() == (12_000 if name == "scan_unsorted_two_groups" else 6000)


@pytest.mark.parametrize("orders, lines", [(0, 50), (50, 0), (40, 13), (40, 173), (0, 0), (1000, 4000)])
def test_mixed_records_of_any_numbers(spark, tmp_path, monkeypatch, orders, lines):
    monkeypatch.setattr(W, "PART_BYTES", 500)
    o, i = np.arange(orders), np.arange(lines)
    table(tmp_path, "orders", pa.table({"o_orderkey": o, "o_custkey": o + 1, "o_totalprice": o / 4}))
    table(tmp_path, "lineitem", pa.table({"l_orderkey": i, "l_linenumber": pa.array(i % 7, pa.int32()), "l_quantity": i / 2}))
    got = sorted(map(tuple, catalogue.queries()["scan_unsorted_two_groups"](spark, str(tmp_path)).collect()))
    assert got == sorted([(0, k, k + 1.0, k / 4) for k in range(orders)] + [(1, k, float(k % 7), k / 2) for k in range(lines)])
    got = catalogue.queries()["scan_unsorted_ranges"](spark, str(tmp_path)).collect()
    assert sorted((r.record_index, r.l_orderkey) for r in got) == [(k, k) for k in range(lines)]


@pytest.mark.parametrize("name", ["scan_vlsd_text", "scan_vlsd_dl_spanning", "scan_vlsd_hl_dl_dz", "scan_vlsd_unsorted"])
def test_texts_of_many_parts_and_nulls(spark, tmp_path, monkeypatch, name):
    """Texts of any length, null ones too, in parts that cut blocks."""
    monkeypatch.setattr(W, "PART_BYTES", 30_000)
    texts = [None if k % 11 == 3 else "" if k % 11 == 4 else f"é{k}" * (k % 90) for k in range(1500)] + ["long" * 40_000, "end"]
    langs = [None if k % 5 == 0 else "en" for k in range(len(texts))]
    whole = pa.table({"doc_id": np.arange(len(texts)), "text": texts, "lang": langs})
    table(tmp_path, "documents", whole.slice(0, 300), whole.slice(300))
    got = {r.doc_id: (r.text, None if name == "scan_vlsd_unsorted" else r.lang) for r in catalogue.queries()[name](spark, str(tmp_path)).collect()}
    assert got == {k: (t, None if name == "scan_vlsd_unsorted" else x) for k, (t, x) in enumerate(zip(texts, langs, strict=True))}


def test_nulls_are_invalid_records(spark, tmp_path):
    table(tmp_path, "orders", pa.table({"o_orderkey": [1, 2, None], "o_custkey": [7, 8, 9], "o_totalprice": [None, 2.5, 4.0], "o_orderstatus": ["O", None, "P"]}))
    got = catalogue.queries()["conv_in_file_2"](spark, str(tmp_path)).collect()
    assert {(r.o_orderkey, r.v) for r in got} == {(1, None), (2, 6 / 27.5), (None, 9 / 29)}
    got = catalogue.queries()["conv_in_file_9"](spark, str(tmp_path)).collect()
    assert {(r.o_orderkey, r.v) for r in got} == {(1, 1.0), (2, None), (None, 9.0)}


@pytest.mark.parametrize("name", ["scan_dz_deflate", "scan_dz_transposed"])
def test_zipped_blocks_stay_within_the_formats_limit(spark, tmp_path, name):
    """A stream over 4 MB is a list of zipped blocks, so no task inflates all of it."""
    n = 400_000
    path = table(tmp_path, "events", events(0, n))
    got = catalogue.queries()[name](spark, path)
    assert got.agg({"event_id": "sum"}).first()[0] == n * (n - 1) // 2
    at = catalogue._events_file(spark, path, name.removeprefix("scan_"))
    with B.Source(at) as src:
        parts = B.fragments(src, open_mf4(spark, at).file.groups[0].data_at)
    assert len(parts) > 1 and max(p.length for p in parts) <= 4 << 20 and sum(p.length for p in parts) == 24 * n
