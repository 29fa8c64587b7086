from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tracelake import fixtures as X
from tracelake.plans.api import open_mf4
from tracelake.sources import blocks as B
from tracelake.sources import datasource as S
from tracelake.sources import decode as D

LAYOUTS = ("dt", "dl_equal", "dl_offsets", "dl_spanning", "dz_deflate", "dz_transposed", "hl_dl_dz")


def source(tmp_path, data, name="f.mf4"):
    p = tmp_path / name
    p.write_bytes(data)
    return str(p)


def columns(path, group=0, first=0, last=1 << 40):
    with B.Source(path) as src:
        f = B.MeasurementFile.read(src)
        g = f.groups[group]
        batches = list(D.read_sorted(src, g, g.channels, first, min(last, g.cycles)) if g.is_sorted else D.read_unsorted(src, f.groups, g, g.channels))
    out = {}
    for b in batches:
        for n in b.schema.names:
            out.setdefault(n, []).extend(b.column(n).to_pylist())
    return out


@settings(max_examples=30, deadline=None)
@given(n=st.integers(0, 60), block=st.integers(1, 200), layout=st.sampled_from(LAYOUTS))
def test_layout_does_not_change_the_records(tmp_path_factory, n, block, layout):
    a = {"t": np.arange(n, dtype="<i8"), "v": np.arange(n) / 3, "w": np.arange(n).astype(">i2")}
    path = source(tmp_path_factory.mktemp("l"), X.Writer().file([X.Data([X.group_of_arrays(a, master="t")], layout, block)]))
    got = columns(path)
    assert got.get("t", []) == list(range(n)) and got.get("v", []) == [k / 3 for k in range(n)] and got.get("w", []) == list(range(n))


@pytest.mark.parametrize("layout", LAYOUTS)
def test_record_ranges(tmp_path, layout):
    path = source(tmp_path, X.Writer().file([X.Data([X.group_of_arrays({"v": np.arange(100.0)})], layout, 64)]))
    assert columns(path, first=37, last=71)["v"] == [float(k) for k in range(37, 71)]


@settings(max_examples=80, deadline=None)
@given(bits=st.integers(1, 64), shift=st.integers(0, 7), little=st.booleans(), signed=st.booleans(), seed=st.integers(0, 2**32))
def test_integers_of_any_width(bits, shift, little, signed, seed):
    c = B.Channel(0, "x", 0, 0, (0 if little else 1) + (2 if signed else 0), shift, 1, bits, 0, 0, False, None, None, None, None, 0, "x")
    n = D.width(c)
    rows = np.random.default_rng(seed).integers(0, 256, (5, n + 2), dtype=np.uint8)
    g = B.ChannelGroup(0, 0, 0, 0, 0, 0, 5, 0, 0, n + 2, 0, None, None, None, None, [c], 0, 0)
    want = []
    for r in rows:
        v = int.from_bytes(bytes(r[1 : 1 + n]), "little" if little else "big") >> shift & ((1 << bits) - 1)
        want.append(v - (1 << bits) if signed and v >> (bits - 1) else v)
    assert [int(v) for v in D.decode(rows, 0, c, g).to_pylist()] == want


def test_invalidation_bits_and_names(tmp_path):
    rows = b"".join(bytes([k, k % 2]) for k in range(6))
    ch = [X.Chan("a", 0, 0, 8, flags=2, inval_pos=0), X.Chan("a", 0, 0, 8), X.Chan("b", 0, 0, 8, flags=1), X.Chan("record_index", 0, 0, 8)]
    got = columns(source(tmp_path, X.Writer().file([X.Data([X.Group(ch, rows, 6, 1, 1)])])))
    assert got["a"] == [0, None, 2, None, 4, None] and got["a_1"] == list(range(6)) and got["b"] == [None] * 6
    assert "record_index_1" in got


def test_strings_and_bytes(tmp_path):
    row = "é\0".encode("latin-1") + "é".encode() + "é".encode("utf-16-le") + "é".encode("utf-16-be") + b"\x01\xff"
    ch = [X.Chan("l", 6, 0, 16), X.Chan("u", 7, 2, 16), X.Chan("w", 8, 4, 16), X.Chan("v", 9, 6, 16), X.Chan("b", 10, 8, 16)]
    got = columns(source(tmp_path, X.Writer().file([X.Data([X.Group(ch, row, 1, len(row))])])))
    assert (got["l"], got["u"], got["w"], got["v"], got["b"]) == (["é"], ["é"], ["é"], ["é"], [b"\x01\xff"])


def test_half_precision_and_virtual(tmp_path):
    v = np.array([0.5, -2.0], "<f2")
    ch = [X.Chan("h", 4, 0, 16), X.Chan("i", 0, 0, 0, type=3)]
    got = columns(source(tmp_path, X.Writer().file([X.Data([X.Group(ch, v.tobytes(), 2, 2)])])))
    assert got["h"] == [0.5, -2.0] and got["i"] == [0, 1]


@pytest.mark.parametrize("rid", [1, 2, 4, 8])
def test_unsorted(tmp_path, rid):
    out = b""
    for k in range(20):
        out += (1).to_bytes(rid, "little") + np.int32(k).tobytes() + bytes(8)
        if k % 3 == 0:
            out += (3).to_bytes(rid, "little") + np.float64(k / 2).tobytes()
        out += (2).to_bytes(rid, "little") + k.to_bytes(4, "little") + b"x" * k
    one = X.Group([X.Chan("k", 2, 0, 32), X.Chan("s", 7, 4, 64, type=1, signal_group=2)], cycles=20, data_bytes=12, record_id=1)
    two = X.Group([], cycles=20, record_id=2, flags=1)
    three = X.Group([X.Chan("h", 4, 0, 64)], cycles=7, data_bytes=8, record_id=3)
    for layout in ("dt", "dl_spanning", "dz_deflate", "hl_dl_dz"):
        path = source(tmp_path, X.Writer().file([X.Data([one, two, three], layout, 16, rid, out)]))
        f = open_groups(path)
        got = columns(path, f[1])
        assert got["k"] == list(range(20)) and got["s"] == ["x" * k for k in range(20)]
        assert columns(path, f[3])["h"] == [k / 2 for k in range(0, 20, 3)]


def open_groups(path):
    with B.Source(path) as src:
        return {g.record_id: g.flat_index for g in B.MeasurementFile.read(src).groups}


def test_errors(tmp_path):
    good = X.Writer().file([])
    with pytest.raises(B.MeasurementFileError):
        columns(source(tmp_path, b"not a file" * 20))
    with pytest.raises(B.VersionError):
        columns(source(tmp_path, X.Writer(330).file([])))
    with pytest.raises(B.NotFinalizedError):
        columns(source(tmp_path, X.Writer(unfinalized=1).file([X.Data([X.group_of_arrays({"v": np.arange(2.0)})])])))
    with pytest.raises(B.MeasurementFileError):
        columns(source(tmp_path, good[:70]))
    bad = X.Group([X.Chan("k", 2, 0, 32)], cycles=1, data_bytes=4, record_id=1)
    with pytest.raises(B.MeasurementFileError):
        columns(source(tmp_path, X.Writer().file([X.Data([bad], "dt", 0, 1, b"\x07abcd")])))


def test_circular_list(tmp_path):
    w = X.Writer()
    data = bytearray(w.file([X.Data([X.group_of_arrays({"v": np.arange(2.0)})])]))
    at = int.from_bytes(data[64 + 24 : 64 + 32], "little")
    data[at + 24 : at + 32] = at.to_bytes(8, "little")
    with pytest.raises(B.MeasurementFileError, match="circle"):
        columns(source(tmp_path, bytes(data)))


def test_newer_groups_and_empty_group(spark, tmp_path):
    g = X.group_of_arrays({"v": np.arange(3.0)}, master_group=True)
    e = X.Group([X.Chan("v", 4, 0, 64)], b"", 0, 8)
    f = open_mf4(spark, source(tmp_path, X.Writer(420).file([X.Data([g]), X.Data([e])])))
    assert f.version == 420
    assert [r.v for r in f.table(0).orderBy("record_index").collect()] == [0.0, 1.0, 2.0]
    assert f.table(1).collect() == []


def test_known_sample_values(spark, tmp_path):
    """The published golden values of the format's classic examples: an integer channel and a wrapping byte ramp."""
    b = [5, 10, 0, 10, 5, 10, 10, 5, 0, 0, 10, 5, 10, 5, 10, 0, 0, 5, 5, 0]
    ramp = (np.arange(124) * 10).astype("<i1")
    data = X.Writer().file([X.Data([X.group_of_arrays({"time": np.arange(20.0), "channel_b": np.array(b, "<i8")}, master="time")]), X.Data([X.group_of_arrays({"ramp": ramp})], "hl_dl_dz", 32)])
    f = open_mf4(spark, source(tmp_path, data))
    assert [r.channel_b for r in f.sample(0, "channel_b").orderBy("record_index").collect()] == b
    assert [r.ramp for r in f.sample(1, "ramp").orderBy("record_index").collect()] == ramp.tolist()


def test_facade(spark, tmp_path):
    g = X.group_of_arrays({"t": np.arange(50.0), "v": np.arange(50, dtype="<i4")}, master="t", rules={"v": X.Rule(1, [1.0, 2.0], unit="V")})
    folder = tmp_path / "many"
    folder.mkdir()
    for k in range(3):
        source(folder, X.Writer().file([X.Data([g])], attachments=[X.Attachment(b"abc", f"n{k}.txt")]), f"{k}.mf4")
    f = open_mf4(spark, str(folder))
    df = f.table(0, ["v"], file_column="file", partition_mb="0.0001")
    assert df.count() == 150 and df.select("file").distinct().count() == 3
    assert df.rdd.getNumPartitions() > 3
    assert df.schema["v"].metadata["unit"] == "V" and f.table().schema["t"].metadata["master"] is True
    assert sorted(r.v for r in df.where("file like '%0.mf4'").collect()) == [1.0 + 2 * k for k in range(50)]
    assert f.raw_sample(0, "v").where("record_index >= 45 and record_index <= 46").select("v").collect()[0].v == 45
    with pytest.raises(Exception, match="no channel"):
        f.table(0, ["nope"])
    with pytest.raises(Exception, match="no channel group"):
        f.table(9)
    saved = f.save_attachments(str(tmp_path / "out"))
    assert len(saved) == 3 and open(saved[0], "rb").read() == b"abc"
    assert [r.name for r in f.channel_names().where("dg_index = 0").collect()].count("t") == 3
    assert {r.name for r in f.map_channels().collect()} == {"v"}
    kept = open_mf4(spark, str(folder / "0.mf4"), memory_optimized=False)
    assert kept.table().count() == 50 and kept.is_finalized()


def test_record_filters_prune_partitions(spark, tmp_path):
    path = source(tmp_path, X.Writer().file([X.Data([X.group_of_arrays({"v": np.arange(1000.0)})])]))
    df = open_mf4(spark, path).raw(0, partition_mb="0.001").where("record_index < 100")
    assert df.count() == 100 and df.rdd.getNumPartitions() == 1


def test_stream_of_a_folder(spark, tmp_path):
    from tracelake.streaming.folder import register

    register(spark)
    folder = tmp_path / "in"
    folder.mkdir()
    one = lambda a: X.Writer().file([X.Data([X.group_of_arrays({"v": np.arange(a, a + 10.0)})])])
    source(folder, one(0), "a.mf4")
    df = spark.readStream.format("mf4_stream").load(str(folder))
    q = df.writeStream.format("memory").queryName("measured").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        q.processAllAvailable()
        assert spark.table("measured").count() == 10
        source(folder, one(10), "b.mf4")
        q.processAllAvailable()
        assert sorted(r.v for r in spark.table("measured").collect()) == [float(k) for k in range(20)]
    finally:
        q.stop()


def test_stream_takes_late_names_and_leaves_broken_files(spark, tmp_path):
    from tracelake.streaming.folder import register

    register(spark)
    folder = tmp_path / "in"
    folder.mkdir()
    one = lambda a, **w: X.Writer(**w).file([X.Data([X.group_of_arrays({"v": np.arange(a, a + 10.0)})])])
    source(folder, one(0), "m.mf4")

    def start():
        return spark.readStream.format("mf4_stream").option("max_files", 1).load(str(folder)).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).start(str(tmp_path / "out"))

    read = lambda: sorted(r.v for r in spark.read.parquet(str(tmp_path / "out")).collect())
    q = start()
    try:
        q.processAllAvailable()
        source(folder, b"broken", "z.mf4")
        source(folder, one(50, unfinalized=1), "y.mf4")
        source(folder, one(10), "a.mf4")  # sorts before what has been read
        q.processAllAvailable()
        assert read() == [float(k) for k in range(20)]
    finally:
        q.stop()
    source(folder, one(20), "b.mf4")
    source(folder, one(50), "y.mf4")
    q = start()  # goes on where it stopped
    try:
        q.processAllAvailable()
        assert read() == [float(k) for k in [*range(30), *range(50, 60)]]
    finally:
        q.stop()


@pytest.mark.parametrize("chunk", [7, 64, 1 << 20])
def test_mixed_records_of_fixed_length(tmp_path, monkeypatch, chunk):
    monkeypatch.setattr(D, "CHUNK_BYTES", chunk)
    out = b"".join(b"\1" + np.int32(k).tobytes() + (b"\2" + np.float64(k / 2).tobytes()) * (k % 3) for k in range(200))
    one = X.Group([X.Chan("k", 2, 0, 32)], cycles=200, data_bytes=4, record_id=1)
    two = X.Group([X.Chan("h", 4, 0, 64)], cycles=199, data_bytes=8, record_id=2)
    path = source(tmp_path, X.Writer().file([X.Data([one, two], "dl_spanning", 50, 1, out)]))
    f = open_groups(path)
    assert columns(path, f[1])["k"] == list(range(200))
    assert columns(path, f[2])["h"] == [k / 2 for k in range(200) for _ in range(k % 3)]
    for bad, what in ((out + b"\7abc", "unknown"), (out + b"\1ab", "left over")):
        with pytest.raises(B.MeasurementFileError, match=what):
            columns(source(tmp_path, X.Writer().file([X.Data([one, two], "dt", 0, 1, bad)]), "bad.mf4"), f[1])


@pytest.mark.parametrize("late", [0, 3])
def test_mixed_records_in_ranges(spark, tmp_path, late):
    """Ranges of the stream give what the whole gives, also where texts follow their records later."""
    out, texts = b"", []
    for k in range(300):
        out += b"\1" + np.int32(k).tobytes() + bytes(8) + (b"\3" + np.float64(k).tobytes()) * (k % 2)
        texts.append(b"\2" + (k % 5).to_bytes(4, "little") + b"y" * (k % 5))
        if k % 7 >= late or len(texts) > late:
            out += b"".join(texts)
            texts = []
    out += b"".join(texts)
    one = X.Group([X.Chan("k", 2, 0, 32), X.Chan("s", 7, 4, 64, type=1, signal_group=2)], cycles=300, data_bytes=12, record_id=1)
    two, three = X.Group([], cycles=300, record_id=2, flags=1), X.Group([X.Chan("h", 4, 0, 64)], cycles=150, data_bytes=8, record_id=3)
    folder = tmp_path / "f"
    folder.mkdir()
    for name in ("a.mf4", "b.mf4"):
        path = source(folder, X.Writer().file([X.Data([one, two, three], "dl_spanning", 64, 1, out)]), name)
    f, group = open_mf4(spark, str(folder)), open_groups(path)
    for g in (group[1], group[3]):
        whole, cut = f.table(g, file_column="file"), f.table(g, file_column="file", sync=f.synchronised(g, 0.0005))
        assert cut.rdd.getNumPartitions() > 10 > whole.rdd.getNumPartitions()
        assert sorted(map(repr, cut.collect())) == sorted(map(repr, whole.collect()))
        assert cut.where("record_index >= 40 and record_index < 90").count() == 100
    assert f.table(group[1], sync=f.synchronised(group[1], 0.0005)).where("record_index < 5").rdd.getNumPartitions() < 5


def test_long_samples_keep_every_digit(spark, tmp_path):
    t = np.array([1_700_000_000_123_456_789, 2**62 + 1, -5], "<i8")
    u = np.array([2**64 - 1, 2**63 - 1, 0], "<u8")
    f = open_mf4(spark, source(tmp_path, X.Writer().file([X.Data([X.group_of_arrays({"t": t, "u": u, "x": np.array([0.5, 1, 2])}, master="t")], "dl_equal", 24)])))
    got = {(r.channel, r.record_index): (r.value_num, r.value_int) for r in spark.read.format("mf4_samples").option("partition_mb", "0.00002").load(f.path).collect()}
    assert {k: v[1] for k, v in got.items()} == {**{("t", k): int(v) for k, v in enumerate(t)}, ("u", 0): None, ("u", 1): 2**63 - 1, ("u", 2): 0, **{("x", k): None for k in range(3)}}
    assert got["u", 0][0] == float(2**64) and got["x", 0][0] == 0.5


def test_ranges_carry_only_their_blocks(tmp_path):
    from tracelake.sources.datasource import spans_of

    path = source(tmp_path, X.Writer().file([X.Data([X.group_of_arrays({"v": np.arange(1000.0)})], "dl_spanning", 100)]))
    with B.Source(path) as src:
        g = B.MeasurementFile.read(src).groups[0]
        spans = spans_of(src, g, 400)
        assert len(spans) == 20 and max(len(s.parts) for s in spans) <= 6
        got = [v for s in spans for b in D.read_sorted(src, g, g.channels, s.first, s.last, s.parts) for v in b.column(1).to_pylist()]
    assert got == [float(k) for k in range(1000)]


def test_attachments_with_one_name(spark, tmp_path):
    files = [X.Attachment(b"a", "x/n.txt"), X.Attachment(b"b", "y/n.txt"), X.Attachment(b"", "N.txt"), X.Attachment(b"d", "n_1.txt")]
    f = open_mf4(spark, source(tmp_path, X.Writer().file([], attachments=files)))
    saved = f.save_attachments(str(tmp_path / "out"))
    assert [(p.rsplit("/", 1)[1], open(p, "rb").read()) for p in saved] == [("n.txt", b"a"), ("n_1.txt", b"b"), ("N_2.txt", b""), ("n_1_1.txt", b"d")]
    assert f.save_attachments(str(tmp_path / "none"), "idx > 9") == []


@pytest.mark.parametrize("ranges", [None, 1, 7])
def test_as_of_against_plain_python(spark, ranges):
    import random

    from tracelake.operators import align

    r = random.Random(5)
    left = [(k, r.choice([None, *range(60)]), r.choice("ab")) for k in range(300)]
    right = [(t, f"{g}{t}", g) for g in "ab" for t in r.sample(range(-5, 70), 12)] + [(None, "no", "a")]
    a, b = spark.createDataFrame(left, "id long, t long, g string"), spark.createDataFrame(right, "t long, v string, g string")
    for by in ([], ["g"]):
        rows = right if by else [x for x in right if x[2] == "a"]
        got = {x.id: x.v for x in align.as_of(a, b if by else b.where("g = 'a'"), "t", ["v"], by, ranges).collect()}
        want = {k: max(((s, v) for s, v, h in rows if s is not None and t is not None and s <= t and (not by or h == g)), default=(0, None))[1] for k, t, g in left}
        assert got == want


def test_long_values_are_read_in_pieces(tmp_path, monkeypatch):
    monkeypatch.setattr(D, "SIGNAL_BYTES", 100)
    texts = [b"x" * (k * 7 % 90) for k in range(50)]
    at = np.concatenate([[0], np.cumsum([4 + len(t) for t in texts])[:-1]]).astype("<u8")
    for layout in ("sd", "dl_spanning", "hl_dl_dz"):
        g = X.Group([X.Chan("s", 7, 0, 64, type=1, signal=texts, signal_layout=layout)], at.tobytes(), 50, 8)
        got = columns(source(tmp_path, X.Writer().file([X.Data([g])])))
        assert got["s"] == [t.decode() for t in texts] and got["record_index"] == list(range(50))


def test_signal_streams_are_read_by_their_lists(tmp_path, monkeypatch):
    """A range of records reads the headers of its own blocks only, and texts count for the ranges' sizes."""
    texts = [b"%06d" % k * 50 for k in range(400)]
    at = np.cumsum([0] + [4 + len(t) for t in texts[:-1]]).astype("<u8")
    ch = [X.Chan("k", 0, 0, 64, type=0), X.Chan("t", 7, 0, 64, type=1, signal=texts, signal_layout="dl_spanning")]
    path = source(tmp_path, X.Writer().file([X.Data([X.Group(ch, at.tobytes(), 400, 8)])]))
    seen = []
    whole = B.fragment
    monkeypatch.setattr(B, "fragment", lambda *a: seen.append(a) or whole(*a))
    with B.Source(path) as src:
        g = B.MeasurementFile.read(src).groups[0]
        spans = S.spans_of(src, g, 20_000, channels=g.channels)
        assert len(seen) <= 3 and 5 <= len(spans) <= 8
        del seen[:]
        got = [b.column("t").to_pylist() for b in D.read_sorted(src, g, g.channels, spans[1].first, spans[1].last, spans[1].parts)]
        assert sum(got, []) == [t.decode() for t in texts[spans[1].first : spans[1].last]] and len(seen) <= 10


def test_lists_that_tell_wrong_places(tmp_path):
    """Where a list's places do not fit its blocks, the blocks' own lengths count."""
    texts = [b"%06d" % k * 50 for k in range(100)]
    at = np.cumsum([0] + [4 + len(t) for t in texts[:-1]]).astype("<u8")
    ch = [X.Chan("t", 7, 0, 64, type=1, signal=texts, signal_layout="dl_spanning")]
    data = bytearray(X.Writer().file([X.Data([X.Group(ch, at.tobytes(), 100, 8)])]))
    with B.Source(source(tmp_path, bytes(data))) as src:
        g = B.MeasurementFile.read(src).groups[0]
        dl = B.raw(src, g.channels[0].data_at, "##DL")
    data[dl.data_at + 16 : dl.data_at + 24] = (5000).to_bytes(8, "little")
    assert columns(source(tmp_path, bytes(data)))["t"] == [t.decode() for t in texts]


def test_ranges_of_mixed_records_read_their_own_blocks(tmp_path, monkeypatch):
    out = b"".join(b"\x01" + np.int32(k).tobytes() for k in range(2000))
    path = source(tmp_path, X.Writer().file([X.Data([X.Group([X.Chan("k", 2, 0, 32)], cycles=2000, data_bytes=4, record_id=1)], "dl_spanning", 64, 1, out)]))
    seen = []
    whole = B.fragment
    monkeypatch.setattr(B, "fragment", lambda *a: seen.append(a) or whole(*a))
    with B.Source(path) as src:
        f = B.MeasurementFile.read(src)
        got = [b.column("k").to_pylist() for b in D.read_unsorted(src, f.groups, f.groups[0], f.groups[0].channels, 500, 1000, 100)]
    assert sum(got, []) == list(range(100, 200)) and len(seen) <= 12
