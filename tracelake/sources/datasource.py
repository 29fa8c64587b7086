"""Spark data sources over measurement files (Python Data Source API).

=================  ====================================================================================================
``mf4``            one channel group as a table: ``record_index`` and a typed column for each channel (raw values)
``mf4_samples``    all groups, long: file, dg_index, cg_index, channel, record_index, value_num, value_int, value_text
``mf4_header``     one row a file
``mf4_groups``     one row a channel group
``mf4_channels``   one row a channel
``mf4_events``     events
``mf4_attachments``  attachments with their content
``mf4_history``    the change log
``mf4_reductions``  stored sample reductions
``mf4_hierarchy``  channel hierarchies
``mf4_reduced``    their records, long: mean, minimum and maximum of each channel in each interval
=================  ====================================================================================================

Options of ``mf4``: ``group`` (flat index, default 0), ``channels`` (comma-separated columns: only these are decoded),
``partition_mb`` (64), ``file_column`` (name of a column with the file's path), ``sync`` (places at which a mixed group may
be cut, as ``MeasurementSet.synchronised`` writes them).  Record ranges in filters on
``record_index`` prune partitions (``register`` turns on Spark's filter pushdown for Python sources).
"""

from __future__ import annotations

import bisect
import dataclasses
import datetime as dt
import hashlib
import json
import struct
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tracelake.sources import blocks as B
from tracelake.sources.decode import CHUNK_BYTES, arrow_type, decode, read_sorted, read_unsorted, signal_bytes, spark_type


def metadata(path: str) -> B.MeasurementFile:
    with B.Source(path) as src:
        return B.MeasurementFile.read(src)


def group_of(file: B.MeasurementFile, index: int) -> B.ChannelGroup:
    if not 0 <= index < len(file.groups):
        raise IndexError(f"{file.path}: no channel group {index}; there are {len(file.groups)}")
    return file.groups[index]


def picked(group: B.ChannelGroup, names: str | None) -> list[B.Channel]:
    own = [c for c in group.channels if c.is_virtual or c.type in (0, 1, 2, 4, 5)]
    if names is None:
        return own
    by = {c.column: c for c in own}
    wanted = [n.strip() for n in names.split(",") if n.strip()]
    if missing := [n for n in wanted if n not in by]:
        raise KeyError(f"no channel {', '.join(missing)}; there are {', '.join(by)}")
    return [by[n] for n in wanted]


def describe(c: B.Channel, group: B.ChannelGroup) -> dict:
    """Column metadata of a channel."""
    out = {"unit": c.unit, "comment": c.comment, "master": c.is_master, "channel": c.name, "conversion": c.conversion.kind if c.conversion else 0, "source": c.source.name if c.source else None, "group": group.name}
    return {k: v for k, v in out.items() if v is not None}


@dataclass
class Span(InputPartition):
    """Records first..last-1 of a group.

    Of a sorted one with the pieces of its stream that hold them, so a task reads no list of blocks; of a mixed one with
    the part of the stream that is gone through (begin, end, number of the first record in it).
    """

    path: str
    first: int
    last: int
    group: B.ChannelGroup | None = None
    parts: list[B.Fragment] | None = None
    part: tuple[int, int | None, int] = (0, None, 0)

    def __init__(self, path: str, first: int, last: int, group: B.ChannelGroup | None = None, parts: list[B.Fragment] | None = None, part: tuple[int, int | None, int] = (0, None, 0)):
        super().__init__((path, first, last, part))
        self.path, self.first, self.last, self.group, self.parts, self.part = path, first, last, group, parts, part


def spans_of(src: B.Source, g: B.ChannelGroup, size: int, low: int = 0, high: int = 1 << 62, sync: list | None = None, channels: list[B.Channel] = ()) -> list[Span]:
    """Record ranges of about ``size`` bytes of a group, the variable-length values of ``channels`` included.

    A group whose records are mixed with others is one range, or one for each of its ``sync`` points (place, records before).
    """
    if not g.is_sorted:
        if not g.data_at:
            return []
        points = [*(sync or [[0, 0]]), [None, 1 << 62]]
        return [Span(src.path, low, high, part=(a[0], b[0], a[1])) for a, b in zip(points, points[1:], strict=False) if a[1] < high and b[1] > low]
    n, parts = g.cycles, []
    if g.row_bytes:
        parts = B.fragments(src, g.data_at)
        n = min(n, (parts[-1].start + parts[-1].length) // g.row_bytes if parts else 0)
    step = max(1, int(size / (max(8, g.row_bytes) + signal_bytes(src, channels) / max(1, n))))
    lo, hi = max(0, low), min(n, high)
    starts, out = [f.start for f in parts], []
    for a in range(lo, hi, step):
        b = min(hi, a + step)
        own = parts[max(0, bisect.bisect_right(starts, a * g.row_bytes) - 1) : bisect.bisect_left(starts, b * g.row_bytes)]
        out.append(Span(src.path, a, b, g, own))
    return out


class GroupReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.paths = B.paths_of(options.get("path", ""))
        self.group = int(options.get("group", 0))
        self.channels = options.get("channels")
        self.size = int(float(options.get("partition_mb", 64)) * (1 << 20))
        self.file_column = options.get("file_column")
        self.sync: dict[str, list] = {}
        if at := options.get("sync"):
            fs, path = pafs.FileSystem.from_uri(at)
            with fs.open_input_stream(path) as f:
                self.sync = json.loads(f.read())
        self.low, self.high = 0, 1 << 62

    def pushFilters(self, filters: list) -> Iterator:
        for f in filters:
            if getattr(f, "attribute", None) == ("record_index",) and isinstance(getattr(f, "value", None), int):
                if isinstance(f, EqualTo):
                    self.low, self.high = max(self.low, f.value), min(self.high, f.value + 1)
                    continue
                if isinstance(f, GreaterThan | GreaterThanOrEqual):
                    self.low = max(self.low, f.value + isinstance(f, GreaterThan))
                    continue
                if isinstance(f, LessThan | LessThanOrEqual):
                    self.high = min(self.high, f.value + isinstance(f, LessThanOrEqual))
                    continue
            yield f

    def _spans(self, path: str) -> list[Span]:
        with B.Source(path) as src:
            g = group_of(B.MeasurementFile.read(src), self.group)
            return spans_of(src, g, self.size, self.low, self.high, self.sync.get(path), picked(g, self.channels))

    def partitions(self) -> list[Span]:
        with ThreadPoolExecutor(16) as pool:
            return [s for own in pool.map(self._spans, self.paths) for s in own] or [Span("", 0, 0)]

    def read(self, part: Span) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        with B.Source(part.path) as src:
            if part.group is not None:
                batches = read_sorted(src, part.group, picked(part.group, self.channels), part.first, part.last, part.parts)
            else:
                file = B.MeasurementFile.read(src)
                g = group_of(file, self.group)
                channels = picked(g, self.channels)
                batches = (_between(b, part.first, min(part.last, g.cycles or part.last)) for b in read_unsorted(src, file.groups, g, channels, *part.part))
            for b in batches:
                if self.file_column:
                    b = b.append_column(self.file_column, pa.array([part.path] * b.num_rows, pa.string()))
                yield b


def _between(b: pa.RecordBatch, first: int, last: int) -> pa.RecordBatch:
    if not b.num_rows:
        return b
    start = b.column(0)[0].as_py()
    lo, hi = max(0, first - start), max(0, min(b.num_rows, last - start))
    return b.slice(lo, max(0, hi - lo))


class GroupSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "mf4"

    def schema(self) -> StructType:
        paths = B.paths_of(self.options.get("path", ""))
        if not paths:
            raise FileNotFoundError(f"no measurement file at {self.options.get('path')!r}")
        g = group_of(metadata(paths[0]), int(self.options.get("group", 0)))
        fields = [StructField("record_index", LongType())]
        fields += [StructField(c.column, spark_type(arrow_type(c)), True, describe(c, g)) for c in picked(g, self.options.get("channels"))]
        if self.options.get("file_column"):
            fields.append(StructField(self.options["file_column"], StringType()))
        return StructType(fields)

    def reader(self, schema: StructType) -> DataSourceReader:
        return GroupReader(dict(self.options), schema)


@dataclass
class OneFile(InputPartition):
    path: str

    def __init__(self, path: str):
        super().__init__((path,))
        self.path = path


class _FileReader(DataSourceReader):
    """One task for each file; ``rows`` is given the open source and the file's metadata."""

    def __init__(self, options: dict, rows):
        self.paths = B.paths_of(options.get("path", ""))
        self.rows = rows
        self.permissive = options.get("mode", "").lower() == "permissive"

    def partitions(self) -> list[OneFile]:
        return [OneFile(p) for p in self.paths]

    def read(self, part: OneFile) -> Iterator:
        with B.Source(part.path) as src:
            it = iter(self.rows(src, B.MeasurementFile.read(src, allow_unfinalized=True)))
            while True:
                try:
                    row = next(it)
                except StopIteration:
                    return
                except (B.MeasurementFileError, struct.error, zlib.error):
                    if self.permissive:
                        return
                    raise
                yield row


def _micros(ns: int) -> dt.datetime:
    return dt.datetime(1970, 1, 1, tzinfo=dt.UTC) + dt.timedelta(microseconds=ns // 1000)


def header_rows(src: B.Source, f: B.MeasurementFile) -> Iterator[tuple]:
    h, i = f.header, f.id
    valid = h.time_flags == 1
    compat = h.start_ns if h.time_flags == 1 else h.start_ns + 2 * h.tz_min
    yield (f.path, i.file, i.version, i.number, i.program, i.finalized, h.start_ns, _micros(h.start_ns), h.tz_min if valid else None, h.dst_min if valid else None, h.time_flags, compat, h.angle if h.flags & 1 else None, h.distance if h.flags & 2 else None, h.comment or "")


def _source(s: B.SourceInfo | None) -> tuple | None:
    return None if s is None else (s.name, s.path, s.comment, s.type, s.bus_type, s.flag)


def group_rows(src: B.Source, f: B.MeasurementFile) -> Iterator[tuple]:
    for g in f.groups:
        kind = B.header(src, g.data_at)[0] if g.data_at else None
        yield (f.path, g.dg_index, g.cg_index, g.flat_index, g.record_id, g.record_id_size, g.cycles, g.data_bytes, g.inval_bytes, g.flags, g.kinds(f.id.number), g.name, g.comment, g.dg_comment, _source(g.source), g.is_sorted, kind, chr(g.separator) if g.separator else None, g.master.name if g.master else None)


def channel_rows(src: B.Source, f: B.MeasurementFile) -> Iterator[tuple]:
    for g in f.groups:
        for c in g.channels:
            cc = c.conversion
            yield (f.path, g.dg_index, g.cg_index, g.flat_index, c.index, c.name, c.column, B.CHANNEL_TYPES.get(c.type, ""), B.SYNC_TYPES.get(c.sync, ""), c.data_type, c.bit_offset, c.byte_offset, c.bit_count, c.flags, c.inval_pos, c.is_master, c.is_vlsd, c.composed, bool(c.flags & 1), not c.flags & 3, c.unit, c.comment, _source(c.source), None if cc is None else (cc.kind, cc.name, cc.unit, cc.comment), g.master.name if g.master else None)


def event_rows(src: B.Source, f: B.MeasurementFile) -> Iterator[tuple]:
    for k, b in enumerate(B.chain(src, f.header.first_ev, "##EV")):
        type_, sync, range_, cause, flags, _, scopes, _, creator, base, factor = B.data(src, b, "<BBBBB3sIHHqd")
        yield (f.path, k, B.text(src, b.link(3)) or "", B.text(src, b.link(4)) or "", type_, sync, range_, cause, flags, scopes, creator, base, factor)


def attachment_rows(src: B.Source, f: B.MeasurementFile) -> Iterator[tuple]:
    for k, b in enumerate(B.chain(src, f.header.first_at, "##AT")):
        flags, creator, _, md5, original, size = B.data(src, b, "<HHI16sQQ")
        name = B.text(src, b.link(1))
        content, ok = None, None
        if flags & 1:
            content = src.span(b.data_at + 40, size) if size else b""
            if flags & 2:
                content = zlib.decompress(content)
            if flags & 4:
                ok = hashlib.md5(content).digest() == md5
        path = (name or f"file-{k}").replace("\\", "/")
        yield (f.path, k, path.rsplit("/", 1)[-1], path, B.text(src, b.link(2)) or "", B.text(src, b.link(3)) or "", bool(flags & 1), bool(flags & 2), ok, original, creator, content)


def history_rows(src: B.Source, f: B.MeasurementFile) -> Iterator[tuple]:
    for k, b in enumerate(B.chain(src, f.header.first_fh, "##FH")):
        ns, tz, dst, flags = B.data(src, b, "<QhhB")
        note = B.text(src, b.link(1)) or ""
        yield (f.path, k, ns, _micros(ns), tz, dst, flags, note, f"{ns} {flags} {note}")


def reduction_rows(src: B.Source, f: B.MeasurementFile) -> Iterator[tuple]:
    for g in f.groups:
        for k, b in enumerate(B.chain(src, g.reductions_at, "##SR")):
            cycles, interval, sync, flags = B.data(src, b, "<QdBB")
            yield (f.path, g.dg_index, g.cg_index, k, cycles, interval, B.SYNC_TYPES.get(sync, ""), flags)


def hierarchy_rows(src: B.Source, f: B.MeasurementFile) -> Iterator[tuple]:
    """The tree of channel hierarchies, parents first; elements are (data group, channel group, channel) by number."""
    places = {c.at: (g.dg_index, g.cg_index, c.index) for g in f.groups for c in g.channels}
    left = [(b, None, 0) for b in reversed(list(B.chain(src, f.header.first_ch, "##CH")))]
    idx, seen = 0, set()
    while left:
        b, parent, level = left.pop()
        if b.at in seen:
            raise B.MeasurementFileError(f"{src.path}: the hierarchy runs in a circle at {b.at}")
        seen.add(b.at)
        count, kind = B.data(src, b, "<IB")
        elements = [places[to] for k in range(count) if (to := b.link(4 + 3 * k + 2)) in places]
        yield (f.path, idx, parent, level, B.text(src, b.link(2)) or "", B.text(src, b.link(3)) or "", B.HIERARCHY_TYPES.get(kind, ""), elements)
        left += [(c, idx, level + 1) for c in reversed(list(B.chain(src, b.link(1), "##CH")))]
        idx += 1


def reduced_rows(src: B.Source, f: B.MeasurementFile) -> Iterator[tuple]:
    """Records of stored reductions: three records of the group (mean, minimum, maximum) for each interval."""
    for g in f.groups:
        for k, b in enumerate(B.chain(src, g.reductions_at, "##SR")):
            cycles, interval, _, flags = B.data(src, b, "<QdBB")
            if not b.link(1) or not g.data_bytes:
                continue
            inval = g.inval_bytes if flags & 1 else 0
            own = dataclasses.replace(g, inval_bytes=0)
            channels = [c for c in picked(g, None) if not c.is_virtual and c.data_type <= 5]
            size = 3 * g.data_bytes + inval
            stream = B.Stream(src, B.fragments(src, b.link(1)))
            step = max(1, CHUNK_BYTES // size)
            last = min(cycles, stream.length // size)
            for first in range(0, last, step):
                stop = min(last, first + step)
                rows = np.frombuffer(stream.read(first * size, stop * size), np.uint8).reshape(stop - first, size)
                for c in channels:
                    each = [decode(np.ascontiguousarray(rows[:, p * g.data_bytes : (p + 1) * g.data_bytes]), first, c, own).cast(pa.float64(), safe=False).to_pylist() for p in range(3)]
                    yield from ((f.path, g.dg_index, g.cg_index, k, c.name, first + i, (first + i) * interval, *values) for i, values in enumerate(zip(*each, strict=True)))


@dataclass
class GroupSpan(InputPartition):
    index: int
    span: Span

    def __init__(self, index: int, span: Span):
        super().__init__((span.path, index, span.first))
        self.index, self.span = index, span


SAMPLES = "file string, dg_index int, cg_index int, channel string, record_index long, value_num double, value_int long, value_text string"


class SamplesReader(DataSourceReader):
    """All groups, long; sorted groups in the same record ranges as ``mf4``."""

    def __init__(self, options: dict):
        self.paths = B.paths_of(options.get("path", ""))
        self.size = int(float(options.get("partition_mb", 64)) * (1 << 20))

    def _spans(self, path: str) -> list[GroupSpan]:
        with B.Source(path) as src:
            return [GroupSpan(g.flat_index, s) for g in B.MeasurementFile.read(src).groups if g.data_at and not g.is_vlsd for s in spans_of(src, g, self.size, channels=picked(g, None))]

    def partitions(self) -> list:
        with ThreadPoolExecutor(16) as pool:
            return [s for own in pool.map(self._spans, self.paths) for s in own] or [GroupSpan(-1, Span("", 0, 0))]

    def read(self, part: GroupSpan) -> Iterator[pa.RecordBatch]:
        span = part.span
        if not span.path:
            return
        with B.Source(span.path) as src:
            if span.group is not None:
                g = span.group
                channels = picked(g, None)
                batches = read_sorted(src, g, channels, span.first, span.last, span.parts)
            else:
                file = B.MeasurementFile.read(src)
                g = file.groups[part.index]
                channels = picked(g, None)
                batches = read_unsorted(src, file.groups, g, channels)
            for b in batches:
                for k, c in enumerate(channels):
                    yield _long(span.path, g, c, b.column(0), b.column(k + 1))


def _long(path: str, g: B.ChannelGroup, c: B.Channel, index: pa.Array, col: pa.Array) -> pa.RecordBatch:
    """One channel's samples; ``value_int`` has every digit of whole numbers that fit 64 bits, ``value_num`` what a double can hold."""
    n, kind = len(col), col.type
    num, whole, text = pa.nulls(n, pa.float64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.string())
    if pa.types.is_binary(kind):
        text = pa.array([None if v is None else v.hex() for v in col.to_pylist()], pa.string())
    elif pa.types.is_string(kind):
        text = col
    elif pa.types.is_list(kind):
        text = pa.array([None if v is None else str(v) for v in col.to_pylist()], pa.string())
    else:
        num = col.cast(pa.float64(), safe=False)
        if pa.types.is_integer(kind):
            whole = col.cast(pa.int64())
        elif pa.types.is_decimal(kind):
            whole = pa.array([None if v is None or v >= 1 << 63 else int(v) for v in col.to_pylist()], pa.int64())
    fixed = lambda v, t: pa.array([v] * n, t)
    return pa.RecordBatch.from_arrays([fixed(path, pa.string()), fixed(g.dg_index, pa.int32()), fixed(g.cg_index, pa.int32()), fixed(c.name, pa.string()), index, num, whole, text], names=[x.split()[0] for x in SAMPLES.split(", ")])


class SamplesSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "mf4_samples"

    def schema(self) -> str:
        return SAMPLES

    def reader(self, schema: StructType) -> DataSourceReader:
        return SamplesReader(dict(self.options))


_SI = "struct<name:string,path:string,comment:string,type:string,bus_type:string,flag:string>"
TABLES = {
    "mf4_header": (header_rows, "file string, id string, version string, version_number int, created_by string, finalized boolean, start_time_ns long, start_time timestamp, tz_offset_min int, dst_offset_min int, time_flags int, start_time_ns_compat long, start_angle_rad double, start_distance_m double, comment string"),
    "mf4_groups": (group_rows, f"file string, dg_index int, cg_index int, flat_index int, record_id long, record_id_size int, cycle_count long, data_bytes long, inval_bytes long, flags int, kinds array<string>, name string, comment string, dg_comment string, source {_SI}, sorted boolean, data_block_id string, path_separator string, master_name string"),
    "mf4_channels": (channel_rows, f"file string, dg_index int, cg_index int, flat_index int, cn_index int, name string, column_name string, type string, sync_type string, data_type int, bit_offset int, byte_offset long, bit_count long, flags long, inval_bit_pos long, is_master boolean, is_vlsd boolean, is_composed boolean, all_invalid boolean, all_valid boolean, unit string, comment string, source {_SI}, conversion struct<type:int,name:string,unit:string,comment:string>, master_name string"),
    "mf4_events": (event_rows, "file string, idx int, name string, comment string, type int, sync_type int, range_type int, cause int, flags int, scope_count long, creator_index int, sync_base_value long, sync_factor double"),
    "mf4_attachments": (attachment_rows, "file string, idx int, name string, path string, mime_type string, comment string, embedded boolean, compressed boolean, md5_ok boolean, original_size long, creator_index int, content binary"),
    "mf4_history": (history_rows, "file string, idx int, time_ns long, time timestamp, tz_offset_min int, dst_offset_min int, time_flags int, comment string, entry string"),
    "mf4_reductions": (reduction_rows, "file string, dg_index int, cg_index int, idx int, cycle_count long, sample_interval double, sync_type string, flags int"),
    "mf4_hierarchy": (hierarchy_rows, "file string, idx int, parent int, level int, name string, comment string, type string, elements array<struct<dg_index:int,cg_index:int,cn_index:int>>"),
    "mf4_reduced": (reduced_rows, "file string, dg_index int, cg_index int, idx int, channel string, record_index long, start double, mean double, min double, max double"),
}


def _table(name_: str) -> type[DataSource]:
    rows, ddl = TABLES[name_]

    class Table(DataSource):
        @classmethod
        def name(cls) -> str:
            return name_

        def schema(self) -> str:
            return ddl

        def reader(self, schema: StructType) -> DataSourceReader:
            return _FileReader(dict(self.options), rows)

    Table.__name__ = Table.__qualname__ = "".join(x.title() for x in name_.split("_"))
    return Table


SOURCES = [GroupSource, SamplesSource, *[_table(n) for n in TABLES]]


def register(spark: SparkSession) -> None:
    """Make the formats known to a session and let filters reach them; doing so again changes nothing."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    if spark.conf.get("spark.tracelake.registered", "") != "yes":
        for s in SOURCES:
            spark.dataSource.register(s)
        spark.conf.set("spark.tracelake.registered", "yes")
