"""Record bytes to Arrow columns: typed, endian-aware, bit-exact, with invalidation bits as nulls."""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import types as T

from tracelake.sources.blocks import Channel, ChannelGroup, Fragment, MeasurementFileError, MisplacedError, Source, Stream, fragments, header, pieces, stream_length

UINT, UINT_BE, SINT, SINT_BE, REAL, REAL_BE, LATIN1, UTF8, UTF16, UTF16_BE, BYTES = range(11)
LITTLE = frozenset({0, 2, 4, 8, 15})
CHARSETS = {LATIN1: "latin-1", UTF8: "utf-8", UTF16: "utf-16-le", UTF16_BE: "utf-16-be"}
CHUNK_BYTES = 8 << 20
SIGNAL_BYTES = 32 << 20


def width(c: Channel) -> int:
    """Bytes that a channel's bits touch."""
    return (c.bit_offset + c.bit_count + 7) // 8


def arrow_type(c: Channel) -> pa.DataType:
    """The Arrow type of a channel's raw values; unsigned integers are widened, 64-bit ones are decimals."""
    if c.is_virtual:
        return pa.int64()
    if c.dims:
        return pa.list_(arrow_type(replace(c, dims=())))
    t, n = c.data_type, c.bit_count
    if t in (UINT, UINT_BE):
        return pa.int16() if n <= 8 else pa.int32() if n <= 16 else pa.int64() if n <= 63 else pa.decimal128(20, 0)
    if t in (SINT, SINT_BE):
        return pa.int8() if n <= 8 else pa.int16() if n <= 16 else pa.int32() if n <= 32 else pa.int64()
    if t in (REAL, REAL_BE):
        return pa.float32() if n <= 32 else pa.float64()
    if t in CHARSETS:
        return pa.string()
    return pa.binary()


SPARK_TYPES = {pa.int8(): T.ByteType(), pa.int16(): T.ShortType(), pa.int32(): T.IntegerType(), pa.int64(): T.LongType(), pa.decimal128(20, 0): T.DecimalType(20, 0), pa.float32(): T.FloatType(), pa.float64(): T.DoubleType(), pa.string(): T.StringType(), pa.binary(): T.BinaryType()}


def spark_type(kind: pa.DataType) -> T.DataType:
    return T.ArrayType(SPARK_TYPES[kind.value_type]) if pa.types.is_list(kind) else SPARK_TYPES[kind]


def _strings(values: list[bytes], t: int) -> pa.Array:
    if t in CHARSETS:
        end = "\x00"
        return pa.array([v.decode(CHARSETS[t], "replace").rstrip(end) for v in values], pa.string())
    return pa.array(values, pa.binary())


def _integers(part: np.ndarray, c: Channel) -> np.ndarray:
    """Unsigned 64-bit values of the channel's bits in rows of bytes."""
    n = part.shape[1]
    order = range(n - 1, -1, -1) if c.data_type in LITTLE else range(n)
    out = np.zeros(len(part), np.uint64)
    if n <= 8:
        for k in order:
            out = (out << np.uint64(8)) | part[:, k]
        out >>= np.uint64(c.bit_offset)
    else:  # up to 64 bits that touch nine bytes
        order = list(order)
        for k in order[1:]:
            out = (out << np.uint64(8)) | part[:, k]
        out = (out >> np.uint64(c.bit_offset)) | (part[:, order[0]].astype(np.uint64) << np.uint64(64 - c.bit_offset))
    if c.bit_count < 64:
        out &= np.uint64((1 << c.bit_count) - 1)
    return out


def decode(records: np.ndarray, first: int, c: Channel, group: ChannelGroup) -> pa.Array:
    """One channel of a block of records (rows of bytes); ``first`` is the index of the first record."""
    if c.dims:  # elements lie at equal distances, the last dimension's next to each other
        many = math.prod(c.dims)
        each = [decode(records, first, replace(c, dims=(), flags=0, byte_offset=c.byte_offset + k * c.step), group) for k in range(many)]
        order = pa.array(np.arange(many * len(records)).reshape(many, -1).T.reshape(-1))
        flat = pa.concat_arrays(each).take(order) if each else pa.array([], arrow_type(c).value_type)
        return _with_nulls(pa.ListArray.from_arrays(pa.array(np.arange(0, many * len(records) + 1, max(1, many), dtype=np.int32) if many else np.zeros(len(records) + 1, np.int32)), flat), records, c, group)
    kind = arrow_type(c)
    if c.is_virtual:
        return pa.array(np.arange(first, first + len(records)))
    n = width(c)
    part = records[:, c.byte_offset : c.byte_offset + n]
    if part.shape[1] < n:
        raise MeasurementFileError(f"channel {c.name!r} reaches past its record")
    t = c.data_type
    if t in (UINT, UINT_BE, SINT, SINT_BE):
        if not 0 < c.bit_count <= 64:
            raise MeasurementFileError(f"channel {c.name!r} has integers of {c.bit_count} bits")
        if c.bit_offset == 0 and c.bit_count in (8, 16, 32, 64):
            own = np.ascontiguousarray(part).view(f"{'<' if t in LITTLE else '>'}{'u' if t < 2 else 'i'}{n}")[:, 0]
            values = own.astype(own.dtype.newbyteorder("="))
        else:
            values = _integers(part, c)
            if t in (SINT, SINT_BE):
                shift = np.uint64(64 - c.bit_count)
                values = (values << shift).view(np.int64) >> np.int64(64 - c.bit_count)
        out = pa.array(values)
        out = out.cast(kind)
    elif t in (REAL, REAL_BE):
        if c.bit_offset or c.bit_count not in (16, 32, 64):
            raise MeasurementFileError(f"channel {c.name!r} has reals of {c.bit_count} bits at bit {c.bit_offset}")
        own = np.ascontiguousarray(part).view(f"{'<' if t == REAL else '>'}f{n}")[:, 0]
        out = pa.array(own.astype(np.float64 if n == 8 else np.float32))
    else:
        flat = np.ascontiguousarray(part).tobytes()
        out = _strings([flat[k * n : (k + 1) * n] for k in range(len(records))], t)
    return _with_nulls(out, records, c, group)


def _with_nulls(out: pa.Array, records: np.ndarray, c: Channel, group: ChannelGroup) -> pa.Array:
    if c.flags & 1:  # every value is invalid
        return pa.nulls(len(out), out.type)
    if not c.flags & 2 or not group.inval_bytes:
        return out
    at = group.data_bytes + (c.inval_pos >> 3)
    bad = (records[:, at] >> (c.inval_pos & 7) & 1).astype(bool)
    return pc.if_else(pa.array(bad), pa.scalar(None, out.type), out) if bad.any() else out


class SignalData:
    """Values of variable length: ``length u32 | bytes`` entries, found by their offset in the stream."""

    def __init__(self, src: Source, at: int):
        self.src, self.at, self.stream = src, at, Stream(src, pieces(src, at))

    def values(self, offsets: np.ndarray) -> list[bytes]:
        try:
            return self._values(offsets)
        except MisplacedError:  # then the blocks' own lengths count
            self.stream = Stream(self.src, fragments(self.src, self.at))
            return self._values(offsets)

    def _values(self, offsets: np.ndarray) -> list[bytes]:
        if not len(offsets) or not self.stream.length:
            return [b""] * len(offsets)
        lo, hi = int(offsets.min()), int(offsets.max())
        data = self.stream.read(lo, hi + 4)
        (size,) = struct.unpack_from("<I", data, hi - lo)
        data += self.stream.read(hi + 4, hi + 4 + size)
        out = []
        for o in offsets.tolist():
            (n,) = struct.unpack_from("<I", data, o - lo)
            out.append(data[o - lo + 4 : o - lo + 4 + n])
        return out


def _batch(records: np.ndarray, first: int, channels: list[Channel], group: ChannelGroup, signals: dict[int, SignalData], extra: dict[int, list[bytes]]) -> pa.RecordBatch:
    cols = [pa.array(np.arange(first, first + len(records)))]
    for c in channels:
        if c.index in extra:
            cols.append(_with_nulls(_strings(extra[c.index], c.data_type), records, c, group))
        elif c.index in signals:
            at = np.ascontiguousarray(records[:, c.byte_offset : c.byte_offset + 8]).view("<u8")[:, 0]
            cols.append(_with_nulls(_strings(signals[c.index].values(at), c.data_type), records, c, group))
        else:
            cols.append(decode(records, first, c, group))
    return pa.RecordBatch.from_arrays(cols, names=["record_index", *[c.column for c in channels]])


def _pieces(records: np.ndarray, first: int, channels: list[Channel], signals: dict[int, SignalData]) -> Iterator[tuple[np.ndarray, int]]:
    """Runs of records whose variable-length values span at most SIGNAL_BYTES of a stream (or single records)."""
    if len(records) > 1:
        for c in channels:
            if c.index in signals:
                at = np.ascontiguousarray(records[:, c.byte_offset : c.byte_offset + 8]).view("<u8")[:, 0]
                if int(at.max()) - int(at.min()) > SIGNAL_BYTES:
                    half = len(records) // 2
                    yield from _pieces(records[:half], first, channels, signals)
                    yield from _pieces(records[half:], first + half, channels, signals)
                    return
    yield records, first


def signal_links(src: Source, channels: list[Channel]) -> dict[int, SignalData]:
    """Streams of variable-length channels whose data link is not a channel group."""
    return {c.index: SignalData(src, c.data_at) for c in channels if has_signal(src, c)}


def has_signal(src: Source, c: Channel) -> bool:
    return c.is_vlsd and bool(c.data_at) and header(src, c.data_at)[0] != "##CG"


def signal_bytes(src: Source, channels: list[Channel]) -> int:
    """Bytes of the streams of variable-length channels."""
    return sum(stream_length(pieces(src, c.data_at)) for c in channels if has_signal(src, c))


def read_sorted(src: Source, group: ChannelGroup, channels: list[Channel], first: int, last: int, parts: list[Fragment] | None = None) -> Iterator[pa.RecordBatch]:
    """Records first..last-1 of a sorted group; ``parts``: the pieces of its stream that hold them, where they are known."""
    size = group.row_bytes
    signals = signal_links(src, channels)
    if not size:  # virtual channels only
        for a in range(first, last, 1 << 16):
            b = min(last, a + (1 << 16))
            yield _batch(np.zeros((b - a, 0), np.uint8), a, channels, group, signals, {})
        return
    stream = Stream(src, fragments(src, group.data_at) if parts is None else parts)
    step = max(1, CHUNK_BYTES // size)
    last = min(last, stream.length // size)
    for a in range(first, last, step):
        b = min(last, a + step)
        data = stream.read(a * size, b * size)
        for part, at in _pieces(np.frombuffer(data, np.uint8).reshape(b - a, size), a, channels, signals):
            yield _batch(part, at, channels, group, signals, {})


def sync_points(src: Source, groups: list[ChannelGroup], dg_index: int, every: int) -> list[tuple[int, dict[int, int]]]:
    """Places in a stream of mixed records where a record begins, ``every`` bytes or more apart, the first at 0.

    Each with how many records of every flat group lie before it.  Only places where variable-length groups have as many
    records as the groups that link to them are taken, so a range of the stream is complete in itself.
    """
    own = [g for g in groups if g.dg_index == dg_index]
    rid = own[0].record_id_size
    by_at = {g.at: g.record_id for g in own}
    twins = [(g.record_id, by_at[c.data_at]) for g in own for c in g.channels if c.is_vlsd and c.data_at in by_at]
    size = {g.record_id: -1 if g.is_vlsd else rid + g.row_bytes for g in own}
    flat = {g.record_id: g.flat_index for g in own}
    counts = dict.fromkeys(size, 0)
    stream = Stream(src, fragments(src, own[0].data_at))
    out, at, left, begin, due = [(0, dict.fromkeys(flat.values(), 0))], 0, b"", 0, every
    while at < stream.length:
        data = left + stream.read(at, at + CHUNK_BYTES)
        at = min(stream.length, at + CHUNK_BYTES)
        p, end = 0, len(data)
        while p + rid <= end:
            if begin + p >= due and all(counts[a] == counts[b] for a, b in twins):
                out.append((begin + p, {flat[i]: n for i, n in counts.items()}))
                due = begin + p + every
            record_id = data[p] if rid == 1 else int.from_bytes(data[p : p + rid], "little")
            n = size.get(record_id)
            if n is None:
                raise MeasurementFileError(f"{src.path}: record id {record_id} is unknown")
            if n < 0:
                if p + rid + 4 > end:
                    break
                n = rid + 4 + int.from_bytes(data[p + rid : p + rid + 4], "little")
            if p + n > end:
                break
            counts[record_id] += 1
            p += n
        begin, left = begin + p, data[p:]
    return out


def read_unsorted(src: Source, groups: list[ChannelGroup], group: ChannelGroup, channels: list[Channel], begin: int = 0, end_at: int | None = None, first: int = 0) -> Iterator[pa.RecordBatch]:
    """The records of one group of a data group whose records are mixed, in file order.

    The stream is read once, in chunks. Variable-length channels whose link is a channel group take that group's
    records in order: the k-th belongs to the k-th record of ``group``.  ``begin`` and ``end_at`` are places of
    ``sync_points``, ``first`` the number of the group's records before ``begin``.
    """
    rid = group.record_id_size
    routes = {g.record_id: g for g in groups if g.dg_index == group.dg_index}
    links = {c.data_at: c for c in channels if c.is_vlsd and c.data_at and header(src, c.data_at)[0] == "##CG"}
    owner = {g.record_id: links[g.at].index for g in routes.values() if g.at in links}
    signals = signal_links(src, channels)
    # a range does not walk over all blocks of the stream where its lists tell where they begin
    stream = Stream(src, (fragments if end_at is None else pieces)(src, group.data_at))
    kinds = {i: (g.is_vlsd, g.row_bytes, g is group, owner.get(i)) for i, g in routes.items()}
    # whole lengths of records of a fixed length, 0 for others
    steps = {i: 0 if g.is_vlsd else rid + g.row_bytes for i, g in routes.items()}
    plain = not any(g.is_vlsd for g in routes.values())
    table = {i.to_bytes(rid, "little"): n for i, n in steps.items()} if rid > 1 else [steps.get(i, 0) for i in range(256)]
    mine_as = group.record_id.to_bytes(rid, "little")
    rows = np.zeros((0, group.row_bytes), np.uint8)
    inside = np.arange(group.row_bytes)
    texts: dict[int, list[bytes]] = {k: [] for k in owner.values()}
    done, left, at = first, b"", begin
    stop = stream.length if end_at is None else end_at

    def read(a: int, b: int) -> bytes:
        nonlocal stream
        try:
            return stream.read(a, b)
        except MisplacedError:  # then the blocks' own lengths count
            stream = Stream(src, fragments(src, group.data_at))
            return stream.read(a, b)

    def flush(n: int) -> pa.RecordBatch:
        nonlocal done, rows
        batch = _batch(rows[:n], done, channels, group, signals, {k: v[:n] for k, v in texts.items()})
        rows = rows[n:]
        for v in texts.values():
            del v[:n]
        done += n
        return batch

    while at < stop or left:
        data = left + read(at, min(stop, at + CHUNK_BYTES))
        at = min(stop, at + CHUNK_BYTES)
        p, end, places = 0, len(data), []
        if plain:  # only where each record begins is a loop
            begins = []
            if rid == 1:
                while p < end and (n := table[data[p]]):
                    begins.append(p)
                    p += n
            else:
                of = table.get
                while n := of(data[p : p + rid]):
                    begins.append(p)
                    p += n
            if p > end:
                p = begins.pop()
            begins, flat = np.array(begins, np.int64), np.frombuffer(data, np.uint8)
            places = begins[np.logical_and.reduce([flat[begins + k] == x for k, x in enumerate(mine_as)])] + rid
        while p + rid <= end:
            record_id = data[p] if rid == 1 else int.from_bytes(data[p : p + rid], "little")
            kind = kinds.get(record_id)
            if kind is None:
                raise MeasurementFileError(f"{src.path}: record id {record_id} is unknown")
            variable, n, mine, to = kind
            if plain:  # a record that the chunk cuts off
                break
            q = p + rid
            if variable:
                if q + 4 > end:
                    break
                n = int.from_bytes(data[q : q + 4], "little")
                q += 4
            if q + n > end:
                break
            if mine and not variable:
                places.append(q)
            elif to is not None:
                texts[to].append(data[q : q + n])
            p = q + n
        if len(places):
            rows = np.concatenate([rows, np.frombuffer(data, np.uint8)[np.asarray(places)[:, None] + inside]])
        left = data[p:]
        if at >= stop and left:
            raise MeasurementFileError(f"{src.path}: {len(left)} bytes are left over at the end of the records")
        ready = min([len(rows), *[len(v) for v in texts.values()]])
        if ready:
            yield flush(ready)
    if len(rows) and texts:
        for v in texts.values():
            v += [b""] * (len(rows) - len(v))
        yield flush(len(rows))
