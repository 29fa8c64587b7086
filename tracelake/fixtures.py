"""A writer of MDF 4 files for tests and benchmarks."""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np

#: Where the blocks after the file header begin.
HEAD_BYTES = 168


@dataclass
class Stored:
    """A stream whose blocks are written apart: their addresses, where each begins in the stream, and how they are listed."""

    at: np.ndarray
    starts: np.ndarray
    listed: str = ""  # "": a single block, equal (all of ``size`` bytes, but the last), offsets
    size: int = 0
    zipped: bool = False


@dataclass
class Rule:
    """A conversion to write; each of ``refs`` is a text, a Rule, or None."""

    kind: int
    values: list[float] = field(default_factory=list)
    refs: list = field(default_factory=list)
    name: str | None = None
    unit: str | None = None
    comment: str | None = None
    masks: list[int] | None = None


@dataclass
class Origin:
    """A source-information block."""

    name: str | None = None
    path: str | None = None
    comment: str | None = None
    type: int = 0
    bus: int = 0
    flags: int = 0


@dataclass
class Chan:
    name: str
    data_type: int
    byte_offset: int
    bit_count: int
    bit_offset: int = 0
    type: int = 0
    sync: int = 0
    rule: Rule | None = None
    unit: str | None = None
    comment: str | None = None
    source: Origin | None = None
    flags: int = 0
    inval_pos: int = 0
    signal: list[bytes] | Stored | None = None  # entries of a signal-data stream
    signal_layout: str = "sd"
    signal_group: int | None = None  # or: the record id of a variable-length group
    dims: tuple[int, ...] = ()  # an array of this shape
    step: int = 0


@dataclass
class Group:
    channels: list[Chan]
    records: bytes = b""
    cycles: int = 0
    data_bytes: int = 0
    inval_bytes: int = 0
    record_id: int = 0
    flags: int = 0
    name: str | None = None
    comment: str | None = None
    source: Origin | None = None
    master_group: bool = False  # write a seventh link, as files of 4.20 do
    separator: int = 0
    reductions: list[tuple] = field(default_factory=list)  # cycles, interval, sync type, flags, and the records' bytes if there are any


@dataclass
class Data:
    """A data group: its groups and how its stream is laid out."""

    groups: list[Group]
    layout: str = "dt"  # dt, dl_equal, dl_offsets, dl_spanning, dz_deflate, dz_transposed, hl_dl_dz
    block_bytes: int = 1 << 20
    record_id_size: int = 0
    stream: bytes | Stored | None = None  # of unsorted groups, or stored
    comment: str | None = None


@dataclass
class Level:
    """A level of a channel hierarchy; elements are (data group, group, channel) by number."""

    name: str
    type: int = 0
    elements: list[tuple[int, int, int]] = field(default_factory=list)
    children: list = field(default_factory=list)
    comment: str | None = None


@dataclass
class Attachment:
    content: bytes
    name: str | None
    mime: str | None = None
    comment: str | None = None
    embedded: bool = True
    compressed: bool = False
    md5: bytes | None = None
    creator: int = 0


@dataclass
class Event:
    name: str | None
    comment: str | None = None
    type: int = 0
    sync: int = 0
    range: int = 0
    cause: int = 0
    flags: int = 0
    base: int = 0
    factor: float = 1.0
    scopes: int = 0


@dataclass
class Log:
    time_ns: int
    comment: str
    tz: int = 0
    dst: int = 0
    flags: int = 0


class Writer:
    def __init__(self, version: int = 410, magic: bytes = b"MDF     ", unfinalized: int = 0):
        ident = struct.pack("<8s8s8s4sH30sHH", magic, f"{version // 100}.{version % 100:02d}".ljust(8).encode(), b"tracelk ", b"", version, b"", unfinalized, 0)
        self.out = bytearray(ident)
        self.version = version
        self.gap = 0  # bytes after the file header that are written apart
        self.channel_at: dict[tuple[int, int], int] = {}

    def block(self, id_: str, links: list[int], data: bytes = b"") -> int:
        self.out += b"\0" * (-len(self.out) % 8)
        at = len(self.out) + (self.gap if len(self.out) >= HEAD_BYTES else 0)
        self.out += struct.pack("<4s4sQQ", id_.encode(), b"", 24 + 8 * len(links) + len(data), len(links))
        self.out += struct.pack(f"<{len(links)}q", *links) + data
        return at

    def link(self, block: int, k: int, to: int) -> None:
        struct.pack_into("<q", self.out, block - (self.gap if block >= HEAD_BYTES else 0) + 24 + 8 * k, to)

    def text(self, s: str | None, md: bool = False) -> int:
        return 0 if s is None else self.block("##MD" if md else "##TX", [], s.encode() + b"\0")

    def origin(self, o: Origin | None) -> int:
        if o is None:
            return 0
        return self.block("##SI", [self.text(o.name), self.text(o.path), self.text(o.comment)], struct.pack("<BBB5s", o.type, o.bus, o.flags, b""))

    def rule(self, r: Rule | None) -> int:
        if r is None:
            return 0
        refs = [self.rule(x) if isinstance(x, Rule) else self.text(x) for x in r.refs]
        values = struct.pack(f"<{len(r.masks)}Q", *r.masks) if r.masks is not None else struct.pack(f"<{len(r.values)}d", *r.values)
        return self.block("##CC", [self.text(r.name), self.text(r.unit), self.text(r.comment), 0, *refs], struct.pack("<BBHHHdd", r.kind, 0, 0, len(refs), len(values) // 8, 0, 0) + values)

    def _zipped(self, part: bytes, org: str, columns: int) -> int:
        return self.block("##DZ", [], zipped(part, org, columns))

    def stored(self, s: Stored) -> int:
        """The link to a stream whose blocks are written apart."""
        if not s.listed:
            return int(s.at[0]) if len(s.at) else 0
        half = (len(s.at) + 1) // 2 if s.zipped else len(s.at)
        lists = []
        for a, b in ((0, half), (half, len(s.at)))[: 1 + s.zipped]:
            more = struct.pack("<Q", s.size) if s.listed == "equal" else s.starts[a:b].astype("<i8").tobytes()
            lists.append(self.block("##DL", [0, *s.at[a:b].tolist()], struct.pack("<B3sI", s.listed == "equal", b"", b - a) + more))
        if not s.zipped:
            return lists[0]
        self.link(lists[0], 0, lists[1])
        return self.block("##HL", [lists[0]], struct.pack("<HB5s", s.listed == "equal", 0, b""))

    def stream(self, data: bytes, layout: str, block_bytes: int, row: int, org: str = "DT") -> int:
        if not data and layout == "dt":
            return 0
        plain = f"##{org}"
        if layout in ("dt", "sd"):
            return self.block(plain, [], data)
        if layout == "dz_deflate":
            return self._zipped(data, org, 0)
        if layout == "dz_transposed":
            return self._zipped(data, org, row)
        size = block_bytes if layout == "dl_spanning" else max(1, block_bytes // max(1, row)) * max(1, row)
        parts = [data[k : k + size] for k in range(0, len(data), size)]
        if layout == "hl_dl_dz":
            half = (len(parts) + 1) // 2
            lists = []
            for own in (parts[:half], parts[half:]):
                to = [self._zipped(p, org, row if k % 2 else 0) for k, p in enumerate(own)]
                lists.append(self.block("##DL", [0, *to], struct.pack("<B3sIQ", 1, b"", len(to), size)))
            self.link(lists[0], 0, lists[1])
            return self.block("##HL", [lists[0]], struct.pack("<HB5s", 1, 0, b""))
        to = [self.block(plain, [], p) for p in parts]
        if layout == "dl_equal":
            return self.block("##DL", [0, *to], struct.pack("<B3sIQ", 1, b"", len(to), size))
        if layout in ("dl_offsets", "dl_spanning"):
            return self.block("##DL", [0, *to], struct.pack("<B3sI", 0, b"", len(to)) + struct.pack(f"<{len(to)}Q", *range(0, size * len(to), size)))
        raise ValueError(layout)

    def channel(self, c: Chan, next_: int, signal: int) -> int:
        array = self.block("##CA", [], struct.pack("<BBHIiI", 0, 0, len(c.dims), 0, c.step, 0) + struct.pack(f"<{len(c.dims)}Q", *c.dims)) if c.dims else 0
        return self.block("##CN", [next_, array, self.text(c.name), self.origin(c.source), self.rule(c.rule), signal, self.text(c.unit), self.text(c.comment, md=True)], struct.pack("<BBBBIIIIBBH6d", c.type, c.sync, c.data_type, c.bit_offset, c.byte_offset, c.bit_count, c.flags, c.inval_pos, 0, 0, 0, *[0.0] * 6))

    def group(self, g: Group, next_: int, vlsd: dict[int, int]) -> int:
        first = 0
        for k, c in reversed(list(enumerate(g.channels))):
            signal = 0
            if isinstance(c.signal, Stored):
                signal = self.stored(c.signal)
            elif c.signal is not None:
                signal = self.stream(b"".join(struct.pack("<I", len(x)) + x for x in c.signal), c.signal_layout, 1 << 12, 0, "SD")
            elif c.signal_group is not None:
                signal = vlsd[c.signal_group]
            first = self.channel_at[id(g), k] = self.channel(c, first, signal)
        reduced = 0
        for cycles, interval, sync, flags, *records in reversed(g.reductions):
            reduced = self.block("##SR", [reduced, self.stream(records[0], "dl_spanning", 1 << 12, 0, "RD") if records else 0], struct.pack("<QdBB6s", cycles, interval, sync, flags, b""))
        links = [next_, first, self.text(g.name), self.origin(g.source), reduced, self.text(g.comment, md=True)] + [0] * g.master_group
        return self.block("##CG", links, struct.pack("<QQHH4sII", g.record_id, g.cycles, g.flags, g.separator, b"", g.data_bytes, g.inval_bytes))

    def levels(self, own: list[Level], groups: list[Data]) -> int:
        nxt = 0
        for x in reversed(own):
            links = [to for d, g, c in x.elements for to in (0, 0, self.channel_at[id(groups[d].groups[g]), c])]
            nxt = self.block("##CH", [nxt, self.levels(x.children, groups), self.text(x.name), self.text(x.comment, md=True), *links], struct.pack("<IB3s", len(x.elements), x.type, b""))
        return nxt

    def file(self, groups: list[Data], *, comment: str | None = None, start_ns: int = 0, tz: int = 0, dst: int = 0, time_flags: int = 0, flags: int = 0, angle: float = 0.0, distance: float = 0.0, attachments: list[Attachment] = (), events: list[Event] = (), history: list[Log] = (), hierarchy: list[Level] = ()) -> bytes:
        hd = self.block("##HD", [0] * 6, struct.pack("<QhhBBBBdd", start_ns, tz, dst, time_flags, 0, flags, 0, angle, distance))
        self.link(hd, 5, self.text(comment, md=True))
        nxt = 0
        for d in reversed(groups):
            stream = d.stream if d.stream is not None else d.groups[0].records if d.groups else b""
            row = d.groups[0].data_bytes + d.groups[0].inval_bytes if d.groups and d.stream is None else 0
            at = self.stored(stream) if isinstance(stream, Stored) else self.stream(stream, d.layout, d.block_bytes, row)
            first, vlsd = 0, {}
            for g in sorted(reversed(d.groups), key=lambda g: not g.flags & 1):  # variable-length groups first: others link to them
                first = self.group(g, first, vlsd)
                vlsd[g.record_id] = first
            nxt = self.block("##DG", [nxt, first, at, self.text(d.comment, md=True)], struct.pack("<B7s", d.record_id_size, b""))
        self.link(hd, 0, nxt)
        self.link(hd, 2, self.levels(hierarchy, groups))
        nxt = 0
        for h in reversed(history):
            nxt = self.block("##FH", [nxt, self.text(h.comment, md=True)], struct.pack("<QhhB3s", h.time_ns, h.tz, h.dst, h.flags, b""))
        self.link(hd, 1, nxt)
        nxt = 0
        for a in reversed(attachments):
            body = zlib.compress(a.content) if a.compressed else a.content
            bits = a.embedded | a.compressed << 1 | (a.md5 is not None) << 2
            nxt = self.block("##AT", [nxt, self.text(a.name), self.text(a.mime), self.text(a.comment, md=True)], struct.pack("<HHI16sQQ", bits, a.creator, 0, a.md5 or b"", len(a.content), len(body) if a.embedded else 0) + (body if a.embedded else b""))
        self.link(hd, 3, nxt)
        nxt = 0
        for e in reversed(events):
            nxt = self.block("##EV", [nxt, 0, 0, self.text(e.name), self.text(e.comment, md=True), *[0] * e.scopes], struct.pack("<BBBBB3sIHHqd", e.type, e.sync, e.range, e.cause, e.flags, b"", e.scopes, 0, 0, e.base, e.factor))
        self.link(hd, 4, nxt)
        return bytes(self.out)


def zipped(part: bytes, org: str, columns: int) -> bytes:
    """Data of a zipped block; with ``columns``, whole rows of so many bytes are transposed first."""
    packed = part
    if columns and len(part) >= columns:
        whole = len(part) // columns * columns
        packed = np.frombuffer(part, np.uint8, whole).reshape(-1, columns).T.tobytes() + part[whole:]
    z = zlib.compress(packed, 6)
    return struct.pack("<2sBBIQQ", org.encode(), 1 if columns else 0, 0, columns, len(part), len(z)) + z


def md5(content: bytes) -> bytes:
    return hashlib.md5(content).digest()


#: numpy kinds to MDF data types (little-endian).
_KINDS = {"u": 0, "i": 2, "f": 4}


def group_of_arrays(columns: dict[str, np.ndarray], master: str | None = None, rules: dict[str, Rule] | None = None, **more) -> Group:
    """A group whose records are rows of these arrays (numbers, or fixed-width bytes as UTF-8 text)."""
    dtype = np.dtype([(n, a.dtype) for n, a in columns.items()])
    rows = np.zeros(len(next(iter(columns.values()))), dtype)
    channels = []
    for n, a in columns.items():
        rows[n] = a
        kind = 7 if a.dtype.kind == "S" else _KINDS[a.dtype.kind] + (a.dtype.byteorder == ">")
        channels.append(Chan(n, kind, dtype.fields[n][1], 8 * a.dtype.itemsize, type=2 if n == master else 0, sync=1 if n == master else 0, rule=(rules or {}).get(n)))
    return Group(channels, rows.tobytes(), len(rows), dtype.itemsize, **more)
