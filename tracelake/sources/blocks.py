"""Parsers of measurement-file (MDF 4) blocks. Plain Python: no Spark here.

A block is a 24-byte header (id, length, link count), its links (absolute addresses, 0 = none) and its data.  All
metadata is little-endian.  Links are taken by number, so blocks with more links than a version knows stay readable.
"""

from __future__ import annotations

import glob
import os
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow.fs as pafs


class MeasurementFileError(Exception):
    """A file that is not readable as MDF 4."""


class VersionError(MeasurementFileError):
    """A version below 4.00."""


class NotFinalizedError(MeasurementFileError):
    """A file that its writer has not finished."""


class Source:
    """Random reads of one file, local or of any file system that Arrow knows, with a small page cache for metadata."""

    PAGE = 1 << 16

    def __init__(self, path: str):
        self.path = path
        if re.match(r"^[a-z][a-z0-9+.-]*://", path):
            fs, at = pafs.FileSystem.from_uri(path)
        else:
            fs, at = pafs.LocalFileSystem(), re.sub(r"^file:/*", "/", path)
        self._file = fs.open_input_file(at)
        self.size = self._file.size()
        self._pages: dict[int, bytes] = {}

    def close(self) -> None:
        self._file.close()

    def __enter__(self) -> Source:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def span(self, at: int, n: int) -> bytes:
        """``n`` bytes straight from the file."""
        out = self._file.read_at(n, at)
        if len(out) < n:
            raise MeasurementFileError(f"{self.path}: {n} bytes at {at} reach past the end")
        return out

    def small(self, at: int, n: int) -> bytes:
        """``n`` bytes through the page cache."""
        if at < 0 or at + n > self.size:
            raise MeasurementFileError(f"{self.path}: {n} bytes at {at} reach past the end")
        first, last = at // self.PAGE, (at + n - 1) // self.PAGE
        if last - first > 4:
            return self.span(at, n)
        parts = []
        for k in range(first, last + 1):
            if k not in self._pages:
                if len(self._pages) > 256:
                    self._pages.clear()
                self._pages[k] = self._file.read_at(min(self.PAGE, self.size - k * self.PAGE), k * self.PAGE)
            parts.append(self._pages[k])
        data = b"".join(parts)
        return data[at - first * self.PAGE : at - first * self.PAGE + n]


def paths_of(path: str) -> list[str]:
    """The files a load path names: a file, a folder (its .mf4 and .mdf files), a glob, or several of them by comma."""
    out: list[str] = []
    for one in path.split(","):
        one = one.strip()
        if not one:
            continue
        if re.match(r"^(?!file:)[a-z][a-z0-9+.-]*://", one):
            fs, at = pafs.FileSystem.from_uri(one)
            scheme = one[: one.index("://") + 3] + (one[one.index("://") + 3 :].split("/")[0] if one.startswith(("hdfs", "viewfs")) else "")
            if fs.get_file_info(at).type == pafs.FileType.Directory:
                out += sorted(scheme + f.path for f in fs.get_file_info(pafs.FileSelector(at)) if f.extension.lower() in ("mf4", "mdf"))
            else:
                out.append(one)
            continue
        local = re.sub(r"^file:/*", "/", one)
        if os.path.isdir(local):
            out += sorted(os.path.join(local, f) for f in os.listdir(local) if f.lower().endswith((".mf4", ".mdf")))
        elif any(c in local for c in "*?["):
            out += sorted(glob.glob(local))
        else:
            out.append(local)
    return out


@dataclass
class Raw:
    """A block's header, links and the place of its data."""

    at: int
    id: str
    length: int
    links: tuple[int, ...]
    data_at: int
    data_length: int

    def link(self, k: int) -> int:
        return self.links[k] if k < len(self.links) else 0


def header(src: Source, at: int) -> tuple[str, int, int]:
    """(id, length, link count) of the block at an address."""
    id_, _, length, count = struct.unpack("<4s4sQQ", src.small(at, 24))
    return id_.decode("latin-1"), length, count


def raw(src: Source, at: int, *ids: str) -> Raw:
    """The block at an address, which must have one of these ids."""
    id_, length, count = header(src, at)
    if ids and id_ not in ids:
        raise MeasurementFileError(f"{src.path}: {'/'.join(ids)} expected at {at}, found {id_!r}")
    links = struct.unpack(f"<{count}q", src.small(at + 24, 8 * count)) if count else ()
    return Raw(at, id_, length, links, at + 24 + 8 * count, length - 24 - 8 * count)


def data(src: Source, block: Raw, fmt: str) -> tuple:
    """The leading data fields of a block."""
    return struct.unpack(fmt, src.small(block.data_at, struct.calcsize(fmt)))


def text(src: Source, at: int) -> str | None:
    """A text or metadata block's content without NULs around it; None for no link."""
    if not at:
        return None
    b = raw(src, at, "##TX", "##MD")
    return src.small(b.data_at, b.data_length).strip(b"\x00").decode("utf-8", "replace")


def chain(src: Source, at: int, *ids: str) -> Iterator[Raw]:
    """The blocks of a linked list whose first link is the next block."""
    seen = set()
    while at:
        if at in seen:
            raise MeasurementFileError(f"{src.path}: the list of {ids[0]} runs in a circle at {at}")
        seen.add(at)
        b = raw(src, at, *ids)
        yield b
        at = b.link(0)


@dataclass
class Identification:
    file: str
    version: str
    program: str
    number: int
    unfinalized: int

    @property
    def finalized(self) -> bool:
        return self.unfinalized == 0


def identification(src: Source) -> Identification:
    """The 64 bytes at the start; raises for other files and versions."""
    if src.size < 64:
        raise MeasurementFileError(f"{src.path}: too short")
    file, version, program, _, number, _, unfinalized, _ = struct.unpack("<8s8s8s4sH30sHH", src.small(0, 64))
    if not file.startswith((b"MDF", b"UnFinMF")):
        raise MeasurementFileError(f"{src.path}: not a measurement file")
    if number < 400:
        raise VersionError(f"{src.path}: version {number} is below 400")
    return Identification(*(x.decode("latin-1").rstrip("\x00") for x in (file, version, program)), number, unfinalized)


@dataclass
class Header:
    first_dg: int
    first_fh: int
    first_at: int
    first_ev: int
    first_ch: int
    comment: str | None
    start_ns: int
    tz_min: int
    dst_min: int
    time_flags: int
    time_class: int
    flags: int
    angle: float
    distance: float


def file_header(src: Source) -> Header:
    b = raw(src, 64, "##HD")
    start, tz, dst, tf, tc, fl, _, angle, distance = data(src, b, "<QhhBBBBdd")
    return Header(b.link(0), b.link(1), b.link(3), b.link(4), b.link(2), text(src, b.link(5)), start, tz, dst, tf, tc, fl, angle, distance)


# Names of source types, bus types, channel types, levels of a hierarchy and synchronisation types.
SOURCE_TYPES = {0: "OTHER", 1: "ECU", 2: "BUS", 3: "I/O", 4: "TOOL", 5: "USER"}
BUS_TYPES = {0: "NONE", 1: "OTHER", 2: "CAN", 3: "LIN", 4: "MOST", 5: "FLEXRAY", 6: "K_LINE", 7: "ETHERNET", 8: "USB"}
CHANNEL_TYPES = {0: "FixedLenght", 1: "VLSD", 2: "Master", 3: "VirtualMaster", 4: "Synchronization", 5: "MaximumLengthData", 6: "VirtualData"}
HIERARCHY_TYPES = {0: "GROUP", 1: "FUNCTION", 2: "STRUCTURE", 3: "MAP_LIST", 4: "INPUT", 5: "OUTPUT", 6: "LOCAL", 7: "CALIBRATION_DEFINITION", 8: "CALIBRATION_OBJECT"}
SYNC_TYPES = {0: "None", 1: "Time", 2: "Angle", 3: "Distance", 4: "Index"}


@dataclass
class SourceInfo:
    name: str | None
    path: str | None
    comment: str | None
    type: str
    bus_type: str
    flag: str


def source_info(src: Source, at: int) -> SourceInfo | None:
    if not at:
        return None
    b = raw(src, at, "##SI")
    kind, bus, flags = data(src, b, "<BBB")
    flag = "" if flags == 0 or kind == 4 else "SIMULATED SOURCE" if flags & 1 else "REAL SOURCE"
    type_ = SOURCE_TYPES.get(kind, "") if kind else ""
    bus_type = BUS_TYPES[0] if kind >= 3 else BUS_TYPES.get(bus, "") if bus else ""
    return SourceInfo(text(src, b.link(0)), text(src, b.link(1)), text(src, b.link(2)), type_, bus_type, flag)


@dataclass
class Conversion:
    """A conversion rule; each of ``refs`` is a text, another rule, or None."""

    kind: int
    values: list[float] = field(default_factory=list)
    refs: list = field(default_factory=list)
    name: str | None = None
    unit: str | None = None
    comment: str | None = None
    masks: list[int] = field(default_factory=list)


def conversion(src: Source, at: int, depth: int = 0) -> Conversion | None:
    if not at:
        return None
    if depth > 16:
        raise MeasurementFileError(f"{src.path}: conversions nest too deep at {at}")
    b = raw(src, at, "##CC")
    kind, _, _, refs, values = data(src, b, "<BBHHH")
    body = src.small(b.data_at + 24, 8 * values)
    found = []
    for k in range(refs):
        to = b.link(4 + k)
        found.append(None if not to else conversion(src, to, depth + 1) if header(src, to)[0] == "##CC" else text(src, to))
    return Conversion(kind, list(struct.unpack(f"<{values}d", body)), found, text(src, b.link(0)), text(src, b.link(1)), text(src, b.link(2)), list(struct.unpack(f"<{values}Q", body)))


@dataclass
class Channel:
    index: int
    name: str
    type: int
    sync: int
    data_type: int
    bit_offset: int
    byte_offset: int
    bit_count: int
    flags: int
    inval_pos: int
    composed: bool
    unit: str | None
    comment: str | None
    source: SourceInfo | None
    conversion: Conversion | None
    data_at: int
    column: str = ""
    dims: tuple[int, ...] = ()  # of an array whose elements lie in the record, step bytes apart
    step: int = 0
    at: int = 0

    @property
    def is_vlsd(self) -> bool:
        return self.type == 1

    @property
    def is_master(self) -> bool:
        return self.type in (2, 3)

    @property
    def is_virtual(self) -> bool:
        return self.type in (3, 6)


def channel(src: Source, b: Raw, index: int) -> Channel:
    type_, sync, dt, bit, byte, count, flags, inval = data(src, b, "<BBBBIIII")
    cc = conversion(src, b.link(4))
    own = text(src, b.link(6))
    dims, step = array_of(src, b.link(1))
    return Channel(index, text(src, b.link(2)) or "", type_, sync, dt, bit, byte, count, flags, inval, bool(b.link(1)), own if own else cc.unit if cc else own, text(src, b.link(7)), source_info(src, b.link(3)), cc, b.link(5), dims=dims, step=step, at=b.at)


def array_of(src: Source, at: int) -> tuple[tuple[int, ...], int]:
    """(sizes of the dimensions, bytes from one element to the next) of an array block whose elements lie in the record.

    Other compositions (structures, arrays of channel groups or of data groups) give no dimensions.
    """
    if not at or header(src, at)[0] != "##CA":
        return (), 0
    b = raw(src, at, "##CA")
    _, storage, dims, _, step, _ = data(src, b, "<BBHIiI")
    if storage:
        return (), 0
    return struct.unpack(f"<{dims}Q", src.small(b.data_at + 16, 8 * dims)), step


@dataclass
class ChannelGroup:
    at: int
    dg_index: int
    cg_index: int
    flat_index: int
    record_id: int
    record_id_size: int
    cycles: int
    flags: int
    separator: int
    data_bytes: int
    inval_bytes: int
    name: str | None
    comment: str | None
    dg_comment: str | None
    source: SourceInfo | None
    channels: list[Channel]
    data_at: int
    master_at: int
    reductions_at: int = 0

    @property
    def is_vlsd(self) -> bool:
        return bool(self.flags & 1)

    @property
    def is_sorted(self) -> bool:
        return self.record_id_size == 0

    @property
    def row_bytes(self) -> int:
        return self.data_bytes + self.inval_bytes

    def kinds(self, version: int) -> list[str]:
        """What the flags say that the file's version knows of."""
        bit = lambda k: self.flags >> k & 1
        out = ["VLSD"] if bit(0) else []
        if version >= 410 and bit(1):
            out.append("PLAIN_BUS_EVENT" if bit(2) else "BUS_EVENT")
        if version >= 420:
            out += ["REMOTE_MASTER"] * bit(3) + ["EVENT"] * bit(4)
        return out

    @property
    def master(self) -> Channel | None:
        return next((c for c in self.channels if c.is_master), None)


@dataclass
class MeasurementFile:
    path: str
    id: Identification
    header: Header
    groups: list[ChannelGroup]

    @classmethod
    def read(cls, src: Source, allow_unfinalized: bool = False) -> MeasurementFile:
        ident = identification(src)
        if not ident.finalized and not allow_unfinalized:
            raise NotFinalizedError(f"{src.path}: the file is not finalized")
        head = file_header(src)
        groups: list[ChannelGroup] = []
        for d, dg in enumerate(chain(src, head.first_dg, "##DG")):
            (rec_size,) = data(src, dg, "<B")
            if rec_size not in (0, 1, 2, 4, 8):
                raise MeasurementFileError(f"{src.path}: record ids of {rec_size} bytes")
            note = text(src, dg.link(3))
            for c, cg in enumerate(chain(src, dg.link(1), "##CG")):
                rid, cycles, flags, sep, _, size, inval = data(src, cg, "<QQHH4sII")
                channels = [channel(src, b, k) for k, b in enumerate(chain(src, cg.link(1), "##CN"))]
                _name(channels)
                groups.append(ChannelGroup(cg.at, d, c, len(groups), rid, rec_size, cycles, flags, sep, size, inval, text(src, cg.link(2)), text(src, cg.link(5)), note, source_info(src, cg.link(3)), channels, dg.link(2), cg.link(6), cg.link(4)))
        return cls(src.path, ident, head, groups)


def _name(channels: list[Channel]) -> None:
    """Column names: a channel's name, with _1, _2 .. where it repeats or clashes."""
    used = {"record_index"}
    for c in channels:
        column, k = c.name or "channel", 0
        while column.lower() in used:
            k += 1
            column = f"{c.name or 'channel'}_{k}"
        used.add(column.lower())
        c.column = column


@dataclass
class Fragment:
    """A piece of a logical data stream: where it lies in the stream and how it is stored."""

    start: int
    length: int
    at: int
    stored: int
    zip: int = -1  # -1 plain, 0 deflate, 1 transposed deflate
    columns: int = 0


def fragment(src: Source, at: int, start: int) -> Fragment:
    """The piece whose block lies at an address and begins at ``start`` of its stream."""
    head = src.span(at, min(48, src.size - at)) if 0 <= at <= src.size - 24 else src.small(at, 24)
    id_, _, length, count = struct.unpack_from("<4s4sQQ", head)
    if id_ == b"##DZ":
        if len(head) < 48:
            raise MeasurementFileError(f"{src.path}: the block at {at} reaches past the end")
        _, zip_, _, param, org, size = struct.unpack_from("<2sBBIQQ", head, 24)
        if zip_ not in (0, 1):
            raise MeasurementFileError(f"{src.path}: zip type {zip_} at {at}")
        return Fragment(start, org, at + 48, size, zip_, param)
    if id_ in (b"##DT", b"##DV", b"##SD", b"##RD"):
        n = length - 24 - 8 * count
        return Fragment(start, n, at + 24 + 8 * count, n)
    raise MeasurementFileError(f"{src.path}: no data block at {at}, but {id_.decode('latin-1')!r}")


def _lists(src: Source, at: int) -> Iterator[Raw] | None:
    """The list blocks that hang off a data link; None where it is a data block itself."""
    id_ = header(src, at)[0]
    if id_ == "##HL":
        at = raw(src, at, "##HL").link(0)
        id_ = "##DL"
    if id_ != "##DL":
        return None
    return chain(src, at, "##DL") if at else iter(())


def fragments(src: Source, at: int) -> list[Fragment]:
    """The pieces of the stream that hangs off a data link: one block, a list, a list of lists, zipped or not."""
    if not at:
        return []
    lists = _lists(src, at)
    if lists is None:
        return [fragment(src, at, 0)]
    out: list[Fragment] = []
    start = 0
    for dl in lists:
        for to in dl.links[1:]:
            if to:
                out.append(fragment(src, to, start))
                start += out[-1].length
    return out


class MisplacedError(MeasurementFileError):
    """A block that is not as long as its list says."""


class Listed:
    """The pieces of a stream by the places that its lists tell: a piece's own header is read only when it is asked for."""

    def __init__(self, src: Source, at: np.ndarray, starts: np.ndarray):
        self.src, self.at, self.starts = src, at, starts
        last = fragment(src, int(at[-1]), int(starts[-1]))
        self.length = last.start + last.length

    def __len__(self) -> int:
        return len(self.at)

    def __getitem__(self, k: int) -> Fragment:
        if k >= len(self.at):
            raise IndexError(k)
        out = fragment(self.src, int(self.at[k]), int(self.starts[k]))
        if out.start + out.length != (self.starts[k + 1] if k + 1 < len(self.at) else self.length):
            raise MisplacedError(f"{self.src.path}: the block at {self.at[k]} is not as long as its list says")
        return out


def pieces(src: Source, at: int) -> list[Fragment] | Listed:
    """As ``fragments``, without a walk over all blocks where the lists tell where each block begins."""
    lists = _lists(src, at) if at else None
    if lists is None:
        return fragments(src, at)
    ats, starts, n = [], [], 0
    for dl in lists:
        links = np.array(dl.links[1:], np.int64)
        flags = src.small(dl.data_at, 1)[0]
        if not len(links):
            continue
        if not links.all() or dl.data_length < (16 if flags & 1 else 8 + 8 * len(links)):
            return fragments(src, at)
        ats.append(links)
        if flags & 1:
            (size,) = struct.unpack("<Q", src.small(dl.data_at + 8, 8))
            starts.append((n + np.arange(len(links))) * size)
        else:
            starts.append(np.frombuffer(src.small(dl.data_at + 8, 8 * len(links)), "<i8"))
        n += len(links)
    if not n:
        return []
    begins = np.concatenate(starts)
    if begins[0] or (np.diff(begins) < 0).any():
        return fragments(src, at)
    return Listed(src, np.concatenate(ats), begins)


def stream_length(parts: list[Fragment] | Listed) -> int:
    return parts.length if isinstance(parts, Listed) else parts[-1].start + parts[-1].length if parts else 0


def untransposed(packed: bytes, columns: int) -> bytes:
    """Bytes stored column by column back in record order; what is left over a whole number of records stays as it is."""
    rows = len(packed) // columns if columns else 0
    if rows < 2:
        return packed
    whole = rows * columns
    return np.frombuffer(packed, np.uint8, whole).reshape(columns, rows).T.tobytes() + packed[whole:]


class Stream:
    """Reads of any byte range of a logical stream; the last block inflated is kept."""

    def __init__(self, src: Source, parts: list[Fragment] | Listed):
        self.src, self.parts = src, parts
        self.starts = parts.starts if isinstance(parts, Listed) else [f.start for f in parts]
        self.length = stream_length(parts)
        self._held: tuple[int, bytes] = (-1, b"")

    def _piece(self, k: int, f: Fragment, a: int, b: int) -> bytes:
        if f.zip < 0:
            return self.src.span(f.at + a, b - a)
        if self._held[0] != k:
            got = zlib.decompress(self.src.span(f.at, f.stored))
            if len(got) != f.length:
                raise MeasurementFileError(f"{self.src.path}: {len(got)} of {f.length} bytes in the zipped block at {f.at}")
            self._held = (k, untransposed(got, f.columns) if f.zip == 1 else got)
        return self._held[1][a:b]

    def read(self, a: int, b: int) -> bytes:
        b = min(b, self.length)
        out = []
        k = max(0, int(np.searchsorted(self.starts, a, side="right")) - 1) if self.parts else 0
        while a < b:
            f = self.parts[k]
            stop = min(b, f.start + f.length)
            if stop > a:
                out.append(self._piece(k, f, a - f.start, stop - f.start))
                a = stop
            k += 1
        return out[0] if len(out) == 1 else b"".join(out)
