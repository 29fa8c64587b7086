"""A deterministic, sharded WARC writer, and its reader.

Records are range-sorted by id.  The ranges come from exact sums of bytes over cells of ids (no sample), a range's files
are named after it and roll over by compressed size, and headers and digests are made anew from the payloads: equal rows
give equal files, however they are partitioned.  Files are written under temporary names (one for each attempt), listed in
a manifest that Spark commits, and only then renamed; the manifest is stored beside them, and temporary files that lost
attempts left behind are removed.  Duplicate payloads are written once, as the record with the largest id; the others are
revisit records.  Files are reached through Arrow file systems, so the target may be local, HDFS or an object store.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm.shared import Scratch, if_small, shared_dir, table

ROLL_BYTES = 64 << 20
#: Rows are dealt over about one range for so many payload bytes.
RANGE_BYTES = 16 << 20
MOST_RANGES = 100_000
#: Ids are summed up in so many cells at a time; a cell that is too heavy is cut into as many again.
CELLS = 4096
#: What a record takes beside its payload, about.
RECORD_BYTES = 700
CRLF = b"\r\n"
#: The format's versions and the revisit profile.
VERSION, HTTP = b"WARC/1.1", b"HTTP/1.1 200 OK"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"


def digest32(payload: bytes) -> str:
    """Bare upper-case base32 of the SHA-1 of a payload."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    """A name-based id: the same for the same page."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def _header(lines: list[tuple[str, str]]) -> bytes:
    return VERSION + CRLF + b"".join(f"{k}: {v}\r\n".encode() for k, v in lines) + CRLF


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record: HTTP block in WARC headers. ``WARC-Page-ID`` and ``WARC-Refers-To-Page-ID`` carry the integer ids.

    ``WARC-Source-URL`` has the whole URL, percent-encoded, where the target URI had to differ from it.
    """
    target = quote(url or "", safe=":/?#[]@!$&'()*+,;=%~-._")
    http = HTTP + CRLF + b"Content-Type: text/html; charset=utf-8" + CRLF + f"Content-Length: {len(payload)}".encode() + CRLF + CRLF
    block = http if revisit else http + payload
    lines = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(page_id)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", target),
        ("WARC-Payload-Digest", f"sha1:{digest32(payload)}"),
        ("WARC-Block-Digest", f"sha1:{digest32(block)}"),
    ]
    if url is not None and (not url or target != url):
        lines.append(("WARC-Source-URL", quote(url, safe="")))
    if page_id is not None:
        lines.append(("WARC-Page-ID", str(page_id)))
    if revisit:
        lines += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to)), ("WARC-Refers-To-Page-ID", str(refers_to))]
    lines += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return _header(lines) + block + CRLF + CRLF


def _member(data: bytes) -> bytes:
    """A gzip member with no time and no name in its header."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


MANIFEST_FILE = "manifest.jsonl"
MANIFEST = "file string, temporary string, first_page long, last_page long, records long, bytes long, digest string"


def _writer(uri: str, roll: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(uri)
        attempt = uuid.uuid4().hex
        done: list[tuple] = []
        out, sha, rolled, task = None, None, 0, -1
        first = last = None
        n = size = 0

        def close() -> None:
            nonlocal out
            if out is not None:
                out.close()
                done.append((f"part-{task:05d}-{rolled:05d}.warc.gz", f".tmp-{task:05d}-{rolled:05d}-{attempt}", first, last, n, size, sha.hexdigest()))
                out = None

        marked: dict[tuple, int] = {}
        for batch in batches:
            pages, marks, urls, payloads, digests, refers, ranges = (batch.column(c) for c in range(7))
            for i in range(batch.num_rows):
                if ranges[i].as_py() != task:
                    close()
                    task, rolled = ranges[i].as_py(), 0
                    marked.clear()
                page, d = pages[i].as_py(), digests[i].as_py()
                if marks[i].as_py() == 0:  # says that the page of this id and payload revisits another
                    if marked and next(iter(marked))[0] != page:
                        marked.clear()
                    marked[(page, d)] = refers[i].as_py()
                    continue
                payload = payloads[i].as_py()
                to = marked.get((page, d))
                data = _member(record(page, urls[i].as_py(), payload, to, to is not None))
                if out is not None and size + len(data) > roll:
                    close()
                    rolled += 1
                if out is None:
                    out, sha, n, size, first = fs.open_output_stream(f"{root}/.tmp-{task:05d}-{rolled:05d}-{attempt}", compression=None), hashlib.sha256(), 0, 0, page
                out.write(data)
                sha.update(data)
                n, size, last = n + 1, size + len(data), page
        close()
        cols = list(zip(*done, strict=True)) or [[]] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["file", "temporary", "first_page", "last_page", "records", "bytes", "digest"])

    return run


def _committer(uri: str):
    """Renames the listed temporary files; done again after a lost task it finds the final names and changes nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(uri)
        for batch in batches:
            for new, old in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if fs.get_file_info(f"{root}/{new}").type == pafs.FileType.NotFound:
                    fs.move(f"{root}/{old}", f"{root}/{new}")
            yield batch.select([0])

    return run


def _cell(lo, width) -> list:
    return [lo.cast("decimal(20, 0)").alias("lo"), width.cast("decimal(20, 0)").alias("w")]


def ranges_of(rows: DataFrame, range_bytes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lower ends, first numbers, parts) of ranges of ``page`` with about ``range_bytes`` of ``n`` each.

    Bytes are summed in cells of equal width; heavy cells are cut again until they are light or hold one id, so nothing
    depends on a sample.  An id that is itself too heavy is a range of several parts, by digest.  Range 0 is of null ids.
    Only sums of cells come to the driver: CELLS and four for each range, at most, in a round.
    """
    size = F.col("n") + RECORD_BYTES
    known = rows.where("page is not null").agg(F.min("page").alias("lo"), F.max("page").alias("hi"), F.sum(size).alias("n")).first()
    nulls = rows.where("page is null").agg(F.sum(size)).first()[0] or 0
    total = (known.n or 0) + nulls
    most = max(range_bytes, -(-total // MOST_RANGES), 1)
    leaves: list[tuple[int, int]] = []  # lower end, bytes
    width = lambda span, n: -(-span // min(CELLS, 4 * -(-n // most)))
    cells = {0: (known.lo, width(known.hi - known.lo + 1, known.n))} if known.n else {}
    near = rows.where("page is not null").select("page", size.alias("n"), F.lit(0).alias("k"), *_cell(F.lit(known.lo), F.lit(str(cells[0][1] if cells else 1))))
    while cells:
        near = near.withColumn("cell", F.expr("(cast(page as decimal(20, 0)) - lo) div w"))  # decimals: the span of ids may pass 63 bits
        heavy = []
        for r in near.groupBy("k", "cell").agg(F.sum("n").alias("n")).collect():
            lo, w = cells[r.k][0] + r.cell * cells[r.k][1], cells[r.k][1]
            if r.n > most and w > 1:
                heavy.append((r.k, r.cell, len(heavy), lo, width(w, r.n)))
            else:
                leaves.append((lo, r.n))
        cells = {k: (lo, w) for _, _, k, lo, w in heavy}
        if heavy:
            further = rows.sparkSession.createDataFrame([(*x[:4], str(x[4])) for x in heavy], "k int, cell long, next int, low long, wide string")
            near = near.join(F.broadcast(further), ["k", "cell"]).select("page", "n", F.col("next").alias("k"), *_cell(F.col("low"), F.col("wide")))
    ends, numbers, parts = [np.iinfo(np.int64).min], [0], [max(1, -(-nulls // most))]
    held = most + 1
    for lo, n in sorted(leaves):
        if held + n > most:
            numbers.append(numbers[-1] + parts[-1])
            ends.append(lo)
            parts.append(max(1, -(-n // most)))
            held = n if n <= most else most
        else:
            held += n
    return np.array(ends), np.array(numbers), np.array(parts)


def write_warc(pages: DataFrame, uri: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, roll_bytes: int = ROLL_BYTES, range_bytes: int = RANGE_BYTES, overwrite: bool = False) -> DataFrame:
    """Write all rows of ``pages`` under the folder ``uri``; returns the committed manifest, one row a file.

    A null html is an empty payload.  Of rows with equal payloads of at least ``min_bytes`` bytes those with the largest
    id are responses and the others revisit it; rows with a null id revisit only if another row has an id.  Rows that
    repeat an id and payload are alike.  Other columns are ignored; an empty table gives a committed folder without files.
    A folder that has files is refused, unless ``overwrite`` says to empty it first.  The payloads cross the network
    once: what is decided about them travels as narrow marker rows that sort right before their page.
    """
    fs, root = pafs.FileSystem.from_uri(uri)
    fs.create_dir(root, recursive=True)
    if there := fs.get_file_info(pafs.FileSelector(root)):
        if not overwrite:
            raise FileExistsError(f"{uri} is not empty")
        for f in sorted(there, key=lambda f: f.base_name != "_COMMITTED"):  # from now on not committed
            (fs.delete_dir if f.type == pafs.FileType.Directory else fs.delete_file)(f.path)
    keep = Scratch(pages.sparkSession, "warc-work")
    base = pages.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.encode(F.col(html_col).cast("string"), "UTF-8"), F.lit(b"")).alias("payload"))
    base = base.withColumn("digest", F.sha1("payload"))
    narrow = keep.write(base.select("page", "digest", F.octet_length("payload").cast("long").alias("n")), "narrow")
    twice = keep.write(narrow.groupBy("digest", "n").agg(F.max("page").alias("to"), F.count("*").alias("rows")).where((F.col("rows") > 1) & F.col("to").isNotNull() & (F.col("n") >= min_bytes)).select("digest", "to"), "twice")
    marks = narrow.join(if_small(twice, 80), "digest").where(~F.col("page").eqNullSafe(F.col("to"))).select("page", "digest", "to").distinct()
    rows = base.select("page", F.lit(1).alias("mark"), "url", "payload", "digest", F.lit(None).cast("long").alias("to")).unionByName(marks.select("page", F.lit(0).alias("mark"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), "digest", "to"))
    ends, numbers, parts = ranges_of(narrow, range_bytes)

    @F.pandas_udf("long")
    def range_of(page: pd.Series, none: pd.Series, share: pd.Series) -> pd.Series:
        g = np.where(none, 0, np.searchsorted(ends[1:], page, side="right"))
        return pd.Series(numbers[g] + (share.to_numpy() * parts[g] >> 28))

    ranged = rows.withColumn("range", range_of(F.coalesce("page", F.lit(0)), F.col("page").isNull(), F.conv(F.substring("digest", 1, 7), 16, 10).cast("long")))
    count = int(numbers[-1] + parts[-1])
    ranged = ranged.repartitionById(count, F.col("range").cast("int")).sortWithinPartitions("range", "page", "mark", "digest", "url")
    manifest = keep.write(ranged.mapInArrow(_writer(uri, roll_bytes), MANIFEST), "manifest")
    done = manifest.mapInArrow(_committer(uri), "file string").count()
    if done != (want := manifest.count()):
        raise RuntimeError(f"{done} of {want} files were committed")
    keep.drop("narrow", "twice")
    for f in fs.get_file_info(pafs.FileSelector(root)):
        if f.base_name.startswith(".tmp-"):
            fs.delete_file(f.path)
    listed = manifest.drop("temporary")
    with fs.open_output_stream(f"{root}/{MANIFEST_FILE}", compression=None) as out:
        for r in listed.orderBy("file").toLocalIterator():
            out.write(json.dumps(r.asDict()).encode() + b"\n")
    with fs.open_output_stream(f"{root}/_COMMITTED") as f:
        f.write(str(want).encode())
    return listed


def _parse(data: memoryview) -> tuple[dict[str, str], memoryview]:
    raw = bytes(data)
    end = raw.index(b"\r\n\r\n")
    head = dict(x.split(": ", 1) for x in raw[:end].decode("utf-8").split("\r\n")[1:])
    return head, data[end + 4 : end + 4 + int(head["Content-Length"])]


READ = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, intact boolean, payload binary"


def _reader(uri: str, with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(uri)
        kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.binary())
        names = [c.split()[0] for c in READ.split(", ")]

        def flush(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * 8, kinds, strict=True)], names=names)

        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, held = [], 0
                with fs.open_input_stream(f"{root}/{name}", compression=None) as f:
                    left = b""
                    while left or (left := f.read(1 << 20)):
                        z, parts = zlib.decompressobj(31), []
                        while True:
                            parts.append(z.decompress(left))
                            left = z.unused_data
                            if z.eof or not (left := f.read(1 << 20)):
                                break
                        head, block = _parse(memoryview(b"".join(parts)))
                        http, _, body = bytes(block).partition(b"\r\n\r\n")
                        revisit = head["WARC-Type"] == "revisit"
                        size = int(http.rpartition(b"Content-Length: ")[2].split(b"\r\n")[0])
                        named = head["WARC-Payload-Digest"].removeprefix("sha1:")
                        intact = f"sha1:{digest32(bytes(block))}" == head["WARC-Block-Digest"] and (revisit or (len(body) == size and digest32(body) == named))
                        page, to = head.get("WARC-Page-ID"), head.get("WARC-Refers-To-Page-ID")
                        url = unquote(head["WARC-Source-URL"]) if "WARC-Source-URL" in head else head["WARC-Target-URI"] or None
                        rows.append((page and int(page), url, head["WARC-Type"], size, named, to and int(to), intact, body if with_payload and not revisit else None))
                        held += len(body)
                        if len(rows) >= 2000 or with_payload and held > 8 << 20:
                            yield flush(rows)
                            rows, held = [], 0
                yield flush(rows)

    return run


def read_warc(spark: SparkSession, uri: str, manifest: DataFrame | None = None, with_payload: bool = False) -> DataFrame:
    """All records of the files of ``manifest`` (default: the one stored with them); ``intact`` says whether the digests hold.

    One task for a few files each.
    """
    fs, root = pafs.FileSystem.from_uri(uri)
    if fs.get_file_info(f"{root}/_COMMITTED").type == pafs.FileType.NotFound:
        raise FileNotFoundError(f"{uri} is not committed")
    if manifest is None:
        with fs.open_input_stream(f"{root}/{MANIFEST_FILE}", compression=None) as f:
            manifest = spark.createDataFrame([(json.loads(x)["file"],) for x in f.read().splitlines()], "file string")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return manifest.select("file").repartition(parts, "file").mapInArrow(_reader(uri, with_payload), READ)


def op1_warc_writer(spark, sf_dir: str) -> DataFrame:
    """All ``pages`` written to WARC files in the shared folder and read back: one row a page."""
    at = shared_dir(spark)
    uri = f"{at if '://' in at else 'file://' + at}/warc-{uuid.uuid4().hex}"
    manifest = write_warc(table(spark, sf_dir, "pages"), uri)
    return read_warc(spark, uri, manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


#: Base32 of a SHA-1: 32 digits of five bits, each out of two hexadecimal digits.
OP1_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top FROM pages),
h AS (SELECT *, sha1(payload) AS h, '0123456789abcdef' AS x FROM p)
SELECT page_id, octet_length(encode(payload))::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((((strpos(x, substr(h, 5 * i // 4 + 1, 1)) - 1) * 16 + strpos(x, substr(h, 5 * i // 4 + 2, 1)) - 1) >> (3 - (5 * i) % 4)) & 31) + 1, 1)), '') AS payload_digest,
       CASE WHEN top IS NULL OR page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN top IS NOT NULL AND page_id IS DISTINCT FROM top THEN top END AS refers_to, true AS intact
FROM h
"""
