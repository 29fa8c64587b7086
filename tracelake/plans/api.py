"""The facade: ``open_mf4(spark, path)`` and what a measurement file offers, as DataFrames."""

from __future__ import annotations

import json
import mimetypes
import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions.conversion import ConversionError, compile_conversion
from tracelake.sources import blocks as B
from tracelake.sources.datasource import group_of, metadata, picked, register
from tracelake.session import shared_dir
from tracelake.sources.decode import CHARSETS, sync_points


class MeasurementSet:
    """One measurement file, or several of the same layout (a folder, a glob)."""

    def __init__(self, spark: SparkSession, path: str, memory_optimized: bool = True, bits: str = "identity"):
        register(spark)
        self.spark, self.path, self.memory_optimized, self.bits = spark, path, memory_optimized, bits
        self._file: B.MeasurementFile | None = None

    @property
    def file(self) -> B.MeasurementFile:
        """Metadata of the (first) file."""
        if self._file is None:
            paths = B.paths_of(self.path)
            if not paths:
                raise FileNotFoundError(self.path)
            self._file = metadata(paths[0])
        return self._file

    # tables of samples

    def raw(self, group: int = 0, channels: list[str] | None = None, **options: str) -> DataFrame:
        """``record_index`` and the raw values of a group's channels; only these channels are decoded."""
        reader = self.spark.read.format("mf4").option("group", group).options(**options)
        if channels is not None:
            reader = reader.option("channels", ",".join(channels))
        return self._kept(reader.load(self.path))

    def synchronised(self, group: int = 0, every_mb: float = 64) -> str:
        """Goes through the mixed records of a group's stream once, file by file in parallel, and writes where it can be cut.

        The returned address is the ``sync`` option of ``raw`` and ``table``, whose tasks are then ranges of the stream.
        """
        every = max(1, int(every_mb * (1 << 20)))

        def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                told = []
                for path in batch.column(0).to_pylist():
                    with B.Source(path) as src:
                        file = B.MeasurementFile.read(src)
                        g = group_of(file, group)
                        points = [] if g.is_sorted or not g.data_at else sync_points(src, file.groups, g.dg_index, every)
                    told.append(json.dumps([[at, n[group]] for at, n in points]))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(told, pa.string())], names=["path", "points"])

        paths = B.paths_of(self.path)
        rows = self.spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)))
        found = {r.path: json.loads(r.points) for r in rows.mapInArrow(walk, "path string, points string").toLocalIterator()}
        at = shared_dir(self.spark)
        uri = f"{at if '://' in at else f'file://{at}'}/tracelake-sync-{uuid.uuid4().hex}.json"
        fs, to = pafs.FileSystem.from_uri(uri)
        with fs.open_output_stream(to) as f:
            f.write(json.dumps(found).encode())
        return uri

    def table(self, group: int = 0, channels: list[str] | None = None, **options: str) -> DataFrame:
        """As ``raw``, with every channel's conversion applied as a Column expression."""
        g = group_of(self.file, group)
        own = {c.column: c for c in picked(g, None if channels is None else ",".join(channels))}
        df = self.raw(group, list(own), **options)
        return df.select(*[self._converted(own[f.name], f) if f.name in own else F.col(f"`{f.name}`") for f in df.schema.fields])

    def _converted(self, c: B.Channel, f) -> Column:
        raw = F.col(f"`{f.name}`")
        typed = compile_conversion(c.conversion, raw, integer=c.data_type <= 3, textual=c.data_type in CHARSETS, bits=self.bits)
        out = typed.column
        if typed.kind == "raw" and c.data_type == 10:
            out = F.lower(F.hex(raw))
        return out.alias(f.name, metadata=f.metadata)

    def sample(self, group: int, name: str) -> DataFrame:
        """Record index and converted samples of one channel; ``group`` is the flat index over all data groups."""
        return self.table(group, [name])

    def raw_sample(self, group: int, name: str) -> DataFrame:
        return self.raw(group, [name])

    def samples(self) -> DataFrame:
        """All groups, long."""
        return self._load("mf4_samples")

    def _kept(self, df: DataFrame) -> DataFrame:
        return df if self.memory_optimized else df.persist(StorageLevel.MEMORY_AND_DISK)

    # metadata

    def _load(self, name: str) -> DataFrame:
        return self.spark.read.format(name).load(self.path)

    def header(self) -> DataFrame:
        return self._load("mf4_header")

    def groups(self) -> DataFrame:
        return self._load("mf4_groups")

    def channels(self) -> DataFrame:
        return self._load("mf4_channels")

    def events(self) -> DataFrame:
        return self._load("mf4_events")

    def attachments(self) -> DataFrame:
        return self._load("mf4_attachments")

    def history(self) -> DataFrame:
        return self._load("mf4_history")

    def reductions(self) -> DataFrame:
        return self._load("mf4_reductions")

    def hierarchy(self) -> DataFrame:
        """The tree of channel hierarchies."""
        return self._load("mf4_hierarchy")

    def reduced(self) -> DataFrame:
        """The records of stored reductions, long."""
        return self._load("mf4_reduced")

    def change_log(self) -> DataFrame:
        return self.history().select("idx", "entry")

    def channel_names(self) -> DataFrame:
        """Names in file order, repeats kept."""
        return self.channels().select("dg_index", "cg_index", "cn_index", "name")

    def channels_of(self, data_group: int) -> DataFrame:
        return self.channels().where(F.col("dg_index") == data_group)

    def map_channel_names(self) -> DataFrame:
        """For each data group the last channel's name and all names."""
        place = F.struct("cg_index", "cn_index")
        own = self.channels().groupBy("file", "dg_index")
        return own.agg(F.max_by("name", place).alias("last_name"), F.transform(F.array_sort(F.collect_list(F.struct("cg_index", "cn_index", "name"))), lambda x: x["name"]).alias("names"))

    def map_channels(self) -> DataFrame:
        """For each data group its last channel."""
        own = self.channels()
        return own.groupBy("file", "dg_index").agg(F.max_by(F.struct(*own.columns), F.struct("cg_index", "cn_index")).alias("c")).select("c.*")

    @property
    def version(self) -> int:
        return self.file.id.number

    def is_finalized(self) -> bool:
        return self.file.id.finalized

    # sink

    def save_attachments(self, folder: str, where: str = "true") -> list[str]:
        """Write the embedded attachments that fit ``where`` to a folder (any file system that Arrow knows); returns their paths.

        The executors write, each file under a temporary name first.  Of attachments with equal names the first one (by file
        and place) keeps it, the others get _1, _2 ..
        """
        uri = folder if "://" in folder else f"file://{os.path.abspath(folder)}"
        fs, root = pafs.FileSystem.from_uri(uri)
        fs.create_dir(root, recursive=True)
        rows = self.attachments().where(where).where("embedded")
        listed = rows.select("file", "idx", "name", "mime_type").orderBy("file", "idx").toLocalIterator()
        names, used = [], set()
        for r in listed:
            stem, end = os.path.splitext(os.path.basename(r.name) or f"file-{r.idx}")
            end = end or (r.mime_type and mimetypes.guess_extension(r.mime_type) or "")
            name, k = stem + end, 0
            while name.lower() in used:
                k += 1
                name = f"{stem}_{k}{end}"
            used.add(name.lower())
            names.append((r.file, r.idx, name))
        if not names:
            return []

        def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fs, root = pafs.FileSystem.from_uri(uri)
            for batch in batches:
                for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    part = f"{root}/.{uuid.uuid4().hex}"
                    with fs.open_output_stream(part, compression=None) as f:
                        f.write(content.as_py() or b"")
                    fs.move(part, f"{root}/{name}")
                yield batch.select([0])

        to = self.spark.createDataFrame(names, "file string, idx int, target string")
        done = {r.target for r in rows.join(F.broadcast(to), ["file", "idx"]).select("target", "content").mapInArrow(write, "target string").collect()}
        at = folder.rstrip("/")
        return [f"{at}/{n}" for _, _, n in names if n in done]


def open_mf4(spark: SparkSession, path: str, **options) -> MeasurementSet:
    return MeasurementSet(spark, path, **options)


__all__ = ["ConversionError", "MeasurementSet", "open_mf4"]
