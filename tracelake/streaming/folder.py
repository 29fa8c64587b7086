"""A stream over a folder to which finished measurement files are added."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql.datasource import DataSourceStreamReader
from pyspark.sql.types import StructType

from tracelake.sources import blocks as B
from tracelake.sources.datasource import GroupReader, GroupSource, Span


class FolderStream(DataSourceStreamReader):
    """Offsets name the files of each batch and carry the names read so far, so that files may come in any order of names.

    A file that is not whole or not finalized is left for a later batch; ``max_files`` a batch at most, in name order, but
    for the first batch after a restart: a reader is not told what was read before, so it offers all files and leaves out
    those read when the batch is planned.  An offset grows with the folder: file away what has been read.
    """

    def __init__(self, options: dict):
        self.options = options
        self.most = int(options.get("max_files", 1000))
        self._known: set[str] = set()
        self._told = False  # whether what was read before is known

    def initialOffset(self) -> dict:
        self._told = True
        return {"files": []}

    def _whole(self, path: str) -> bool:
        try:
            with B.Source(path) as src:
                B.MeasurementFile.read(src)
        except (B.MeasurementFileError, OSError, struct.error):
            return False
        return True

    def latestOffset(self) -> dict:
        fresh = [p for p in B.paths_of(self.options["path"]) if p not in self._known]
        with ThreadPoolExecutor(16) as pool:
            ready = [p for p, ok in zip(fresh, pool.map(self._whole, fresh), strict=True) if ok]
        self._known.update(ready[: self.most] if self._told else ready)
        self._told = True
        return {"files": sorted(self._known)}

    def partitions(self, start: dict, end: dict) -> list[Span]:
        self._known.update(end["files"])  # after a restart
        before = set(start["files"])
        return [s for p in end["files"] if p not in before for s in GroupReader({**self.options, "path": p}, StructType())._spans(p)]

    def commit(self, end: dict) -> None:
        pass

    def read(self, part: Span) -> Iterator[pa.RecordBatch]:
        yield from GroupReader({**self.options, "path": part.path}, StructType()).read(part)


class FolderSource(GroupSource):
    """``mf4_stream``: as ``mf4``, for ``spark.readStream``."""

    @classmethod
    def name(cls) -> str:
        return "mf4_stream"

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return FolderStream(dict(self.options))


def register(spark) -> None:
    spark.dataSource.register(FolderSource)


__all__ = ["FolderSource", "register"]
