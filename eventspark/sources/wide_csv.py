"""Wide CSV files as a Spark data source, for batches and streams: cells as rows, parsed by Arrow in the tasks."""

from __future__ import annotations

import fnmatch
import time
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.csv as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

_CELLS = "id string, code string, cell string"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path and the path in it. Plain paths and those of Hadoop's local form are local."""
    if path.startswith("file:") and not path.startswith("file://"):
        path = path[5:]
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def csv_files(path: str) -> list[tuple[str, int, int]]:
    """(path, bytes, time of change in ns) of the CSV files of a folder, or of those that a pattern or path names, by
    name. Nothing there: none; empty files are left out."""
    store, inner = opened(path)
    info = store.get_file_info(inner.rstrip("/"))
    if info.type == fs.FileType.Directory:
        folder, pattern = inner.rstrip("/"), "*.csv"
    else:
        folder, _, pattern = inner.rpartition("/")
    found = store.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return sorted((f.path, f.size, f.mtime_ns or 0) for f in found if f.type == fs.FileType.File and f.size and f.base_name.endswith(".csv") and fnmatch.fnmatchcase(f.base_name, pattern))


@dataclass
class Files(InputPartition):
    """Files that one task reads."""

    paths: list[str]


def dealt(files: list[tuple[str, int, int]], most: int) -> list[Files]:
    """Files in order, in parts of ``most`` bytes; a larger one is a part of its own."""
    out, room = [], 0
    for path, size, _ in files:
        if not out or size > room:
            out.append(Files([]))
            room = most
        out[-1].paths.append(path)
        room -= size
    return out


class _Cells:
    """Reads the cells of files. The header is read by the task, a block of lines at a time is in memory."""

    def __init__(self, options: dict[str, str]) -> None:
        if "path" not in options:
            raise ValueError("Wide CSV files need a path")
        self.path, self.id_col = options["path"], options.get("idcol", "subject_id")
        self.part_bytes, self.block_bytes = int(options.get("partbytes", 16 << 20)), int(options.get("blockbytes", 4 << 20))

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = opened(self.path)
        for path in partition.paths:
            with store.open_input_stream(path) as f:
                names = pc.open_csv(f, pc.ReadOptions(block_size=self.block_bytes)).schema.names
            if self.id_col not in names:
                continue
            types = pc.ConvertOptions(column_types=dict.fromkeys(names, pa.string()), strings_can_be_null=True, null_values=[""], quoted_strings_can_be_null=True)
            with store.open_input_stream(path) as f, pc.open_csv(f, pc.ReadOptions(block_size=self.block_bytes), convert_options=types) as blocks:
                for block in blocks:
                    ids = block.column(names.index(self.id_col))
                    for i, name in enumerate(names):
                        if name != self.id_col:
                            yield pa.record_batch([ids, pa.repeat(name, len(ids)), block.column(i)], names=["id", "code", "cell"])


class CellReader(_Cells, DataSourceReader):
    def partitions(self) -> list[Files]:
        return dealt(csv_files(self.path), self.part_bytes)


class CellStreamReader(_Cells, DataSourceStreamReader):
    """Each file once, by its time of change. A file is taken when it is ``settle`` seconds old, so that no other of the
    same time can come after it; files must not change, nor be put there with an older time."""

    def __init__(self, options: dict[str, str]) -> None:
        super().__init__(options)
        self.settle = float(options.get("settle", 1))

    def initialOffset(self) -> dict:
        return {"changed": -1}

    def latestOffset(self) -> dict:
        till = time.time_ns() - int(self.settle * 1e9)
        return {"changed": max((c for _, _, c in csv_files(self.path) if c <= till), default=-1)}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        return dealt([f for f in csv_files(self.path) if start["changed"] < f[2] <= end["changed"]], self.part_bytes)

    def commit(self, end: dict) -> None:
        pass


class WideCsv(DataSource):
    """``id, code, cell``: the cells of wide CSV files, each beside its row's id and under its column's name.

    Options: ``path`` (a folder, a pattern in one, a file), ``idCol`` (``subject_id``); files without that column have no
    cells, and files may differ in columns. ``partBytes``: small files share a task up to that size. ``blockBytes``: how
    much of a file a task holds. ``settle``: see ``CellStreamReader``. Cells are text, empty ones null.
    """

    @classmethod
    def name(cls) -> str:
        return "wide_csv"

    def schema(self) -> str:
        return _CELLS

    def reader(self, schema: StructType) -> CellReader:
        return CellReader(self.options)

    def streamReader(self, schema: StructType) -> CellStreamReader:
        return CellStreamReader(self.options)


def reaches(path: str) -> bool:
    """Whether Arrow can list the path's store; others only Spark may reach."""
    try:
        csv_files(path)
    except (OSError, ValueError, NotImplementedError, pa.ArrowException):
        return False
    return True


def read_cells(spark: SparkSession, path: str, id_col: str = "subject_id", **options: str) -> DataFrame:
    spark.dataSource.register(WideCsv)
    return spark.read.format("wide_csv").option("idCol", id_col).options(**options).load(path)


def stream_cells(spark: SparkSession, path: str, id_col: str = "subject_id", **options: str) -> DataFrame:
    spark.dataSource.register(WideCsv)
    return spark.readStream.format("wide_csv").option("idCol", id_col).options(**options).load(path)
