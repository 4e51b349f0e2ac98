"""File tables walked by Spark tasks, and archives streamed from open files.

A file table is ``(path, size)`` of every file below a folder.  Folders are listed in rounds: each round's
folders are rows that tasks list one level deep, and the folders found are the next round, so neither
the names nor the listing pass through the driver, which reads numbers of rows only.  Files are opened
with Arrow's file systems (local paths, ``file:``, ``s3:``, ``gs:``, ``hdfs:``).
"""

from __future__ import annotations

import io
import tarfile
import zipfile

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusrisk.session import pin

# Fixed value: supported archive suffixes
ARCHIVE_SUFFIXES = (".zip", ".tar.gz")
BATCH_BYTES = 16 << 20  # members that are handed on together

_LISTED = "path string, is_dir boolean, size long"


def local_form(path: str) -> str:
    """``file:`` paths as plain ones, without a slash at the end."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return path.rstrip("/") or "/"


def _opened(path: str) -> tuple[fs.FileSystem, str, str]:
    """File system, path within it, and what stands before that path in the full name."""
    system, inner = fs.FileSystem.from_uri(local_form(path))
    return system, inner, local_form(path)[: -len(inner)] if local_form(path).endswith(inner) else ""


def _listed(batches):
    for batch in batches:
        out = []
        for path in batch.column(0).to_pylist():
            system, inner, prefix = _opened(path)
            out += [(prefix + i.path, i.type == fs.FileType.Directory, i.size or 0) for i in system.get_file_info(fs.FileSelector(inner, allow_not_found=False))]
        columns = list(zip(*out)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.bool_(), pa.int64()))], names=["path", "is_dir", "size"])


def file_table(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """``(path, size)`` of every file in ``path``, and with ``recursive`` below it; empty files too.
    A folder that is not there raises."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    frontier = spark.createDataFrame([(local_form(path),)], "path string")
    found = None
    while True:
        level = pin(frontier.repartition(n, "path").mapInArrow(_listed, _LISTED))
        files = level.filter(~F.col("is_dir")).select("path", "size")
        found = files if found is None else found.unionByName(files)
        frontier = level.filter("is_dir").select("path")
        if not recursive or frontier.limit(1).count() == 0:
            return found


def relative_to(path: str, column: str = "path") -> F.Column:
    """A file's name within the folder ``path``, whichever form of the path the column has."""
    root = local_form(path)
    root = root.split("://", 1)[1] if "://" in root else root
    return F.expr(f"substring({column}, instr({column}, '{root.replace(chr(39), chr(92) + chr(39))}/') + {len(root) + 1})")


class _Seekable(io.RawIOBase):
    """An Arrow file as the standard library's readers want it: bad positions are OSErrors."""

    def __init__(self, file: pa.NativeFile):
        self.file = file

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.file.tell()

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        base = {io.SEEK_SET: 0, io.SEEK_CUR: self.file.tell(), io.SEEK_END: self.file.size()}[whence]
        if base + offset < 0:
            raise OSError("position before the start of the file")
        self.file.seek(base + offset)
        return base + offset

    def readinto(self, buffer) -> int:
        data = self.file.read(len(buffer))
        buffer[: len(data)] = data
        return len(data)


def _members(path: str, suffix: str):
    """(name, bytes) of an archive's members, read one after another from the open file."""
    system, inner, _ = _opened(path)
    if path.endswith(".zip"):
        with system.open_input_file(inner) as f, zipfile.ZipFile(io.BufferedReader(_Seekable(f), 1 << 20)) as z:
            for info in z.infolist():
                if not info.is_dir() and info.filename.endswith(suffix):
                    yield info.filename, z.read(info)
    elif path.endswith(".tar.gz"):
        with system.open_input_stream(inner, compression=None) as f, tarfile.open(fileobj=f, mode="r|gz") as t:
            for m in t:
                if m.isfile() and m.name.endswith(suffix):
                    yield m.name, t.extractfile(m).read()
    else:
        raise ValueError(f"unsupported archive: {path}")


def archive_members(archives: DataFrame, suffix: str = ".c") -> DataFrame:
    """``(archive, path, content BINARY)`` of the members whose names end in ``suffix``, for archives in a
    file table.  A task reads its archives from open files, one member at a time, and hands members on
    by ``BATCH_BYTES``: an archive may be of any size, a member as large as a cell.  A file with
    another suffix than ``ARCHIVE_SUFFIXES`` raises."""
    schema = pa.schema([("archive", pa.string()), ("path", pa.string()), ("content", pa.binary())])

    def run(batches):
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                held, size = [], 0
                for name, data in _members(archive, suffix):
                    held.append((archive, name, data))
                    size += len(data)
                    if size >= BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)

    n = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return archives.select("path").repartition(n, "path").mapInArrow(run, "archive string, path string, content binary")
