"""What the file formats share: listing and opening in any store that Arrow can reach, and sinks that
show their files only when the whole write has succeeded."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import IO

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql.datasource import DataSourceWriter, InputPartition, WriterCommitMessage

PARTITION_BYTES = 64 << 20
_PIECE = 1 << 20


def store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def listed(path: str, suffix: str) -> list[tuple[str, int]]:
    """(path, bytes) of the files under a folder, or of the file itself, whose names end so; hidden parts aside."""
    files, own = store(path)
    info = files.get_file_info(own)
    found = [info] if info.is_file else files.get_file_info(fs.FileSelector(own, recursive=True))
    scheme = path[: path.index("://") + 3] if "://" in path else ""
    return sorted((scheme + f.path, f.size) for f in found if f.is_file and f.path.lower().endswith(suffix) and not any(p[:1] in "._" for p in f.path[len(own) :].split("/") if p))


def opened(path: str) -> IO[bytes]:
    """The file for reading at any place."""
    files, own = store(path)
    return files.open_input_file(own)


def piece(file: IO[bytes], start: int, size: int) -> bytes:
    file.seek(start)
    got = file.read(size)
    if len(got) < size:
        raise ValueError(f"the file ends {size - len(got)} bytes before {start + size}")
    return bytes(got)


@dataclass
class Span(InputPartition):
    """Records or windows from ``start`` up to ``stop`` of one file."""

    path: str
    start: int
    stop: int
    more: tuple = ()


@dataclass
class Done(WriterCommitMessage):
    names: tuple[str, ...]


class FolderSink(DataSourceWriter):
    """Writes each task's files to a hidden folder; the commit moves them, an abort removes them."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path.rstrip("/"), overwrite

    def parts(self, rows: Iterator) -> Iterator[tuple[str, dict[str, IO[bytes]]]]:
        """(name, or "" for one of the sink's own; temporary files by suffix) for each file to write."""
        raise NotImplementedError

    def write(self, iterator: Iterator) -> Done:
        files, own = store(self.path)
        files.create_dir(f"{own}/_parts")
        names = []
        for name, made in self.parts(iterator):
            name = name or f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}"
            for suffix, temp in made.items():
                temp.seek(0)
                with files.open_output_stream(f"{own}/_parts/{name}{suffix}") as out, temp:
                    shutil.copyfileobj(temp, out, _PIECE)
                names.append(name + suffix)
        return Done(tuple(names))

    def commit(self, messages: list[Done | None]) -> None:
        files, own = store(self.path)
        names = [n for m in messages if m for n in m.names]
        if len(set(names)) < len(names):
            raise ValueError("two tasks wrote one file; deal the rows by file first")
        if self.overwrite:
            for old in files.get_file_info(fs.FileSelector(own)):
                if old.is_file:
                    files.delete_file(old.path)
        for name in names:
            files.move(f"{own}/_parts/{name}", f"{own}/{name}")
        files.delete_dir(f"{own}/_parts")
        with files.open_output_stream(f"{own}/_SUCCESS"):
            pass

    def abort(self, messages: list[Done | None]) -> None:
        files, own = store(self.path)
        for name in (n for m in messages if m for n in m.names):
            if files.get_file_info(f"{own}/_parts/{name}").is_file:
                files.delete_file(f"{own}/_parts/{name}")


def temporary() -> IO[bytes]:
    return tempfile.TemporaryFile()
