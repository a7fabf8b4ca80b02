"""Positioned byte reads, with a status for each and no path or scheme in the contract."""

from __future__ import annotations

import os
import re
from enum import Enum
from typing import Protocol

import pyarrow.fs as pafs

from sparkgrid.diagnostics import Code, RasterError


class Status(str, Enum):
    """Outcomes of a read."""

    ok = "ok"
    short_read = "shortRead"
    end_of_source = "endOfSource"
    failed = "failed"


class ByteSource(Protocol):
    def size(self) -> int: ...

    def read(self, offset: int, length: int) -> tuple[Status, bytes]: ...


def _outcome(size: int, offset: int, length: int, data: bytes) -> tuple[Status, bytes]:
    if len(data) == length:
        return Status.ok, data
    return (Status.short_read if data else Status.end_of_source), data


class MemorySource:
    def __init__(self, data: bytes):
        self.data = memoryview(data)

    def size(self) -> int:
        return len(self.data)

    def read(self, offset: int, length: int) -> tuple[Status, bytes]:
        if offset > len(self.data):
            return Status.end_of_source, b""
        return _outcome(len(self.data), offset, length, bytes(self.data[offset : offset + length]))


class FileSource:
    """A file that the reading process sees."""

    def __init__(self, path: str):
        self.path = re.sub(r"^file:(//)?", "", path)
        try:
            self.handle = open(self.path, "rb")  # noqa: SIM115
        except OSError as error:
            raise RasterError(Code.SourceUnavailable, f"cannot open the source: {error.strerror}") from error
        self.length = os.fstat(self.handle.fileno()).st_size

    def size(self) -> int:
        return self.length

    def read(self, offset: int, length: int) -> tuple[Status, bytes]:
        if offset > self.length:
            return Status.end_of_source, b""
        try:
            data = os.pread(self.handle.fileno(), length, offset)
        except OSError:
            return Status.failed, b""
        return _outcome(self.length, offset, length, data)

    def close(self) -> None:
        self.handle.close()


class StoreSource:
    """A file of an object store or HDFS, by URI: reads ask for their range and no more."""

    def __init__(self, uri: str):
        try:
            store, path = pafs.FileSystem.from_uri(uri)
            self.handle = store.open_input_file(path)
            self.length = self.handle.size()
        except (OSError, ValueError, NotImplementedError) as error:
            raise RasterError(Code.SourceUnavailable, f"cannot open the source: {type(error).__name__}") from error

    def size(self) -> int:
        return self.length

    def read(self, offset: int, length: int) -> tuple[Status, bytes]:
        if offset > self.length:
            return Status.end_of_source, b""
        try:
            data = self.handle.read_at(length, offset)
        except OSError:
            return Status.failed, b""
        return _outcome(self.length, offset, length, data)

    def close(self) -> None:
        self.handle.close()


def has_scheme(path: str) -> bool:
    return re.match(r"[A-Za-z][A-Za-z0-9+.-]+:", path) is not None and not path.startswith("file:")


def open_source(path: str) -> FileSource | StoreSource:
    """The source of a local path or of a URI that pyarrow's file systems know."""
    return StoreSource(path) if has_scheme(path) else FileSource(path)


class RecordingSource:
    """Notes every range before it is read."""

    def __init__(self, inner: ByteSource):
        self.inner, self.ranges = inner, []

    def size(self) -> int:
        return self.inner.size()

    def read(self, offset: int, length: int) -> tuple[Status, bytes]:
        self.ranges.append((offset, length))
        return self.inner.read(offset, length)

    def clear(self) -> None:
        self.ranges.clear()

    def distinct_bytes(self) -> int:
        total, upto = 0, 0
        for offset, length in sorted(self.ranges):
            total += max(0, offset + length - max(upto, offset))
            upto = max(upto, offset + length)
        return total

    def touched(self, begin: int, end: int) -> bool:
        return any(n and begin < end and o < end and begin < o + n for o, n in self.ranges)


def exactly(source: ByteSource, offset: int, length: int) -> bytes:
    """The bytes, or a diagnostic of why there are fewer."""
    if offset > source.size() or length > source.size() - offset:
        raise RasterError(Code.TruncatedData, "a read extends beyond the source", byte_offset=offset)
    status, data = source.read(offset, length)
    if status is not Status.ok:
        code = Code.ShortRead if status is Status.short_read else Code.SourceUnavailable
        raise RasterError(code, "the source could not be read", byte_offset=offset)
    return data
