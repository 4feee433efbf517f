"""Files beside Spark's own readers and writers: in the shared file system, or any store that Arrow knows."""

from __future__ import annotations

import io
import uuid
from urllib.parse import urlsplit

from pyarrow import fs


def store(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of ``file:/a``, ``/a`` or an address such as ``hdfs://``, ``s3://``, ``gs://``."""
    s = urlsplit(uri)
    return (fs.LocalFileSystem(), s.path) if s.scheme in ("", "file") else fs.FileSystem.from_uri(uri)


class _Seekable(io.RawIOBase):
    """An Arrow file as Python's own kind, whose faults are OSErrors."""

    def __init__(self, file):
        self.file = file

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def seek(self, offset: int, whence: int = 0) -> int:
        to = offset + (0, self.file.tell(), self.file.size())[whence]
        if to < 0:
            raise OSError("before the beginning")
        return self.file.seek(to)

    def tell(self) -> int:
        return self.file.tell()

    def readinto(self, into) -> int:
        data = self.file.read(len(into))
        into[: len(data)] = data
        return len(data)

    def close(self) -> None:
        self.file.close()
        super().close()


def open_seekable(uri: str) -> io.BufferedReader:
    where, path = store(uri)
    return io.BufferedReader(_Seekable(where.open_input_file(path)), 1 << 16)


def put(uri: str, data: bytes) -> None:
    """Write a file whole or not at all: under another name first, then renamed."""
    where, path = store(uri)
    folder, _, name = path.rpartition("/")
    aside = f"{folder}/.{name}.{uuid.uuid4().hex}"
    where.create_dir(folder, recursive=True)
    with where.open_output_stream(aside) as out:
        out.write(data)
    where.move(aside, path)


def get(uri: str) -> bytes:
    where, path = store(uri)
    with where.open_input_stream(path) as file:
        return file.read()


def names(uri: str) -> list[str]:
    """Names in a folder, without hidden ones; none if it is not there."""
    where, path = store(uri)
    found = where.get_file_info(fs.FileSelector(path, allow_not_found=True))
    return sorted(f.base_name for f in found if not f.base_name.startswith("."))
