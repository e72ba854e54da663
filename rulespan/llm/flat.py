"""Flat binary files in a folder that driver and executors share, through Arrow's file systems."""

from __future__ import annotations

import os
import uuid

import pyarrow.fs as pafs


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{os.path.abspath(uri)}")


class Writer:
    """A file that appears under its name only when whole, so retried and doubled tasks are harmless."""

    def __init__(self, uri: str):
        self.fs, self.path = _open(uri)
        self.fs.create_dir(os.path.dirname(self.path), recursive=True)
        self.part = f"{self.path}.{uuid.uuid4().hex}"
        self.out, self.size = self.fs.open_output_stream(self.part), 0

    def write(self, data) -> None:
        self.out.write(data)
        self.size += len(data)

    def commit(self) -> int:
        self.out.close()
        self.fs.move(self.part, self.path)
        return self.size

    def abort(self) -> None:
        self.out.close()
        self.fs.delete_file(self.part)


def read_range(uri: str, offset: int, length: int) -> bytes:
    fs, path = _open(uri)
    with fs.open_input_file(path) as f:
        return f.read_at(length, offset)
