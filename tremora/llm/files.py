"""Files in the shared folder, opened from tasks by URI (local, HDFS or object store)."""

from __future__ import annotations

import uuid

import pyarrow.fs as pafs


def locate(uri: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


class Written:
    """A file that appears under its own name only when it is complete: a lost attempt leaves no half file."""

    def __init__(self, folder: str, name: str):
        self.fs, self.folder = locate(folder)
        self.uri = f"{folder}/{name}"
        self.path, self.temporary = f"{self.folder}/{name}", f"{self.folder}/.{name}.{uuid.uuid4().hex}"
        self.fs.create_dir(self.folder, recursive=True)
        self.stream = self.fs.open_output_stream(self.temporary)
        self.at = 0

    def write(self, data: bytes) -> None:
        self.stream.write(data)
        self.at += len(data)

    def close(self) -> str:
        self.stream.close()
        self.fs.move(self.temporary, self.path)
        return self.uri


def open_read(uri: str):
    fs, path = locate(uri)
    return fs.open_input_file(path)


def list_files(folder: str) -> list[str]:
    """Names of the files in a folder; none if there is no such folder."""
    fs, path = locate(folder)
    return [
        x.base_name
        for x in fs.get_file_info(pafs.FileSelector(path, allow_not_found=True)) if x.type == pafs.FileType.File
    ]
