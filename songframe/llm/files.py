"""Files of our own formats in the folder that driver and executors share.

A file is written under a temporary name that no other attempt of the task uses
and gets its own name when it is whole, so a lost executor leaves no half file
under a name that a manifest could list.
"""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator
from typing import BinaryIO

from pyarrow import fs

TEMPORARY = "_temporary-"
#: Names under which Hadoop knows stores, and those under which Arrow does.
SCHEMES = {"s3a": "s3", "s3n": "s3", "gs": "gs", "s3": "s3", "file": "file", "hdfs": "hdfs", "viewfs": "viewfs", "abfs": "abfs", "abfss": "abfss"}


def address(uri: str) -> str:
    """The URI as Arrow wants it: Hadoop's s3a:// is s3://, bare paths are files."""
    if "://" not in uri:
        return "file://" + uri.removeprefix("file:")
    scheme, rest = uri.split("://", 1)
    if scheme not in SCHEMES:
        raise ValueError(f"{scheme}:// is no store that files of our own formats can be written to; one of {', '.join(SCHEMES)} is")
    return f"{SCHEMES[scheme]}://{rest}"


def _at(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(address(uri))


def make_dir(uri: str) -> str:
    store, path = _at(uri)
    store.create_dir(path, recursive=True)
    return uri


def drop_leftovers(uri: str) -> None:
    """Delete temporary files that killed workers left in a folder; call it once all
    tasks that write to it are over."""
    store, path = _at(uri)
    for x in store.get_file_info(fs.FileSelector(path)):
        if x.is_file and x.base_name.startswith(TEMPORARY):
            store.delete_file(x.path)


class NewFile:
    """A file that appears as `name` in the folder `uri` on commit()."""

    def __init__(self, uri: str, name: str):
        self.store, folder = _at(uri)
        self.name, self.size = name, 0
        self.path, self.temporary = f"{folder}/{name}", f"{folder}/{TEMPORARY}{uuid.uuid4().hex}"
        self.stream = self.store.open_output_stream(self.temporary)

    def write(self, data: bytes) -> None:
        self.stream.write(data)
        self.size += len(data)

    def commit(self) -> None:
        self.stream.close()
        self.store.move(self.temporary, self.path)

    def drop(self) -> None:
        with contextlib.suppress(OSError):
            self.stream.close()
            self.store.delete_file(self.temporary)


@contextlib.contextmanager
def opened(uri: str, name: str) -> Iterator[BinaryIO]:
    store, folder = _at(uri)
    with store.open_input_file(f"{folder}/{name}") as f:
        yield f
