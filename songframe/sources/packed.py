"""Songs packed one archive each: a data source to read from and to write to.

    packed.register(spark)
    rows.write.format("songs").mode("append").save(folder)     # song, name, content
    spark.read.format("songs").load(folder)

Rows of a song that follow one another in a task go into one archive, so deal them out
first (`packed.by_song`). A task writes its archives under names that no other attempt uses, and
a list of them. What the job wrote can be seen once its driver has written the one
file that names the tasks' lists; a task or a job that fails leaves nothing that a reader
finds, and the job that fails deletes its files. Overwriting puts a mark into that file,
behind which readers do not look.

Reading is one task for each list, archive by archive and entry by entry. The folder is
reached by Arrow's file systems, from the driver and from every executor.
"""

from __future__ import annotations

import io
import json
import time
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "song string, name string, content binary"
#: Names under which Hadoop knows stores that Arrow has another name for.
STORES = {"s3a": "s3", "s3n": "s3"}
COMMITTED, LIST = "_commit-", "_list-"
#: The time of an entry; archives of the same rows are the same bytes.
EPOCH = (1980, 1, 1, 0, 0, 0)


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    scheme, mark, rest = path.partition("://")
    if not mark:
        return fs.FileSystem.from_uri("file://" + path.removeprefix("file:"))
    return fs.FileSystem.from_uri(f"{STORES.get(scheme, scheme)}://{rest}")


def put(path: str, name: str, content: bytes) -> None:
    """A whole file, or none: it is written under another name first."""
    store, folder = store_of(path)
    draft = f"{folder}/_draft-{uuid.uuid4().hex}"
    with store.open_output_stream(draft) as f:
        f.write(content)
    store.move(draft, f"{folder}/{name}")


def get(path: str, name: str) -> bytes:
    store, folder = store_of(path)
    with store.open_input_file(f"{folder}/{name}") as f:
        return f.read()


@dataclass
class TaskList(WriterCommitMessage):
    name: str | None


@dataclass
class OneList(InputPartition):
    name: str


class PackedReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[OneList]:
        store, folder = store_of(self.path)
        names = sorted(x.base_name for x in store.get_file_info(fs.FileSelector(folder)) if x.base_name.startswith(COMMITTED))
        lists: list[str] = []
        for name in names:
            commit = json.loads(get(self.path, name))
            lists = ([] if commit["overwrite"] else lists) + commit["lists"]
        return [OneList(x) for x in lists]

    def read(self, partition: OneList | None) -> Iterator[tuple]:
        if partition is None:  # nothing has been written yet
            return
        store, folder = store_of(self.path)
        for archive, song in json.loads(get(self.path, partition.name)):
            with store.open_input_file(f"{folder}/{archive}") as f, zipfile.ZipFile(f) as z:
                for entry in z.infolist():
                    yield song, entry.filename, z.read(entry)


class PackedWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite
        store, folder = store_of(path)
        store.create_dir(folder, recursive=True)

    def write(self, rows: Iterator[Row]) -> TaskList:
        store, folder = store_of(self.path)
        task, written = uuid.uuid4().hex, []
        song, entries = None, []

        def close() -> None:
            if entries:
                held = io.BytesIO()
                with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
                    for name, content in entries:
                        z.writestr(zipfile.ZipInfo(name, EPOCH), content, zipfile.ZIP_DEFLATED)
                archive = f"{task}-{len(written)}.zip"
                with store.open_output_stream(f"{folder}/{archive}") as f:
                    f.write(held.getvalue())
                written.append((archive, song))

        try:
            for row in rows:
                if row.song is None or row.name is None:
                    raise ValueError("a song and a name must not be null")
                if row.song != song:
                    close()
                    song, entries = row.song, []
                entries.append((row.name, bytes(row.content or b"")))
            close()
        except BaseException:
            for archive, _ in written:  # those of a task that is lost are never listed
                store.delete_file(f"{folder}/{archive}")
            raise
        if not written:
            return TaskList(None)
        put(self.path, f"{LIST}{task}.json", json.dumps(written).encode())
        return TaskList(f"{LIST}{task}.json")

    def commit(self, messages: list[TaskList | None]) -> None:
        lists = [m.name for m in messages if m and m.name]
        put(self.path, f"{COMMITTED}{time.time_ns():020d}-{uuid.uuid4().hex}.json", json.dumps({"overwrite": self.overwrite, "lists": lists}).encode())

    def abort(self, messages: list[TaskList | None]) -> None:
        store, folder = store_of(self.path)
        for name in [m.name for m in messages if m and m.name]:
            for archive, _ in json.loads(get(self.path, name)):
                store.delete_file(f"{folder}/{archive}")
            store.delete_file(f"{folder}/{name}")


class PackedSongs(DataSource):
    @classmethod
    def name(cls) -> str:
        return "songs"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> PackedReader:
        return PackedReader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> PackedWriter:
        return PackedWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PackedSongs)


def by_song(files: DataFrame) -> DataFrame:
    """Files (song, name, content) so dealt out and sorted that each song is one archive; its
    entries are in order of their names."""
    return files.select("song", "name", "content").repartition("song").sortWithinPartitions("song", "name")
