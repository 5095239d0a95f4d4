"""Sinks that executors write: files from rows, and the blocks of one large file at their places.

Both are data sources. A task may run twice: files are written aside and moved to their names, and a block has one place and
one content, so that what is written twice is the same. Commit messages carry how many rows and bytes each task wrote.
Stores are those that pyarrow opens, places in a file need a folder that all machines mount; `reachable` and `mounted` tell, and
callers let the driver copy row by row where they don't hold.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..sources.stores import mounted, reachable, store_of
from . import files


@dataclass
class Written(WriterCommitMessage):
    rows: int
    size: int


class FileWriter(DataSourceWriter):
    def __init__(self, folder: str, totals: str):
        self.folder, self.totals = folder, totals

    def write(self, rows: Iterator) -> Written:
        store, base = store_of(self.folder)
        n = size = 0
        made: set = set()
        for r in rows:
            path = f"{base}/{r.path}"
            folder = path.rpartition("/")[0]
            if folder not in made:
                store.create_dir(folder, recursive=True)
                made.add(folder)
            aside = f"{path}.{uuid.uuid4().hex}.part"
            with store.open_output_stream(aside) as out:
                out.write(bytes(r.data))
            store.move(aside, path)
            if mounted(self.folder):  # a checksum beside an earlier file of this name would not fit
                Path(f"{folder}/.{path.rpartition('/')[2]}.crc").unlink(missing_ok=True)
            n, size = n + 1, size + len(r.data)
        return Written(n, size)

    def commit(self, messages: list) -> None:
        """What all tasks wrote, as one small file, since a save returns nothing."""
        store, path = store_of(self.totals)
        told = [m for m in messages if m is not None]
        with store.open_output_stream(path) as out:
            out.write(json.dumps({"rows": sum(m.rows for m in told), "size": sum(m.size for m in told)}).encode())


class BlockWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, rows: Iterator) -> Written:
        n = size = 0
        with open(mounted(self.path), "r+b") as out:
            for r in rows:
                out.seek(r.at)
                out.write(bytes(r.data))
                n, size = n + 1, size + len(r.data)
        return Written(n, size)


class FileSink(DataSource):
    """Rows (path, data) as files under the option `folder`; `totals` is where the sums go."""

    @classmethod
    def name(cls) -> str:
        return "survey_files"

    def writer(self, schema, overwrite) -> FileWriter:
        return FileWriter(self.options["folder"], self.options["totals"])


class BlockSink(DataSource):
    """Rows (at, data) into the file of the option `file`, which is there already."""

    @classmethod
    def name(cls) -> str:
        return "survey_blocks"

    def writer(self, schema, overwrite) -> BlockWriter:
        return BlockWriter(self.options["file"])


def write_files(rows: DataFrame, folder: str) -> tuple[int, int]:
    """Writes rows (path, data) as files under a folder, and gives their number and size."""
    spark: SparkSession = rows.sparkSession
    uri = files.full_uri(spark, folder)
    if not reachable(uri):
        n = size = 0
        for r in rows.toLocalIterator():
            n, size = n + 1, size + files.write_bytes(spark, f"{folder}/{r.path}", bytes(r.data))
        return n, size
    spark.dataSource.register(FileSink)
    totals = f"{uri}/written-{uuid.uuid4().hex}.json"
    files.make_folder(spark, folder)
    rows.select("path", "data").write.format("survey_files").mode("append").option("folder", uri).option("totals", totals).save()
    told = json.loads(files.read_text(spark, totals))
    files.delete(spark, totals)
    return told["rows"], told["size"]


def write_blocks(rows: DataFrame, head: bytes, path: str, size: int) -> None:
    """A file of `size` bytes from its head and rows (at, data), the first of which follows the head; it gets its name when it is whole."""
    spark: SparkSession = rows.sparkSession
    aside = f"{path}.{uuid.uuid4().hex}.part"
    uri = files.full_uri(spark, aside)
    if mounted(uri):
        Path(mounted(uri)).parent.mkdir(parents=True, exist_ok=True)
        Path(mounted(uri)).write_bytes(head)  # without the checksums of the JVM's writer, which what follows would belie
        spark.dataSource.register(BlockSink)
        rows.select("at", "data").write.format("survey_blocks").mode("append").option("file", uri).save()
    else:  # stores without places in a file take the blocks in order; one is held at a time
        files.write_stream(spark, aside, head, (bytes(r.data) for r in rows.select("at", "data").orderBy("at").toLocalIterator()))
    if (got := files.size(spark, aside)) != size:
        raise OSError(f"{aside} has {got} bytes, not {size}")
    files.rename(spark, aside, path)
