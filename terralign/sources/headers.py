"""Headers of image files, read by ranges: a data source that lists a folder once and reads of each file what its headers need."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition, StringContains, StringEndsWith, StringStartsWith

from .stores import store_of

#: Bytes of one read, of a file's beginning that may hold XMP, and files of a partition at most.
STEP, XMP, FILES = 1 << 14, 1 << 16, 10_000


class Ranges:
    """A file as bytes that are read, STEP at a time, when they are looked at."""

    def __init__(self, file, size: int):
        self.file, self.size, self.held = file, size, {}

    def __len__(self) -> int:
        return self.size

    @property
    def n_read(self) -> int:
        return sum(map(len, self.held.values()))

    def _step(self, i: int) -> bytes:
        if i not in self.held:
            self.file.seek(i * STEP)
            self.held[i] = self.file.read(min(STEP, self.size - i * STEP))
        return self.held[i]

    def __getitem__(self, at):
        if isinstance(at, int):
            return self[at : at + 1][0]
        start, stop, _ = at.indices(self.size)
        if stop <= start:
            return b""
        first = start // STEP
        whole = b"".join(self._step(i) for i in range(first, (stop - 1) // STEP + 1))
        return whole[start - first * STEP : stop - first * STEP]


@dataclass
class Files(InputPartition):
    files: list


class HeaderReader(DataSourceReader):
    def __init__(self, folder: str, parts: int):
        self.folder, self.parts, self.asked = folder.rstrip("/"), parts, []

    def partitions(self) -> list[Files]:
        from pyarrow import fs

        from .images import SUFFIXES

        store, base = store_of(self.folder)
        found = store.get_file_info(fs.FileSelector(base, allow_not_found=True))
        named = sorted((f.base_name, f.size) for f in found if f.is_file and f.base_name[0] not in "._" and f.base_name.lower().endswith(SUFFIXES))
        named = [(name, size) for name, size in named if all(test(f"{self.folder}/{name}", v) for test, v in self.asked)]
        width = max(1, min(FILES, -(-len(named) // self.parts)))
        return [Files(named[i : i + width]) for i in range(0, len(named), width)]

    def read(self, partition: Files) -> Iterator[tuple]:
        from .images import parse_image

        if partition is None:
            return
        store, base = store_of(self.folder)
        for name, size in partition.files:
            with store.open_input_file(f"{base}/{name}") as file:
                content = Ranges(file, size)
                facts, head = parse_image(content), content[:XMP]
                yield f"{self.folder}/{name}", tuple(facts.values()), head.decode("latin-1"), size, content.n_read


class AskedReader(HeaderReader):
    """Used where the session lets Python sources take filters; Spark refuses a reader that could take them elsewhere."""

    def pushFilters(self, filters: list) -> Iterator:
        """Takes the filters on `path` alone: files that they leave out are not opened."""
        test = {EqualTo: lambda p, v: p == v, In: lambda p, v: p in v, StringStartsWith: str.startswith, StringEndsWith: str.endswith, StringContains: str.__contains__}
        for f in filters:
            if type(f) in test and f.attribute == ("path",):
                self.asked.append((test[type(f)], f.value))
            else:
                yield f


class HeaderSource(DataSource):
    """(path, meta, xmp, length, bytes_read) of the image files right in the option `folder`."""

    @classmethod
    def name(cls) -> str:
        return "survey_headers"

    def schema(self) -> str:
        from .images import META_STRUCT

        return f"path string, meta {META_STRUCT}, xmp string, length long, bytes_read long"

    def reader(self, schema) -> HeaderReader:
        kind = AskedReader if self.options["asks"] == "true" else HeaderReader
        return kind(self.options["folder"], int(self.options["parts"]))


def read_headers(spark: SparkSession, uri: str) -> DataFrame:
    """The headers of a folder's image files, by its full URI in a store that pyarrow opens."""
    spark.dataSource.register(HeaderSource)
    parts = 4 * spark.sparkContext.defaultParallelism
    asks = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format("survey_headers").option("folder", uri).option("parts", str(parts)).option("asks", asks).load()
